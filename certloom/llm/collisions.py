"""Approximate nearest neighbours by counting collisions in query-centred windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from certloom.llm.shared import written
from certloom.llm.vectors import against_all, best_first, matrix, top, usable
from certloom.shipping import by_value

#: Projections; the share of them in which a candidate must collide; the share of a block's rows that
#: must have reached it before windows stop growing; the first half width, in standard deviations of a
#: projection, and its growth from one level to the next.
PROJECTIONS = 64
THRESHOLD = 0.75
ENOUGH = 0.25
FIRST_WIDTH = 0.5
GROWTH = 1.15
#: Groups of blocks for each core; queries whose products with a block of rows are computed at once.
GROUPS = 8
AT_ONCE = 32


def directions(dim: int, count: int, seed: int = 7) -> np.ndarray:
    """Random unit vectors, orthogonal to each other by groups of `dim`."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.hstack(groups)[:, :count]


class Index:
    """The sorted projections of a block of vectors on every direction, and each vector's rank in them."""

    def __init__(self, x: np.ndarray, radius: float, projections: int) -> None:
        unit = x / radius
        self.up = np.sqrt(np.maximum(1 - (unit * unit).sum(axis=1), 0.0))
        self.axes = directions(x.shape[1] + 1, projections)
        at = unit @ self.axes[:-1] + self.up[:, None] * self.axes[-1]
        self.n, self.spread = len(x), float(at.std()) or 1.0
        by_direction = np.ascontiguousarray(at.T)
        order = np.argsort(by_direction, axis=1)
        self.sorted = np.take_along_axis(by_direction, order, axis=1)
        self.rank = np.empty(order.shape, dtype=np.min_scalar_type(self.n))
        np.put_along_axis(self.rank, order, np.arange(self.n, dtype=self.rank.dtype)[None, :], axis=1)

    def candidates(self, queries: np.ndarray, threshold: float, enough: float, least: int):
        """Per query the positions that collide with it in enough directions.

        A window around the query's own projection grows level by level until enough positions
        have reached the threshold. All of those are candidates. More collide at every level than at the one before,
        so the search for the first level with enough of them begins at that of the query before.
        """
        m = self.rank.shape[0]
        need, target = max(1, int(np.ceil(threshold * m))), min(self.n, max(least, int(np.ceil(enough * self.n))))
        norms = np.sqrt((queries * queries).sum(axis=1))[:, None]
        centre = (queries / norms) @ self.axes[:-1]
        windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def window(level: int, i: int) -> tuple[np.ndarray, np.ndarray]:
            """Per direction the first rank inside, and how many there are."""
            if level not in windows:
                half = FIRST_WIDTH * self.spread * GROWTH**level
                low, high = (np.stack([np.searchsorted(self.sorted[j], centre[:, j] + side * half, side=how) for j in range(m)], axis=1)
                             for side, how in ((-1, "left"), (1, "right")))
                windows[level] = low.astype(self.rank.dtype), (high - low).astype(self.rank.dtype)
            low, width = windows[level]
            return low[i], width[i]

        def colliding(level: int, i: int) -> np.ndarray:
            low, width = window(level, i)
            inside = self.rank - low[:, None] < width[:, None]  # a rank below the window wraps around to a large number
            return np.flatnonzero(inside.sum(axis=0, dtype=np.min_scalar_type(m)) >= need)

        level = 0
        for i in range(len(queries)):
            found = colliding(level, i)
            if len(found) >= target:
                while level and len(fewer := colliding(level - 1, i)) >= target:
                    level, found = level - 1, fewer
            else:
                while len(found) < target and (window(level, i)[1] < self.n).any():
                    level += 1
                    found = colliding(level, i)
            yield found


def likely(scores: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Positions of all scores that may be among the k highest if each is off by half of `slack` at most."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(~(scores < np.partition(scores, len(scores) - k)[len(scores) - k] - slack))


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            projections: int = PROJECTIONS, threshold: float = THRESHOLD, enough: float = ENOUGH,
            row_block: int = 32768, query_block: int = 256) -> DataFrame:
    """Each query's k nearest rows found, by largest inner product.

    is_query: a condition on the column `id`. Gives query_id, rank (from 1), vec_id, score
    (the inner product of the original vectors in double precision), ties to the smaller vec_id.
    Vectors are lifted onto a sphere whose radius is the largest norm of all, where the nearest
    have the largest inner product. Every row is in the index of its block; every row
    whose collisions reach the threshold is verified, however many they are: by a product of
    matrices, and those that rounding leaves among the nearest by their own sum.

    Vectors that are null, zero, empty or hold null or non-finite components take no part; of rows
    that repeat an id one does; vectors are compared with those of their own length. An empty table
    gives no rows. All other columns are left aside.
    """
    rows = usable(df, key, vector, allow_zero=False)
    kind = df.select(F.col(vector)).schema[0].dataType
    if isinstance(kind, ArrayType) and kind.elementType == FloatType():  # half as wide, and the same numbers
        rows = rows.withColumn("v", F.col("v").cast("array<float>"))
    rows = written(rows)
    norm2 = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    radius = float(rows.agg(F.max(norm2)).first()[0] or 1.0) ** 0.5

    def run(rows, queries):
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and queries.num_rows:
            ids, x, q = rows["id"].to_numpy(), *(matrix(side["v"]).astype(float, copy=False) for side in (rows, queries))
            index = Index(x, radius, projections)
            own = queries["id"].to_numpy()
            # more than twice what rounding makes between the two ways of adding up, for any row
            slack = 8 * x.shape[1] * np.finfo(float).eps * radius * np.sqrt((q * q).sum(axis=1)) + np.finfo(float).tiny
            for start in range(0, len(q), query_block):
                block = q[start : start + query_block]
                for i, found in enumerate(index.candidates(block, threshold, enough, k + 1), start):
                    if (i - start) % AT_ONCE == 0:
                        products = block[i - start : i - start + AT_ONCE] @ x.T
                    found = found[ids[found] != own[i]]
                    found = found[likely(products[(i - start) % AT_ONCE][found], k, slack[i])]
                    scores = (x[found] * q[i]).sum(axis=1)
                    best = top(scores, ids[found], k)
                    out.append((np.full(len(best), own[i]), ids[found][best], scores[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 3
        return pa.table([pa.array(c.astype(t), type=a) for c, t, a in zip(cols, (np.int64, np.int64, float), (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                        names=["query_id", "vec_id", "score"])

    found = against_all(rows, is_query, run, "query_id long, vec_id long, score double", row_block, query_block,
                        GROUPS * df.sparkSession.sparkContext.defaultParallelism)
    return best_first(found, k, "double")


by_value(__name__)
