"""Exact top-k by inner product: a table of distances to pivots rules candidates out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.llm.shared import least_hashed, written
from certloom.llm.vectors import against_all, best_first, matrix, top, usable
from certloom.shipping import by_value

#: Pivots, and the rows (by the least hash of the id) out of which they are chosen.
PIVOTS = 24
SAMPLE = 1024
EXACT = float(1 << 53)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Far-apart rows: each is the one farthest from all before it."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def lifted(x: np.ndarray, radius2: float) -> np.ndarray:
    """One more coordinate puts all rows on a sphere: there the nearest row has the largest inner product."""
    return np.sqrt(np.maximum(radius2 - (x * x).sum(axis=1), 0.0))


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integral vectors; beyond the range of a long they stay at its ends."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < EXACT:
        return (x @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in whole], dtype=np.int64)


def search_block(x: np.ndarray, ids: np.ndarray, table: np.ndarray, q: np.ndarray, own: int, to_pivots: np.ndarray,
                 radius2: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and positions of one query's k best rows of a block, and how many rows were evaluated.

    |d(q, p) - d(x, p)| is at most d(q, x) for every pivot p. The largest of these
    bounds limits x's inner product from above; rows are evaluated by falling limit until
    the k-th best score lies above the next one.
    """
    bound = np.abs(table - to_pivots).max(axis=1)
    limit = ((q * q).sum() + radius2 - bound * bound) / 2
    limit += 1e-9 * (abs(limit) + radius2 + 1)  # rounding of the distances
    order = np.argsort(-limit, kind="stable")
    order = order[ids[order] != own]
    scores, at, step, evaluated = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 64, 0
    while evaluated < len(order):
        if len(scores) == k and limit[order[evaluated]] < scores[-1]:
            break
        chunk = order[evaluated : evaluated + step]
        evaluated, step = evaluated + len(chunk), 2 * step
        scores, at = np.concatenate([scores, _products(x[chunk], q)]), np.concatenate([at, chunk])
        best = top(scores, ids[at], k)
        scores, at = scores[best], at[best]
    return scores, at, evaluated


def exact_top_k(df: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding",
                pivots: int = PIVOTS, row_block: int = 8192, query_block: int = 1024) -> DataFrame:
    """Each query's k rows with the highest inner product of floor(scale * component) vectors.

    is_query: a condition on the column `id`. Gives query_id, rank (from 1), vec_id and
    score (long), ties to the smaller vec_id; fewer rows where fewer candidates exist. A
    vector is compared with those of its own length. Vectors that are null, empty or hold
    null or non-finite components take no part; of rows that repeat an id one does. An
    empty table gives no rows. All other columns are left aside.

    The pivots come from a sample of `SAMPLE` rows, whatever the table's size; they
    only steer how much is ruled out. Distances to them are computed once per row and written.
    """
    rows = usable(df, key, vector, allow_zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = written(rows.withColumn("norm2", norm2))
    radius2 = float(rows.agg(F.max("norm2")).first()[0] or 0.0)
    sample = least_hashed(rows, SAMPLE, "id").select("v").toArrow().column("v").to_pylist()
    by_dim: dict[int, np.ndarray] = {}
    for dim in {len(v) for v in sample}:
        by_dim[dim] = choose_pivots(np.array([v for v in sample if len(v) == dim]), pivots)

    def distances(x: np.ndarray) -> np.ndarray:
        """To the pivots, on the sphere; where no pivot has that length, the origin is the pivot."""
        p = by_dim.get(x.shape[1], np.zeros((1, x.shape[1])))
        up, up_p = lifted(x, radius2), lifted(p, radius2)
        square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T) + (up[:, None] - up_p) ** 2
        return np.sqrt(np.maximum(square, 0.0))

    def with_table(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes, tables = np.array(lists.value_lengths()), [None] * batch.num_rows
            for dim in set(sizes.tolist()):
                rows_of = np.flatnonzero(sizes == dim)
                for i, d in zip(rows_of.tolist(), distances(matrix(lists.take(pa.array(rows_of)), dim)), strict=True):
                    tables[i] = d
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(tables, type=pa.list_(pa.float64()))], names=["id", "v", "far"])

    def run(rows, queries):
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and queries.num_rows:
            ids, x, table = rows["id"].to_numpy(), matrix(rows["v"]), matrix(rows["far"])
            q = matrix(queries["v"])
            p = by_dim.get(q.shape[1], np.zeros((1, q.shape[1])))
            square = (q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (q @ p.T) + lifted(p, radius2) ** 2
            to = np.sqrt(np.maximum(square, 0.0))  # a query lies at 0 of the added coordinate
            for i, own in enumerate(queries["id"].to_numpy()):
                scores, at, _ = search_block(x, ids, table, q[i], own, to[i], radius2, k)
                out.append((np.full(len(at), own), ids[at], scores))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 3
        return pa.table([pa.array(c, type=pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    ready = written(rows.select("id", "v").mapInArrow(with_table, "id long, v array<double>, far array<double>"))
    found = against_all(ready, is_query, run, "query_id long, vec_id long, score long", row_block, query_block)
    return best_first(found, k, "long")


by_value(__name__)
