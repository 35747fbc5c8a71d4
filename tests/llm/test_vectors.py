from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from certloom.llm import collisions, queries, topk
from certloom.llm.vectors import against_all

SF = "/root/testdata/sf0.01"


def rows_of(spark, sf=SF):
    return {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}


def test_exact_search_on_awkward_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-3.0, 0.0, 0.5, 2.25]) for _ in range(3)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(60)] + [(2000, None), (2001, [1.0, None, 2.0]), (2002, [math.nan, 1.0, 1.0]), (2003, [math.inf, 1.0, 1.0]),
                                                            (2004, [0.0, 0.0, 0.0]), (2005, [5.0, 5.0]), (None, [9.0, 9.0, 9.0]), (2004, [0.0, 0.0, 0.0]), (2050, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = topk.exact_top_k(df, F.col("id") % 50 == 0, row_block=64, query_block=3).collect()
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk.exact_top_k(df.where("vec_id > 9999"), F.col("id") % 50 == 0).count() == 0


def test_pivots_rule_rows_out():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.rint(rng.normal(size=(1, 16)) * 300 + rng.normal(size=(200, 16)) * 5) for _ in range(20)])
    radius2 = float((x * x).sum(axis=1).max())
    pivots = topk.choose_pivots(x[::7], 24)
    far = lambda rows, up: np.sqrt(((rows[:, None] - pivots) ** 2).sum(axis=2) + (up[:, None] - topk.lifted(pivots, radius2)) ** 2)
    scores, at, evaluated = topk.search_block(x, np.arange(len(x)), far(x, topk.lifted(x, radius2)), x[5], 5, far(x[5:6], np.zeros(1))[0], radius2, 5)
    exact = (x @ x[5]).astype(int)
    exact[5] = -(1 << 60)
    assert at.tolist() == np.lexsort((np.arange(len(x)), -exact))[:5].tolist() and evaluated < len(x) / 2


def test_recall_of_collision_counting(spark):
    vectors = rows_of(spark)
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    found: dict[int, list] = {}
    for r in queries.op10(spark, SF).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in (i for i in ids if i % 20 == 0):
        score = x @ vectors[q]
        score[ids == q] = -9
        best = set(ids[np.lexsort((ids, -score))[:20]])
        hits, total = hits + len(best & {i for i, _ in found[q]}), total + 20
        assert [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
        assert all(abs(s - float(vectors[i] @ vectors[q])) < 1e-12 for i, s in found[q])
    assert hits / total >= 0.9


def test_collision_edges(spark):
    rows = [(20 * i, [1.0, 2.0]) for i in range(30)] + [(1, [0.0, 0.0]), (3, None), (5, [math.nan, 1.0]), (7, [3.0]), (9, [-1.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict[int, list[int]] = {}
    for r in collisions.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [9] + [20 * i for i in range(1, 20)] or got[0] == [20 * i for i in range(1, 21)]
    assert len(got) == 30 and all(len(v) == 20 for v in got.values())
    assert collisions.nearest(df.where("vec_id > 9999"), F.col("id") % 20 == 0).count() == 0


def test_candidates_are_those_of_the_first_level_with_enough():
    """Against windows that are compared with every projection, level by level, from the first one for each query; with many ties."""
    rng = np.random.default_rng(3)
    for x in (rng.standard_normal((300, 6)), rng.integers(1, 4, (200, 3)).astype(float), np.ones((5, 2))):
        queries = x[rng.permutation(len(x))[:20]] * rng.uniform(0.5, 2, (min(20, len(x)), 1))
        index = collisions.Index(x, float(np.sqrt((x * x).sum(axis=1).max())), 16)
        at = np.empty(index.rank.shape)
        for j, rank in enumerate(index.rank):
            at[j] = index.sorted[j][rank]
        centre = (queries / np.sqrt((queries * queries).sum(axis=1))[:, None]) @ index.axes[:-1]
        for i, found in enumerate(index.candidates(queries, 0.75, 0.25, 21)):
            level, want = 0, np.empty(0)
            while len(want) < min(len(x), max(21, math.ceil(0.25 * len(x)))):
                half = collisions.FIRST_WIDTH * index.spread * collisions.GROWTH**level
                inside = (at >= (centre[i] - half)[:, None]) & (at <= (centre[i] + half)[:, None])
                want, level = np.flatnonzero(inside.sum(axis=0) >= 12), level + 1
            assert found.tolist() == want.tolist()


def test_blocks_of_queries_share_groups(spark):
    """With as many groups as are wanted a row moves once for each, not for each block of queries; all pairs meet once."""
    rows = spark.range(400).select("id", F.array(F.lit(1.0)).alias("v"))

    def run(rows, queries):
        return pa.table({"rows": [rows.num_rows], "queries": [queries.num_rows]})

    met = [against_all(rows, F.col("id") % 2 == 0, run, "rows long, queries long", 100, 10, n).collect() for n in (None, 8, 1)]
    assert [len(m) for m in met] == [80, 8, 4]
    assert all(sum(r["rows"] * r["queries"] for r in m) == 400 * 200 for m in met)


def test_nearest_whatever_the_groups(spark, monkeypatch):
    """Floats are sent as floats; queries in blocks of 3, or all together, give the same rows and the same bits."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-40, 40, (400, 5)) / 8 + 0.1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = []
    for groups, frame, block in ((8, df, 256), (1, df, 3), (1, df.withColumn("embedding", F.col("embedding").cast("array<double>")), 3)):
        monkeypatch.setattr(collisions, "GROUPS", groups)
        got.append(sorted(collisions.nearest(frame, F.col("id") % 20 == 0, k=6, row_block=1000, query_block=block).collect()))
    assert got[0] == got[1] == got[2]
    x = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    assert all(r["score"] == (x[r["query_id"]] * x[r["vec_id"]])[None, :].sum(axis=1)[0] for r in got[0])
