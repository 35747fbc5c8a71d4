"""Blocked scans give what a plain window gives, whatever the block size and skew."""

from __future__ import annotations

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from certloom.operators import lookups, ordered


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows; a null key and gaps in the order."""
    n = F.col("id")
    key = F.when(n % 10 < 7, "hot").when(n % 10 == 7, None).otherwise(F.concat(F.lit("k"), (n % 3).cast("string")))
    return spark.range(0, 2000, 1, 8).select(
        key.alias("k"), (n * 7 - 3000).alias("o"), F.when(n % 5 == 0, n.cast("string")).alias("v"), (n % 4).alias("x"))


@pytest.mark.parametrize("block", [1, 13, 1 << 16])
def test_carry_last(rows, block):
    window = W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, 0)
    plain = rows.withColumn("v", F.last("v", True).over(window))
    got = ordered.carry_last(rows, ["k"], "o", ["v"], block)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    again = ordered.carry_last(got, ["k"], "o", ["v"], block)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum_and_max(rows, inclusive):
    window = W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    plain = rows.withColumns({"s": F.coalesce(F.sum("x").over(window), F.lit(0)), "m": F.max("x").over(window)})
    got = ordered.running(rows, ["k"], "o", {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, inclusive, 50)
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_row_numbers(rows):
    plain = rows.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("o")))
    got = ordered.row_numbers(rows, ["k"], "o", "n", 100)
    assert sorted((str(r.k), r.o, r.n) for r in got.collect()) == sorted((str(r.k), r.o, r.n) for r in plain.collect())


@pytest.mark.parametrize("kind", ["hash", "time", "clustered"])
def test_sparse_orders(spark, kind):
    """Hashes, time stamps and a crowd between outliers, one key with most rows: right, and blocks of about equal size."""
    n = F.col("id")
    order = {"hash": F.xxhash64("id"), "time": F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(10**12))),
             "clustered": F.when(n == 0, -(1 << 60)).when(n == 1, 1 << 60).otherwise(n)}[kind]
    data = spark.range(0, 4000, 1, 8).select(
        F.when(n % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), (n % 7).cast("string"))).alias("k"), order.alias("o"),
        F.when(n % 5 == 0, n.cast("string")).alias("v"), (n % 4).alias("x"))
    window = W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, 0)
    plain = data.withColumns({"l": F.last("v", True).over(window), "s": F.sum("x").over(window), "m": F.max("x").over(window)})
    got = ordered.running(data, ["k"], "o", {"l": ("last", F.col("v")), "s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, block=None, rows=200)
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    sizes = data.groupBy("k", ordered.measured_block(data, "o", 200).alias("b")).count().collect()
    assert max(r["count"] for r in sizes) <= 400 and len({r["b"] for r in sizes}) >= 15


def test_ties_follow_the_further_columns(spark):
    data = spark.range(0, 600).select(F.lit("a").alias("k"), (F.col("id") % 30).alias("o"), F.col("id").alias("t"), F.lit(1).alias("x"))
    window = W.partitionBy("k").orderBy("o", "t").rowsBetween(W.unboundedPreceding, 0)
    got = ordered.running(data, ["k"], "o", {"s": ("sum", F.col("x"))}, block=None, ties=["t"], rows=50)
    plain = data.withColumn("s", F.sum("x").over(window))
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_hot_key_is_spread(rows):
    """No window of the blocked scan sees more rows than the block is wide."""
    wide = rows.withColumn("b", F.floor(F.col("o") / 700)).groupBy("k", "b").count().agg(F.max("count")).first()[0]
    assert wide <= 100


def test_lookup_join_spreads_missing_keys(spark, rows):
    lookup = spark.createDataFrame([("hot", 1)], "k string, y int")
    out = lookups.lookup_join(rows, lookup, {"k": F.col("k")}, {"y": "found"}, F.col("o"))
    assert out.count() == rows.count()
    assert out.where("found = 1").count() == rows.where("k = 'hot'").count()


def test_patterns_in_shards_and_at_once_are_alike(spark):
    """More patterns than a shard holds, nested and overlapping ones, a text of 20,000 words."""
    words = [f"w{i}x" for i in range(300)] + ["w1", "x w", "1x w2"]
    texts = [(i, " ".join(f"w{(i * 7 + j) % 400}x" for j in range(40))) for i in range(60)] + [(99, " ".join(f"w{j % 350}x" for j in range(20_000))), (100, None)]
    frame, needles = spark.createDataFrame(texts, "id int, t string").repartition(4), spark.createDataFrame([(w, len(w)) for w in words], "w string, n int")
    want = {(i, w, len(w)) for i, t in texts for w in words if t and w in t}
    for shard in (10_000, 40):
        assert {tuple(r) for r in lookups.pattern_hits(frame, "id", F.col("t"), needles, "w", ["n"], shard=shard).collect()} == want


def test_keyed_lookup_serves_all_kinds(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, None)], "id int, p string, q string")
    both = lookups.composite(F.col("p"), F.col("q"))
    assert {r[0] for r in rows.select(both).collect()} == {"1:ax", None}
    probes = lookups.keyed(rows, {"p": F.col("p"), "pq": both, "many": F.array("p", "q")}, {"row": F.col("id")})
    entries = spark.createDataFrame([("p", "a", 1), ("pq", "1:ax", 2), ("many", "x", 4)], "which string, key string, v int")
    out = lookups.lookup_many(rows, "id", probes, entries, {"s": F.sum("v")})
    assert {(r["id"], r["s"]) for r in out.collect()} == {(1, 7), (2, 1), (3, None)}


def test_pattern_hits(spark):
    texts = spark.createDataFrame([(1, "局部放电测试系统x"), (2, "ab"), (3, "")], "id int, t string")
    words = spark.createDataFrame([("局部放电",), ("b",), ("放电测试系统",), ("zz",), ("",)], "w string")
    out = lookups.pattern_hits(texts, "id", F.col("t"), words, "w", [])
    assert {(r.id, r.w) for r in out.collect()} == {(1, "局部放电"), (1, "放电测试系统"), (2, "b")}
