"""Vectors by blocks: a stated set of queries against all rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certloom.shipping import by_value

#: Blocks of queries in one group at most; partitions for each group that is wanted, so that few groups meet in one.
TOGETHER = 64
PARTITIONS = 4


def usable(df: DataFrame, key: str, vector: str, allow_zero: bool) -> DataFrame:
    """(id long, v array<double>): one row per id, of vectors without null or non-finite components.

    Rows with a null id or vector take no part; of rows that repeat an id the smallest vector does.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    if not allow_zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column that are equally long."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if width is None else width)


def against_all(rows: DataFrame, is_query: Column, run, schema: str, row_block: int, query_block: int, groups: int | None = None) -> DataFrame:
    """run(rows, queries) for every pair of a block of rows and a block of queries of one vector length.

    rows has id and v, and whatever else run needs; run takes two Arrow tables.
    Blocks are cut by a hash of the id, of `row_block` and `query_block` rows on average,
    so a task holds two blocks whatever the table's size, and each vector moves once per
    block of the other side. Their number comes from two counts. With `groups`, as many groups
    are enough: blocks of queries beyond them, up to TOGETHER, go to run in one table, and rows move once for all of these.
    """
    rows = rows.withColumn("dim", F.size("v"))
    counts = rows.agg(F.count("*").alias("rows"), F.count(F.when(is_query, 1)).alias("queries")).first()
    n_rows, n_queries = max(1, -(-counts["rows"] // row_block)), max(1, -(-counts["queries"] // query_block))
    if groups:
        n_queries = min(n_queries, max(-(-groups // n_rows), -(-n_queries // TOGETHER)))
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.withColumn("rb", part(1, n_rows)).withColumn("qb", every(n_queries))
    b = rows.where(is_query).withColumn("qb", part(2, n_queries)).withColumn("rb", every(n_rows))
    keys = ["dim", "rb", "qb"]
    if groups:
        a, b = (side.repartition(PARTITIONS * min(groups, n_rows * n_queries), *keys) for side in (a, b))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)


def best_first(found: DataFrame, k: int, score: str) -> DataFrame:
    """Each query's k highest scores of what its blocks gave, ties to the smaller id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score).alias("score"))


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


by_value(__name__)
