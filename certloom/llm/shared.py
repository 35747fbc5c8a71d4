"""Tables between the jobs of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster names.

    Where it is unset a local session gets a temporary folder (tests); a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, at: str | None = None) -> DataFrame:
    """The rows, written as Parquet and read again: the lineage ends there and the true size is known to the planner."""
    spark = df.sparkSession
    at = at or folder(spark)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it a job's shuffle files go when the job ends; else they stay until the driver happens to collect its garbage.

    For operators that write their tables: no later job reads the shuffles of an earlier one.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def free_name(taken: list[str], name: str) -> str:
    """`name`, with underscores before it while a column of the caller has it (Spark's names ignore case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def least_hashed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows (or all, if fewer) of about the least hash of the keys, a sample that a rerun gives again.

    A count sets a bound of the hash that about 2n rows meet; only those are sorted, so no task gets more.
    """
    total = df.count()
    bound = min(1 << 30, (2 * n << 30) // max(total, 1) + 1)
    order = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    return df.where(order < bound).orderBy(order, *keys).limit(n)
