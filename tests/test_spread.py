"""Work on rows: over all cores and once per row."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from certloom.plans import spread

SF = "/root/testdata/sf0.001"


def test_one_row_group_is_spread_over_all_cores(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"x": list(range(5000))}), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        frame = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert frame.rdd.getNumPartitions() >= cores
        sizes = spread(frame).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 5000 and sum(n > 0 for n in sizes) >= cores and max(sizes) <= 2 * 5000 / cores


@pytest.mark.parametrize("name", [
    "explode_devices", "validate_stage", "group_rollup", "typed_projection", "resolve_payload", "match_requirements"])
def test_rows_are_worked_on_once_and_after_the_shuffle(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Repartition", 1)
    assert "Filter" not in plan
    assert not re.search(r"lambda|regexp|rlike", below, re.IGNORECASE)


def test_catalog_rows_are_spread(spark):
    plan = entry.queries()["write_tsv"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


def test_profiles_are_made_once(spark):
    plan = entry.queries()["profile_changes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "一般检查" not in plan


def test_texts_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        rows = entry.queries()["read_text_lossy"](spark, SF).count()
        assert rows == spark.read.parquet(f"{SF}/documents.parquet").count() and int(spark.conf.get(key)) <= 500
    finally:
        spark.conf.set(key, before)


def test_linearity_is_worked_out_once(spark):
    plan = entry.queries()["linearity_metrics"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
