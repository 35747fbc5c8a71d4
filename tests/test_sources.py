from __future__ import annotations

import csv
import json
import random
from datetime import datetime

from pyspark.sql import functions as F

from certloom.operators import enrich, records
from certloom.sources import csv_lines, readers, writers


def test_ragged_csv_keeps_rows_and_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t\na,b,c,d\n1.0,2,3.5\n\n,x\n", encoding="utf-8")
    rows = readers.read_sheet_rows(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(len(rows)))
    assert rows[1].cells == ["a", "b", "c", "d"] and rows[2].cells[:3] == ["1", "2", "3.5"]


def test_rows_of_a_split_file_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"{n},x\n" for n in range(3000)), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_sheet_rows(spark, str(tmp_path))
        assert rows.where(F.col("cells")[0].cast("long") != F.col("row_idx")).count() == 0
        assert rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quoted_cells_across_lines_and_splits(spark, tmp_path):
    dice = random.Random(5)
    bits = ["a", '"', ",", "\n", "", "天平", "x y", '""', "\n\n", "7"]
    want = {}
    for name in ("a", "b"):
        rows = [["".join(dice.choices(bits, k=dice.randrange(12))) for _ in range(dice.randrange(2, 6))] for _ in range(400)]
        with open(tmp_path / f"{name}.csv", "w", encoding="utf-8", newline="") as out:
            csv.writer(out, lineterminator="\n").writerows(rows)
        want[name] = rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = spark.read.text(str(tmp_path)).select(
            F.regexp_extract("_metadata.file_path", r"(\w)\.csv$", 1).alias("file_id"),
            F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("in_block"), "value")
        assert lines.select("block_start").distinct().count() > 5
        got = csv_lines.records_of_lines(lines).select("file_id", "row_idx", csv_lines.cells_of(F.col("record")).alias("cells")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, rows in want.items():
        read = {r.row_idx: r.cells for r in got if r.file_id == name}
        assert [read[n] for n in range(len(read))] == rows


def test_stray_and_unclosed_quotes(spark):
    lines = ['5" pipe,x', '"done"x,2', "", 'a,"b', "c,d"]
    made = spark.createDataFrame([("f", n // 2, n, v) for n, v in enumerate(lines)], "file_id string, block_start long, in_block long, value string")
    got = {r.row_idx: r.cells for r in csv_lines.records_of_lines(made).select("row_idx", csv_lines.cells_of(F.col("record")).alias("cells")).collect()}
    assert got == {0: ['5" pipe', "x"], 1: ["donex", "2"], 2: ["a", '"b\nc', "d"]}
    assert csv_lines.records_of_lines(made.limit(0)).count() == 0


def test_lossy_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿设备名称".encode())
    (tmp_path / "b.txt").write_bytes("设备名称".encode("gb18030"))
    out = readers.read_text_lossy(spark, str(tmp_path)).collect()
    assert {r.text for r in out} == {"设备名称"} and len(out) == 2


def test_catalog_list(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1. 天平，T1\n2、卡尺|x\n设备名称\n-\n天 平\n", encoding="utf-8")
    first = enrich.union_candidates([readers.read_catalog_list(spark, str(tmp_path))])
    assert sorted(r.name for r in first.collect()) == ["卡尺", "天平"]


def test_seeds_and_tasks(spark, tmp_path):
    seed = {"seed_key": "s", "row_count": 1, "rows": [{"row_number": 1, "raw_record": "2.11", "fields": {"col_01": "2.11"}}]}
    (tmp_path / "seed.json").write_text(json.dumps(seed), encoding="utf-8")
    row = readers.read_seed_records(spark, str(tmp_path / "seed.json")).first()
    assert (row.seed_key, row.fields) == ("s", {"col_01": "2.11"})
    task = {"id": "t", "task_name": "n", "status": "草稿", "archived": False, "template_info": {"record_no": "20240101-001"},
            "workspace_draft": {"queue": [{"id": "q", "fields": {"a": "1"}}, {"id": "r", "fields": {}}]}}
    for n, archived in enumerate((False, True)):
        (tmp_path / f"task{n}.json").write_text(json.dumps({**task, "id": f"t{n}", "archived": archived}), encoding="utf-8")
    tasks = readers.read_tasks(spark, str(tmp_path / "task*.json"))
    assert [(r.id, r.queue_size) for r in readers.task_list(tasks).collect()] == [("t0", 2)]
    assert readers.task_queue(tasks).count() == 4


def test_import_schema_file(spark, tmp_path):
    (tmp_path / "schema.csv").write_text("基础,,水压试验,\n检验日期,Owner code,试验压力MPa,试验压力MPa\n", encoding="utf-8")
    columns = readers.read_import_schema(readers.read_sheet_rows(spark, str(tmp_path)))
    rows = columns.orderBy("index").collect()
    assert [r.key for r in rows] == ["col_01", "owner_code", "mpa", "mpa_2"]
    assert [r.grp for r in rows] == ["基础", "基础", "水压试验", "水压试验"]
    rules = spark.createDataFrame([("label", "检验日期", "L"), ("key", "owner_code", "K"), ("field", "owner_code", "F")], "kind string, name string, rule string")
    assert {r.key: r.rule for r in readers.attach_rules(columns, rules).collect()} == {
        "col_01": "L", "owner_code": "F", "mpa": None, "mpa_2": None}


def test_schema_from_config():
    out = readers.schema_from_config(
        [{"key": "a", "label": "A"}], {"a": {"type": "number", "normalize": {"o_to_0": True}, "choices": [{"label": "x"}]}})
    assert out[0].rule.type == "number" and out[0].rule.o_to_0 and out[0].rule.choices == [("x", [])]


def test_writers(spark, tmp_path):
    catalog = spark.createDataFrame([("天平", "T1", "N1", "0~9", "", "K1", "", "NIM")], "name string, model string, code string, measurement_range string, uncertainty string, certificate_no string, valid_date string, traceability_institution string")
    writers.write_tsv(writers.instrument_table(catalog), str(tmp_path / "tsv"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).first()
    assert back["计量标准气瓶名称"] == "天平" and back["证书编号/有效期"] == "K1"
    rows = spark.createDataFrame([(1, "r", "T", {"a": "v"}), (2, "s", "U", {})], "row_number int, row_name string, template_name string, values map<string,string>")
    templates = spark.createDataFrame([("T", "x{{a}}")], "template_name string, body string")
    out = records.render_text_batch(rows, templates)
    writers.write_rendered(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().output == "xv"
    assert writers.write_version(out.select("row_number"), str(tmp_path / "v"), 3).endswith("version=3")


def test_file_manifest_and_expiry(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    row = readers.file_manifest(files).first()
    assert (row["size"], row.md5, row.ok) == (3, "900150983cd24fb0d6963f7d28e17f72", True)
    assert readers.expire_files(files, datetime(2000, 1, 1)).first().expired is False
    assert readers.expire_files(files, datetime(2100, 1, 1)).first().expired is True
