"""Sources."""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StringType

from certloom import vocab
from certloom.functions import text as tx
from certloom.functions.cells import FieldRule
from certloom.functions.text import let, placeholder_to_null, squeeze, strip, token
from certloom.operators.cells import SchemaColumn
from certloom.operators.extract import split_certificate
from certloom.operators.ordered import first_per_key
from certloom.shipping import by_value
from certloom.sources.csv_lines import cells_of, records_of_lines

by_value(__name__)

# --- sheets -----------------------------------------------------------------


def clean_cell(c: Column) -> Column:
    """Cell as text; whole numbers lose their '.0'."""
    return F.regexp_replace(strip(c), r"^(\d+)\.0$", "$1")


def read_sheet_rows(spark: SparkSession, path: str, sheet: str = "s1", separator: str = ",") -> DataFrame:
    """CSV files as sheet rows (file_id, sheet, row_idx, cells), read in one scan.

    Rows keep the cells they have, however many. Quoted cells may hold separators, doubled quotes and line feeds.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("in_block"), "value")
    cells = F.transform(cells_of(F.col("record"), separator), clean_cell)
    return records_of_lines(lines, separator).select("file_id", F.lit(sheet).alias("sheet"), "row_idx", cells.alias("cells"))


def rows_from_columns(df: DataFrame, file_id: Column, sheet: Column, row_idx: Column, columns: list[str]) -> DataFrame:
    """Sheet rows out of any table (parquet, orc, jdbc)."""
    return df.select(
        file_id.alias("file_id"), sheet.alias("sheet"), row_idx.cast("long").alias("row_idx"),
        F.array(*[clean_cell(F.col(c)) for c in columns]).alias("cells"))


def long_cells(rows: DataFrame) -> DataFrame:
    """(file_id, sheet, row_idx, col_idx, value) of the non-empty cells."""
    return rows.select("file_id", "sheet", "row_idx", F.posexplode("cells").alias("col_idx", "value")).where("value <> ''")


# --- texts ------------------------------------------------------------------


#: Texts that a Python worker holds at a time.
TEXTS_AT_ONCE = 500


def small_batches(spark: SparkSession) -> None:
    """Python workers get few texts at a time from now on, so that their memory doesn't grow with the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_AT_ONCE)


@F.pandas_udf(StringType())
def _decode_gb18030(content: pd.Series) -> pd.Series:
    def one(raw: bytes) -> str:
        try:
            return bytes(raw).decode("gb18030")
        except UnicodeDecodeError:
            return ""

    return content.map(one)


def decode_lossy(files: DataFrame, content: str = "content") -> DataFrame:
    """Add text: UTF-8 (with or without mark) in the JVM, other bytes as GB18030."""
    small_batches(files.sparkSession)
    raw = F.col(content)
    valid = F.is_valid_utf8(raw.cast("string"))
    utf8 = files.where(valid).withColumn("text", F.regexp_replace(F.decode(raw, "UTF-8"), "^﻿", ""))
    other = files.where(~valid).withColumn("text", _decode_gb18030(raw))
    return utf8.unionByName(other)


def read_text_lossy(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return decode_lossy(files).select("path", "text")


# --- catalogues -------------------------------------------------------------


def catalog_line(c: Column, paragraph: bool = False) -> Column:
    """Item name of a list line: numbering cut, text up to the first comma or pipe."""
    value = squeeze(c)
    number = r"^\s*(?:\(?\d+\)?|[一二三四五六七八九十]+)\s*[.)、．）]\s*" if paragraph else r"^\s*\d+\s*[.)、．]\s*"
    out = F.regexp_replace(value, number, "")
    cut = (
        F.when(out.contains(","), F.substring_index(out, ",", 1)).when(out.contains("，"), F.substring_index(out, "，", 1))
        .when(out.contains("|"), F.substring_index(out, "|", 1)).otherwise(out))
    return placeholder_to_null(cut)


def read_catalog_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name) candidates of a text list; see enrich.union_candidates."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")
    return lines.select("ord", catalog_line(F.col("value")).alias("name")).where("name IS NOT NULL")


def catalog_columns(cells: Column) -> Column:
    """struct of the zero-based column of each catalogue key in a row, null where it has none."""
    tokens = F.transform(cells, token)

    def build(ts: Column) -> Column:
        def place(key: str) -> Column:
            words = "|".join(vocab.CATALOG_HEADERS[key])
            certificate = "|".join(vocab.CATALOG_HEADERS["certificate_no"])

            def test(t: Column) -> Column:
                hit = t.rlike(words)
                if key == "code":
                    hit = hit & ~t.rlike(certificate)
                if key in ("certificate_no", "valid_date"):
                    hit = hit | (t.contains("证书编号") & t.contains("有效期")) | (
                        t.contains("certificatenumber") & t.contains("valid"))
                return hit

            return (F.nullif(F.array_position(F.transform(ts, test), True), F.lit(0).cast("long")) - 1).cast("int")

        return F.struct(*[place(k).alias(k) for k in vocab.CATALOG_KEYS])

    return let(tokens, build)


def catalog_from_rows(rows: DataFrame) -> DataFrame:
    """Catalogue rows (file_id, sheet, row_idx, 8 keys) of sheet rows.

    The header is the first row with a name column; a sheet without one gives
    the first filled cell of each row as a name.
    """
    keyed = rows.where(F.exists("cells", lambda x: x != "")).withColumn("m", catalog_columns(F.col("cells")))
    sheet = ["file_id", "sheet"]
    heads = keyed.where(F.col("m.name").isNotNull())
    header = first_per_key(heads.withColumn("header_idx", F.col("row_idx")), sheet, F.col("row_idx"), ["header_idx", "m"])
    joined = rows.join(header, sheet, "left").where(F.exists("cells", lambda x: x != ""))
    below = joined.where(F.col("header_idx").isNull() | (F.col("row_idx") > F.col("header_idx")))

    def cell(i: Column) -> Column:
        return placeholder_to_null(F.get(F.col("cells"), i))

    no_header = F.col("header_idx").isNull()
    next_cell = cell(F.col("m.certificate_no") + 1)
    shifted = (F.col("m.valid_date") == F.col("m.certificate_no")) & F.coalesce(
        next_cell.rlike(r"\d{4}\D+\d{1,2}\D+\d{1,2}"), F.lit(False))
    valid = F.when(shifted, next_cell).otherwise(cell(F.col("m.valid_date")))
    split = split_certificate(cell(F.col("m.certificate_no")), valid)
    first = F.get(F.filter(F.transform("cells", placeholder_to_null), lambda x: x.isNotNull()), F.lit(0))
    plain = [k for k in vocab.CATALOG_KEYS if k not in ("name", "certificate_no", "valid_date")]
    return below.withColumn("__c", split).select(
        *sheet, "row_idx", F.when(no_header, first).otherwise(cell(F.col("m.name"))).alias("name"),
        *[cell(F.col(f"m.{k}")).alias(k) for k in plain],
        F.col("__c.certificate_no").alias("certificate_no"), F.col("__c.valid_date").alias("valid_date"))


def parse_catalog_json(c: Column | str, limit: int | None = None) -> Column:
    """array<struct> of a JSON list of catalogue rows: nameless rows dropped, the first `limit` kept (None: all)."""
    item = "struct<" + ",".join(f"{k}:string" for k in vocab.CATALOG_KEYS) + ">"
    rows = F.from_json(strip(c), f"array<{item}>")
    cleaned = F.transform(rows, lambda r: F.struct(*[placeholder_to_null(r[k]).alias(k) for k in vocab.CATALOG_KEYS]))
    named = F.filter(cleaned, lambda r: r["name"].isNotNull())
    return named if limit is None else F.slice(named, 1, limit)


# --- import schema ----------------------------------------------------------


def _groups(names: Column) -> Column:
    """Empty names take the nearest one on the left, else on the right, else the default."""

    def fill(x: Column, i: Column, every: Column) -> Column:
        left = F.filter(F.slice(every, F.lit(1), i + 1), lambda v: v != "")
        right = F.filter(every, lambda v: v != "")
        return F.coalesce(
            F.try_element_at(left, F.lit(-1)), F.get(right, F.lit(0)), F.lit(vocab.DEFAULT_GROUP))

    return let(F.transform(names, squeeze), lambda e: F.transform(e, lambda x, i: fill(x, i, e)))


def _unique_keys(labels: Column) -> Column:
    """Slug of each label; repeats are numbered; labels without ASCII become col_NN."""

    def slug(x: Column, i: Column) -> Column:
        out = F.lower(F.btrim(F.regexp_replace(x, "[^a-zA-Z0-9]+", "_"), F.lit("_")))
        number = (i + 1).cast("string")
        fallback = F.concat(F.lit("col_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
        return F.when(x == "", F.lit("")).when(out == "", fallback).otherwise(out)

    def number(keys: Column) -> Column:
        def one(k: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(keys, F.lit(1), i), lambda v: v == k))
            return F.when(before == 0, k).otherwise(F.concat(k, F.lit("_"), (before + 1).cast("string")))

        return F.transform(keys, one)

    return let(F.transform(labels, slug), number)


def read_import_schema(rows: DataFrame) -> DataFrame:
    """(file_id, index, key, label, grp) of two-row schemas in sheet rows: groups above labels."""
    two = rows.where(F.col("row_idx") < 2).groupBy("file_id", "sheet").agg(
        F.max(F.when(F.col("row_idx") == 0, F.col("cells"))).alias("groups"),
        F.max(F.when(F.col("row_idx") == 1, F.col("cells"))).alias("labels"))
    width = F.greatest(F.size("groups"), F.size("labels"))

    def padded(c: str) -> Column:
        return F.concat(F.col(c), F.array_repeat(F.lit(""), width - F.size(c)))

    labels = F.transform(padded("labels"), squeeze)
    table = two.select("file_id", F.arrays_zip(
        F.sequence(F.lit(0), width - 1).alias("index"), _unique_keys(labels).alias("key"), labels.alias("label"),
        _groups(padded("groups")).alias("grp")).alias("c"))
    return table.select("file_id", F.inline("c")).where("label <> ''")


def attach_rules(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule of each schema column: by field key, then by rule key, then by label.

    rules: (kind, name, rule); kind is 'field', 'key' or 'label'.
    """
    rank = {"field": 0, "key": 1, "label": 2}
    order = F
    for kind, n in rank.items():
        order = order.when(F.col("kind") == kind, n)
    named = rules.select(strip("name").alias("name"), order.alias("n"), "kind", "rule")
    by_key = columns.join(named.where("kind <> 'label'"), columns["key"] == named["name"])
    by_label = columns.join(named.where("kind = 'label'"), columns["label"] == named["name"])
    both = by_key.unionByName(by_label)
    best = first_per_key(both, ["file_id", "index"], F.col("n"), ["rule"])
    return columns.join(best, ["file_id", "index"], "left")


def schema_from_config(columns: list[dict], rules: dict[str, dict]) -> list[SchemaColumn]:
    """Declared schema objects from configuration (key, label, index, group; rule per key or label)."""
    out = []
    for n, c in enumerate(columns):
        raw = rules.get(c["key"], rules.get(c.get("label", ""), {}))
        normalize = raw.get("normalize", {})
        rule = FieldRule(
            type=raw.get("type", "text"), std_type=raw.get("std_type", ""), max_len=raw.get("max_len"),
            pattern=raw.get("pattern", ""), empty_strategy=raw.get("empty_strategy", ""),
            required=bool(raw.get("required", False)), allow_empty=raw.get("allow_empty"),
            expected_pattern=raw.get("expected_pattern", ""), forbidden_pattern=raw.get("forbidden_pattern", ""),
            fold_width=bool(normalize.get("fullwidth_to_halfwidth")), o_to_0=bool(normalize.get("o_to_0")),
            l_to_1=bool(normalize.get("l_to_1")),
            choices=[(x["label"], list(x.get("tokens", []))) for x in raw.get("choices", [])])
        out.append(SchemaColumn(c.get("index", n), c["key"], c.get("label", ""), c.get("group", vocab.DEFAULT_GROUP), rule))
    return out


def load_config(path: str) -> dict:
    """A rule file of the driver's configuration."""
    with open(path, encoding="utf-8") as handle:
        return json.load(handle)


# --- tasks and files --------------------------------------------------------

_SEED = "seed_key string, source_image string, rotation int, row_count int, rows array<struct<row_number:int, raw_record:string, fields:map<string,string>>>"
_TASK = (
    "id string, task_name string, status string, archived boolean, created_at string, updated_at string, "
    "template_info struct<info_title:string, file_no:string, inspect_standard:string, record_no:string, submit_org:string>, "
    "workspace_draft struct<queue:array<struct<id:string, fileName:string, recordName:string, rowNumber:int, status:string, "
    "templateName:string, recordCount:int, fields:map<string,string>, recognizedFields:map<string,string>>>, selected_ids:array<string>>")


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document variant): each object of JSON files, of a file's array each element, with all its fields. Broken files give none."""
    whole = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    many = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return whole.select(F.explode(many).alias("document"))


def read_seed_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of seed files: (seed_key, row_count, row_number, raw_record, fields), and the whole seed as `document`.

    A typed view of documents that keep the fields that it doesn't know.
    """
    seeds = read_json_documents(spark, path).select("document", F.try_variant_get("document", "$", f"struct<{_typed(_SEED)}>").alias("s"))
    return seeds.select(F.col("s.seed_key").alias("seed_key"), F.col("s.row_count").alias("row_count"), F.inline("s.rows"), "document")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks, a typed view, and the whole task as `document`."""
    return read_json_documents(spark, path).select("document", F.try_variant_get("document", "$", f"struct<{_typed(_TASK)}>").alias("t")).select("t.*", "document")


def _typed(columns: str) -> str:
    """Column definitions as the fields of a struct type."""
    return T.StructType.fromDDL(columns).simpleString()[len("struct<") : -1]


def read_field_patterns(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A configuration {field: [pattern, ...]} out of a JSON file wherever Spark can read it."""
    rows = spark.read.option("wholetext", True).text(path).where("trim(value) <> ''").collect()
    return {field: list(patterns) for row in rows for field, patterns in json.loads(row["value"]).items()}


def task_queue(tasks: DataFrame) -> DataFrame:
    """Queue items of tasks, one row each."""
    return tasks.select(F.col("id").alias("task_id"), F.posexplode("workspace_draft.queue").alias("position", "q")).select(
        "task_id", "position", "q.*")


def task_list(tasks: DataFrame) -> DataFrame:
    """Summary rows of the tasks that are not archived."""
    return tasks.where(~F.coalesce("archived", F.lit(False))).select(
        "id", "task_name", "status", "updated_at", F.col("template_info.record_no").alias("record_no"),
        F.greatest(F.lit(0), F.size("workspace_draft.queue")).alias("queue_size"))


def file_manifest(files: DataFrame, content: str = "content") -> DataFrame:
    """Size and hashes per output; files: (path, content)."""
    raw = F.col(content)
    return files.select(
        "path", F.octet_length(raw).cast("long").alias("size"), F.md5(raw).alias("md5"), F.sha2(raw, 256).alias("sha256"),
        (F.octet_length(raw) > 0).alias("ok"))


def expire_files(files: DataFrame, ref_time: datetime | Column, days: int = 7) -> DataFrame:
    """files: (path, modificationTime) with a flag for those older than the retention."""
    ref = ref_time if isinstance(ref_time, Column) else F.lit(ref_time)
    limit = ref - F.make_dt_interval(F.lit(days))
    old = F.lit(days > 0) & (F.col("modificationTime") < limit)
    return files.withColumn("expired", old)
