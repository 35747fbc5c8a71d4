"""Catalogues, record maps, templates, changes, files and report rows."""

from __future__ import annotations

import uuid
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.operators import enrich, metrics, records
from certloom.operators import extract as ex
from certloom.plans import query, spread, table
from certloom.plans.sheets import _CELLS, sheet_rows
from certloom.session import shared_folder
from certloom.sources import csv_lines, readers, writers


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- sheets and catalogues --------------------------------------------------


@query("read_cells", "WITH " + _CELLS + """
SELECT file_id, row_idx, col - 1 AS col_idx, v AS value FROM sheet_cells WHERE v <> ''""")
def read_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = readers.long_cells(sheet_rows(spark, sf))
    return cells.select("file_id", "row_idx", F.col("col_idx").cast("long").alias("col_idx"), "value")


@query("read_sheet_rows", """
SELECT coalesce(source, '') AS file_id, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) - 1 AS row_idx,
  3 AS width, CAST(doc_id AS VARCHAR) AS first, md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS last
FROM documents""")
def read_sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as one CSV file a source, whose splits begin inside the quoted texts of every 50th document, back to rows."""
    docs = table(spark, sf, "documents")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    record = F.concat(_s("doc_id"), F.lit(","), quoted, F.lit(","), F.coalesce("lang", F.lit("")))
    lines = docs.select(
        F.coalesce("source", F.lit("")).alias("file_id"), "doc_id", F.posexplode(F.split(record, "\n")).alias("line", "value"))
    split = F.floor((F.col("doc_id") + F.when(F.col("line") > 0, 1).otherwise(0)) / 50)
    numbered = lines.select("file_id", split.alias("block_start"), F.struct("doc_id", "line").alias("in_block"), "value")
    rows = csv_lines.records_of_lines(numbered).select("file_id", "row_idx", csv_lines.cells_of(F.col("record")).alias("cells"))
    cell = [F.try_element_at("cells", F.lit(n)) for n in (1, 2, 3)]
    return rows.select(
        "file_id", F.col("row_idx").cast("long").alias("row_idx"), F.size("cells").alias("width"),
        cell[0].alias("first"), F.md5(cell[1].cast("binary")).alias("text_md5"), cell[2].alias("last"))


@F.pandas_udf(T.BinaryType())
def _gb18030(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t.encode("gb18030"))


@query("read_text_lossy", """
SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS path, length(text) AS chars, md5(text) AS text_md5 FROM documents""")
def read_text_lossy(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as bytes, every third one in another encoding."""
    docs = table(spark, sf, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, _gb18030("text")).otherwise(F.encode("text", "UTF-8"))
    files = docs.select(F.concat(F.lit("doc-"), _s("doc_id")).alias("path"), raw.alias("content"))
    return readers.decode_lossy(files).select(
        "path", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("read_catalog_list", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_name END AS name FROM part""")
def read_catalog_list(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    line = F.when(key % 4 == 0, F.concat(_s(key), F.lit(". "), "p_name", F.lit(", x, y"))).when(
        key % 4 == 1, F.concat(_s(key), F.lit("、"), "p_name", F.lit("，规格"))).when(
            key % 4 == 2, F.concat("p_name", F.lit("|a|b"))).otherwise(" — ")
    return table(spark, sf, "part").select("p_partkey", readers.catalog_line(line).alias("name"))


def catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets of instruments, one per type: a title, a header, rows; one type has no header."""
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    headed = F.col("p_type") != "PROMO"
    body = spread(part).select(
        F.col("p_type").alias("file_id"), F.lit("s").alias("sheet"), (key + 2).alias("row_idx"), F.array(
            F.lit(""), F.col("p_name"), F.col("p_brand"), F.concat(F.lit("K-"), _s(key), F.lit(" 2025-3-4")), F.lit("/")).alias("cells"))
    types = part.select("p_type").distinct()
    title = types.select(
        F.col("p_type").alias("file_id"), F.lit("s").alias("sheet"), F.lit(0).cast("long").alias("row_idx"),
        F.array(F.lit("总目录"), *[F.lit("")] * 4).alias("cells"))
    head = types.where(headed).select(
        F.col("p_type").alias("file_id"), F.lit("s").alias("sheet"), F.lit(1).cast("long").alias("row_idx"),
        F.array(*map(F.lit, ["序", "仪器名称", "型号/规格", "证书编号/有效期限", "备注"])).alias("cells"))
    return title.unionByName(head).unionByName(body)


@query("read_catalog_table", """
SELECT p_type AS file_id, p_partkey + 2 AS row_idx, p_name AS name, CASE WHEN p_type <> 'PROMO' THEN p_brand END AS model,
  CASE WHEN p_type <> 'PROMO' THEN 'K-' || CAST(p_partkey AS VARCHAR) || ' 2025-3-4' END AS certificate_no,
  CASE WHEN p_type <> 'PROMO' THEN '2025年03月04日' END AS valid_date FROM part
UNION ALL SELECT 'PROMO', 0, '总目录', NULL, NULL, NULL""")
def read_catalog_table(spark: SparkSession, sf: str) -> DataFrame:
    return readers.catalog_from_rows(catalog_rows(spark, sf)).select(
        "file_id", "row_idx", "name", "model", "certificate_no", "valid_date")


@query("write_tsv", """
SELECT p_type AS file_id, p_partkey + 2 AS row_idx, p_name || chr(9) || p_brand || chr(9) || chr(9) || chr(9) || chr(9)
  || 'K-' || CAST(p_partkey AS VARCHAR) || ' 2025-3-4 2025年03月04日' || chr(9) AS line FROM part WHERE p_type <> 'PROMO'""")
def write_tsv(spark: SparkSession, sf: str) -> DataFrame:
    shown = writers.instrument_table(readers.catalog_from_rows(catalog_rows(spark, sf)))
    return shown.select("file_id", "row_idx", writers.tsv_line().alias("line"))


@query("parse_catalog_json", """
SELECT event_id, event_type AS name, CAST(CAST(json_extract(props, '$.k') AS INT) AS VARCHAR) AS model FROM events WHERE event_id % 4 <> 0""")
def parse_catalog_json(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("event_id") % 4 == 0, "/").otherwise(F.col("event_type"))
    payload = F.concat(
        F.lit('[{"name": "'), name, F.lit('", "model": " '), F.get_json_object("props", "$.k"), F.lit(' ", "code": "-"}]'))
    return table(spark, sf, "events").select("event_id", F.inline(readers.parse_catalog_json(payload))).select(
        "event_id", "name", "model")


@query("read_import_schema", """
SELECT 'f' || CAST(s_suppkey AS VARCHAR) AS file_id, unnest([0, 1, 2, 4, 5]) AS index, unnest(['a_b', 'a_b_2', 'col_03', 's_' || CAST(s_suppkey AS VARCHAR), 'a_b_3']) AS key,
  unnest(['A b', 'a b', '结论', 'S ' || CAST(s_suppkey AS VARCHAR), 'A-B']) AS label, unnest(['水压', '水压', '水压', s_name, s_name]) AS grp FROM supplier""")
def read_import_schema(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier")
    file_id = F.concat(F.lit("f"), _s("s_suppkey"))
    groups = suppliers.select(file_id.alias("file_id"), F.lit("s").alias("sheet"), F.lit(0).alias("row_idx"), F.array(
        F.lit(""), F.lit("水压"), F.lit(""), F.col("s_name")).alias("cells"))
    labels = suppliers.select(file_id.alias("file_id"), F.lit("s").alias("sheet"), F.lit(1).alias("row_idx"), F.array(
        F.lit("A b"), F.lit("a  b"), F.lit("结论"), F.lit(""), F.concat(F.lit("S "), _s("s_suppkey")), F.lit("A-B")).alias("cells"))
    return readers.read_import_schema(groups.unionByName(labels))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    empty = [F.lit("").alias(k) for k in ("measurement_range", "uncertainty", "valid_date", "traceability_institution")]
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.concat(F.lit("Nation "), _s("s_nationkey")).alias("name"), F.col("s_name").alias("model"),
        F.when(F.col("s_suppkey") % 2 == 0, "-").otherwise(_s("s_suppkey")).alias("code"), F.lit("C1").alias("certificate_no"), *empty)


_FIRST = """
first AS (SELECT s_nationkey, min_by(s_name, s_suppkey) AS model, min_by(CASE WHEN s_suppkey % 2 = 1 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END, s_suppkey) AS code
  FROM supplier GROUP BY s_nationkey)
"""


def instruments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.concat(F.lit("NATION"), _s("c_nationkey")).alias("name"),
        F.lit("own").alias("model"), F.col("c_name").alias("code"))


@query("catalog_merge", f"""WITH {_FIRST}
SELECT c_custkey AS row_id, CASE WHEN f.model IS NULL THEN 'NATION' || CAST(c_nationkey AS VARCHAR) ELSE 'Nation ' || CAST(c_nationkey AS VARCHAR) END AS name,
  coalesce(f.model, 'own') AS model, coalesce(nullif(f.code, ''), c_name) AS code FROM customer LEFT JOIN first f ON f.s_nationkey = c_nationkey""")
def catalog_merge(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.catalog_merge(instruments(spark, sf), catalog(spark, sf))


@query("catalog_semi_filter", """
SELECT c_custkey AS row_id, 'NATION' || CAST(c_nationkey AS VARCHAR) AS name FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)""")
def catalog_semi_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = enrich.catalog_semi_filter(instruments(spark, sf), catalog(spark, sf))
    return kept.select("row_id", "name")


@query("union_candidates", """
WITH a AS (SELECT 0 AS part, p_partkey AS ord, CASE WHEN p_partkey % 10 = 0 THEN '设备名称' ELSE p_name END AS name, p_type AS model FROM part
  UNION ALL SELECT 1, s_suppkey, replace(s_name, '#', ' '), NULL FROM supplier UNION ALL SELECT 1, p_partkey, upper(p_name), NULL FROM part)
SELECT min(part) AS part, min_by(ord, part * 1000000000000 + ord) AS ord, min_by(name, part * 1000000000000 + ord) AS name, min_by(coalesce(model, ''), part * 1000000000000 + ord) AS model
FROM a WHERE name <> '设备名称' GROUP BY lower(replace(name, ' ', ''))""")
def union_candidates(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    first = part.select(
        F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 10 == 0, "设备名称").otherwise(F.col("p_name")).alias("name"),
        F.col("p_type").alias("model"))
    second = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.replace("s_name", F.lit("#"), F.lit(" ")).alias("name")).unionByName(
            part.select(F.col("p_partkey").alias("ord"), F.upper("p_name").alias("name")))
    return enrich.union_candidates([first, second]).select("part", "ord", "name", F.coalesce("model", F.lit("")).alias("model"))


@query("merge_choices", """
WITH own AS (SELECT p_brand AS key, p_type AS choice, min(p_partkey) AS pos FROM part GROUP BY ALL),
lib AS (SELECT lower(c_mktsegment) AS choice, min(c_custkey) AS pos FROM customer GROUP BY ALL UNION ALL SELECT 'economy', 0),
b AS (SELECT key, 0 AS src, pos, choice FROM own UNION ALL SELECT k.key, 1, l.pos, l.choice FROM (SELECT DISTINCT key FROM own) k, lib l WHERE k.key LIKE 'Brand#1%')
SELECT key, src, pos, choice FROM b QUALIFY row_number() OVER (PARTITION BY key, lower(choice) ORDER BY src, pos) = 1""")
def merge_choices(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("pos")).select(
        F.col("p_brand").alias("key"), F.when(F.col("p_brand").startswith("Brand#1"), " Medium").otherwise("other").alias("label"),
        "pos", F.col("p_type").alias("choice"))
    segments = table(spark, sf, "customer").groupBy(F.lower("c_mktsegment").alias("choice")).agg(F.min("c_custkey").alias("pos"))
    extra = table(spark, sf, "customer").agg((F.count("*") * 0).alias("pos")).select(F.lit("economy").alias("choice"), "pos")
    library = segments.unionByName(extra).withColumn("label", F.lit("medium"))
    return enrich.merge_choices(own, library)


# --- maps and texts ---------------------------------------------------------


@query("prune_fields", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'type' ELSE 'name,type' END AS kept, CASE WHEN p_partkey % 2 = 0 THEN 'extra' ELSE 'extra,type' END AS recognized,
  CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 5 AS INT) END AS row_number, 'a,b' AS selected FROM part""")
def prune_fields(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    fields = F.create_map(
        F.lit("name"), F.when(key % 3 == 0, " ").otherwise(F.col("p_name")), F.lit("type"), F.col("p_type"), F.lit(" "), F.lit("x"))
    found = F.create_map(
        F.lit("type"), F.when(key % 2 == 0, F.col("p_type")).otherwise(F.lit("other")), F.lit("extra"), F.lit("1"), F.lit("none"), F.lit(""))
    kept = records.prune_fields(fields)

    def keys(m: Column) -> Column:
        return F.array_join(F.array_sort(F.map_keys(m)), ",")

    picked = records.prune_selection(F.array(*map(F.lit, ["a", " b", "a", "z", ""])), F.array(*map(F.lit, ["b", "a", "c"])))
    return table(spark, sf, "part").select(
        "p_partkey", keys(kept).alias("kept"), keys(records.prune_recognized(kept, found)).alias("recognized"),
        records.positive(key % 5).alias("row_number"), F.array_join(F.array_sort(picked), ",").alias("selected"))


@query("overlay_fields", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'seen' ELSE p_name END AS name, '' AS model, p_brand AS code FROM part""")
def overlay_fields(spark: SparkSession, sf: str) -> DataFrame:
    defaults = F.create_map(F.lit("name"), F.lit(""), F.lit("model"), F.lit(""))
    fields = F.create_map(F.lit("name"), F.col("p_name"), F.lit("code"), F.lit("?"))
    found = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("name"), F.lit("seen"), F.lit("code"), F.col("p_brand"))).otherwise(
        F.create_map(F.lit("code"), F.col("p_brand")))
    merged = table(spark, sf, "part").select("p_partkey", records.overlay_fields(defaults, fields, found).alias("m"))
    return merged.select("p_partkey", "m.name", "m.model", "m.code")


@query("supplemental_pairs", """
SELECT p_partkey, 'Colour' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, 'Size', CAST(p_size AS VARCHAR) FROM part""")
def supplemental_pairs(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(
        F.lit("设备名称: x\nColour: "), "p_name", F.lit("\n co lour： "), "p_name", F.lit("\nSize："), _s("p_size"), F.lit("\nno pair\nAddress: y"))
    return table(spark, sf, "part").select("p_partkey", F.inline(records.supplemental_pairs(source)))


@query("fill_placeholders", """
SELECT p_partkey, 'N:' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END || ' C:none ' || p_brand || '[]' AS filled FROM part""")
def fill_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    context = F.create_map(F.lit("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(""), F.lit("brand"), F.col("p_brand"))
    payload = F.create_map(F.lit("type"), F.col("p_type"))
    marked = records.fill_markers(F.lit("N:<name> C:<code> {{ brand }}[{{unknown}}{{ not a key! }}]"), {
        "<name>": records.placeholder_value(context, payload, ["name", "type"]),
        "<code>": records.placeholder_value(context, payload, ["code"], "none")})
    return table(spark, sf, "part").select("p_partkey", records.fill_braces(marked, context).alias("filled"))


@query("render_text_batch", """
SELECT p_partkey AS row_number, CASE WHEN p_type <> 'PROMO' THEN lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(4, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') || '_' || p_name || '__' || p_type END AS output_name,
  CASE WHEN p_type <> 'PROMO' THEN p_type || ' of ' || p_brand END AS output, CASE WHEN p_type = 'PROMO' THEN '第 ' || CAST(p_partkey AS VARCHAR) || ' 行模板不存在' END AS error FROM part""")
def render_text_batch(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    rows = part.select(
        F.col("p_partkey").alias("row_number"), F.col("p_name").alias("row_name"), F.col("p_type").alias("template_name"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("values"))
    templates = part.select("p_type").distinct().where("p_type <> 'PROMO'").select(
        F.col("p_type").alias("template_name"), F.concat("p_type", F.lit(" of {{brand}}")).alias("body"))
    return records.render_text_batch(rows, templates).select("row_number", "output_name", "output", "error")


@query("default_value_policy", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '2024年02月03日' END ELSE p_name END AS value FROM part""")
def default_value_policy(spark: SparkSession, sf: str) -> DataFrame:
    current = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", records.default_value(current, date(2024, 2, 3), F.col("p_partkey") % 2 == 1).alias("value"))


@query("infer_category", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Excel批量' WHEN 1 THEN p_name WHEN 2 THEN '代号:R-803B' ELSE '未分类' END AS category,
  CASE p_partkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'Excel行' ELSE p_type END AS label FROM part""")
def infer_category(spark: SparkSession, sf: str) -> DataFrame:
    n, m = F.col("p_partkey") % 4, F.col("p_partkey") % 3
    category = records.infer_category(
        F.when(n == 0, "a.XLSX").otherwise("a.docx"), F.when(n == 1, F.col("p_name")).otherwise(" "), F.when(n == 2, "r-803b").otherwise(""))
    label = records.profile_label(F.when(m == 0, "own").otherwise(""), F.when(m == 1, "excel_row").otherwise(F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", category.alias("category"), label.alias("label"))


@query("reprocess_targets", """
WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'single' WHEN o_orderkey % 2 = 0 THEN 'excel-record' ELSE 'record' END AS kind,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_custkey % 2 = 0 THEN 'F' || CAST(o_custkey AS VARCHAR) ELSE 'file::S' || CAST(o_custkey AS VARCHAR) END AS group_key
  FROM orders WHERE o_orderstatus <> 'F')
SELECT kind, group_key, min(id) AS id FROM i GROUP BY ALL""")
def reprocess_targets(spark: SparkSession, sf: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    items = table(spark, sf, "orders").select(
        key.alias("id"), F.when(F.col("o_orderstatus") == "F", "generated").otherwise("ready").alias("status"),
        F.when(customer % 2 == 0, F.concat(F.lit("F"), _s(customer))).otherwise("").alias("file_id"),
        F.concat(F.lit("S"), _s(customer)).alias("source_file"), (key % 2 == 0).alias("is_excel"), (key % 3 != 0).alias("is_record"))
    return records.reprocess_targets(items)


@query("document_index", """
WITH d AS (SELECT 0 AS part, 'raw/d' || CAST(doc_id AS VARCHAR) || '.docx' AS path, 'raw' AS source_dir, lang, doc_id FROM documents
  UNION ALL SELECT 1, CASE WHEN doc_id % 2 = 0 THEN 'raw' ELSE 'up' END || '/d' || CAST(doc_id AS VARCHAR) || '.docx', 'up', lang, doc_id FROM documents)
SELECT 'd' || CAST(doc_id AS VARCHAR) || '.docx' AS name, path, min_by(source_dir, part) AS source_dir, '.docx' AS suffix,
  CASE WHEN min(part) = 0 THEN 2 ELSE 1 END AS coverage, doc_id % 3 = 0 AS has_core_markers FROM d GROUP BY doc_id, path""")
def document_index(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    file = F.concat(F.lit("/d"), _s("doc_id"), F.lit(".docx"))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n设备名称 型号 设备编号"))).otherwise(F.col("text"))

    def part(folder: Column, source: str, values: dict[str, Column]) -> DataFrame:
        fields = [values.get(f, F.lit("")).alias(f) for f in (
            "device_name", "manufacturer", "device_model", "device_code", "certificate_no", "basis_standard", "location",
            "temperature", "humidity")]
        return docs.select(F.concat(folder, file).alias("path"), F.lit(source).alias("source_dir"), body.alias("text"), *fields)

    first = part(F.lit("raw"), "raw", {"device_name": F.col("lang"), "location": F.col("source")})
    second = part(F.when(F.col("doc_id") % 2 == 0, "raw").otherwise("up"), "up", {"device_name": F.col("lang")})
    return records.document_index([first, second]).select("name", "path", "source_dir", "suffix", "coverage", "has_core_markers")


@query("library_summary", """
SELECT (SELECT count(*) FROM part) AS template_total, (SELECT count(*) FROM part WHERE p_size > 10) AS template_with_core_markers,
  (SELECT count(*) FROM documents) AS raw_record_total, (SELECT count(*) FROM documents WHERE doc_id % 4 > 0) AS raw_record_with_any_field""")
def library_summary(spark: SparkSession, sf: str) -> DataFrame:


    templates = table(spark, sf, "part").select((F.col("p_size") > 10).alias("has_core_markers"))
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("coverage"))
    return metrics.library_summary(templates, rows)


@query("file_manifest", """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5, sha256(text) AS sha256, strlen(text) > 0 AS ok FROM documents""")
def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(_s("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return readers.file_manifest(files).select(F.col("path").cast("long").alias("doc_id"), "size", "md5", "sha256", "ok")


@query("expire_files", """
SELECT event_id, ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AS expired FROM events""")
def expire_files(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "events").select("event_id", F.col("ts").alias("modificationTime"))
    return readers.expire_files(files, F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("event_id", "expired")


# --- changes and reports ----------------------------------------------------


@query("update_records", """
WITH c AS (SELECT user_id AS id, event_id, CASE event_type WHEN 'click' THEN '草稿' WHEN 'view' THEN '已生成' END AS status,
    CASE WHEN event_id % 2 = 0 THEN event_type END AS remark FROM events),
l AS (SELECT id, max_by(status, event_id) FILTER (WHERE status IS NOT NULL) AS status, max_by(remark, event_id) FILTER (WHERE remark IS NOT NULL) AS remark FROM c GROUP BY id),
b AS (SELECT c_custkey AS id, '待处理' AS status, c_mktsegment AS remark FROM customer)
SELECT coalesce(b.id, l.id) AS id, coalesce(l.status, b.status) AS status, coalesce(l.remark, b.remark) AS remark FROM b FULL JOIN l ON l.id = b.id""")
def update_records(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("待处理").alias("status"), F.col("c_mktsegment").alias("remark"))
    changes = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), "event_id",
        F.when(F.col("event_type") == "click", "草稿").when(F.col("event_type") == "view", "已生成").otherwise("其它").alias("status"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("remark"))
    return records.update_records(base, changes, "id", "event_id", ["status", "remark"])


@query("bulk_set", """
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END AS priority,
  CASE WHEN o_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS place FROM orders""")
def bulk_set(spark: SparkSession, sf: str) -> DataFrame:
    selected = F.col("o_custkey") % 3 == 0
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.create_map(F.lit("place"), F.lit("old"), F.lit("x"), F.lit("y")).alias("fields"))
    done = records.bulk_set_map(
        records.bulk_set(rows, selected, {"status": "done", "priority": None}), selected, "fields", "place", "new")
    return done.select("o_orderkey", "status", "priority", F.col("fields")["place"].alias("place"))


def selected_cylinders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows of a customer's task."""
    key = F.col("o_orderkey")
    fields = F.create_map(
        F.lit("device_code"), F.when(key % 4 > 0, F.concat(F.lit("S"), _s(key))).otherwise(" "),
        F.lit("col_04"), F.when(key % 8 > 0, F.col("o_orderstatus")).otherwise(""),
        F.lit("next_check_date"), F.when(key % 16 > 0, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(""))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", fields.alias("fields"))


_APPENDIX = """
a AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN 'S' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS serial,
  CASE WHEN o_orderkey % 8 > 0 THEN o_orderstatus ELSE '' END AS maker, strftime(o_orderdate, '%Y-%m-%d') AS next_date FROM orders WHERE o_orderkey % 16 > 0)
"""


@query("appendix_rows", f"""WITH {_APPENDIX}
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, serial || chr(9) || maker || chr(9) || next_date AS line FROM a""")
def appendix_rows(spark: SparkSession, sf: str) -> DataFrame:
    return records.appendix_rows(selected_cylinders(spark, sf), "o_custkey", "o_orderkey").select(
        "o_custkey", "o_orderkey", "line_no", "line")


@query("appendix_counts", f"""WITH {_APPENDIX},
n AS (SELECT o_custkey, count(*) AS cylinder_total_count FROM orders GROUP BY ALL), l AS (SELECT o_custkey, count(*) AS lines FROM a GROUP BY ALL)
SELECT n.o_custkey, cylinder_total_count, coalesce(lines, 0) AS lines,
  coalesce(lines, 0) > 0 AND (n.o_custkey % 2 = 0 OR (cylinder_total_count > 1 AND coalesce(lines, 0) <> 2)) AS replace_text FROM n LEFT JOIN l USING (o_custkey)""")
def appendix_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = selected_cylinders(spark, sf)
    appendix = records.appendix_rows(rows, "o_custkey", "o_orderkey")
    existing = rows.select("o_custkey").distinct().select(
        "o_custkey", F.when(F.col("o_custkey") % 2 == 0, " ").otherwise("a\r\nb\n").alias("appendix_text"))
    return records.appendix_counts(rows, appendix, existing, "o_custkey")


@query("appendix_lines", """
SELECT p_partkey, p_name AS serial, p_type AS maker, '2025-01-02' AS next_date FROM part""")
def appendix_lines(spark: SparkSession, sf: str) -> DataFrame:
    separator = F.when(F.col("p_partkey") % 2 == 0, "\t").otherwise(",")
    source = F.concat_ws("", F.lit("\n"), F.col("p_name"), separator, F.col("p_type"), separator, F.lit(" 2025-01-02\n"))
    return table(spark, sf, "part").select("p_partkey", F.inline(ex.appendix_lines(source)))


@query("seed_records", """
SELECT p_brand AS seed_key, CAST(count(*) OVER (PARTITION BY p_brand) AS INT) AS row_count, CAST(p_partkey AS INT) AS row_number, p_name || ': ' || p_type AS raw_record,
  p_type AS model, 'of ' || p_brand AS unknown FROM part""")
def seed_records(spark: SparkSession, sf: str) -> DataFrame:
    """A seed file per brand; a field that no schema names is read as well."""
    row = F.struct(F.col("p_partkey").cast("int").alias("row_number"), F.concat("p_name", F.lit(": "), "p_type").alias("raw_record"),
                   F.create_map(F.lit("model"), F.col("p_type")).alias("fields"))
    seeds = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_list(row).alias("rows"))
    made = F.to_json(F.struct(F.col("p_brand").alias("seed_key"), F.size("rows").alias("row_count"), "rows", F.concat(F.lit("of "), "p_brand").alias("origin")))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    seeds.select(F.md5("p_brand").alias("part"), made.alias("value")).write.partitionBy("part").text(path)
    back = readers.read_seed_records(spark, path)
    return back.select("seed_key", "row_count", "row_number", "raw_record", F.col("fields")["model"].alias("model"),
                       F.try_variant_get("document", "$.origin", "string").alias("unknown"))


def task_files(spark: SparkSession, sf: str) -> str:
    """A task file per customer nation: its orders' status as queue."""
    item = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("fileName"), F.lit(1).alias("rowNumber"), F.lit("ready").alias("status"))
    tasks = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(item)).alias("queue"))
    made = F.to_json(F.struct(
        F.concat(F.lit("t"), "c_nationkey").alias("id"), F.lit("task").alias("task_name"), F.lit("open").alias("status"), (F.col("c_nationkey") % 5 == 0).alias("archived"),
        F.struct(F.concat(F.lit("NO"), "c_nationkey").alias("record_no")).alias("template_info"), F.struct("queue").alias("workspace_draft")))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    tasks.select("c_nationkey", made.alias("value")).write.partitionBy("c_nationkey").text(path)
    return path


@query("task_list", """
SELECT 't' || c_nationkey AS id, 'task' AS task_name, 'NO' || c_nationkey AS record_no, CAST(count(*) AS INT) AS queue_size
FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY c_nationkey""")
def task_list(spark: SparkSession, sf: str) -> DataFrame:
    return readers.task_list(readers.read_tasks(spark, task_files(spark, sf))).select("id", "task_name", "record_no", "queue_size")


@query("task_queue", """
SELECT 't' || c_nationkey AS task_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS INT) AS position,
  CAST(c_custkey AS VARCHAR) AS id, c_name AS "fileName", 'ready' AS status FROM customer""")
def task_queue(spark: SparkSession, sf: str) -> DataFrame:
    queue = readers.task_queue(readers.read_tasks(spark, task_files(spark, sf)))
    return queue.select("task_id", "position", "id", "fileName", "status")
