"""Sheets made of the part table: one file per brand, messy on purpose; written once per query, as sheets are read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.operators import enrich, sheets
from certloom.plans import query, table
from certloom.session import written

_CN = ["序号", "设备名称", "规格型号", "设备编号", "生产厂商", "备注"]
_EN = ["no", "name", "model", "code", "manufacturer", "remark"]


def sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Row 0 title, row 1 header (Chinese or English), then the brand's parts with gaps."""
    part = table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    number = F.substring_index("p_brand", "#", -1).cast("int")

    def gap(every: int, value: object) -> object:
        return F.when(key % every == 0, "").otherwise(value)

    body = part.select(
        F.col("p_brand").alias("file_id"), F.lit("s1").alias("sheet"), (key + 2).alias("row_idx"),
        F.array(
            (key + 1).cast("string"), gap(7, F.col("p_name")), gap(5, F.col("p_type")),
            gap(11, F.concat(F.lit("C-"), (size * 100 + number).cast("string"))),
            gap(4, F.concat(F.lit("Maker#"), (number + F.when(key % 9 == 0, 1).otherwise(0)).cast("string"))),
            F.when(key % 13 == 0, "-").otherwise("")).alias("cells"))
    brands = part.select("p_brand").distinct().withColumn("odd", F.substring_index("p_brand", "#", -1).cast("int") % 2)
    title = brands.select(
        F.col("p_brand").alias("file_id"), F.lit("s1").alias("sheet"), F.lit(0).cast("long").alias("row_idx"),
        F.array(F.concat(F.lit("资产台账清单 "), "p_brand"), *[F.lit("")] * 5).alias("cells"))
    head = brands.select(
        F.col("p_brand").alias("file_id"), F.lit("s1").alias("sheet"), F.lit(1).cast("long").alias("row_idx"),
        F.when(F.col("odd") == 1, F.array(*map(F.lit, _CN))).otherwise(F.array(*map(F.lit, _EN))).alias("cells"))
    return written(title.unionByName(head).unionByName(body))


_TYPED = """
parts AS (
  SELECT *, CAST(split_part(p_brand, '#', 2) AS INT) AS num FROM part),
sheet_body AS (
  SELECT p_brand AS file_id, p_partkey + 2 AS row_idx,
    CAST(p_partkey + 1 AS VARCHAR) AS c0,
    CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS c1,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS c2,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'C-' || CAST(p_size * 100 + num AS VARCHAR) END AS c3,
    CASE WHEN p_partkey % 4 = 0 THEN ''
      ELSE 'Maker#' || CAST(num + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS c4,
    CASE WHEN p_partkey % 13 = 0 THEN '-' ELSE '' END AS c5
  FROM parts),
brands AS (SELECT DISTINCT p_brand, num FROM parts)
"""
_CELLS = _TYPED + """,
sheet_rows AS (
  SELECT file_id, row_idx, [c0, c1, c2, c3, c4, c5] AS cells FROM sheet_body
  UNION ALL SELECT p_brand, 0, ['资产台账清单 ' || p_brand, '', '', '', '', ''] FROM brands
  UNION ALL SELECT p_brand, 1, CASE WHEN num % 2 = 1
    THEN ['序号', '设备名称', '规格型号', '设备编号', '生产厂商', '备注']
    ELSE ['no', 'name', 'model', 'code', 'manufacturer', 'remark'] END FROM brands),
sheet_cells AS (
  SELECT file_id, row_idx, unnest(range(1, 7)) AS col, unnest(cells) AS v FROM sheet_rows)
"""
_ALIASES = (
    "'template_name','模板','模板名称','template','device_name','气瓶名称','设备名称','仪器名称','name','device_model',"
    "'型号规格','规格型号','型号','规格','model','device_code','气瓶编号','设备编号','资产编号','编号','serial','code',"
    "'manufacturer','生产厂商','制造厂商','制造厂/商','厂家','厂商','use_department','使用部门','部门','使用科室','科室',"
    "'certificate_no','证书编号','证书号','缆专检号','certificate','client_name','委托单位','客户名称','客户','receive_date',"
    "'收样日期','收样时间','calibration_date','校准日期','检定日期','检测日期','location','地点','校准地点','检定地点',"
    "'temperature','温度','humidity','湿度','source_code','模板代号','来源代号','模板编号','序号','计量单位','购置日期',"
    "'启用日期','使用日期','设备状态','账面原值','检验室','原检验室'")
_HEADER = _CELLS + f""",
scored AS (
  SELECT file_id, row_idx, count(*) AS filled,
    count(*) FILTER (WHERE n IN ({_ALIASES})) AS exact,
    count(*) FILTER (WHERE regexp_matches(n,
      '编号|名称|型号|日期|模板|设备|气瓶|证书|厂商|厂家|单位|地址|状态|地点|计量|检验')) AS kw,
    count(*) FILTER (WHERE regexp_full_match(n, '[0-9a-z./:_-]+')) AS data
  FROM (SELECT file_id, row_idx, lower(regexp_replace(v, '\\s+', '', 'g')) AS n FROM sheet_cells WHERE v <> '')
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_idx) AS rn FROM scored),
header AS (
  SELECT file_id, row_idx AS header_idx, exact FROM ranked WHERE rn <= 60
  QUALIFY row_number() OVER (PARTITION BY file_id
    ORDER BY exact * 100 + kw * 12 + filled - data * 3 DESC, exact DESC, filled DESC, row_idx) = 1)
"""


@query("detect_header_row", "WITH " + _HEADER + """
SELECT h.file_id, h.header_idx, array_to_string(r.cells, '|') AS header
FROM header h JOIN sheet_rows r ON r.file_id = h.file_id AND r.row_idx = h.header_idx""")
def detect_header_row(spark: SparkSession, sf: str) -> DataFrame:
    found = sheets.detect_header_row(sheet_rows(spark, sf))
    return found.select("file_id", "header_idx", F.array_join("header", "|").alias("header"))


@query("rows_to_records", "WITH " + _HEADER + """,
pairs AS (
  SELECT c.file_id, c.row_idx, c.col, h.v || ': ' || c.v AS line
  FROM sheet_cells c JOIN header x ON x.file_id = c.file_id AND c.row_idx > x.header_idx
  JOIN sheet_cells h ON h.file_id = c.file_id AND h.row_idx = x.header_idx AND h.col = c.col
  WHERE c.v <> '')
SELECT file_id, row_idx, string_agg(line, chr(10) ORDER BY col) AS raw_record, count(*) AS n_values
FROM pairs GROUP BY file_id, row_idx""")
def rows_to_records(spark: SparkSession, sf: str) -> DataFrame:
    records = sheets.rows_to_records(sheet_rows(spark, sf))
    return records.select(
        "file_id", "row_idx", sheets.raw_record(F.col("data")).alias("raw_record"),
        F.size("data").cast("long").alias("n_values"))


_RECORDS = _TYPED + """,
recs AS (
  SELECT file_id, row_idx, nullif(c1, '') AS device_name, nullif(c2, '') AS device_model,
    nullif(c3, '') AS device_code, nullif(c4, '') AS manufacturer FROM sheet_body),
tok AS (
  SELECT *, lower(regexp_replace(device_code, '[\\s:/\\\\_.|*()-]+', '', 'g')) AS ck,
    lower(regexp_replace(device_name, '[\\s:/\\\\_.|*()-]+', '', 'g')) AS nk,
    lower(regexp_replace(device_model, '[\\s:/\\\\_.|*()-]+', '', 'g')) AS mk FROM recs)
"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.resolve_fields(
        sheets.rows_to_records(sheet_rows(spark, sf)),
        ["device_name", "device_model", "device_code", "manufacturer"]).drop("data")


@query("resolve_aliases", "WITH " + _RECORDS + """
SELECT file_id, row_idx, device_name, device_model, device_code, manufacturer FROM recs""")
def resolve_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).drop("sheet")


_FILLED = _RECORDS + """,
own_code AS (
  SELECT file_id, ck, CASE WHEN count(DISTINCT device_name) = 1 THEN min(device_name) END AS n,
    CASE WHEN count(DISTINCT device_model) = 1 THEN min(device_model) END AS m,
    CASE WHEN count(DISTINCT manufacturer) = 1 THEN min(manufacturer) END AS f
  FROM tok WHERE ck IS NOT NULL GROUP BY ALL),
own_pair AS (
  SELECT file_id, nk, mk, CASE WHEN count(DISTINCT manufacturer) = 1 THEN min(manufacturer) END AS f
  FROM tok WHERE nk IS NOT NULL AND mk IS NOT NULL GROUP BY ALL),
library AS (
  SELECT DISTINCT p_name AS device_name, p_type AS device_model, 'Maker@' || p_type AS manufacturer,
    'C-' || CAST(p_size * 100 + num AS VARCHAR) AS device_code FROM parts),
lib_tok AS (
  SELECT *, lower(replace(device_code, '-', '')) AS ck, lower(replace(device_name, ' ', '')) AS nk,
    lower(device_model) AS mk FROM library),
lib_code AS (
  SELECT ck, CASE WHEN count(DISTINCT device_name) = 1 THEN min(device_name) END AS n,
    CASE WHEN count(DISTINCT device_model) = 1 THEN min(device_model) END AS m,
    CASE WHEN count(DISTINCT manufacturer) = 1 THEN min(manufacturer) END AS f FROM lib_tok GROUP BY ALL),
lib_pair AS (
  SELECT nk, mk, CASE WHEN count(DISTINCT manufacturer) = 1 THEN min(manufacturer) END AS f
  FROM lib_tok GROUP BY ALL),
filled AS (
  SELECT t.file_id, t.row_idx, coalesce(t.device_name, oc.n, lc.n) AS device_name,
    coalesce(t.device_model, oc.m, lc.m) AS device_model, t.device_code,
    coalesce(t.manufacturer, oc.f, op.f, lc.f, lp.f) AS manufacturer
  FROM tok t LEFT JOIN own_code oc ON oc.file_id = t.file_id AND oc.ck = t.ck
  LEFT JOIN own_pair op ON op.file_id = t.file_id AND op.nk = t.nk AND op.mk = t.mk
  LEFT JOIN lib_code lc ON lc.ck = t.ck LEFT JOIN lib_pair lp ON lp.nk = t.nk AND lp.mk = t.mk)
"""


def library(spark: SparkSession, sf: str) -> DataFrame:
    """Known devices of a document library, ambiguous in places."""
    part = table(spark, sf, "part")
    number = F.substring_index("p_brand", "#", -1).cast("int")
    return part.select(
        F.col("p_name").alias("device_name"), F.col("p_type").alias("device_model"),
        F.concat(F.lit("Maker@"), "p_type").alias("manufacturer"),
        F.concat(F.lit("C-"), (F.col("p_size") * 100 + number).cast("string")).alias("device_code")).distinct()


@query("unique_lookup_fill", "WITH " + _FILLED + " SELECT * FROM filled")
def unique_lookup_fill(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.unique_lookup_fill(records(spark, sf), library(spark, sf)).drop("sheet")


_CHECKED = _FILLED + """,
checked AS (
  SELECT *, concat_ws('、', CASE WHEN device_name IS NULL THEN '气瓶名称' END,
    CASE WHEN device_model IS NULL AND device_code IS NULL THEN '型号规格或气瓶编号' END,
    CASE WHEN manufacturer IS NULL THEN '生产厂商' END) AS summary FROM filled)
"""


@query("validate_records", "WITH " + _CHECKED + """
SELECT file_id, row_idx, summary = '' AS ok, summary FROM checked""")
def validate_records(spark: SparkSession, sf: str) -> DataFrame:
    filled = enrich.unique_lookup_fill(records(spark, sf), library(spark, sf))
    checked = enrich.validate_records(filled.withColumn("template_name", F.lit("R-803B.docx")))
    return checked.select("file_id", "row_idx", "ok", "summary")


@query("batch_summary", "WITH " + _CHECKED + """
SELECT file_id, count(*) AS total_rows, count(*) FILTER (WHERE summary = '') AS valid_rows,
  count(*) FILTER (WHERE summary <> '') AS skipped_rows FROM checked GROUP BY file_id""")
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Which records of each file are complete after filling what is unambiguous."""
    return enrich.batch_summary(validate_records(spark, sf), "summary", by=["file_id"])


@query("first_errors", "WITH " + _CHECKED + """
SELECT file_id, row_idx, summary AS error FROM checked WHERE summary <> ''
ORDER BY file_id, row_idx LIMIT 200""")
def first_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The batch response lists the first 200 errors; the limit is the feature."""
    checked = validate_records(spark, sf).withColumnRenamed("summary", "error")
    return enrich.first_errors(checked, ["file_id", "row_idx"])


@query("drop_placeholder_rows", """
WITH r AS (
  SELECT p_partkey AS row_idx, CASE WHEN p_partkey % 10 = 3 THEN 'Instrument name' ELSE p_name END AS device_name,
    CASE WHEN p_partkey % 20 = 3 THEN 'Model/Specification' ELSE p_type END AS device_model,
    p_brand AS device_code FROM part)
SELECT * FROM r WHERE NOT (device_name = 'Instrument name' AND device_model = 'Model/Specification')""")
def drop_placeholder_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        key.alias("row_idx"),
        F.when(key % 10 == 3, "Instrument name").otherwise(F.col("p_name")).alias("device_name"),
        F.when(key % 20 == 3, "Model/Specification").otherwise(F.col("p_type")).alias("device_model"),
        F.col("p_brand").alias("device_code"))
    return sheets.drop_placeholder_rows(rows)


@query("record_name", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_') || '_' || p_type
  WHEN p_partkey % 3 = 1 THEN replace(p_brand, '#', '#') ELSE 'row_' || CAST(p_partkey + 1 AS VARCHAR) END AS record_name
FROM part""")
def record_name(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    certificate = F.when(key % 3 == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("?")), F.lit("/"), "p_type"))
    code = F.when(key % 3 == 1, F.concat(F.lit(". "), "p_brand", F.lit(".")))
    name = sheets.record_name(certificate, F.btrim(code), F.lit(""), key)
    return table(spark, sf, "part").select("p_partkey", F.btrim(name).alias("record_name"))


@query("preview_sheet", "WITH " + _CELLS + """,
body AS (
  SELECT file_id, row_idx, cells, count(*) OVER (PARTITION BY file_id) AS total_rows,
    row_number() OVER (PARTITION BY file_id ORDER BY row_idx) AS rn FROM sheet_rows WHERE row_idx > 1)
SELECT b.file_id, '资产台账清单 ' || b.file_id AS title, array_to_string(h.cells[1:4], '|') AS headers,
  b.row_idx + 1 AS row_number, array_to_string(b.cells[1:4], '|') AS cells, b.total_rows, b.total_rows > 20 AS truncated
FROM body b JOIN sheet_rows h ON h.file_id = b.file_id AND h.row_idx = 1 WHERE b.rn <= 20""")
def preview_sheet(spark: SparkSession, sf: str) -> DataFrame:
    shown = sheets.preview_sheet(sheet_rows(spark, sf), max_rows=20, max_cols=4)
    return shown.select(
        "file_id", "title", F.array_join("headers", "|").alias("headers"), "row_number",
        F.array_join("cells", "|").alias("cells"), "total_rows", "truncated")


@query("required_fields", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat_ws(',',
  CASE WHEN p_partkey % 3 = 0 THEN 'temperature' END, CASE WHEN p_partkey % 5 = 0 THEN 'humidity' END) END AS missing,
  CASE WHEN p_partkey % 4 = 1 THEN 'r803b' ELSE 'default' END AS rule,
  CASE WHEN p_size % 5 = 0 THEN CAST(len(string_split(p_name, ' ')) AS INT) ELSE p_size % 5 END AS items FROM part""")
def required_fields(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    template = F.when(key % 4 == 0, "").when(key % 4 == 1, "R-803B 原始记录.docx").otherwise("其它.docx")
    values = {
        "temperature": F.when(key % 3 == 0, "-").otherwise("20"), "humidity": F.when(key % 5 == 0, "/").otherwise("50")}
    required = {"default": ["temperature", "humidity"], "r803b": ["temperature", "humidity"]}
    items = enrich.count_measurement_items(
        (F.col("p_size") % 5).cast("string"), F.replace("p_name", F.lit(" "), F.lit("\n")))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(enrich.missing_required(template, values, required), ",").alias("missing"),
        enrich.template_rule(template).alias("rule"), items.alias("items"))


@query("context_aliases", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS device_name, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'task' END AS location FROM part""")
def context_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical value first, then aliases; a row value before the task's."""
    key = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(key % 2 == 0, F.col("p_name")).otherwise(" ").alias("device_name"), F.lit("").alias("设备名称"),
        F.col("p_type").alias("name"), F.when(key % 3 == 0, F.col("p_brand")).otherwise("").alias("place"))
    location = sheets.aliased_value(
        F.create_map(F.lit("地点"), F.col("place")), F.create_map(F.lit("校准地点"), F.lit("task")), "校准地点", {"location": ["校准地点"], "校准地点": ["地点"]})
    return sheets.resolve_aliases(rows).select("p_partkey", "device_name", location.alias("location"))
