"""Column functions over parts, orders and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions import cells, dates, numbers
from certloom.functions import text as tx
from certloom.plans import query, spread, table


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("normalize_text", """
WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{2,}', chr(10), 'g'), E' \\n\\t\\r') AS t FROM documents)
SELECT doc_id, md5(t) AS digest, CAST(len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS INT) AS lines FROM n""")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select(
        "doc_id", F.md5(tx.normalize_text("text")).alias("digest"), F.size(tx.split_lines("text")).alias("lines"))


@query("text_tokens", """
SELECT p_partkey, p_name || ' ' || p_type AS squeezed, replace(p_name, ' ', '') || lower(replace(p_brand, '#', '#')) AS token,
  CASE WHEN p_partkey % 4 > 0 THEN p_name END AS cell, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS optional, 'a1-' || p_name AS folded FROM part""")
def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    placeholder = F.array(*map(F.lit, ["-", "／", " — ", "--"]))[(key % 16 / 4).cast("int")]
    return table(spark, sf, "part").select(
        "p_partkey", tx.squeeze(F.concat(F.lit(" 　"), "p_name", F.lit("  \t"), "p_type")).alias("squeezed"),
        tx.token(F.concat("p_name", F.lit("：（/) "), "p_brand", F.lit("_-"))).alias("token"),
        tx.placeholder_to_null(F.when(key % 4 == 0, placeholder).otherwise(F.col("p_name"))).alias("cell"),
        tx.optional_blank(F.when(key % 3 == 0, F.when(key % 2 == 0, "Received Date").otherwise(" /;")).otherwise(F.col("p_type"))).alias("optional"),
        tx.fold_width(F.concat(F.lit("ａl－"), "p_name"), l_to_1=False).alias("x"), "p_name").select(
            "p_partkey", "squeezed", "token", "cell", "optional",
            F.concat(F.translate(F.left("x", F.lit(3)), "l", "1"), "p_name").alias("folded"))


@query("similarity_key", """
SELECT p_partkey, replace(p_name, ' ', '') || '夹头最大距离' AS key FROM part""")
def similarity_key(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("(3) "), F.upper("p_name"), F.lit("、旋转夹头：最大起始距离（）应为"))
    return table(spark, sf, "part").select("p_partkey", tx.similarity_key(line).alias("key"))


@query("codes_and_modes", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'r-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || 'b' END AS template_code,
  'GB/T ' || CAST(p_size AS VARCHAR) || '.1-2008,JB/T 7-2011' AS standards, CASE p_partkey % 4 WHEN 0 THEN '校准' WHEN 1 THEN '检测' WHEN 2 THEN '校准' END AS mode FROM part""")
def codes_and_modes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    code = F.when(key % 2 == 0, F.concat(F.lit("R_"), F.lpad(_s(key % 1000), 3, "0"), F.lit("B x.docx"))).otherwise("无")
    standards = F.concat(F.lit("见 GB / T "), _s("p_size"), F.lit(".1-2008，JB/T 7-2011; GB/t"), _s("p_size"), F.lit(".1-2008"))
    texts = F.array(*map(F.lit, ["√ 校准 □检测 检测依据", "检测地点：A", "校准结果", "其它"]))[(key % 4).cast("int")]
    return table(spark, sf, "part").select(
        "p_partkey", tx.template_code(code).alias("template_code"), F.array_join(tx.standard_codes(standards), ",").alias("standards"),
        tx.basis_mode(texts).alias("mode"))


@query("parse_date_cn", """
SELECT o_orderkey, strftime(o_orderdate, '%Y年%m月%d日') AS strict, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y年%m月%d日') END AS loose_only,
  '20' || strftime(o_orderdate, '%y年%m月%d日') AS short_year, strftime(o_orderdate + INTERVAL 3 DAY, '%Y年%m月%d日') AS shifted, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""")
def parse_date_cn(spark: SparkSession, sf: str) -> DataFrame:
    day, even = F.col("o_orderdate"), F.col("o_orderkey") % 2 == 0
    spread = F.concat(F.lit("于 "), F.date_format(day, "yyyy"), F.lit(" 年 "), F.date_format(day, "M"), F.lit(" / "), F.date_format(day, "d"), F.lit(" 完"))
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.parse_date_cn(spread).alias("strict"),
        dates.parse_date_cn(F.when(even, spread).otherwise("2024年13月40日"), strict=False).alias("loose_only"),
        dates.parse_date_cn(F.date_format(day, "yy.M.d"), strict=False, two_digit_year=True).alias("short_year"),
        dates.add_days(spread, 3).alias("shifted"), dates.iso_date(F.date_format(day, "yyyy年M月d日")).alias("iso"))


@query("resolve_dates", """
WITH d AS (SELECT o_orderkey, o_orderkey % 4 AS k, strftime(o_orderdate, '%Y年%m月%d日') AS d, strftime(o_orderdate + INTERVAL 1 DAY, '%Y年%m月%d日') AS a, strftime(o_orderdate - INTERVAL 1 DAY, '%Y年%m月%d日') AS b FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN b END AS receive, CASE k WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN b END AS calibration, CASE k WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN d END AS release FROM d""")
def resolve_dates(spark: SparkSession, sf: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, dates.cn_date(F.col("o_orderdate"))
    out = dates.infer_dates(F.when(k == 0, day), F.when(k == 1, day).otherwise(""), F.when(k == 2, day).otherwise("待定"))
    return table(spark, sf, "orders").select("o_orderkey", out.alias("d")).select("o_orderkey", "d.*")


@query("month_day", """
SELECT o_orderkey, CAST(month(o_orderdate) AS VARCHAR) || '.' || CAST(day(o_orderdate) AS VARCHAR) AS month_day, CASE WHEN o_orderkey % 2 = 0 THEN '2.' || CAST(day(o_orderdate) AS VARCHAR) END AS repaired,
  CASE WHEN month(o_orderdate) > 12 THEN NULL ELSE '13.' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') END AS flipped, true AS was_flipped FROM orders""")
def month_day(spark: SparkSession, sf: str) -> DataFrame:
    day, even = F.col("o_orderdate"), F.col("o_orderkey") % 2 == 0
    turned = dates.year_month(F.concat(F.date_format(day, "MM"), F.lit("。13")))
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.month_day(F.date_format(day, "'x 'M'、'd")).alias("month_day"),
        dates.month_day(F.concat(F.when(even, "z").otherwise("13"), F.date_format(day, "' - 'd"))).alias("repaired"),
        turned["value"].alias("flipped"), turned["flipped"].alias("was_flipped"))


@query("clean_number", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '0.5' AS cleaned, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS first,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.1' END AS several FROM lineitem""")
def clean_number(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.clean_number(F.concat(F.lit("约"), q, F.lit("o，5kg."))).alias("cleaned"),
        numbers.first_number(F.concat(F.lit("v="), q, F.lit("; 7"))).alias("first"),
        numbers.clean_number(F.when(F.col("l_linenumber") % 2 == 0, F.concat(q, F.lit(".l.2"))).otherwise("无")).alias("several"))


@query("parse_number_list", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(3 AS INT) AS n, round(l_quantity + l_discount - 0.5, 4) AS total,
  regexp_replace(regexp_replace(format('{:.2f}', l_discount), '0+$', ''), '[.]$', '') AS shown FROM lineitem""")
def parse_number_list(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(_s("l_quantity"), F.lit("，nan;x 1_0；"), F.format_string("%.2f", "l_discount"), F.lit("\n-.5 inf"))
    parsed = numbers.parse_number_list(source)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size(parsed).alias("n"), F.round(numbers.list_sum(parsed), 4).alias("total"),
        numbers.format_number(F.col("l_discount"), 2).alias("shown"))


@query("series_keys", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x10^-' || CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) || '.5' ELSE p_name END AS key,
  '标值' || replace(p_name, ' ', '') || 'Ω' AS label, 'mΩ' AS unit FROM part""")
def series_keys(spark: SparkSession, sf: str) -> DataFrame:
    size = _s("p_size")
    source = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("× 10^-"), size)).when(
        F.col("p_partkey") % 3 == 1, F.concat(size, F.lit(".500 Ω"))).otherwise(F.upper("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", tx.semantic_key(source).alias("key"), tx.series_label(F.concat(F.lit("(2) 标称值["), "p_name", F.lit("]（ω）："))).alias("label"),
        tx.unit_token(F.lit("m Ohm")).alias("unit"))


@query("clean_model_code", """
SELECT p_partkey, p_type || '-9' AS model, CASE WHEN p_partkey % 2 = 0 THEN 'N' || CAST(p_size AS VARCHAR) || 'X' ELSE CAST(p_partkey AS VARCHAR) END AS code,
  p_type AS pair_model, 'K-' || CAST(p_size AS VARCHAR) || 'Q' AS pair_code, p_name AS stripped FROM part""")
def clean_model_code(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    code = F.when(even, F.concat(F.lit("编号：N "), _s("p_size"), F.lit(" X 输出容量 5kVA"))).otherwise(
        F.concat(F.lit("Serial No.: "), _s("p_partkey"), F.lit(" |")))
    pair = tx.split_model_code(F.concat("p_type", F.lit("：K-"), _s("p_size"), F.lit("Q")))
    return table(spark, sf, "part").select(
        "p_partkey", tx.clean_model(F.concat(F.lit("型号规格: Model: "), "p_type", F.lit("-9 /"))).alias("model"), tx.clean_code(code).alias("code"),
        pair["model"].alias("pair_model"), pair["code"].alias("pair_code"),
        tx.strip_english_label(F.concat(F.lit("Instrument name: Device (x): "), "p_name")).alias("stripped"))


@query("is_low_quality", """
SELECT p_partkey, p_partkey % 2 = 0 AS name_low, p_partkey % 3 = 0 AS code_low, p_partkey % 4 = 0 AS date_low, p_partkey % 5 <> 0 AS meaningful FROM part""")
def is_low_quality(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", tx.is_low_quality("device_name", F.when(key % 2 == 0, "仪器 名称：").otherwise(F.col("p_name"))).alias("name_low"),
        tx.is_low_quality("device_code", F.when(key % 3 == 0, "a，").otherwise(F.col("p_brand"))).alias("code_low"),
        tx.is_low_quality("release_date", F.when(key % 4 == 0, "2024年13月1日").otherwise("2024年12月1日")).alias("date_low"),
        tx.is_meaningful(F.when(key % 5 == 0, "型号/规格").otherwise(F.col("p_name"))).alias("meaningful"))


@query("looks_like_measurement_row", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS row_like FROM part""")
def looks_like_measurement_row(spark: SparkSession, sf: str) -> DataFrame:
    k, none = F.col("p_partkey") % 4, F.lit("-")
    test = tx.looks_like_measurement_row(
        F.when(k == 2, "Measurement range").otherwise(F.col("p_name")), F.when(k.isin(0, 2), F.col("p_type")).otherwise(none),
        F.when(k == 0, F.col("p_brand")).when(k == 1, "KB-102").otherwise(none), none, none, none, none)
    return table(spark, sf, "part").select("p_partkey", test.alias("row_like"))


@query("check_flag", """
SELECT p_partkey, p_partkey % 4 < 2 AS checked, p_partkey % 4 = 3 AS boolean_text, ['Ar', 'Ar', 'O2', 'zz'][CAST(p_partkey % 4 AS INT) + 1] AS medium FROM part""")
def check_flag(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("p_partkey") % 4).cast("int")
    flags = F.array(*map(F.lit, [" √x", "V", "", "False"]))[k]
    return table(spark, sf, "part").select(
        "p_partkey", cells.check_flag(flags).alias("checked"), cells.is_boolean_text(flags).alias("boolean_text"),
        cells.medium_line_name(F.array(*map(F.lit, ["hr", " AIR", "Oz", "zz"]))[k]).alias("medium"))
