"""Record texts made of parts, and the documents as they are."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions import text as tx
from certloom.operators import extract as ex
from certloom.operators import fields
from certloom.plans import query, spread, table
from certloom.session import shared_folder, written
from certloom.sources import readers


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def record_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One labelled record per part; every fourth maker stands on the line below its label."""
    key, size = F.col("p_partkey"), F.col("p_size")
    maker = F.concat(F.lit("Maker "), _s(key % 7))
    source = F.concat_ws(
        "\n", F.concat(F.lit("缆专检号：C"), _s(key)), F.concat(F.lit("设备名称:  "), "p_name"),
        F.concat(F.lit("型号规格: "), "p_type", F.lit("-"), _s(size)),
        F.concat(F.lit("设备编号："), _s(size), F.lit("-"), _s(key)),
        F.when(key % 4 == 0, F.concat(F.lit("生产厂商:\nManufacturer:\n"), maker)).otherwise(
            F.concat(F.lit("生产厂商: Manufacturer: "), maker)),
        F.concat(F.lit("收样日期: 2024-"), _s(key % 12 + 1), F.lit("-"), _s(size % 28 + 1)),
        F.concat(F.lit("校准地点: Room "), _s(size), F.lit("\n温度：2"), _s(key % 9), F.lit(".5℃ 湿度：4"), _s(key % 9), F.lit("%RH")))
    return spread(table(spark, sf, "part")).select(key.alias("doc_id"), source.alias("text"))


_EXPECT = """
e AS (
  SELECT p_partkey AS doc_id, p_name AS device_name, p_type || '-' || CAST(p_size AS VARCHAR) AS device_model,
    CAST(p_size AS VARCHAR) || '-' || CAST(p_partkey AS VARCHAR) AS device_code, 'Maker ' || CAST(p_partkey % 7 AS VARCHAR) AS manufacturer,
    'C' || CAST(p_partkey AS VARCHAR) AS certificate_no,
    '2024-' || CAST(p_partkey % 12 + 1 AS VARCHAR) || '-' || CAST(p_size % 28 + 1 AS VARCHAR) AS receive_date,
    strftime(make_date(2024, CAST(p_partkey % 12 + 1 AS INT), CAST(p_size % 28 + 1 AS INT)) + INTERVAL 1 DAY, '%Y年%m月%d日') AS release_date,
    'Room ' || CAST(p_size AS VARCHAR) AS location, '2' || CAST(p_partkey % 9 AS VARCHAR) || '.5' AS temperature,
    '4' || CAST(p_partkey % 9 AS VARCHAR) AS humidity FROM part)
"""


@query("extract_fields", f"WITH {_EXPECT} SELECT *, '校准' AS basis_mode, 'single_device_general' AS source_profile FROM e")
def extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    return fields.extract_fields(record_texts(spark, sf)).select(
        "doc_id", "device_name", "device_model", "device_code", "manufacturer", "certificate_no", "receive_date",
        "release_date", "location", "temperature", "humidity", "basis_mode", "source_profile")


@query("label_pairs", f"""WITH {_EXPECT}
SELECT doc_id, unnest(['缆专检号', '设备名称', '型号规格', '设备编号', '生产厂商', '收样日期', '校准地点']) AS label,
  unnest([certificate_no, device_name, device_model, device_code, manufacturer, receive_date, location]) AS value FROM e""")
def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    marked = record_texts(spark, sf).select("doc_id", ex.mark_lines(tx.split_lines("text")).alias("m"))
    pairs = marked.select("doc_id", F.inline(ex.label_pairs(F.col("m"))))
    return pairs.where(F.col("label") != "manufacturer").select("doc_id", "label", "value")


@query("apply_pairs", f"""WITH {_EXPECT}
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN device_name ELSE 'kept ' || device_name END AS device_name,
  CASE WHEN doc_id % 3 = 0 THEN receive_date ELSE '2020年1月2日' END AS receive_date FROM e""")
def apply_pairs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    marked = record_texts(spark, sf).join(names, "doc_id").select(
        "doc_id", "p_name", ex.mark_lines(tx.split_lines("text")).alias("m"))
    pairs = marked.withColumn("pairs", ex.label_pairs(F.col("m")))
    name = F.when(key % 2 == 0, "设备名称").otherwise(F.concat(F.lit("kept "), "p_name"))
    day = F.when(key % 3 == 0, "2020年13月2日").otherwise("2020年1月2日")
    return pairs.select(
        "doc_id", ex.apply_pairs(name, F.col("pairs"), "device_name").alias("device_name"),
        ex.apply_pairs(day, F.col("pairs"), "receive_date").alias("receive_date"))


@query("regex_rules", f"""WITH {_EXPECT}
SELECT doc_id, device_name, CASE WHEN device_model LIKE 'ECONOMY-%' THEN substr(device_model, 6) ELSE device_code END AS device_code,
  certificate_no, receive_date FROM e""")
def regex_rules(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    return record_texts(spark, sf).select("doc_id", tx.normalize_text("text").alias("t")).select(
        "doc_id", *[ex.regex_rule(t, f).alias(f) for f in ("device_name", "device_code", "certificate_no", "receive_date")])


@query("environment_values", """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'Lab ' ELSE 'Room ' END || CAST(p_size AS VARCHAR) AS location,
  CASE WHEN p_partkey % 2 = 0 THEN '18' ELSE '2' || CAST(p_partkey % 9 AS VARCHAR) || '.5' END AS temperature,
  '4' || CAST(p_partkey % 9 AS VARCHAR) AS humidity FROM part""")
def environment_values(spark: SparkSession, sf: str) -> DataFrame:
    """Even documents carry a calibration block that goes before the rest of the text."""
    size = F.regexp_extract("text", r"Room (\d+)", 1)
    block = F.concat(F.lit("\n其它校准信息：\n地点：Lab "), size, F.lit(" 温度：18℃\n备注："))
    texts = record_texts(spark, sf).withColumn(
        "text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", block)).otherwise(F.col("text")))
    return texts.select("doc_id", ex.environment_values(F.col("text")).alias("e")).select("doc_id", "e.*")


@query("labelled_date", """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 < 2 THEN '2024年' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') || '月'
  || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') || '日' END AS day FROM part""")
def labelled_date(spark: SparkSession, sf: str) -> DataFrame:
    month, day = _s(F.col("p_partkey") % 12 + 1), _s(F.col("p_size") % 28 + 1)
    near = F.concat(F.lit("x\n发布日期：24/"), month, F.lit("/"), day)
    far = F.concat(F.lit("发 布 日 期 | "), "p_name", F.lit(" |\n2024 年 | "), month, F.lit(" 月 | "), day, F.lit(" 日"))
    source = F.when(F.col("p_partkey") % 3 == 0, near).when(F.col("p_partkey") % 3 == 1, far).otherwise("发布日期：待定")
    made = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("t"))
    return made.select("doc_id", ex.labelled_date(F.col("t"), tx.split_lines("t"), "发布日期").alias("day"))


@query("device_groups", """
SELECT p_partkey AS doc_id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS groups,
  '1. ' || p_name || ' | ' || p_type || ' | NX-' || CAST(p_partkey AS VARCHAR)
  || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '2. ' || p_name || ' B | - | NX-' || CAST(p_partkey + 1 AS VARCHAR) ELSE '' END AS summary,
  CASE WHEN p_partkey % 3 = 0 THEN 'multi_device_baseinfo_word' WHEN p_partkey % 2 = 0 THEN 'single_device_with_scope'
    ELSE 'single_device_general' END AS source_profile FROM part""")
def device_groups(spark: SparkSession, sf: str) -> DataFrame:
    grouped = devices(spark, sf)
    return grouped.select(
        "doc_id", F.size("groups").alias("groups"), ex.group_summary(F.col("groups")).alias("summary"),
        ex.source_profile(F.col("text"), F.col("groups")).alias("source_profile"))


def devices(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with one or two devices, a repeated standard instrument and an environment line."""
    key = F.col("p_partkey")
    source = F.concat(
        F.lit("气瓶名称: "), "p_name", F.lit("\n型号规格: "), "p_type", F.lit("："), F.lit("NX-"), _s(key), F.lit("\n"),
        F.when(key % 3 == 0, F.concat(
            F.lit("气瓶名称："), "p_name", F.lit(" B\n气瓶编号: NX-"), _s(key + 1), F.lit("\n气瓶名称: 数字温度表\n气瓶编号: NX-"), _s(key), F.lit("\n"))).otherwise(""),
        F.lit("设备名称: 环境\n"), F.when(key % 2 == 0, "测量范围 0~10").otherwise(""))
    made = spread(table(spark, sf, "part")).select(key.alias("doc_id"), source.alias("text"))
    return made.withColumn("groups", ex.device_groups(ex.mark_lines(tx.split_lines("text"))))


@query("explode_devices", """
SELECT p_partkey AS doc_id, n AS row_number, CASE n WHEN 1 THEN p_name ELSE p_name || ' B' END AS device_name,
  CASE n WHEN 1 THEN p_type ELSE '' END AS device_model, 'NX-' || CAST(p_partkey + n - 1 AS VARCHAR) AS device_code
FROM part, (VALUES (1), (2)) v(n) WHERE p_partkey % 3 = 0""")
def explode_devices(spark: SparkSession, sf: str) -> DataFrame:
    return ex.explode_devices(devices(spark, sf), "groups", []).select(
        "doc_id", "row_number", "device_name", "device_model", "device_code")


@query("split_records", """
SELECT p_partkey AS doc_id, n AS block_no, CASE WHEN n = 1 THEN 'Maker 有限公司' || chr(10) || '设备名称: ' || p_name || chr(10) || '一、x'
  ELSE '设备名称: ' || p_type || chr(10) || '型号: ' || CAST(p_size AS VARCHAR) END AS block
FROM part, (VALUES (1), (2)) v(n)""")
def split_records(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(
        F.lit("Maker 有限公司\n设备名称: "), "p_name", F.lit("\n一、x\n设备名称: "), "p_type", F.lit("\n型号: "), _s("p_size"))
    made = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("t"))
    return made.select("doc_id", F.posexplode(ex.split_records(F.col("t"))).alias("n", "block")).select(
        "doc_id", (F.col("n") + 1).alias("block_no"), "block")


@query("split_stacked", """
SELECT p_partkey AS id, n AS part, CASE WHEN p_partkey % 3 = 0 THEN p_name || '/' || CAST(n AS VARCHAR) ELSE p_name || chr(10) || p_type END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN 'M' || CAST(n AS VARCHAR) ELSE 'M' END AS model, p_brand AS code,
  CASE WHEN p_partkey % 3 = 0 THEN 'K' || CAST(n AS VARCHAR) ELSE 'K' END AS certificate_no, '2024年05月06日' AS valid_date
FROM part, (VALUES (0), (1)) v(n) WHERE n = 0 OR p_partkey % 3 = 0""")
def split_stacked(spark: SparkSession, sf: str) -> DataFrame:
    two = F.col("p_partkey") % 3 == 0
    made = spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("id"),
        F.when(two, F.concat("p_name", F.lit("/0\n"), "p_name", F.lit("/1"))).otherwise(
            F.concat("p_name", F.lit("\n"), "p_type")).alias("name"),
        F.when(two, "M0\r\nM1").otherwise("M").alias("model"), F.col("p_brand").alias("code"),
        *[F.lit("").alias(k) for k in ("measurement_range", "uncertainty", "valid_date", "traceability_institution")],
        F.when(two, "K0 2024年5月6日\nK1 2024-5-6").otherwise("K 2024/5/6").alias("certificate_no"))
    return ex.split_stacked(made).select("id", "part", "name", "model", "code", "certificate_no", "valid_date")


def lab_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Check sections with uncertainties, measured values and tab tables."""
    key, size = F.col("p_partkey"), F.col("p_size")
    source = F.concat(
        F.lit("一、一般检查：\n(1)夹具能夹紧试样。\n二、温度 扩展不确定度U="), _s(size), F.lit(".5 ℃, k=2\n实测值：2"), _s(key % 9),
        F.lit(" ℃\n三、夹角测量\n实 测 值 (°)： "), _s(key % 90), F.lit("\n标称值(N)\t0.50\t1\t"), _s(size),
        F.lit("\n校准值(N)\t0.52\t1.1\t"), _s(key), F.lit("\n备注 电荷量 实测 "), _s(key % 5), F.lit(" 1.5\n放电量 Urel=0."), _s(key % 7 + 1), F.lit("% k=2"))
    return spread(table(spark, sf, "part")).select(key.alias("doc_id"), source.alias("text"))


@query("uncertainty_items", """
SELECT p_partkey AS doc_id, '温度' AS anchor, CAST(p_size AS VARCHAR) || '.5' AS value, '℃' AS unit FROM part""")
def uncertainty_items(spark: SparkSession, sf: str) -> DataFrame:
    return lab_texts(spark, sf).select("doc_id", F.inline(ex.uncertainty_items(tx.squeezed_lines("text"))))


@query("measured_items", """
SELECT p_partkey AS doc_id, unnest(['温度', '夹角测量']) AS anchor,
  unnest(['2' || CAST(p_partkey % 9 AS VARCHAR), CAST(p_partkey % 90 AS VARCHAR)]) AS value, unnest(['℃', '°']) AS unit FROM part""")
def measured_items(spark: SparkSession, sf: str) -> DataFrame:
    return lab_texts(spark, sf).select("doc_id", F.inline(ex.measured_items(tx.squeezed_lines("text"))))


@query("value_maps", """
WITH k AS (SELECT p_partkey AS doc_id, unnest([1, 2, 3]) AS c, unnest(['0.5', '1', CAST(p_size AS VARCHAR)]) AS key,
  unnest(['0.52', '1.1', CAST(p_partkey AS VARCHAR)]) AS value FROM part)
SELECT doc_id, CAST(1 AS INT) AS map_no, key, max_by(value, c) AS value FROM k GROUP BY doc_id, key""")
def value_maps(spark: SparkSession, sf: str) -> DataFrame:
    return lab_texts(spark, sf).select("doc_id", F.inline(ex.value_maps(F.col("text"))))


@query("series_maps", """
WITH v AS (SELECT p_partkey AS doc_id, unnest(['标值n', '值n']) AS key,
  unnest(['0.50 1 ' || CAST(p_size AS VARCHAR), '0.52 1.1 ' || CAST(p_partkey AS VARCHAR)]) AS series FROM part)
SELECT * FROM v UNION ALL SELECT doc_id, key || replace(series, ' ', ''), series FROM v""")
def series_maps(spark: SparkSession, sf: str) -> DataFrame:
    found = lab_texts(spark, sf).select("doc_id", F.inline(ex.series_maps(F.col("text"))))
    first = found.groupBy("doc_id", "key").agg(F.min_by("values", "block").alias("v"))
    return first.select("doc_id", "key", F.array_join("v", " ").alias("series"))


@query("series_fields", """
SELECT p_partkey AS doc_id, CAST(p_partkey % 5 AS VARCHAR) || ' 1.5' AS charge, '0.' || CAST(p_partkey % 7 + 1 AS VARCHAR) AS urel FROM part""")
def series_fields(spark: SparkSession, sf: str) -> DataFrame:
    lines = tx.split_lines("text")
    return lab_texts(spark, sf).select(
        "doc_id", ex.series_values(lines, ["电荷量", "放电量"]).alias("charge"),
        ex.urel_percent(F.col("text"), lines, ["放电量"]).alias("urel"))


@query("section_values", """
SELECT p_partkey AS doc_id, unnest(['一', '二', '三']) AS section, unnest([NULL, CAST(p_size AS VARCHAR) || '.5', NULL]) AS u,
  unnest([NULL, '2' || CAST(p_partkey % 9 AS VARCHAR), CAST(p_partkey % 90 AS VARCHAR)]) AS measured FROM part""")
def section_values(spark: SparkSession, sf: str) -> DataFrame:
    return lab_texts(spark, sf).select("doc_id", F.inline(ex.section_values(F.col("text"))))


@query("check_lines", """
SELECT p_partkey AS doc_id, unnest(['夹具能夹紧试样。', p_name || '可以调整']) AS line FROM part""")
def check_lines(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(F.lit("一、一般检查：(1)夹具能夹紧试样。(2)"), "p_name", F.lit("可以调整 (3)短"))
    apart = F.concat(F.lit("一、一般检查：\n(1)夹具能夹紧试样。\n(2) "), "p_name", F.lit("可以调整\n(3)短"))
    made = spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("doc_id"),
        F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace(source, "一、一般检查：", "")).otherwise(apart).alias("t"))
    return made.select("doc_id", F.explode(ex.check_lines(F.col("t"))).alias("line"))


@query("block_richness", """
SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'field' ELSE 'raw' END AS chosen FROM part""")
def block_richness(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    own = F.when(key % 3 == 0, "").when(
        key % 3 == 1, F.concat(F.lit("field\n温度 U=1 ℃,k=2\n实测值：5 ℃\n"), "p_name")).otherwise("扩展不确定度U=  ,k=2")
    raw = F.concat(F.lit("raw\n"), "p_name", F.lit(" 检查 1 2 3"))
    made = spread(table(spark, sf, "part")).select(key.alias("doc_id"), own.alias("own"), raw.alias("raw"))
    return made.select("doc_id", F.regexp_extract(
        ex.choose_block(F.col("own"), F.col("raw")), "^(field|raw)", 1).alias("chosen"))


# --- the documents table ----------------------------------------------------

_LINES = """
raw AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
cut AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM raw),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x
  FROM cut WHERE trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '')
"""


@query("text_block", f"""WITH {_LINES},
s AS (SELECT doc_id, min(n) AS s FROM lines WHERE regexp_matches(x, '(?i)the |que ') GROUP BY doc_id),
b AS (SELECT s.doc_id, s.s, min(n) AS e FROM s LEFT JOIN lines l ON l.doc_id = s.doc_id AND l.n > s.s AND regexp_matches(l.x, '(?i)ing |oi') GROUP BY ALL)
SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.n) AS block FROM lines l JOIN b ON b.doc_id = l.doc_id AND l.n >= b.s AND (b.e IS NULL OR l.n < b.e)
GROUP BY l.doc_id""")
def text_block(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents")).select("doc_id", tx.squeezed_lines("text").alias("lines"))
    block = ex.text_block(F.col("lines"), ["the ", "que "], ["ing ", "oi"])
    return docs.select("doc_id", F.explode(F.array_compact(F.array(block))).alias("block"))


@query("document_profile", f"""WITH {_LINES}
SELECT d.doc_id, CAST(length(d.text) AS INT) AS text_length, false AS has_general_check_keyword, CAST(0 AS INT) AS general_check_length,
  CAST(0 AS INT) AS uncertainty_items_count, CAST(0 AS INT) AS measured_items_count FROM documents d""")
def document_profile(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", ex.document_profile(F.col("text")).alias("p")).select("doc_id", "p.*")


@query("profile_changes", """
WITH d AS (SELECT doc_id, length(text) AS n, doc_id % 10 AS k, length('一般检查' || chr(10) || '温度偏差 扩展不确定度U=1.5 ℃,k=2') AS block FROM documents)
SELECT doc_id, CASE k WHEN 1 THEN 'lost' ELSE 'added' END AS status, NULL AS field, NULL AS before, NULL AS after FROM d WHERE k IN (1, 2)
UNION ALL SELECT doc_id, 'changed', 'text_length', CAST(n AS VARCHAR), CAST(n + 1 + block AS VARCHAR) FROM d WHERE k = 3
UNION ALL SELECT doc_id, 'changed', 'has_general_check_keyword', 'false', 'true' FROM d WHERE k = 3
UNION ALL SELECT doc_id, 'changed', 'general_check_length', '0', CAST(block AS VARCHAR) FROM d WHERE k = 3
UNION ALL SELECT doc_id, 'changed', 'uncertainty_items_count', '0', '1' FROM d WHERE k = 3""")
def profile_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles against stored ones: some documents gone, some new, some with a general check and an uncertainty added."""
    docs, k = table(spark, sf, "documents"), F.col("doc_id") % 10
    added = F.concat("text", F.lit("\n一般检查\n温度偏差 扩展不确定度U=1.5 ℃,k=2"))

    def profiles(df: DataFrame) -> DataFrame:
        return written(spread(df).select("doc_id", ex.document_profile(F.col("text")).alias("p")).select("doc_id", "p.*"))

    baseline = profiles(docs.where(k != 2))
    current = profiles(docs.where(k != 1).withColumn("text", F.when(k == 3, added).otherwise(F.col("text"))))
    return ex.profile_changes(baseline, current, "doc_id")


@query("extract_all_fields", f"""WITH {_EXPECT}
SELECT e.doc_id, device_name, device_model, device_code, manufacturer, 'Client Co ' || doc_id AS unit_name, 'Road ' || doc_id AS address,
  '021-5555' || doc_id AS contact_info, certificate_no, receive_date, '2024-05-07' AS calibration_date, '2024年05月08日' AS release_date, location,
  '(1) JJG 123-2010 规程' AS basis_standard, 'Client Co ' || doc_id AS client_name, temperature, humidity, doc_id || '0W' AS power_rating,
  '2020年01月15日' AS manufacture_date, '校准' AS basis_mode, 'JJG 123-2010 规程' AS basis_standard_items, '耐压试验' || chr(10) || '局放试验' AS measurement_items,
  '2' AS measurement_item_count, '5 10 ' || doc_id AS pd_charge_values_pc, NULL AS pd_rise_time_values_ns, NULL AS pd_pulse_amplitude_values_v,
  '1.5' AS pd_voltage_urel_percent, '0.2' AS pd_scan_time_urel_percent, NULL AS pd_capacitance_urel_percent, NULL AS pd_power_tolerance_urel_percent,
  '1.5' AS pd_voltage_calibration_urel_percent, '1' AS device_group_count, '1. ' || device_name || ' | ' || device_model || ' | ' || device_code AS device_group_summary,
  'template_form_word' AS source_profile, '模板单记录Word' AS source_profile_label, '0' AS has_measurement_scope, '耐压试验|局放试验' AS numbered FROM e""")
def extract_all_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of richer records; the maker's label is one that a configuration file adds. numbered: numbered_items by itself."""
    key = _s("doc_id")
    more = [F.concat(F.lit("委托单位: Client Co "), key), F.concat(F.lit("地址: Road "), key), F.concat(F.lit("联系方式: 021-5555"), key),
            F.concat(F.lit("电源/功率: "), key, F.lit("0W")), F.lit("制造日期: 2020-01-15\n校准日期: 2024-05-07\n一、耐压试验\n2. 局放试验"),
            F.concat(F.lit("电荷量 实测值: 5 10 "), key), F.lit("试验电压 Urel= 1.5%\n扫描时间 Urel=0.2%\n本次校准所依据的技术规范\n(1) JJG 123-2010 规程\n备注")]
    body = F.regexp_replace("text", "生产厂商:\\s*Manufacturer:\\s*", "出品方: ")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([('{"manufacturer": ["(出品方)[:：]?\\\\s*(.+)"]}',)], "value string").write.text(path)
    texts = record_texts(spark, sf).select("doc_id", F.concat_ws("\n", body, *more).alias("text"))
    found = fields.extract_fields(texts, patterns=readers.read_field_patterns(spark, path)).withColumn(
        "basis_standard_items", F.array_join("basis_standard_items", "|"))
    items = ex.numbered_items(tx.split_lines("raw_record"))
    return found.select("doc_id", *fields.RESULT_FIELDS, F.array_join(items, "|").alias("numbered"))


@query("data_lines", """
SELECT p_partkey AS doc_id, unnest([0, 1, 2]) AS pos,
  unnest(['2.11 Ar GZ ' || CAST(p_partkey AS VARCHAR) || ' 22.5', 'z1-3 x', '1 2 3 4 5 6']) AS line FROM part""")
def data_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Table lines between prose: one document per part."""
    source = F.concat(
        F.lit("检验记录\n序号 名称\n2.11 Ar GZ "), _s("p_partkey"), F.lit(" 22.5\nz1-3 x\n1 2 3 4 5 6\n备注 "), "p_name", F.lit("\n3.4 y"))
    made = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("t"))
    return made.select("doc_id", F.posexplode(ex.data_lines(tx.raw_lines("t"))).alias("pos", "line"))


@query("detect_field_keys", """
SELECT p_partkey AS doc_id, 'certificate_no,device_name,manufacturer,device_model,device_code'
  || CASE WHEN p_partkey % 2 = 0 THEN ',temperature' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ',breakdown_voltage_values_kv,breakdown_voltage_avg_kv,breakdown_voltage_stddev_kv' ELSE '' END AS keys
FROM part""")
def detect_field_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    source = F.concat("p_name", F.when(key % 2 == 0, "\n温　度").otherwise(""), F.when(key % 3 == 0, " 耐压").otherwise(""))
    fixed = F.replace(source, F.lit("温　度"), F.lit("温度"))
    return spread(table(spark, sf, "part")).select(
        key.alias("doc_id"), F.array_join(ex.detect_field_keys(F.lit("模板"), fixed), ",").alias("keys"))


@query("table_rows", """
SELECT p_partkey AS doc_id, r AS row_no, CASE WHEN r = 0 THEN 'name' ELSE p_name END AS c0, CASE WHEN r = 0 THEN 'type' ELSE p_type END AS c1
FROM part, (VALUES (0), (1), (2)) v(r) WHERE p_partkey % 4 < 3""")
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    separator = F.when(key % 4 == 0, "\t").when(key % 4 == 1, " | ").when(key % 4 == 2, "   ").otherwise(" ")
    source = F.concat(
        F.lit("name"), separator, F.lit("type\n"), "p_name", separator, "p_type", F.lit("\n"), "p_name", separator, "p_type")
    made = spread(table(spark, sf, "part")).select(key.alias("doc_id"), source.alias("t"))
    return made.select("doc_id", F.posexplode(ex.table_rows(F.col("t"))).alias("row_no", "c")).select(
        "doc_id", "row_no", F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"))


@query("paired_series", """
SELECT p_partkey AS doc_id, '-' || CAST(p_size AS VARCHAR) AS p1, '-' || CAST(p_size + 6 AS VARCHAR) AS p2,
  CASE WHEN p_partkey % 2 = 0 THEN '6' ELSE '5.5' END AS se FROM part""")
def paired_series(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(
        F.lit("频率\tP1(dBm)\tP2(dBm)\tSE(dB)\n10\t-"), _s("p_size"), F.lit("\t-"), _s(F.col("p_size") + 6), F.lit("\t"),
        F.when(F.col("p_partkey") % 2 == 0, "").otherwise("5.5"), F.lit("\nx\t\t\t"))
    made = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("t"))
    return made.select("doc_id", F.inline(ex.paired_series(F.col("t"))))


@query("following_numbers", """
SELECT p_partkey AS doc_id, unnest([0, 1, 2]) AS pos, unnest(['实测值(℃): ' || CAST(p_size AS VARCHAR) || '  ' || CAST(p_partkey AS VARCHAR), p_name, '7']) AS line FROM part""")
def following_numbers(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(F.lit("实测值(℃):\n"), _s("p_size"), F.lit("\n"), _s("p_partkey"), F.lit("\n"), "p_name", F.lit("\n7"))
    made = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("t"))
    return made.select("doc_id", F.posexplode(ex.following_numbers(tx.raw_lines("t"))).alias("pos", "line"))


@query("neighbor_value", """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 < 2 THEN 'M' || CAST(p_size AS VARCHAR) || '-x' END AS model FROM part""")
def neighbor_value(spark: SparkSession, sf: str) -> DataFrame:
    model = F.concat(F.lit("M"), _s("p_size"), F.lit("-x"))
    source = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("型号 "), model)).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lit("型号\n规格\n"), model)).otherwise(F.concat(F.lit("型号\n1\n2\n"), model))
    made = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("t"))
    value = ex.neighbor_value(tx.split_lines("t"), ["型号", "Type"], r"([A-Za-z][A-Za-z0-9\-_/\. ]{2,40})")
    return made.select("doc_id", value.alias("model"))


@query("resolve_payload", """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'Given ' || p_name ELSE p_name END AS device_name,
  p_type AS device_model, 'N' || CAST(p_size AS VARCHAR) AS device_code FROM part""")
def resolve_payload(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    source = F.concat(F.lit("设备名称："), "p_name", F.lit("\nModel/Number："), "p_type", F.lit(":N"), _s("p_size"))
    made = spread(table(spark, sf, "part")).select(
        key.alias("doc_id"), F.when(key % 2 == 0, F.concat(F.lit("Given "), "p_name")).otherwise("Instrument name").alias("device_name"),
        F.lit("Model/Specification").alias("device_model"), source.alias("raw_record"))
    return fields.resolve_payload(made).select("doc_id", "device_name", "device_model", "device_code")


@query("standard_items", """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'GB/T ' || CAST(p_size AS VARCHAR) || '-2008,JB/T 4278.1-2011' ELSE 'GB/T ' || CAST(p_size AS VARCHAR) || '-2008' END AS items
FROM part""")
def standard_items(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(F.lit("GB / T "), _s("p_size"), F.lit("-2008"))
    block = F.concat(F.lit("前言\n校准依据：\n1. GB/T "), _s("p_size"), F.lit("-2008\n2、JB/T 4278.1-2011\n1. JB/T 4278.1-2011\n备注"))
    made = spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 2 == 0, block).otherwise(
            F.concat(F.lit("见 "), code, F.lit(" 与 "), code)).alias("t"))
    return made.select("doc_id", F.array_join(ex.standard_items(tx.split_lines("t")), ",").alias("items"))


@query("key_value_rows", """
SELECT p_partkey AS doc_id, unnest(['name', 'type']) AS key, unnest([p_name, p_type]) AS value FROM part WHERE p_partkey % 3 > 0""")
def key_value_rows(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(F.lit("name: "), "p_name", F.lit("\n\ntype： "), "p_type", F.when(F.col("p_partkey") % 3 == 0, "\nno pair").otherwise(""))
    made = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("t"))
    return made.select("doc_id", F.inline(ex.key_value_rows("t")))


@query("list_items", """
SELECT p_partkey AS doc_id, unnest([p_name, p_type, 'GB/T ' || CAST(p_size AS VARCHAR) || '-2008']) AS item FROM part WHERE p_partkey % 3 > 0""")
def list_items(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(
        F.lit("1. "), "p_name", F.lit("\n(2) "), "p_type", F.lit("\nGB/T "), _s("p_size"), F.lit("-2008"),
        F.when(F.col("p_partkey") % 3 == 0, "\nplain").otherwise(""))
    made = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("t"))
    return made.select("doc_id", F.explode(ex.list_items("t")).alias("item"))


@query("measurement_rows", """
SELECT p_partkey AS doc_id, p_name AS name, p_type AS model, p_brand AS code, '0~' || CAST(p_size AS VARCHAR) AS measurement_range FROM part""")
def measurement_rows(spark: SparkSession, sf: str) -> DataFrame:
    separator = F.when(F.col("p_partkey") % 2 == 0, "\t").otherwise(" | ")
    source = F.concat(
        F.lit("气瓶名称"), separator, F.lit("型号\n"), "p_name", separator, "p_type", separator, "p_brand", separator, F.lit("0~"), _s("p_size"))
    made = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("t"))
    return made.select("doc_id", F.inline(ex.measurement_rows("t"))).select("doc_id", "name", "model", "code", "measurement_range")


@query("background_noise", """
SELECT p_partkey AS doc_id, '0.' || CAST(p_size AS VARCHAR) || ',1.5,2.5' AS noise FROM part""")
def background_noise(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(F.lit("160kV 背景噪声 1.5pC\n0 kV 背景噪声：9 pC 0."), _s("p_size"), F.lit(" pC\n"), "p_name", F.lit("\n220 kV 背景噪声 2.5 pC"))
    made = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("t"))
    return made.select("doc_id", F.array_join(ex.background_noise(tx.squeezed_lines("t")), ",").alias("noise"))


@query("hammer_rows", """
SELECT p_partkey AS doc_id, '2 3 4 5 6 7 8 9 10 ' || CAST(p_size AS VARCHAR) || '|' || CASE WHEN p_partkey % 2 = 0 THEN '7 8' ELSE '' END AS hammer FROM part""")
def hammer_rows(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(F.lit("实际值(g) 1 2 3 4 5 6 7 8 9 10 "), _s("p_size"), F.lit("\n实际值(g) 1 2\n"), "p_name")
    made = spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("doc_id"), source.alias("t"), F.when(F.col("p_partkey") % 2 == 0, "7, 8").alias("stated"))
    rows = ex.hammer_rows(tx.squeezed_lines("t"), [F.lit(""), F.col("stated")])
    return made.select("doc_id", F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), "|").alias("hammer"))


@query("split_and_extract", """
SELECT p_partkey AS doc_id, n AS record_no, CASE n WHEN 1 THEN p_name ELSE p_name || ' B' END AS device_name,
  CASE n WHEN 1 THEN p_type || '-7' ELSE 'KX-' || CAST(p_size AS VARCHAR) END AS device_model, 'A-' || CAST(p_partkey AS VARCHAR) AS certificate_no
FROM part, (VALUES (1), (2)) v(n)""")
def split_and_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with two records; the certificate number stands once, above both."""
    source = F.concat(
        F.lit("缆专检号：A-"), _s("p_partkey"), F.lit("\n设备名称: "), "p_name", F.lit("\n型号规格: "), "p_type", F.lit("-7\n设备名称: "), "p_name",
        F.lit(" B\n型号规格: KX-"), _s("p_size"))
    made = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("text"))
    return fields.split_and_extract(made).select("doc_id", "record_no", "device_name", "device_model", "certificate_no")
