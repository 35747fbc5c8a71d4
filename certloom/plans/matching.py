"""Template matching, requirement matching and learned corrections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions import text as tx
from certloom.operators import extract as ex
from certloom.operators import matching as mt
from certloom.plans import query, spread, table
from certloom.plans.extract import lab_texts
from certloom.session import shared_folder


def _s(c: object) -> object:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("match_by_keywords", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'r-803b' WHEN 1 THEN 'r-825b' WHEN 2 THEN 'r-819b' WHEN 3 THEN 'r-859b' END AS by_keyword,
  CASE p_partkey % 6 WHEN 1 THEN 'r-825b' WHEN 3 THEN 'r-859b' WHEN 4 THEN 'r-803b' END AS by_alias FROM part""")
def match_by_keywords(spark: SparkSession, sf: str) -> DataFrame:
    texts = ["低温 冲击\n缆专检号 气瓶名称 型号/规格", "软击穿试验仪", "局部放电 测量系统", "工频高电压 测量系统", "R_803B", "无"]
    body = F.concat("p_name", F.lit("\n"), F.array(*map(F.lit, texts))[(F.col("p_partkey") % 6).cast("int")])
    source = mt.search_text(F.lit("记录.docx"), body)
    return table(spark, sf, "part").select(
        "p_partkey", mt.match_by_keywords(source).alias("by_keyword"), mt.match_by_alias(source).alias("by_alias"))


def code_templates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.concat(
        F.lit("R_"), F.lpad(_s(F.col("p_partkey") % 900), 3, "0"), F.lit("B "), "p_name", F.lit(".docx")).alias("template_name"))


_CODES = """
t AS (SELECT DISTINCT lpad(CAST(p_partkey % 900 AS VARCHAR), 3, '0') AS n,
  'R_' || lpad(CAST(p_partkey % 900 AS VARCHAR), 3, '0') || 'B ' || p_name || '.docx' AS name FROM part),
u AS (SELECT n, min(name) AS name FROM t GROUP BY n HAVING count(*) = 1)
"""


@query("match_by_code", f"""WITH {_CODES}
SELECT o_orderkey, u.name AS by_code FROM orders LEFT JOIN u
  ON o_orderkey % 3 > 0 AND u.n = lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0')""")
def match_by_code(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("o_orderkey") % 3 > 0, F.concat(
        F.lit("r "), F.lpad(_s(F.col("o_custkey") % 1000), 3, "0"), F.lit(" b"))).otherwise("无")
    orders = table(spark, sf, "orders").select("o_orderkey", code.alias("code"))
    return mt.match_by_code(orders, code_templates(spark, sf), F.col("code"), F.col("o_orderkey")).drop("code")


def named_templates(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select("p_name").distinct()
    suffixes = F.array_compact(F.array(
        F.lit("试验装置.docx"), F.when(F.col("p_name").startswith("s"), "核查记录.docx"),
        F.when(F.col("p_name").startswith("b"), "测试系统.docx")))
    made = names.select("p_name", F.explode(suffixes).alias("suffix"))
    return made.select(F.concat("p_name", "suffix").alias("template_name")).unionByName(
        names.limit(1).select(F.lit("R-802B 空白.docx").alias("template_name")))


@query("match_by_name", """
SELECT p_partkey, CASE WHEN p_name LIKE 'b%' OR p_partkey % 5 = 0 THEN NULL ELSE p_name || '试验装置.docx' END AS by_name FROM part""")
def match_by_name(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    records = table(spark, sf, "part").select(
        "p_partkey", F.when(key % 2 == 0, F.concat(F.lit("12 "), "p_name", F.lit(" CNAS-3"))).otherwise("").alias("device_name"),
        F.when(key % 5 == 0, F.lit("设备名称：x9y9z")).otherwise(F.concat(F.lit("a\n 设备名称：" ), "p_name", F.lit(" | b"))).alias("body"))
    device = F.when(key % 5 == 0, "q9w9e").otherwise(F.col("device_name"))
    hints = mt.name_hints(device, F.col("body"), F.lit("R-803B 其它.docx"))
    return mt.match_by_name(records, named_templates(spark, sf), "p_partkey", hints).select("p_partkey", "by_name")


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.lpad(_s(key), 8, "0").alias("id"), F.lpad(_s(key), 8, "0").alias("updated_at"),
        F.concat(F.lit("T"), _s(key)).alias("template_name"),
        F.when(key % 3 == 0, "").otherwise(F.col("p_name")).alias("device_name"),
        F.when(key % 2 == 0, F.col("p_brand")).otherwise("").alias("device_code"),
        F.array(F.concat("p_name", F.lit(" "), "p_type"), F.lit("x")).alias("source_aliases"))


def identities(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("record_id"), F.when(key % 3 == 0, "").otherwise(F.upper("p_name")).alias("device_name"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit(" "), F.lower("p_brand"))).alias("device_code"),
        F.concat(F.lit("记录 "), "p_name", F.lit("\n"), "p_type", F.lit(" 续页")).alias("raw_text"))


_FEEDBACK = """
f AS (SELECT p_partkey AS fk, 'T' || CAST(p_partkey AS VARCHAR) AS t, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE replace(p_name, ' ', '') END AS n,
  CASE WHEN p_partkey % 2 = 0 THEN upper(replace(p_brand, '#', '')) END AS c, lower(replace(p_name, ' ', '') || p_type) AS a FROM part),
r AS (SELECT p_partkey AS record_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE replace(p_name, ' ', '') END AS n,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE upper(replace(p_brand, '#', '')) END AS c, '记录' || lower(replace(p_name, ' ', '') || p_type) || '续页' AS src FROM part),
s AS (SELECT r.record_id, f.t, f.fk, CASE WHEN r.c = f.c THEN 100 ELSE 0 END + CASE WHEN r.n = f.n THEN 40 ELSE 0 END
    + CASE WHEN r.n IS NULL AND r.c IS NULL THEN 10 ELSE 0 END AS score
  FROM r JOIN f ON (r.c IS NULL OR f.c IS NULL OR r.c = f.c) AND (r.n IS NULL OR f.n IS NULL OR r.n = f.n)
    AND (r.n IS NOT NULL OR r.c IS NOT NULL OR contains(r.src, f.a))),
b AS (SELECT record_id, max_by(t, CAST(score AS BIGINT) * 1000000000 + fk) AS t FROM s WHERE score > 0 GROUP BY record_id)
"""


@query("match_by_feedback", f"WITH {_FEEDBACK} SELECT r.record_id, b.t AS by_feedback FROM r LEFT JOIN b USING (record_id)")
def match_by_feedback(spark: SparkSession, sf: str) -> DataFrame:
    records = identities(spark, sf)
    source = mt.search_text(F.lit(""), F.col("raw_text"))
    return mt.match_by_feedback(
        records, feedback(spark, sf), "record_id", F.col("device_name"), F.col("device_code"), source).select(
            "record_id", "by_feedback")


@query("match_template", """
WITH m AS (SELECT p_partkey AS record_id, p_name, CASE WHEN p_partkey % 7 = 0 THEN 'explicit' WHEN p_partkey % 11 = 0 THEN 'code'
  WHEN p_partkey % 4 = 1 THEN 'feedback:default' WHEN p_name LIKE 'b%' THEN 'fallback:blank' ELSE 'name:strict' END AS matched_by FROM part)
SELECT record_id, CASE matched_by WHEN 'explicit' THEN 'unknown.docx' WHEN 'code' THEN 'R-802B 空白.docx' WHEN 'fallback:blank' THEN 'R-802B 空白.docx'
    ELSE p_name || '试验装置.docx' END AS template_name, matched_by,
  CASE WHEN matched_by = 'explicit' THEN '模板不存在：unknown.docx' END AS error FROM m""")
def match_template(spark: SparkSession, sf: str) -> DataFrame:
    """Every stage hits; each part has a learned entry, and a newer one whose template is gone."""
    key = F.col("p_partkey")
    own_code = F.concat(F.lit("K-"), _s(key))
    records = table(spark, sf, "part").select(
        key.alias("record_id"), F.when(key % 7 == 0, " unknown.docx").otherwise("").alias("explicit"),
        F.when(key % 11 == 0, "R-802B").otherwise("R-999z").alias("source_code"), F.col("p_name").alias("device_name"),
        F.when(key % 4 == 1, F.lower(own_code)).otherwise("").alias("device_code"),
        F.col("p_name").alias("file_name"), F.concat(F.lit("name: "), "p_name").alias("raw_text"))
    number = F.lpad(_s(key), 8, "0")
    gone = F.explode(F.array(F.lit(False), F.lit(True))).alias("gone")
    learned = table(spark, sf, "part").select("*", gone).select(
        F.concat(number, _s("gone")).alias("id"), F.concat(_s(F.col("gone").cast("int")), number).alias("updated_at"),
        F.when(F.col("gone"), "gone.docx").otherwise(F.concat("p_name", F.lit("试验装置.docx"))).alias("template_name"),
        F.lit("").alias("device_name"), own_code.alias("device_code"), F.array(own_code).alias("source_aliases"))
    return mt.match_template(records, named_templates(spark, sf), learned, excel=True).select(
        "record_id", "template_name", "matched_by", "error")


@query("match_requirements", """
SELECT p_partkey, CAST(unnest([0, 1]) AS INT) AS target_no, CAST(unnest([1, 2]) AS INT) AS source_no FROM part""")
def match_requirements(spark: SparkSession, sf: str) -> DataFrame:
    """Two requirements against three source lines per part, two of which say the same in other words."""
    made = spread(table(spark, sf, "part")).select(
        "p_partkey", F.array(F.lit("(1)夹具应能夹紧试样"), F.concat("p_name", F.lit("的最大距离为 mm"))).alias("targets"),
        F.array(F.concat("p_type", F.lit("外观完好")), F.lit("(2)夹具能夹紧试样。"), F.concat("p_name", F.lit("最大距离：500mm"))).alias("sources"))
    return made.select("p_partkey", F.inline(mt.match_requirements(F.col("targets"), F.col("sources")))).drop("score")


@query("lookup_value_maps", """
SELECT p_partkey AS doc_id, CASE WHEN p_size = 1 THEN CAST(p_partkey AS VARCHAR) ELSE '1.1' END AS value, '0.50 1 ' || CAST(p_size AS VARCHAR) AS series FROM part""")
def lookup_value_maps(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    found = lab_texts(spark, sf).select("doc_id", ex.value_maps(t).alias("maps"), ex.series_maps(t).alias("series"))
    return found.select(
        "doc_id", mt.value_for_key(F.col("maps"), F.lit("1")).alias("value"),
        F.array_join(mt.series_for_label(F.col("series"), F.lit("(1) 标准值（N）")), " ").alias("series"))


@query("match_anchor_items", """
SELECT p_partkey AS doc_id, '温度偏差 扩展不确定度U=' || CAST(p_size AS VARCHAR) || '.5 ℃,k=2' AS u_line,
  '夹角 实测值： ' || CAST(p_partkey % 90 AS VARCHAR) || '°。' AS m_line FROM part""")
def match_anchor_items(spark: SparkSession, sf: str) -> DataFrame:
    lines = tx.squeezed_lines("text")
    found = lab_texts(spark, sf).select(
        "doc_id", ex.uncertainty_items(lines).alias("u"), ex.measured_items(lines).alias("m"))
    return found.select(
        "doc_id", mt.fill_uncertainty(F.lit("温度偏差 扩展不确定度U=℃,k=2"), F.col("u")).alias("u_line"),
        mt.fill_measured(F.lit("夹角 实测值： °。"), F.col("m")).alias("m_line"))


@query("rule_checks", """
SELECT p_partkey, p_partkey % 2 = 0 AS met, CASE WHEN p_partkey % 2 = 0 THEN '最大距离为500mm' ELSE '最大距离为' || CAST(p_size AS VARCHAR) || 'mm' END AS filled FROM part""")
def rule_checks(spark: SparkSession, sf: str) -> DataFrame:
    distance = F.when(F.col("p_partkey") % 2 == 0, "500").otherwise(_s("p_size"))
    sources = F.array(F.col("p_name"), F.concat(F.lit("两夹具间 最大起始距离："), distance, F.lit(" mm")))
    wanted = F.lit("最大距离为 ___ mm")
    return table(spark, sf, "part").select(
        "p_partkey", mt.rule_check(wanted, sources).alias("met"),
        F.replace(mt.fill_distance(wanted, sources), F.lit(" "), F.lit("")).alias("filled"))


@query("keyword_candidates", """
WITH l AS (SELECT doc_id, trim(unnest(string_split(replace(text, chr(13), ''), chr(10))), E' \\t\\n') AS x FROM documents),
t AS (SELECT doc_id, unnest(regexp_extract_all(x, '[一-鿿A-Za-z0-9%℃Ωμ~./-]{2,30}')) AS token FROM l
  WHERE x <> '' AND NOT regexp_matches(lower(x), '^page\\s+\\d+\\s+of\\s+\\d+$')),
c AS (SELECT doc_id, token, count(*) AS n, CASE WHEN regexp_matches(token, '(?i)\\d{2,4}k?v|kV') THEN 1 ELSE 0 END AS boost
  FROM t WHERE NOT regexp_full_match(token, '[\\d.%-]+') GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER w AS INT) AS rank, token, n AS count, boost FROM c
WINDOW w AS (PARTITION BY doc_id ORDER BY boost DESC, n DESC, length(token) DESC, token) QUALIFY row_number() OVER w <= 20""")
def keyword_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return mt.keyword_candidates(table(spark, sf, "documents"), "doc_id", "text")


@query("pick_best_table", """
WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS table_no, CASE l_suppkey % 5 WHEN 0 THEN '设备名称' WHEN 1 THEN '型号规格' WHEN 2 THEN '设备编号'
    WHEN 3 THEN '厂商' ELSE '原始记录' END AS t FROM lineitem),
s AS (SELECT doc_id, table_no, max(CASE WHEN t = '设备名称' THEN 2 ELSE 0 END) + max(CASE WHEN t = '型号规格' THEN 2 ELSE 0 END)
  + max(CASE WHEN t = '设备编号' THEN 2 ELSE 0 END) + max(CASE WHEN t = '厂商' THEN 1 ELSE 0 END) + max(CASE WHEN t = '原始记录' THEN 1 ELSE 0 END) AS score FROM c GROUP BY ALL)
SELECT doc_id, table_no, score FROM s WHERE score >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, table_no) = 1""")
def pick_best_table(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*map(F.lit, ["设备名称", "型号规格", "设备编号", "厂商", "原始记录"]))
    cells = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("table_no"), words[(F.col("l_suppkey") % 5).cast("int")].alias("text"))
    return mt.pick_best_table(cells, threshold=3)


@query("merge_aliases", """
SELECT p_partkey, p_name || '|' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '|' || p_brand ELSE '' END AS aliases FROM part""")
def merge_aliases(spark: SparkSession, sf: str) -> DataFrame:
    old = F.array(F.concat(F.lit(" "), "p_name"), F.lit("校 准"), F.lit("x"))
    new = F.array(F.upper("p_name"), F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit("设备")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(mt.merge_aliases(old, new), "|").alias("aliases"))


@query("learn_feedback", """
WITH l AS (SELECT user_id, max_by(event_type, event_id) AS template_name, min(event_id) AS id, max(event_id) AS last FROM events GROUP BY user_id),
a AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL)
SELECT lpad(CAST(l.id AS VARCHAR), 10, '0') AS id, l.template_name, CASE WHEN l.last % 5 <> 0 THEN 'd' || CAST(l.user_id AS VARCHAR) ELSE '' END AS device_name_norm,
  'D' || CAST(l.user_id AS VARCHAR) || '|' || string_agg('D' || CAST(l.user_id AS VARCHAR) || ' ' || a.event_type, '|' ORDER BY a.first) AS aliases
FROM l JOIN a USING (user_id) GROUP BY l.id, l.template_name, l.user_id, l.last""")
def learn_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Events as corrections of one device per user, by code, by name or by alias alone; the older half is learned first."""
    number = F.lpad(_s("event_id"), 10, "0")
    device = F.concat(F.lit("D"), _s("user_id"))
    rows = table(spark, sf, "events").select(
        number.alias("id"), number.alias("updated_at"), F.col("event_type").alias("template_name"),
        F.when(F.col("event_id") % 5 != 0, device).otherwise("").alias("device_name"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("K"), _s("user_id"))).otherwise("").alias("device_code"),
        F.array(device, F.concat(device, F.lit(" "), "event_type"), F.lit("系 统")).alias("source_aliases"))
    half = F.lpad(_s(F.floor(table(spark, sf, "events").agg(F.max("event_id")).scalar() / 2)), 10, "0")
    learned = mt.learn_feedback(rows.limit(0), rows.where(F.col("id") <= half)).select(*rows.columns)
    return mt.learn_feedback(learned, rows.where(F.col("id") > half)).select(
        "id", "template_name", "device_name_norm", F.array_join("source_aliases", "|").alias("aliases"))


@query("pending_feedback", """
WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(p_name || ' ' || p_type || ' ' || p_type, '[一-鿿A-Za-z0-9%℃Ωμ~./-]{2,30}')) AS token FROM part),
c AS (SELECT p_partkey, token, count(*) AS n, CASE WHEN regexp_matches(token, '(?i)\\d{2,4}k?v|kV') THEN 1 ELSE 0 END AS boost FROM t
  WHERE NOT regexp_full_match(token, '[\\d.%-]+') GROUP BY ALL),
k AS (SELECT p_partkey, string_agg(token, '|' ORDER BY boost DESC, n DESC, length(token) DESC, token) AS keywords FROM c GROUP BY p_partkey)
SELECT p_partkey % 3 AS batch_id, p_partkey AS id, 'pending' AS status, 'R-803B ' || p_name || '.docx' AS template_name,
  'r-803b' AS template_code, p_brand AS device_code, p_name AS aliases, keywords FROM part JOIN k USING (p_partkey)""")
def pending_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """The log after three batches of corrections, the second of which came twice."""
    corrections = table(spark, sf, "part").select(
        (F.col("p_partkey") % 3).alias("batch_id"), F.col("p_partkey").alias("id"), F.lit("2024-01-01").alias("created_at"),
        F.concat(F.lit("R-803B "), "p_name", F.lit(".docx ")).alias("template_name"), F.col("p_name").alias("device_name"),
        F.col("p_type").alias("device_model"), F.concat(F.lit(" "), "p_brand").alias("device_code"), F.lit("").alias("manufacturer"),
        F.lit("a.docx").alias("file_name"), F.concat("p_name", F.lit("\n"), "p_type", F.lit("\n"), "p_type").alias("raw_text"))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for batches in ([0, 1], [1], [1, 2]):
        mt.append_pending(path, corrections.where(F.col("batch_id").isin(batches)))
    return spark.read.parquet(path).select(
        "batch_id", "id", "status", "template_name", F.lower("template_code").alias("template_code"), "source.device_code",
        F.array_join("template_aliases", "|").alias("aliases"), F.array_join("source_keywords", "|").alias("keywords"))
