"""Recognised cells made of line items and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions import cells as cf
from certloom.functions.cells import FieldRule
from certloom.operators import cells
from certloom.operators.cells import SchemaColumn
from certloom.operators.ordered import carry_last
from certloom.plans import query, spread, table

ORD = "l_partkey * 100000 + l_suppkey * 10 + l_quantity"


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Several readings per cell of column 4 (maker code): table = order, row = line."""
    raw = F.concat(F.lit(" "), F.lower("l_returnflag"), F.lit("-"), (F.col("l_suppkey") % 3).cast("string"))
    return spread(table(spark, sf, "lineitem")).select(
        F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.lit(4).alias("col"),
        F.when(F.col("l_suppkey") % 11 == 0, "").otherwise(raw).alias("raw_text"),
        F.round(F.col("l_discount") * 10, 2).alias("confidence"),
        F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("preprocess_id"),
        F.expr(f"CAST({ORD} AS BIGINT)").alias("ord"))


_READINGS = f"""
readings AS (
  SELECT l_orderkey AS table_id, l_linenumber AS row, CAST({ORD} AS BIGINT) AS ord,
    CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE lower(l_returnflag) || '-' || CAST(l_suppkey % 3 AS VARCHAR) END AS raw_text,
    least(0.99, round(l_discount * 10, 2) * 0.95) AS score,
    CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE upper(l_returnflag) || CAST(l_suppkey % 3 AS VARCHAR) END AS final_text,
    round(l_discount * 10, 2) AS confidence
  FROM lineitem)
"""


@query("cell_vote", f"""WITH {_READINGS},
v AS (SELECT table_id, row, final_text, sum(score) AS total, max(score) AS single, min(ord) AS first
  FROM readings WHERE final_text <> '' GROUP BY ALL)
SELECT table_id, row, final_text, round(greatest(single, least(0.99, total / 2.4)), 6) AS confidence FROM v
QUALIFY row_number() OVER (PARTITION BY table_id, row ORDER BY round(total, 9) DESC, round(single, 9) DESC, first) = 1""")
def cell_vote(spark: SparkSession, sf: str) -> DataFrame:
    voted = cells.cell_vote(readings(spark, sf), keys=["table_id", "row"])
    return voted.select("table_id", "row", "final_text", F.round("confidence", 6).alias("confidence"))


@query("pick_best_candidate", f"""WITH {_READINGS}
SELECT table_id, row, final_text, round(CASE WHEN final_text = '' THEN least(0.99, confidence * 0.6) ELSE score END, 6) AS confidence
FROM readings QUALIFY row_number() OVER (PARTITION BY table_id, row
  ORDER BY CASE WHEN final_text = '' THEN least(0.99, confidence * 0.6) ELSE score END DESC, ord DESC, raw_text DESC) = 1""")
def pick_best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    best = cells.pick_best_candidate(readings(spark, sf), ["table_id", "row"])
    return best.select("table_id", "row", "final_text", F.round("confidence", 6).alias("confidence"))


@query("column_rule", """
WITH r AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INT) AS q, month(l_shipdate) AS m, day(l_shipdate) AS d
  FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q,
  CASE WHEN q > 45 THEN '' ELSE CAST(m AS VARCHAR) || '.' || CAST(d AS VARCHAR) END AS date_text,
  CAST(CASE WHEN q > 45 THEN 0.2 ELSE 1.0 END AS DOUBLE) AS date_score,
  ['CO2', 'Ar', 'O2', 'N2', '', ''][l_suppkey % 6 + 1] AS medium_text,
  CAST(CASE WHEN l_suppkey % 6 > 3 THEN 0.2 ELSE 1.0 END AS DOUBLE) AS medium_score,
  '10' || CAST(l_partkey AS VARCHAR) || '1' AS serial_text,
  CAST(CASE WHEN length(CAST(l_partkey AS VARCHAR)) >= 2 THEN 0.95 ELSE 0.75 END AS DOUBLE) AS serial_score,
  CASE WHEN q < 10 THEN CAST(q AS VARCHAR) || '0' || '.5' WHEN q % 2 = 0 THEN CAST(q AS VARCHAR) || '.5' ELSE CAST(q AS VARCHAR) END AS pressure_text,
  CAST(CASE WHEN q < 10 THEN 0.95
    WHEN q % 2 = 0 THEN CASE WHEN q = 22 THEN 1.0 ELSE 0.95 END WHEN q BETWEEN 8 AND 35 THEN 0.88 ELSE 0.8 END AS DOUBLE) AS pressure_score
FROM r""")
def column_rule(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    month, day = F.month("l_shipdate").cast("string"), F.dayofmonth("l_shipdate").cast("string")
    date_raw = F.translate(F.concat(F.when(q > 45, "13").otherwise(month), F.lit("-"), day), "1", "l")
    medium = F.array(*map(F.lit, ["C02", " aR", "02", "n2", "OZ", "air"]))[(F.col("l_suppkey") % 6).cast("int")]
    serial = F.concat(F.lit("i-O"), F.col("l_partkey").cast("string"), F.lit("l"))
    pressure = F.when(q < 10, F.concat(q.cast("string"), F.lit("o:S"))).when(
        q % 2 == 0, F.concat(q.cast("string"), F.lit(";s"))).otherwise(q.cast("string"))
    ruled = spread(table(spark, sf, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", q.alias("q"), cf.column_rule(date_raw, 0).alias("d"),
        cf.column_rule(medium, 2).alias("m"), cf.column_rule(serial, 4).alias("s"), cf.column_rule(pressure, 5).alias("p"))
    return ruled.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "q",
        F.col("d.text").alias("date_text"), F.col("d.score").alias("date_score"), F.col("m.text").alias("medium_text"),
        F.col("m.score").alias("medium_score"), F.col("s.text").alias("serial_text"), F.col("s.score").alias("serial_score"),
        F.col("p.text").alias("pressure_text"), F.col("p.score").alias("pressure_score"))


@query("suppress_noise", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE
  WHEN l_suppkey % 3 = 0 THEN l_discount * 10 < 0.6
  WHEN l_suppkey % 3 = 1 THEN true
  ELSE l_discount * 10 <= 0.45 END AS blank FROM lineitem""")
def suppress_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Column 4 (critical), 2 (owner code with one letter) and 8 (plain) by supplier."""
    kind = F.col("l_suppkey") % 3
    col_index = F.when(kind == 0, 3).when(kind == 1, 1).otherwise(7)
    blank = cf.suppress_noise(F.col("l_returnflag"), F.col("l_discount") * 10, col_index)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", blank.alias("blank"))


def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Settled cells: table = supplier, row = order, column from the line; one reading each."""
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    return rows.select(
        F.col("l_suppkey").alias("table_id"), (F.col("l_orderkey") + 1).alias("row"),
        (F.col("l_linenumber") * 3).cast("int").alias("col"),
        F.concat(F.lit("col_"), F.lpad((F.col("l_linenumber") * 3).cast("string"), 2, "0")).alias("column_key"),
        F.when(F.col("q") % 3 == 0, "").otherwise(F.col("q").cast("int").cast("string")).alias("final_text"),
        F.round(1 - F.col("d") * 2, 2).alias("confidence"))


_CELLS = """
c AS (
  SELECT l_suppkey AS table_id, l_orderkey + 1 AS row, l_linenumber * 3 AS col, max(l_quantity) AS q,
    round(1 - max(l_discount) * 2, 2) AS confidence FROM lineitem GROUP BY ALL),
cells AS (
  SELECT *, 'col_' || lpad(CAST(col AS VARCHAR), 2, '0') AS column_key,
    CASE WHEN q % 3 = 0 THEN '' ELSE CAST(CAST(q AS INT) AS VARCHAR) END AS final_text,
    col - 1 IN (0, 2, 3, 4, 5, 6, 8, 17, 19, 25, 27, 32, 33) AS crit FROM c),
vol AS (
  SELECT table_id, row, max(CASE WHEN col = 9 THEN try_cast(final_text AS DOUBLE) END) AS a,
    max(CASE WHEN col = 18 THEN try_cast(final_text AS DOUBLE) END) AS b FROM cells GROUP BY ALL),
review AS (
  SELECT table_id, row, col, column_key, 'low_confidence' AS reason, confidence FROM cells
  WHERE confidence < CASE WHEN crit THEN 0.92 ELSE 0.85 END
  UNION ALL SELECT table_id, row, col, column_key, 'empty_critical', confidence FROM cells WHERE crit AND final_text = ''
  UNION ALL SELECT table_id, row, NULL, 'col_20', 'volume_deviation', NULL FROM vol WHERE abs(a - b) > 3)
"""


def _review(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    made = table_cells(spark, sf)
    rows = made.groupBy("table_id", "row").agg(
        F.max(F.when(F.col("col") == 9, F.col("final_text"))).alias("col_09"),
        F.max(F.when(F.col("col") == 18, F.col("final_text"))).alias("col_20"))
    return made, cells.build_review_queue(made, rows)


@query("build_review_queue", f"WITH {_CELLS} SELECT * FROM review")
def build_review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return _review(spark, sf)[1]


@query("table_quality", f"""WITH {_CELLS},
t AS (SELECT table_id, count(DISTINCT CASE WHEN final_text <> '' THEN row END) AS row_count,
    count(*) FILTER (WHERE final_text <> '') / count(*) AS f,
    count(*) FILTER (WHERE crit AND final_text <> '') / greatest(1, count(*) FILTER (WHERE crit)) AS k, count(*) AS n
  FROM cells GROUP BY table_id),
v AS (SELECT table_id, count(*) AS r FROM review GROUP BY table_id)
SELECT t.table_id, row_count, round(f, 4) AS non_empty_ratio, round(k, 4) AS critical_non_empty_ratio,
  round(coalesce(r, 0) / n, 4) AS review_ratio,
  row_count > 0 AND f >= 0.24 AND k >= 0.18 AND coalesce(r, 0) / n <= 0.72 AS ok, false AS salvaged
FROM t LEFT JOIN v USING (table_id)""")
def table_quality(spark: SparkSession, sf: str) -> DataFrame:
    made, review = _review(spark, sf)
    return cells.table_quality(made, review)


@query("row_consistency", """
SELECT p_partkey, unnest(list_filter([
  CASE WHEN abs(p_size - (p_partkey % 50)) > 3 THEN 'col_20:volume_deviation' END,
  CASE WHEN p_partkey % 4 = 0 THEN 'col_19:weight_loss_inconsistent' END,
  CASE WHEN p_partkey % 3 = 0 THEN 'col_33:conclusion_missing' END], lambda x: x IS NOT NULL)) AS issue FROM part""")
def row_consistency(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    values = {
        "col_09": F.col("p_size").cast("string"), "col_20": (key % 50).cast("string"), "col_08": F.lit("50.0"),
        "col_18": F.when(key % 4 == 0, "50.0").otherwise("49.0"), "col_19": F.lit("1.8"),
        "col_29": F.when(key % 3 == 0, "√").otherwise(""), "col_33": F.lit("")}
    found = cf.row_inconsistencies(values.__getitem__)
    return table(spark, sf, "part").select("p_partkey", F.explode(found).alias("i")).select(
        "p_partkey", F.concat_ws(":", "i.column_key", "i.reason").alias("issue"))


SCHEMA = [SchemaColumn(n, f"k{n}", f"列{n}") for n in range(10)]


@query("cells_to_records", """
WITH f AS (
  SELECT l_suppkey AS table_id, l_orderkey + 1 AS row, l_linenumber, l_partkey, l_quantity, CASE l_linenumber % 4
    WHEN 0 THEN l_linenumber % 10 WHEN 1 THEN (l_linenumber + 1) % 10 WHEN 2 THEN (l_linenumber + 2) % 10
    ELSE least(9, CAST(floor((l_partkey % 100) / 10) AS INT)) END AS slot, l_returnflag || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS t
  FROM lineitem),
m AS (SELECT table_id, row, slot, string_agg(t, '' ORDER BY l_partkey % 100, l_linenumber, t) AS v FROM f GROUP BY ALL)
SELECT table_id, row, coalesce(max(v) FILTER (WHERE slot = 2), '') AS k2, coalesce(max(v) FILTER (WHERE slot = 5), '') AS k5,
  string_agg(v, ' ' ORDER BY slot) AS raw_record FROM m GROUP BY table_id, row""")
def cells_to_records(spark: SparkSession, sf: str) -> DataFrame:
    """Cells placed by number, key, label or position, four ways by line number."""
    n, x = F.col("l_linenumber"), F.col("l_partkey") % 100
    text = F.concat("l_returnflag", F.col("l_quantity").cast("int").cast("string"))
    made = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("table_id"), (F.col("l_orderkey") + 1).alias("row"),
        F.when(n % 4 == 0, n % 10 + 1).otherwise(0).alias("col"),
        F.when(n % 4 == 1, F.concat(F.lit("col_"), F.lpad(((n + 1) % 10 + 1).cast("string"), 2, "0"))).otherwise("").alias("column_key"),
        F.when(n % 4 == 2, F.concat(F.lit("列"), ((n + 2) % 10).cast("string"))).otherwise("").alias("column_label"),
        F.concat(F.lit(" "), text).alias("final_text"), n.alias("n"),
        F.array(*[c.cast("int") for c in (x, n * 0, x, n * 0)]).alias("bbox"),
        F.array(*[F.lit(float(10 * i)) for i in range(11)]).alias("x_lines"))
    slotted = cells.slot_cells(made, SCHEMA, "x_lines")
    merged = slotted.groupBy("table_id", "row", "slot").agg(cells.merge_tokens(F.transform(
        F.array_sort(F.collect_list(F.struct("y", "x", "n", F.trim("final_text").alias("t")))), lambda s: s["t"])).alias("v"))
    out = merged.groupBy("table_id", "row").agg(
        *[F.coalesce(F.max(F.when(F.col("slot") == i, F.col("v"))), F.lit("")).alias(f"k{i}") for i in range(10)])
    record = F.concat_ws(" ", *[F.nullif(F.col(f"k{i}"), F.lit("")) for i in range(10)])
    return out.select("table_id", "row", "k2", "k5", record.alias("raw_record"))


RULES = [
    SchemaColumn(0, "size", "公称容积", "水压试验", FieldRule("number", "number", forbidden_pattern=r"^4\d$")),
    SchemaColumn(1, "made", "制造年月", "基础信息", FieldRule("date", "date")),
    SchemaColumn(2, "tick", "试验结论", "水压试验", FieldRule("check", "check")),
    SchemaColumn(3, "day", "检验日期", "基础信息", FieldRule("date", "date", required=True)),
    SchemaColumn(4, "name", "名称", "基础信息", FieldRule("code", "string", fold_width=True, expected_pattern="^[a-z]+ [a-z]+$")),
]


def _part_stages() -> Column:
    key, size = F.col("p_partkey"), F.col("p_size")
    raw = {
        "size": F.when(key % 7 == 0, "abc").otherwise(F.concat(size.cast("string"), F.lit(" L"))),
        "made": F.concat((key % 12 + 1).cast("string"), F.lit("/"), (size % 10 + 13).cast("string")),
        "tick": F.when(key % 3 == 0, "√").when(key % 3 == 1, "x").otherwise(""),
        "day": F.when(key % 5 == 0, "").otherwise(F.concat((key % 13 + 1).cast("string"), F.lit("-"), F.lit("15"))),
        "name": F.when(key % 6 == 0, F.col("p_brand")).otherwise(F.translate("p_name", "abc", "ａｂｃ"))}
    return cells.field_stages(RULES, raw.__getitem__, 2024)


def stages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "part")).select("p_partkey", _part_stages().alias("stages"))


_STAGES = """
s AS (
  SELECT p_partkey, 'size' AS key, '水压试验' AS grp, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS normalized,
    CASE WHEN p_partkey % 7 = 0 OR p_size BETWEEN 40 AND 49 THEN 'failed' ELSE 'parsed' END AS status FROM part
  UNION ALL SELECT p_partkey, 'made', '基础信息', CASE WHEN false THEN '' ELSE CAST(p_size % 10 + 13 AS VARCHAR) || '.' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') END,
    'warning' FROM part
  UNION ALL SELECT p_partkey, 'tick', '水压试验', CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE '' END,
    CASE p_partkey % 3 WHEN 0 THEN 'parsed' WHEN 1 THEN 'failed' ELSE 'waiting' END FROM part
  UNION ALL SELECT p_partkey, 'day', '基础信息', CASE WHEN p_partkey % 5 = 0 OR p_partkey % 13 = 12 THEN '' ELSE CAST(p_partkey % 13 + 1 AS VARCHAR) || '.15' END,
    CASE WHEN p_partkey % 5 = 0 OR p_partkey % 13 = 12 THEN 'failed' ELSE 'parsed' END FROM part
  UNION ALL SELECT p_partkey, 'name', '基础信息', CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE p_name END,
    CASE WHEN p_partkey % 6 = 0 THEN 'warning' ELSE 'parsed' END FROM part)
"""


@query("validate_stage", f"WITH {_STAGES} SELECT p_partkey, key, normalized, status FROM s")
def validate_stage(spark: SparkSession, sf: str) -> DataFrame:
    # inlined as an expression: for a column the optimizer adds a filter that builds the stages twice more
    parts = spread(table(spark, sf, "part"))
    return parts.select("p_partkey", F.inline(_part_stages())).select("p_partkey", "key", "normalized", "status")


@query("group_rollup", f"""WITH {_STAGES}
SELECT p_partkey, grp AS group_name, CAST(count(*) AS INT) AS total, CAST(count(*) FILTER (WHERE status = 'parsed') AS INT) AS parsed,
  CAST(count(*) FILTER (WHERE status = 'warning') AS INT) AS warning, CAST(count(*) FILTER (WHERE status = 'failed') AS INT) AS failed,
  CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 'warning') > 0 THEN 'warning'
    WHEN count(*) FILTER (WHERE status = 'parsed') > 0 THEN 'parsed' ELSE 'waiting' END AS status
FROM s GROUP BY p_partkey, grp""")
def group_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = cells.group_rollup(F.col("stages"), ["基础信息", "水压试验"])
    return stages(spark, sf).select("p_partkey", F.inline(rolled)).withColumnRenamed("group", "group_name")


@query("typed_projection", """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size_num,
  CASE WHEN p_partkey % 3 = 0 THEN true END AS tick_flag,
  CASE WHEN p_partkey % 5 = 0 OR p_partkey % 13 = 12 THEN NULL ELSE '2024-' || lpad(CAST(p_partkey % 13 + 1 AS VARCHAR), 2, '0') || '-15' END AS day_iso,
  CAST(p_size % 10 + 13 AS VARCHAR) || '.' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') AS made_value FROM part""")
def typed_projection(spark: SparkSession, sf: str) -> DataFrame:
    def typed(n: int) -> object:
        return F.col("stages")[n]["typed"]

    return stages(spark, sf).select(
        "p_partkey", typed(0)["num"].alias("size_num"), typed(2)["flag"].alias("tick_flag"),
        typed(3)["iso"].alias("day_iso"), typed(1)["value"].alias("made_value"))


@query("exclusive_choice", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '校阀' WHEN 1 THEN '' WHEN 2 THEN '换阀' WHEN 3 THEN '换阀' WHEN 4 THEN '校阀' ELSE '' END AS choice,
  p_partkey % 6 = 1 AS conflict FROM part""")
def exclusive_choice(spark: SparkSession, sf: str) -> DataFrame:
    texts = ["√校阀 □换阀", "☑校阀 ☑换阀", "□校阀 换阀", "换阀", "收阀", "无"]
    line = F.concat("p_name", F.lit(" "), F.array(*map(F.lit, texts))[(F.col("p_partkey") % 6).cast("int")])
    plain = F.translate(line, "vV", "  ")
    picked = cf.exclusive_choice(plain, [("校阀", ["校阀"]), ("换阀", ["换阀"])])
    return table(spark, sf, "part").select("p_partkey", picked.alias("c")).select(
        "p_partkey", F.col("c.value").alias("choice"), (F.col("c.warning") != "").alias("conflict"))


@query("reading_score", """
WITH n AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{2,}', chr(10), 'g'), E' \\n\\t\\r') AS t
  FROM documents),
k AS (
  SELECT doc_id, t, CAST(len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS INT) AS lines,
  list_sum(list_transform(['型号','编号','输入电压','输出电压','输入电流','输出电流','频率','生产日期','使用条件','局部放电','局放仪','有限公司','type','model'],
    lambda w: CASE WHEN contains(lower(t), w) THEN 24 ELSE 0 END)) AS hints FROM n)
SELECT doc_id, CAST(3 * length(regexp_replace(t, '[^一-鿿]', '', 'g')) + 2 * length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g'))
  + length(regexp_replace(t, '[^/_.:()-]', '', 'g')) + hints + least(lines, 30) * 3
  + CASE WHEN contains(t, ' kV') OR contains(t, 'kVA') OR contains(lower(t), ' hz') THEN 30 ELSE 0 END
  - CASE WHEN regexp_matches(t, '[A-Za-z]{5,}') AND lines <= 2 THEN 20 ELSE 0 END AS INT) AS score FROM k""")
def reading_score(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", cells.reading_score("text").alias("score"))


@query("quality_score", """
WITH m AS (SELECT p_partkey, 1000 + p_partkey % 1500 AS w, 2000 AS h, 40 + p_size * 2 AS s, 30 + p_partkey % 40 AS c,
  p_partkey % 3 = 0 AS ok, p_partkey % 6 = 1 AS empty, (p_partkey % 10) / 10.0 AS r FROM part)
SELECT p_partkey, CAST(greatest(0, 100 - CASE WHEN least(w, h) < 1800 THEN 20 ELSE 0 END - CASE WHEN s < 70 THEN 22 WHEN s < 110 THEN 10 ELSE 0 END
  - CASE WHEN c < 45 THEN 16 ELSE 0 END - CASE WHEN NOT ok AND empty THEN 18 ELSE 0 END - CASE WHEN NOT ok AND r > 0.6 THEN 12 ELSE 0 END) AS INT) AS score,
  concat_ws(',', CASE WHEN least(w, h) < 1800 THEN 'low_resolution' END, CASE WHEN s < 70 THEN 'blur' WHEN s < 110 THEN 'soft_focus' END,
    CASE WHEN c < 45 THEN 'low_contrast' END, CASE WHEN NOT ok AND empty THEN 'table_not_detected' END,
    CASE WHEN NOT ok AND r > 0.6 THEN 'high_uncertainty' END) AS issues FROM m""")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    scored = cells.quality_score(
        1000 + key % 1500, F.lit(2000), 40 + F.col("p_size") * 2, 30 + key % 40, key % 3 == 0, key % 6 == 1, (key % 10) / 10)
    return table(spark, sf, "part").select("p_partkey", scored.alias("q")).select(
        "p_partkey", "q.score", F.array_join("q.issues", ",").alias("issues"))


@query("carry_forward", """
SELECT user_id, event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS owner FROM events""")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("owner"))
    return carry_last(rows, ["user_id"], "event_id", ["owner"])


@query("merged_cell_fill", """
WITH m AS (SELECT user_id AS table_id, event_id AS row, 0 AS col, event_id % 5 AS k, event_type AS t FROM events),
g AS (SELECT *, sum(CASE WHEN k IN (0, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row) AS grp FROM m)
SELECT table_id, row, col, CASE WHEN k IN (1, 2) THEN coalesce(max(CASE WHEN k = 0 THEN t END) OVER (PARTITION BY table_id, grp), '') ELSE t END AS text FROM g""")
def merged_cell_fill(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 5
    made = table(spark, sf, "events").select(
        F.col("user_id").alias("table_id"), F.col("event_id").alias("row"), F.lit(0).alias("col"),
        F.when(k.isin(1, 2), "").otherwise(F.col("event_type")).alias("text"),
        F.when(k == 0, "restart").when(k.isin(1, 2, 3), "continue").alias("vmerge"))
    return cells.merged_cell_fill(made).drop("vmerge")


@query("merge_near", """
WITH p AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS pos FROM events),
d AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 6 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
c AS (SELECT user_id, pos, sum(s) OVER (PARTITION BY user_id ORDER BY pos RANGE UNBOUNDED PRECEDING) AS cluster FROM d)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, CAST(round_even(sum(pos) / count(*), 0) AS BIGINT) AS position, count(*) AS members FROM c GROUP BY ALL""")
def merge_near(spark: SparkSession, sf: str) -> DataFrame:
    positions = table(spark, sf, "events").select("user_id", F.floor("value").alias("pos"))
    return cells.merge_near(positions, ["user_id"], "pos")


@query("stack_tables", """
WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS table_no, 1 + o_orderkey % 4 AS n, 2 + o_orderkey % 5 AS cols FROM orders),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY table_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  max(cols) OVER (PARTITION BY doc_id) AS width FROM t)
SELECT doc_id, table_no, r AS row, CAST(r + off AS BIGINT) AS stacked_row, width FROM o, unnest(range(n)) AS u(r)""")
def stack_tables(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    tables = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), key.alias("table_no"), (1 + key % 4).alias("rows"), (2 + key % 5).alias("cols"))
    made = tables.select("doc_id", "table_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"))
    return cells.stack_tables(tables, made).select("doc_id", "table_no", "row", "stacked_row", "width")


@query("group_header_fill", """
SELECT user_id, event_id, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id),
  first_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '基础信息') AS grp
FROM (SELECT user_id, event_id, CASE WHEN event_id % 11 = 0 THEN event_type END AS g FROM events)""")
def group_header_fill(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "events").select(
        "user_id", "event_id", F.when(F.col("event_id") % 11 == 0, F.col("event_type")).otherwise(" ").alias("grp"))
    return cells.header_fill(columns, ["user_id"], "event_id", "grp")
