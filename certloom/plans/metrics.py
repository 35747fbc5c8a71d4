"""List metrics over line items, numbering over orders, coverage over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions import numbers
from certloom.operators import metrics
from certloom.plans import query, table


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: quantity and price lists as texts, in line order (an order has a few lines)."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount").alias("x"))
    lists = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lists.select(
        "l_orderkey",
        F.array_join(F.transform("xs", lambda x: x["l_quantity"].cast("string")), " ").alias("ux"),
        F.array_join(F.transform("xs", lambda x: F.format_string("%.2f", x["l_discount"])), "；").alias("u2"))


_LISTS = """
lines AS (
  SELECT l_orderkey, l_quantity AS q, CAST(format('{:.2f}', l_discount) AS DOUBLE) AS d,
    row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_discount) AS rn FROM lineitem)
"""


@query("list_mean", f"""WITH {_LISTS}
SELECT l_orderkey, round(avg(q), 6) AS mean FROM lines GROUP BY l_orderkey""")
def list_mean(spark: SparkSession, sf: str) -> DataFrame:
    parsed = numbers.parse_number_list("ux")
    return measured(spark, sf).select("l_orderkey", F.round(numbers.list_mean(parsed), 6).alias("mean"))


@query("list_stddev", f"""WITH {_LISTS}
SELECT l_orderkey, round(stddev_pop(q), 6) AS stddev FROM lines GROUP BY l_orderkey""")
def list_stddev(spark: SparkSession, sf: str) -> DataFrame:
    parsed = numbers.parse_number_list("ux")
    return measured(spark, sf).select("l_orderkey", F.round(numbers.list_stddev(parsed), 6).alias("stddev"))


@query("list_subtract", f"""WITH {_LISTS}
SELECT l_orderkey, string_agg(regexp_replace(regexp_replace(format('{{:.3f}}', q - d), '0+$', ''), '[.]$', ''), ' '
  ORDER BY rn) AS difference FROM lines GROUP BY l_orderkey""")
def list_subtract(spark: SparkSession, sf: str) -> DataFrame:
    diff = numbers.list_subtract(numbers.parse_number_list("ux"), numbers.parse_number_list("u2"))
    return measured(spark, sf).select("l_orderkey", numbers.format_list(diff, 3).alias("difference"))


@query("linearity_metrics", f"""WITH {_LISTS},
fi AS (SELECT l_orderkey, rn, q / d AS f FROM lines WHERE abs(d) >= 1e-12),
m AS (SELECT l_orderkey, avg(f) AS f_avg FROM fi GROUP BY l_orderkey)
SELECT fi.l_orderkey, count(*) AS n, round(any_value(m.f_avg), 4) AS f_avg,
  round(max(abs((f - f_avg) / f_avg * 100)), 4) AS worst_delta, round(sum(f), 3) AS fi_sum
FROM fi JOIN m USING (l_orderkey) GROUP BY fi.l_orderkey""")
def linearity_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = numbers.linearity(numbers.parse_number_list("ux"), numbers.parse_number_list("u2"))
    # inlined: a filter on the result would work it out once more
    out = measured(spark, sf).select("l_orderkey", F.inline(F.filter(F.array(found), lambda m: F.size(m["fi"]) > 0)))
    return out.select(
        "l_orderkey", F.size("fi").cast("long").alias("n"), F.round("f_avg", 4).alias("f_avg"),
        F.round(F.array_max(F.transform("delta", F.abs)), 4).alias("worst_delta"),
        F.round(numbers.list_sum(F.col("fi")), 3).alias("fi_sum"))


@query("formula_profiles", f"""WITH {_LISTS},
agg AS (SELECT l_orderkey, avg(q) AS m, stddev_pop(q) AS s, count(*) AS n FROM lines GROUP BY l_orderkey),
fmt AS (SELECT l_orderkey, regexp_replace(regexp_replace(format('{{:.4f}}', m), '0+$', ''), '[.]$', '') AS m,
  regexp_replace(regexp_replace(format('{{:.4f}}', s), '0+$', ''), '[.]$', '') AS s FROM agg),
d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y年%m月%d日') AS day,
  strftime(o_orderdate + INTERVAL 1 DAY, '%Y年%m月%d日') AS next FROM orders)
SELECT f.l_orderkey, CASE WHEN f.l_orderkey % 3 = 0 THEN f.m END AS breakdown_voltage_avg_kv,
  CASE WHEN f.l_orderkey % 3 = 0 THEN f.s END AS breakdown_voltage_stddev_kv,
  CASE WHEN f.l_orderkey % 3 = 1 THEN CASE WHEN f.l_orderkey % 2 = 0 THEN 'kept' ELSE f.m END
    WHEN f.l_orderkey % 2 = 0 THEN 'kept' END AS pd_charge_avg_pc,
  d.day AS receive_date, d.day AS calibration_date, d.next AS publish_date
FROM fmt f JOIN d ON d.o_orderkey = f.l_orderkey""")
def formula_profiles(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("l_orderkey")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy/M/d").alias("calibration_date"))
    template = F.when(key % 3 == 0, "58 15kV击穿电压试验仪").when(key % 3 == 1, "036 局放.docx").otherwise("其它")
    rows = measured(spark, sf).join(orders, "l_orderkey").select(
        "l_orderkey", template.alias("template"), "calibration_date", F.lit("").alias("receive_date"),
        F.col("ux").alias("breakdown_voltage_values_kv"), F.col("ux").alias("pd_charge_values_pc"),
        F.when(key % 2 == 0, "kept").alias("pd_charge_avg_pc"))
    done = metrics.apply_formulas(rows, "template")
    return done.select(
        "l_orderkey", "breakdown_voltage_avg_kv", "breakdown_voltage_stddev_kv", "pd_charge_avg_pc",
        "receive_date", "calibration_date", "publish_date")


@query("daily_number", """
WITH k AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 17 = 0 THEN 'X-' || CAST(o_orderkey AS VARCHAR) END AS g
  FROM orders),
n AS (SELECT *, sum(CASE WHEN g IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS seq FROM k)
SELECT o_orderkey, coalesce(g, strftime(o_orderdate, '%Y%m%d')
  || CASE WHEN seq < 10 THEN '0' ELSE '' END || CAST(seq AS VARCHAR)) AS report_no FROM n""")
def daily_number(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    explicit = F.when(F.col("o_orderkey") % 17 == 0, F.concat(F.lit("X-"), F.col("o_orderkey").cast("string")))
    return metrics.daily_numbers(orders, "day", "o_orderkey", explicit).select("o_orderkey", "report_no")


@query("next_record_no", """
SELECT day, day || '-' || lpad(CAST(max(n) + 1 AS VARCHAR), 3, '0') AS record_no
FROM (SELECT strftime(o_orderdate, '%Y%m%d') AS day, o_custkey % 500 AS n FROM orders WHERE o_orderkey % 7 <> 0)
GROUP BY day""")
def next_record_no(spark: SparkSession, sf: str) -> DataFrame:
    number = F.concat(
        F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lpad((F.col("o_custkey") % 500).cast("string"), 3, "0"))
    rows = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 7 == 0, "draft").otherwise(number).alias("record_no"))
    return metrics.next_record_no(rows)


@query("serial_number", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'R' || CAST(o_orderkey AS VARCHAR)
  WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0')
  ELSE strftime(o_orderdate, '%Y%m%d') || '01' END AS serial FROM orders""")
def serial_number(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    given = F.when(key % 5 == 0, F.concat(F.lit("R"), key.cast("string")))
    record = F.when(key % 5 == 1, F.concat(
        F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), (key % 90).cast("string")))
    serial = metrics.serial_number(given, record, F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", serial.alias("serial"))


@query("kpi_coverage", """
WITH s AS (
  SELECT p_brand, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS v, 'number' AS want, p_partkey
  FROM part UNION ALL
  SELECT p_brand, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_name END, 'number', p_partkey FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_brand, p_type, 'string', p_partkey FROM part)
SELECT p_brand, count(*) AS fields, count(*) FILTER (WHERE v <> '') AS filled,
  round(avg(CASE WHEN v <> '' THEN 1.0 ELSE 0.0 END), 4) AS coverage,
  round(count(*) FILTER (WHERE v <> '' AND (want = 'string' OR try_cast(v AS DOUBLE) IS NOT NULL))
    / count(*) FILTER (WHERE v <> ''), 4) AS type_agreement
FROM s GROUP BY p_brand""")
def kpi_coverage(spark: SparkSession, sf: str) -> DataFrame:
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    fields = F.array_compact(F.array(
        F.struct(F.when(key % 4 == 0, "").otherwise(F.col("p_size").cast("string")).alias("v"), F.lit("number").alias("t")),
        F.when(key % 2 == 0, F.struct(
            F.when(key % 6 == 0, "").otherwise(F.col("p_name")).alias("v"), F.lit("number").alias("t"))),
        F.struct(F.col("p_type").alias("v"), F.lit("string").alias("t"))))
    stage = part.select("p_brand", F.inline(fields)).select(
        "p_brand", F.col("v").alias("normalized"), F.col("t").alias("declared_type"),
        F.when(F.col("v") != "", F.col("t")).alias("typed_type"),
        F.when(F.col("t") == "number", numbers.to_double("v").isNotNull()).otherwise(F.lit(True)).alias("typed_ok"))
    return metrics.kpi_coverage(stage, ["p_brand"])


@query("run_agreement", """
SELECT count(*) AS fields, round(avg(CASE WHEN p_partkey % 25 = 0 THEN 0.0 ELSE 1.0 END), 4) AS agreement FROM part""")
def run_agreement(spark: SparkSession, sf: str) -> DataFrame:
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    first = part.select("p_partkey", F.col("p_name").alias("value"))
    second = part.select("p_partkey", F.when(key % 25 == 0, F.concat("p_name", F.lit("!"))).otherwise(
        F.concat("p_name", F.lit(" "))).alias("value"))
    return metrics.run_agreement(first, second, ["p_partkey"], "value")
