"""Filters, facets, order and recent values over customers, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.operators import explore
from certloom.plans import query, table


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a work list; some priorities are blanked in different ways."""
    key = F.col("o_orderkey")
    blank = F.when(key % 10 == 0, "").when(key % 10 == 1, " / ").when(key % 10 == 2, "-")
    return table(spark, sf, "orders").select(
        key.alias("id"), F.col("o_custkey"), F.col("o_orderstatus").alias("status"),
        blank.otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))).alias("priority"))


_QUEUE = """
WITH queue AS (
  SELECT o_orderkey AS id, o_custkey, o_orderstatus AS status,
    CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN ' / ' WHEN 2 THEN '-' ELSE ' ' || o_orderpriority || ' ' END AS priority
  FROM orders),
tokens AS (
  SELECT *, CASE WHEN o_orderkey_mod < 3 THEN '__BLANK__' ELSE trim(priority) END AS token
  FROM (SELECT *, id % 10 AS o_orderkey_mod FROM queue))
"""


@query("facet_counts", _QUEUE + """
SELECT token, CASE WHEN token = '__BLANK__' THEN '(空)' ELSE token END AS label, count(*) AS count
FROM tokens WHERE status = 'F' GROUP BY token""")
def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    kept = explore.keyword_status_filter(queue(spark, sf), ["priority"], status="F")
    return explore.facet_counts(kept, "priority")


@query("keyword_status_filter", _QUEUE + """
SELECT id, status, trim(priority) AS priority FROM queue
WHERE status = 'O' AND contains(lower(priority || ' ' || CAST(o_custkey AS VARCHAR)), 'high')""")
def keyword_status_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = explore.keyword_status_filter(queue(spark, sf), ["priority", "o_custkey"], keyword=" HIGH ", status="O")
    return kept.select("id", "status", F.trim("priority").alias("priority"))


@query("column_value_filter", _QUEUE + """
SELECT id, status, token FROM tokens WHERE token IN ('__BLANK__', '1-URGENT') AND status IN ('P', 'O')""")
def column_value_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = explore.column_value_filter(
        queue(spark, sf), {"priority": ["__BLANK__", "1-URGENT"], "status": ["P", "O"], "id": []})
    return kept.select("id", "status", explore.filter_token("priority").alias("token"))


@query("queue_stats", """
SELECT count(DISTINCT o_custkey) AS files, CAST(sum(1 + o_orderkey % 3) AS BIGINT) AS records,
  count(*) FILTER (WHERE o_orderstatus <> 'P') AS done FROM orders""")
def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    items = queue(spark, sf).withColumn("record_count", 1 + F.col("id") % 3)
    return explore.queue_stats(items, source="o_custkey", pending="P")


@query("shared_value", """
SELECT c_nationkey, CASE WHEN count(DISTINCT m) = 1 THEN min(m) END AS segment,
  CASE WHEN count(DISTINCT n) = 1 THEN min(n) END AS nation
FROM (SELECT c_nationkey, CASE WHEN c_nationkey % 3 = 0 THEN 'X' ELSE c_mktsegment END AS m,
  coalesce(CASE WHEN c_custkey % 2 = 0 THEN '' END, '') AS n FROM customer) GROUP BY c_nationkey""")
def shared_value(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        "c_nationkey", F.when(F.col("c_nationkey") % 3 == 0, "X").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 2 == 0, "").alias("nation"))
    return explore.shared_values(rows, ["segment", "nation"], ["c_nationkey"])


@query("sort_records", """
SELECT c_custkey, c_mktsegment FROM customer ORDER BY lower(c_mktsegment) DESC, c_custkey""")
def sort_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return explore.sort_records(rows, "c_mktsegment", "c_custkey", descending=True)


@query("cap_rows", """
SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5""")
def cap_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first five rows per key, as the instrument table shows them."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return explore.cap_rows(rows, 5, ["event_id"], ["user_id"])


_RECENT = """
last AS (
  SELECT user_id AS key, event_type || ':' || CAST(CAST(floor(value) AS INT) % 20 AS VARCHAR) AS value,
    max(event_id) AS seen FROM events GROUP BY ALL),
recent AS (
  SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY seen DESC) AS recency FROM last
  QUALIFY recency <= 8)
"""


def _recent(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "events").select(
        "user_id", "event_id",
        F.concat(F.lit(" "), "event_type", F.lit(":"), (F.floor("value") % 20).cast("string")).alias("value"))
    return explore.recent_distinct(used, "user_id", "value", "event_id")


@query("recent_distinct", f"WITH {_RECENT} SELECT key, value, recency FROM recent")
def recent_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return _recent(spark, sf)


@query("suggest_value", f"""WITH {_RECENT},
typed AS (SELECT DISTINCT user_id AS key, left(event_type, 2) AS current FROM events)
SELECT t.key, t.current, min_by(r.value, CASE WHEN starts_with(r.value, t.current) THEN 0 ELSE 100 END + r.recency)
  AS suggestion FROM typed t JOIN recent r ON r.key = t.key AND r.value <> t.current GROUP BY ALL""")
def suggest_value(spark: SparkSession, sf: str) -> DataFrame:
    typed = table(spark, sf, "events").select(
        F.col("user_id").alias("key"), F.left("event_type", F.lit(2)).alias("current")).distinct()
    return explore.suggest(_recent(spark, sf), typed)
