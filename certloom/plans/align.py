"""Text lines of recognised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions.cells import FieldRule
from certloom.operators.align import align_line_to_schema
from certloom.operators.cells import SchemaColumn
from certloom.plans import query, spread, table

MEDIA = [(n, [n]) for n in ("Ar", "O2", "N2", "CO2")]
SCHEMA = [
    SchemaColumn(0, "check_date", "检验日期", rule=FieldRule("date")),
    SchemaColumn(1, "owner_code", "产权代码编号", rule=FieldRule("code", max_len=12)),
    SchemaColumn(2, "medium", "充装介质", rule=FieldRule("text", choices=MEDIA)),
    SchemaColumn(3, "maker_code", "制造单位代码", rule=FieldRule("code", max_len=12)),
    SchemaColumn(4, "serial_no", "出厂编号", rule=FieldRule("code", max_len=24)),
    SchemaColumn(5, "hydro_pressure", "水压试验压力MPa", rule=FieldRule("number")),
    SchemaColumn(6, "work_pressure", "公称工作压力MPa", rule=FieldRule("number")),
    SchemaColumn(7, "nominal_weight", "公称瓶重kg", rule=FieldRule("number")),
]


@query("align_line_to_schema", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(month(l_shipdate) AS VARCHAR) || '.' || CAST(day(l_shipdate) AS VARCHAR) AS check_date,
  CASE WHEN l_suppkey % 2 = 0 THEN CAST(300 + l_suppkey AS VARCHAR) ELSE '' END AS owner_code, CASE WHEN l_linenumber % 2 = 0 THEN 'Ar' ELSE 'CO2' END AS medium,
  'GZ' AS maker_code, 'A2004' || CAST(l_partkey AS VARCHAR) AS serial_no, '22.5' AS hydro_pressure, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.5' AS nominal_weight FROM lineitem""")
def align(spark: SparkSession, sf: str) -> DataFrame:
    even, owned = F.col("l_linenumber") % 2 == 0, F.col("l_suppkey") % 2 == 0
    medium = F.when(owned, F.when(even, "Ar").otherwise("CO2")).otherwise(F.when(even, "AI").otherwise("C02"))
    line = F.concat_ws(
        " ", F.date_format("l_shipdate", "M.d"), F.when(owned, (300 + F.col("l_suppkey")).cast("string")),
        medium, F.lit("GZ"), F.concat(F.lit("A2004"), F.col("l_partkey").cast("string")),
        F.lit("22.5 15.0"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5")))
    made = spread(table(spark, sf, "lineitem")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", align_line_to_schema(line, SCHEMA).alias("a"))
    keys = ["check_date", "owner_code", "medium", "maker_code", "serial_no", "hydro_pressure", "nominal_weight"]
    return made.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col("a")[k].alias(k) for k in keys])
