"""Derived values of records: formulas, numbers per day, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.functions import numbers
from certloom.functions.text import strip
from certloom.operators.ordered import running


def apply_formulas(df: DataFrame, template: str | None = None) -> DataFrame:
    """Base formulas and those of the template's profiles, in order.

    A target is written only when empty, except by the two date formulas.
    Missing target columns are added.
    """
    for condition, config in numbers.formula_steps(F.col(template) if template else None):
        fields = {c: F.col(c) for c in df.columns}
        new = numbers.FORMULAS[config["type"]](fields, config)
        if condition is not None:
            old = {k: (F.col(k) if k in df.columns else F.lit(None).cast("string")) for k in new}
            new = {k: F.when(condition, v).otherwise(old[k]) for k, v in new.items()}
        df = df.withColumns(new)
    return df


def daily_numbers(
    df: DataFrame, day: str, arrival: str, explicit: Column | None = None, issued: DataFrame | None = None,
    name: str = "report_no",
) -> DataFrame:
    """An explicit number is kept; the others count per day from 1 as YYYYMMDD + two digits.

    arrival: whole number or time stamp, unique per day. issued: (day, seq) numbers already given
    out; counting goes on after them. Days are counted in blocks, so a day
    with most of the rows is spread over tasks.
    """
    given = F.nullif(strip(explicit), F.lit("")) if explicit is not None else F.lit(None).cast("string")
    keyed = df.withColumns({"__given": given})
    counted = running(
        keyed, [day], arrival, {"__seq": ("sum", F.col("__given").isNull().cast("long"))}, block=None)
    if issued is not None:
        last = issued.groupBy(F.col("day").alias("__day")).agg(F.max("seq").alias("__last"))
        counted = counted.join(last, F.col(day) == F.col("__day"), "left")
    else:
        counted = counted.withColumn("__last", F.lit(0).cast("long"))
    seq = (F.col("__seq") + F.coalesce("__last", F.lit(0))).cast("string")
    padded = F.when(F.length(seq) < 2, F.lpad(seq, 2, "0")).otherwise(seq)
    number = F.coalesce("__given", F.concat(F.date_format(day, "yyyyMMdd"), padded))
    return counted.select(*df.columns, number.alias(name))


def next_record_no(df: DataFrame, record_no: str = "record_no") -> DataFrame:
    """Per day: 'YYYYMMDD-NNN', one after the highest number used."""
    pattern = r"^(\d{8})-(\d{3,})$"
    parsed = df.select(
        F.regexp_extract(strip(record_no), pattern, 1).alias("day"),
        F.regexp_extract(strip(record_no), pattern, 2).try_cast("long").alias("seq")).where("seq IS NOT NULL")
    top = parsed.groupBy("day").agg((F.max("seq") + 1).cast("string").alias("n"))
    padded = F.when(F.length("n") < 3, F.lpad("n", 3, "0")).otherwise(F.col("n"))
    return top.select("day", F.concat("day", F.lit("-"), padded).alias("record_no"))


def serial_number(explicit: Column, record_no: Column, fallback_day: Column) -> Column:
    """Report serial: the given one, else from the record number, else the day's first."""
    given = F.nullif(strip(explicit), F.lit(""))
    pattern = r"^(\d{8})[-_]?(\d{1,4})$"
    day = F.nullif(F.regexp_extract(strip(record_no), pattern, 1), F.lit(""))
    seq = F.regexp_extract(strip(record_no), pattern, 2)
    padded = F.when(F.length(seq) < 2, F.lpad(seq, 2, "0")).otherwise(seq)
    return F.coalesce(given, F.concat(day, padded), F.concat(F.date_format(fallback_day, "yyyyMMdd"), F.lit("01")))


def kpi_coverage(stage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of filled fields and of typed values that agree with the declared type."""
    filled = strip("normalized") != ""
    typed = F.col("typed_type").isNotNull()
    agrees = typed & (F.col("typed_type") == F.col("declared_type")) & F.col("typed_ok")
    return stage.groupBy(*(keys or [])).agg(
        F.count("*").alias("fields"), F.count_if(filled).alias("filled"),
        F.round(F.avg(filled.cast("double")), 4).alias("coverage"),
        F.round(F.count_if(agrees) / F.count_if(typed), 4).alias("type_agreement"))


def run_agreement(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of key fields on which two runs agree."""
    a = left.select(*keys, strip(value).alias("a"))
    b = right.select(*keys, strip(value).alias("b"))
    both = a.join(b, keys, "full")
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    return both.agg(F.count("*").alias("fields"), F.round(F.avg(same.cast("double")), 4).alias("agreement"))


def library_summary(templates: DataFrame, records: DataFrame) -> DataFrame:
    """Counts over templates (has_core_markers) and records (coverage)."""
    t = templates.agg(
        F.count("*").alias("template_total"), F.count_if("has_core_markers").alias("template_with_core_markers"))
    r = records.agg(
        F.count("*").alias("raw_record_total"), F.count_if(F.col("coverage") > 0).alias("raw_record_with_any_field"))
    both = t.select(F.lit(1).alias("one"), "*").join(r.select(F.lit(1).alias("one"), "*"), "one")
    return both.drop("one")


def coverage(columns: list[str]) -> Column:
    """Number of non-empty fields of a row."""
    return sum(((strip(c) != "").cast("int") for c in columns), F.lit(0))
