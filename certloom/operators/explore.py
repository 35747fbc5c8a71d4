"""Looking at a record table: filters, facets, shared values, order, recent values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom import vocab
from certloom.functions.text import strip, text
from certloom.operators.ordered import first_per_key, top_per_key


def keyword_status_filter(
    df: DataFrame, columns: list[str], keyword: str = "", status: str = "", status_column: str = "status",
) -> DataFrame:
    """Equal status and case-insensitive keyword anywhere in the joined columns."""
    word = keyword.strip().lower()
    if status.strip():
        df = df.where(F.col(status_column) == status.strip())
    if word:
        joined = F.lower(F.concat_ws(" ", *[text(c) for c in columns]))
        df = df.where(F.contains(joined, F.lit(word)))
    return df


def filter_token(c: Column | str) -> Column:
    """Trimmed value; empty or only slashes and dashes become the blank token."""
    value = strip(c)
    return F.when(value.rlike(r"^[\s/-]*$"), F.lit(vocab.BLANK_TOKEN)).otherwise(value)


def column_value_filter(df: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """Rows whose token is among the chosen values, for every column with a choice."""
    for name, values in filters.items():
        if values:
            df = df.where(filter_token(name).isin(values))
    return df


def only_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(filter_token(column) == vocab.BLANK_TOKEN)


def only_filled(df: DataFrame, column: str) -> DataFrame:
    return df.where(filter_token(column) != vocab.BLANK_TOKEN)


def facet_counts(df: DataFrame, column: str, collation: str | None = None) -> DataFrame:
    """Value counts of a column, blanks first, then by value."""
    counts = df.groupBy(filter_token(column).alias("token")).agg(F.count("*").alias("count"))
    by_value = F.collate("token", collation) if collation else F.col("token")
    label = F.when(F.col("token") == vocab.BLANK_TOKEN, "(空)").otherwise(F.col("token"))
    return counts.withColumn("label", label).orderBy(F.col("token") != vocab.BLANK_TOKEN, by_value)


def queue_stats(
    df: DataFrame, source: str = "source_file", records: str = "record_count", status: str = "status",
    pending: str = "pending",
) -> DataFrame:
    """Distinct source files, records in total, items no longer pending.

    Files are reduced to one row each before they are counted, so a file with
    very many items is combined where it is read.
    """
    per_file = df.groupBy(source).agg(
        F.sum(records).alias("records"), F.count_if(F.col(status) != pending).alias("done"))
    return per_file.agg(
        F.count(source).alias("files"), F.sum("records").alias("records"), F.sum("done").alias("done"))


def shared_values(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """One value per column if all rows agree (missing counts as ''), else null."""
    bounds = [f(text(c)).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    shared = [
        F.when(F.col(f"__lo_{c}") == F.col(f"__hi_{c}"), F.col(f"__lo_{c}")).alias(c) for c in columns]
    return df.groupBy(*(keys or [])).agg(*bounds).select(*(keys or []), *shared)


def sort_records(df: DataFrame, column: str, position: str, descending: bool = False) -> DataFrame:
    """Case-folded order; equal values stay in input order in both directions."""
    folded = F.lower(text(column))
    return df.orderBy(folded.desc() if descending else folded.asc(), F.col(position).asc())


def cap_rows(df: DataFrame, limit: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """First rows in order, overall or per key."""
    if keys:
        return top_per_key(df, keys, [F.col(c) for c in order], limit, "__n").drop("__n")
    return df.orderBy(*order).limit(limit)


# --- recent values ----------------------------------------------------------


def recent_distinct(
    df: DataFrame, key: str, value: str, position: str | Column, limit: int = 8,
) -> DataFrame:
    """The most recent distinct values per key; recency 1 is the newest."""
    at = F.col(position) if isinstance(position, str) else position
    used = df.select(F.col(key).alias("key"), strip(value).alias("value"), at.alias("at")).where(
        (F.col("value") != "") & F.col("key").isNotNull())
    last = used.groupBy("key", "value").agg(F.max("at").alias("at"))
    return top_per_key(last, ["key"], [F.col("at").desc(), F.col("value")], limit, "recency").select(
        "key", "value", "recency")


def field_values(tasks: DataFrame, position: Column, fields: str = "fields") -> DataFrame:
    """(key, value, at) rows of the field maps of past tasks, to seed recent_distinct."""
    return tasks.select(position.alias("at"), F.explode(fields).alias("key", "value"))


def suggest(recent: DataFrame, current: DataFrame) -> DataFrame:
    """Per (key, current): newest other value with that prefix, else the newest other value."""
    typed = current.select("key", strip("current").alias("current"))
    pairs = typed.join(recent, "key").where(F.col("value") != F.col("current"))
    prefix = (F.col("current") != "") & F.startswith(F.lower("value"), F.lower("current"))
    order = F.struct(F.when(prefix, 0).otherwise(1), F.col("recency"))
    return first_per_key(pairs, ["key", "current"], order, ["value"]).withColumnRenamed("value", "suggestion")
