"""Joins against lookup tables that hold one row per key, and the search for many patterns at once."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.shipping import by_value

SALTS = 4096
#: Patterns (and characters of them) that one automaton holds.
SHARD = 20_000
SHARD_CHARS = 1 << 20


def unique_values(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key; a value is kept only where the key has exactly one distinct value."""
    bounds = [f(v).alias(f"__{n}_{v}") for v in values for n, f in (("lo", F.min), ("hi", F.max))]
    kept = [
        F.when(F.col(f"__lo_{v}") == F.col(f"__hi_{v}"), F.col(f"__lo_{v}")).alias(v) for v in values]
    return df.groupBy(*keys).agg(*bounds).select(*keys, *kept)


def lookup_join(
    df: DataFrame, lookup: DataFrame, on: dict[str, Column], values: dict[str, str], salt: Column, tasks: int | None = None,
) -> DataFrame:
    """Left join to a one-row-per-key lookup.

    on: lookup key column -> key expression over df. Rows whose key is null
    cannot match; their key is replaced by salted non-matching text, so they
    spread over all tasks instead of meeting in one. A hot real key meets one
    lookup row and is split by adaptive skew handling.
    values: lookup column -> name in the result.
    tasks: deals df by key to so many tasks, which adaptive execution neither joins nor splits, for costly work that follows.
    """
    names = list(on)
    missing = F.lit(False)
    for key in on.values():
        missing = missing | key.isNull()
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("string"))
    left = df.withColumns(
        {f"__j_{n}": F.when(missing, spread).otherwise(on[n].cast("string")) for n in names})
    right = lookup.where(" AND ".join(f"`{n}` IS NOT NULL" for n in names)).select(
        *[F.col(n).cast("string").alias(f"__j_{n}") for n in names],
        *[F.col(v).alias(out) for v, out in values.items()])
    if tasks is not None:
        left, right = left.repartition(tasks, *[f"__j_{n}" for n in names]), right.hint("merge")
    return left.join(right, [f"__j_{n}" for n in names], "left").select(*df.columns, *values.values())


def composite(*parts: Column) -> Column:
    """One text for several key parts, null if one is null; lengths keep parts apart."""
    missing = reduce(lambda a, b: a | b, [p.isNull() for p in parts])
    texts = [p.cast("string") for p in parts]
    sized = [x for t in texts[:-1] for x in (F.length(t).cast("string"), F.lit(":"), t)]
    return F.when(~missing, F.concat(*sized, texts[-1]))


def keyed(df: DataFrame, keys: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """A row for each kind of key that a row has: which, key and the carried values.

    keys: kind -> text, or array of texts; null keys give no row.
    """
    def of(which: str, key: Column) -> Column:
        many = key if isinstance(df.select(key).schema[0].dataType, T.ArrayType) else F.array(key)
        kept = F.array_compact(F.coalesce(many, F.array().cast("array<string>")))
        return F.transform(kept, lambda x: F.struct(F.lit(which).alias("which"), x.alias("key")))

    every = F.concat(*(of(which, key) for which, key in keys.items()))
    return df.select(F.explode(every).alias("__k"), *(c.alias(n) for n, c in carry.items())).select("__k.which", "__k.key", *carry)


def lookup_many(rows: DataFrame, row_id: str, probes: DataFrame, entries: DataFrame, found: dict[str, Column], more: DataFrame | None = None) -> DataFrame:
    """rows with the columns `found`, aggregates over all entries that a row's probes meet.

    probes: (which, key, row); entries: (which, key, values ...), one row per key and kind, whatever the
    kinds are: one join serves all of them. A row without probes is sent nowhere, a hot key meets one entry and is
    split by adaptive skew handling. more: further (row, which, values ...) that are met already.
    """
    met = probes.join(entries, ["which", "key"]).drop("key")
    if more is not None:
        met = met.unionByName(more, allowMissingColumns=True)
    per_row = met.groupBy(F.col("row").alias("__row")).agg(*(c.alias(n) for n, c in found.items()))
    return rows.join(per_row, rows[row_id] == per_row["__row"], "left").drop("__row")


def _occurring(words: Iterable[str]):
    """A function that gives the words that occur in a text, found in one pass over it."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in words:
        automaton.add_word(word, word)
    if not len(automaton):
        return lambda text: ()
    automaton.make_automaton()
    return lambda text: {word for _, word in automaton.iter(text)}


def _made(rows: list, found: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, kind), pa.array(found, pa.string())], names=["__row", "__needle"])


def _hits_of_few(texts: DataFrame, words: list[str], schema: T.StructType) -> DataFrame:
    """One automaton for all patterns, sent to the tasks; texts stay where they are."""

    def run(batches):
        occurring = _occurring(words)
        for batch in batches:
            rows, found = [], []
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                hits = occurring(text.as_py() or "")
                rows += [row] * len(hits)
                found += hits
            yield _made([r.as_py() for r in rows], found, batch.schema.field(0).type)

    return texts.mapInArrow(run, schema)


def _hits_of_many(texts: DataFrame, patterns: DataFrame, shards: int, schema: T.StructType) -> DataFrame:
    """Patterns dealt to shards; each shard's automaton is built ahead of the texts of its partition, which stream through it."""
    salts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    nothing = F.lit(None).cast(schema[0].dataType).alias("__row")
    dealt = patterns.select(
        F.pmod(F.xxhash64("__needle"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.lit(0).alias("kind"), nothing, F.col("__needle").alias("text"))
    sent = texts.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "__row", F.col("__text").alias("text"))

    def run(batches):
        group, words, occurring = None, [], None
        for batch in batches:
            rows, found = [], []
            for shard, salt, kind, row, text in zip(*(batch.column(i) for i in range(5)), strict=True):
                if (shard.as_py(), salt.as_py()) != group:
                    group, words, occurring = (shard.as_py(), salt.as_py()), [], None
                if kind.as_py() == 0:
                    words.append(text.as_py())
                    continue
                if occurring is None:
                    occurring, words = _occurring(words), []
                hits = occurring(text.as_py() or "")
                rows += [row.as_py()] * len(hits)
                found += hits
            yield _made(rows, found, batch.schema.field(3).type)

    both = dealt.unionByName(sent).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return both.mapInArrow(run, schema)


def pattern_hits(
    df: DataFrame, row_id: str, haystack: Column, needles: DataFrame, needle: str, carry: list[str],
    shard: int = SHARD, shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """(row_id, needle columns) for every needle that occurs in the row's text; empty needles occur nowhere.

    One pass over each text, whatever the number of needles: an automaton finds all that occur. Up to `shard` needles
    of `shard_chars` characters in all are sent to the tasks; that is measured first. More are dealt to shards of that
    size, through each of which the texts stream. Either way the rows are the same.
    """
    spark = df.sparkSession
    texts = df.select(F.col(row_id).alias("__row"), haystack.alias("__text"))
    patterns = needles.select(F.col(needle).alias("__needle")).where(F.length("__needle") > 0).distinct()
    number, chars = patterns.agg(F.count("*"), F.coalesce(F.sum(F.length("__needle")), F.lit(0))).first()
    schema = T.StructType([T.StructField("__row", texts.schema["__row"].dataType), T.StructField("__needle", T.StringType())])
    shards = max(-(-number // shard), -(-chars // shard_chars))
    if not number:
        hits = spark.createDataFrame([], schema)
    elif shards == 1:
        hits = _hits_of_few(texts, [r[0] for r in patterns.collect()], schema)
    else:
        hits = _hits_of_many(texts, patterns, shards, schema)
    named = hits.withColumnsRenamed({"__row": row_id, "__needle": needle})
    return named.join(needles.select(needle, *carry), needle).select(row_id, needle, *carry) if carry else named


by_value(__name__)
