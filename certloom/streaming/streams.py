"""Extraction, numbering and learning on unbounded input.

Extraction is a projection and needs no state. Numbering and learning remember counts per day and entries as a log of
runs (see runs): a batch reads what it needs of them, writes what it changes, and may be run again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from certloom.functions import text as tx
from certloom.functions.text import strip
from certloom.operators import fields, matching, metrics
from certloom.streaming.runs import FAN, Runs

Step = Callable[[DataFrame, int], None]

_COUNTS = T.StructType().add("day", T.DateType()).add("seq", T.LongType())
_CORRECTION = ["id", "updated_at", "template_name", "device_name", "device_code", "source_aliases"]
_ENTRY = (
    T.StructType().add("id", "string").add("updated_at", "string").add("template_name", "string").add("device_name", "string")
    .add("device_code", "string").add("device_name_norm", "string").add("device_code_norm", "string")
    .add("source_aliases", T.ArrayType(T.StringType())))
_VERSIONED = T.StructType([*_ENTRY.fields, T.StructField("batch", T.LongType())])


def stream_extract(texts: DataFrame, doc_id: str = "doc_id", source: str = "text") -> DataFrame:
    """Fields of documents as they arrive."""
    return fields.extract_fields(texts, doc_id, source)


def read_text_stream(spark: SparkSession, path: str) -> DataFrame:
    """New text files of a folder, one document each."""
    return spark.readStream.format("text").option("wholetext", True).load(path).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def _run(stream: DataFrame, step: Step, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _staged(batch: DataFrame, n: int, root: str) -> DataFrame:
    """The rows of a batch, read from the source once; the folder is used again two batches later."""
    at = f"{root}/batch/slot={n % 2}"
    batch.write.mode("overwrite").parquet(at)
    return batch.sparkSession.read.schema(batch.schema).parquet(at)


# --- numbers per day --------------------------------------------------------


def _per_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day").agg(F.sum("seq").alias("seq"))


def numbering_step(day: str, arrival: str, folder: str, explicit: str | None = None, fan: int = FAN) -> Step:
    """What stream_daily_number does with a batch."""
    root = folder.rstrip("/")
    counts = Runs(f"{root}/counts", _COUNTS, _per_day, fan)

    def step(batch: DataFrame, n: int) -> None:
        rows = _staged(batch, n, root)
        given: Column | None = F.col(explicit) if explicit else None
        free = rows if given is None else rows.where(F.coalesce(strip(given), F.lit("")) == "")
        new = free.groupBy(F.col(day).cast("date").alias("day")).agg(F.count("*").alias("seq"))
        issued = _per_day(counts.before(rows.sparkSession, n).join(new.select("day"), "day", "left_semi"))
        metrics.daily_numbers(rows, day, arrival, given, issued).write.mode("overwrite").parquet(f"{root}/out/batch={n}")
        counts.write(n, new)

    return step


def stream_daily_number(
    stream: DataFrame, day: str, arrival: str, folder: str, explicit: str | None = None, once: bool = False, fan: int = FAN,
) -> StreamingQuery:
    """Report numbers per day across batches, in out/batch=N below the folder.

    Rows of a day that come late go on where that day ended. A day with most of a batch is spread over tasks.
    Rows with an explicit number keep it and count for nothing; rows without a day get a null number.
    """
    return _run(stream, numbering_step(day, arrival, folder, explicit, fan), f"{folder.rstrip('/')}/checkpoint", once)


# --- learned corrections ----------------------------------------------------


def _newest(rows: DataFrame) -> DataFrame:
    values = [c for c in _VERSIONED.names if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*values), "batch").alias("__v")).select("id", *[F.col("__v")[c].alias(c) for c in values])


def _keys(rows: DataFrame) -> DataFrame:
    """(id, key): code, name and aliases by which a correction may find an entry."""
    def marked(kind: str, key: Column) -> Column:
        return F.when(key != "", F.concat(F.lit(kind), key))

    code, name = marked("code ", tx.code_norm("device_code")), marked("name ", tx.match_text("device_name"))
    aliases = F.transform(F.coalesce("source_aliases", F.array().cast("array<string>")), lambda a: marked("alias ", tx.match_text(a)))
    return rows.select("id", F.explode(F.concat(F.array(code, name), aliases)).alias("key")).where("key IS NOT NULL")


def learning_step(folder: str, fan: int = FAN) -> Step:
    """What stream_feedback does with a batch."""
    root = folder.rstrip("/")
    entries = Runs(f"{root}/learned", _VERSIONED, _newest, fan)

    def step(batch: DataFrame, n: int) -> None:
        rows = _staged(batch.select(*[F.col(c).cast(_ENTRY[c].dataType).alias(c) for c in _CORRECTION]), n, root)
        log = entries.before(rows.sparkSession, n)
        # entries that any row of the batch may find, by any of their versions; more do no harm
        found = _keys(log).join(_keys(rows).select("key").distinct(), "key", "left_semi").select("id").distinct()
        known = _newest(log.join(found, "id", "left_semi")).select(*_ENTRY.names)
        learned = matching.learn_feedback(known.select(*_CORRECTION), rows).select(*_ENTRY.names)
        entries.write(n, learned.subtract(known).withColumn("batch", F.lit(n).cast("long")))

    return step


def stream_feedback(stream: DataFrame, folder: str, once: bool = False, fan: int = FAN) -> StreamingQuery:
    """Learned entries across batches of corrections; learned_entries reads them.

    A batch reads the entries that share a code, a name or an alias with it and writes those that it adds or changes.
    """
    return _run(stream, learning_step(folder, fan), f"{folder.rstrip('/')}/checkpoint", once)


def learned_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of every learned entry. To be read between batches: a running one may replace an old run."""
    return _newest(Runs(f"{folder.rstrip('/')}/learned", _VERSIONED, _newest).everything(spark)).select(*_ENTRY.names)
