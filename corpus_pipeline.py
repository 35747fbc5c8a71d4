"""A corpus through five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.llm import bpe, jaccard, lines, mixing, toxicity
from certloom.llm.queries import TOKENIZER, table
from certloom.llm.shared import free_name, written

#: Documents from this score on are rejected.
TOXIC = 0.7
#: Rows of text that a Python worker holds at a time, so that its memory doesn't depend on how rows are batched.
ROWS_AT_ONCE = 1000


def _in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, by a model of the labelled ones among them, is below TOXIC."""
    _in_small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score, spans = free_name(docs.columns, "toxic_score"), free_name(docs.columns, "toxic_spans")
    return toxicity.tag(docs, model, score_name=score, spans=spans).where(F.col(score) < TOXIC).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated windows; one of which nothing is left goes. n_chars follows the text."""
    _in_small_batches(spark)
    removed = free_name(docs.columns, "n_removed")
    done = lines.dedup_lines(docs, removed=removed)
    done = done.where((F.col(removed) == 0) | (F.length(F.trim("text")) > 0))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id. Those without words or doc_id stay."""
    _in_small_batches(spark)
    known = jaccard.classes(docs, count_links=False)
    gone = known.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents again in random order, the same share of each source. Copies are rows alike."""
    copy = free_name(docs.columns, "copy")
    return mixing.mix_sources(docs, copy=copy).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token ids (packed), their number, and whether they decode to its text."""
    _in_small_batches(spark)
    ids, decoded = free_name(docs.columns, "ids"), free_name(docs.columns, "decoded")
    both = bpe.decode(bpe.encode(docs, TOKENIZER, ids=ids), TOKENIZER, ids=ids, text=decoded)
    same = F.col(decoded) == F.coalesce(F.col("text"), F.lit(""))
    return both.select(*docs.columns, F.col(ids), bpe.token_count(ids).alias(free_name(docs.columns, "n_tokens")), same.alias(free_name(docs.columns, "round_trip")))


STAGES = [("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("jaccard_join", without_near_copies), ("mix_sources", mixed), ("bpe", tokens)]

#: The stages train a model, join by similarity and tokenise: no SQL gives their rows. Tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
