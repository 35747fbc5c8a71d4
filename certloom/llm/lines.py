"""Line dedup over overlapping windows of consecutive lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.shared import free_name
from certloom.shipping import by_value

#: Positions in a document are below this; the order of all windows is doc_id * POSITIONS + position.
POSITIONS = 1 << 32


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """One row per window of `size` consecutive lines: its 128-bit hash and its place in the corpus order.

    A document of fewer lines is one window of all its lines. Windows of blank lines alone don't count.
    """
    lines = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.split(F.col(text), "\n").alias("lines"))
    number = F.greatest(F.size("lines") - (size - 1), F.lit(1))
    beside = F.arrays_zip(*(F.when(F.size("lines") < size, F.array(F.get("lines", F.lit(i)))).otherwise(F.slice("lines", i + 1, number)).alias(f"l{i}") for i in range(size)))
    parts = [F.col("w")[f"l{i}"] for i in range(size)]
    rows = lines.select("doc_id", "text_key", F.posexplode(beside).alias("pos", "w"))
    return rows.where(F.concat_ws("", *parts).rlike(r"[^ \t\r]")).select(
        F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(size), *reversed(parts)).alias("h2"),
        (F.col("doc_id").cast("decimal(20,0)") * POSITIONS + F.col("pos")).alias("place"), "doc_id", "text_key", "pos")


def _covered_lines(text: str, starts, size: int) -> tuple[list[str], set[int]]:
    lines = text.split("\n")
    return lines, {i for p in starts for i in range(p, min(p + size, len(lines)))}


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, starts: pd.Series, size: pd.Series) -> pd.Series:
    def cut(t: str | None, at, n: int) -> str | None:
        if t is None or at is None:
            return t
        lines, covered = _covered_lines(t, at, n)
        return "\n".join(line for i, line in enumerate(lines) if i not in covered)

    return pd.Series([cut(t, at, n) for t, at, n in zip(text, starts, size, strict=True)], dtype=object)


@F.pandas_udf(T.IntegerType())
def _covered(text: pd.Series, starts: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([0 if at is None else len(_covered_lines(t, at, n)[1]) for t, at, n in zip(text, starts, size, strict=True)], dtype="int32")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3,
                removed: str = "n_removed") -> DataFrame:
    """The documents without the lines that a later occurrence of a repeated window covers.

    A window is `size` consecutive lines of one document (cut at line feeds), or all lines of a document that has
    fewer. Of the occurrences of a window in the corpus the first by (doc_id, position)
    stays; every line that any other occurrence covers goes, overlapping windows
    merged. So each removed line still stands at an earlier place. Null texts (they stay null) and rows with a null doc_id are left as
    they are, a document that only repeats keeps an empty text. Rows that repeat
    doc_id and text are the same document: they stay alike; rows that share a doc_id alone are cut each at its own
    lines. Adds the column `removed`, the number of lines taken out (with underscores before it while a column has
    that name); all other columns are kept.

    The windows are counted with map-side combining, so a passage in a third of
    all documents is one row per task; joining back goes by (hash), one row on the
    side of the repeated windows, which adaptive execution splits if it is hot.
    """
    rows = windows(docs, doc_id, text, size)
    first = rows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = rows.join(first, ["h1", "h2"]).where(F.col("place") > F.col("first"))
    taken = docs.columns
    key, of, at = (free_name(taken, x) for x in ("dedup_doc", "dedup_text", "dedup_starts"))
    starts = later.groupBy(F.col("doc_id").alias(key), F.col("text_key").alias(of)).agg(F.collect_set("pos").alias(at))
    joined = docs.join(starts, (F.col(doc_id).cast("long") == F.col(key)) & (F.xxhash64(F.col(text)) == F.col(of)), "left")
    keep = [_without(F.col(c), F.col(at), F.lit(size)).alias(c) if c == text else F.col(c) for c in taken]
    return joined.select(*keep, _covered(F.col(text), F.col(at), F.lit(size)).alias(free_name(taken, removed)))


by_value(__name__)
