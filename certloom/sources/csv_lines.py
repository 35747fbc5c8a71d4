"""Lines of CSV files to records, whose quoted cells may hold separators, quotes and line feeds, also across splits.

A line alone doesn't tell whether it begins inside a quoted cell. What it tells is where it ends in both cases: that is
the same for all lines before a certain one (it ends outside, or inside, either way) or depends on the beginning (kept,
or turned round). These four transitions compose, so each split counts both cases, one row per split tells which was
right, and only lines of records of more than one line are put together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from certloom.session import written

_QUOTED = '"(?:[^"]++|"")*+"'


def _ends_inside(line: Column, separator: str) -> Column:
    """1 if a line that begins outside of quotes ends inside a quoted cell, else 0."""
    s = re.escape(separator)
    cell = f'(?:{_QUOTED}[^{s}]*+|[^"{s}][^{s}]*+|)'
    return (~line.rlike(rf"\A(?:{cell}{s})*+{cell}\z")).cast("int")


def _parity(number: Column) -> Column:
    return (number % 2).cast("int")


def _state(anchor: Column, swaps: Column, first: Column | int) -> Column:
    """1 inside of quotes, 0 outside: from the last fixed state, or the first one, and the turns since."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.coalesce(anchor, first).bitwiseXOR(_parity(swaps))


def records_of_lines(lines: DataFrame, separator: str = ",") -> DataFrame:
    """(file_id, row_idx, record): the records of each file, numbered from 0; blank lines between records are none.

    lines: (file_id, block_start, in_block, value), a split of a file per block_start, its lines in the order of
    in_block (any type that has one). They are read once and written; a split's lines are in one task, splits are one row
    each. A quoted cell that is never closed runs to the end of its file. Lines of a record are joined by a line feed.
    """
    inside = W.partitionBy("file_id", "block_start").orderBy("in_block")
    ahead = inside.rowsBetween(W.unboundedPreceding, -1)
    turns = lines.select("file_id", "block_start", "in_block", "value").withColumns({
        "end0": _ends_inside(F.col("value"), separator), "end1": _ends_inside(F.concat(F.lit('"'), "value"), separator)})
    turns = turns.withColumn("swap", F.when(F.col("end0") > F.col("end1"), 1).otherwise(0))
    turns = turns.withColumn("swaps", F.sum("swap").over(inside))
    fixed = F.when(F.col("end0") == F.col("end1"), F.col("end0")).bitwiseXOR(_parity(F.col("swaps")))
    turns = turns.withColumn("anchor", fixed)
    turns = turns.withColumn("fixed", F.last("anchor", ignorenulls=True).over(ahead))
    past = F.col("swaps") - F.col("swap")
    turns = turns.withColumns({f"open{s}": _state(F.col("fixed"), past, s) for s in (0, 1)})
    filled = F.trim("value") != ""
    turns = turns.withColumns({f"no{s}": F.sum(F.when((F.col(f"open{s}") == 0) & filled, 1).otherwise(0)).over(inside) for s in (0, 1)})
    known = written(turns.drop("fixed", "swap"))

    splits = known.groupBy("file_id", "block_start").agg(
        F.max("swaps").alias("turned"), F.max("no0").alias("n0"), F.max("no1").alias("n1"),
        F.max_by("anchor", F.when(F.col("anchor").isNotNull(), F.col("in_block"))).alias("last_anchor"))
    by_file = W.partitionBy("file_id").orderBy("block_start")
    earlier = by_file.rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("all_turned", F.sum("turned").over(by_file))
    ended = F.col("last_anchor").bitwiseXOR(_parity(F.col("turned"))).bitwiseXOR(_parity(F.col("all_turned")))
    splits = splits.withColumn("ended", ended)
    splits = splits.withColumn("first", _state(F.last("ended", ignorenulls=True).over(earlier), F.col("all_turned") - F.col("turned"), 0))
    right = F.when(F.col("first") == 0, F.col("n0")).otherwise(F.col("n1"))
    splits = splits.withColumn("offset", F.coalesce(F.sum(right).over(earlier), F.lit(0)))
    places = splits.select("file_id", "block_start", "first", "offset")

    def chosen(zero: str, one: str) -> Column:
        return F.when(F.col("first") == 0, F.col(zero)).otherwise(F.col(one))

    placed = known.join(places, ["file_id", "block_start"]).withColumn("open", chosen("open0", "open1"))
    ends = F.when(F.col("open") == 0, F.col("end0")).otherwise(F.col("end1"))
    placed = placed.withColumns({"row_idx": F.col("offset") + chosen("no0", "no1") - 1, "ends": ends}).where((F.col("open") == 1) | filled)
    alone = (F.col("open") == 0) & (F.col("ends") == 0)
    part = F.struct("block_start", "in_block", "value")
    several = placed.where(~alone).groupBy("file_id", "row_idx").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return placed.where(alone).select("file_id", "row_idx", F.col("value").alias("record")).unionByName(
        several.select("file_id", "row_idx", joined.alias("record")))


def cells_of(record: Column, separator: str = ",") -> Column:
    """The cells of a record, as many as it has; quotes around a cell go, doubled ones inside are one."""
    s = re.escape(separator)
    found = F.regexp_extract_all(F.concat(F.lit(separator), record), F.lit(f"{s}({_QUOTED}[^{s}]*+|[^{s}]*+)"), F.lit(1))

    def bare(cell: Column) -> Column:
        quoted = F.regexp_extract(cell, rf"\A({_QUOTED})", 1)
        content = F.replace(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit('""'), F.lit('"'))
        return F.when(quoted == "", cell).otherwise(F.concat(content, F.substring(cell, F.length(quoted) + 1, F.length(cell))))

    return F.transform(found, bare)
