"""Ragged sheets to records.

A sheet row is (file_id, sheet, row_idx, cells array<string>); one row of the
file stays one row of the table, so header texts and values are matched
inside the row and no cell is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom import vocab
from certloom.functions.text import any_of, file_name, let, match_text, one_of
from certloom.operators.ordered import top_per_key

SHEET = ["file_id", "sheet"]

_HEADER_LABELS = sorted(
    {"".join(a.split()).lower() for names in vocab.FIELD_ALIASES.values() for a in names}
    | set(vocab.EXTRA_HEADER_LABELS))


def header_score(cells: Column) -> Column:
    """struct(score, exact, filled) of one row as a header candidate."""
    filled = F.filter(F.transform(cells, match_text), lambda x: x != "")

    def score(n: Column) -> Column:
        exact = F.size(F.filter(n, lambda x: one_of(x, _HEADER_LABELS)))
        keyword = F.size(F.filter(n, lambda x: any_of(x, vocab.HEADER_KEYWORDS)))
        data = F.size(F.filter(n, lambda x: x.rlike("^[0-9a-z./:_-]+$")))
        return F.struct(
            (exact * 100 + keyword * 12 + F.size(n) - data * 3).alias("score"),
            exact.alias("exact"), F.size(n).alias("filled"))

    return let(filled, score)


def detect_header_row(rows: DataFrame, scan_rows: int = vocab.HEADER_SCAN_ROWS) -> DataFrame:
    """One row per sheet: header_idx and the header cells.

    Best score among the first non-empty rows; without two exact header texts
    the fullest row (at least two cells) is taken.
    """
    scored = rows.withColumn("s", header_score(F.col("cells"))).where(F.col("s.filled") > 0)
    head = top_per_key(scored, SHEET, [F.col("row_idx")], scan_rows)
    best = F.struct("s.score", "s.exact", "s.filled", -F.col("row_idx"))
    full = F.when(F.col("s.filled") >= 2, F.struct("s.filled", -F.col("row_idx")))
    row = F.struct("row_idx", "cells")
    picked = head.groupBy(*SHEET).agg(
        F.max_by("s.exact", best).alias("exact"), F.max_by(row, best).alias("best"),
        F.max_by(row, full).alias("full"), F.min_by(row, F.col("row_idx")).alias("first"))
    header = F.when(F.col("exact") >= 2, F.col("best")).otherwise(F.coalesce("full", "first"))
    return picked.select(*SHEET, header.alias("h")).select(
        *SHEET, F.col("h.row_idx").alias("header_idx"), F.col("h.cells").alias("header"))


def data_map(header: Column, cells: Column) -> Column:
    """Header text -> value of the non-empty cells; a later column wins over an earlier namesake."""
    pairs = F.filter(
        F.arrays_zip(F.transform(header, match_text).alias("k"), cells.alias("v")),
        lambda p: (F.coalesce(p["k"], F.lit("")) != "") & (F.coalesce(p["v"], F.lit("")) != ""))

    def build(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda p: p["k"]))
        return F.map_from_arrays(keys, F.transform(
            keys, lambda k: F.element_at(F.filter(found, lambda p: p["k"] == k), -1)["v"]))

    return let(pairs, build)


def rows_to_records(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Rows below the header as maps; empty rows are dropped."""
    headers = detect_header_row(rows) if headers is None else headers
    below = rows.join(headers, SHEET).where(
        (F.col("row_idx") > F.col("header_idx")) & F.exists("cells", lambda x: x != ""))
    return below.select(
        *SHEET, "row_idx", data_map(F.col("header"), F.col("cells")).alias("data"))


def alias_value(data: Column, field: str, aliases: dict[str, list[str]] | None = None) -> Column:
    """First non-empty value among the declared header texts of a field."""
    names = (aliases or vocab.FIELD_ALIASES).get(field, [])
    return F.coalesce(*[F.try_element_at(data, F.lit("".join(n.split()).lower())) for n in names])


def resolve_fields(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Canonical columns next to the data map."""
    wanted = fields or list(vocab.FIELD_ALIASES)
    return records.select("*", *[alias_value(F.col("data"), f).alias(f) for f in wanted])


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]] = vocab.CONTEXT_ALIASES) -> DataFrame:
    """Fill canonical columns from alias columns; an existing value is never replaced."""
    present = set(df.columns)

    def filled(name: str) -> Column:
        return F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))

    out = {}
    for field, names in aliases.items():
        sources = [n for n in [field, *names] if n in present]
        if sources:
            out[field] = F.coalesce(*[filled(n) for n in sources])
    return df.withColumns(out)


def aliased_value(
    fields: Column, task_info: Column, key: str, aliases: dict[str, list[str]],
) -> Column:
    """Value under a key or any alias (in both directions); the row before the task."""
    names = [key, *aliases.get(key, []), *[k for k, v in aliases.items() if key in v]]
    names = list(dict.fromkeys(names))

    def filled(source: Column, n: str) -> Column:
        return F.nullif(F.trim(F.try_element_at(source, F.lit(n))), F.lit(""))

    return F.coalesce(*[filled(s, n) for s in (fields, task_info) for n in names])


def is_placeholder_row(name: Column, model: Column, code: Column) -> Column:
    """A repeated header row: name and model/code both hold header words."""
    marks = F.concat(match_text(model), F.lit("\n"), match_text(code))
    return one_of(match_text(name), vocab.PLACEHOLDER_NAMES) & any_of(marks, vocab.HEADER_ROW_MODEL_MARKS)


def drop_placeholder_rows(records: DataFrame) -> DataFrame:
    return records.where(~is_placeholder_row(F.col("device_name"), F.col("device_model"), F.col("device_code")))


def raw_record(data: Column) -> Column:
    """'key: value' lines of a record."""
    lines = F.transform(F.map_entries(data), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(lines, "\n")


def record_name(certificate: Column, code: Column, name: Column, row_idx: Column) -> Column:
    """Name of the record's output file."""
    fallback = F.concat(F.lit("row_"), (row_idx + 1).cast("string"))
    filled = [F.nullif(c, F.lit("")) for c in (certificate, code, name)]
    return file_name(F.coalesce(*filled, fallback))


def preview_sheet(rows: DataFrame, max_rows: int = 80, max_cols: int | None = None) -> DataFrame:
    """First rows below the header, with title, total and truncation flag per sheet.

    max_rows: rows shown of each sheet; max_cols: columns shown, all if None. The rows are read three times: for the
    header, for title and total by one aggregate, and for the rows shown.
    """
    def narrow(c: str) -> Column:
        return F.slice(c, 1, max_cols) if max_cols else F.col(c)

    cut = rows.join(detect_header_row(rows), SHEET).withColumns({"cells": narrow("cells"), "header": narrow("header")})
    filled = cut.withColumn("n", F.size(F.filter("cells", lambda x: x != ""))).where(F.col("n") > 0)
    above, below = F.col("row_idx") < F.col("header_idx"), F.col("row_idx") > F.col("header_idx")
    only = F.element_at(F.filter("cells", lambda x: x != ""), 1)
    title = F.when(above & (F.col("n") == 1) & (F.length(only) >= 8), F.col("row_idx"))
    facts = filled.groupBy(*SHEET).agg(F.min_by(only, title).alias("title"), F.count_if(below).alias("total_rows"))
    shown = top_per_key(filled.where(below).select(*SHEET, "row_idx", "header", "cells"), SHEET, [F.col("row_idx")], max_rows)
    names = F.transform("header", lambda x, i: F.when(x != "", x).otherwise(F.concat(F.lit("列"), (i + 1).cast("string"))))
    return shown.join(facts, SHEET).select(
        *SHEET, F.coalesce("title", F.lit("")).alias("title"), names.alias("headers"),
        (F.col("row_idx") + 1).alias("row_number"), "cells", "total_rows",
        (F.col("total_rows") > max_rows).alias("truncated"))
