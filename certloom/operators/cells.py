"""Recognised table cells to records: voting, slotting, typing, review and quality."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom import vocab
from certloom.functions import cells as cf
from certloom.functions import numbers
from certloom.functions.text import let, normalize_text, strip, text
from certloom.operators.ordered import running

CELL = ["table_id", "row", "col"]


@dataclass(frozen=True)
class SchemaColumn:
    """One declared column of the import schema."""

    index: int
    key: str
    label: str = ""
    group: str = vocab.DEFAULT_GROUP
    rule: cf.FieldRule = field(default_factory=cf.FieldRule)


# --- choosing among readings ------------------------------------------------


def pick_best_candidate(candidates: DataFrame, keys: list[str], later_wins: bool = True) -> DataFrame:
    """Best reading per cell by repaired score.

    candidates: keys + (col, raw_text, confidence, preprocess_id, ord). Equal
    scores: the later reading of a cell, or the earlier one between engines.
    """
    ruled = candidates.withColumn("__r", cf.column_rule("raw_text", F.col("col") - 1))
    score = cf.vote_score(F.col("confidence"), F.col("__r.score"))
    order = F.struct(score, F.col("ord") if later_wins else -F.col("ord"))
    best = F.max_by(F.struct(
        strip("raw_text").alias("raw_text"), F.col("__r.text").alias("final_text"), score.alias("confidence"),
        F.col("preprocess_id")), order)
    return ruled.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def cell_vote(candidates: DataFrame, fallback: DataFrame | None = None, keys: list[str] = CELL) -> DataFrame:
    """Readings of a cell grouped by repaired text; best (sum, best single) wins.

    Confidence is the larger of the best single score and the capped, damped
    sum. Cells without a vote keep the fallback (keys + final_text, confidence).
    """
    ruled = candidates.withColumn("__r", cf.column_rule("raw_text", F.col("col") - 1))
    scored = ruled.select(
        *keys, "ord", strip("raw_text").alias("raw_text"), F.col("__r.text").alias("final_text"), "preprocess_id",
        cf.vote_score(F.col("confidence"), F.col("__r.score")).alias("score"),
        cf.cell_text(F.col("__r.text")).alias("vote")).where((F.col("vote") != "") & (F.col("raw_text") != ""))
    per_text = scored.groupBy(*keys, "vote").agg(
        F.sum("score").alias("total"), F.max("score").alias("single"), F.min("ord").alias("first"),
        F.max_by(F.struct("raw_text", "final_text", "preprocess_id"), F.struct("score", -F.col("ord"))).alias("t"))
    won = per_text.groupBy(*keys).agg(F.max_by(
        F.struct("t.*", "total", "single"), F.struct(F.round("total", 9), F.round("single", 9), -F.col("first"))).alias("w"))
    confidence = F.greatest(F.col("w.single"), F.least(F.lit(0.99), F.col("w.total") / 2.4))
    voted = won.select(*keys, "w.raw_text", "w.final_text", "w.preprocess_id", confidence.alias("confidence"))
    if fallback is None:
        return voted
    base = fallback.select(*keys, F.col("final_text").alias("__text"), F.col("confidence").alias("__conf"))
    return base.join(voted, keys, "left").select(
        *keys, F.coalesce("raw_text", "__text").alias("raw_text"), F.coalesce("final_text", "__text").alias("final_text"),
        F.coalesce("preprocess_id", F.lit("vote")).alias("preprocess_id"),
        F.coalesce("confidence", "__conf").alias("confidence"))


def settle_cells(cells: DataFrame, relaxed: bool = False) -> DataFrame:
    """Blank noisy and weak readings; a blanked cell has confidence 0."""
    blank = cf.suppress_noise(F.col("final_text"), F.col("confidence"), F.col("col") - 1, relaxed)
    return cells.withColumn("__blank", blank).withColumns({
        "final_text": F.when(F.col("__blank"), "").otherwise(F.col("final_text")),
        "confidence": F.when(F.col("__blank"), 0.0).otherwise(F.col("confidence"))}).drop("__blank")


def reading_score(c: Column | str) -> Column:
    """How text-like a recognised page is: character classes, known words, lines."""

    def score(t: Column) -> Column:
        han = F.regexp_count(t, F.lit("[一-鿿]")) * 3
        word = F.regexp_count(t, F.lit("[A-Za-z0-9]")) * 2
        mark = F.regexp_count(t, F.lit("[/\\-_.:()]"))
        hints = sum((F.lower(t).contains(h.lower()).cast("int") for h in vocab.ROTATION_HINTS), F.lit(0)) * 24
        lines = F.size(F.filter(F.split(t, "\n"), lambda x: strip(x) != ""))
        volt = F.when(t.contains(" kV") | t.contains("kVA") | F.lower(t).contains(" hz"), 30).otherwise(0)
        junk = F.when(t.rlike("[A-Za-z]{5,}") & (lines <= 2), 20).otherwise(0)
        return han + word + mark + hints + F.least(lines, F.lit(30)) * 3 + volt - junk

    return let(normalize_text(c), score)


# --- slotting ---------------------------------------------------------------


def slot_index(
    schema: list[SchemaColumn], col: Column, key: Column, label: Column, center: Column, lines: Column,
) -> Column:
    """Zero-based schema position of a cell: column number, key, label, then position."""
    n = len(schema)
    by_key = F.regexp_extract(strip(key), r"(?i)^col_(\d{1,2})$", 1).try_cast("int") - 1
    positions: dict[str, int] = {}
    for place, column in enumerate(schema):
        if column.label.strip():
            positions.setdefault(column.label.strip(), place)
    pairs = [x for name, place in positions.items() for x in (F.lit(name), F.lit(place))]
    by_label = F.try_element_at(F.create_map(*pairs), strip(label)) if pairs else F.lit(None).cast("int")

    def by_x(ls: Column) -> Column:
        steps = F.when(F.size(ls) >= 2, F.sequence(F.lit(0), F.size(ls) - 2))
        hits = F.filter(steps, lambda i: (center >= F.get(ls, i)) & (center < F.get(ls, i + 1)))
        outside = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.size(ls) - 2))
        return F.when((F.size(ls) >= 2) & center.isNotNull(), F.coalesce(F.get(hits, F.lit(0)), outside))

    return F.coalesce(
        F.when(col.between(1, n), col - 1), F.when(by_key.between(0, n - 1), by_key), by_label, let(lines, by_x))


def even_lines(left: Column, right: Column, n: int) -> Column:
    """n equal columns between two positions."""
    width = F.greatest(F.lit(1.0), (right - left).cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: left + width * i / n)


def slot_cells(cells: DataFrame, schema: list[SchemaColumn], lines: str | None = None) -> DataFrame:
    """Add the slot of each cell that carries text (null where nothing places it).

    cells: (table_id, row, col, column_key, column_label, final_text, bbox).
    lines: column with the x positions of the table's rules; without it a row
    is cut into equal widths between its outermost cells.
    """
    filled = cells.where((strip("final_text") != "") & (F.col("row") > 0))
    box = F.when(F.size("bbox") >= 4, F.col("bbox"))
    center = (box[0] + box[2]) / 2
    if lines is None:
        # equal widths are needed only where neither number, key nor label places a cell
        spans = cells.where(F.size("bbox") >= 4).groupBy("table_id", "row").agg(
            F.min(F.col("bbox")[0]).alias("__left"), F.max(F.col("bbox")[2]).alias("__right"))
        filled = filled.join(spans, ["table_id", "row"], "left")
        ruler = even_lines(F.col("__left"), F.col("__right"), len(schema))
    else:
        ruler = F.col(lines).cast("array<double>")
    slot = slot_index(schema, F.col("col"), F.col("column_key"), F.col("column_label"), center, ruler)
    return filled.withColumns({
        "slot": slot, "x": F.coalesce(center, F.lit(0.0)),
        "y": F.coalesce((box[1] + box[3]) / 2, F.lit(0.0))}).drop("__left", "__right")


def merge_tokens(tokens: Column) -> Column:
    """Fragments of one cell: joined directly when all are code-like, else with a blank."""

    def join(parts: Column) -> Column:
        simple = F.forall(parts, lambda t: t.rlike("^[A-Za-z0-9./:-]+$"))
        return F.when(F.size(parts) == 1, parts[0]).when(simple, F.array_join(parts, "")).otherwise(
            F.array_join(parts, " "))

    return let(tokens, join)


def cells_to_records(cells: DataFrame, schema: list[SchemaColumn], lines: str | None = None) -> DataFrame:
    """One record per table row; empty slots stay empty and later ones do not shift."""
    slotted = slot_cells(cells, schema, lines)
    fragment = F.struct("y", "x", "col", strip("final_text").alias("t"))
    # one output cell holds exactly the fragments of its slot
    merged = slotted.groupBy("table_id", "row", "slot").agg(
        merge_tokens(F.transform(F.array_sort(F.collect_list(fragment)), lambda f: f["t"])).alias("value"))
    columns = [
        F.coalesce(F.max(F.when(F.col("slot") == place, F.col("value"))), F.lit("")).alias(c.key)
        for place, c in enumerate(schema)]
    records = merged.groupBy("table_id", "row").agg(*columns)
    keys = [F.nullif(F.col(c.key), F.lit("")) for c in schema]
    return records.withColumn("raw_record", F.concat_ws(" ", *keys))


# --- field stages -----------------------------------------------------------


def validate_stage(
    raw: Column, normalized: Column, rule: cf.FieldRule, warnings: Column | None = None,
) -> Column:
    """struct(status, errors, warnings) of one field."""
    raw, value = strip(raw), strip(normalized)
    notes = [] if warnings is None else [warnings]
    errors = []
    if rule.expected_pattern:
        notes.append(F.when(
            (value != "") & ~value.rlike(rule.expected_pattern),
            F.array(F.lit(f"不匹配 expectedPattern: {rule.expected_pattern}"))))
    if rule.forbidden_pattern:
        errors.append(F.when(
            (value != "") & value.rlike(rule.forbidden_pattern), f"命中 forbiddenPattern: {rule.forbidden_pattern}"))
    errors.append(F.when((value == "") & (raw != ""), "解析失败"))
    if rule.required and not rule.empty_ok:
        errors.append(F.when((value == "") & (raw == ""), "必填字段为空"))
    none = F.array().cast("array<string>")
    parts = F.struct(
        F.array_compact(F.array(*errors)).alias("errors"),
        F.concat(none, *[F.coalesce(n, none) for n in notes]).alias("warnings"))

    def status(p: Column) -> Column:
        state = (
            F.when(F.size(p["errors"]) > 0, "failed").when(F.size(p["warnings"]) > 0, "warning")
            .when((value == "") & (raw == ""), "waiting").otherwise("parsed"))
        return F.struct(state.alias("status"), p["errors"].alias("errors"), p["warnings"].alias("warnings"))

    return let(parts, status)


def field_stages(
    schema: list[SchemaColumn], raw: Callable[[str], Column], ref_year: int, warning: Callable[[str], Column] | None = None,
) -> Column:
    """array<struct> with one stage per schema column, computed inside the row."""

    def one(column: SchemaColumn) -> Column:
        base = strip(raw(column.key))
        note = strip(warning(column.key)) if warning else F.lit("")
        if column.rule.type == "checkbox_choice":
            note = F.when(note != "", note).when(cf.valve_conflict(base), vocab.VALVE_CONFLICT).otherwise("")

        def stage(p: Column) -> Column:
            normalized = cf.apply_field_rule(p["raw"], column.rule, column.label)
            typed = cf.typed_value(normalized, column.rule, ref_year, column.label)

            def finish(s: Column) -> Column:
                dropped = p["note"] != ""
                none = F.array().cast("array<string>")
                notes = [F.coalesce(s["typed"]["warnings"], none), F.when(dropped, F.array(p["note"])).otherwise(none)]
                if column.label == "制造年月":
                    changed = (p["raw"] != "") & (s["normalized"] != "") & (p["raw"] != s["normalized"])
                    fixed = F.concat(F.lit("制造年月从 "), p["raw"], F.lit(" 自动校正为 "), s["normalized"])
                    notes.insert(0, F.when(changed, F.array(fixed)).otherwise(none))
                raw_kept = F.when(dropped, "").otherwise(p["raw"])
                value = F.when(dropped, "").otherwise(s["normalized"])
                checked = validate_stage(raw_kept, value, column.rule, F.concat(*notes))
                display = F.when(dropped, "").otherwise(
                    F.coalesce(s["typed"]["display"], F.nullif(s["normalized"], F.lit("")), p["raw"]))
                return let(checked, lambda v: F.struct(
                    F.lit(column.key).alias("key"), F.lit(column.label).alias("label"),
                    F.lit(column.group).alias("group"), raw_kept.alias("raw"), value.alias("normalized"),
                    display.alias("display"), s["typed"].alias("typed"), v["status"].alias("status"),
                    v["errors"].alias("errors"), v["warnings"].alias("warnings")))

            return let(F.struct(normalized.alias("normalized"), typed.alias("typed")), finish)

        return let(F.struct(base.alias("raw"), F.coalesce(note, F.lit("")).alias("note")), stage)

    return F.array(*[one(c) for c in schema])


def group_rollup(stages: Column, groups: list[str]) -> Column:
    """array<struct(group, total, parsed, warning, failed, status)>; the worst state wins."""

    def one(name: str) -> Column:
        mine = F.filter(stages, lambda s: s["group"] == name)

        def count(state: str) -> Callable[[Column], Column]:
            return lambda m: F.size(F.filter(m, lambda s: s["status"] == state))

        def roll(m: Column) -> Column:
            p, w, f = count("parsed")(m), count("warning")(m), count("failed")(m)
            state = F.when(f > 0, "failed").when(w > 0, "warning").when(p > 0, "parsed").otherwise("waiting")
            return F.struct(
                F.lit(name).alias("group"), F.size(m).alias("total"), p.alias("parsed"), w.alias("warning"),
                f.alias("failed"), state.alias("status"))

        return let(mine, roll)

    return F.array(*[one(g) for g in groups])


# --- review and quality -----------------------------------------------------


def build_review_queue(cells: DataFrame, records: DataFrame) -> DataFrame:
    """Low confidence, empty critical cells, and contradictions inside rows.

    cells: CELL + (column_key, final_text, confidence); records: table_id, row
    and the columns col_08 ... col_33 the row checks read.
    """
    reasons = cf.review_reasons(F.col("final_text"), F.col("confidence"), F.col("col") - 1)
    from_cells = cells.select(
        *CELL, "column_key", F.explode(reasons).alias("reason"), F.round("confidence", 4).alias("confidence"))
    present = set(records.columns)
    found = cf.row_inconsistencies(lambda k: F.col(k) if k in present else F.lit(""))
    from_rows = records.select("table_id", "row", F.explode(found).alias("i")).select(
        "table_id", "row", F.lit(None).cast("int").alias("col"), "i.column_key", "i.reason",
        F.lit(None).cast("double").alias("confidence"))
    return from_cells.select(
        "table_id", "row", F.col("col").cast("int").alias("col"), "column_key", "reason", "confidence").unionByName(from_rows)


def table_quality(cells: DataFrame, review: DataFrame, relaxed: bool = False) -> DataFrame:
    """Fill, critical fill and review ratios per table, and whether it is usable."""
    filled = strip("final_text") != ""
    critical = cf.is_critical(F.col("col") - 1)
    sums = cells.groupBy("table_id", "row").agg(
        F.count("*").alias("cells"), F.count_if(filled).alias("filled"), F.count_if(critical).alias("crit"),
        F.count_if(critical & filled).alias("crit_filled"))
    totals = sums.groupBy("table_id").agg(
        F.sum("cells").alias("cells"), F.sum("filled").alias("filled"), F.sum("crit").alias("crit"),
        F.sum("crit_filled").alias("crit_filled"), F.count_if(F.col("filled") > 0).alias("row_count"))
    reviews = review.groupBy("table_id").agg(F.count("*").alias("reviews"))
    ratios = totals.join(reviews, "table_id", "left").select(
        "table_id", "row_count", (F.col("filled") / F.col("cells")).alias("f"),
        (F.col("crit_filled") / F.greatest(F.lit(1), F.col("crit"))).alias("c"),
        (F.coalesce("reviews", F.lit(0)) / F.col("cells")).alias("r"))
    good = (
        (F.col("row_count") > 0) & (F.col("f") >= vocab.MIN_NON_EMPTY_RATIO) & (F.col("c") >= vocab.MIN_CRITICAL_RATIO)
        & (F.col("r") <= vocab.MAX_REVIEW_RATIO))
    salvage = F.lit(relaxed) & (F.col("row_count") > 0) & ((F.col("f") >= 0.10) | (F.col("c") >= 0.08))
    return ratios.select(
        "table_id", "row_count", F.round("f", 4).alias("non_empty_ratio"),
        F.round("c", 4).alias("critical_non_empty_ratio"), F.round("r", 4).alias("review_ratio"),
        (good | salvage).alias("ok"), (~good & salvage).alias("salvaged"))


def quality_score(
    width: Column, height: Column, sharpness: Column, contrast: Column, table_ok: Column, table_empty: Column,
    review_ratio: Column,
) -> Column:
    """struct(score, issues, summary) of an image's measured properties."""

    def issue(test: Column, code: str, penalty: int, message: str) -> Column:
        return F.when(test, F.struct(
            F.lit(code).alias("code"), F.lit(penalty).alias("penalty"), F.lit(message).alias("message")))

    bad_table = ~F.coalesce(table_ok, F.lit(True))
    issues = F.array_compact(F.array(
        issue(F.least(width, height) < 1800, "low_resolution", 20, "分辨率偏低，小字难以稳定识别"),
        issue(sharpness < 70, "blur", 22, "清晰度不足，文字边缘模糊"),
        issue((sharpness >= 70) & (sharpness < 110), "soft_focus", 10, "清晰度一般，细小手写字可能丢失"),
        issue(contrast < 45, "low_contrast", 16, "对比度偏低，网格线和文字分离困难"),
        issue(bad_table & table_empty, "table_not_detected", 18, "未稳定检测到有效表格行"),
        issue(bad_table & (review_ratio > 0.6), "high_uncertainty", 12, "低置信度单元格比例偏高")))

    def build(found: Column) -> Column:
        penalty = F.aggregate(found, F.lit(0), lambda a, x: a + x["penalty"])
        return F.struct(
            F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).alias("score"),
            F.transform(found, lambda x: x["code"]).alias("issues"),
            F.array_join(F.transform(F.slice(found, 1, 3), lambda x: x["message"]), "；").alias("summary"))

    return let(issues, build)


# --- table geometry ---------------------------------------------------------


def merged_cell_fill(cells: DataFrame) -> DataFrame:
    """Empty continuation cells take the text of the cell that started the merge.

    cells: (table_id, row, col, text, vmerge); vmerge is 'restart', 'continue' or null.
    """
    open_text = (
        F.when(F.col("vmerge") == "restart", text("text")).when(F.col("vmerge") == "continue", F.lit(None))
        .otherwise(F.lit("")))
    carried = running(cells, ["table_id", "col"], "row", {"__open": ("last", open_text)})
    filled = F.when(
        (F.col("vmerge") == "continue") & (text("text") == ""), F.coalesce("__open", F.lit(""))).otherwise(text("text"))
    return carried.withColumn("text", filled).select(*cells.columns)


def merge_near(positions: DataFrame, keys: list[str], position: str, gap: int = 6) -> DataFrame:
    """Chain integer positions whose gaps are at most ``gap``; rounded mean per chain."""
    distinct = positions.groupBy(*keys, F.col(position).cast("long").alias("__p")).agg(F.count("*").alias("__n"))
    block = 1 << 16
    before = running(distinct, keys, "__p", {"__prev": ("max", F.col("__p"))}, inclusive=False, block=block)
    starts = F.when(F.col("__prev").isNull() | (F.col("__p") - F.col("__prev") > gap), 1).otherwise(0)
    chained = running(before, keys, "__p", {"__chain": ("sum", starts.cast("long"))}, block=block)
    grouped = chained.groupBy(*keys, "__chain").agg(
        F.sum(F.col("__p") * F.col("__n")).alias("s"), F.sum("__n").alias("n"))
    return grouped.select(
        *keys, F.col("__chain").alias("cluster"), F.bround(F.col("s") / F.col("n"), 0).cast("long").alias("position"),
        F.col("n").alias("members"))


def stack_tables(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Append a document's tables: rows shifted below the earlier tables, width the widest.

    tables: (doc_id, table_no, rows, cols); cells: (doc_id, table_no, row, ...).
    """
    shifted = running(
        tables, ["doc_id"], "table_no", {"offset": ("sum", F.col("rows").cast("long"))}, inclusive=False)
    width = tables.groupBy("doc_id").agg(F.max("cols").alias("width"))
    placed = shifted.join(width, "doc_id").select("doc_id", "table_no", "offset", "width")
    return cells.join(placed, ["doc_id", "table_no"]).withColumn(
        "stacked_row", F.col("row") + F.col("offset")).drop("offset")


def header_fill(columns: DataFrame, keys: list[str], position: str, name: str, default: str = vocab.DEFAULT_GROUP) -> DataFrame:
    """Empty group name: nearest to the left, else nearest to the right, else the default."""
    value = F.nullif(strip(name), F.lit(""))
    backward = columns.withColumn("__neg", -F.col(position))
    left = running(backward, keys, position, {"__left": ("last", value)})
    both = running(left, keys, "__neg", {"__right": ("last", value)})
    return both.withColumn(name, F.coalesce(value, "__left", "__right", F.lit(default))).select(*columns.columns)
