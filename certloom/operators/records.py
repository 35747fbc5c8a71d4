"""Record maps: cleaning, overlay, text templates, changes and report rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom import vocab
from certloom.functions import dates
from certloom.functions import text as tx
from certloom.functions.text import let, squeeze, strip, text
from certloom.operators.extract import _first
from certloom.operators.ordered import first_per_key, row_numbers


def prune_fields(fields: Column) -> Column:
    """Only keys with a name and a value."""
    return F.map_filter(fields, lambda k, v: (strip(k) != "") & (strip(v) != ""))


def prune_recognized(fields: Column, recognized: Column) -> Column:
    """Recognised values that differ from the kept ones."""
    return F.map_filter(prune_fields(recognized), lambda k, v: ~F.coalesce(
        F.try_element_at(fields, k) == v, F.lit(False)))


def positive(c: Column) -> Column:
    return F.when(c.cast("int") > 0, c.cast("int"))


def prune_selection(selected: Column, queue_ids: Column) -> Column:
    """Selected ids that exist, once each."""
    return F.array_intersect(F.filter(F.transform(selected, strip), lambda x: x != ""), queue_ids)


def overlay_fields(*maps: Column) -> Column:
    """Maps laid over each other; the right one wins."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_zip_with(out, m, lambda k, a, b: F.coalesce(b, a))
    return out


def supplemental_pairs(source: Column) -> Column:
    """array<struct(key, value)> of 'key: value' lines whose key is no standard field."""
    pattern = r"^([^:：]{1,80})[:：]\s*(.+)$"

    def pair(x: Column) -> Column:
        key, value = strip(F.regexp_extract(x, pattern, 1)), strip(F.regexp_extract(x, pattern, 2))
        token = F.regexp_replace(F.lower(tx.compact(key)), r"[^a-z0-9一-鿿]", "")
        keep = x.rlike(pattern) & (token != "") & (value != "") & ~tx.one_of(token, vocab.SUPPLEMENT_HIDDEN_KEYS)
        return F.when(keep, F.struct(token.alias("token"), key.alias("key"), value.alias("value")))

    def distinct(found: Column) -> Column:
        kept = F.filter(found, lambda e, i: ~F.exists(
            F.slice(found, F.lit(1), i), lambda o: (o["token"] == e["token"]) & (o["value"] == e["value"])))
        return F.transform(kept, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))

    return let(F.array_compact(F.transform(tx.raw_lines(source), pair)), distinct)


# --- text templates ---------------------------------------------------------


def placeholder_value(context: Column, payload: Column, keys: list[str], default: str = "") -> Column:
    """First value of a key and its fallbacks; the context goes before the payload."""
    found = [
        F.nullif(squeeze(F.try_element_at(m, F.lit(k))), F.lit("")) for k in keys for m in (context, payload)]
    return F.coalesce(*found, F.lit(default))


def fill_markers(template: Column, values: dict[str, Column]) -> Column:
    """Every marker replaced by its value, in declared order."""
    for marker, value in values.items():
        if marker.strip():
            template = F.replace(template, F.lit(marker), text(value))
    return template


def fill_braces(template: Column, values: Column) -> Column:
    """'{{ key }}' replaced from a map in one pass; unknown ones are removed."""
    pattern = r"\{\{\s*([A-Za-z0-9_#-]+)\s*\}\}"
    parts = F.split(text(template), pattern)
    keys = F.regexp_extract_all(text(template), F.lit(pattern), F.lit(1))
    filled = F.zip_with(parts, keys, lambda p, k: F.concat(
        F.coalesce(p, F.lit("")), F.coalesce(F.try_element_at(values, F.coalesce(k, F.lit(""))), F.lit(""))))
    return F.regexp_replace(F.array_join(filled, ""), r"\{\{[^{}]{1,120}\}\}", "")


def render_text_batch(records: DataFrame, templates: DataFrame, values: str = "values") -> DataFrame:
    """One output text per record with a known template; the others get an error.

    records: (row_number, row_name, template_name, values map); templates:
    (template_name, body). Output name: 'NNNN_rowname__template'.
    """
    joined = records.join(templates, "template_name", "left")
    number = F.col("row_number").cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    name = F.concat(padded, F.lit("_"), "row_name", F.lit("__"), "template_name")
    known = F.col("body").isNotNull()
    return joined.select(
        *records.columns, F.when(known, name).alias("output_name"), F.when(known, fill_braces(F.col("body"), F.col(values))).alias("output"),
        F.when(~known, F.concat(F.lit("第 "), "row_number", F.lit(" 行模板不存在"))).alias("error"))


def default_value(c: Column, ref_date: date, mixed: Column | bool = False) -> Column:
    return dates.default_today(c, ref_date, mixed)


# --- labels and targets -----------------------------------------------------


def infer_category(file_name: Column, device_name: Column, source_code: Column) -> Column:
    extension = F.lower(F.regexp_extract(text(file_name), r"\.([^.]+)$", 1))
    return (
        F.when(extension.isin("xlsx", "xls"), "Excel批量")
        .when(strip(device_name) != "", strip(device_name))
        .when(text(source_code) != "", F.concat(F.lit("代号:"), F.upper(text(source_code)))).otherwise("未分类"))


def profile_label(label: Column, profile: Column) -> Column:
    """A stated label, else the label of the profile, else the profile itself."""
    known = F.try_element_at(tx.literal_map(vocab.SOURCE_PROFILE_LABELS), strip(profile))
    return F.coalesce(F.nullif(strip(label), F.lit("")), known, strip(profile))


def reprocess_targets(items: DataFrame) -> DataFrame:
    """One target per kind and source of the items not yet done.

    items: (id, status, file_id, source_file, is_excel, is_record). The first
    item of a group stands for it.
    """
    kind = F.when(F.col("is_record") & F.col("is_excel"), "excel-record").when(F.col("is_record"), "record").otherwise("single")
    group = F.when(kind == "single", F.col("id").cast("string")).otherwise(F.coalesce(
        F.nullif(strip("file_id"), F.lit("")), F.concat_ws("::", F.lit("file"), "source_file")))
    open_items = items.where(~F.col("status").isin("generated", "confirmed"))
    return first_per_key(open_items.withColumns({"kind": kind, "group_key": group}), ["kind", "group_key"], F.col("id"), ["id"])


def document_row(name: Column, values: dict[str, Column]) -> list[Column]:
    """Coverage and marker columns of a document library row."""
    filled = sum(((squeeze(v) != "").cast("int") for v in values.values()), F.lit(0))
    code = F.concat(F.lit("r-"), tx.first_group(F.lower(text(name)), r"(?:r[-_ ]?)?(\d{3}(?:\.\d+)?[a-z])"))
    return [filled.alias("coverage"), code.alias("template_code")]


def core_markers(source: Column) -> dict[str, Column]:
    """Flags per basic field whether the text holds one of its markers."""
    flat = squeeze(source)
    return {k: tx.any_of(flat, words) for k, words in vocab.BASIC_FIELD_MARKS.items()}


def document_index(parts: list[DataFrame]) -> DataFrame:
    """Documents of several folders once each, with values, coverage, markers and code.

    parts: (path, source_dir, text, basic fields); an earlier folder wins.
    """
    stacked = None
    for n, part in enumerate(parts):
        rows = part.select(F.lit(n).alias("part"), "path", "source_dir", "text", *vocab.BASIC_FIELDS)
        stacked = rows if stacked is None else stacked.unionByName(rows)
    once = first_per_key(stacked, ["path"], F.col("part"), ["source_dir", "text", *vocab.BASIC_FIELDS])
    name = F.element_at(F.split("path", "/"), -1)
    marks = core_markers(F.col("text"))
    core = marks["device_name"] & marks["device_model"] & marks["device_code"]
    return once.select(
        name.alias("name"), "path", "source_dir", F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1).alias("suffix"),
        *[squeeze(f).alias(f) for f in vocab.BASIC_FIELDS], *document_row(name, {f: F.col(f) for f in vocab.BASIC_FIELDS}),
        core.alias("has_core_markers")).orderBy("name", "path")


# --- changes ----------------------------------------------------------------


def update_records(
    base: DataFrame, changes: DataFrame, key: str, order: str, columns: list[str],
    allowed_status: list[str] = vocab.TASK_STATUSES, status: str = "status",
) -> DataFrame:
    """The table after a batch of changes; null in a change leaves the value.

    Per column the last given value wins. Statuses outside the allowed set
    are ignored. New keys are inserted.
    """
    given = changes
    if status in columns:
        given = given.withColumn(status, F.when(F.col(status).isin(allowed_status), F.col(status)))
    last = given.groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in columns])
    joined = base.join(last, key, "full")
    return joined.select(*[
        F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def active_records(records: DataFrame, archived: str = "archived") -> DataFrame:
    return records.where(~F.coalesce(F.col(archived), F.lit(False)))


def bulk_set(records: DataFrame, selected: Column, values: dict[str, str | None]) -> DataFrame:
    """The same values written to every selected record; null clears."""
    return records.withColumns({
        c: F.when(selected, F.lit(v).cast("string")).otherwise(F.col(c)) for c, v in values.items()})


def bulk_set_map(records: DataFrame, selected: Column, fields: str, key: str, value: str) -> DataFrame:
    new = overlay_fields(F.col(fields), F.create_map(F.lit(key), F.lit(value)))
    return records.withColumn(fields, F.when(selected, new).otherwise(F.col(fields)))


# --- report appendix --------------------------------------------------------

SERIAL_KEYS = ["factory_serial_no", "serial_no", "device_code", "col_05"]
MAKER_KEYS = ["manufacturer_code", "maker_code", "manufacturer", "col_04"]
NEXT_KEYS = ["next_inspection_date", "next_check_date", "col_33"]


def appendix_rows(records: DataFrame, task: str, row_number: str, fields: str = "fields") -> DataFrame:
    """Serial, maker code and next ISO date per record in row order, empty rows dropped.

    Rows stay rows: line_no counts per task in blocks, so a task with most of
    the records is spread over tasks of the cluster.
    """
    def pick(keys: list[str]) -> Column:
        found = [F.nullif(strip(F.try_element_at(F.col(fields), F.lit(k))), F.lit("")) for k in keys]
        return F.coalesce(*found)

    rows = records.select(task, row_number, F.struct(
        pick(SERIAL_KEYS).alias("serial"), pick(MAKER_KEYS).alias("maker"),
        dates.iso_date(pick(NEXT_KEYS)).alias("next_date")).alias("r"))
    # the three values are worked out once, ahead of the filter and both passes of the numbering
    rows = rows.select(task, row_number, F.explode(F.array("r")).alias("r")).select(task, row_number, "r.*")
    filled = rows.where(F.coalesce("serial", "maker", "next_date").isNotNull())
    line = F.concat_ws("\t", *[text(c) for c in ("serial", "maker", "next_date")])
    return row_numbers(filled, [task], row_number, "line_no").withColumn("line", line)


def appendix_counts(records: DataFrame, appendix: DataFrame, existing: DataFrame, task: str) -> DataFrame:
    """Per task: selected records, appendix lines, and whether an existing text is replaced.

    existing: (task, appendix_text); it is kept unless it is empty or several
    records are selected and its line count differs.
    """
    selected = records.groupBy(task).agg(F.count("*").alias("cylinder_total_count"))
    lines = appendix.groupBy(task).agg(F.count("*").alias("lines"))
    stated = existing.select(task, F.size(tx.raw_lines("appendix_text")).alias("stated"))
    joined = selected.join(lines, task, "left").join(stated, task, "left")
    now, old = F.coalesce("lines", F.lit(0)), F.coalesce("stated", F.lit(0))
    replace = (now > 0) & ((old == 0) | ((F.col("cylinder_total_count") > 1) & (old != now)))
    return joined.select(task, "cylinder_total_count", now.alias("lines"), replace.alias("replace_text"))
