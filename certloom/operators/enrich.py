"""Completing and checking records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom import vocab
from certloom.functions.text import (
    is_meaningful, let, one_of, optional_blank, placeholder_to_null, strip, text, token,
)
from certloom.operators.lookups import composite, keyed, lookup_join, lookup_many, unique_values
from certloom.operators.ordered import first_per_key
from certloom.session import written

_VALUES = ["device_name", "device_model", "manufacturer"]


def _token_or_null(c: str) -> Column:
    return F.nullif(token(c), F.lit(""))


def _filled(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def unique_entries(records: DataFrame, scope: list[str], kinds: tuple[str, str]) -> DataFrame:
    """(which, key, values) of one source: a row per code and per name and model, not yet combined."""
    tokens = {t: _token_or_null(f"device_{t}") for t in ("code", "name", "model")}
    inside = [F.col(c) for c in scope]
    return keyed(
        records, {kinds[0]: composite(*inside, tokens["code"]), kinds[1]: composite(*inside, tokens["name"], tokens["model"])},
        {v: _filled(v) for v in _VALUES})


def unique_lookup_fill(records: DataFrame, library: DataFrame | None = None, scope: str = "file_id") -> DataFrame:
    """Fill empty name, model and manufacturer where the own file, then the library, is unambiguous.

    Keys come from the record as it was before filling. The own file is asked
    by code and then by name and model before the library is asked.

    The records are written once, with a number, and serve all lookups: one aggregate gives the values that are
    unambiguous per code and per name and model, in a file and in the library, one join brings all that a record asks
    for, one aggregate puts them side by side. Records that lack nothing ask nothing.
    """
    records = written(records.withColumn("__id", F.monotonically_increasing_id()))
    code, name, model = (_token_or_null(c) for c in ("device_code", "device_name", "device_model"))
    empty = {v: _filled(v).isNull() for v in _VALUES}
    by_code = F.when(empty["device_name"] | empty["device_model"] | empty["manufacturer"], code)
    by_name = F.when(empty["manufacturer"], name)
    probes = {"file code": composite(F.col(scope), by_code), "file pair": composite(F.col(scope), by_name, model)}
    sources = unique_entries(records, [scope], ("file code", "file pair"))
    if library is not None:
        probes |= {"library code": by_code, "library pair": composite(by_name, model)}
        sources = sources.unionByName(unique_entries(library, [], ("library code", "library pair")))
    entries = unique_values(sources, ["which", "key"], _VALUES)
    found = {f"__{which}_{v}": F.max(F.when(F.col("which") == which, F.col(v))) for which in probes for v in _VALUES
             if v == "manufacturer" or which.endswith("code")}
    out = lookup_many(records, "__id", keyed(records, probes, {"row": F.col("__id")}), entries, found)
    return out.withColumns({
        v: F.coalesce(_filled(v), *[F.col(f"__{which}_{v}") for which in probes if f"__{which}_{v}" in found]) for v in _VALUES
    }).select(*[c for c in records.columns if c != "__id"])


# --- catalogue --------------------------------------------------------------


def catalog_first(catalog: DataFrame, order: str = "ord") -> DataFrame:
    """First catalogue row per name token, cells cleaned."""
    cleaned = catalog.select(
        F.nullif(token("name"), F.lit("")).alias("token"), F.col(order),
        *[placeholder_to_null(k).alias(k) for k in vocab.CATALOG_KEYS])
    return first_per_key(cleaned.where(F.col("token").isNotNull()), ["token"], F.col(order), vocab.CATALOG_KEYS)


def catalog_merge(records: DataFrame, catalog: DataFrame, row_id: str = "row_id", order: str = "ord") -> DataFrame:
    """Catalogue values over the record's own, matched on the name token; unmatched rows stay."""
    joined = lookup_join(
        records, catalog_first(catalog, order), {"token": F.nullif(token("name"), F.lit(""))},
        {k: f"__cat_{k}" for k in vocab.CATALOG_KEYS}, F.col(row_id))
    merged = {
        k: F.coalesce(F.col(f"__cat_{k}"), placeholder_to_null(k)) for k in vocab.CATALOG_KEYS if k in records.columns}
    return joined.withColumns(merged).select(*records.columns)


def catalog_semi_filter(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose name is in the catalogue; everything while the catalogue is empty."""
    tokens = catalog.select(F.nullif(token(placeholder_to_null("name")), F.lit("")).alias("__token")).where(
        F.col("__token").isNotNull()).distinct()
    known = records.withColumn("__own", token("name")).join(
        tokens.withColumn("__listed", F.lit(True)), F.col("__own") == F.col("__token"), "left")
    return known.where(F.col("__listed") | ~tokens.exists()).select(*records.columns)


def is_catalog_header(row: dict[str, Column]) -> Column:
    """Heading texts inside a catalogue: exact, or contained with at most one other cell."""
    name = token(row["name"])
    others = sum((placeholder_to_null(row[k]).isNotNull().cast("int") for k in vocab.CATALOG_KEYS[1:]), F.lit(0))
    contained = name.rlike("|".join(vocab.CATALOG_HEADER_TOKENS))
    return one_of(name, vocab.CATALOG_HEADER_TOKENS) | (contained & (others <= 1))


def union_candidates(parts: list[DataFrame], order: str = "ord", limit: int | None = None) -> DataFrame:
    """Candidate rows of several sources, the first per name token, headings dropped.

    Each part carries ``ord``; an earlier part wins over a later one.
    """
    stacked = None
    for n, part in enumerate(parts):
        columns = [
            (F.col(k) if k in part.columns else F.lit(None).cast("string")).alias(k) for k in vocab.CATALOG_KEYS]
        rows = part.select(F.struct(F.lit(n).alias("part"), F.col(order).alias("ord")).alias("__ord"), *columns)
        stacked = rows if stacked is None else stacked.unionByName(rows)
    cleaned = stacked.select("__ord", *[placeholder_to_null(k).alias(k) for k in vocab.CATALOG_KEYS])
    keep = (
        (token("name") != "") & ~one_of(token("name"), vocab.CATALOG_NAME_TOKENS)
        & ~one_of(text("name"), vocab.CATALOG_STOP_NAMES)
        & ~is_catalog_header({k: F.col(k) for k in vocab.CATALOG_KEYS}))
    keyed = cleaned.where(keep).withColumn("token", token("name"))
    first = first_per_key(keyed, ["token"], F.col("__ord"), ["__ord", *vocab.CATALOG_KEYS])
    if limit is not None:
        first = first.orderBy("__ord").limit(limit)
    return first.select(
        F.col("__ord.part").alias("part"), F.col("__ord.ord").alias("ord"), *vocab.CATALOG_KEYS)


def merge_choices(rules: DataFrame, library: DataFrame) -> DataFrame:
    """Choices of each field followed by the library's for the same label.

    rules: (key, label, pos, choice); library: (label, pos, choice). The first
    spelling of a choice (case-insensitive) stays. Result: (key, pos, choice).
    """

    def label(c: str) -> Column:
        return F.lower(F.regexp_replace(strip(c), r"\s+", " "))

    fields = rules.select("key", label("label").alias("__label")).distinct()
    own = rules.select("key", F.struct(F.lit(0).alias("src"), F.col("pos")).alias("__ord"), strip("choice").alias("choice"))
    extra = fields.join(
        library.select(label("label").alias("__label"), "pos", strip("choice").alias("choice")), "__label")
    extra = extra.select("key", F.struct(F.lit(1).alias("src"), F.col("pos")).alias("__ord"), "choice")
    both = own.unionByName(extra).where(F.col("choice") != "").withColumn("__low", F.lower("choice"))
    first = first_per_key(both, ["key", "__low"], F.col("__ord"), ["__ord", "choice"])
    return first.select("key", F.col("__ord.src").alias("src"), F.col("__ord.pos").alias("pos"), "choice")


# --- checks -----------------------------------------------------------------


def record_issues(
    template: Column, name: Column, model: Column, code: Column, manufacturer: Column, groups: Column | None = None,
) -> Column:
    """Reasons why a record is not complete enough for a report."""
    count = F.coalesce(groups.try_cast("int"), F.lit(0)) if groups is not None else F.lit(0)
    return F.array_compact(F.array(
        F.when(strip(template) == "", "模板"),
        F.when(~is_meaningful(name), "气瓶名称"),
        F.when(~(is_meaningful(model) | is_meaningful(code)), "型号规格或气瓶编号"),
        F.when(~is_meaningful(manufacturer), "生产厂商"),
        F.when(count > 1, F.concat(F.lit("来源文件包含"), count.cast("string"), F.lit("组气瓶信息（需拆分后再生成）"))),
    ))


def validate_records(records: DataFrame, template: str = "template_name", groups: str | None = None) -> DataFrame:
    """Add issues, ok and summary."""
    issues = record_issues(
        F.col(template), F.col("device_name"), F.col("device_model"), F.col("device_code"), F.col("manufacturer"),
        F.col(groups) if groups else None)
    return records.withColumn("issues", issues).withColumns({
        "ok": F.size("issues") == 0, "summary": F.array_join("issues", "、")})


def template_rule(template: Column) -> Column:
    """Id of the first generation rule whose pattern fits the template name."""
    out = F
    for rule, pattern, _ in vocab.TEMPLATE_RULES:
        out = out.when(text(template).rlike("(?i)" + pattern), rule)
    return out


def missing_required(
    template: Column, values: dict[str, Column], required: dict[str, list[str]] = vocab.TEMPLATE_REQUIRED_FIELDS,
) -> Column:
    """Required keys of the template's rule that hold no meaningful value."""
    rule = template_rule(template)
    missing = [
        F.when((rule == name) & ~is_meaningful(values.get(key, F.lit(None))), key)
        for name, keys in required.items() for key in keys]
    if not missing:
        return F.array().cast("array<string>")
    return F.when(strip(template) != "", F.array_compact(F.array(*missing))).otherwise(
        F.array().cast("array<string>"))


def count_measurement_items(count: Column, items: Column) -> Column:
    """A stated positive count, else the number of non-empty lines."""
    stated = F.regexp_extract(strip(count), r"^([+-]?\d+)", 1).try_cast("int")
    lines = F.size(F.filter(F.split(text(items), "\n"), lambda x: strip(x) != ""))
    return F.when(stated > 0, stated).otherwise(lines)


def batch_summary(records: DataFrame, error: str = "error", generated: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Total, valid, skipped (and generated) counts, of all records or per key."""
    bad = F.col(error).isNotNull() & (F.col(error) != "")
    counts = [
        F.count("*").alias("total_rows"), F.count_if(~bad).alias("valid_rows"), F.count_if(bad).alias("skipped_rows")]
    if generated:
        counts.append(F.count_if(F.col(generated)).alias("generated_rows"))
    return records.groupBy(*by or []).agg(*counts)


def first_errors(records: DataFrame, order: list[str], error: str = "error", limit: int = 200) -> DataFrame:
    """The first error rows in order."""
    return records.where(F.col(error) != "").orderBy(*order).limit(limit).select(*order, error)
