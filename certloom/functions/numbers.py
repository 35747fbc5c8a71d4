"""Numbers in texts and the metrics computed from number lists."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from certloom import vocab
from certloom.functions import dates
from certloom.functions.text import first_group, let, strip, text

_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def to_double(c: Column | str) -> Column:
    """Plain decimal number or null (no nan, inf or underscores)."""
    return let(strip(c), lambda x: F.when(x.rlike(_NUMBER), x.try_cast("double")))


def parse_number_list(c: Column | str) -> Column:
    """Numbers of a text separated by blanks, commas or semicolons."""
    parts = F.split(strip(c), r"[\s,，;；]+")
    return F.filter(F.transform(parts, to_double), lambda x: x.isNotNull())


def first_number(c: Column | str) -> Column:
    return first_group(text(c), r"([+-]?\d+(?:\.\d+)?)")


def all_numbers(c: Column | str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"([+-]?\d+(?:\.\d+)?)"), F.lit(1))


def format_number(c: Column, precision: int) -> Column:
    """Fixed precision, trailing zeros cut."""
    out = F.format_string(f"%.{precision}f", c)
    if precision > 0:
        out = F.rtrim(F.rtrim(out, F.lit("0")), F.lit("."))
    return F.when(c.isNotNull(), out)


def format_list(c: Column, precision: int) -> Column:
    return F.array_join(F.transform(c, lambda x: format_number(x, precision)), " ")


def clean_number(c: Column | str) -> Column:
    """Misread digits repaired, other characters cut; several dots: first number."""
    out = F.regexp_replace(F.translate(strip(c), "oOlI，。", "0011.."), r"[^\d.+\-]", "")
    several = F.length(out) - F.length(F.replace(out, F.lit("."), F.lit(""))) > 1
    out = F.when(several, F.coalesce(first_number(out), out)).otherwise(out)
    return F.nullif(F.btrim(out, F.lit(".")), F.lit(""))


# --- list metrics -----------------------------------------------------------


def list_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def list_mean(c: Column) -> Column:
    """Mean of a number array; null for an empty one."""
    return F.when(F.size(c) > 0, list_sum(c) / F.size(c))


def list_stddev(c: Column) -> Column:
    """Population standard deviation; 0 for one value, null for none."""
    spread = let(list_mean(c), lambda m: F.sqrt(list_sum(F.transform(c, lambda x: (x - m) * (x - m))) / F.size(c)))
    return F.when(F.size(c) > 1, spread).when(F.size(c) == 1, F.lit(0.0))


def list_subtract(left: Column, right: Column) -> Column:
    """Element-wise difference up to the shorter length."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: a - b)


def linearity(ux: Column, u2: Column) -> Column:
    """struct(fi, f_avg, delta) of two series; pairs with a zero divisor are skipped."""
    n = F.least(F.size(ux), F.size(u2))
    pairs = F.filter(
        F.arrays_zip(F.slice(ux, F.lit(1), n).alias("a"), F.slice(u2, F.lit(1), n).alias("b")),
        lambda p: F.abs(p["b"]) >= 1e-12)
    fi = F.transform(pairs, lambda p: p["a"] / p["b"])

    def build(f: Column) -> Column:
        def with_mean(m: Column) -> Column:
            delta = F.transform(
                f, lambda x: F.when(F.abs(m) < 1e-12, F.lit(0.0)).otherwise((x - m) / m * 100.0))
            return F.struct(f.alias("fi"), m.alias("f_avg"), delta.alias("delta"))

        return let(list_mean(f), with_mean)

    return let(fi, build)


# --- formula registry -------------------------------------------------------
# A formula reads named fields and returns new values for some of them.

Fields = dict[str, Column]


def _get(fields: Fields, key: str) -> Column:
    return text(fields[key]) if key in fields else F.lit("")


def _if_empty(fields: Fields, key: str, value: Column) -> Column:
    current = strip(_get(fields, key))
    return F.when(current != "", current).otherwise(value)


def _unify(fields: Fields, cfg: dict[str, Any]) -> Fields:
    both = dates.unify_dates(_get(fields, cfg["receive_key"]), _get(fields, cfg["calibration_key"]))
    return {cfg["receive_key"]: both["receive"], cfg["calibration_key"]: both["calibration"]}


def _offset(fields: Fields, cfg: dict[str, Any]) -> Fields:
    source = F.coalesce(
        dates.strip_null(_get(fields, cfg["source_key"])), dates.strip_null(_get(fields, cfg["fallback_key"])))
    current = dates.strip_null(_get(fields, cfg["target_key"]))
    return {cfg["target_key"]: F.coalesce(dates.add_days(source, cfg["days"]), current)}


def _linearity(fields: Fields, cfg: dict[str, Any]) -> Fields:
    parsed = linearity(
        parse_number_list(_get(fields, cfg["ux_key"])), parse_number_list(_get(fields, cfg["u2_key"])))
    out = let(parsed, lambda m: F.when(F.size(m["fi"]) > 0, F.struct(
        format_list(m["fi"], cfg["precision"]).alias("fi"),
        format_number(m["f_avg"], cfg["precision"]).alias("f_avg"),
        format_list(m["delta"], cfg["delta_precision"]).alias("delta"))))
    return {
        cfg["fi_key"]: _if_empty(fields, cfg["fi_key"], out["fi"]),
        cfg["f_avg_key"]: _if_empty(fields, cfg["f_avg_key"], out["f_avg"]),
        cfg["delta_key"]: _if_empty(fields, cfg["delta_key"], out["delta"]),
    }


def _mean(fields: Fields, cfg: dict[str, Any]) -> Fields:
    value = let(parse_number_list(_get(fields, cfg["source_key"])), list_mean)
    return {cfg["target_key"]: _if_empty(fields, cfg["target_key"], format_number(value, cfg["precision"]))}


def _stddev(fields: Fields, cfg: dict[str, Any]) -> Fields:
    value = let(parse_number_list(_get(fields, cfg["source_key"])), list_stddev)
    return {cfg["target_key"]: _if_empty(fields, cfg["target_key"], format_number(value, cfg["precision"]))}


def _subtract(fields: Fields, cfg: dict[str, Any]) -> Fields:
    value = list_subtract(
        parse_number_list(_get(fields, cfg["left_key"])), parse_number_list(_get(fields, cfg["right_key"])))
    out = let(value, lambda v: F.when(F.size(v) > 0, format_list(v, cfg["precision"])))
    return {cfg["target_key"]: _if_empty(fields, cfg["target_key"], out)}


FORMULAS: dict[str, Callable[[Fields, dict[str, Any]], Fields]] = {
    "unify_dates": _unify,
    "date_offset": _offset,
    "linearity_metrics": _linearity,
    "list_mean": _mean,
    "list_stddev": _stddev,
    "list_subtract": _subtract,
}


def register_formula(name: str, builder: Callable[[Fields, dict[str, Any]], Fields]) -> None:
    """Add a formula type of your own."""
    FORMULAS[name] = builder


def formula_steps(template: Column | None = None) -> list[tuple[Column | None, dict[str, Any]]]:
    """The base formulas, then those whose profile pattern matches the template name."""
    steps: list[tuple[Column | None, dict[str, Any]]] = [(None, f) for f in vocab.BASE_FORMULAS]
    if template is not None:
        for pattern, formulas in vocab.FORMULA_PROFILES:
            steps += [(text(template).rlike("(?i)" + pattern), f) for f in formulas]
    return steps
