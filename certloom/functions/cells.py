"""Recognised table cells: per-column repair, noise, choices, typing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from certloom import vocab
from certloom.functions import dates, numbers
from certloom.functions.text import compact, fold_width, let, literal_map, one_of, strip, text


def cell_text(c: Column | str) -> Column:
    return compact(c)


def _map(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(pairs), key)


def _whole(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})$")


def _scored(value: Column | str, score: Column | float) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    score = score if isinstance(score, Column) else F.lit(score)
    return F.struct(value.alias("text"), score.cast("double").alias("score"))


# --- per-column repair: cell text -> struct(text, score) ---------------------


def _date(t: Column) -> Column:
    fixed = F.regexp_replace(F.translate(t, "-:lI", "..11"), "^[zZ]", "2")
    month = F.regexp_extract(fixed, r"^(\d{1,2})\.(\d{1,2})$", 1).try_cast("int")
    day = F.regexp_extract(fixed, r"^(\d{1,2})\.(\d{1,2})$", 2).try_cast("int")
    good = month.between(1, 12) & day.between(1, 31)
    value = F.concat(month.cast("string"), F.lit("."), day.cast("string"))
    return F.when(month.isNotNull(), F.when(good, _scored(value, 1.0)).otherwise(_scored("", 0.2))).otherwise(
        _scored(fixed, 0.82))


def _owner(t: Column) -> Column:
    score = (
        F.when(_whole(t, r"[一-鿿]"), 0.35).when(_whole(t, r"[A-Za-z0-9\-]{2,16}"), 0.95)
        .when(_whole(t, r"[一-鿿A-Za-z0-9\-]{2,8}"), 0.78).when(_whole(t, r"[A-Za-z0-9\-]"), 0.35)
        .otherwise(0.52))
    return _scored(t, score)


def medium_name(t: Column) -> Column:
    """Known filling medium of a cell (common misreads repaired), else the upper-case text."""
    upper = F.upper(F.replace(t, F.lit(" "), F.lit("")))
    return F.coalesce(_map(vocab.MEDIUM_MISREADS, upper), upper)


def medium_line_name(c: Column | str) -> Column:
    """Like medium_name for tokens of a text line; unknown tokens stay as they are."""
    value = strip(c)
    return F.coalesce(_map(vocab.MEDIUM_LINE_MISREADS, F.upper(value)), value)


def _medium(t: Column) -> Column:
    return let(medium_name(t), lambda m: F.when(one_of(m, vocab.MEDIUM_NAMES), _scored(m, 1.0)).otherwise(
        _scored("", 0.2)))


def _unit(t: Column) -> Column:
    def rule(x: Column) -> Column:
        return (
            F.when(one_of(x, vocab.UNIT_CODES), _scored(x, 1.0))
            .when(_whole(x, "[A-Z0-9]{1,4}"), _scored(x, 0.95)).otherwise(_scored(F.substring(x, 1, 4), 0.75)))

    return let(F.regexp_replace(F.upper(t), "[^A-Z0-9]", ""), rule)


def _serial(t: Column) -> Column:
    fixed = F.regexp_replace(F.translate(F.upper(t), "ILO", "110"), "[^A-Z0-9]", "")
    return let(fixed, lambda x: _scored(x, F.when(_whole(x, "[A-Z0-9]{5,}"), 0.95).otherwise(0.75)))


def _pressure_text(t: Column) -> Column:
    fixed = F.regexp_replace(F.translate(t, ":;zZsSoO", "..225500"), "[^0-9.]", "")
    head = F.regexp_extract(fixed, r"^([^.]*\.?)(.*)$", 1)
    tail = F.replace(F.regexp_extract(fixed, r"^([^.]*\.?)(.*)$", 2), F.lit("."), F.lit(""))
    one_dot = F.concat(head, tail)
    return F.when(_whole(one_dot, r"\d{3}"), F.regexp_replace(one_dot, r"^(\d\d)(\d)$", "$1.$2")).otherwise(one_dot)


def _one_decimal(x: Column, value: Column) -> Column:
    decimal = x.contains(".") | (value != F.round(value))
    return F.when(decimal, F.format_string("%.1f", value)).otherwise(value.cast("long").cast("string"))


def _pressure(low: float, high: float, sure: list[str], range_score: float, drop_above: float | None) -> Callable:
    def rule(t: Column) -> Column:
        def test(x: Column) -> Column:
            value = numbers.to_double(x)
            out = F.when(_whole(x, r"\d{1,2}\.\d"), _scored(x, F.when(one_of(x, sure), 1.0).otherwise(0.95)))
            out = out.when(value.between(low, high), _scored(_one_decimal(x, value), range_score))
            if drop_above is not None:
                out = out.when(value > drop_above, _scored("", 0.2))
            return out.otherwise(_scored(x, 0.8))

        return let(_pressure_text(t), test)

    return rule


def _shaped(pattern: str, old: str, new: str, sure: str | None = None) -> Callable:
    def rule(t: Column) -> Column:
        fixed = F.translate(t, old, new) if new else F.regexp_replace(t, old, "")

        def test(x: Column) -> Column:
            score = F.when(_whole(x, pattern), F.when(x == (sure or ""), 1.0).otherwise(0.95)).otherwise(0.8)
            return _scored(x, score)

        return let(fixed, test)

    return rule


_COLUMN_RULES: dict[int, Callable[[Column], Column]] = {0: _date, 1: _owner, 2: _medium, 3: _unit, 4: _serial}
_COLUMN_RULES.update({n: _pressure(8.0, 35.0, ["22.5", "15.0"], 0.88, None) for n in (5, 21, 29)})
_COLUMN_RULES[6] = _pressure(5.0, 30.0, ["15.0"], 0.86, 35.0)
_COLUMN_RULES.update({n: _shaped(r"\d{1,2}\.\d|\d{1,3}", ":", ".") for n in (7, 8, 17, 19)})
_COLUMN_RULES.update({n: _shaped(r"\d(?:\.\d{1,2})?", ":", ".") for n in (18, 20, 25)})
_COLUMN_RULES.update({n: _shaped(r"\d+", r"[^\d]", "", "2") for n in (22, 30)})
_COLUMN_RULES[33] = _shaped(r"\d{1,2}\.\d", "-:", "..")


def column_rule(raw: Column | str, col_index: Column | int) -> Column:
    """Repaired cell text and rule score for a zero-based column number."""

    def choose(t: Column) -> Column:
        if isinstance(col_index, int):
            rule = _COLUMN_RULES.get(col_index)
            chosen = rule(t) if rule else _scored(t, 0.9)
        else:
            groups: dict[Callable, list[int]] = {}
            for n, rule in _COLUMN_RULES.items():
                groups.setdefault(rule, []).append(n)
            chosen = F.when(F.lit(False), _scored(t, 0.9))
            for rule, members in groups.items():
                chosen = chosen.when(col_index.isin(members), rule(t))
            chosen = chosen.otherwise(_scored(t, 0.9))
        return F.when(t == "", _scored("", 0.6)).otherwise(chosen)

    return let(cell_text(raw), choose)


def vote_score(confidence: Column, rule_score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), confidence * rule_score))


def is_critical(col_index: Column) -> Column:
    return col_index.isin(vocab.CRITICAL_COLUMNS)


def suppress_noise(
    final: Column, confidence: Column, col_index: Column, relaxed: bool = False,
    trigger: float = vocab.SECOND_PASS_TRIGGER,
) -> Column:
    """True where a recognised text should be blanked."""
    t = cell_text(final)
    owner = (
        _whole(t, "[A-Za-z0-9]|[A-Za-z]{1,2}") | (_whole(t, "[A-Za-z0-9]{2,3}") & (confidence < 0.82))
        | _whole(t, r"[一-鿿]"))
    forced = ((col_index == 1) & owner) | ((col_index == 2) & ~one_of(medium_name(t), vocab.MEDIUM_NAMES))
    noise = (t != "√") & (confidence <= vocab.NOISE_CONFIDENCE) & _whole(
        t, r"[A-Za-z]{1,4}|[A-Za-z][A-Za-z0-9]{0,3}|[一-鿿]|[`'\".,;:|]{1,4}")
    floor = max(0.42, trigger - 0.18) if relaxed else trigger
    weak = confidence < min(floor, trigger)
    return (t != "") & (forced | F.when(is_critical(col_index), weak).otherwise(noise))


def review_reasons(final: Column, confidence: Column, col_index: Column) -> Column:
    """Reasons why a cell needs a human look."""
    limit = F.when(is_critical(col_index), vocab.REVIEW_THRESHOLD_CRITICAL).otherwise(vocab.REVIEW_THRESHOLD)
    return F.array_compact(F.array(
        F.when(confidence < limit, "low_confidence"),
        F.when((strip(final) == "") & is_critical(col_index), "empty_critical")))


def row_inconsistencies(fields: Callable[[str], Column]) -> Column:
    """array<struct(column_key, reason)> of contradictions inside one table row."""
    volume, volume_now = numbers.to_double(fields("col_09")), numbers.to_double(fields("col_20"))
    weight, weight_now = numbers.to_double(fields("col_08")), numbers.to_double(fields("col_18"))
    loss = numbers.to_double(fields("col_19"))

    def item(test: Column, key: str, reason: str) -> Column:
        return F.when(test, F.struct(F.lit(key).alias("column_key"), F.lit(reason).alias("reason")))

    return F.array_compact(F.array(
        item(F.abs(volume_now - volume) > 3.0, "col_20", "volume_deviation"),
        item((F.abs(weight - weight_now) < 0.05) & (F.abs(loss) > 0.2), "col_19", "weight_loss_inconsistent"),
        item((strip(fields("col_29")) != "") & (strip(fields("col_33")) == ""), "col_33", "conclusion_missing")))


# --- flags and choices ------------------------------------------------------


def check_flag(c: Column | str, boxes: bool = False) -> Column:
    """True for '1', 'true', V or a tick mark; with boxes also for a ticked box."""
    value = strip(c)
    return one_of(value, ["true", "1", "V", "v"]) | value.rlike("[√✓☑]" if boxes else "[√✓]")


def is_boolean_text(c: Column | str) -> Column:
    return one_of(F.lower(strip(c)), ["true", "false"])


def _words(words: list[str]) -> str:
    quoted = ["".join("\\" + ch if ch in r".*+?^${}()|[]\\" else ch for ch in w.strip()) for w in words if w.strip()]
    return "(?:" + "|".join(quoted) + ")"


def exclusive_choice(line: Column | str, choices: list[tuple[str, list[str]]]) -> Column:
    """struct(value, warning) of a cell with choices of which one is ticked.

    Exactly one ticked choice wins; several are a conflict. Of two choices an
    open box leaves the other. Then a single mentioned choice, then the usual
    misreads of the two valve words.
    """

    def decide(x: Column) -> Column:
        hit = [x.rlike(_words(w)) for _, w in choices]
        ticked = [x.rlike(f"(?i)[☑√✓Vv]\\s*{_words(w)}") for _, w in choices]
        opened = [x.rlike(f"(?i)[□口☐◻]\\s*{_words(w)}") for _, w in choices]

        def count(flags: list[Column]) -> Column:
            return sum((f.cast("int") for f in flags), F.lit(0))

        def only(flags: list[Column]) -> Column:
            return F.coalesce(*[F.when(f, name) for f, (name, _) in zip(flags, choices)], F.lit(""))

        def out(value: Column | str, warning: str = "") -> Column:
            value = F.lit(value) if isinstance(value, str) else value
            return F.struct(value.alias("value"), F.lit(warning).alias("warning"))

        conflict = out("", vocab.VALVE_CONFLICT)
        rule = F.when(count(ticked) == 1, out(only(ticked))).when(count(ticked) > 1, conflict)
        if len(choices) == 2:
            other = F.when(opened[0] & hit[1], choices[1][0]).when(opened[1] & hit[0], choices[0][0])
            rule = rule.when((count(opened) == 1) & other.isNotNull(), out(other))
        rule = rule.when(count(hit) == 1, out(only(hit))).when(count(hit) > 1, conflict)
        check, swap = x.rlike(f"(?i){vocab.VALVE_CHECK_WORDS}"), x.rlike(f"(?i){vocab.VALVE_SWAP_WORDS}")
        return (
            rule.when(check & swap, conflict).when(check, out("校阀")).when(swap, out("换阀")).otherwise(out("")))

    return let(strip(line), decide)


def valve_conflict(c: Column | str) -> Column:
    """Both valve words, and the marks do not tell which one is meant."""
    x = strip(c)
    check, swap = f"(?:{vocab.VALVE_CHECK_WORDS})", f"(?:{vocab.VALVE_SWAP_WORDS})"

    def marked(mark: str, words: str) -> Column:
        return x.rlike(f"(?i)[{mark}]\\s*{words}")

    clear = (marked("☑√✓Vv", check) != marked("☑√✓Vv", swap)) | (marked("□口☐◻", check) != marked("□口☐◻", swap))
    return x.rlike(f"(?i){check}") & x.rlike(f"(?i){swap}") & ~clear


# --- declared rules ---------------------------------------------------------


@dataclass(frozen=True)
class FieldRule:
    """Declared handling of one schema column."""

    type: str = "text"
    std_type: str = ""
    max_len: int | None = None
    pattern: str = ""
    empty_strategy: str = ""
    required: bool = False
    allow_empty: bool | None = None
    expected_pattern: str = ""
    forbidden_pattern: str = ""
    fold_width: bool = False
    o_to_0: bool = False
    l_to_1: bool = False
    choices: list[tuple[str, list[str]]] = field(default_factory=list)

    @property
    def empty_ok(self) -> bool:
        if self.allow_empty is not None:
            return self.allow_empty
        return not self.required or self.type == "optional_blank"


def _rule_number(value: Column, rule: FieldRule, label: str) -> Column:
    return F.btrim(F.regexp_replace(F.translate(value, "oOlI，。", "0011.."), r"[^\d.+\-]", ""), F.lit("."))


def _rule_year_month(value: Column) -> Column:
    return F.coalesce(dates.year_month(value)["value"], value)


def _rule_text(value: Column, rule: FieldRule, label: str) -> Column:
    out = fold_width(value) if rule.fold_width else value
    if rule.o_to_0:
        out = F.translate(out, "oO", "00")
    if rule.l_to_1:
        out = F.translate(out, "lI", "11")
    return strip(out)


FIELD_RULE_TYPES: dict[str, Callable[[Column, FieldRule, str], Column]] = {
    "number": _rule_number,
    "date": lambda v, r, l: F.coalesce(dates.month_day(v), F.lit("")),
    "date_or_dash": lambda v, r, l: F.coalesce(dates.month_day(v), F.lit("")),
    "checkbox_choice": lambda v, r, l: v,
    "check": lambda v, r, l: F.when(check_flag(v), "true").otherwise(""),
    "text": _rule_text,
    "code": _rule_text,
    "loose_text": _rule_text,
    "optional_blank": _rule_text,
    "signature": _rule_text,
}


def register_field_rule(name: str, builder: Callable[[Column, FieldRule, str], Column]) -> None:
    """Add a rule type of your own."""
    FIELD_RULE_TYPES[name] = builder


def apply_field_rule(c: Column | str, rule: FieldRule, label: str = "") -> Column:
    """Normalised text of a raw field value."""

    def run(v: Column) -> Column:
        if rule.type != "number" and label == "制造年月":
            out = _rule_year_month(v)
        else:
            out = FIELD_RULE_TYPES.get(rule.type, _rule_text)(v, rule, label)
        return F.when(v == "", F.lit("")).otherwise(out)

    return let(strip(c), run)


_TYPED = (
    "struct<type:string,raw:string,display:string,num:double,iso:string,flag:boolean,value:string,"
    "warnings:array<string>>")


def typed_value(c: Column | str, rule: FieldRule, ref_year: int, label: str = "") -> Column:
    """Tagged value of a normalised field; null when empty or not of the type."""

    def tagged(kind: str, v: Column, **parts: Column) -> Column:
        null = F.lit(None)
        return F.struct(
            F.lit(kind).alias("type"), v.alias("raw"), parts.get("display", v).alias("display"),
            parts.get("num", null.cast("double")).alias("num"), parts.get("iso", null.cast("string")).alias("iso"),
            parts.get("flag", null.cast("boolean")).alias("flag"),
            parts.get("value", null.cast("string")).alias("value"),
            parts.get("warnings", F.array().cast("array<string>")).alias("warnings")).cast(_TYPED)

    def date_value(v: Column, kind: str) -> Column:
        cn = r"^\s*(\d{2,4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?\s*$"
        plain = r"^\s*(\d{2,4})\s*[.\-/、]\s*(\d{1,2})\s*[.\-/、]\s*(\d{1,2})\s*$"
        short = r"^\s*(\d{1,2})\.(\d{1,2})\s*$"

        def parts(pattern: str, year: Column | None, m: int, d: int) -> tuple[Column, Column, Column]:
            y = F.lpad(F.regexp_extract(v, pattern, 1), 4, "0") if year is None else year
            return y, F.lpad(F.regexp_extract(v, pattern, m), 2, "0"), F.lpad(F.regexp_extract(v, pattern, d), 2, "0")

        def build(y: Column, m: Column, d: Column) -> Column:
            return tagged(
                kind, v, iso=F.concat_ws("-", y, m, d),
                display=F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日")))

        out = F.when(v.rlike(cn), build(*parts(cn, None, 2, 3))).when(v.rlike(plain), build(*parts(plain, None, 2, 3)))
        out = out.when(v.rlike(short), build(*parts(short, F.lit(str(ref_year)), 1, 2)))
        return out.when(v == "-", tagged(kind, v)) if kind == "date_or_dash" else out

    def run(v: Column) -> Column:
        kind, std = rule.type, rule.std_type
        plain = tagged(std or kind or "string", v, value=v)
        if "number" in (kind, std):
            out = tagged("number", v, num=numbers.to_double(v))
        elif label == "制造年月":
            ym = dates.year_month(v)
            note = F.concat(F.lit("制造年月从 "), v, F.lit(" 自动校正为 "), ym["value"])
            notes = F.when(ym["flipped"], F.array(note)).otherwise(F.array().cast("array<string>"))
            fallback = date_value(v, "date") if "date" in (kind, std) else plain
            out = F.when(
                ym["value"].isNotNull(),
                tagged("year_month", v, value=ym["value"], display=ym["value"], warnings=notes)).otherwise(fallback)
        elif "date" in (kind, std):
            out = date_value(v, "date")
        elif kind == "date_or_dash":
            out = date_value(v, "date_or_dash")
        elif kind == "checkbox_choice":
            out = tagged("checkbox_choice", v)
        elif "check" in (kind, std):
            out = tagged("check", v, flag=check_flag(v, boxes=True))
        elif "signature" in (kind, std):
            out = tagged("signature", v, value=v)
        else:
            out = plain
        return F.when(v != "", out)

    return let(strip(c), run)
