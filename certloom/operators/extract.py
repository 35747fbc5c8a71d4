"""Fields out of free text.

A document is one row; its lines live in an array column, so every
look-ahead, block and carry rule is an array expression inside the row. No
line is shuffled, and a document with very many copies is no hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom import vocab
from certloom.functions import dates, numbers
from certloom.functions import text as tx
from certloom.functions.text import clean_value, let, squeeze, squeezed_lines, strip, text

def _null() -> Column:
    return F.lit(None).cast("string")


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _any(c: Column, patterns: list[str]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def _index_of(lines: Column, test: Callable[[Column], Column]) -> Column:
    """Zero-based position of the first line that passes, or null."""
    return F.nullif(F.array_position(F.transform(lines, test), True), F.lit(0).cast("long")).cast("int") - 1


# --- label / value pairs ----------------------------------------------------


_PAIR = r"^([^:：]{1,80})[:：]\s*(.*)$"


def mark_lines(lines: Column) -> Column:
    """array<struct(line, label, head)>: known label of each line and of its part before a colon."""
    return F.transform(lines, lambda x: F.struct(
        x.alias("line"), tx.known_label(x).alias("label"),
        F.when(x.rlike(_PAIR), tx.known_label(F.regexp_extract(x, _PAIR, 1))).alias("head")))


def following_value(marked: Column, at: Column, field: Column, reach: int = 4) -> Column:
    """First acceptable line after a label; a line of another label ends the search.

    Lines of the same field's labels are stepped over.
    """
    window = F.slice(marked, at + 2, reach)
    other = F.transform(window, lambda m: m["label"].isNotNull() & ~F.coalesce(
        tx.label_field(m["label"]) == field, F.lit(False)))
    before = F.slice(window, F.lit(1), F.coalesce(_index_of(other, lambda x: x), F.size(window)))
    values = F.transform(
        F.filter(before, lambda m: m["label"].isNull()), lambda m: tx.strip_english_label(m["line"]))
    return _first(F.filter(values, lambda v: ~tx.is_poor_candidate(v)))


def label_pairs(marked: Column) -> Column:
    """array<struct(label, value)>: 'label: value' lines first, then bare label lines.

    Only acceptable values are kept; the first pair of a label counts.
    """

    def own(m: Column) -> Column:
        value = tx.strip_english_label(F.regexp_extract(m["line"], _PAIR, 2))
        return let(value, lambda v: F.when(~tx.is_poor_candidate(v), v))

    def pair(label: Column, value: Column) -> Column:
        return F.when(label.isNotNull(), F.struct(label.alias("label"), value.alias("value")))

    colon = F.transform(marked, lambda m, i: pair(m["head"], F.coalesce(
        own(m), following_value(marked, i, tx.label_field(m["head"])))))
    bare = F.transform(marked, lambda m, i: F.when(~m["line"].rlike("[:：]"), pair(
        m["label"], following_value(marked, i, tx.label_field(m["label"])))))
    return F.filter(F.concat(colon, bare), lambda p: p["value"].isNotNull())


def pair_value(pairs: Column, field: str) -> Column:
    """Value of the first declared label of a field that has one."""

    def of(label: str) -> Column:
        return _first(F.filter(pairs, lambda p: p["label"] == label))["value"]

    labels = [k for k, f in tx.LABEL_FIELDS.items() if f == field]
    return F.coalesce(*[of(k) for k in labels])


def apply_pairs(current: Column, pairs: Column, field: str) -> Column:
    """The pair value replaces a current value only while that is of low quality."""
    return F.when(~tx.is_low_quality(field, current), current).otherwise(
        F.coalesce(pair_value(pairs, field), F.nullif(text(current), F.lit(""))))


def regex_rule(source: Column, field: str, patterns: dict[str, list[str]] = vocab.FIELD_PATTERNS) -> Column:
    """First acceptable value of a field's patterns (last group)."""
    found = []
    for pattern in patterns.get(field, []):
        value = clean_value(F.regexp_extract(source, "(?i)" + pattern, 2))
        found.append(let(value, lambda v: F.when(~tx.is_low_quality(field, v), v)))
    return F.coalesce(*found, _null())


def neighbor_value(lines: Column, labels: list[str], value_pattern: str) -> Column:
    """Value on a label's line, else on the next two lines; first label line that has one."""

    def of(line: Column) -> Column:
        return F.nullif(clean_value(F.regexp_extract(text(line), "(?i)" + value_pattern, 1)), F.lit(""))

    found = F.transform(lines, lambda x, i: F.when(
        _any(x, labels), F.coalesce(of(x), of(F.get(lines, i + 1)), of(F.get(lines, i + 2)))))
    return _first(F.array_compact(found))


def first_line(lines: Column, pattern: str) -> Column:
    return _first(F.filter(lines, lambda x: x.rlike("(?i)" + pattern)))


# How far behind a label a date is looked for, its form, and what the match has to hold.
DATE_WINDOWS = [
    (180, r"(\d{4})[./-](\d{1,2})[./-](\d{1,2})", r"\d"),
    (260, r"(\d{4})\D{0,20}(?:年|Year)\D{0,20}(\d{1,2})\D{0,20}(?:月|Month)\D{0,20}(\d{1,2})\D{0,20}(?:日|Day)", r"\d"),
    (180, r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})", r"年|月|日|year|month|day"),
]


# --- blocks -----------------------------------------------------------------


def text_block(lines: Column, starts: list[str], ends: list[str]) -> Column:
    """Lines from the first start line up to the next end line, or null."""

    def cut(start: Column) -> Column:
        rest = F.slice(lines, start + 2, F.greatest(F.size(lines), F.lit(1)))
        stop = F.coalesce(_index_of(rest, lambda x: _any(x, ends)), F.size(rest))
        return F.when(start.isNotNull(), F.array_join(F.slice(lines, start + 1, stop + 1), "\n"))

    return let(_index_of(lines, lambda x: _any(x, starts)), cut)


def all_blocks(lines: Column, starts: list[str], ends: list[str]) -> Column:
    """Lines of every start..end block, end lines left out."""
    begin = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        keep = F.struct(F.lit(True).alias("open"), F.concat(s["kept"], F.array(x)).alias("kept"))
        closed = F.struct(F.lit(False).alias("open"), s["kept"].alias("kept"))
        return F.when(s["open"], F.when(_any(x, ends), closed).otherwise(keep)).otherwise(
            F.when(_any(x, starts), keep).otherwise(s))

    return F.nullif(F.array_join(F.aggregate(lines, begin, step)["kept"], "\n"), F.lit(""))


CHECK_STARTS = [r"(?:一[、.．)]\s*)?一般检查", r"General inspection"]
CHECK_ENDS = ["备注", "结果", "检测员", "校准员", "核验员", r"(?:以下空白|\(以下空白\)|（以下空白）)"]
BASIS_STARTS = ["本次校准所依据的技术规范", r"Reference\s*documents\s*for\s*the\s*calibration", r"(?:检测|校准)\s*/?\s*依据"]
BASIS_ENDS = [
    "本次校准所使用的主要计量标准气瓶", "Main measurement standard instruments", "(?:其它|其他)校准信息",
    "Calibration Information", r"(?:一[、.．)]\s*)?一般检查", "General inspection", "备注", "结果", "检测员", "校准员", "核验员",
]


def calibration_block(source: Column) -> Column:
    """Up to 1200 characters after the calibration-information heading."""
    block = F.regexp_extract(source, r"(?i)(?:其它|其他)校准信息[:：]?((?s:.{0,1200}))(?:备注[:：]|$)", 1)
    return F.nullif(clean_value(block), F.lit(""))


def environment_values(source: Column) -> Column:
    """struct(location, temperature, humidity): the calibration block first, then the whole text."""

    def find(block: Column) -> Column:
        def first(pattern: str, sanitize: Callable[[Column], Column] = lambda c: c) -> Column:
            found = [
                F.nullif(sanitize(clean_value(F.regexp_extract(text(s), "(?i)" + pattern, 1))), F.lit(""))
                for s in (block, source)]
            return F.coalesce(*found)

        def place(c: Column) -> Column:
            cut = F.regexp_replace(c, r"(?s)(?:温度|湿度|Ambient\s*temperature|Relative\s*humidity)[:：]?.*$", "")
            return clean_value(F.regexp_replace(cut, r"[，,;；\s]+$", ""))

        return F.struct(
            first(r"(?:地点|Location)[:：]?\s*([^\n|；;]+)", place).alias("location"),
            first(r"(?:温度|Ambient\s*temperature)[:：]?\s*([+-]?\d+(?:\.\d+)?)\s*(?:℃|°C|C)?").alias("temperature"),
            first(r"(?:湿度|Relative\s*humidity)[:：]?\s*([0-9]+(?:\.[0-9]+)?)\s*%?\s*(?:RH|rh)?").alias("humidity"))

    return let(calibration_block(source), find)


def labelled_date(source: Column, lines: Column, label: str) -> Column:
    """Date on the label's line, else in the windows after the label."""
    exact = "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in label)
    spaced = r"\s*".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in label)
    found = []
    for name in dict.fromkeys((exact, spaced)):
        for window, body, unit in DATE_WINDOWS:
            hit = F.regexp_extract(source, rf"(?i){name}(?s:.{{0,{window}}}?){body}", 0)
            parts = F.concat_ws("-", *[F.regexp_extract(hit, f"(?i){body}", n) for n in (1, 2, 3)])
            found.append(F.when(hit.rlike("(?i)" + unit), parts))
    on_line = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(label))), clean_value)
    every = F.concat(on_line, F.array_compact(F.array(*found)))
    parsed = F.transform(every, lambda x: dates.parse_date_cn(x, strict=False, two_digit_year=True))
    # the windows are searched only where the label occurs at all
    return F.when(source.rlike("(?i)" + spaced), _first(F.array_compact(parsed)))


def standard_items(lines: Column, strict: bool = True) -> Column:
    """Distinct lines of the basis block without headings and numbering, else the codes.

    Without a block: the codes of the text, or with strict=False every line.
    """

    def items(block: Column) -> Column:
        kept = F.filter(block, lambda x: (clean_value(x) != "") & ~_any(x, BASIS_STARTS + BASIS_ENDS))
        cleaned = F.transform(
            kept, lambda x: clean_value(F.regexp_replace(clean_value(x), r"^\(?\d+\)?[、.．]?\s*", "")))
        return F.array_distinct(F.filter(cleaned, lambda x: x != ""))

    block = text_block(lines, BASIS_STARTS, BASIS_ENDS)
    codes = tx.standard_codes(F.array_join(lines, "\n"))
    found = items(F.split(block, "\n"))
    without = codes if strict else let(items(lines), lambda a: F.when(F.size(a) > 0, a).otherwise(codes))
    return F.when(block.isNotNull(), let(found, lambda a: F.when(F.size(a) > 0, a).otherwise(
        tx.standard_codes(block)))).otherwise(without)


def resolve_standard_items(items: Column, basis: Column) -> Column:
    """Given items, else the basis text's lines, else the codes in it."""
    given = F.array_distinct(F.filter(F.transform(
        F.coalesce(items, F.array().cast("array<string>")), squeeze), lambda x: x != ""))
    lines = squeezed_lines(basis)
    return F.when(F.size(given) > 0, given).when(F.size(lines) > 0, lines).otherwise(tx.standard_codes(basis))


# --- items ------------------------------------------------------------------


def numbered_items(lines: Column) -> Column:
    """Contents of '一、' or '1.' lines (numbers 1 to 99)."""
    pattern = r"^\s*([一二三四五六七八九十百千万\d]{1,4})[、.．)]\s*(.+)$"

    def content(x: Column) -> Column:
        number = F.regexp_extract(x, pattern, 1)
        value = clean_value(F.regexp_extract(x, pattern, 2))
        bad = number.rlike(r"^\d+$") & ~F.coalesce(number.try_cast("int").between(1, 99), F.lit(False))
        return F.when(x.rlike(pattern) & ~bad & (value != ""), value)

    return F.array_compact(F.transform(lines, content))


def check_lines(source: Column) -> Column:
    """Lines of a general check without numbering; collapsed texts are cut at '(n)'."""
    plain = F.split(text(source), "\r\n|\r|\n")
    parts = F.split(text(source), r"(?=\(\d+\))")
    chosen = F.when((F.size(plain) <= 2) & (F.size(parts) > F.size(plain)), parts).otherwise(plain)

    def clean(x: Column) -> Column:
        heading = x.rlike("^(?:[一二三四五六七八九十]+[、.．)]\\s*)?一般检查[:：]?$")
        body = strip(F.regexp_replace(x, r"^\(?\d+\)?[、.．)]?\s*", ""))
        return F.when((x != "") & ~heading & (F.length(body) >= 4), body)

    return F.array_compact(F.transform(chosen, lambda x: let(squeeze(x), clean)))


def series_values(lines: Column, keywords: list[str]) -> Column:
    """Numbers of a keyword's series: a measured line first, else the first line with numbers.

    Lines that state an uncertainty (Urel=) are no series lines; a measured
    line right below a keyword line belongs to it.
    """

    def numbers_of(x: Column, i: Column) -> Column:
        above = F.coalesce(F.get(lines, i - 1), F.lit(""))
        measured = x.contains("实测")
        mine = tx.any_of(x, keywords) | (measured & tx.any_of(above, keywords))
        found = numbers.all_numbers(x)
        return F.when(mine & ~x.rlike(r"(?i)Urel\s*=") & (F.size(found) > 0), F.struct(
            measured.alias("measured"), F.array_join(found, " ").alias("values")))

    def choose(rows: Column) -> Column:
        best = _first(F.filter(rows, lambda r: r["measured"]))
        return F.coalesce(best["values"], _first(rows)["values"])

    return let(F.array_compact(F.transform(lines, numbers_of)), choose)


def urel_windows(source: Column) -> Column:
    """What stands within 40 characters of a Urel value, one text per Urel.

    They begin where the text does or 40 characters before a Urel: every later one lies inside an earlier one.
    """
    word = "[Uu][Rr][Ee][Ll]"
    value = rf"{word}\s*=\s*[+-]?\d+(?:\.\d+)?\s*%?"
    # a dot: the class of blanks and no blanks takes twenty times as long
    before = rf"(?s)(?={word})(?<=(?=(.{{0,40}}{value}.{{0,40}}))(?:\A.{{0,40}}|.{{40}}))"
    return F.regexp_extract_all(source, F.lit(before), F.lit(1))


def urel_percent(source: Column, lines: Column, keywords: list[str]) -> Column:
    """Urel value on a keyword line, else one with a keyword within 40 characters."""
    pattern = r"(?i)Urel\s*=\s*([+-]?\d+(?:\.\d+)?)\s*%?"
    on_line = _first(F.array_compact(F.transform(lines, lambda x: F.when(
        tx.any_of(x, keywords), F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))))))
    near = let(_first(F.filter(urel_windows(source), lambda w: tx.any_of(w, keywords))), lambda w: F.nullif(
        F.regexp_extract(w, pattern, 1), F.lit("")))
    return F.when(source.rlike(r"(?i)Urel\s*="), F.coalesce(on_line, F.when(tx.any_of(source, keywords), near)))


# --- devices ----------------------------------------------------------------

_GROUP = "struct<device_name:string,device_model:string,device_code:string>"
_ENVIRONMENT = r"(?i)(温度[:：]|湿度[:：]|ambient\s*temperature|others|%RH|环境)"
_STANDARD_NAME = (
    r"(?i)(数字温度表|热电偶|铜卷尺|测量范围|溯源机构|证书编号|有效期限|measurement\s*range|traceability|certificate\s*number)")


def device_groups(marked: Column) -> Column:
    """Distinct (name, model, code) groups in first-seen order.

    A new name closes the open group only if that has a model or a code.
    Environment lines and repeats of standard instruments are dropped.
    """

    def part(m: Column, i: Column) -> Column:
        field = tx.label_field(m["head"])

        def value(s: Column) -> Column:
            is_name = s["field"] == "device_name"
            ahead = following_value(marked, i, s["field"])
            chosen = F.when(~tx.is_poor_candidate(s["own"]), s["own"]).when(~is_name | (s["own"] == ""), ahead)
            return let(chosen, lambda v: F.when(
                v.isNotNull() & ~(is_name & v.rlike(_ENVIRONMENT)), F.struct(s["field"].alias("field"), v.alias("value"))))

        own = tx.strip_english_label(F.regexp_extract(m["line"], _PAIR, 2))
        both = F.struct(field.alias("field"), own.alias("own"))
        return F.when(m["head"].isNotNull(), let(both, lambda s: F.when(
            s["field"].isin("device_name", "device_model", "device_code"), value(s))))

    parts = F.array_compact(F.transform(marked, part))
    empty = F.struct(*[F.lit("").alias(k) for k in ("device_name", "device_model", "device_code")]).cast(_GROUP)
    start = F.struct(F.array().cast(f"array<{_GROUP}>").alias("done"), empty.alias("now"))

    def group(name: Column, model: Column, code: Column) -> Column:
        return F.struct(
            name.alias("device_name"), model.alias("device_model"), code.alias("device_code")).cast(_GROUP)

    def step(s: Column, p: Column) -> Column:
        now, v = s["now"], p["value"]
        full = (now["device_name"] != "") & ((now["device_model"] != "") | (now["device_code"] != ""))

        def put(done: Column, current: Column) -> Column:
            return F.struct(done.alias("done"), current.alias("now"))

        named = F.when(full, put(F.concat(s["done"], F.array(now)), group(v, F.lit(""), F.lit("")))).otherwise(
            put(s["done"], group(v, now["device_model"], now["device_code"])))
        modelled = let(tx.split_model_code(v), lambda m: put(s["done"], group(
            now["device_name"], F.coalesce(m["model"], tx.clean_model(v)),
            F.when(now["device_code"] == "", F.coalesce(m["code"], F.lit(""))).otherwise(now["device_code"]))))
        coded = put(s["done"], group(now["device_name"], now["device_model"], tx.clean_code(v)))
        return F.when(p["field"] == "device_name", named).when(p["field"] == "device_model", modelled).otherwise(coded)

    def finish(s: Column) -> Column:
        last = s["now"]
        used = (last["device_name"] != "") | (last["device_model"] != "") | (last["device_code"] != "")
        groups = F.when(used, F.concat(s["done"], F.array(last))).otherwise(s["done"])
        cleaned = F.transform(groups, lambda g: group(
            clean_value(g["device_name"]), tx.clean_model(g["device_model"]), tx.clean_code(g["device_code"])))
        valid = F.filter(cleaned, lambda g: (
            (g["device_name"] != "") & ~g["device_name"].rlike(_ENVIRONMENT)
            & ((g["device_model"] != "") | (g["device_code"] != ""))))

        def repeats(rows: Column) -> Column:
            def kept(g: Column, i: Column) -> Column:
                bare = (g["device_model"] == "") | tx.is_placeholder_model(g["device_model"])
                seen = (g["device_code"] != "") & F.array_contains(
                    F.transform(F.slice(rows, F.lit(1), i), lambda r: r["device_code"]), g["device_code"])
                return ~((g["device_name"].contains(":") | g["device_name"].rlike(_STANDARD_NAME)) & bare & seen)

            return F.array_distinct(F.filter(rows, kept))

        return let(valid, repeats)

    return let(F.aggregate(parts, start, step), finish)


def group_summary(groups: Column) -> Column:
    """'1. name | model | code' lines."""

    def dash(c: Column) -> Column:
        return F.when(c == "", "-").otherwise(c)

    return F.array_join(F.transform(groups, lambda g, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), dash(g["device_name"]), F.lit(" | "), dash(g["device_model"]),
        F.lit(" | "), dash(g["device_code"]))), "\n")


def parse_group_summary(summary: Column) -> Column:
    """The inverse of group_summary."""
    pattern = r"^\s*\d+\.\s*(.*?)\s*\|\s*(.*?)\s*\|\s*(.*?)\s*$"

    def value(x: Column, n: int) -> Column:
        found = F.regexp_extract(x, pattern, n)
        return F.when(found.isin("-", "—"), "").otherwise(found)

    rows = F.transform(F.filter(F.split(text(summary), "\n"), lambda x: x.rlike(pattern)), lambda x: F.struct(
        value(x, 1).alias("device_name"), value(x, 2).alias("device_model"), value(x, 3).alias("device_code")))
    return F.filter(rows, lambda r: r["device_name"] != "")


def has_scope(source: Column) -> Column:
    return source.rlike(r"(?i)(测量范围|检测范围|温度范围|measurement\s*range|range\s*/\s*accuracy)")


def source_profile(source: Column, groups: Column) -> Column:
    """Shape of a source document."""
    marks = [
        "原始记录", "缆专检号", "委托单位|单位名称", "收样日期|校准日期", "扩展不确定度|不确定度",
        r"测量范围|检测范围|measurement\s*range"]
    hits = sum((source.rlike("(?i)" + m).cast("int") for m in marks), F.lit(0))
    return (
        F.when(F.size(groups) >= 2, "multi_device_baseinfo_word").when(hits >= 3, "template_form_word")
        .when(has_scope(source), "single_device_with_scope").otherwise("single_device_general"))


def explode_devices(df: DataFrame, groups: str, shared: list[str]) -> DataFrame:
    """One record per device of a document with several; shared fields copied.

    Standard-instrument groups (bare names with a repeated or no code) do not
    count as devices.
    """

    def own(rows: Column) -> Column:
        def keep(g: Column) -> Column:
            bare = g["device_model"].isin("", "-", "—")
            twice = (g["device_code"] != "") & (
                F.size(F.filter(rows, lambda r: r["device_code"] == g["device_code"])) >= 2)
            standard = g["device_name"].rlike(_STANDARD_NAME + "|标准气瓶")
            colon = g["device_name"].rlike("[:：]")
            return ~((colon & bare & twice) | (standard & bare & (twice | (g["device_code"] == ""))))

        return F.filter(rows, keep)

    # no filter: one on an array is copied down to the scan, where the groups would be found once more
    several = let(own(F.col(groups)), lambda d: F.when((F.size(groups) >= 2) & (F.size(d) >= 2), d))
    exploded = df.select(*[c for c in df.columns if c != groups], F.posexplode(several).alias("__n", "__g"))
    kept = [c for c in shared if c in df.columns]
    ids = [c for c in exploded.columns if c not in ("__n", "__g", *kept)]
    g = F.col("__g")
    raw = F.concat_ws(
        "\n", F.concat(F.lit("气瓶名称: "), g["device_name"]), F.concat(F.lit("型号规格: "), g["device_model"]),
        F.concat(F.lit("气瓶编号: "), g["device_code"]))
    return exploded.select(
        *ids, *kept, (F.col("__n") + 1).alias("row_number"), g["device_name"].alias("device_name"),
        g["device_model"].alias("device_model"), g["device_code"].alias("device_code"), raw.alias("raw_record"))


# --- several records in one text --------------------------------------------


def split_records(source: Column) -> Column:
    """Blocks of a text with several records.

    Cut at name labels (an owner line shortly above goes with the record), else
    at lines that look like a device name, else the whole text.
    """
    mark = "(?:设备名称|气瓶名称|仪器名称|设备名)"
    whole = F.replace(text(source), F.lit("\r"), F.lit(""))
    owner = "有限公司|厂商|厂家|制造|联系方式|电话|单位名称|地址"
    item = r"(?:\d+|[一二三四五六七八九十]+)[、.．)]"
    # a record starts at its label, or at an owner line with only blank and plain lines in between
    labels = F.split(whole, f"(?={mark})")

    def by_label(parts: Column) -> Column:
        def tail(p: Column) -> Column:
            """The end of a block that belongs to the next record."""
            lines = F.transform(F.split(F.right(p, F.lit(220)), "\n"), lambda x: x)

            def step(s: Column, x: Column) -> Column:
                line, used = strip(x), s["used"] + F.length(x) + 1
                found = F.struct(F.lit(True).alias("done"), used.alias("used"), used.alias("take"))
                stop = F.struct(F.lit(True).alias("done"), used.alias("used"), s["take"].alias("take"))
                on = F.struct((used > 120).alias("done"), used.alias("used"), s["take"].alias("take"))
                blank = F.struct(F.lit(False).alias("done"), used.alias("used"), s["take"].alias("take"))
                return (
                    F.when(s["done"], s).when(line == "", blank).when(line.rlike("^" + item), stop)
                    .when(line.rlike(owner), found).otherwise(on))

            start = F.struct(F.lit(False).alias("done"), F.lit(0).alias("used"), F.lit(0).alias("take"))
            return F.aggregate(F.reverse(lines), start, step)["take"]

        def block(p: Column, i: Column) -> Column:
            before = F.get(parts, i - 1)
            lead = F.when(i > 0, F.right(before, F.least(tail(before), F.length(before))))
            return strip(F.concat(F.coalesce(lead, F.lit("")), p))

        blocks = F.transform(parts, block)
        return F.filter(F.slice(blocks, F.lit(2), F.size(parts)), lambda x: x != "")

    named = F.filter(labels, lambda p: p.rlike("^" + mark))
    lines = F.filter(F.transform(F.split(whole, "\n"), strip), lambda x: x != "")
    like = "试验仪|高温箱|电桥|局放仪|击穿|伸长|冲击|老化|温度|耐压|绝缘"

    def by_line(rows: Column) -> Column:
        def starts(x: Column, i: Column) -> Column:
            above = F.coalesce(F.get(rows, i - 1), F.lit(""))
            return F.length(x).between(3, 40) & x.rlike(like) & ~((i > 0) & above.rlike("单位名称|地址|联系方式|电话"))

        flags = F.transform(rows, starts)
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0))), lambda i: F.get(flags, i))

        def cut(points: Column) -> Column:
            pieces = F.transform(points, lambda p, n: F.array_join(F.slice(
                rows, p + 1, F.coalesce(F.get(points, n + 1), F.size(rows)) - p), "\n"))
            return F.when(F.size(points) > 1, pieces).otherwise(F.array(whole))

        return let(at, cut)

    padded = F.when(_first(labels).rlike("^" + mark), F.concat(F.array(F.lit("")), labels)).otherwise(labels)
    return F.when(strip(whole) == "", F.array().cast("array<string>")).when(
        F.size(named) > 1, let(padded, by_label)).otherwise(let(lines, by_line))


def split_certificate(certificate: Column, valid: Column) -> Column:
    """struct(certificate_no, valid_date): a date inside the number moves to the date."""
    no, until = tx.placeholder_to_null(certificate), tx.placeholder_to_null(valid)
    loose = dates.parse_date_cn
    inside = loose(no, strict=False)
    rest = tx.placeholder_to_null(F.regexp_replace(text(no), r"\d{4}\D+\d{1,2}\D+\d{1,2}(?:\D*日)?", ""))
    moved = until.isNull() & inside.isNotNull()
    return F.struct(
        F.when(moved, rest).otherwise(no).alias("certificate_no"),
        F.when(until.isNotNull(), F.coalesce(loose(until, strict=False), until)).otherwise(inside).alias("valid_date"))


def split_stacked(df: DataFrame) -> DataFrame:
    """Catalogue rows whose cells hold several lines become several rows.

    At least two anchor cells must have the largest number of lines; single
    lines repeat. Certificate numbers give up a date they contain.
    """
    keys = vocab.CATALOG_KEYS

    def parts(k: str) -> Column:
        found = F.filter(F.transform(F.split(text(k), "\r\n|\r|\n"), strip), lambda x: x != "")
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))

    split = df.withColumns({f"__{k}": parts(k) for k in keys})
    most = F.greatest(*[F.size(f"__{k}") for k in keys])
    anchors = sum(((F.size(f"__{k}") == most).cast("int") for k in vocab.STACK_ANCHORS), F.lit(0))
    stacked = (most > 1) & (anchors >= 2)
    counted = split.withColumns({"__stacked": stacked, "__n": F.when(stacked, most).otherwise(1)})
    rows = counted.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    other = [c for c in df.columns if c not in keys]

    def cell(k: str) -> Column:
        value = F.when(F.size(f"__{k}") == 1, F.col(f"__{k}")[0]).otherwise(F.get(F.col(f"__{k}"), F.col("__i")))
        return F.when(F.col("__stacked"), tx.placeholder_to_null(value)).otherwise(F.nullif(strip(k), F.lit("")))

    out = rows.select(*other, F.col("__i").alias("part"), *[cell(k).alias(k) for k in keys])
    fixed = out.withColumn("__c", split_certificate(F.col("certificate_no"), F.col("valid_date")))
    return fixed.withColumns({"certificate_no": F.col("__c.certificate_no"), "valid_date": F.col("__c.valid_date")}).drop("__c")


# --- measured values --------------------------------------------------------


def _unnumbered(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(x, "\t+", " "), r"^\s*[一二三四五六七八九十\d]+[、.．)]\s*", ""))


def uncertainty_items(lines: Column) -> Column:
    """array<struct(anchor, value, unit)> of 'anchor U=value unit, k=2' lines."""
    pattern = r"(?i)^(.*?)\s*(?:[:：])?\s*U\s*=\s*([+-]?\d+(?:\.\d+)?)\s*([^\s,，;；]*)\s*[,，]?\s*k\s*=\s*2"

    def item(x: Column) -> Column:
        anchor = strip(F.regexp_replace(squeeze(F.regexp_extract(x, pattern, 1)), r"(?:扩展不确定度|校准)\s*$", ""))
        return F.when(x.rlike(pattern), F.struct(
            anchor.alias("anchor"), F.regexp_extract(x, pattern, 2).alias("value"),
            squeeze(F.regexp_extract(x, pattern, 3)).alias("unit")))

    return F.array_compact(F.transform(lines, lambda x: let(_unnumbered(x), item)))


def resistive_uncertainty(source: Column) -> Column:
    """First U of a resistance."""
    tail = r"\s*U\s*=\s*([0-9]+(?:\.[0-9]+)?)\s*(?:m?[ΩΩω])\s*[,，]?\s*k\s*=\s*2"
    return tx.first_match(squeeze(source), [r"电阻(?:校准)?[:：]?" + tail, "扩展不确定度" + tail])


def measured_items(lines: Column) -> Column:
    """array<struct(anchor, value, unit)> of measured-value lines.

    The anchor is the last line above that is no measured value.
    """
    word = r"实\s*测\s*值"
    regular = (
        rf"(?i){word}(?:\s*[（(]\s*([^)）]+)\s*[)）])?\s*[:：]\s*([+-]?\d+(?:\.\d+)?)\s*([^\s,，;；。．]*)")
    loose = rf"(?i){word}[^\d+-]*([+-]?\d+(?:\.\d+)?)"

    def parse(x: Column) -> Column:
        unit = F.coalesce(
            F.nullif(squeeze(F.regexp_extract(x, regular, 3)), F.lit("")), squeeze(F.regexp_extract(x, regular, 1)))
        bracket = squeeze(F.regexp_extract(x, r"[（(]\s*([^)）]+)\s*[)）]\s*[:：]?\s*$", 1))
        tail = F.regexp_extract(x, loose + r"(.*)$", 2)
        after = squeeze(F.regexp_extract(tail, r"([A-Za-z%°ΩΩω℃/]+)\s*[。．]?\s*$", 1))
        return F.when(x.rlike(regular), F.struct(
            F.regexp_extract(x, regular, 2).alias("value"), unit.alias("unit"))).when(x.rlike(loose), F.struct(
                F.regexp_extract(x, loose, 1).alias("value"),
                F.when(bracket != "", bracket).otherwise(after).alias("unit")))

    def run(rows: Column) -> Column:
        parsed = F.transform(rows, parse)

        def with_anchor(p: Column) -> Column:
            def one(item: Column, i: Column) -> Column:
                above = F.filter(F.slice(rows, F.lit(1), i), lambda x, j: F.get(p, j).isNull())
                anchor = F.when(F.size(above) > 0, F.element_at(above, -1)).otherwise("")
                cut = squeeze(F.regexp_replace(anchor, r"(?i)(?:扩展不确定度\s*)?U\s*=\s*.*$", ""))
                return F.when(item.isNotNull(), F.struct(
                    cut.alias("anchor"), item["value"].alias("value"), item["unit"].alias("unit")))

            return F.array_compact(F.transform(p, one))

        return let(parsed, with_anchor)

    return let(F.transform(lines, _unnumbered), run)


_KEY_HEAD, _VALUE_HEAD = "标准值|标称值|设定值", "校准值|实际值|实测值|示值|读数|测量值"
_ENTRY = "struct<map_no:int,key:string,value:string>"


def value_maps(source: Column) -> Column:
    """array<struct(map_no, key, value)> of the key/value tables in tab-separated lines.

    Two-row tables (keys over values) first, then column tables, in which an
    empty key repeats the one above and a closing row ends the table.
    """
    rows = F.transform(
        F.filter(F.split(text(source), "\r\n|\r|\n"), lambda x: x.contains("\t")),
        lambda x: F.transform(F.split(x, "\t"), squeeze))

    def build(table: Column) -> Column:
        def flat(i: Column) -> Column:
            upper, lower = F.get(table, i), F.get(table, i + 1)
            fits = (
                (F.size(upper) >= 2) & (F.size(lower) >= 2) & tx.compact(upper[0]).rlike(_KEY_HEAD)
                & tx.compact(lower[0]).rlike(_VALUE_HEAD))
            width = F.least(F.size(upper), F.size(lower))
            cells = F.transform(F.sequence(F.lit(1), width - 1), lambda c: F.struct(
                tx.semantic_key(F.get(upper, c)).alias("key"), F.get(lower, c).alias("value")))
            return F.when(fits, F.filter(cells, lambda e: (e["key"] != "") & (e["value"] != "")))

        def column(i: Column) -> Column:
            heads = F.transform(F.get(table, i), tx.compact)

            def where(pattern: str) -> Column:
                return _index_of(heads, lambda x: x.rlike(pattern))

            value = where("实际值|实测值|示值|读数|测量值|校准值")
            key = F.coalesce(where(_KEY_HEAD), where("倍率|量程|点位|档位"), F.greatest(F.lit(0), value - 1))
            rest = F.slice(table, i + 2, F.greatest(F.size(table), F.lit(1)))

            def read(at: Column) -> Column:
                k, v = at["k"], at["v"]
                wide = F.filter(rest, lambda r: (F.size(r) > k) & (F.size(r) > v))
                # an empty key takes the last key above it
                full = F.transform(wide, lambda r, j: F.struct(
                    F.coalesce(F.element_at(F.concat(F.array(_null()), F.filter(F.transform(
                        F.slice(wide, F.lit(1), j + 1), lambda q: F.get(q, k)), lambda q: q != "")), -1), F.lit("")).alias("k"),
                    F.get(r, v).alias("v"), squeeze(F.array_join(r, " ")).alias("all")))
                stop = _index_of(full, lambda e: ((e["k"] != "") | (e["v"] != "")) & e["all"].rlike(
                    r"以下空白|不确定度评定|检测员|校准员|核验员|结果[:：]?$"))
                kept = F.slice(full, F.lit(1), F.coalesce(stop, F.size(full)))
                entries = F.transform(kept, lambda e: F.struct(tx.semantic_key(e["k"]).alias("key"), e["v"].alias("value")))
                return F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != ""))

            return F.when(value.isNotNull() & (key != value), let(F.struct(key.alias("k"), value.alias("v")), read))

        steps = F.when(F.size(table) >= 2, F.sequence(F.lit(0), F.size(table) - 1)).otherwise(
            F.array().cast("array<int>"))
        maps = F.filter(
            F.concat(F.transform(F.slice(steps, F.lit(1), F.greatest(F.size(table) - 1, F.lit(0))), flat), F.transform(steps, column)),
            lambda m: F.size(F.coalesce(m, F.array().cast("array<struct<key:string,value:string>>"))) > 0)

        def number(found: Column) -> Column:
            # inside one map a later value of a key replaces an earlier one
            return F.flatten(F.transform(found, lambda m, n: F.transform(
                F.filter(m, lambda e, i: ~F.exists(F.slice(m, i + 2, F.size(m)), lambda o: o["key"] == e["key"])),
                lambda e: F.struct((n + 1).alias("map_no"), e["key"].alias("key"), e["value"].alias("value")).cast(_ENTRY))))

        return let(maps, number)

    return let(rows, build)


def series_maps(source: Column) -> Column:
    """array<struct(block, key, values)>: labelled rows of tab tables, then plain-text rows.

    The first row of a label in a block counts.
    """
    rows = F.split(text(source), "\r\n|\r|\n")

    def build(lines: Column) -> Column:
        def block_no(i: Column) -> Column:
            return F.size(F.filter(F.slice(lines, F.lit(1), i), lambda x: ~x.contains("\t")))

        def tabbed(x: Column, i: Column) -> Column:
            cells = F.transform(F.split(x, "\t"), squeeze)
            values = F.slice(cells, F.lit(2), F.size(cells))
            key = tx.series_label(cells[0])
            ok = x.contains("\t") & (key != "") & F.exists(values, lambda v: v != "")
            return F.when(ok, F.struct(block_no(i).alias("block"), key.alias("key"), values.alias("values")))

        def plain(x: Column) -> Column:
            line = squeeze(x)
            found = numbers.all_numbers(line)
            key = tx.series_label(_first(F.split(line, "[:：]")))
            ok = line.rlike("标称值|标准值|校准值|实际值|实测值|显示值|示值") & (F.size(found) >= 2) & (key != "")
            return F.when(ok, F.struct((F.size(lines) + 1).alias("block"), key.alias("key"), found.alias("values")))

        both = F.array_compact(F.concat(F.transform(lines, tabbed), F.transform(lines, plain)))
        return let(both, lambda b: F.filter(b, lambda e, i: ~F.exists(
            F.slice(b, F.lit(1), i), lambda o: (o["block"] == e["block"]) & (o["key"] == e["key"]))))

    return let(rows, build)


def following_numbers(lines: Column) -> Column:
    """A header line of shown or measured values absorbs the pure-number lines below it."""
    header = r"(?i)^(?:显\s*示\s*值|实\s*测\s*值)\s*\(?.*?[℃°cC]?\)?\s*[:：]?$"
    number = r"^[+-]?\d+(?:\.\d+)?$"

    def build(rows: Column) -> Column:
        def run(i: Column) -> Column:
            rest = F.slice(rows, i + 2, F.greatest(F.size(rows), F.lit(1)))
            stop = F.coalesce(_index_of(rest, lambda x: ~x.rlike(number)), F.size(rest))
            return F.slice(rest, F.lit(1), stop)

        def line(x: Column, i: Column) -> Column:
            above = F.slice(rows, F.lit(1), i)
            last_other = F.filter(above, lambda y: ~y.rlike(number))
            absorbed = x.rlike(number) & F.coalesce(F.element_at(F.concat(F.array(F.lit("")), last_other), -1).rlike(header), F.lit(False))
            merged = let(run(i), lambda r: F.when(F.size(r) > 0, F.concat(x, F.lit(" "), F.array_join(r, "  "))).otherwise(x))
            return F.when(absorbed, _null()).when(x.rlike(header), merged).otherwise(x)

        return F.array_compact(F.transform(rows, line))

    return let(lines, build)


# --- tables in texts --------------------------------------------------------


def table_rows(source: Column) -> Column:
    """array<array<string>> when all lines split into the same number of columns, else null.

    Tabs first, then pipes, then runs of two or more blanks (three lines at least).
    """
    lines = tx.raw_lines(source)

    def build(rows: Column) -> Column:
        def attempt(separator: str) -> Column:
            cut = F.transform(rows, lambda x: F.transform(F.split(x, separator), strip))
            sizes = F.transform(cut, F.size)
            same = (F.array_min(sizes) == F.array_max(sizes)) & (F.array_min(sizes) >= 2)
            return F.when(same, cut)

        wide = attempt(r"\s{2,}")
        return F.when(F.size(rows) >= 2, F.coalesce(
            attempt("\t"), attempt(r"\|"), F.when(F.size(rows) >= 3, wide)))

    return let(lines, build)


def key_value_rows(source: Column) -> Column:
    """array<struct(key, value)> when every line is 'key: value', else null."""
    pattern = r"^([^:：]{1,60})[:：]\s*(.+)$"
    return let(tx.raw_lines(source), lambda rows: F.when(
        (F.size(rows) >= 2) & F.forall(rows, lambda x: x.rlike(pattern)),
        F.transform(rows, lambda x: F.struct(
            strip(F.regexp_extract(x, pattern, 1)).alias("key"), strip(F.regexp_extract(x, pattern, 2)).alias("value")))))


def list_items(source: Column) -> Column:
    """Items when every line is numbered, bulleted or holds a standard code, else null."""
    bullet = r"^(?:[-*•]|(?:\d+|[一二三四五六七八九十]+)[、.．)]|\(\d+\))\s*(.+)$"
    code = r"(?i)[A-Za-z]{1,5}\s*/\s*T\s*\d+(?:\.\d+)?-\d{4}"
    return let(tx.raw_lines(source), lambda rows: F.when(
        (F.size(rows) >= 2) & F.forall(rows, lambda x: x.rlike(bullet) | x.rlike(code)),
        F.transform(rows, lambda x: F.when(x.rlike(bullet), strip(F.regexp_extract(x, bullet, 1))).otherwise(x))))


def measurement_rows(source: Column) -> Column:
    """array<struct> of instrument rows: name, model, code, range, uncertainty, certificate, trace."""
    names = ["name", "model", "code", "measurement_range", "uncertainty", "certificate", "traceability"]

    def cells(x: Column) -> Column:
        tabs = F.transform(F.split(x, "\t"), squeeze)
        wide = F.transform(F.split(x, r"\s{2,}"), squeeze)
        pipes = F.transform(F.split(x, r"\|"), squeeze)
        chosen = F.when(F.size(tabs) >= 2, tabs).when(F.size(wide) >= 2, wide).otherwise(pipes)
        return F.filter(chosen, lambda c: c != "")

    rows = F.filter(F.transform(F.split(tx.keep_tabs_text(source), "\n"), cells), lambda r: F.size(r) > 0)

    def build(found: Column) -> Column:
        head = _first(found)
        heading = head[0].contains("气瓶名称") | F.contains(
            F.lower(tx.compact(F.array_join(head, ""))), F.lit("instrumentname"))
        body = F.when(heading, F.slice(found, F.lit(2), F.size(found))).otherwise(found)
        return F.transform(body, lambda r: F.struct(
            *[F.coalesce(F.get(r, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]))

    return let(rows, build)


def appendix_lines(source: Column) -> Column:
    """array<struct(serial, maker, next_date)> of tab- or comma-separated lines."""

    def one(x: Column) -> Column:
        parts = F.when(x.contains("\t"), F.split(x, "\t")).otherwise(F.split(x, ","))
        cell = [F.coalesce(strip(F.get(parts, F.lit(i))), F.lit("")) for i in range(3)]
        return F.struct(cell[0].alias("serial"), cell[1].alias("maker"), cell[2].alias("next_date"))

    return F.transform(tx.raw_lines(source), one)


def neighbor_cell(table: Column, labels: list[str]) -> Column:
    """Value of a label in a table: to its right, else in the next three rows below."""

    def row(cells: Column, r: Column) -> Column:
        def cell(x: Column, c: Column) -> Column:
            right = F.array_compact(F.transform(F.slice(cells, c + 2, F.size(cells)), tx.context_value))
            below = F.flatten(F.transform(F.slice(table, r + 2, F.lit(3)), lambda nxt: F.array_compact(F.array(
                tx.context_value(F.get(nxt, c)), tx.context_value(F.get(nxt, c + 1))))))
            return F.when(tx.any_of(x, labels), F.coalesce(_first(right), _first(below)))

        return _first(F.array_compact(F.transform(cells, cell)))

    return _first(F.array_compact(F.transform(table, row)))


def paired_series(source: Column) -> Column:
    """array<struct(p1, p2, se)> of P1/P2 tables; SE is P1 - P2 where it is missing."""
    rows = F.transform(
        F.filter(F.split(text(source), "\r\n|\r|\n"), lambda x: x.contains("\t")),
        lambda x: F.transform(F.split(x, "\t"), squeeze))

    def build(grid: Column) -> Column:
        def at(pattern: str, cells: Column) -> Column:
            return _index_of(cells, lambda x: tx.compact(x).rlike(pattern))

        heads = F.transform(grid, lambda r: F.struct(
            at("P1", r).alias("p1"), at("P2", r).alias("p2"), at("SE|屏蔽效能", r).alias("se")))

        def values(hs: Column) -> Column:
            def data(row: Column, i: Column) -> Column:
                own = F.get(hs, i)
                above = F.filter(F.slice(hs, F.lit(1), i), lambda h: h["p1"].isNotNull() & h["p2"].isNotNull())
                h = F.element_at(F.concat(F.array(F.lit(None).cast("struct<p1:int,p2:int,se:int>")), above), -1)

                def read(c: Column) -> Column:
                    p1, p2 = (numbers.first_number(F.get(row, c[k])) for k in ("p1", "p2"))
                    se = numbers.first_number(F.get(row, c["se"]))
                    diff = numbers.format_number(p1.cast("double") - p2.cast("double"), 3)
                    any_value = p1.isNotNull() | p2.isNotNull() | se.isNotNull()
                    wide = F.size(row) > F.greatest(c["p1"], c["p2"])
                    return F.when(wide & any_value, F.struct(
                        F.coalesce(p1, F.lit("")).alias("p1"), F.coalesce(p2, F.lit("")).alias("p2"),
                        F.coalesce(se, diff, F.lit("")).alias("se")))

                is_head = own["p1"].isNotNull() & own["p2"].isNotNull()
                return F.when(~is_head & h.isNotNull(), let(h, read))

            return F.array_compact(F.transform(grid, data))

        return let(heads, values)

    return let(rows, build)


def background_noise(lines: Column) -> Column:
    """Background noise values: the first at 0 kV, then those at working voltage."""

    def value(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(r"(?i)([+-]?\d+(?:\.\d+)?)\s*pC"), F.lit(1))
        return F.when(x.contains("背景噪声") & (F.size(found) > 0), F.struct(
            F.element_at(found, -1).alias("v"), x.rlike(r"(?i)(?<!\d)0\s*kV").alias("zero")))

    def order(items: Column) -> Column:
        zero = F.slice(F.filter(items, lambda e: e["zero"]), F.lit(1), F.lit(1))
        return F.transform(F.concat(zero, F.filter(items, lambda e: ~e["zero"])), lambda e: e["v"])

    return let(F.array_compact(F.transform(lines, value)), order)


def section_values(source: Column) -> Column:
    """array<struct(section, u, measured)> of the numbered sections, the first of a number counts."""
    start = r"(?:(?<=^)|(?<=\n)|(?<=[。．;；]))\s*([一二三四五六七])\s*[、.．)]"
    pieces = F.split(text(source), "(?=" + start + ")")

    def one(p: Column) -> Column:
        number = F.regexp_extract(p, r"^\s*([一二三四五六七])\s*[、.．)]", 1)
        body = strip(F.regexp_replace(p, r"^\s*[一二三四五六七]\s*[、.．)]", ""))
        u = tx.first_group(body, r"(?i)(?:扩展不确定度\s*)?U\s*=\s*([+-]?[0-9]+(?:\.[0-9]+)?)")
        measured = F.coalesce(
            tx.first_group(body, r"实\s*测\s*值(?:\s*[（(][^)）]*[)）])?\s*[:：]?\s*([+-]?[0-9]+(?:\.[0-9]+)?)"),
            tx.first_group(body, r"实\s*测\s*值[^\d+-]*([+-]?[0-9]+(?:\.[0-9]+)?)"))
        return F.when((number != "") & (body != ""), F.struct(
            number.alias("section"), u.alias("u"), measured.alias("measured")))

    found = F.array_compact(F.transform(pieces, one))
    return let(found, lambda a: F.filter(a, lambda e, i: ~F.exists(
        F.slice(a, F.lit(1), i), lambda o: o["section"] == e["section"])))


def window_value(source: Column, title: str, unit: str, kind: str = "u") -> Column:
    """U or measured value within a window after a section title."""
    name, u = ("".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s) for s in (title, unit))
    if kind == "u":
        pattern = rf"(?is){name}[\s\S]{{0,240}}?扩展不确定度U\s*=\s*([0-9]+(?:\.[0-9]+)?)\s*{u}"
    else:
        pattern = rf"(?is){name}[\s\S]{{0,280}}?实测值[:：]?\s*([0-9]+(?:\.[0-9]+)?)\s*{u}"
    return tx.first_group(text(source), pattern)


def hammer_rows(lines: Column, overrides: list[Column] | None = None) -> Column:
    """Up to three rows of the last ten actual values; a stated row replaces its place."""

    def row(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
        return F.when(x.contains("实际值(g)") & (F.size(found) >= 10), F.slice(found, -10, 10))

    rows = F.slice(F.array_compact(F.transform(lines, row)), 1, 3)
    if not overrides:
        return rows

    def stated(c: Column) -> Column:
        found = F.slice(F.regexp_extract_all(text(c), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), 1, 10)
        return F.when(F.size(found) > 0, found)

    none = F.array().cast("array<string>")
    return let(rows, lambda r: F.array(*[
        F.coalesce(stated(o), F.get(r, F.lit(i)), none) for i, o in enumerate(overrides)]))


def detect_field_keys(name: Column, source: Column) -> Column:
    """Keys of the fields a document needs, by its marker words."""
    both = F.concat(squeeze(name), F.lit("\n"), squeeze(source))

    def keys(t: Column) -> Column:
        parts = [
            F.when(tx.any_of(t, marks), tx.literal_array(found)).otherwise(F.array().cast("array<string>"))
            for marks, found in vocab.FIELD_KEY_GROUPS]
        return F.array_distinct(F.concat(tx.literal_array(vocab.CORE_FIELD_KEYS), *parts))

    return let(both, keys)


def field_labels(keys: Column) -> Column:
    """array<struct(key, label)> of known keys."""
    return F.transform(keys, lambda k: F.struct(
        k.alias("key"), F.try_element_at(tx.literal_map(vocab.FIELD_LABELS), k).alias("label")))


def data_lines(lines: Column, min_tokens: int = 6) -> Column:
    """Lines of the data region: from the first date-like line to the first unlike line."""
    start = r"^\s*[zZ]?\d{1,2}(?:\s*[./-]\s*\d{1,2})?\b"
    inside = r"(?:^|\s)[zZ]?\d{1,2}\s*[./-]\s*\d{1,2}\b"
    need = max(3, min_tokens // 3)

    def dated(x: Column) -> Column:
        return x.rlike(start) | x.rlike(inside)

    def row_like(x: Column) -> Column:
        tokens = F.filter(F.split(x, r"\s+"), lambda t: t != "")
        return dated(x) | ((F.size(tokens) >= min_tokens) & (
            F.size(F.filter(tokens, lambda t: t.rlike(r"\d"))) >= need))

    def build(first: Column) -> Column:
        rest = F.slice(lines, first + 1, F.greatest(F.size(lines), F.lit(1)))
        stop = F.coalesce(_index_of(rest, lambda x: ~row_like(x)), F.size(rest))
        return F.when(first.isNotNull(), F.slice(rest, F.lit(1), stop)).otherwise(F.array().cast("array<string>"))

    return let(_index_of(lines, dated), build)


# --- profiles ---------------------------------------------------------------


def document_profile(source: Column) -> Column:
    """struct of counts that describe a document."""
    lines = squeezed_lines(source)

    def build(rows: Column) -> Column:
        block = text_block(rows, CHECK_STARTS, CHECK_ENDS)
        return F.struct(
            F.length(text(source)).alias("text_length"),
            (text(source).contains("一般检查") | text(source).rlike("(?i)General inspection")).alias("has_general_check_keyword"),
            F.coalesce(F.length(block), F.lit(0)).alias("general_check_length"),
            F.size(uncertainty_items(rows)).alias("uncertainty_items_count"),
            F.size(measured_items(rows)).alias("measured_items_count"))

    return let(lines, build)


PROFILE_FIELDS = ["text_length", "has_general_check_keyword", "general_check_length", "uncertainty_items_count", "measured_items_count"]


def profile_changes(baseline: DataFrame, current: DataFrame, key: str, fields: list[str] = PROFILE_FIELDS, buckets: int = 4096) -> DataFrame:
    """(key, status, field, before, after): what a collection of profiles lost, gained or changed against a stored one.

    Both sides are cut into buckets by key; each bucket's digest (rows, and a sum and an exclusive or of row hashes) is
    one aggregate. Only rows of buckets with different digests are joined, so an unchanged collection costs two scans.
    A lost or added document is one row without field. Keys are unique and not null.
    """
    def numbered(df: DataFrame) -> DataFrame:
        row = F.struct(key, *[F.col(f).cast("string").alias(f) for f in fields])
        return df.select(F.col(key).alias("k"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), row.alias("row"), F.xxhash64(row).alias("h"))

    def digests(df: DataFrame, name: str) -> DataFrame:
        low = F.col("h").bitwiseAND(F.lit((1 << 31) - 1))
        return df.groupBy("bucket").agg(F.struct(F.count("*"), F.sum(low), F.bit_xor("h")).alias(name))

    before, after = numbered(baseline), numbered(current)
    both = digests(before, "x").join(digests(after, "y"), "bucket", "full")
    differing = both.where(~F.col("x").eqNullSafe(F.col("y"))).select("bucket")
    old, new = (df.join(differing, "bucket", "left_semi").select("k", F.col("row").alias(name)) for df, name in ((before, "old"), (after, "new")))
    status = F.when(F.col("new").isNull(), "lost").when(F.col("old").isNull(), "added").otherwise("changed")
    changes = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col("old")[f].alias("before"), F.col("new")[f].alias("after")) for f in fields)),
                       lambda c: ~c["before"].eqNullSafe(c["after"]))
    nothing = F.array(F.struct(*(F.lit(None).cast("string").alias(f) for f in ("field", "before", "after"))))
    joined = old.join(new, "k", "full").withColumn("status", status)
    return joined.select(F.col("k").alias(key), "status", F.inline(F.when(F.col("status") == "changed", changes).otherwise(nothing)))


def block_score(block: Column) -> Column:
    """How much usable content a general-check block holds."""
    kept = tx.keep_tabs_text(block)

    def score(t: Column) -> Column:
        lines = squeezed_lines(t)
        return (
            F.size(check_lines(t)) + F.size(uncertainty_items(lines)) * 3 + F.size(measured_items(lines)) * 3
            + F.size(value_maps(t)) * 2 + F.size(series_maps(t)) * 2)

    return let(kept, lambda t: F.when(t == "", F.lit(0)).otherwise(score(t)))


def is_sparse(block: Column) -> Column:
    """A block without values: no items, open placeholders, or fewer than three numbers."""

    def test(t: Column) -> Column:
        lines = squeezed_lines(t)
        items = (F.size(uncertainty_items(lines)) > 0) | (F.size(measured_items(lines)) > 0)
        open_u = (t.contains("扩展不确定度") & t.contains("U=")) | t.rlike(
            r"扩展不确定度\s*U\s*=\s*(?:[:：]?\s*)?$") | t.rlike(r"扩展不确定度\s*U\s*=\s*[^\d\n]*[,，]?\s*k\s*=\s*2")
        open_m = t.rlike(r"实\s*测\s*值(?:\s*[（(][^)）]*[)）])?\s*[:：]\s*[^\d\n]*$")
        few = F.size(numbers.all_numbers(t)) < 3
        return F.when(t == "", True).when(items, False).otherwise(open_u | open_m | few)

    return let(tx.keep_tabs_text(block), test)


def choose_block(field_block: Column, raw_block: Column) -> Column:
    """The field's block unless it is empty, sparse or clearly poorer than the text's."""
    own, raw = F.nullif(tx.keep_tabs_text(field_block), F.lit("")), F.nullif(text(raw_block), F.lit(""))
    mine = block_score(own)
    richer = (mine < 4) & (block_score(raw) > mine)
    return F.when(own.isNull(), raw).when(raw.isNull(), own).when(is_sparse(own), raw).when(richer, raw).otherwise(own)
