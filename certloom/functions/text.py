"""Text columns: cleaning, tokens, label tests and codes.

Cleaners keep strings (a missing text becomes ''); functions that read a value
out of a text return null when there is none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from certloom import vocab

# Java's \s is ASCII only; records also hold no-break and ideographic spaces.
SPACE = "[\\s\u00a0\u3000]"
_STRIP = " \t\n\r\f\x0b\u00a0\u3000"
_TOKEN_JUNK = "[\\s\u00a0\u3000:：/\\\\\\-_.|*（）()]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``c`` once and hand it to ``use`` (SQL has no local names)."""
    return F.transform(F.array(c), use)[0]


def any_of(c: Column, words: Iterable[str]) -> Column:
    """True when the text contains at least one of the words."""
    return c.rlike(_contains_any(words))


def _one_of_words(words: list[str]) -> str:
    """Pattern of any of the words; words of one first character stand together, so that few are tried at a place."""
    if not words or not all(words):
        return "(?:" + "|".join(_quote(w) for w in words) + ")"
    rests: dict[str, list[str]] = {}
    for word in words:
        rests.setdefault(word[0], []).append(_quote(word[1:]))
    firsts = "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in rests)
    return f"(?=[{firsts}])(?:" + "|".join(f"{_quote(c)}(?:{'|'.join(r)})" for c, r in rests.items()) + ")"


def _contains_any(words: Iterable[str]) -> str:
    """Pattern that finds whether any of the words occurs; a word that holds another one isn't needed."""
    words = list(dict.fromkeys(words))
    return _one_of_words([w for w in words if not any(o in w for o in words if o != w)])


def _quote(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in word)


def literal_array(words: Iterable[str]) -> Column:
    """Constant array of strings."""
    return F.expr("array(" + ", ".join(_sql(w) for w in words) + ")")


def literal_map(pairs: dict[str, str]) -> Column:
    """Constant map of strings."""
    return F.expr("map(" + ", ".join(_sql(x) for pair in pairs.items() for x in pair) + ")")


def _sql(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(c: Column, words: Iterable[str]) -> Column:
    return c.isin(list(words))


# --- cleaning ---------------------------------------------------------------


def strip(c: Column | str) -> Column:
    return F.btrim(text(c), F.lit(_STRIP))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def null_as_empty(c: Column | str) -> Column:
    return text(c)


def squeeze(c: Column | str) -> Column:
    """Runs of spaces of any kind become one space; ends trimmed."""
    return strip(F.regexp_replace(text(c), SPACE + "+", " "))


def compact(c: Column | str) -> Column:
    """All spaces removed."""
    return F.regexp_replace(text(c), SPACE + "+", "")


def normalize_text(c: Column | str) -> Column:
    """Line ends unified, blanks squeezed inside lines, empty lines dropped."""
    out = F.regexp_replace(text(c), "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+", " ")
    return strip(F.regexp_replace(out, "\n{2,}", "\n"))


def _non_empty(lines: Column) -> Column:
    return F.filter(lines, lambda x: x != "")


def split_lines(c: Column | str) -> Column:
    """Trimmed, non-empty lines of a text as an array."""
    return _non_empty(F.transform(F.split(normalize_text(c), "\n"), strip))


def raw_lines(c: Column | str) -> Column:
    """Like split_lines, but blanks inside a line stay as they are."""
    return _non_empty(F.transform(F.split(text(c), "\r\n|\r|\n"), strip))


def squeezed_lines(c: Column | str) -> Column:
    return _non_empty(F.transform(F.split(text(c), "\r\n|\r|\n"), squeeze))


def keep_tabs_text(c: Column | str) -> Column:
    """Lines squeezed; cells of tab-separated lines squeezed one by one."""

    def line(raw: Column) -> Column:
        cells = F.transform(F.split(raw, "\t"), squeeze)
        tabbed = F.when(F.exists(cells, lambda x: x != ""), F.array_join(cells, "\t")).otherwise("")
        return F.when(raw.contains("\t"), tabbed).otherwise(squeeze(raw))

    return F.array_join(_non_empty(F.transform(F.split(text(c), "\r\n|\r|\n"), line)), "\n")


def token(c: Column | str) -> Column:
    """Comparison token: lower case, no spaces, no separators."""
    return F.lower(F.regexp_replace(text(c), _TOKEN_JUNK, ""))


def label_token(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(text(c), "[\\s\u3000:：]+", ""))


def match_text(c: Column | str) -> Column:
    """Lower case without spaces: the form in which names are searched."""
    return F.lower(compact(c))


def code_norm(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(text(c), "[^A-Za-z0-9]+", ""))


def fold_width(c: Column | str, o_to_0: bool = False, l_to_1: bool = False) -> Column:
    """Full-width ASCII to half-width; optionally o to 0 and l/I to 1."""
    wide = "".join(chr(n) for n in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(n) for n in range(0x21, 0x7F)) + " "
    out = F.translate(text(c), wide, narrow)
    if o_to_0:
        out = F.translate(out, "oO", "00")
    if l_to_1:
        out = F.translate(out, "lI", "11")
    return out


def clean_value(c: Column | str) -> Column:
    """Trim and cut leading colons, dashes and spaces."""
    return strip(F.regexp_replace(strip(c), "^[：:\\- ]+", ""))


def placeholder_to_null(c: Column | str) -> Column:
    """Squeezed cell; '-', '--', '—' and slashes count as missing."""
    value = squeeze(c)
    return F.when(~one_of(value, vocab.PLACEHOLDER_CELLS), value)


def optional_blank(c: Column | str) -> Column:
    """Null for separators only and for bare English date words."""

    def keep(value: Column) -> Column:
        blank = (value == "") | value.rlike(r"^[/\\;；|]+$") | one_of(match_text(value), vocab.DATE_WORDS)
        return F.when(~blank, value)

    return let(strip(c), keep)


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """Captured text or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_match(c: Column, patterns: Iterable[str]) -> Column:
    """Cleaned group 1 of the first pattern that yields a value."""
    return F.coalesce(*[F.nullif(clean_value(first_group(c, "(?i)" + p)), F.lit("")) for p in patterns])


def file_name(c: Column | str, fallback: str = "row") -> Column:
    """Path-unsafe characters to '_', outer dots cut, at most 80 characters; of a longer name the last nine are '_' and a hash of it all."""
    out = F.regexp_replace(text(c), r'[\\/:*?"<>|]+', "_")
    out = F.btrim(strip(out), F.lit("."))
    short = F.concat(F.substring(out, 1, 71), F.lit("_"), F.substring(F.md5(out.cast("binary")), 1, 8))
    return F.when(out == "", F.lit(fallback)).when(F.length(out) > 80, short).otherwise(out)


def replace_all(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def similarity_key(c: Column | str) -> Column:
    """Requirement text without numbering, punctuation and trailing modal word."""
    out = F.lower(squeeze(c))
    out = F.regexp_replace(out, r"^\(?\d+\)?[、.．)]?\s*", "")
    out = F.regexp_replace(out, r"[（）()【】\[\]{}《》“”\"'、,，.:：;；/\\|_+\-\s]", "")
    out = replace_all(out, vocab.SIMILARITY_SYNONYMS)
    return F.regexp_replace(out, "(结果|一般检查|应为|为|可以|能够|能|可|进行|满足|要求)$", "")


# --- codes and modes --------------------------------------------------------


def template_code(c: Column | str) -> Column:
    """'r-NNNx' or null."""
    digits = first_group(F.lower(compact(c)), r"(?:r[-_ ]?)?(\d{3}[a-z])")
    return F.concat(F.lit("r-"), digits)


def standard_codes(c: Column | str) -> Column:
    """All distinct 'XX/T NNN-YYYY' codes in order, in one spelling."""
    found = F.regexp_extract_all(
        text(c), F.lit(r"([A-Za-z]{1,5}\s*/\s*[Tt]\s*\d+(?:\.\d+)?-\d{4})"), F.lit(1))

    def spell(x: Column) -> Column:
        x = F.regexp_replace(squeeze(x), r"\s*/\s*", "/")
        return F.regexp_replace(x, r"(?i)/\s*T\s*", "/T ")

    return F.array_distinct(F.transform(found, spell))


def basis_mode(c: Column | str) -> Column:
    """'校准' or '检测': checked box first, then exclusive wording, then heading."""
    mark = "(?:☑|√|✔|■)"

    def choose(out: Column) -> Column:
        calibration, test = out.rlike("校准依据|校准地点"), out.rlike("检测依据|检测地点")
        return (
            F.when(out.rlike(f"{mark}校准|校准{mark}"), "校准")
            .when(out.rlike(f"{mark}检测|检测{mark}"), "检测")
            .when(calibration & ~test, "校准").when(test & ~calibration, "检测")
            .when(out.contains("校准结果"), "校准").when(out.contains("检测结果"), "检测"))

    return let(compact(c), choose)


def infer_basis_mode(c: Column | str) -> Column:
    out = squeeze(c)
    return F.when(out.rlike("校准证书|本次校准|校准日期|校准依据"), "校准").when(
        out.rlike("本次检测|检测日期|检测依据"), "检测")


# --- keys of measured series ------------------------------------------------


def unit_token(c: Column | str) -> Column:
    out = F.lower(compact(c))
    return replace_all(out, [("Ω", "Ω"), ("ω", "Ω"), ("ohm", "Ω"), ("欧姆", "Ω"), ("°c", "℃"), ("c", "℃")])


def semantic_key(c: Column | str) -> Column:
    """Numeric keys without trailing zeros; powers of ten as 'x10^n'; else lower case."""

    def build(value: Column) -> Column:
        power = F.regexp_extract(value, r"(?i)^[x×]\s*10\s*(?:\^)?\s*([+-]?\d+)$", 1)
        number = F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return (
            F.when(power != "", F.concat(F.lit("x10^"), power)).when(value.rlike(r"^[+-]?\d+\.\d+$"), number)
            .otherwise(F.lower(value)))

    return let(strip(F.regexp_replace(F.replace(squeeze(c), F.lit(","), F.lit("")), "[ΩΩω]$", "")), build)


def series_label(c: Column | str) -> Column:
    out = F.regexp_replace(squeeze(c), r"^\s*(?:[（(]\d+[)）]|\d+[、.．)])\s*", "")
    out = replace_all(F.lower(compact(out)), [("Ω", "Ω"), ("ω", "Ω")])
    out = F.regexp_replace(out, "校准值|实测值|实际值|示值|显示值|测量值|读数", "值")
    out = F.regexp_replace(out, "标称值|标准值|设定值", "标值")
    return F.regexp_replace(out, r"[：:;；，,。．\[\]【】（）()<>《》]", "")


# --- label and quality tests ------------------------------------------------

LABEL_FIELDS: dict[str, str] = {}
for _field, _labels in vocab.TEXT_LABELS.items():
    for _label in _labels:
        _key = "".join(_label.split()).replace(":", "").replace("：", "").lower()
        LABEL_FIELDS[_key] = _field
LABEL_TOKENS_LONGEST_FIRST = sorted(LABEL_FIELDS, key=len, reverse=True)


def known_label(c: Column | str) -> Column:
    """Known label inside a text: exact token, else the longest contained one."""

    def pick(t: Column) -> Column:
        contained = F.filter(literal_array(LABEL_TOKENS_LONGEST_FIRST), lambda k: F.contains(t, k))
        return F.when(one_of(t, LABEL_FIELDS), t).when(
            any_of(t, LABEL_TOKENS_LONGEST_FIRST), F.get(contained, F.lit(0)))

    return let(label_token(clean_value(c)), pick)


def label_field(label: Column) -> Column:
    """Field of a known label token."""
    return F.try_element_at(literal_map(LABEL_FIELDS), F.coalesce(label, F.lit("")))


def is_placeholder_name(c: Column | str) -> Column:
    return one_of(token(c), vocab.PLACEHOLDER_NAMES)


def is_placeholder_model(c: Column | str) -> Column:
    return any_of(token(c), vocab.PLACEHOLDER_MODEL_MARKS)


def is_placeholder_code(c: Column | str) -> Column:
    return one_of(token(c), vocab.PLACEHOLDER_CODES)


_LABEL_LINE = (
    "^" + _one_of_words(vocab.LABEL_LINE_TOKENS) + "$|" + _contains_any(vocab.LABEL_LINE_MARKS))
_POOR_LABEL = "^$|" + _contains_any(["measurementrange", "测量范围", *LABEL_TOKENS_LONGEST_FIRST])
_POOR_TOKEN = (
    "^" + _one_of_words([*vocab.LABEL_LINE_TOKENS, *vocab.PLACEHOLDER_NAMES, *vocab.PLACEHOLDER_CODES]) + "$|"
    + _contains_any([*vocab.LABEL_LINE_MARKS, *vocab.PLACEHOLDER_MODEL_MARKS]))


def looks_like_label_line(c: Column | str) -> Column:
    return any_of(label_token(clean_value(c)), LABEL_TOKENS_LONGEST_FIRST) | token(c).rlike(_LABEL_LINE)


def is_poor_candidate(c: Column | str) -> Column:
    """Empty, label-like or placeholder text: no value for a label."""
    return label_token(c).rlike(_POOR_LABEL) | token(c).rlike(_POOR_TOKEN)


def is_low_quality(field: str, c: Column | str) -> Column:
    """Per-field test whether a value should give way to a better one."""

    def test(x: Column) -> Column:
        poor = (x == "") | is_poor_candidate(x)
        words = vocab.FIELD_LABEL_TOKENS.get(field)
        if words:
            poor = poor | one_of(token(x), words)
        if field == "device_code":
            poor = poor | (~x.rlike(r"\d") & ~compact(x).rlike("[A-Za-z]{2,}"))
        elif field.endswith("_date") and field in vocab.FIELD_LABEL_TOKENS:
            month = F.regexp_extract(x, r"(\d{4})\D*(\d{1,2})\D*(\d{1,2})", 2).try_cast("int")
            day = F.regexp_extract(x, r"(\d{4})\D*(\d{1,2})\D*(\d{1,2})", 3).try_cast("int")
            poor = poor | ~F.coalesce(month.between(1, 12) & day.between(1, 31), F.lit(False))
        return poor

    return let(clean_value(c), test)


def is_meaningful(c: Column | str) -> Column:
    """A value a report can be made from."""

    def test(value: Column) -> Column:
        words = "^(?:" + "|".join(_quote(w) for w in vocab.MEANINGLESS_TOKENS) + ")?$"
        return (value != "") & ~value.rlike("^[-/—–_]+$") & ~token(value).rlike(words)

    return let(strip(c), test)


def looks_like_label(c: Column | str) -> Column:
    """Label words standing where a value was expected."""

    def test(x: Column) -> Column:
        letters = F.regexp_replace(F.lower(x), "[^a-z]", "")
        wordy = letters.rlike("model|specification|serial|number|manufacturer|measurement|range|traceability|institution")
        return (
            x.rlike("[:：]$") | x.contains("溯源机构名称") | one_of(letters, vocab.LABEL_VALUE_WORDS)
            | (wordy & ~x.rlike(r"\d"))
        )

    return let(squeeze(c), test)


def context_value(c: Column | str) -> Column:
    value = squeeze(c)
    return F.when((value != "") & ~looks_like_label(value), value)


# --- model and code cleaning ------------------------------------------------


# 'English label:' in front of a value, any number of times, but not the left half of 'MODEL:CODE'
_MODEL_CODE = (
    r"(?=[^:：]*[A-Za-z])(?:[A-Za-z0-9\-_./]\s*){4,80}[:：][：:\-\s]*[A-Za-z0-9\-_./]{3,60}\s*$")
_ENGLISH_LABELS = (
    rf"^(?:(?!{_MODEL_CODE})(?=[^:：]*[A-Za-z])[A-Za-z0-9\s/().,_-]{{2,120}}[:：][：:\-\s]*(?=\S))+")


def strip_english_label(c: Column | str) -> Column:
    """Cut leading 'English label:' prefixes, but keep 'MODEL:CODE' pairs."""
    return clean_value(F.regexp_replace(clean_value(c), _ENGLISH_LABELS, ""))


_TAIL = r"(?is)(输出容量|额定功率|Rated power).*$"


def clean_code(c: Column | str) -> Column:
    """Device code without labels, trailing rating text and inner spaces."""
    out = strip_english_label(c)
    out = F.regexp_replace(
        out, r"(?i)^(?:出厂编号|设备编号|气瓶编号|编号|No\.?|Serial(?:\s*No\.?)?|Number)\s*[:：]?\s*", "")
    out = F.btrim(F.regexp_replace(out, _TAIL, ""), F.lit(" /|;,"))
    return let(out, lambda x: F.when(compact(x).rlike(r"^[A-Za-z0-9\-_./]+$"), compact(x)).otherwise(x))


def clean_model(c: Column | str) -> Column:
    """Device model without labels."""
    out = F.regexp_replace(
        clean_value(c),
        r"(?i)^(?:型号/编号|型号规格|规格型号|型号|model/specification|model|specification|"
        r"type\s*model|instrument\s*serial\s*number|serial\s*number|number)\s*[:：]?\s*", "")
    return F.btrim(strip_english_label(out), F.lit(" /|;,"))


def model_label_noise(c: Column | str) -> Column:
    """The lighter model cleaner used on whole lines."""
    out = strip(F.regexp_replace(clean_value(c), r"^(?:型号\s*/\s*编号|型号规格|型号|编号)\s*[:：]?\s*", ""))
    return F.when(out.rlike(r"^[/:：\- ]*$") | out.rlike(r"^/?\s*编号\s*[:：]?\s*$"), F.lit("")).otherwise(out)


def model_tail_noise(c: Column | str) -> Column:
    out = F.regexp_replace(clean_value(c), r"(?is)(输出容量|额定功率|Rated power|出厂编号|编号|Number|Serial).*$", "")
    return F.btrim(out, F.lit(" /|;,"))


def split_model_code(c: Column | str) -> Column:
    """struct(model, code) of 'model:code'; both null when it is not such a pair."""

    def test(parts: Column) -> Column:
        pair = F.struct(
            clean_model(F.get(parts, F.lit(0))).alias("model"),
            clean_code(F.element_at(parts, -1)).alias("code"))

        def keep(p: Column) -> Column:
            ok = (
                (p["model"] != "") & (p["code"] != "") & ~is_placeholder_model(p["model"])
                & ~is_placeholder_code(p["code"]))
            return F.struct(F.when(ok, p["model"]).alias("model"), F.when(ok, p["code"]).alias("code"))

        none = F.struct(F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("code"))
        return F.when(F.size(parts) >= 2, let(pair, keep)).otherwise(none)

    parts = F.filter(F.transform(F.split(clean_value(c), "[:：]"), strip), lambda x: x != "")
    return let(parts, test)


def split_combined(c: Column | str) -> Column:
    """struct(model, code) of 'model:code', 'model/code' or 'model|code'."""
    parts = F.filter(F.transform(F.split(squeeze(c), "[:：/|]"), squeeze), lambda x: x != "")

    def test(p: Column) -> Column:
        left = context_value(F.get(p, F.lit(0)))
        right = context_value(F.get(p, F.lit(1)))
        both = left.isNotNull() & right.isNotNull()
        return F.struct(
            F.when(both, left).otherwise(context_value(c)).alias("model"), F.when(both, right).alias("code"))

    return let(parts, test)


def looks_like_measurement_row(
    name: Column, model: Column, code: Column, measurement_range: Column, uncertainty: Column,
    certificate: Column, traceability: Column,
) -> Column:
    """A catalogue row that carries measurement data, not a heading."""
    name_t = token(placeholder_to_null(name))
    header = (
        (name_t == "") | one_of(name_t, vocab.CATALOG_NAME_TOKENS)
        | name_t.contains("mainmeasurementstandardinstrumentsusedinthiscalibration")
        | name_t.contains("measurementrange") | name_t.contains("certificatenumber"))
    cells = [placeholder_to_null(c) for c in (model, code, measurement_range, uncertainty, certificate, traceability)]
    filled = sum((c.isNotNull().cast("int") for c in cells), F.lit(0))
    shaped = (
        text(cells[2]).rlike(r"(?i)(?:~|～|\(|\)|mm|cm|m|℃|°c|kv|mv|v|a|μa|hz)")
        | text(cells[4]).rlike(r"(?:\d{4}年\d{1,2}月\d{1,2}日|[A-Za-z]\d{5,}|[A-Za-z]{1,6}[-/][A-Za-z0-9-]{3,})")
        | F.replace(text(cells[1]), F.lit(" "), F.lit("")).rlike("^[A-Za-z]{1,4}[A-Za-z0-9-]{2,}$"))
    return ~header & ((filled >= 2) | shaped)
