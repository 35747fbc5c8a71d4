"""Dates as they are written in the records: 'YYYY年MM月DD日', 'M.D', 'YY.MM'."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from certloom.functions.text import first_group, let, squeeze, strip, text

_YMD = r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})"
_YMD_SHORT = r"(\d{4}|\d{2})\D+(\d{1,2})\D+(\d{1,2})"


def cn_date(d: Column) -> Column:
    return F.date_format(d, "yyyy年MM月dd日")


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def _as_date(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-MM-dd")


def parse_date_cn(c: Column | str, strict: bool = True, two_digit_year: bool = False) -> Column:
    """First year-month-day in a text as 'YYYY年MM月DD日', or null.

    strict: the day must exist in the calendar; otherwise month <= 12 and
    day <= 31 suffice. two_digit_year: '24' counts as 2024.
    """
    pattern = _YMD_SHORT if two_digit_year else _YMD

    def build(x: Column) -> Column:
        year = F.regexp_extract(x, pattern, 1)
        if two_digit_year:
            year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
        month, day = F.regexp_extract(x, pattern, 2), F.regexp_extract(x, pattern, 3)
        found = year != ""
        if strict:
            return F.when(found, cn_date(_as_date(_iso(year, month, day))))
        ok = month.try_cast("int").between(1, 12) & day.try_cast("int").between(1, 31)
        return F.when(found & ok, _cn_parts(year, month, day))

    return let(text(c), build)


def _cn_parts(year: Column, month: Column, day: Column) -> Column:
    def two(x: Column) -> Column:
        return F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)

    return F.concat(year, F.lit("年"), two(month), F.lit("月"), two(day), F.lit("日"))


def to_date_cn(c: Column | str) -> Column:
    """Calendar date of the first year-month-day in a text."""

    def build(x: Column) -> Column:
        return _as_date(_iso(*[F.regexp_extract(x, _YMD, n) for n in (1, 2, 3)]))

    return let(text(c), build)


def add_days(c: Column | str, days: int) -> Column:
    return cn_date(F.date_add(to_date_cn(c), days))


def any_date(c: Column | str) -> Column:
    """Only dates with units or plain separators ('2024年1月2日', '2024-1-2')."""
    marked, plain = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", r"(\d{4})[./-](\d{1,2})[./-](\d{1,2})"

    def build(x: Column) -> Column:
        def read(p: str) -> Column:
            year = first_group(x, p, 1)
            return F.when(year.isNotNull(), _cn_parts(year, F.regexp_extract(x, p, 2), F.regexp_extract(x, p, 3)))

        return F.coalesce(read(marked), read(plain))

    return let(squeeze(c), build)


def context_date(c: Column | str) -> Column:
    """The first three numbers of a text read as year, month, day."""
    digits = F.regexp_extract_all(text(c), F.lit(r"(\d+)"), F.lit(1))
    return let(digits, lambda d: F.when(
        F.size(d) >= 3, _cn_parts(F.get(d, F.lit(0)), F.get(d, F.lit(1)), F.get(d, F.lit(2)))))


def iso_date(c: Column | str) -> Column:
    """'YYYY-MM-DD' of a whole-cell date, or null."""
    pattern = r"^(\d{4})(?:[-/.](\d{1,2})[-/.](\d{1,2})|年(\d{1,2})月(\d{1,2})日?)$"

    def build(value: Column) -> Column:
        month = F.concat(F.regexp_extract(value, pattern, 2), F.regexp_extract(value, pattern, 4))
        day = F.concat(F.regexp_extract(value, pattern, 3), F.regexp_extract(value, pattern, 5))
        return F.when(value.rlike(pattern), _iso(F.substring(value, 1, 4), month, day))

    return let(strip(c), build)


def first_iso_date(*columns: Column | str) -> Column:
    """ISO form of the first usable date of several columns."""
    dates = [context_date(c) for c in columns]
    usable = F.coalesce(*dates)
    return F.regexp_replace(F.regexp_replace(usable, "[年月]", "-"), "日", "")


def unify_dates(receive: Column | str, calibration: Column | str) -> Column:
    """struct(receive, calibration): both become calibration, else receive; unparsed kept."""
    base = F.coalesce(parse_date_cn(calibration), parse_date_cn(receive))

    def build(b: Column) -> Column:
        return F.struct(
            F.coalesce(b, strip_null(receive)).alias("receive"),
            F.coalesce(b, strip_null(calibration)).alias("calibration"))

    return let(base, build)


def strip_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def infer_dates(receive: Column | str, calibration: Column | str, release: Column | str) -> Column:
    """struct(receive, calibration, release): gaps filled from each other.

    Receive and calibration stand in for each other; release is the day after;
    with release alone the other two are the day before.
    """

    def valid(c: Column | str) -> Column:
        return F.when(to_date_cn(c).isNotNull(), strip(c))

    def build(s: Column) -> Column:
        base = F.coalesce(s["c"], s["r"])
        before = add_days(s["p"], -1)
        return F.struct(
            F.coalesce(s["r"], s["c"], before).alias("receive"),
            F.coalesce(s["c"], s["r"], before).alias("calibration"),
            F.coalesce(s["p"], add_days(base, 1)).alias("release"))

    return let(F.struct(valid(receive).alias("r"), valid(calibration).alias("c"), valid(release).alias("p")), build)


def month_day(c: Column | str) -> Column:
    """'M.D' of the first month-day in a text (leading z reads as 2), or null."""
    pattern = r"([zZ]\d{0,2}|\d{1,2})\s*[.\-/、]\s*(\d{1,2})"

    def build(x: Column) -> Column:
        month = F.regexp_replace(F.regexp_extract(x, pattern, 1), "^[zZ]", "2").try_cast("int")
        day = F.regexp_extract(x, pattern, 2).try_cast("int")
        return F.when(
            month.between(1, 12) & day.between(1, 31),
            F.concat(month.cast("string"), F.lit("."), day.cast("string")))

    return let(strip(c), build)


def year_month(c: Column | str) -> Column:
    """struct(value 'YY.MM', flipped): a month in first place is swapped."""
    cleaned = F.translate(strip(c), "oOlI，。年/-", "0011.....")
    cleaned = F.btrim(F.regexp_replace(F.replace(cleaned, F.lit("月"), F.lit("")), "[\\s\u3000]+", ""), F.lit("."))

    def build(x: Column) -> Column:
        left, right = F.regexp_extract(x, r"^(\d{1,4})\.+(\d{1,4})$", 1), F.regexp_extract(x, r"^(\d{1,4})\.+(\d{1,4})$", 2)
        a, b = left.try_cast("int"), right.try_cast("int")
        straight = (a.between(0, 99) & b.between(1, 12)) | ((F.length(left) == 4) & b.between(1, 12))
        turned = (a.between(1, 12) & b.between(0, 99)) | (a.between(1, 12) & (F.length(right) == 4))
        small_first = a.between(0, 99) & b.between(1, 12)
        small_turned = a.between(1, 12) & b.between(0, 99)

        def form(year: Column, month: Column) -> Column:
            short = F.when(F.length(year) >= 2, F.right(year, F.lit(2))).otherwise(F.lpad(year, 2, "0"))
            return F.concat(short, F.lit("."), F.lpad(month.cast("string"), 2, "0"))

        flip = F.when(small_first, False).when(small_turned, True).when(straight, False).when(turned, True)
        value = F.when(flip, form(right, a)).when(~flip, form(left, b))
        return F.struct(value.alias("value"), F.coalesce(flip, F.lit(False)).alias("flipped"))

    return let(cleaned, build)


def default_today(c: Column | str, ref_date: date, mixed: Column | bool = False) -> Column:
    """A given day fills an empty, non-mixed field."""
    is_mixed = F.lit(mixed) if isinstance(mixed, bool) else mixed
    return F.when((strip(c) == "") & ~is_mixed, cn_date(F.lit(ref_date))).otherwise(strip_null(c))
