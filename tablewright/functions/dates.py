"""Dates in text: the shape of a value decides how it's read, so that a column may mix shapes.

A value is a date, a time, or a date and a time: year first (2024-01-31, 2024/1/31, 2024.1.31, 20240131, 2024-01), year last
(1/31/2024, 31.1.24), or with the name of a month (Jan 31, 2024, 31 January 2024, 31-Jan-2024), each after the name of a weekday or
without it; times have seconds, fractions and AM or PM or not; a zone (Z, UTC, GMT, +01:00) is left out, and the clock's time is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English names of months and weekdays.
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAY_NAME = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+"
ZONE = r"(?i)(?<=[0-9]|[AP]M)\s*(?:Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})$"
TIME = r"(?i)(?:^|[T\s])\s*([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?\s*([AP]M)?$"
#: Shapes of dates as year, then the two others, then what they are.
YEAR_FIRST, YEAR_LAST = r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})$", r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})$"
DIGITS, YEAR_MONTH = r"^([0-9]{4})([0-9]{2})([0-9]{2})$", r"^([0-9]{4})[-/]([0-9]{1,2})$"
NAME_FIRST, NAME_SECOND = r"^([A-Za-z]{3,9})\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})$", r"^([0-9]{1,2})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{3,9})\.?[\s,-]+([0-9]{4})$"


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), where value is worked out once, however often made refers to it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _clock(text: Column) -> Column:
    """The text without a weekday before it and, if it has a time, without its zone."""
    plain = F.regexp_replace(F.trim(text), F.lit(WEEKDAY_NAME), F.lit(""))
    return _with(plain, lambda p: F.when(F.contains(p, F.lit(":")), F.regexp_replace(p, F.lit(ZONE), F.lit(""))).otherwise(p))


def _day(clock: Column) -> Column:
    """What is left without the time."""
    return F.when(F.contains(clock, F.lit(":")), F.rtrim(F.regexp_replace(F.regexp_replace(clock, F.lit(TIME), F.lit("")), F.lit(r",$"), F.lit("")))).otherwise(clock)


def _whole(text: Column) -> Column:
    return text.try_cast("int")


def _year_and_two(day: Column) -> Column:
    """year|month|day as an array, with a name for the month where there is one; of a date with the year last year|first|second|x."""
    shapes = [(YEAR_FIRST, "$1|$3|$4"), (YEAR_LAST, "$4|$1|$3|x"), (NAME_FIRST, "$3|$1|$2"), (NAME_SECOND, "$3|$2|$1"), (DIGITS, "$1|$2|$3"), (YEAR_MONTH, "$1|$2|1")]
    told = (F.when(F.regexp_like(day, F.lit(p)), F.regexp_replace(day, F.lit(p), F.lit(to))) for p, to in shapes)
    return F.split(F.coalesce(F.when(day == "", F.lit("1970|1|1")), *told), r"\|")


def _date(parts: Column, day_first: bool | Column) -> Column:
    """year, month, day as a struct."""
    months = F.create_map(*(F.lit(x) for i, name in enumerate(MONTH_NAMES, 1) for key in sorted({name, name[:3], "sept" if i == 9 else name}) for x in (key, i)))
    of = F.struct(_whole(F.get(parts, 0)).alias("y"), F.coalesce(_whole(F.get(parts, 1)), F.try_element_at(months, F.lower(F.get(parts, 1)))).alias("a"), _whole(F.get(parts, 2)).alias("b"), (F.size(parts) == 4).alias("free"), F.length(F.get(parts, 0)).alias("digits"))

    def told(x: Column) -> Column:
        year = F.when(x["free"] & (x["digits"] == 2), x["y"] + F.when(x["y"] >= 69, 1900).otherwise(2000)).otherwise(x["y"])
        # the second part is the month, where that is wanted or the only way
        swap = x["free"] & (x["b"] <= 12) & ((day_first if isinstance(day_first, Column) else F.lit(day_first)) | (x["a"] > 12))
        return F.struct(year.alias("year"), F.when(swap, x["b"]).otherwise(x["a"]).alias("month"), F.when(swap, x["a"]).otherwise(x["b"]).alias("day"))

    return _with(of, told)


def _seconds(clock: Column) -> Column:
    """hour, minute, second as a struct, 0 without a time."""
    split = F.split(F.regexp_replace(F.regexp_extract(clock, TIME, 0), F.lit(TIME), F.lit("$1|$2|$3|$4|$5")), r"\|")

    def told(t: Column) -> Column:
        hour, half = _whole(F.get(t, 0)), F.upper(F.get(t, 4))
        second = F.concat(F.when(F.get(t, 2) == "", F.lit("0")).otherwise(F.get(t, 2)), F.lit("."), F.rpad(F.substring(F.get(t, 3), 1, 6), 6, "0")).try_cast("decimal(16,6)")
        own = F.struct(F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0)).alias("hour"), _whole(F.get(t, 1)).alias("minute"), second.alias("second"))
        return F.when(F.size(t) == 5, own).otherwise(F.struct(F.lit(0).alias("hour"), F.lit(0).alias("minute"), F.lit(0).cast("decimal(16,6)").alias("second")))

    return _with(split, told)


def parsed_date(text: Column, day_first: bool | Column = False) -> Column:
    """The value as timestamp, null where no shape fits or the parts make no date. A time alone is one of 1970-01-01.

    Of a date with the year last, the month comes first, or second with day_first; where that makes no month, the other
    one does. Years of two digits are 1969 to 2068.
    """

    def told(clock: Column) -> Column:
        both = F.struct(_with(_with(_day(clock), _year_and_two), lambda p: _date(p, day_first)).alias("d"), _seconds(clock).alias("t"))
        made = _with(both, lambda x: F.try_make_timestamp(x["d"]["year"], x["d"]["month"], x["d"]["day"], x["t"]["hour"], x["t"]["minute"], x["t"]["second"]))
        return F.when(clock != "", made)

    return _with(_clock(text), told)


def counted_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, text, n: how many rows have each text of each column, so that one is read once however often it stands there."""
    made = F.array(*(F.struct(F.lit(c).alias("column"), F.col("`" + c.replace("`", "``") + "`").cast("string").alias("text")) for c in columns))
    return df.select(F.inline(made)).groupBy("column", "text").agg(F.count("*").alias("n"))


def day_first(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Whether dates of each column with the year last begin with the day: some first part is over 12, and no second part is. One job for all columns."""
    return counted_day_first(counted_texts(df, columns), columns) if columns else {}


def counted_day_first(texts: DataFrame, columns: list[str]) -> dict[str, bool]:
    """day_first() of counted_texts()."""
    parts = _with(_with(_clock(F.col("text")), _day), lambda day: F.struct(_whole(F.regexp_extract(day, YEAR_LAST, 1)).alias("a"), _whole(F.regexp_extract(day, YEAR_LAST, 3)).alias("b")))
    rows = texts.select("column", parts.alias("p")).groupBy("column").agg(F.max("p.a").alias("a"), F.max("p.b").alias("b")).collect()  # a row for each column
    found = {r.column: (r.a or 0) > 12 >= (r.b or 0) for r in rows}
    return {c: found.get(c, False) for c in columns}
