"""Date functions, on ISO 8601 text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import Value, fn, python

LETTERS = [("yyyy", "%Y"), ("yy", "%y"), ("MMMM", "%B"), ("MMM", "%b"), ("MM", "%m"), ("M", "%m"), ("dd", "%d"), ("d", "%d"), ("HH", "%H"), ("H", "%H"), ("hh", "%I"), ("h", "%I"), ("mm", "%M"), ("m", "%M"), ("ss", "%S"), ("s", "%S"), ("SSS", "%f"), ("S", "%f"), ("EEEE", "%A"), ("EEE", "%a"), ("DDD", "%j"), ("D", "%j"), ("a", "%p"), ("Z", "%z"), ("z", "%Z")]


def strptime_pattern(pattern: str) -> str:
    """A pattern of letters (yyyy-MM-dd) as strptime knows it; text between apostrophes is itself."""
    out, k = "", 0
    while k < len(pattern):
        if pattern[k] == "'":
            end = pattern.find("'", k + 1)
            end = len(pattern) if end < 0 else end
            out, k = out + pattern[k + 1 : end], end + 1
            continue
        for letters, code in LETTERS:
            if pattern.startswith(letters, k):
                out, k = out + code, k + len(letters)
                break
        else:
            out, k = out + pattern[k], k + 1
    return out


SPARK_SAFE = {"yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy"}


def iso(ts: Column) -> Column:
    """ISO text of a timestamp, as isoformat() writes it."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


@fn("grel:date_toDate", value="valueParameter", pattern="p_string_pattern")
def to_date(value: Value, pattern: Value | None = None) -> Value:
    if pattern is None:
        return Value(iso(stamp(value)))
    if pattern.constant in SPARK_SAFE:
        return Value(iso(F.try_to_timestamp(value.text, F.lit(pattern.constant))))
    return Value(python(lambda t, p: datetime.strptime(t, strptime_pattern(p)).isoformat(), value.text, pattern.text))


@fn("bi:date_toDate", value="valueParameter", pattern="p_string_pattern")
def to_date_python(value: Value, pattern: Value) -> Value:
    return Value(python(lambda t, p: datetime.strptime(t, p).isoformat(), value.text, pattern.text))


@fn("grel:date_now")
def now() -> Value:
    return Value(iso(F.current_timestamp()))


def stamp(v: Value) -> Column:
    return F.try_to_timestamp(F.replace(F.trim(v.text), F.lit("T"), F.lit(" ")))


@fn("grel:date_diff", first="p_datetime_d", second="p_datetime_d2", unit="p_string_timeunit")
def date_diff(first: Value, second: Value, unit: Value) -> Value:
    """The absolute difference in whole units: d, h, m, s, or w for weeks (with a fraction)."""
    from ..operators.lexical import py_float

    seconds = F.floor(F.abs(F.unix_micros(stamp(first)) - F.unix_micros(stamp(second))) / 1_000_000)
    u = unit.text
    return Value(
        F.when(u.isin("d", "days"), F.floor(seconds / 86_400).cast("string"))
        .when(u.isin("h", "hours"), F.floor(seconds / 3_600).cast("string"))
        .when(u.isin("m", "minutes"), F.floor(seconds / 60).cast("string"))
        .when(u.isin("s", "seconds"), seconds.cast("string"))
        .when(u.isin("w", "weeks"), py_float(F.floor(seconds / 86_400) / 7))
    )


@fn("compat:grel:date_diff", first="p_datetime_d", second="p_datetime_d2", unit="p_string_timeunit")
def old_date_diff(first: Value, second: Value, unit: Value) -> Value:
    """As date_diff, but hours are sixty times, and seconds are, the seconds of the last day begun."""
    rest = F.pmod(F.floor(F.abs(F.unix_micros(stamp(first)) - F.unix_micros(stamp(second))) / 1_000_000), F.lit(86_400))
    u = unit.text
    return Value(F.when(u.isin("h", "hours"), (rest * 60).cast("string")).when(u.isin("s", "seconds"), rest.cast("string")).otherwise(date_diff(first, second, unit).col))


@fn("grel:date_datePart", value="p_date_d", unit="p_string_unit")
def date_part(value: Value, unit: Value) -> Value:
    t, u = stamp(value), F.lower(unit.text)
    return Value(
        F.when(u.isin("years", "year"), F.year(t).cast("string"))
        .when(u.isin("months", "month"), F.month(t).cast("string"))
        .when(u.isin("days", "day", "d"), F.dayofmonth(t).cast("string"))
        .when(u.isin("weeks", "week", "w"), (F.floor((F.dayofmonth(t) - 1) / 7) + 1).cast("string"))
        .when(u == "weekday", F.date_format(t, "EEEE"))
        .when(u.isin("hours", "hour", "h"), F.hour(t).cast("string"))
        .when(u.isin("minutes", "minute", "min"), F.minute(t).cast("string"))
        .when(u.isin("seconds", "sec", "s"), F.second(t).cast("string"))
        .when(u.isin("milliseconds", "ms"), F.floor(F.date_format(t, "SSSSSS").cast("int") / 1000).cast("string"))
        .when(u.isin("nanos", "nano", "n"), (F.date_format(t, "SSSSSS").cast("long") * 1000).cast("string"))
        .when(u == "time", F.unix_millis(t).cast("string"))
    )


@fn("grel:date_inc", value="p_date_d", by="p_dec_n", unit="p_string_unit")
def date_inc(value: Value, by: Value, unit: Value) -> Value:
    """Days that a month lacks become its last."""
    t, u = stamp(value), F.lower(unit.text)
    n = F.floor(by.text.cast("double")).cast("int")
    zero = F.lit(0)
    return Value(
        iso(
            t
            + F.make_interval(
                F.when(u.isin("years", "year"), n).otherwise(zero), F.when(u.isin("months", "month"), n).otherwise(zero), F.when(u.isin("weeks", "week", "w"), n).otherwise(zero), F.when(u.isin("days", "day", "d"), n).otherwise(zero),
                F.when(u.isin("hours", "hour", "h"), n).otherwise(zero), F.when(u.isin("minutes", "minute", "min"), n).otherwise(zero), F.when(u.isin("seconds", "sec", "s"), n).otherwise(zero).cast("decimal(18,6)"),
            )
        )
    )
