"""Values in books and requests: clock values, dates, byte ranges, colours, numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(text: Column) -> Column:
    """Seconds of h:m:s, m:s, or a number with h, min, s or ms; null for anything else."""
    t = F.trim(text)
    parts = F.transform(F.split(t, ":"), lambda p: F.when(p.rlike(r"^[0-9]+([.][0-9]+)?$"), p.cast("double")))
    n = F.size(parts)
    last, minutes = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    hours = F.when(n == 3, F.try_element_at(parts, F.lit(1))).otherwise(0.0)
    sound = n.isin(2, 3) & (last < 60) & (minutes < 60) & (minutes == F.floor(minutes)) & (hours == F.floor(hours))
    number = F.regexp_extract(t, r"^([0-9]+([.][0-9]+)?)(h|min|ms|s)?$", 1)
    unit = F.regexp_extract(t, r"^([0-9]+([.][0-9]+)?)(h|min|ms|s)?$", 3)
    plain = F.when(number != "", number.cast("double") * F.when(unit == "h", 3600.0).when(unit == "min", 60.0).when(unit == "ms", 0.001).otherwise(1.0))
    seconds = F.when(F.contains(t, F.lit(":")), F.when(sound, hours * 3600 + minutes * 60 + last)).otherwise(plain)
    return F.when(seconds <= 9e9, seconds)


def clock_interval(text: Column) -> Column:
    """The same as a day-time interval."""
    return F.make_dt_interval(secs=clock_seconds(text))


def book_date(text: Column) -> Column:
    """A timestamp of a date, or of the first day of a year or month; impossible days give null."""
    t = F.trim(text)
    full = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).otherwise(t)
    return F.when(full.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(full))


def positive_integer(text: Column) -> Column:
    n = text.try_cast("int")
    return F.when(n > 0, n)


def byte_range(header: Column, length: Column) -> Column:
    """(status, start, end) of a Range header over `length` bytes: 206 with a half-open range, 416 if
    it can't be met, 200 without a header that is understood."""
    m = lambda g: F.nullif(F.regexp_extract(header, r"^bytes=([0-9]*)-([0-9]*)$", g), F.lit("")).cast("bigint")
    known = F.coalesce(header.rlike(r"^bytes=([0-9]+-[0-9]*|-[0-9]+)$"), F.lit(False))
    first, last = m(1), m(2)
    start = F.when(first.isNull(), F.greatest(length - last, F.lit(0).cast("bigint"))).otherwise(first)
    end = F.when(first.isNull() | last.isNull(), length).otherwise(F.least(last + 1, length))
    bad = (start >= length) | (end <= start) | (first.isNull() & (last == 0))
    return F.struct(
        F.when(~known, 200).when(bad, 416).otherwise(206).alias("status"),
        F.when(known & ~bad, start).alias("start"),
        F.when(known & ~bad, end).alias("end"),
    )


def checked_range(length: Column, start: Column, end: Column) -> Column:
    """Whether a half-open range lies within `length`; what reads are guarded by."""
    return (start >= 0) & (end >= start) & (end <= length)


def slice_bytes(content: Column, start: Column, end: Column) -> Column:
    """Bytes start to end; a range outside the content is an error, never a shorter answer."""
    ok = checked_range(F.octet_length(content), start, end)
    return F.when(ok, F.substring(content, (start + 1).cast("int"), (end - start).cast("int"))).otherwise(F.raise_error(F.lit("byte range outside the content")))


def channels(argb: Column) -> Column:
    """Alpha (0 to 1), red, green and blue of a 32-bit colour."""
    byte = lambda n: F.shiftright(argb, n).bitwiseAND(F.lit(255)).cast("int")
    return F.struct((byte(24) / 255.0).alias("alpha"), byte(16).alias("red"), byte(8).alias("green"), byte(0).alias("blue"))


def script_result(text: Column) -> Column:
    """JSON that a browser gave back: an object, or a string that holds one."""
    inner = F.try_variant_get(F.try_parse_json(text), "$", "string")
    return F.coalesce(F.when(F.startswith(F.trim(text), F.lit('"')), inner), text)
