"""Timestamps, calendar keys and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def rfc3339(text: Column) -> Column:
    """An RFC 3339 text as a timestamp; null for anything else, a bare date included."""
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(F.upper(text)))


def epoch_ms(ms: Column) -> Column:
    """Milliseconds since the epoch (fractions too) as a timestamp; null if not finite or out of range."""
    micros = F.round(ms.cast("double") * 1000)
    fits = F.abs(micros) <= F.lit(8.2e18)
    return F.when(fits & ~F.isnan(micros), F.timestamp_micros(micros.cast("long")))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def plus_micros(ts: Column, delta: Column | int) -> Column:
    """A timestamp moved by microseconds, held within the range that dates can show."""
    low, high = -62_135_596_800_000_000, 253_402_300_799_999_999
    moved = F.try_add(F.unix_micros(ts), delta if isinstance(delta, Column) else F.lit(delta).cast("long"))
    past = F.when((delta if isinstance(delta, Column) else F.lit(delta)) > 0, F.lit(high)).otherwise(F.lit(low))
    return F.timestamp_micros(F.greatest(F.least(F.coalesce(moved, past), F.lit(high)), F.lit(low)))


def local_midnight(date: Column, noon_rule: bool = False) -> Column:
    """The first instant of a local date.

    Where a clock change skips midnight this is the first valid instant; with
    ``noon_rule`` it is local noon instead.
    """
    start = date.cast("timestamp")
    if not noon_rule:
        return start
    noon = F.make_timestamp(F.year(date), F.month(date), F.dayofmonth(date), F.lit(12), F.lit(0), F.lit(0))
    return F.when(F.hour(start) == 0, start).otherwise(noon)


def local_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def local_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def calendar_days(first: Column, last: Column) -> Column:
    """Days from the first local date to the last, both counted; 0 if there is none."""
    days = F.greatest(F.datediff(F.to_date(last), F.to_date(first)), F.lit(0)) + 1
    return F.coalesce(days, F.lit(0)).cast("long")


def round3(x: Column) -> Column:
    """Three decimals, ties to even, never a negative zero."""
    return F.rint(x.cast("double") * 1000) / 1000 + F.lit(0.0)


def seconds(us: Column) -> Column:
    """Microseconds as rounded seconds."""
    return round3(us / F.lit(1_000_000.0))


def iso(ts: Column) -> Column:
    """UTC text with offset; microseconds only where there are any."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.unix_micros(ts) % 1_000_000 == 0
    text = F.when(whole, F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    return F.concat(text, F.lit("+00:00"))


def bound(text: Column, until: bool) -> Column:
    """``yyyy-MM`` or ``yyyy-MM-dd`` as the instant a window starts or, with ``until``, ends (exclusive)."""
    month = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    if until:
        month, day = F.add_months(month, 1), F.date_add(day, 1)
    return local_midnight(F.coalesce(month, day))


def span(unit: str, reference: Column, back: int = 0) -> tuple[Column, Column]:
    """Half-open month or year around a reference instant, ``back`` units earlier."""
    step = {"month": 1, "year": 12}[unit]
    start = F.add_months(F.to_date(F.date_trunc(unit, reference)), -step * back)
    return local_midnight(start), local_midnight(F.add_months(start, step))
