"""Small column helpers: time units, finiteness, safe arithmetic."""

from __future__ import annotations

import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(x: Column, n: int) -> Column:
    """x // n of whole numbers, exact for all of them: a division of doubles is not, beyond 2**53."""
    return F.call_function("div", x - F.pmod(x, F.lit(n).cast("long")), F.lit(n).cast("long"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp of either kind, or a date."""
    return floor_div(F.unix_micros(ts.cast("timestamp")), 1000)


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_ms(ms: Column) -> Column:
    """A zone-less timestamp from milliseconds since 1970 (UTC)."""
    return F.timestamp_millis(ms.cast("long")).cast("timestamp_ntz")


def instant(value: datetime.datetime | str | int | float) -> datetime.datetime:
    """A naive UTC time from a datetime, ISO text (also without seconds) or epoch milliseconds."""
    if isinstance(value, int | float):
        return datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=value)
    if isinstance(value, str):
        value = datetime.datetime.fromisoformat(value.replace("Z", "+00:00"))
    return value.astimezone(datetime.UTC).replace(tzinfo=None) if value.tzinfo else value


def at(value: datetime.datetime | str | int | float) -> Column:
    """A literal that compares natively with a timestamp column, so that the comparison reaches the file scan."""
    return F.lit(instant(value)).cast("timestamp_ntz")


def finite(x: Column) -> Column:
    """x as a double, null unless finite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def zero_filled(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def over(a: Column, b: Column) -> Column:
    """a / b in doubles; null for a zero divisor."""
    return F.when(b != 0, a / F.when(b != 0, b))


def all_of(parts: list[Column | None]) -> Column | None:
    """The conjunction of those that are there."""
    given = [p for p in parts if p is not None]
    return reduce(and_, given) if given else None
