"""Times of mixed precision.

A time is a precision and the closed interval of microseconds that it covers.  Calendar periods are nested or disjoint,
so comparing two times at the coarser of their precisions is comparing intervals, and plain comparisons of long columns
do: a < b where a ends before b begins, a <= b where a begins no later than b ends.  Equality is structural.
"""

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from positdb.errors import ExecutionError

BOT, YEAR, MONTH, DATE, MOMENT, EOT = range(6)
LOWEST, HIGHEST = -(2**63), 2**63 - 1
DAY = 86_400_000_000
EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Time:
    prec: int
    lo: int
    hi: int
    text: str


BEGINNING, END = Time(BOT, LOWEST, LOWEST, "BOT"), Time(EOT, HIGHEST, HIGHEST, "EOT")


def days(year: int, month: int = 1, day: int = 1) -> int:
    """Days from 1970-01-01 in the proleptic Gregorian calendar, for any year."""
    years = year - (month <= 2)
    era = years // 400
    of_era = years - era * 400
    of_year = (153 * ((month + 9) % 12) + 2) // 5 + day - 1
    return era * 146_097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719_468


def moment(value: dt.datetime) -> Time:
    at = (value - EPOCH) // dt.timedelta(microseconds=1)
    return Time(MOMENT, at, at, str(value))


def now() -> Time:
    return moment(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))


def parse(text: str) -> Time:
    """A literal without its quotes: a year, month, date or moment."""
    text = text.strip()
    if m := re.fullmatch(r"([+-]?\d{4,8})", text):
        year = int(m[1])
        if abs(year) > 290_000:
            raise ExecutionError(f"The year of '{text}' is out of range")
        return Time(YEAR, days(year) * DAY, days(year + 1) * DAY - 1, str(year))
    if m := re.fullmatch(r"(-?\d{4,6})-(\d{1,2})", text):
        year, month = int(m[1]), int(m[2])
        if not 1 <= month <= 12:
            raise ExecutionError(f"'{text}' has no such month")
        return Time(MONTH, days(year, month) * DAY, days(year + month // 12, month % 12 + 1) * DAY - 1, f"{year}-{month}")
    try:
        if re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", text):
            day = dt.date(*map(int, text.split("-")))
            lo = days(day.year, day.month, day.day) * DAY
            return Time(DATE, lo, lo + DAY - 1, str(day))
        if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?", text):
            part = [int(x or 0) for x in m.groups()[:6]]
            return moment(dt.datetime(*part, int((m[7] or "0").ljust(6, "0"))))
    except ValueError as e:
        raise ExecutionError(f"'{text}' is not a time: {e}") from None
    raise ExecutionError(f"'{text}' is not a time")


def constant(name: str, at: Time) -> Time:
    """@NOW (``at``, the same in a whole script), @BOT, @EOT."""
    found = {"NOW": at, "BOT": BEGINNING, "EOT": END}.get(name)
    if found is None:
        raise ExecutionError(f"Unknown constant @{name}")
    return found


def compare(op: str, a: tuple, b: tuple) -> Column:
    """``a`` op ``b``, each a triple (prec, lo, hi) of columns or numbers."""
    (ap, alo, ahi), (bp, blo, bhi) = ([x if isinstance(x, Column) else F.lit(x) for x in t] for t in (a, b))
    return {"<": ahi < blo, "<=": alo <= bhi, ">": alo > bhi, ">=": ahi >= blo, "=": (ap == bp) & (alo == blo)}[op]


def micros(stamp: Column) -> Column:
    """Microseconds from 1970 of a timestamp without zone, whatever the session's zone is."""
    second = F.extract(F.lit("SECOND"), stamp).cast("decimal(18,6)")
    return F.datediff(stamp.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY + (F.hour(stamp) * 3600 + F.minute(stamp) * 60).cast("long") * 1_000_000 + (second * 1_000_000).cast("long")


def timestamp(lo: Column) -> Column:
    """The timestamp without zone at ``lo``; null for the beginning and the end of time."""
    seconds = lo.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.when((lo > LOWEST) & (lo < HIGHEST), at)


def shown(prec: Column, lo: Column) -> Column:
    """Display: months without padding, moments with seconds."""
    at = timestamp(lo)
    return (
        F.when(prec == BOT, F.lit("BOT"))
        .when(prec == EOT, F.lit("EOT"))
        .when(prec == YEAR, F.year(at).cast("string"))
        .when(prec == MONTH, F.concat_ws("-", F.year(at).cast("string"), F.month(at).cast("string")))
        .when(prec == DATE, at.cast("date").cast("string"))
        .otherwise(at.cast("string"))
    )
