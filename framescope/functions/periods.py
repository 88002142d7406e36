"""Calendar periods by alias: starts of anchored weeks, quarters and years, and bins of several units."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Period aliases and the units they truncate to (weeks start on Monday).
UNITS = {
    "Y": "year", "YE": "year", "A": "year",
    "Q": "quarter", "QE": "quarter",
    "M": "month", "ME": "month",
    "W": "week",
    "B": "business day",
    "D": "day",
    "H": "hour", "h": "hour",
    "T": "minute", "min": "minute",
    "S": "second", "s": "second",
    "L": "millisecond", "ms": "millisecond",
    "U": "microsecond", "us": "microsecond",
}

# Names of anchors, and the last day of a week and last month of a year without one.
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}
MONTHS_OF = {"month": 1, "quarter": 3, "year": 12}
ALIAS = re.compile(r"([0-9]*)([A-Za-z]+)(?:-([A-Za-z]{3}))?")


def parse(alias: str) -> tuple[int, str, int]:
    """Units of a period, the unit, and its anchor: days after Monday or months after January of its start."""
    found = ALIAS.fullmatch(alias)
    if not found or (found[2] not in UNITS and found[2].upper() not in ("Y", "A", "Q", "W", "D", "B")):
        raise ValueError(f"unknown period alias: {alias}")
    unit = UNITS.get(found[2]) or UNITS[found[2].upper()]
    count = int(found[1] or 1)
    if not count:
        raise ValueError(f"a period of no units: {alias}")
    name = (found[3] or "").upper()
    if not name:
        return count, unit, 0
    names = WEEKDAYS if unit == "week" else MONTHS if unit in ("quarter", "year") else ()
    if name not in names:
        raise ValueError(f"unknown anchor of a period: {alias}")
    # The anchor names the end; the next day or month is the start.
    after = names.index(name) + 1
    return count, unit, after % 7 if unit == "week" else after % MONTHS_OF[unit]


def _day(value: Column) -> Column:
    return value.cast("date")


def _ntz(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def unit_start(ts: Column, unit: str, anchor: int = 0) -> Column:
    """Start of the unit that ``ts`` lies in; on a weekend the next business day is Monday."""
    if unit == "business day":
        # Days since Monday 1970-01-05: the last two of a week move on.
        weekday = F.weekday(ts)
        return _ntz(F.date_add(_day(ts), F.when(weekday > 4, 7 - weekday).otherwise(0)))
    if not anchor:
        return _ntz(F.date_trunc(unit, ts))
    if unit == "week":
        return _ntz(F.date_add(_day(F.date_trunc("week", F.date_sub(_day(ts), anchor))), anchor))
    return _ntz(F.add_months(F.trunc(F.add_months(_day(ts), -anchor), unit), anchor))


def period_start(ts: Column, alias: str = "D", bins: bool = False) -> Column:
    """Start of the period that ``ts`` lies in, as ``timestamp_ntz``.

    As a calendar period of several units starts with the unit of its row, a count before the
    alias changes nothing, unless ``bins`` asks for bins of that many units side by side,
    counted from 1970 (weeks from the first anchored one, business days are refused).
    """
    count, unit, anchor = parse(alias)
    start = unit_start(ts, unit, anchor)
    if not bins or count == 1:
        return start
    if unit == "business day":
        raise ValueError("bins of business days are not defined")
    if unit in MICROS:
        width = count * MICROS[unit]
        # Bins may begin inside a day's unit, so the instant itself is cut.
        micros = F.unix_micros(ts.cast("timestamp"))
        return _ntz(F.timestamp_micros(micros - F.pmod(micros, F.lit(width))))
    if unit in ("day", "week"):
        first = {"day": "1970-01-01", "week": f"1970-01-{5 + anchor:02d}"}[unit]
        width = count * (1 if unit == "day" else 7)
        past = F.pmod(F.date_diff(_day(start), F.lit(first).cast("date")), F.lit(width))
        return _ntz(F.date_sub(_day(start), past.cast("int")))
    width = count * MONTHS_OF[unit]
    past = F.pmod((F.year(start) - 1970) * 12 + F.month(start) - 1 - anchor, F.lit(width))
    return _ntz(F.add_months(_day(start), -past.cast("int")))
