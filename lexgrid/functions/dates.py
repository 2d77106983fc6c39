"""Scalar functions over dates. Each gives a UTC timestamp and, where it has one, a precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names by number.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def month_number(text: Column) -> Column:
    """1-12 from a number or the beginning (three letters at least) of an English month name."""
    low = F.lower(F.trim(text))
    named = [F.when((F.length(low) >= 3) & F.startswith(F.lit(m), low), F.lit(i)) for i, m in enumerate(MONTHS, 1)]
    number = F.when(low.rlike("^[0-9]{1,2}$"), low.try_cast("int"))
    return F.coalesce(F.when(number.between(1, 12), number), *named)


def catalog_date(text: Column) -> tuple[Column, Column]:
    """`January 2006`, `Jan 2006` or `2006` to (timestamp, precision)."""
    year = F.regexp_extract(F.trim(text), r"^(?:([A-Za-z]+)\s+)?([0-9]{4})$", 2).try_cast("int")
    word = F.regexp_extract(F.trim(text), r"^(?:([A-Za-z]+)\s+)?([0-9]{4})$", 1)
    month = month_number(word)
    ok = year.isNotNull() & ((word == "") | month.isNotNull())
    return F.when(ok, F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1)).cast("timestamp")), F.when(~ok, "").when(word == "", "year").otherwise("month")


def citation_date(year: Column, month: Column, day: Column, free: Column) -> tuple[Column, Column]:
    """Year, month and day fields, or a free text that starts with them, to (timestamp, precision). Days run over into the next month."""
    y = F.coalesce(F.trim(year).try_cast("int"), F.substring(F.trim(free), 1, 4).try_cast("int"))
    y = F.when(y.between(1000, 9999), y)
    word = F.when(F.trim(F.coalesce(month, F.lit(""))) != "", month).otherwise(F.regexp_extract(F.trim(F.coalesce(free, F.lit(""))), r"^\S+\s+([A-Za-z]+|[0-9]+)", 1))
    m = month_number(word)
    d = F.trim(day).try_cast("int")
    d = F.when(m.isNotNull() & d.between(1, 31), d)
    at = F.date_add(F.make_date(y, F.coalesce(m, F.lit(1)), F.lit(1)), F.coalesce(d, F.lit(1)) - 1).cast("timestamp")
    return at, F.when(y.isNull(), "").when(m.isNull(), "year").when(d.isNull(), "month").otherwise("day")


def revision_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def compact_date(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd")


def listing_month(text: Column) -> Column:
    return F.trunc(F.try_to_timestamp(text, F.lit("dd-MMM-yyyy")).cast("date"), "MM")


def search_bounds(text: str) -> tuple[str, str]:
    """First and last microsecond of YYYY, YYYY-MM, YYYY-MM-DD or a full time, as ISO text; anything else raises ValueError."""
    from datetime import datetime, timedelta, timezone

    parts = text.strip().split("-")
    try:
        if len(parts) <= 3 and all(p.isdigit() for p in parts) and len(parts[0]) == 4:
            y, m, d = [int(p) for p in parts] + [0] * (3 - len(parts))
            first = datetime(y, m or 1, d or 1)
            after = datetime(y + 1, 1, 1) if not m else (datetime(y + m // 12, m % 12 + 1, 1) if not d else first + timedelta(days=1))
            return first.isoformat(sep=" "), (after - timedelta(microseconds=1)).isoformat(sep=" ")
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"no date: {text!r}") from e
    at = at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    return at.isoformat(sep=" "), at.isoformat(sep=" ")


def or_null(text: Column) -> Column:
    """A stored time as text; null where it is none."""
    return text.try_cast("timestamp")


def by_priority(value: Column, priority: Column, place: Column) -> Column:
    """Aggregate: the date of the highest priority, of equal ones the later entry."""
    return F.max_by(value, F.struct(priority, place, value))
