"""Time keys: node ids, periods and titles of the time hierarchy, ULIDs, and range arguments."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("year", "month", "week", "day", "segment")
#: The level above each level.
PARENT = {"segment": "day", "day": "week", "week": "month", "month": "year"}
_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def iso_year(ts: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), ts)


def node_id(level: str, ts: Column, suffix: Column | None = None) -> Column:
    """Id of the node of a level that a time lies in; segments have the suffix as well."""
    if level == "year":
        return F.concat(F.lit("toc:year:"), F.date_format(ts, "yyyy"))
    if level == "month":
        return F.concat(F.lit("toc:month:"), F.date_format(ts, "yyyy-MM"))
    if level == "week":
        return F.concat(F.lit("toc:week:"), iso_year(ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    if level == "day":
        return F.concat(F.lit("toc:day:"), F.date_format(ts, "yyyy-MM-dd"))
    return F.concat(F.lit("toc:segment:"), F.date_format(ts, "yyyy-MM-dd"), F.lit(":"), suffix)


def parent_id(level: str, ts: Column) -> Column:
    """Id of the parent of the node of a level that a time lies in; a week belongs to the month of its Thursday."""
    if level == "year":
        return F.lit(None).cast("string")
    if level == "week":
        return node_id("month", F.date_add(F.date_trunc("week", ts).cast("date"), 3).cast("timestamp"))
    return node_id(PARENT[level], ts)


def period_start(level: str, ts: Column) -> Column:
    return ts if level == "segment" else F.date_trunc(level, ts)


def period_end(level: str, ts: Column) -> Column:
    """The last millisecond of the period."""
    if level == "segment":
        return ts
    step = {"year": F.make_interval(F.lit(1)), "month": F.make_interval(F.lit(0), F.lit(1)), "week": F.expr("INTERVAL 7 DAYS"), "day": F.expr("INTERVAL 1 DAY")}[level]
    return F.date_trunc(level, ts) + step - F.expr("INTERVAL 1 MILLISECOND")


def title(level: str, ts: Column) -> Column:
    if level == "year":
        return F.date_format(ts, "yyyy")
    if level == "month":
        return F.date_format(ts, "MMMM yyyy")
    if level == "week":
        return F.concat(F.lit("Week "), F.weekofyear(ts).cast("string"), F.lit(" of "), iso_year(ts).cast("string"))
    return F.date_format(ts, "EEEE, MMMM dd, yyyy")


def ulid_ms(ulid: Column) -> Column:
    """Milliseconds in the first ten characters of a ULID."""
    digits = F.split(F.substring(F.upper(ulid), 1, 10), "")
    return F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: a * 32 + F.position(c, F.lit(_CROCKFORD)) - 1)


def parse_range(text: str, now: datetime) -> tuple[datetime, datetime]:
    """Bounds of ``Nd``, ``Nw`` or a name; 7 days by default, and one day at least."""
    named = {"today": 1, "yesterday": 1, "week": 7, "month": 30, "year": 365}
    low = text.strip().lower()
    if found := re.fullmatch(r"(\d+)([dw])", low):
        days = int(found[1]) * (7 if found[2] == "w" else 1)
    else:
        days = named.get(low.removeprefix("last ").removeprefix("this "), 7)
    return now - timedelta(days=max(days, 1)), now


def parse_time(text: str) -> datetime:
    """A time given as epoch milliseconds or as a date."""
    if re.fullmatch(r"-?\d+", text):
        return datetime.fromtimestamp(int(text) / 1000, tz=UTC)
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def range_days(argument: Column) -> Column:
    """Days of a range argument, as :func:`parse_range` reads it."""
    low = F.lower(F.trim(argument))
    count = F.regexp_extract(low, r"^(\d+)[dw]$", 1).try_cast("int")
    name = F.regexp_replace(F.regexp_replace(low, "^last ", ""), "^this ", "")
    named = F.when(name.isin("today", "yesterday"), 1).when(name == "month", 30).when(name == "year", 365).otherwise(7)
    return F.greatest(F.coalesce(F.when(F.endswith(low, F.lit("w")), count * 7).otherwise(count), named), F.lit(1))


def time_ms(argument: Column) -> Column:
    """Epoch milliseconds of a time given as such or as a date, as :func:`parse_time` reads it; null where it is neither."""
    return F.when(argument.rlike(r"^-?\d+$"), argument.try_cast("bigint")).otherwise(F.unix_millis(F.try_to_timestamp(argument)))


def lookback_days(query: Column) -> Column:
    """Days that a time phrase in a query looks back, or null."""
    low = F.lower(query)
    count = lambda unit: F.regexp_extract(low, rf"(\d+) {unit} ago", 1)
    fixed = F.when(F.contains(low, F.lit("yesterday")) | F.contains(low, F.lit("today")), 1.0).when(F.contains(low, F.lit("week")), 7.0).when(F.contains(low, F.lit("month")), 30.0).when(F.contains(low, F.lit("recent")) | F.contains(low, F.lit("latest")), 3.0)
    return (
        F.when(count("minutes") != "", F.try_divide(count("minutes").try_cast("double"), F.lit(1440.0)))
        .when(count("hours") != "", F.try_divide(count("hours").try_cast("double"), F.lit(24.0)))
        .when(count("days") != "", count("days").try_cast("double"))
        .otherwise(fixed)
    )


def age_days(ts: Column, newest: Column) -> Column:
    return (F.unix_millis(newest) - F.unix_millis(ts)) / F.lit(86_400_000.0)
