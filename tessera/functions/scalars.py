"""Scalar checks and sums: dates, timestamps, decimals, ids, paths, retry delays, prices, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTTP answers after which a request is tried again.
RETRYABLE = (429, 500, 502, 503, 504)


def as_date(c: Column) -> Column:
    """YYYY-MM-DD that the calendar has, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def as_timestamp(c: Column) -> Column:
    """RFC 3339 in UTC, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)$"), F.try_to_timestamp(c))


def is_decimal(c: Column) -> Column:
    """A decimal literal, which stays a string."""
    return c.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$")


def is_record_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")


def is_vault_path(c: Column) -> Column:
    """Relative and portable: no leading slash, drive, backslash, NUL or dot segment."""
    return (c != "") & ~c.rlike(r"(^/)|(^[A-Za-z]:)|\\|\x00|(^|/)\.{1,2}(/|$)|//")


def is_interval(start: Column, end: Column) -> Column:
    """A half-open validity interval; an open side is valid."""
    return start.isNull() | end.isNull() | (end > start)


def stem(path: Column) -> Column:
    """The basename without .md."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.md$", "")


def retry_delay(attempt: Column, status: Column) -> Column:
    """Milliseconds before the next attempt, 1000 doubled at most 5 times and at most 30000; null if it isn't retried."""
    return F.when(status.isin(*RETRYABLE), F.least(F.lit(1000) * F.pow(F.lit(2), F.least(attempt - 1, F.lit(5))), F.lit(30000)).cast("long"))


def price(units: Column, nanos: Column, per: Column) -> Column:
    """Nanounits for units at a price for each `per` of them, rounded up, exact."""
    return _ceil_div(nanos.cast("decimal(18,0)") * units.cast("decimal(18,0)"), per)


def _ceil_div(a: Column, b: Column) -> Column:
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    rest = a % b
    return ((a - rest) / b + F.when(rest > 0, 1).otherwise(0)).cast("decimal(38,0)")


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and one way of spacing; null if it is no JSON."""
    return F.to_json(F.try_parse_json(c))


def errors(**checks: Column) -> Column:
    """Names of the checks that fail, sorted, joined by commas; a check that is null doesn't fail."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in sorted(checks.items())])), ",")
