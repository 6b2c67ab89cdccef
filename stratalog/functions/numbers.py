"""Numbers, dates and their display, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity; non-finite and null become 0, minus zero becomes zero."""
    p = F.lit(float(10**digits))
    y = F.floor(x.cast("double") * p + 0.5).cast("double") / p
    bad = x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.when(bad, 0.0).when(y == 0, 0.0).otherwise(y)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def nearest_rank(x: Column, p: float) -> Column:
    """Aggregate: the value at rank ceil(p * n); null of an empty group."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {_name(x)})")


def _name(x: Column) -> str:
    return x._jc.toString() if hasattr(x, "_jc") else str(x)


def epoch_ms(iso: Column) -> Column:
    """ISO-8601 text to epoch milliseconds; no zone means UTC, unreadable text is null."""
    return F.unix_millis(F.try_to_timestamp(F.regexp_replace(iso, r"^(\d{4}-\d\d-\d\d[T ][\d:.]+)$", "$1Z")))


def epoch(iso: Column) -> Column:
    """ISO-8601 text to whole epoch seconds, rounded down."""
    return F.floor(epoch_ms(iso) / 1000).cast("bigint")


def iso_of(seconds: Column) -> Column:
    """Epoch seconds as ISO text with milliseconds, empty for null and anything not positive."""
    shown = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(seconds > 0, shown).otherwise("")


def duration_sec(start_ms: Column, end_ms: Column) -> Column:
    """Seconds between two instants, never negative; null when either is."""
    gap = (end_ms - start_ms) / 1000.0
    return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))


def grouped(n: Column) -> Column:
    """12,345"""
    return F.format_number(half_up(n).cast("bigint"), 0)


def fixed(x: Column, digits: int) -> Column:
    """A number with exactly so many decimals."""
    return F.format_string(f"%.{digits}f", half_up(x, digits))


def tokens_short(n: Column) -> Column:
    """999, 1.2k, 12.35M"""
    return F.when(n < 1000, half_up(n).cast("bigint").cast("string")).when(n < 1_000_000, F.concat(fixed(n / 1e3, 1), F.lit("k"))).otherwise(F.concat(fixed(n / 1e6, 2), F.lit("M")))


def thousands_short(n: Column) -> Column:
    """999, 5.3k, 531k, 2.00M: one decimal only below ten thousand."""
    k = F.when(n < 10_000, F.concat(fixed(n / 1e3, 1), F.lit("k"))).otherwise(F.concat(fixed(n / 1e3, 0), F.lit("k")))
    return F.when(n < 1000, half_up(n).cast("bigint").cast("string")).when(n < 1_000_000, k).otherwise(F.concat(fixed(n / 1e6, 2), F.lit("M")))


def seconds_short(s: Column) -> Column:
    """Seconds below 90, minutes below 5,400 seconds, then hours."""
    return F.when(s < 90, F.concat(fixed(s, 1), F.lit("s"))).when(s < 5400, F.concat(fixed(s / 60, 1), F.lit("m"))).otherwise(F.concat(fixed(s / 3600, 1), F.lit("h")))


def duration_words(s: Column) -> Column:
    """1h 1m, 1m 5s, 5s, an em dash for nothing."""
    n = half_up(s).cast("bigint")
    h, m, r = F.floor(n / 3600), F.floor(n / 60) % 60, n % 60
    long = F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))
    mid = F.concat(m.cast("string"), F.lit("m "), r.cast("string"), F.lit("s"))
    return F.when(s.isNull() | (s <= 0), F.lit("—")).when(h > 0, long).when(m > 0, mid).otherwise(F.concat(r.cast("string"), F.lit("s")))


def bytes_short(b: Column) -> Column:
    """512 B, 2.0 KB, 2.0 MB"""
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1 << 20, F.concat(fixed(b / 1024, 1), F.lit(" KB"))).otherwise(F.concat(fixed(b / (1 << 20), 1), F.lit(" MB")))


def percent(x: Column) -> Column:
    """41.2%"""
    return F.concat(fixed(x * 100, 1), F.lit("%"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def zone(share: Column, limit: float) -> Column:
    """ok, warn from 0.75 (or midway to 1 when the limit is that high), bad from the limit's far side on."""
    warn = 0.75 if limit < 0.75 else (1 + limit) / 2
    return F.when(share < limit, "ok").when(share < warn, "warn").otherwise("bad")


def gauge(lines: Column, size: Column, most_lines: int = 200, most_bytes: int = 25 * 1024) -> Column:
    """Zone of an index against its budget of lines and bytes, by the fuller of the two."""
    full = F.greatest(lines / most_lines, size / most_bytes)
    return F.when(full < 0.6, "ok").when(full < 0.9, "warn").otherwise("bad")


def node_radius(size: Column, largest: Column) -> Column:
    """Radius of a graph node: area grows with the file."""
    return 6 + 12 * F.sqrt(safe_div(size, largest))


def arc_lift(dx: Column) -> Column:
    """Height of an arc over a horizontal distance."""
    return F.least(F.lit(150.0), 30 + 0.42 * F.abs(dx))
