"""The seven calendar levels (UTC), the edges along which they roll up, and bucket bounds as Column expressions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("second", "minute", "hour", "day", "week", "month", "year")
#: Each level's parents; a week ends nowhere, since months aren't made of weeks.
EDGES = (("second", "minute"), ("minute", "hour"), ("hour", "day"), ("day", "week"), ("day", "month"), ("month", "year"))
#: For display only: months and years differ in length.
APPROX_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
PRESETS = {"1h": (timedelta(hours=1), "minute"), "24h": (timedelta(days=1), "hour"), "7d": (timedelta(days=7), "hour"), "30d": (timedelta(days=30), "day"), "90d": (timedelta(days=90), "day"), "1y": (timedelta(days=365), "month")}
MAX_BUCKETS = 2000


def parse_level(name: str) -> str:
    if name not in LEVELS:
        raise ValueError(f"invalid_level: {name!r} is none of {', '.join(LEVELS)}")
    return name


def parents(level: str) -> tuple[str, ...]:
    return tuple(p for c, p in EDGES if c == level)


def path_to(level: str) -> list[str]:
    """The levels from second to ``level`` along the edges."""
    out = [level]
    while out[0] != "second":
        out.insert(0, next(c for c, p in EDGES if p == out[0]))
    return out


def bucket(ts: Column | str, level: str) -> Column:
    """Start of the bucket that holds an instant; keeps timestamp_ntz."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(parse_level(level).upper(), col).cast("timestamp_ntz")


parent_start = bucket


def literal(at: datetime) -> Column:
    """A naive UTC datetime as a constant, whatever the session's time zone."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")

_ZONED = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def utc(column: Column | str, kind: str) -> Column:
    """The UTC wall clock of an instant, whatever the session's time zone; null where there is none.

    kind: the column's type. Text must be RFC 3339 with an offset, integers are milliseconds since 1970, and a
    timestamp without a zone, or a date, is UTC already.
    """
    col = F.col(column) if isinstance(column, str) else column
    if kind in ("timestamp_ntz", "date"):
        return col.cast("timestamp_ntz")
    if kind in ("bigint", "int"):
        seconds = (col.cast("decimal(20,0)") / 1000).cast("decimal(18,6)")
    else:
        instant = F.when(col.rlike(_ZONED), F.try_to_timestamp(F.upper(col))) if kind == "string" else col
        seconds = (F.unix_micros(instant.cast("timestamp")).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return literal(datetime(1970, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def bucket_end(start: Column | str, level: str) -> Column:
    col = F.col(start) if isinstance(start, str) else start
    return col + F.expr(f"interval 1 {parse_level(level)}")


def floor(at: datetime, level: str) -> datetime:
    """``bucket`` for a Python datetime."""
    keep = {"second": 6, "minute": 5, "hour": 4, "day": 3, "week": 3, "month": 2, "year": 1}[parse_level(level)]
    parts = list(at.timetuple()[:6])
    out = datetime(*(parts[:keep] + [1, 1, 1, 0, 0, 0][keep:])) if keep < 6 else at.replace(microsecond=0)
    return out - timedelta(days=out.weekday()) if level == "week" else out


def ceil(at: datetime, level: str) -> datetime:
    """The first bound of a level at or after an instant."""
    low = floor(at, level)
    if low == at:
        return low
    return floor(low + timedelta(seconds=APPROX_SECONDS[level] * 1.1 + (3 * 86400 if level in ("month", "year") else 0)), level) if level in ("month", "year") else low + timedelta(seconds=APPROX_SECONDS[level])


def overlaps(start: datetime, end: datetime, level: str, column: str = "bucket_start") -> Column:
    """Buckets with bucket_start < end and bucket_end > start, in a form that reaches the scan."""
    return (F.col(column) >= literal(floor(start, level))) & (F.col(column) < literal(end))


def preset_range(preset: str, now: datetime) -> tuple[datetime, datetime, datetime, str]:
    """Start and end of a preset, start of the window before it, and its level."""
    span, level = PRESETS[preset]
    return now - span, now, now - 2 * span, level


def estimated_buckets(start: datetime, end: datetime, level: str) -> int:
    return -(-int((end - start).total_seconds()) // APPROX_SECONDS[level])
