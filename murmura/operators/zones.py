"""Zone-offset intervals, exploded, and the as-of join of local or UTC minutes to them.

Times are whole minutes since 1970 (BIGINT); a local minute is counted as if its wall clock were UTC. Each zone's
local time line is cut where a clock change makes an interval begin or end there. A stretch knows how many offset
intervals hold it: one gives the offset, two mean that its minutes are ambiguous, none that they do not exist.
Stretches are cut again at the turn of each year, so that the year is an equality of the join.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All years that a date text can name.
FIRST_YEAR, LAST_YEAR = 1900, 2099
DAY = 1440
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
SCHEMA = "zone STRING, clock STRING, zone_year INT, low BIGINT, high BIGINT, hits INT, shift BIGINT, other BIGINT"


def known_zones() -> tuple[str, ...]:
    """The IANA names; any other name in a table counts as none."""
    return tuple(sorted(available_timezones()))


def year_start(year: int) -> int:
    return (datetime(year, 1, 1, tzinfo=UTC) - _EPOCH) // timedelta(minutes=1)


def _offset(zone: ZoneInfo, minute: int) -> int:
    at = _EPOCH + timedelta(minutes=minute)
    return int(at.astimezone(zone).utcoffset().total_seconds() // 60)


@lru_cache(maxsize=1024)
def intervals(name: str) -> tuple[tuple[int, int, int], ...]:
    """(first UTC minute, end, offset in minutes) of each stretch of one offset, FIRST_YEAR to LAST_YEAR."""
    zone = ZoneInfo(name)
    at, end = year_start(FIRST_YEAR) - 2 * DAY, year_start(LAST_YEAR + 1) + 2 * DAY
    out, start, shift = [], at, _offset(zone, at)
    while at < end:
        step = min(at + 5 * DAY, end)
        if (other := _offset(zone, step)) != shift:
            low, high = at, step
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if _offset(zone, mid) == shift else (low, mid)
            out.append((start, high, shift))
            start, shift = high, other
        at = step
    out.append((start, end, shift))
    return tuple(out)


def stretches(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(first minute, end, offsets in time order) of each stretch between the ends of (first, end, offset) spans."""
    edges = sorted({x for first, end, _ in spans for x in (first, end)})
    spans, out, k = sorted(spans), [], 0
    for low, high in zip(edges, edges[1:], strict=False):
        while k < len(spans) and spans[k][1] <= low:
            k += 1
        out.append((low, high, [s for first, end, s in spans[k : k + 3] if first <= low and high <= end]))
    return out


def _by_year(spans: list[tuple[int, int, list[int]]]) -> list[tuple]:
    out, k = [], 0
    for year in range(FIRST_YEAR, LAST_YEAR + 1):
        begin, end = year_start(year), year_start(year + 1)
        while spans[k][1] <= begin:
            k += 1
        n = k
        while n < len(spans) and spans[n][0] < end:
            low, high, shifts = spans[n]
            out.append((year, max(low, begin), min(high, end), len(shifts), *(shifts + [None, None])[:2]))
            n += 1
    return out


def interval_table(zones: DataFrame) -> DataFrame:
    """The stretches of the IANA zones named in zones.zone, on the local clock and on the UTC clock.

    Size bound: names outside the IANA list are dropped before anything is collected, so that at most about 600
    zones come out, with some five rows for each clock and year; this is what makes the broadcast in ``as_of`` safe.
    """
    found = [r[0] for r in zones.where(F.col("zone").isin(list(known_zones()))).distinct().collect()]
    rows = []
    for name in found:
        utc = list(intervals(name))
        local = [(low + shift, high + shift, shift) for low, high, shift in utc]
        for clock, spans in (("utc", utc), ("local", local)):
            rows += [(name, clock, *row) for row in _by_year(stretches(spans))]
    return zones.sparkSession.createDataFrame(rows, SCHEMA)


def as_of(df: DataFrame, table: DataFrame, clock: str, zone: str, minute: str, name: str) -> DataFrame:
    """df with name: struct(hits, shift, other) of the stretch that holds its minute column on that clock.

    One row per row of df: the stretches of a zone do not overlap. Null for a null zone or minute and for years
    outside FIRST_YEAR to LAST_YEAR.
    """
    side = table.where(F.col("clock") == clock).select(
        F.col("zone").alias("_zone"), F.col("zone_year").alias("_year"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.struct("hits", "shift", "other").alias(name)
    )
    at = df[minute]
    same = (df[zone] == side["_zone"]) & (F.year(F.timestamp_seconds(at * 60)) == side["_year"])
    return df.join(F.broadcast(side), same & (side["_low"] <= at) & (at < side["_high"]), "left").drop("_zone", "_year", "_low", "_high")


def known_zone(name: Column) -> Column:
    """The name if it is an IANA zone, whatever its case and the blanks around it; else null."""
    spelling = F.create_map(*[F.lit(x) for z in known_zones() for x in (z.lower(), z)])
    return F.try_element_at(spelling, F.lower(F.trim(name)))
