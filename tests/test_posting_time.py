"""Posting times against zoneinfo, with ambiguous, nonexistent and missing cases."""

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest

from murmura.operators import zones
from murmura.operators.posting_time import posting_times

ITEMS = "item_id string, first_run_id string, first_seen string, posted_at string, time_exact string, time_text string, zone string"
RUNS = "run_id string, browser_timezone string, browser_utc_offset_minutes int"
SEEN = "2026-04-15T10:20:30Z"
CASES = [
    ("iso_offset", "berlin", "2026-03-05T08:41:59+01:00", None, None, "2026-03-05T07:41:00Z"),
    ("iso_z", "berlin", "2026-03-05T07:41:59.123Z", None, None, "2026-03-05T07:41:00Z"),
    ("compact", "berlin", "20260305T0741Z", None, None, "2026-03-05T07:41:00Z"),
    ("rfc", "berlin", "Thu, 05 Mar 2026 08:41:00 +0100", None, None, "2026-03-05T07:41:00Z"),
    ("epoch", "none", "1772696460", None, None, "2026-03-05T07:41:00Z"),
    ("epoch_ms", "none", "1772696460123", None, None, "2026-03-05T07:41:00Z"),
    ("naive_winter", "berlin", "2026-03-05 08:41", None, None, "2026-03-05T07:41:00Z"),
    ("naive_summer", "berlin", None, "Wednesday 1 July 2026 at 8:41 PM", None, "2026-07-01T18:41:00Z"),
    ("gap", "berlin", None, "29/03/2026 02:30", None, None),
    ("twice", "berlin", None, "25 October 2026, 02.30", None, None),
    ("twice_known", "summer", None, "25 October 2026, 02.30", None, "2026-10-25T00:30:00Z"),
    ("twice_later", "winter", None, "25 October 2026, 02.30", None, "2026-10-25T01:30:00Z"),
    ("twice_stated", "berlin", None, "25 October 2026, 02.30", "5 mins", "2026-04-15T10:15:00Z"),
    ("long_ago", "karachi", None, "3 March 1925 at 10:00", None, "1925-03-03T04:30:00Z"),
    ("far_ahead", "berlin", None, "3 July 2088 at 10:00", None, "2088-07-03T08:00:00Z"),
    ("no_such_zone", "offset_name", None, "16 April 2026 at 10:00", None, "2026-04-16T05:00:00Z"),
    ("no_such_zone_ago", "offset_name", None, None, "Yesterday at 09:05", "2026-04-14T04:05:00Z"),
    ("other_case", "lower", None, "1 July 2026 at 20:41", None, "2026-07-01T18:41:00Z"),
    ("stated", "none", None, "June 28th 2026 08:53 GMT-04:00", None, "2026-06-28T12:53:00Z"),
    ("urdu", "fixed", None, "۶ مئی ۲۰۲۶ ۱۴:۲۴", None, "2026-05-06T09:24:00Z"),
    ("spanish", "fixed", None, "9 de abril de 2026 a las 22:14", None, "2026-04-09T17:14:00Z"),
    ("ago", "none", None, None, "about 20 minutes ago", "2026-04-15T10:00:00Z"),
    ("weekday", "fixed", None, None, "Wednesday at 9:05 AM", "2026-04-08T04:05:00Z"),
    ("yesterday", "fixed", None, None, "Ayer a las 09:05", "2026-04-14T04:05:00Z"),
    ("yearless", "fixed", None, None, "December 30 at 9:05PM", "2025-12-30T16:05:00Z"),
    ("impossible", "fixed", None, "31 February 2026 at 11:38 PM", None, None),
    ("no_clock", "fixed", None, "16 April 2026", "3h", None),
    ("no_zone", "none", None, "16 April 2026 at 10:00", None, None),
    ("words", "fixed", None, "May be an image of a roof", "1d", None),
    ("empty", "fixed", "", "", "", None),
    ("no_run", "missing", None, "16 April 2026 at 10:00", None, None),
]


@pytest.fixture
def runs(spark):
    return spark.createDataFrame([("berlin", "Europe/Berlin", None), ("fixed", None, 300), ("none", None, None), ("summer", "Europe/Berlin", 120), ("winter", "Europe/Berlin", 60), ("karachi", "Asia/Karachi", 300), ("offset_name", "UTC+05:00", 300), ("lower", " europe/berlin", None), ("odd", "Nowhere/City", None), ("blank", " ", 0)], RUNS)


def test_cases(spark, runs):
    rows = [(n, r, SEEN, p, e, t, "clash") for n, r, p, e, t, _ in CASES]
    got = {r.item_id: r.posted_utc for r in posting_times(spark.createDataFrame(rows, ITEMS), runs).collect()}
    assert got == {n: want for n, _, _, _, _, want in CASES}


def test_ambiguity_and_repeats(spark, runs):
    rows = [("a", "berlin", SEEN, None, "25/10/2026 02:30", None, "")] * 2 + [("b", "berlin", SEEN, None, "25/10/2026 04:30", None, "")]
    got = posting_times(spark.createDataFrame(rows, ITEMS), runs).collect()
    assert sorted((r.item_id, r.ambiguous) for r in got) == [("a", True), ("a", True), ("b", False)]


def test_empty_tables(spark, runs):
    items = spark.createDataFrame([("a", "x", SEEN, "2026-03-05T07:41:00Z", None, None, "")], ITEMS)
    assert posting_times(items.limit(0), runs).count() == 0
    assert posting_times(items, runs.limit(0)).first().posted_utc == "2026-03-05T07:41:00Z"


@pytest.mark.parametrize("name", ["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "UTC", "Australia/Lord_Howe"])
def test_intervals_match_zoneinfo(name):
    spans = zones.intervals(name)
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(spans, spans[1:], strict=False))
    for year in (1901, 1946, 1985, 2026, 2048, 2099):
        for month in range(1, 13):
            at = datetime(year, month, 15, 12, tzinfo=UTC)
            minute = int(at.timestamp() // 60)
            shift = next(s[2] for s in spans if s[0] <= minute < s[1])
            assert shift == at.astimezone(ZoneInfo(name)).utcoffset().total_seconds() // 60


@pytest.mark.parametrize("name", ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe"])
def test_stretches_count_the_intervals_of_a_local_minute(name):
    local = [(low + shift, high + shift, shift) for low, high, shift in zones.intervals(name)]
    parts = zones._by_year(zones.stretches(local))
    assert all(a[2] == b[1] for a, b in zip(parts, parts[1:], strict=False))  # no gap, no overlap
    for year, low, high, hits, shift, other in parts:
        for minute in (low, high - 1):
            held = [s for first, end, s in local if first <= minute < end]
            assert (hits, [s for s in (shift, other) if s is not None]) == (len(held), held) and zones.year_start(year) <= minute < zones.year_start(year + 1)
