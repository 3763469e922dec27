"""Registered queries of the general problems on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmura.functions import times
from murmura.operators.posting_time import STATED, posting_times
from murmura.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id and UTC posting time of every item whose fields fix it to the minute."""
    times_ = posting_times(table(spark, sf_dir, "items"), table(spark, sf_dir, "runs"))
    return times_.select("item_id", "posted_utc").where("posted_utc is not null")


def p3_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its UTC posting time (null where nothing fixes it), the field that fixed it, and whether it is ambiguous."""
    return posting_times(table(spark, sf_dir, "items"), table(spark, sf_dir, "runs")).select("item_id", "posted_utc", "how", "ambiguous")


# SQL: the same writings by other means, zones by the database's own rules. It takes a local time that a zone has twice
# for the earlier one; the tables have none.

_DIGITS = "".join(map(chr, range(0x660, 0x66A))) + "".join(map(chr, range(0x6F0, 0x6FA)))
_SPACE = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_MONTH_NAMES = "|".join(sorted(times.MONTH_OF, key=lambda n: (-len(n), n)))
_DAY_NAMES = "|".join(times.DAY_OF)
_CLOCK = "(?:^|[^0-9:.])([0-9]{1,2})[:.]([0-9]{2})(?::[0-9]{2}(?:\\.[0-9]+)?)?\\s*([ap]\\.?m)?(?:$|[^0-9])"


def _tidy(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '{_DIGITS}', '{'0123456789' * 2}'), '{_SPACE}', ' ', 'g'))"


def _clock(x: str) -> str:
    h, m, half = (f"regexp_extract({x}, '{_CLOCK}', {n})" for n in (1, 2, 3))
    hour, minute = f"TRY_CAST({h} AS INT)", f"TRY_CAST({m} AS INT)"
    twelve = f"CASE WHEN {hour} BETWEEN 1 AND 12 THEN {hour} % 12 + CASE WHEN {half} LIKE 'p%' THEN 12 ELSE 0 END END"
    return f"CASE WHEN {minute} <= 59 THEN CASE WHEN {half} <> '' THEN {twelve} WHEN {hour} <= 23 THEN {hour} END * 60 + {minute} END"


def _date(y: str, m: str, d: str) -> str:
    return f"date_diff('day', DATE '1970-01-01', TRY_CAST({y} || '-' || lpad(({m})::VARCHAR, 2, '0') || '-' || lpad(({d})::VARCHAR, 2, '0') AS DATE))"


def _month(x: str) -> str:
    found = f"regexp_extract({x}, '(?:^|[^\\p{{L}}])({_MONTH_NAMES})(?:$|[^\\p{{L}}])', 1)"
    return f"CASE {found} " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in times.MONTH_OF.items()) + " END"


def _named_day(x: str) -> str:
    before = f"regexp_extract({x}, '(?:^|[^0-9])([0-9]{{1,2}})(?:st|nd|rd|th)?,?\\s+(?:de\\s+)?(?:{_MONTH_NAMES})(?:$|[^\\p{{L}}])', 1)"
    after = f"regexp_extract({x}, '(?:^|[^\\p{{L}}])(?:{_MONTH_NAMES})\\.?\\s+([0-9]{{1,2}})(?:st|nd|rd|th)?(?:$|[^0-9:.])', 1)"
    return f"coalesce(TRY_CAST({before} AS INT), TRY_CAST({after} AS INT))"


def _year(x: str) -> str:
    return f"nullif(regexp_extract({x}, '(?:^|[^0-9:+\\-])((?:19|20)[0-9]{{2}})(?:$|[^0-9:])', 1), '')"


def _stated(x: str) -> str:
    """struct(minute, shift) of a full date with a clock time."""
    iso, slash = "^((?:19|20)[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})(?:$|[^0-9])", "^([0-9]{1,2})/([0-9]{1,2})/((?:19|20)[0-9]{2})"
    part = lambda p, n: f"regexp_extract({x}, '{p}', {n})"
    day = (
        f"CASE WHEN regexp_matches({x}, '{iso}') THEN {_date(part(iso, 1), part(iso, 2), part(iso, 3))} WHEN regexp_matches({x}, '{slash}') THEN {_date(part(slash, 3), part(slash, 2), part(slash, 1))} "
        f"ELSE {_date(_year(x), _month(x), _named_day(x))} END"
    )
    clock = _clock(f"regexp_replace(regexp_replace({x}, '([0-9])t([0-9])', '\\1 \\2', 'g'), '(?:gmt|utc)\\s*[+\\-].*$', ' ')")
    offset = "[0-9](?:\\s*[ap]\\.?m)?\\s*(?:gmt|utc)?\\s*([+\\-])([0-9]{1,2}):?([0-9]{2})$"
    shift = (
        f"CASE WHEN regexp_matches({x}, '[0-9](?:\\s*[ap]\\.?m)?\\s*(?:z|utc|gmt)$') THEN 0 WHEN regexp_matches({x}, '{offset}') "
        f"THEN CASE WHEN {part(offset, 1)} = '-' THEN -1 ELSE 1 END * (TRY_CAST({part(offset, 2)} AS INT) * 60 + TRY_CAST({part(offset, 3)} AS INT)) END"
    )
    packed = "^([0-9]{4})([0-9]{2})([0-9]{2})t([0-9]{2})([0-9]{2})(?:[0-9]{2})?z$"
    packed_minute = f"{_date(part(packed, 1), part(packed, 2), part(packed, 3))} * 1440 + TRY_CAST({part(packed, 4)} AS INT) * 60 + TRY_CAST({part(packed, 5)} AS INT)"
    return (
        f"CASE WHEN regexp_matches({x}, '[0-9][:.][0-9]{{2}}') THEN struct_pack(minute := ({day}) * 1440 + ({clock}), shift := {shift}) WHEN regexp_matches({x}, '^[0-9]{{10}}$') THEN struct_pack(minute := TRY_CAST({x} AS BIGINT) // 60, shift := 0) "
        f"WHEN regexp_matches({x}, '^[0-9]{{13}}$') THEN struct_pack(minute := TRY_CAST({x} AS BIGINT) // 60000, shift := 0) WHEN regexp_matches({x}, '{packed}') THEN struct_pack(minute := {packed_minute}, shift := 0) END"
    )


_AGO = "^(?:about |over |almost |hace |mga )?([0-9]+|an?|one|un) ?(?:m|mins?|minutes?|minutos?|minuto)(?: (?:ago|na ang nakalipas|nakalipas))?$"
_WEEKDAY = "CASE wd " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in times.DAY_OF.items()) + " END"


def _moment(minute: str) -> str:
    return f"make_timestamp(CAST({minute} AS BIGINT) * 60000000)"


_SQL = (
    "WITH a AS (SELECT item_id, floor(epoch(CAST(replace(first_seen, 'Z', '') AS TIMESTAMP)) / 60) AS seen, nullif(trim(browser_timezone), '') AS zone, browser_utc_offset_minutes AS fixed, "
    + ", ".join(f"{_tidy(c)} AS {c}" for c in STATED)
    + " FROM items LEFT JOIN runs ON first_run_id = run_id), b AS (SELECT *, " + ", ".join(f"{_stated(c)} AS s_{c}" for c in STATED)
    + f", CASE WHEN zone IS NULL THEN fixed ELSE (epoch(timezone(zone, timezone('UTC', {_moment('seen')}))) - epoch({_moment('seen')})) / 60 END AS seen_shift FROM a), "
    f"c AS (SELECT *, seen + seen_shift AS now, {_clock('time_text')} AS tclock, {_month('time_text')} AS tmonth, {_named_day('time_text')} AS tday, {_year('time_text')} AS tyear, regexp_extract(time_text, '^({_DAY_NAMES})(?:$|[^\\p{{L}}])', 1) AS wd FROM b), "
    f"d AS (SELECT *, floor(now / 1440) AS today, year({_moment('now')}) AS ny, {_WEEKDAY} AS w FROM c), "
    f"e AS (SELECT *, {_date('ny::VARCHAR', 'tmonth', 'tday')} AS d1, {_date('(ny - 1)::VARCHAR', 'tmonth', 'tday')} AS d0 FROM d), "
    "f AS (SELECT *, (CASE WHEN regexp_matches(time_text, '^(?:today|hoy|ngayon)(?:$|[^\\p{L}])') THEN today WHEN regexp_matches(time_text, '^(?:yesterday|ayer|kahapon)(?:$|[^\\p{L}])') THEN today - 1 "
    "WHEN w IS NOT NULL AND tmonth IS NULL THEN today - (((today + 3) % 7 - w + 6) % 7 + 1) WHEN tmonth IS NOT NULL AND tyear IS NULL THEN CASE WHEN d1 <= today + 1 THEN d1 ELSE coalesce(d0, d1 - 365) END END) * 1440 + tclock AS called FROM e), "
    "g AS (SELECT *, coalesce(" + ", ".join(f"CASE WHEN s_{c}.shift IS NULL THEN s_{c}.minute END" for c in STATED) + ", called) AS local FROM f), "
    f"h AS (SELECT *, CASE WHEN zone IS NULL THEN local - fixed WHEN timezone(zone, timezone(zone, {_moment('local')})) = {_moment('local')} THEN epoch(timezone(zone, {_moment('local')})) / 60 END AS u_local, "
    f"CASE WHEN regexp_matches(time_text, '{_AGO}') THEN seen - coalesce(TRY_CAST(regexp_extract(time_text, '{_AGO}', 1) AS INT), 1) END AS u_ago FROM g), "
    "k AS (SELECT item_id, " + ", ".join(f"s_{c}.minute - s_{c}.shift AS u_{c}" for c in STATED) + ", u_local, u_ago FROM h), "
    f"z AS (SELECT *, coalesce({', '.join(f'u_{c}' for c in STATED)}, u_local, u_ago) AS m, CASE {' '.join(f'WHEN u_{c} IS NOT NULL THEN {chr(39)}{c}{chr(39)}' for c in STATED)} WHEN u_local IS NOT NULL THEN 'local' WHEN u_ago IS NOT NULL THEN 'ago' END AS how FROM k) "
)
_UTC = f"strftime({_moment('m')}, '%Y-%m-%dT%H:%M:%SZ')"

QUERIES = {"p3_found": p3_found, "p3_times": p3_times}
SQL: dict[str, str] = {
    "p3_found": _SQL + f"SELECT item_id, {_UTC} AS posted_utc FROM z WHERE m IS NOT NULL",
    "p3_times": _SQL + f"SELECT item_id, {_UTC} AS posted_utc, how, false AS ambiguous FROM z",
}
