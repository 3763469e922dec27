"""Time strings as column expressions.

Two families: ``parse_exact``/``parse_relative``/``resolve`` give a record's posting time with its precision;
``stated_minute`` and friends read any of the wider writings that ``operators.posting_time`` needs.
Local times are whole minutes since 1970.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmura.functions import fixed_values as V

# Month names in the languages of the data, by number.
MONTHS = {
    1: "january jan enero جنوری enero", 2: "february feb febrero فروری", 3: "march mar marzo مارچ", 4: "april apr abril اپریل",
    5: "may mayo مئی", 6: "june jun junio جون", 7: "july jul julio جولائی", 8: "august aug agosto اگست",
    9: "september sept sep septiembre setiembre ستمبر", 10: "october oct octubre اکتوبر", 11: "november nov noviembre نومبر",
    12: "december dec diciembre دسمبر",
}
# Weekday names, Monday = 0.
WEEKDAYS = {
    0: "monday mon lunes", 1: "tuesday tue martes", 2: "wednesday wed miércoles", 3: "thursday thu jueves",
    4: "friday fri viernes", 5: "saturday sat sábado", 6: "sunday sun domingo",
}
PRECISIONS = ("minute", "hour", "day", "week", "month", "year")

MONTH_OF = {name: number for number, names in MONTHS.items() for name in names.split()}
DAY_OF = {name: number for number, names in WEEKDAYS.items() for name in names.split()}
_MONTH = "|".join(sorted(MONTH_OF, key=lambda n: (-len(n), n)))
_CLOCK = r"(?<![\d:.])(\d{1,2})[:.](\d{2})(?::\d{2}(?:\.\d+)?)?\s*([ap]\.?m)?(?![\d])"


def utc_second(text: Column) -> Column:
    """Seconds since 1970 of an ISO moment; without a zone it is UTC, whatever the session's zone; else null."""
    plain = F.trim(text)
    return F.unix_seconds(F.try_to_timestamp(F.when(plain.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), plain).otherwise(F.concat(plain, F.lit("Z")))))


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def tidy(text: Column) -> Column:
    """Lower case, ASCII digits, plain single blanks."""
    digits = "".join(map(chr, range(0x660, 0x66A))) + "".join(map(chr, range(0x6F0, 0x6FA)))
    plain = F.translate(F.lower(text), digits, "0123456789" * 2)
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def whole(text: Column) -> Column:
    """An extracted group as INT; an empty one is null."""
    return text.try_cast("int")


def group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, also where the plan is interpreted."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def day_number(text: Column, pattern: str = "yyyy-M-d") -> Column:
    """Days since 1970 of a date text; null for one that does not exist, such as 31 February."""
    return F.unix_date(F.try_to_timestamp(text, F.lit(pattern)).cast("date"))


def clock_minute(text: Column) -> Column:
    """Minute of the day of the first clock time in tidy text: 24 h, or 12 h with am or pm; else null."""

    def minute(clock: Column) -> Column:
        parts = F.struct(whole(group(clock, _CLOCK, 1)).alias("h"), whole(group(clock, _CLOCK, 2)).alias("m"), F.substring(group(clock, _CLOCK, 3), 1, 1).alias("x"))

        def count(p: Column) -> Column:
            twelve = F.when(p["h"].between(1, 12), p["h"] % 12 + F.when(p["x"] == "p", 12).otherwise(0))
            return F.when(p["m"] <= 59, F.when(p["x"] != "", twelve).otherwise(F.when(p["h"] <= 23, p["h"])) * 60 + p["m"])

        return F.when(clock != "", bind(parts, count))

    return bind(group(text, _CLOCK, 0), minute)


def month_number(text: Column) -> Column:
    return F.try_element_at(_map(MONTH_OF), group(text, rf"(?<![\p{{L}}])({_MONTH})(?![\p{{L}}])", 1))


def named_day(text: Column) -> Column:
    """Day of the month next to a month name."""
    before = group(text, rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?:de\s+)?(?:{_MONTH})(?![\p{{L}}])", 1)
    after = group(text, rf"(?<![\p{{L}}])(?:{_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?![\d:.])", 1)
    return F.coalesce(whole(before), whole(after))


def named_year(text: Column) -> Column:
    return whole(group(text, r"(?<![\d:+-])((?:19|20)\d{2})(?![\d:])", 1))


def offset_minutes(text: Column) -> Column:
    """Minutes east of UTC that tidy text with a clock time states after it; null if it states none."""
    pattern = r"\d(?:\s*[ap]\.?m)?\s*(?:gmt|utc)?\s*([+-])(\d{1,2}):?(\d{2})$"
    sign = F.when(group(text, pattern, 1) == "-", -1).otherwise(1)
    stated = sign * (whole(group(text, pattern, 2)) * 60 + whole(group(text, pattern, 3)))
    return F.when(text.rlike(r"\d(?:\s*[ap]\.?m)?\s*(?:z|utc|gmt)$"), F.lit(0)).when(text.rlike(pattern), stated)


def stated_minute(text: Column) -> Column:
    """struct(minute, shift) of a full date with a clock time in tidy text.

    minute is local; shift is its stated offset or null. Epoch seconds and milliseconds and the compact UTC
    form count as UTC. Null, empty, impossible or clockless text gives a null minute.
    """
    compact = r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(?:\d{2})?z$"
    packed = F.floor(F.unix_seconds(F.try_to_timestamp(F.regexp_replace(text, compact, "$1-$2-$3 $4:$5"), F.lit("yyyy-MM-dd HH:mm"))) / 60)
    iso = r"^((?:19|20)\d{2}-\d{1,2}-\d{1,2})(?!\d)"
    slash = r"^\d{1,2}/\d{1,2}/(?:19|20)\d{2}"
    named = F.concat_ws("-", named_year(text), month_number(text), named_day(text))
    day = (
        F.when(text.rlike(iso), day_number(group(text, iso, 1)))
        .when(text.rlike(slash), day_number(group(text, slash, 0), "d/M/yyyy"))
        .otherwise(day_number(named))
    )
    clock = clock_minute(F.regexp_replace(text, r"(?<=\d)t(?=\d)|(?:gmt|utc)\s*[+-].*$", " "))
    number = F.struct(F.lit(None).cast("bigint").alias("minute"), F.lit(None).cast("int").alias("shift"))
    return (
        F.when(text.rlike(r"\d[:.]\d{2}"), F.struct((day.cast("bigint") * 1440 + clock).alias("minute"), offset_minutes(text).alias("shift")))
        .when(text.rlike(r"^\d{10}$"), F.struct(F.floor(text.try_cast("bigint") / 60).alias("minute"), F.lit(0).alias("shift")))
        .when(text.rlike(r"^\d{13}$"), F.struct(F.floor(text.try_cast("bigint") / 60000).alias("minute"), F.lit(0).alias("shift")))
        .when(text.rlike(compact), F.struct(packed.alias("minute"), F.lit(0).alias("shift")))
        .otherwise(number)
    )


def minutes_ago(text: Column) -> Column:
    """Number of minutes of a label such as "7 minutes ago" or "41 mins"; null for coarser labels."""
    pattern = r"^(?:about |over |almost |hace |mga )?(\d+|an?|one|un) ?(?:m|mins?|minutes?|minutos?|minuto)(?: (?:ago|na ang nakalipas|nakalipas))?$"
    number = group(text, pattern, 1)
    return F.when(number.rlike(r"^\d+$"), number.try_cast("int")).when(number != "", F.lit(1))


def called_minute(text: Column, now: Column) -> Column:
    """Local minute of a label that names a day with a clock time, counted back from the local minute now.

    Today, yesterday, a weekday (never today: the same weekday is a week back) or a date without a year (the
    last such date that is not over a day ahead). Anything else gives null.
    """
    today = F.floor(now / 1440)
    clock = clock_minute(text)
    weekday = F.try_element_at(_map(DAY_OF), group(text, rf"^({'|'.join(DAY_OF)})(?![\p{{L}}])", 1))
    back = (((today + 3) % 7 - weekday + 6) % 7) + 1
    year = F.year(F.timestamp_seconds(now * 60))
    month, day = month_number(text), named_day(text)
    this_year, last_year = (day_number(F.concat_ws("-", y, month, day)) for y in (year, year - 1))
    yearless = F.when(this_year <= today + 1, this_year).otherwise(F.coalesce(last_year, this_year - 365))
    named = (
        F.when(text.rlike(r"^(?:today|hoy|ngayon)(?![\p{L}])"), today)
        .when(text.rlike(r"^(?:yesterday|ayer|kahapon)(?![\p{L}])"), today - 1)
        .when(weekday.isNotNull() & month.isNull(), today - back)
        .when(month.isNotNull() & named_year(text).isNull(), yearless)
    )
    return named.cast("bigint") * 1440 + clock


# A record's posting time with its precision


_SPANISH = "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre".split()
ENGLISH_MONTHS = {name: number for name, number in MONTH_OF.items() if name.isascii() and name not in _SPANISH}
_ENGLISH = "|".join(sorted(ENGLISH_MONTHS, key=lambda n: (-len(n), n)))
_EXACT_CLOCK = r"(?<![\p{L}\p{N}_])(\d{1,2})[:.](\d{2})(?:\s*([ap])\.?\s?m(?![\p{L}\p{N}_])\.?)?"


def label_text(text: Column) -> Column:
    """A time label in lower case with plain blanks and no commas."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "\u202f\u00a0,", "   "), r"(?U)\s+", " "))


def _label_clock(text: Column) -> tuple[Column, Column]:
    """(whether a clock time is written, its minute of the day or null if it cannot be)."""
    written = text.rlike(_EXACT_CLOCK)

    def minute(clock: Column) -> Column:
        hour, minutes, half = whole(group(clock, _EXACT_CLOCK, 1)), whole(group(clock, _EXACT_CLOCK, 2)), group(clock, _EXACT_CLOCK, 3)
        twelve = F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        return F.when(minutes <= 59, F.when(half != "", twelve).otherwise(F.when(hour <= 23, hour)) * 60 + minutes)

    return written, F.when(written, bind(text, minute))


def _label_date(text: Column, default_year: Column) -> tuple[Column, Column]:
    """(day number, whether a year is written) of a month name with a day and perhaps a year."""
    rest = F.regexp_replace(text, _EXACT_CLOCK, " ")
    year_text = group(rest, r"(?<![\p{L}\p{N}_])((?:19|20)\d{2})(?![\p{L}\p{N}_])", 1)
    month = F.try_element_at(_map(ENGLISH_MONTHS), group(rest, rf"(?<![a-z])({_ENGLISH})(?![a-z])", 1))
    rest = F.regexp_replace(rest, r"(?<![\p{L}\p{N}_])(?:19|20)\d{2}(?![\p{L}\p{N}_])", " ")
    day = whole(group(rest, r"(?<![\p{L}\p{N}_])(\d{1,2})(?:st|nd|rd|th)?(?![\p{L}\p{N}_])", 1))
    year = F.coalesce(whole(year_text), default_year)
    return day_number(F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.concat_ws("-", year, month, day))), year_text != ""


def parse_exact(text: Column) -> Column:
    """struct(minute, precision) of a tooltip: a date with its year, minute precise with a clock time, else day."""
    label = label_text(text)
    written, clock = _label_clock(label)
    day, _ = _label_date(label, F.lit(None).cast("int"))
    valid = day.isNotNull() & ~(written & clock.isNull())
    return F.when(valid, F.struct((day.cast("bigint") * 1440 + F.coalesce(clock, F.lit(0))).alias("minute"), F.when(written, "minute").otherwise("day").alias("precision")))


def parse_relative(text: Column, now: Column) -> Column:
    """struct(minute, precision) of a short label, relative to the local second now."""
    label = F.regexp_replace(label_text(text), r"^(?:about|over|almost|more than)\s+", "")
    number = group(label, r"^(\d+|an?|one)\s*([a-z]+)(?:\s+ago)?$", 1)
    unit = group(label, r"^(\d+|an?|one)\s*([a-z]+)(?:\s+ago)?$", 2)
    seconds = F.try_element_at(_map({u: s for units, (_, s) in V.TIME_UNITS.items() for u in units.split()}), unit)
    unit_precision = F.try_element_at(F.create_map(*[F.lit(x) for units, (p, _) in V.TIME_UNITS.items() for u in units.split() for x in (u, p)]), unit)
    times = F.coalesce(number.try_cast("bigint"), F.lit(1))
    written, clock = _label_clock(label)
    today = F.floor(now / 86400)
    rest = F.trim(F.regexp_replace(F.regexp_replace(label, _EXACT_CLOCK, " "), r"(?<![\p{L}\p{N}_])at(?![\p{L}\p{N}_])", " "))
    names = "monday tuesday wednesday thursday friday saturday sunday".split()
    weekday = F.try_element_at(_map({n: k for k, n in enumerate(names)}), rest)
    called = F.when(rest == "today", today).when(rest == "yesterday", today - 1).otherwise(today - ((today + 3 - weekday + 6) % 7 + 1))
    year = F.year(F.timestamp_seconds(now))
    day, has_year = _label_date(label, year)
    minute = day.cast("bigint") * 1440 + F.coalesce(clock, F.lit(0))
    before, _ = _label_date(label, year - 1)
    late = ~has_year & (minute * 60 > now + 86400)
    dated = F.when(late, F.coalesce(before.cast("bigint") * 1440 + F.coalesce(clock, F.lit(0)), minute - 365 * 1440)).otherwise(minute)
    precision = F.when(written, "minute").otherwise("day")
    return F.when(
        F.length(label_text(text)) <= 60,
        F.when(label_text(text).isin(list(V.NOW_LABELS)), F.struct(F.floor(now / 60).alias("minute"), F.lit("minute").alias("precision")))
        .when((number != "") & seconds.isNotNull(), F.struct(F.floor((now - times * seconds) / 60).alias("minute"), unit_precision.alias("precision")))
        .when(
            ~(written & clock.isNull()),
            F.when(called.isNotNull(), F.struct((called * 1440 + F.coalesce(clock, F.lit(0))).alias("minute"), precision.alias("precision"))).when(
                dated.isNotNull(), F.struct(dated.alias("minute"), precision.alias("precision"))
            ),
        ),
    )


def finer_rank(precision: Column) -> Column:
    """Rank of a precision, finest 0; null is the coarsest."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in PRECISIONS]), precision), F.lit(0)) - 1, F.lit(len(PRECISIONS)))


def local_iso(minute: Column, offset: Column) -> Column:
    """ISO text of a local minute with its offset."""
    sign = F.when(offset < 0, "-").otherwise("+")
    zone = F.concat(sign, F.lpad(F.floor(F.abs(offset) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(offset) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(F.timestamp_seconds(minute * 60), "yyyy-MM-dd'T'HH:mm:00"), zone)


def resolve(time_exact: Column, time_text: Column, captured_at: Column, offset: Column, default_offset: int = 0) -> Column:
    """struct(posted_at, posted_date, posted_at_precision, posted_at_source) of a record; nulls if nothing is known.

    The tooltip first, else the label relative to captured_at in the run's zone. A missing offset counts as
    default_offset, the same on every machine.
    """
    zone = F.coalesce(offset.cast("int"), F.lit(default_offset))
    captured = utc_second(captured_at)
    exact = parse_exact(time_exact)
    relative = parse_relative(time_text, captured + zone * 60)
    source = F.when(exact.isNotNull(), "time_exact").when(relative.isNotNull(), "time_text")

    def fields(found: Column) -> Column:
        return F.struct(
            local_iso(found["minute"], zone).alias("posted_at"),
            F.date_format(F.timestamp_seconds(found["minute"] * 60), "yyyy-MM-dd").alias("posted_date"),
            found["precision"].alias("posted_at_precision"),
            F.when(found.isNotNull(), source).alias("posted_at_source"),
        )

    return bind(F.coalesce(exact, relative), fields)
