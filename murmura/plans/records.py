"""Registered queries of the record, URL, listing and time operators, each over its whole table, with their SQL.

The tables hold no URL of the site and no listing page. The queries on these build one per item from its id, by a
template whose outcome is known; their SQL states that outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import content, listings, times, urls
from murmura.functions import fixed_values as V
from murmura.functions import text as X
from murmura.operators import collect, entity
from murmura.operators import items as I
from murmura.operators import labels as L
from murmura.operators.items import Filters, Tables
from murmura.plans.queries import sql_nfkc, sql_normal, sql_term, tables
from murmura.session import spread, table
from murmura.sources import runs as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL if it has one."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


# URLs: (address, canonical form, kind, role, url_key as a post, group); # stands for a number of the item
_S = V.SITE
URLS = [
    ("http://m.facebook.com/groups/#//posts/7#?ref=x#top", f"{_S}/groups/#/posts/7#/", "group_post", "content", "url:/groups/#/posts/7#/", "#"),
    ("https://facebook.com/groups/Club#/?multi_permalinks=9#&tab=1", f"{_S}/groups/Club#/posts/9#/", "group_post", "content", "url:/groups/club#/posts/9#/", "Club#"),
    (f"{_S}/groups/#/posts/7/?comment_id=#&m=R", f"{_S}/groups/#/posts/7/?comment_id=#", "comment", "comment", "url:/groups/#/posts/7/?comment_id=#", "#"),
    (f"{_S}/groups/#/posts/7/?reply_comment_id=#&comment_id=3", f"{_S}/groups/#/posts/7/?comment_id=3&reply_comment_id=#", "reply", "comment", "url:/groups/#/posts/7/?comment_id=3&reply_comment_id=#", "#"),
    (f"{_S}/reel/#", f"{_S}/reel/#/", "reel", "content", "url:/reel/#/", None),
    (f"{_S}/watch?v=#&autoplay=1", f"{_S}/watch/?v=#", "video", "content", "url:/watch/?v=#", None),
    (f"{_S}/photo.php?set=a.1&fbid=#", f"{_S}/photo.php?fbid=#&set=a.1", "photo", "content", "url:/photo.php?fbid=#", None),
    (f"{_S}/events/#/", f"{_S}/events/#/", "event", "content", "url:/events/#/", None),
    (f"{_S}/marketplace/item/#?src=y", f"{_S}/marketplace/item/#/", "marketplace", "content", "url:/marketplace/item/#/", None),
    (f"{_S}/Page.#/posts/a#", f"{_S}/Page.#/posts/a#/", "post", "content", "url:/page.#/posts/a#/", None),
    (f"{_S}/permalink.php?story_fbid=pfbid#&id=1", f"{_S}/permalink.php?id=1&story_fbid=pfbid#", "post", "content", None, None),
    (f"{_S}/share/p/Q#/", f"{_S}/share/p/Q#/", "post", "content", None, None),
    (f"{_S}/groups/#/", f"{_S}/groups/#/", "unknown", "group", None, "#"),
    (f"{_S}/groups/#/user/5", f"{_S}/groups/#/user/5/", "unknown", "profile", None, "#"),
    (f"{_S}/hashtag/tag#", f"{_S}/hashtag/tag#/", "unknown", "hashtag", None, None),
    (f"{_S}/profile.php?id=#&sk=about", f"{_S}/profile.php?id=#", "unknown", "profile", None, None),
    (f"{_S}/some.name#?comment_id=2", f"{_S}/some.name#/?comment_id=2", "unknown", "profile", None, None),
    (f"{_S}/settings/#", f"{_S}/settings/#/", "unknown", "other", None, None),
    ("https://l.facebook.com/l.php?u=https%3A%2F%2Fshop.example%2Fa%23b%3Fn%3D#&h=1", "https://shop.example/a", "unknown", "external", None, None),
    ("https://shop.example/a?q=#+1#end", "https://shop.example/a?q=#+1", "unknown", "external", None, None),
    ("mailto:#@shop.example", None, "unknown", "none", None, None),
]
_NUMBER = "coalesce(nullif(regexp_replace(item_id, '[^0-9]', '', 'g'), ''), '0')"
_TURN = "ascii(right(item_id, 1)) * 7 + length(item_id) + ascii(substr(item_id, 4, 1))"


def _number() -> Column:
    return F.coalesce(F.nullif(F.regexp_replace("item_id", "[^0-9]", ""), F.lit("")), F.lit("0"))


def _turn(n: int) -> Column:
    return (F.ascii(F.substring("item_id", -1, 1)) * 7 + F.length("item_id") + F.ascii(F.substring("item_id", 4, 1))) % n


def _filled(templates: list[str | None], number: Column, turn: Column) -> Column:
    return F.replace(F.get(F.array(*[F.lit(t) for t in templates]), turn), F.lit("#"), number)


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_filled(n: int) -> str:
    return f"replace(({_sql_list([u[n] for u in URLS])})[t + 1], '#', n)"


@query(
    f"WITH i AS (SELECT item_id, {_NUMBER} AS n, ({_TURN}) % {len(URLS)} AS t FROM items) "
    f"SELECT item_id, {_sql_filled(1)} AS canonical, ({_sql_list([u[2] for u in URLS])})[t + 1] AS kind, ({_sql_list([u[3] for u in URLS])})[t + 1] AS role, {_sql_filled(4)} AS key, {_sql_filled(5)} AS in_group FROM i"
)
def site_urls(spark, d) -> DataFrame:
    # The mark # also begins a fragment; templates with one write it as ~.
    address = _filled([u[0].replace("#top", "~top").replace("#end", "~end") for u in URLS], _number(), _turn(len(URLS)))
    rows = table(spark, d, "items").select("item_id", F.translate(address, "~", "#").alias("u"))
    u = F.col("u")
    return rows.select("item_id", urls.canonical_url(u).alias("canonical"), urls.kind_of(u).alias("kind"), urls.role_of(u).alias("role"), urls.url_key(F.lit("post"), u, F.lit(None).cast("string")).alias("key"), urls.group_of(u).alias("in_group"))


@query(
    f"WITH i AS (SELECT item_id, {_NUMBER} AS n, ({_TURN}) % 4 AS t FROM items) SELECT item_id, 'comment:' || CASE t WHEN 3 THEN '8' || n ELSE n END AS key, CASE WHEN t = 2 THEN '{_S}/groups/Hoses/posts/' || n || '/' END AS photo_post, "
    f"'{_S}/groups/7/posts/' || n || '/' || CASE t WHEN 2 THEN '?v=4' ELSE '' END AS plain FROM i"
)
def comment_keys(spark, d) -> DataFrame:
    """Comment ids plain, in base64 and of replies; posts from photo links; addresses without their comment."""
    n, turn = _number(), _turn(4)
    post = F.concat(F.lit(f"{_S}/groups/7/posts/"), n, F.lit("/"))
    packed = F.regexp_replace(F.base64(F.concat(F.lit("comment:7_"), n).cast("binary")), "=+$", "")
    asked = F.when(turn == 0, n).when(turn == 1, packed).when(turn == 2, F.concat(n, F.lit("&v=4"))).otherwise(F.concat(n, F.lit("&reply_comment_id=8"), n))
    rows = table(spark, d, "items").select("item_id", turn.alias("t"), n.alias("n"), F.concat(post, F.lit("?comment_id="), asked).alias("u"))
    photo = F.when(F.col("t") == 2, F.concat(F.lit(f"{_S}/photo/?fbid=1&set=gm."), "n")).otherwise(F.concat(F.lit(f"{_S}/photo/?fbid=1&set=a."), "n"))
    return rows.select(
        "item_id", urls.url_key(F.lit("comment"), F.lit(None).cast("string"), F.col("u")).alias("key"), urls.photo_group_post(photo, F.lit(f"{_S}/groups/Hoses/")).alias("photo_post"), urls.without_comment(F.col("u")).alias("plain")
    )


@query(
    f"WITH i AS (SELECT item_id, {_NUMBER} AS n, ({_TURN}) % 3 AS t FROM items) SELECT item_id, CASE t WHEN 0 THEN '{_S}/groups/7/posts/' || n || '/' WHEN 1 THEN '{_S}/groups/7/posts/' || n || '/' END AS url, "
    "CASE t WHEN 0 THEN 'group_post' WHEN 1 THEN 'group_post' END AS kind, CAST(CASE t WHEN 0 THEN 2 ELSE -1 END AS BIGINT) AS place, CASE WHEN t < 2 THEN 'Ann ' || n END AS author FROM i"
)
def permalinks(spark, d) -> DataFrame:
    """The best content link and the first named profile of three kinds of link lists."""
    n, turn = _number(), _turn(3)

    def link(i: int, href: Column, text: Column, img: bool = False) -> Column:
        return F.struct(F.lit(i).alias("i"), href.alias("href"), text.alias("text"), F.lit(img).alias("img"))

    post, none = F.concat(F.lit(f"{_S}/groups/7/posts/"), n, F.lit("/")), F.lit(None).cast("string")
    person = link(1, F.concat(F.lit(f"{_S}/ann."), n), F.concat(F.lit(" Ann "), n, F.lit("\n2h")))
    photo = link(0, F.concat(F.lit(f"{_S}/photo/?fbid="), n), F.lit(""), True)
    comment = link(3, F.concat(post, F.lit("?comment_id=5")), F.lit("1h"))
    whole = F.array(photo, person, link(2, post, F.lit("2h")), comment)
    links = F.when(turn == 0, whole).when(turn == 1, F.array(person, comment)).otherwise(F.array(link(0, none, F.lit("x"))))
    rows = table(spark, d, "items").select("item_id", links.alias("links"))
    picked, named = urls.picked_permalink(F.col("links")), urls.first_named_link(F.col("links"), "profile")
    return rows.select("item_id", picked.alias("p"), named.alias("a")).select("item_id", "p.url", "p.kind", F.coalesce("p.index", F.lit(-1)).cast("bigint").alias("place"), F.col("a.name").alias("author"))


# Listings


@query(
    "SELECT item_id, 'Thing ' || right(item_id, 4) AS title, nullif(p, '') AS price, g AS location FROM (SELECT item_id, CASE WHEN regexp_matches(coalesce(price, ''), '^[A-Z]{2,3} ?[0-9]') THEN regexp_replace(price, '^[A-Z]+ ?', 'Rs ') ELSE '' END AS p, coalesce(nullif(group_name, ''), 'Townville') AS g FROM items)"
)
def listing_cards(spark, d) -> DataFrame:
    """Card texts of a price (if the item has one), a struck-out price, a title and a place, taken apart again."""
    price = F.when(F.coalesce(F.col("price").rlike("^[A-Z]{2,3} ?[0-9]"), F.lit(False)), F.regexp_replace("price", "^[A-Z]+ ?", "Rs "))
    place = F.coalesce(F.nullif("group_name", F.lit("")), F.lit("Townville"))
    card = F.concat_ws("\n", price, F.when(price.isNotNull(), F.lit("Rs 9,999")), F.concat(F.lit("Thing "), F.substring("item_id", -4, 4)), place)
    rows = table(spark, d, "items").select("item_id", listings.parse_card(card, F.lit("")).alias("c"))
    return rows.select("item_id", "c.title", "c.price", "c.location")


@query(
    "SELECT item_id, n || ' days ago' AS listed_text, 'Place ' || n AS location, CASE WHEN t = 0 THEN 'Used - good' END AS condition, 'Line one ' || n || chr(10) || 'Line two' AS description "
    f"FROM (SELECT item_id, {_NUMBER} AS n, ({_TURN}) % 2 AS t FROM items)"
)
def listing_pages(spark, d) -> DataFrame:
    n = _number()
    head = F.when(_turn(2) == 0, F.concat(F.lit("Thing\nListed "), n, F.lit(" days ago in Place "), n, F.lit("\nDetails\nCondition\nUsed - good\nLine one "), n)).otherwise(
        F.concat(F.lit("Thing\nListed "), n, F.lit(" days ago in\nPlace "), n, F.lit("\nMessage\nDetails\nLine one "), n)
    )
    page = F.concat(head, F.lit("\nSee translation\nLine two\nSeller information\nAnn\nRelated searches\nListed now in Elsewhere"))
    return table(spark, d, "items").select("item_id", listings.parse_page(page).alias("p")).select("item_id", "p.*")


# Records merged into items


def _first(c: str) -> str:
    return f"arg_min({c}, item_id) FILTER ({c} <> '') AS {c}"


_KIND_RANK = "coalesce(list_position(" + _sql_list(list(V.KINDS)) + ", kind), 99)"
_WHEN_RANK = "coalesce(list_position(['minute', 'hour', 'day', 'week', 'month', 'year'], posted_at_precision), 7)"
_FILLED = [c for c in entity.FILL_FIELDS]


@query(
    f"SELECT content_key, coalesce(arg_min(kind, ({_KIND_RANK}, item_id)) FILTER (kind IS NOT NULL), 'unknown') AS kind, {', '.join(map(_first, _FILLED))}, {_first('screenshot_path')}, "
    "coalesce(arg_max(text, length(coalesce(text, ''))) FILTER (text IS NOT NULL AND length(text) = longest AND item_id = earliest), '') AS text, "
    f"arg_min(coalesce(posted_at, '-'), ({_WHEN_RANK}, item_id)) AS posted_at FROM (SELECT *, min(item_id) FILTER (coalesce(length(text), 0) = longest) OVER (PARTITION BY content_key) AS earliest FROM "
    "(SELECT *, max(coalesce(length(text), 0)) OVER (PARTITION BY content_key) AS longest FROM items WHERE content_key IS NOT NULL)) GROUP BY content_key"
)
def entity_merge(spark, d) -> DataFrame:
    """The rows of each content key merged as records of one item, in the order of item_id: first values, best kind, longest text, finest time."""
    rows = R.numbered(table(spark, d, "items").where("content_key is not null"), ["item_id"]).drop("language", "content_type")
    placed = rows.select("seq", F.col("content_key").alias("item_id"), F.lit(False).alias("sets_key"))
    items = entity.merged(rows.drop("item_id"), placed)
    return items.select(F.col("item_id").alias("content_key"), "kind", *_FILLED, "screenshot_path", "text", F.coalesce("posted_at", F.lit("-")).alias("posted_at"))


@query(
    f"SELECT item_id, CASE WHEN length(p) >= 12 THEN 'ck_' || substr(sha1(CASE WHEN kind IN ('comment', 'reply') THEN 'comment|' || coalesce(parent_post_url, lower(coalesce(group_name, ''))) ELSE 'post|' || lower(coalesce(group_name, '')) END || '|' || p), 1, 16) END AS content_key "
    f"FROM (SELECT item_id, coalesce(kind, '') AS kind, parent_post_url, group_name, substr(regexp_replace(lower({sql_normal('text')}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 1, 160) AS p FROM items)"
)
def content_keys(spark, d) -> DataFrame:
    """Content keys of posts by their group and of comments by the post they stand under."""
    key = X.content_key(F.col("text"), F.col("kind"), F.col("group_name"), F.col("parent_post_url"))
    return table(spark, d, "items").select("item_id", key.alias("content_key"))


_REFS = "SELECT item_id, min(struct_pack(r := run_id, c := record_id)) AS ref FROM sightings GROUP BY item_id"


@query(
    f"WITH f AS ({_REFS}), v AS (SELECT run_id, record_id, min(item_id) AS via FROM sightings GROUP BY ALL), "
    "l AS (SELECT CASE WHEN labels.sentiment = 'negative' THEN v.via ELSE labels.item_id END AS item_id, keyword, sentiment, labeled_at FROM labels LEFT JOIN f USING (item_id) LEFT JOIN v ON v.run_id = f.ref.r AND v.record_id = f.ref.c WHERE labels.item_id IN (SELECT item_id FROM items)) "
    "SELECT item_id, lower(keyword) AS keyword, sentiment FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lower(keyword) ORDER BY labeled_at DESC NULLS LAST, sentiment) AS k FROM l WHERE item_id IS NOT NULL) WHERE k = 1"
)
def labels_restored(spark, d) -> DataFrame:
    """Labels after a rebuild that lost the ids of all items with a negative one: those come back by their refs."""
    t = tables(spark, d)
    refs = t.sightings.groupBy("item_id").agg(F.array(F.min(F.struct("run_id", "record_id"))).alias("refs"))
    log = t.labels.join(refs, "item_id", "left").withColumn("item_id", F.when(F.col("sentiment") == "negative", F.concat(F.lit("lost_"), "item_id")).otherwise(F.col("item_id")))
    return L.restored(log, t.items, t.sightings).select("item_id", F.lower("keyword").alias("keyword"), "sentiment")


# Times

_EN = {m: n for m, n in times.ENGLISH_MONTHS.items()}
_MONTHS = "|".join(sorted(_EN, key=lambda m: (-len(m), m)))
_MONTH_CASE = "CASE m " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in _EN.items()) + " END"
_LABEL = "trim(regexp_replace(translate(lower({x}), '  ,', '   '), '[\\s\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
_W = "[\\p{L}\\p{N}_]"
_CLOCK = f"(?:^|[^\\p{{L}}\\p{{N}}_])([0-9]{{1,2}})[:.]([0-9]{{2}})(?:\\s*([ap])\\.?\\s?m(?:$|[^\\p{{L}}\\p{{N}}_])\\.?)?"
_CLOCK_CUT = f"(^|[^\\p{{L}}\\p{{N}}_])[0-9]{{1,2}}[:.][0-9]{{2}}(?:\\s*[ap]\\.?\\s?m($|[^\\p{{L}}\\p{{N}}_])\\.?)?"


def _parsed_sql(column: str, now: str | None) -> str:
    """Parts of a label: whether a clock is written, its minute, month, day, year."""
    return f"""
p0 AS (SELECT *, {_LABEL.format(x=column)} AS l{', ' + now + ' AS now' if now else ''} FROM rows0),
p1 AS (SELECT *, regexp_matches(l, '{_CLOCK}') AS written, TRY_CAST(regexp_extract(l, '{_CLOCK}', 1) AS INT) AS ch, TRY_CAST(regexp_extract(l, '{_CLOCK}', 2) AS INT) AS cm, regexp_extract(l, '{_CLOCK}', 3) AS half,
  regexp_replace(l, '{_CLOCK_CUT}', '\\1 \\2', 'g') AS rest FROM p0),
p2 AS (SELECT *, CASE WHEN written AND cm <= 59 THEN CASE WHEN half <> '' THEN CASE WHEN ch BETWEEN 1 AND 12 THEN ch % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END WHEN ch <= 23 THEN ch END * 60 + cm END AS clock,
  regexp_extract(rest, '(?:^|[^a-z])({_MONTHS})(?:$|[^a-z])', 1) AS m, TRY_CAST(regexp_extract(rest, '(?:^|{_W.replace('[', '[^')})((?:19|20)[0-9]{{2}})(?:$|{_W.replace('[', '[^')})', 1) AS INT) AS y,
  regexp_replace(rest, '(^|{_W.replace('[', '[^')})(?:19|20)[0-9]{{2}}($|{_W.replace('[', '[^')})', '\\1 \\2', 'g') AS noyear FROM p1),
p3 AS (SELECT *, {_MONTH_CASE} AS mon, TRY_CAST(regexp_extract(noyear, '(?:^|{_W.replace('[', '[^')})([0-9]{{1,2}})(?:st|nd|rd|th)?(?:$|{_W.replace('[', '[^')})', 1) AS INT) AS dd FROM p2)"""


def _day(year: str) -> str:
    return f"epoch(CAST(TRY_CAST(({year})::VARCHAR || '-' || lpad(mon::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0') AS DATE) AS TIMESTAMP)) / 60"


_EXACT = "CASE WHEN NOT (written AND clock IS NULL) THEN " + _day("y") + " + coalesce(clock, 0) END"


def _minute_text(minute: Column) -> Column:
    return F.date_format(F.timestamp_seconds(minute * 60), "yyyy-MM-dd HH:mm")


_TEXT_OF = "strftime(make_timestamp(CAST({m} AS BIGINT) * 60000000), '%Y-%m-%d %H:%M')"


@query(
    f"WITH rows0 AS (SELECT item_id, time_exact FROM items), {_parsed_sql('time_exact', None)} SELECT item_id, {_TEXT_OF.format(m='minute')} AS posted, CASE WHEN minute IS NOT NULL THEN CASE WHEN written THEN 'minute' ELSE 'day' END END AS posted_precision "
    f"FROM (SELECT *, {_EXACT} AS minute FROM p3)"
)
def exact_time_parse(spark, d) -> DataFrame:
    parsed = times.parse_exact(F.col("time_exact"))
    rows = table(spark, d, "items").select("item_id", parsed.alias("p"))
    return rows.select("item_id", _minute_text(F.col("p.minute")).alias("posted"), F.col("p.precision").alias("posted_precision"))


_UNITS = {u: (p, s) for units, (p, s) in V.TIME_UNITS.items() for u in units.split()}
_UNIT_SECONDS = "CASE unit " + " ".join(f"WHEN '{u}' THEN {s}" for u, (_, s) in _UNITS.items()) + " END"
_UNIT_PRECISION = "CASE unit " + " ".join(f"WHEN '{u}' THEN '{p}'" for u, (p, _) in _UNITS.items()) + " END"
_WEEKDAY = "CASE called " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate("monday tuesday wednesday thursday friday saturday sunday".split())) + " END"


def _relative_sql(now: str) -> str:
    """minute and precision of time_text, relative to the local second now."""
    return _parsed_sql("time_text", now) + f""",
r1 AS (SELECT *, regexp_replace(l, '^(?:about|over|almost|more than)\\s+', '') AS label FROM p3),
r2 AS (SELECT *, regexp_extract(label, '^([0-9]+|an?|one)\\s*([a-z]+)(?:\\s+ago)?$', 1) AS num, regexp_extract(label, '^([0-9]+|an?|one)\\s*([a-z]+)(?:\\s+ago)?$', 2) AS unit,
  trim(regexp_replace(regexp_replace(label, '{_CLOCK_CUT}', '\\1 \\2', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])at($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g')) AS called, floor(now / 86400) AS today, year(make_timestamp(CAST(now AS BIGINT) * 1000000)) AS this_year FROM r1),
r3 AS (SELECT *, {_UNIT_SECONDS} AS secs, {_UNIT_PRECISION} AS uprec, {_WEEKDAY} AS wd, {_day('coalesce(y, this_year)')} AS d1, {_day('this_year - 1')} AS d0 FROM r2),
r4 AS (SELECT *, CASE WHEN called = 'today' THEN today WHEN called = 'yesterday' THEN today - 1 WHEN wd IS NOT NULL THEN today - ((today + 3 - wd + 6) % 7 + 1) END AS cday, d1 + coalesce(clock, 0) AS dated FROM r3),
r5 AS (SELECT *, CASE WHEN length(l) > 60 THEN NULL WHEN l IN ({', '.join(f"'{n}'" for n in V.NOW_LABELS)}) THEN floor(now / 60) WHEN num <> '' AND secs IS NOT NULL THEN floor((now - coalesce(TRY_CAST(num AS BIGINT), 1) * secs) / 60)
  WHEN written AND clock IS NULL THEN NULL WHEN cday IS NOT NULL THEN cday * 1440 + coalesce(clock, 0) WHEN dated IS NOT NULL THEN CASE WHEN y IS NULL AND dated * 60 > now + 86400 THEN coalesce(d0 + coalesce(clock, 0), dated - 365 * 1440) ELSE dated END END AS rminute,
  CASE WHEN l IN ({', '.join(f"'{n}'" for n in V.NOW_LABELS)}) THEN 'minute' WHEN num <> '' AND secs IS NOT NULL THEN uprec WHEN written THEN 'minute' ELSE 'day' END AS rprec FROM r4)"""


_SEEN = "epoch(CAST(replace(first_seen, 'Z', '') AS TIMESTAMP))"


@query(
    f"WITH rows0 AS (SELECT item_id, time_text, first_seen FROM items), {_relative_sql(_SEEN)} SELECT item_id, {_TEXT_OF.format(m='rminute')} AS posted, CASE WHEN rminute IS NOT NULL THEN rprec END AS posted_precision FROM r5"
)
def rel_time_parse(spark, d) -> DataFrame:
    parsed = times.parse_relative(F.col("time_text"), times.utc_second(F.col("first_seen")))
    rows = table(spark, d, "items").select("item_id", parsed.alias("p"))
    return rows.select("item_id", _minute_text(F.col("p.minute")).alias("posted"), F.col("p.precision").alias("posted_precision"))


_ZONE = "coalesce(browser_utc_offset_minutes, 0)"
_OFFSET_TEXT = f"(CASE WHEN {_ZONE} < 0 THEN '-' ELSE '+' END || lpad((abs({_ZONE}) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs({_ZONE}) % 60)::VARCHAR, 2, '0'))"


@query(
    "WITH src AS (SELECT item_id, time_exact, time_text, first_seen, browser_utc_offset_minutes FROM items LEFT JOIN runs ON first_run_id = run_id), "
    f"e AS (WITH rows0 AS (SELECT item_id, time_exact FROM src), {_parsed_sql('time_exact', None)} SELECT item_id, {_EXACT} AS eminute, CASE WHEN written THEN 'minute' ELSE 'day' END AS eprec FROM p3), "
    f"r AS (WITH rows0 AS (SELECT * FROM src), {_relative_sql(_SEEN + ' + ' + _ZONE + ' * 60')} SELECT item_id, browser_utc_offset_minutes, rminute, rprec FROM r5), "
    "b AS (SELECT item_id, browser_utc_offset_minutes, coalesce(eminute, rminute) AS minute, CASE WHEN eminute IS NOT NULL THEN eprec WHEN rminute IS NOT NULL THEN rprec END AS p, CASE WHEN eminute IS NOT NULL THEN 'time_exact' WHEN rminute IS NOT NULL THEN 'time_text' END AS s FROM r JOIN e USING (item_id)) "
    f"SELECT item_id, strftime(make_timestamp(CAST(minute AS BIGINT) * 60000000), '%Y-%m-%dT%H:%M:00') || {_OFFSET_TEXT} AS posted_at, strftime(make_timestamp(CAST(minute AS BIGINT) * 60000000), '%Y-%m-%d') AS posted_date, p AS posted_at_precision, s AS posted_at_source FROM b"
)
def posted_resolved(spark, d) -> DataFrame:
    rows = table(spark, d, "items").join(table(spark, d, "runs").select("run_id", "browser_utc_offset_minutes"), F.col("first_run_id") == F.col("run_id"), "left")
    when = times.resolve(F.col("time_exact"), F.col("time_text"), F.col("first_seen"), F.col("browser_utc_offset_minutes"))
    return rows.select("item_id", when.alias("w")).select("item_id", "w.*")


# Content


def _cue(pattern: str) -> str:
    return pattern.replace("'", "''").replace("*+", "*")


def _found(pattern: str, most: int) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(hay, '{_cue(pattern)}'), lambda x: trim(x)))"


def _points(name: str) -> str:
    parts = [f"{points} * least(len({_found(p, most)}), {most})" for p, points, most in V.CUES[name]]
    if name == "promotion":
        parts += [f"CASE WHEN regexp_matches(hay, '{_cue(p)}') THEN {points} ELSE 0 END" for _, p, points in V.NAMED_CUES]
        parts.append(f"CASE WHEN len(regexp_extract_all(raw, '{_cue(V.SPECIFICATION_LINE)}')) >= 4 THEN 2 ELSE 0 END")
        parts.append("CASE WHEN length(hay) - length(replace(hay, '#', '')) >= 5 THEN 1 ELSE 0 END")
        letters = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
        parts.append(f"CASE WHEN {letters.format('coalesce(author_name, chr(32))')} <> '' AND len(list_filter(keywords, lambda k: length({letters.format('k')}) >= 3 AND contains({letters.format('coalesce(author_name, chr(32))')}, {letters.format('k')}))) > 0 THEN 3 ELSE 0 END")
    return " + ".join(parts)


_HAY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '([\\p{L}\\p{N}_])\\+([\\p{L}\\p{N}_])', '\\1 \\2', 'g'), '([\\p{L}\\p{N}_])\\+([\\p{L}\\p{N}_])', '\\1 \\2', 'g'), '[\\x{2010}-\\x{2015}]', '-', 'g'), '[\\s\\x{a0}\\x{85}\\x{2028}\\x{2029}]+', ' ', 'g')"
_CONTENT = (
    "WITH k AS (SELECT item_id, list(DISTINCT keyword) AS keywords FROM sightings WHERE keyword <> '' GROUP BY item_id), "
    f"a AS (SELECT item_id, kind, author_name, coalesce(keywords, []) AS keywords, lower({sql_nfkc('coalesce(text, chr(0)) || chr(10) || coalesce(image_text, chr(0))')}) AS raw0 FROM items LEFT JOIN k USING (item_id)), "
    f"b0 AS (SELECT * REPLACE (replace(raw0, chr(0), '') AS raw0) FROM a), b AS (SELECT *, raw0 AS raw FROM b0), c AS (SELECT *, {_HAY} AS hay FROM b), "
    f"s AS (SELECT *, CASE WHEN regexp_matches(hay, '{_cue(V.OPINION)}') THEN {V.OPINION_POINTS} ELSE 0 END AS less, {', '.join(f'{_points(n)} AS {n}' for n in content.TIE_ORDER)} FROM c) "
)


@query(
    _CONTENT + f"SELECT item_id, CASE WHEN kind = 'marketplace' THEN 'marketplace' WHEN trim(hay) = '' OR greatest({', '.join(content.TIE_ORDER)}) - less < {V.TYPE_THRESHOLD} THEN NULL "
    + " ".join(f"WHEN {n} = greatest({', '.join(content.TIE_ORDER)}) THEN '{n}'" for n in content.TIE_ORDER)
    + " END AS content_type FROM s"
)
def content_type(spark, d) -> DataFrame:
    t = tables(spark, d)
    rows = t.items.join(I.keywords_per_item(t.sightings), "item_id", "left")
    rows = spread(rows.select("item_id", "text", "image_text", "author_name", "keywords", "kind"))
    return rows.select("item_id", content.classify(*[F.col(n) for n in ("text", "image_text", "author_name", "keywords", "kind")])["content_type"].alias("content_type"))


# Labels, pages, statistics, searches


@query(
    "SELECT item_id, lower(keyword) AS keyword, arg_max(sentiment, (new, coalesce(labeled_at, ''), sentiment)) AS sentiment FROM (SELECT *, 0 AS new FROM labels UNION ALL SELECT item_id, upper(keyword), CASE sentiment WHEN 'negative' THEN 'neutral' ELSE 'negative' END, reason, labeler, '2000-01-01', 1 FROM labels WHERE sentiment <> 'neutral') GROUP BY item_id, lower(keyword)"
)
def label_upsert(spark, d) -> DataFrame:
    """New labels, in capitals and dated back, replace the old ones of the same item and keyword."""
    labels = table(spark, d, "labels")
    turned = F.when(F.col("sentiment") == "negative", "neutral").otherwise("negative")
    new = labels.where("sentiment <> 'neutral'").select("item_id", F.upper("keyword").alias("keyword"), turned.alias("sentiment"), "reason", "labeler", F.lit("2000-01-01").alias("labeled_at"))
    return L.upserted(labels, new).select("item_id", F.lower("keyword").alias("keyword"), "sentiment")


@query(
    "SELECT q.item_id, q.keyword, i.kind, i.language, coalesce(nullif(i.comment_url, ''), i.post_url) AS url, CASE WHEN length(i.text) > 1500 THEN substr(i.text, 1, 1500) || '…' ELSE i.text END AS text FROM (SELECT DISTINCT s.item_id, s.keyword FROM sightings s JOIN runs r USING (run_id) JOIN items i ON i.item_id = s.item_id "
    "WHERE i.content_type IS NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.item_id = s.item_id AND lower(l.keyword) = lower(s.keyword)) ORDER BY s.item_id, s.keyword NULLS FIRST LIMIT 50) q JOIN items i USING (item_id)"
)
def label_queue_page(spark, d) -> DataFrame:
    return L.label_queue(tables(spark, d), 50).select("item_id", "keyword", "kind", "language", "url", "text")


@query(
    "SELECT run_id, keyword, coalesce(status, '') = 'completed' AS ok, status, records, coalesce(array_to_string(list_sort(list_transform(list_filter(map_entries(stats), lambda e: starts_with(e.key, 'skipped_') AND e.key <> 'skipped_not_posts' AND e.value <> 0), lambda e: substr(e.key, 9) || '=' || e.value::VARCHAR)), ','), '') AS filtered_out FROM runs"
)
def run_summaries(spark, d) -> DataFrame:
    rows = R.summaries(table(spark, d, "runs"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("filtered_out"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return rows.select("run_id", "keyword", "ok", "status", "records", F.coalesce(shown, F.lit("")).alias("filtered_out"))


_VISIBLE = "SELECT * FROM items WHERE content_type IS NULL AND item_id IN (SELECT item_id FROM sightings WHERE lower(keyword) = 'rooftop solar')"


@query(
    f"WITH i AS ({_VISIBLE}) SELECT 'totals' AS part, '' AS value, count(*) AS n FROM i UNION ALL SELECT 'by_kind', coalesce(kind, 'unknown'), count(*) FROM i GROUP BY ALL UNION ALL SELECT 'by_language', coalesce(language, 'unknown'), count(*) FROM i GROUP BY ALL "
    "UNION ALL SELECT 'by_month', coalesce(substr(posted_date, 1, 7), 'unknown'), count(*) FROM i GROUP BY ALL UNION ALL SELECT 'top_groups', group_name, count(*) FROM i WHERE group_name IS NOT NULL GROUP BY ALL"
)
def statistics_once(spark, d) -> DataFrame:
    """Totals and facets of filtered items, counted in one pass."""
    return I.counted(I.filtered(tables(spark, d), Filters(keyword="rooftop solar"))).select("part", "value", "n")


@query(f"SELECT keyword AS value, count(DISTINCT item_id) AS n FROM (SELECT min(keyword) OVER (PARTITION BY lower(keyword)) AS keyword, item_id FROM sightings WHERE keyword IS NOT NULL AND item_id IN (SELECT item_id FROM ({_VISIBLE}))) GROUP BY keyword")
def by_keyword_filtered(spark, d) -> DataFrame:
    t = tables(spark, d)
    return I.by_keyword(I.filtered(t, Filters(keyword="rooftop solar")), t.sightings)


@query("SELECT count(*) FILTER (item_id NOT IN (SELECT item_id FROM (SELECT item_id FROM sightings WHERE run_id = (SELECT max(run_id) FROM sightings)))) AS items, (SELECT count(*) FROM sightings WHERE item_id NOT IN (SELECT item_id FROM sightings WHERE run_id = (SELECT max(run_id) FROM sightings))) AS sightings, (SELECT count(*) FROM labels WHERE item_id NOT IN (SELECT item_id FROM sightings WHERE run_id = (SELECT max(run_id) FROM sightings))) AS labels FROM items")
def exclusion_applied(spark, d) -> DataFrame:
    """What is left after all items of the last run are excluded."""
    t = tables(spark, d)
    last = t.sightings.agg(F.max("run_id").alias("run_id"))
    ids = t.sightings.join(last, "run_id", "left_semi").select("item_id").distinct()
    left: Tables = L.after_exclusion(t, L.excluded(t.sightings, ids, "off topic", "2026-01-01T00:00:00Z"))
    counts = [df.agg(F.count("*").alias(n)) for n, df in (("items", left.items), ("sightings", left.sightings), ("labels", left.labels))]
    rows = counts[0]
    for c in counts[1:]:
        rows = rows.unionByName(c, allowMissingColumns=True)
    return rows.agg(*[F.sum(n).alias(n) for n in ("items", "sightings", "labels")])


def _holds(column: str) -> str:
    return f"regexp_matches({sql_normal(column)}, '{sql_term('rooftop solar')}')"


@query(
    "WITH c AS (SELECT first_run_id, item_id, kind, url_key, " + _holds("text") + " AS own, " + _holds("image_text") + " AS seen FROM items WHERE url_key IS NOT NULL), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY first_run_id, url_key ORDER BY item_id) AS n FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY first_run_id ORDER BY item_id) AS search_rank FROM f WHERE n = 1) "
    "SELECT item_id, search_rank, CASE WHEN kind IN ('comment', 'reply') THEN CASE WHEN own THEN 'text' END WHEN kind = 'marketplace' THEN CASE WHEN own THEN 'title' END WHEN kind = 'profile' THEN NULL WHEN own THEN 'text' WHEN seen THEN 'image_text' END AS matched_in FROM r"
)
def verified_candidates(spark, d) -> DataFrame:
    """Items with a URL key as candidates of their first run's search: without repeats, ranked, verified."""
    none = F.lit(None).cast("string")
    rows = table(spark, d, "items").where("url_key is not null").select("item_id", "first_run_id", F.col("item_id").alias("position"), "url_key", "kind", "text", none.alias("full_text"), "image_text", none.alias("name_text"), "author_name")
    return collect.judged(spread(rows), "rooftop solar", search="first_run_id").select("item_id", "search_rank", "matched_in")
