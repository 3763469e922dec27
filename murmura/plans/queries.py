"""Registered queries of the relational and text operators, each over its whole table, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.functions import content, identity, language, times, urls
from murmura.functions import text as X
from murmura.operators import items as I
from murmura.operators import labels as L
from murmura.operators.items import Filters, Tables
from murmura.plans.study import plan_of
from murmura.session import spread, table
from murmura.sources import runs as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SALT = bytes(range(32))  # for the registered query only


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL if it has one."""

    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def tables(spark: SparkSession, d: str) -> Tables:
    return Tables(*[table(spark, d, n) for n in ("items", "sightings", "runs", "labels")])


# SQL of the text normal form: full-width forms, ligatures, the ellipsis and blanks as compatibility normalisation
# maps them, zero-width characters gone.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_BLANKS = "    　"
_GONE = "​‌‍⁠﻿"


def sql_nfkc(x: str) -> str:
    x = f"translate({x}, '{_WIDE}{_BLANKS}', '{_NARROW}{' ' * len(_BLANKS)}')"
    for a, b in (("ﬃ", "ffi"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("…", "...")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"nfc_normalize({x})"


def sql_normal(x: str) -> str:
    space = "[ \\t\\n\\v\\f\\r\\x{1c}-\\x{1f}\\x{85}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{205f}]+"
    return f"trim(regexp_replace(regexp_replace({sql_nfkc(f'coalesce({x}, chr(32))')}, '[{_GONE}]', '', 'g'), '{space}', ' ', 'g'))"


def sql_term(term: str) -> str:
    body = "[^\\p{L}\\p{N}]*".join(term.split())
    return f"(?i)(^|[^_\\p{{L}}\\p{{N}}]){body}($|[^_\\p{{L}}\\p{{N}}])"


_TEXT = sql_normal("text")
_PRINT = f"substr(regexp_replace(lower({_TEXT}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 1, 160)"

# Keyword verification


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({_TEXT}, '{sql_term('rooftop solar')}')")
def kw_phrase(spark, d):
    return table(spark, d, "documents").where(X.matches("rooftop solar", F.col("text"))).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({_TEXT}, '{sql_term('warranty')}') AND regexp_matches({_TEXT}, '{sql_term('card')}')")
def kw_all(spark, d):
    return table(spark, d, "documents").where(X.matches("warranty card", F.col("text"), "all")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({_TEXT}, '{sql_term('gasket')}') OR regexp_matches({_TEXT}, '{sql_term('thermostat')}')")
def kw_any(spark, d):
    return table(spark, d, "documents").where(X.matches("gasket thermostat", F.col("text"), "any")).select("doc_id")


@query(
    f"SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches({_TEXT}, '{sql_term('gasket')}') THEN 'gasket' END, "
    f"CASE WHEN regexp_matches({_TEXT}, '{sql_term('thermostat')}') THEN 'thermostat' END) AS terms FROM documents"
)
def kw_matched_terms(spark, d):
    found = X.matched_terms(["gasket", "thermostat"], X.normalize(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", found).alias("terms"))


@query(
    f"WITH n AS (SELECT doc_id, {_TEXT} AS h FROM documents), m AS (SELECT doc_id, h, length(regexp_extract(h, '(?is)^(.*?(?:^|[^_\\p{{L}}\\p{{N}}]))warranty[^\\p{{L}}\\p{{N}}]*card(?:$|[^_\\p{{L}}\\p{{N}}])', 1)) AS s, "
    f"length(regexp_extract(h, '(?i)(?:^|[^_\\p{{L}}\\p{{N}}])(warranty[^\\p{{L}}\\p{{N}}]*card)(?:$|[^_\\p{{L}}\\p{{N}}])', 1)) AS k FROM n WHERE regexp_matches(h, '{sql_term('warranty card')}')) "
    "SELECT doc_id, (CASE WHEN s > 70 THEN '…' ELSE '' END) || substr(h, greatest(s - 70, 0) + 1, least(s + k + 70, length(h)) - greatest(s - 70, 0)) || (CASE WHEN s + k + 70 < length(h) THEN '…' ELSE '' END) AS snippet FROM m"
)
def kw_snippet(spark, d):
    found = table(spark, d, "documents").select("doc_id", X.match_keyword("warranty card", F.col("text")).alias("m"))
    return found.where("m.ok").select("doc_id", "m.snippet")


@query(
    "SELECT item_id, CASE WHEN regexp_matches(" + sql_normal("text") + f", '{sql_term('rooftop solar')}') THEN 'text' WHEN regexp_matches(" + sql_normal("image_text") + f", '{sql_term('rooftop solar')}') THEN 'image_text' "
    "WHEN regexp_matches(" + sql_normal("author_name") + f", '{sql_term('rooftop solar')}') THEN 'name' END AS matched_in FROM items"
)
def verify_cascade(spark, d):
    columns = {"text": F.col("text"), "image_text": F.col("image_text"), "name": F.col("author_name")}
    return table(spark, d, "items").select("item_id", X.verified_in("rooftop solar", columns).alias("matched_in"))


# Text forms and keys


@query(f"SELECT doc_id, {_PRINT} AS fingerprint FROM documents")
def fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@query(f"SELECT doc_id, CASE WHEN length(p) >= 12 THEN 'ck_' || substr(sha1('post|' || lower(coalesce(source, '')) || '|' || p), 1, 16) END AS content_key FROM (SELECT doc_id, source, {_PRINT} AS p FROM documents)")
def content_key(spark, d):
    key = X.content_key(F.col("text"), F.lit("post"), F.col("source"), F.lit(None).cast("string"))
    return table(spark, d, "documents").select("doc_id", key.alias("content_key"))


@query(f"SELECT p AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, {_PRINT} AS p FROM documents) WHERE length(p) >= 12 GROUP BY p HAVING count(*) > 1")
def dedup_exact_groups(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint")).where(F.length("fingerprint") >= 12)
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY CASE WHEN length(p) >= 12 THEN p ELSE cast(doc_id AS VARCHAR) END ORDER BY doc_id) AS k FROM (SELECT doc_id, {_PRINT} AS p FROM documents)) WHERE k = 1")
def dedup_keep_first(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("p"))
    key = F.when(F.length("p") >= 12, F.col("p")).otherwise(F.col("doc_id").cast("string"))
    return rows.groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT content_key, arg_max(item_id, (length(coalesce(text, '')), item_id)) AS item_id, max(length(coalesce(text, ''))) AS chars FROM items WHERE content_key IS NOT NULL GROUP BY content_key")
def merge_longest_text(spark, d):
    size = F.length(F.coalesce("text", F.lit("")))
    rows = table(spark, d, "items").where("content_key is not null")
    return rows.groupBy("content_key").agg(F.max_by("item_id", F.struct(size, "item_id")).alias("item_id"), F.max(size).alias("chars"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS text FROM documents")
def text_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncated(F.col("text"), 100).alias("text"))


@query(
    "SELECT item_id, regexp_replace(array_to_string(list_filter(string_split(regexp_replace(text, '(?m)([ \\t]*\\bSee (more|less)\\b[….]*)+[ \\t]*$', '', 'g'), chr(10)), lambda x: trim(x) <> 'Facebook'), chr(10)), "
    "'^[\\s    ]+|[\\s    ]+$', '', 'g') AS text FROM items"
)
def clean_text_lines(spark, d):
    return table(spark, d, "items").select("item_id", X.clean_text(F.col("text")).alias("text"))


@query("SELECT run_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(coalesce(keyword, '')), '[^_\\p{L}\\p{N}]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 1, 60), ''), 'keyword') AS slug FROM runs")
def slugs(spark, d):
    return table(spark, d, "runs").select("run_id", X.slugify(F.col("keyword")).alias("slug"))


@query("SELECT item_id, 'r_' || substr(sha1(item_id), 1, 12) AS record_id, sha1(trim(regexp_replace(lower(coalesce(group_name, '')), '\\s+', ' ', 'g'))) AS text_key FROM items")
def record_keys(spark, d):
    return table(spark, d, "items").select("item_id", X.record_id(F.col("item_id")).alias("record_id"), X.text_key(F.col("group_name")).alias("text_key"))


@query("SELECT item_id, nullif(array_to_string(list_filter(string_split(image_text, chr(10)), lambda x: lower(trim(x)) NOT IN ('no photo description available.', 'no photo description available')), chr(10)), '') AS image_text FROM items")
def image_texts(spark, d):
    return table(spark, d, "items").select("item_id", X.image_text(F.split("image_text", "\n")).alias("image_text"))


_INNER = "".join(f"\\x{b ^ 0x36:02x}" for b in SALT.ljust(64, b"\0"))
_OUTER = "".join(f"\\x{b ^ 0x5C:02x}" for b in SALT.ljust(64, b"\0"))


@query(
    f"SELECT doc_id, CASE WHEN source <> '' THEN 'a_' || substr(sha256(unhex('{_OUTER.replace(chr(92) + 'x', '')}') || unhex(sha256(unhex('{_INNER.replace(chr(92) + 'x', '')}') || encode(lower(trim(source)))))), 1, 12) END AS author_id FROM documents"
)
def pseudonyms(spark, d):
    return table(spark, d, "documents").select("doc_id", identity.pseudonym(F.col("source"), SALT).alias("author_id"))


# Language and content


def _in_list(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_T = sql_nfkc("coalesce(text, '')")
_SCRIPTS = {
    "arabic": "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]", "devanagari": "[\\x{0900}-\\x{097F}]",
    "bengali": "[\\x{0980}-\\x{09FF}]", "latin": "[A-Za-z\\x{00C0}-\\x{024F}]",
}


def _letters_in(script: str) -> str:
    return f"len(list_filter(regexp_extract_all(t, '\\p{{L}}'), lambda x: regexp_matches(x, '{_SCRIPTS[script]}')))"


@query(f"SELECT doc_id, {', '.join(f'{_letters_in(s)} AS {s}' for s in _SCRIPTS)}, len(regexp_extract_all(t, '\\p{{L}}')) AS letters FROM (SELECT doc_id, {_T} AS t FROM documents)")
def script_counts(spark, d):
    normal = X.nfkc(F.coalesce("text", F.lit("")))
    counts = language.script_counts(normal)
    return table(spark, d, "documents").select("doc_id", *[counts[s].cast("bigint").alias(s) for s in _SCRIPTS], F.regexp_count(normal, F.lit(r"\p{L}")).cast("bigint").alias("letters"))


def _hits(names: list[str]) -> str:
    return f"len(list_filter(w, lambda x: x IN {_in_list(names)}))"


_LANGUAGE = f"""
WITH a AS (SELECT doc_id, lang, source, {_T} AS t FROM documents),
b AS (SELECT doc_id, lang, source, t, {', '.join(f'{_letters_in(s)} AS {s}' for s in _SCRIPTS)}, len(regexp_extract_all(t, '\\p{{L}}')) AS letters,
  list_transform(list_filter(regexp_extract_all(t, '\\p{{L}}+'), lambda x: regexp_matches(x, '^[A-Za-z]+$')), lambda x: lower(x)) AS w FROM a),
c AS (SELECT *, {_hits(language.V.ENGLISH)} AS en, {_hits(language.V.ROMAN_URDU)} AS ru, {_hits(language.V.TAGALOG)} AS tl FROM b),
e AS (SELECT doc_id, lang, source, CASE WHEN letters < 3 THEN 'und'
  WHEN arabic >= greatest(devanagari, bengali, latin) AND arabic > latin THEN CASE WHEN regexp_matches(t, '[{language.V.URDU_LETTERS}]') THEN 'ur' WHEN regexp_matches(t, '[{language.V.PERSIAN_LETTERS}]') THEN 'fa' ELSE 'ar' END
  WHEN devanagari >= greatest(bengali, latin) AND devanagari > latin THEN 'hi' WHEN bengali > latin THEN 'bn'
  WHEN latin >= 1 THEN CASE WHEN ru >= 2 OR tl >= 2 THEN CASE WHEN ru >= tl THEN 'ur-Latn' ELSE 'tl' END WHEN en >= 1 AND en >= ru AND en >= tl THEN 'en' WHEN ru >= 1 THEN 'ur-Latn' WHEN tl >= 1 THEN 'tl' ELSE 'und' END
  ELSE 'und' END AS language FROM c)
"""  # ties between scripts do not occur in the data


@query(_LANGUAGE + "SELECT doc_id, language FROM e")
def lang_detect(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", language.detect_language(F.col("text")).alias("language"))


@query(_LANGUAGE + "SELECT coalesce(lang, 'unknown') AS lang, language, count(*) AS n FROM e GROUP BY ALL")
def lang_confusion(spark, d):
    rows = spread(table(spark, d, "documents").select("lang", "text")).select(F.coalesce("lang", F.lit("unknown")).alias("lang"), language.detect_language(F.col("text")).alias("language"))
    return rows.groupBy("lang", "language").agg(F.count("*").alias("n"))



# Times and URLs





@query("SELECT item_id, regexp_replace(post_url, '#.*$', '') AS post_url, regexp_extract(post_url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(post_url, '[?&]fbid=([^&#]*)', 1), '') AS fbid FROM items WHERE post_url IS NOT NULL")
def url_parts(spark, d):
    rows = table(spark, d, "items").where("post_url is not null")
    return rows.select("item_id", urls.canonical_url(F.col("post_url")).alias("post_url"), F.try_parse_url("post_url", F.lit("HOST")).alias("host"), F.try_parse_url("post_url", F.lit("QUERY"), F.lit("fbid")).alias("fbid"))


@query("SELECT regexp_extract(post_url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM items WHERE post_url IS NOT NULL GROUP BY ALL")
def url_host_counts(spark, d):
    return table(spark, d, "items").where("post_url is not null").groupBy(F.try_parse_url("post_url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN post_url IS NULL THEN 'none' ELSE 'external' END AS role, count(*) AS n FROM items GROUP BY ALL")
def link_roles(spark, d):
    return table(spark, d, "items").groupBy(urls.role_of(F.col("post_url")).alias("role")).agg(F.count("*").alias("n"))


# Facets and statistics


def _facet_sql(t: str, c: str) -> str:
    return f"SELECT coalesce({c}, 'unknown') AS value, count(*) AS n FROM {t} GROUP BY ALL ORDER BY n DESC, value"


@query(_facet_sql("documents", "source"))
def facet_source(spark, d):
    return I.facet(table(spark, d, "documents"), "source")


@query(_facet_sql("items", "language"))
def facet_lang(spark, d):
    return I.facet(table(spark, d, "items"), "language")


@query(_facet_sql("items", "kind"))
def facet_kind(spark, d):
    return I.facet(table(spark, d, "items"), "kind")


@query("SELECT coalesce(substr(posted_date, 1, 7), 'unknown') AS value, count(*) AS n FROM items GROUP BY ALL")
def facet_month(spark, d):
    return I.by_month(table(spark, d, "items"))


@query("SELECT group_name AS value, count(*) AS n FROM items WHERE group_name IS NOT NULL GROUP BY ALL ORDER BY n DESC, value LIMIT 10")
def top_groups(spark, d):
    return I.facet(table(spark, d, "items").where("group_name is not null"), "group_name", 10)


@query("SELECT item_id, min(captured_at) AS first_seen, max(captured_at) AS last_seen, count(DISTINCT run_id) AS times_seen FROM sightings GROUP BY item_id")
def item_first_last_seen(spark, d):
    return I.seen_spans(table(spark, d, "sightings")).select("item_id", "first_seen", "last_seen", "times_seen")


@query(
    "SELECT item_id, max(run_id) FILTER (a = 1) AS first_run_id, max(run_id) FILTER (z = 1) AS last_run_id FROM (SELECT item_id, run_id, row_number() OVER (PARTITION BY item_id ORDER BY captured_at IS NOT NULL, captured_at, run_id, record_id) AS a, "
    "row_number() OVER (PARTITION BY item_id ORDER BY captured_at IS NULL, captured_at DESC, run_id DESC, record_id DESC) AS z FROM sightings) GROUP BY item_id"
)
def first_last_run(spark, d):
    return I.seen_spans(table(spark, d, "sightings")).select("item_id", "first_run_id", "last_run_id")


@query("SELECT count(*) AS items, min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(*) FILTER (times_seen > 1) AS seen_more_than_once, count(*) FILTER (posted_date IS NULL) AS undated FROM items")
def stats_totals(spark, d):
    return I.totals(table(spark, d, "items"))


_FOLD = "lower(keyword)"


@query(f"SELECT min(keyword) AS value, count(DISTINCT item_id) AS n FROM sightings WHERE keyword IS NOT NULL GROUP BY {_FOLD}")
def by_keyword_distinct(spark, d):
    return I.by_keyword(table(spark, d, "items"), table(spark, d, "sightings"))


@query("SELECT sentiment AS value, count(DISTINCT item_id) AS n FROM labels WHERE item_id IN (SELECT item_id FROM items) GROUP BY sentiment")
def by_sentiment(spark, d):
    return I.by_sentiment(table(spark, d, "items"), table(spark, d, "labels"))


@query("SELECT count(*) AS items FROM items i WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.item_id = i.item_id)")
def not_labelled(spark, d):
    return I.not_labelled(table(spark, d, "items"), table(spark, d, "labels")).agg(F.count("*").alias("items"))


# Filters

_OPEN = "content_type IS NULL"


def _filter(sql: str, **f):
    def run(spark, d):
        return I.filtered(tables(spark, d), Filters(**f)).select("item_id")

    return run, f"SELECT item_id FROM items WHERE {sql}"


_FILTERS = {
    "filter_keyword": _filter(f"{_OPEN} AND item_id IN (SELECT item_id FROM sightings WHERE lower(keyword) = 'rooftop solar')", keyword="Rooftop Solar"),
    "filter_kind": _filter(f"{_OPEN} AND kind IN ('comment', 'reply')", kind="comment, reply"),
    "filter_language": _filter(f"{_OPEN} AND language IN ('ur', 'hi')", language=["ur", "hi"]),
    "filter_sentiment": _filter("item_id IN (SELECT item_id FROM labels WHERE sentiment = 'negative')", sentiment="Negative", include_types="all"),
    "filter_batch": _filter(f"{_OPEN} AND item_id IN (SELECT item_id FROM sightings JOIN runs USING (run_id) WHERE batch_id = 'study_000000')", batch_id="study_000000"),
    "filter_group_like": _filter(f"{_OPEN} AND (lower(group_name) LIKE '%users%' OR lower(group_url) LIKE '%users%')", group="Users"),
    "filter_contains_like": _filter(f"{_OPEN} AND (lower(text) LIKE '%gas_et%' OR lower(image_text) LIKE '%gas_et%' OR lower(price) LIKE '%gas_et%' OR lower(location) LIKE '%gas_et%')", contains="Gas_et"),
    "filter_since_until": _filter(f"{_OPEN} AND posted_date >= '2026-03-01' AND posted_date <= '2026-06-30'", since="2026-03-01", until="2026-06-30"),
    "visibility_filter": _filter("content_type IS NULL OR content_type IN ('job', 'spam')", include_types="job,spam"),
    "visibility_marketplace": _filter("(content_type IS NULL OR content_type = 'marketplace') AND kind = 'marketplace'", kind="marketplace"),
}
for _name, (_run, _sql) in _FILTERS.items():
    _run.__name__ = _name
    query(_sql)(_run)


@query("SELECT item_id FROM items WHERE content_type IS NULL AND item_id IN (SELECT item_id FROM sightings WHERE run_id = (SELECT max(run_id) FROM runs))")
def filter_run(spark, d):
    t = tables(spark, d)
    last = t.runs.agg(F.max("run_id")).first()[0]
    return I.filtered(t, Filters(run_id=last or "-")).select("item_id")


@query("SELECT content_type AS value, count(*) AS n FROM items WHERE content_type IS NOT NULL AND content_type <> 'job' GROUP BY ALL")
def hidden_by_type(spark, d):
    return I.hidden(tables(spark, d), Filters(include_types="job"))


# Pages, labels, exclusions


@query("SELECT item_id, posted_at, last_seen FROM items WHERE content_type IS NULL ORDER BY posted_at DESC NULLS LAST, last_seen DESC NULLS LAST, item_id LIMIT 50 OFFSET 25")
def items_page(spark, d):
    return I.page(tables(spark, d), Filters(), 50, 25).select("item_id", "posted_at", "last_seen")


@query("SELECT item_id, string_agg(keyword, ' | ' ORDER BY keyword) AS keywords FROM (SELECT DISTINCT item_id, keyword FROM sightings WHERE keyword <> '') GROUP BY item_id")
def keywords_per_item(spark, d):
    return I.keywords_per_item(table(spark, d, "sightings")).select("item_id", F.concat_ws(" | ", "keywords").alias("keywords"))


@query(
    "SELECT item_id, CASE WHEN count(*) = 1 THEN max(sentiment) ELSE string_agg(keyword || ': ' || sentiment, ' | ' ORDER BY lower(keyword), keyword, sentiment, reason NULLS FIRST) END AS sentiment, "
    "CASE WHEN count(*) = 1 THEN max(reason) ELSE nullif(string_agg(CASE WHEN coalesce(reason, '') <> '' THEN keyword || ': ' || reason END, ' | ' ORDER BY lower(keyword), keyword, sentiment, reason NULLS FIRST), '') END AS sentiment_reason FROM labels GROUP BY item_id"
)
def label_strings(spark, d):
    return I.label_strings(table(spark, d, "labels"))


_QUEUE = (
    "SELECT DISTINCT s.item_id, s.keyword FROM sightings s JOIN runs r USING (run_id) JOIN items i ON i.item_id = s.item_id WHERE i.content_type IS NULL "
    "AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.item_id = s.item_id AND lower(l.keyword) = lower(s.keyword))"
)


@query(_QUEUE)
def label_queue(spark, d):
    return L.queue_pairs(tables(spark, d))


@query(f"SELECT count(*) AS remaining FROM ({_QUEUE})")
def label_queue_remaining(spark, d):
    return L.remaining(tables(spark, d))



@query("SELECT item_id, count(*) AS n FROM sightings s WHERE NOT EXISTS (SELECT 1 FROM exclusions e WHERE e.run_id = s.run_id AND e.record_id = s.record_id) GROUP BY item_id")
def exclusions_anti(spark, d):
    return L.without_excluded(table(spark, d, "sightings"), table(spark, d, "exclusions")).groupBy("item_id").agg(F.count("*").alias("n"))


@query("SELECT run_id, keyword, started_at FROM runs ORDER BY coalesce(started_at, '') DESC, run_id LIMIT 20")
def runs_listed(spark, d):
    return R.listed(table(spark, d, "runs")).select("run_id", "keyword", "started_at")



@query("SELECT run_id, record_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY search_rank NULLS LAST, record_id, item_id) AS rank FROM (SELECT DISTINCT run_id, record_id, item_id, search_rank FROM sightings WHERE keyword_verified)) WHERE rank <= 10")
def verified_top(spark, d):
    rows = table(spark, d, "sightings").where("keyword_verified").select("run_id", "record_id", "item_id", "search_rank").distinct()
    order = Window.partitionBy("run_id").orderBy(F.asc_nulls_last("search_rank"), "record_id", "item_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 10").select("run_id", "record_id", "item_id", "rank")


@query("SELECT c.item_id, coalesce(p.url_key, 'none') AS parent_key FROM items c LEFT JOIN (SELECT post_url, min(url_key) AS url_key FROM items WHERE kind NOT IN ('comment', 'reply') GROUP BY post_url) p ON p.post_url = c.parent_post_url WHERE c.kind IN ('comment', 'reply')")
def comment_parent_key(spark, d):
    items = table(spark, d, "items")
    posts = items.where("kind not in ('comment', 'reply')").groupBy("post_url").agg(F.min("url_key").alias("parent"))
    comments = items.where("kind in ('comment', 'reply')").select("item_id", "parent_post_url")
    return comments.join(posts, F.col("parent_post_url") == F.col("post_url"), "left").select("item_id", F.coalesce("parent", F.lit("none")).alias("parent_key"))


@query(
    "WITH k AS (SELECT row_number() OVER (ORDER BY keyword) AS keyword_position, keyword FROM (SELECT DISTINCT keyword FROM runs)), s AS (SELECT row_number() OVER (ORDER BY scope) AS scope_position, scope FROM (SELECT DISTINCT scope FROM runs)) "
    "SELECT keyword_position, keyword, scope_position, scope FROM k, s"
)
def study_plan(spark, d):
    runs = table(spark, d, "runs")
    return plan_of(*[R.ranked(runs.select(name).distinct(), [F.asc_nulls_last(name)]) for name in ("keyword", "scope")])


@query()
def entity_resolution(spark, d):
    """The sightings of the dataset resolved again from their items' fields, in the order of import."""
    from murmura.operators import entity

    t = tables(spark, d)
    fields = ["kind", "post_url", "comment_url", "parent_post_url", "author_name", "author_url", "group_name", "group_url", "text", "image_text", "time_text", "time_exact", "price", "location", "condition"]
    rows = t.sightings.select("item_id", "run_id", "record_id", "keyword", "source", "search_rank", "keyword_verified", "matched_in", "matched_terms", "match_snippet", "screenshot_path", "captured_at")
    records = rows.join(t.items.select("item_id", *fields), "item_id").join(t.runs.select("run_id", F.col("keyword").alias("run_keyword"), "browser_utc_offset_minutes", "imported_at"), "run_id")
    numbered = R.numbered(records.drop("item_id"), ["imported_at", "run_id", "record_id", "captured_at", "screenshot_path"])
    return entity.resolved(numbered)["outcomes"].groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))
