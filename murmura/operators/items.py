"""The relational layer: item filters, pages, facets, counts and statistics as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import fixed_values as V
from murmura.functions.text import ascii_lower, contains_like, truncated
from murmura.session import cut

#: Columns of an item page and of an export, in order.
ITEM_COLUMNS = (
    "item_id kind keywords sentiment sentiment_reason content_type content_reason language text image_text price location condition posted_at posted_date "
    "posted_at_precision author_name author_url group_name group_url post_url comment_url parent_post_url time_text time_exact first_seen last_seen times_seen screenshot_path first_run_id"
).split()


#: Most rows of a page that a caller may ask for, and most pairs of a label queue.
MOST_ITEMS, MOST_PAIRS = 500, 50


def clamped(n: int | None, most: int) -> int:
    """n from 1 to most; None asks for as many as there may be."""
    return most if n is None else max(1, min(int(n), most))


def split_list(value: str | Iterable[str] | None) -> list[str]:
    """A comma string or a list without blanks and empties."""
    if not value:
        return []
    return [v.strip() for v in (value.split(",") if isinstance(value, str) else value) if v and v.strip()]


def parse_types(value: str | Iterable[str] | None) -> tuple[str, ...]:
    """Content types by name; ``all`` stands for every type, an unknown one raises ValueError."""
    names = [v.lower() for v in split_list(value)]
    if "all" in names:
        return V.CONTENT_TYPES
    if unknown := [n for n in names if n not in V.CONTENT_TYPES]:
        raise ValueError(f"unknown content types: {', '.join(unknown)}; known: {', '.join(V.CONTENT_TYPES)}")
    return tuple(dict.fromkeys(names))


def visible_types(column: Column, include_types: str | Iterable[str] | None, kinds: Iterable[str] = ()) -> Column | None:
    """The visibility predicate: ordinary items and the types asked for; None where nothing is hidden."""
    shown = set(parse_types(include_types)) | ({"marketplace"} & set(kinds))
    if shown == set(V.CONTENT_TYPES):
        return None
    return column.isNull() | column.isin(sorted(shown)) if shown else column.isNull()


@dataclass(frozen=True)
class Filters:
    """What to keep of the items; all conditions hold together, None asks for nothing.

    group and contains take % and _ as wildcards; since and until compare posted_date as text, both inclusive.
    """

    keyword: str | None = None
    kind: str | Iterable[str] | None = None
    language: str | Iterable[str] | None = None
    sentiment: str | Iterable[str] | None = None
    run_id: str | None = None
    batch_id: str | None = None
    group: str | None = None
    since: str | None = None
    until: str | None = None
    contains: str | None = None
    include_types: str | Iterable[str] | None = field(default=None)


@dataclass(frozen=True)
class Tables:
    """The tables that queries read."""

    items: DataFrame
    sightings: DataFrame
    runs: DataFrame
    labels: DataFrame


def filtered(t: Tables, f: Filters) -> DataFrame:
    """Items that pass the filters; lookups in other tables are left semi joins."""
    items, kinds = t.items, split_list(f.kind)
    if (seen := visible_types(F.col("content_type"), f.include_types, kinds)) is not None:
        items = items.where(seen)
    if kinds:
        items = items.where(F.col("kind").isin(kinds))
    if languages := split_list(f.language):
        items = items.where(F.col("language").isin(languages))
    if f.since:
        items = items.where(F.col("posted_date") >= f.since)
    if f.until:
        items = items.where(F.col("posted_date") <= f.until)
    if f.group:
        items = items.where(contains_like(F.col("group_name"), f.group) | contains_like(F.col("group_url"), f.group))
    if f.contains:
        hits = [contains_like(F.col(c), f.contains) for c in ("text", "image_text", "price", "location")]
        items = items.where(hits[0] | hits[1] | hits[2] | hits[3])
    for chosen in _lookups(t, f):
        items = items.join(chosen.select("item_id"), "item_id", "left_semi")
    return items


def _lookups(t: Tables, f: Filters) -> Iterable[DataFrame]:
    if f.run_id:
        yield t.sightings.where(F.col("run_id") == f.run_id)
    if f.batch_id:
        yield t.sightings.join(t.runs.where(F.col("batch_id") == f.batch_id).select("run_id"), "run_id", "left_semi")
    if sentiments := [s.lower() for s in split_list(f.sentiment)]:
        labels = t.labels.where(F.col("sentiment").isin(sentiments))
        yield labels.where(keyword_is(F.col("keyword"), f.keyword)) if f.keyword else labels
    if f.keyword:
        yield t.sightings.where(keyword_is(F.col("keyword"), f.keyword))


def keyword_is(column: Column, keyword: str) -> Column:
    """Equal without regard to ASCII case."""
    return ascii_lower(column) == ascii_lower(F.lit(keyword))


def keywords_per_item(sightings: DataFrame) -> DataFrame:
    """item_id with its distinct non-empty keywords, sorted."""
    return sightings.where(F.col("keyword") != "").groupBy("item_id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))


def label_strings(labels: DataFrame, keyword: str | None = None) -> DataFrame:
    """item_id, sentiment, sentiment_reason: one label as it is, several as ``keyword: value | …`` by keyword."""
    if keyword:
        labels = labels.where(keyword_is(F.col("keyword"), keyword))
    entry = F.struct(ascii_lower(F.col("keyword")).alias("k"), "keyword", "sentiment", "reason")
    per_item = labels.groupBy("item_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    one = F.size("all") == 1
    mixed = F.array_join(F.transform("all", lambda x: F.concat(x["keyword"], F.lit(": "), x["sentiment"])), " | ")
    given = F.filter("all", lambda x: F.coalesce(x["reason"], F.lit("")) != "")
    reasons = F.array_join(F.transform(given, lambda x: F.concat(x["keyword"], F.lit(": "), x["reason"])), " | ")
    return per_item.select(
        "item_id",
        F.when(one, F.col("all")[0]["sentiment"]).otherwise(mixed).alias("sentiment"),
        F.when(one, F.col("all")[0]["reason"]).when(reasons != "", reasons).alias("sentiment_reason"),
    )


def with_details(t: Tables, items: DataFrame, keyword: str | None = None, few: bool = False) -> DataFrame:
    """Items with their keywords and label strings.

    few: items is a page of MOST_ITEMS rows at most; only its rows of the other tables are aggregated.
    """
    sightings, labels = t.sightings, t.labels
    if few:
        ids = F.broadcast(items.select("item_id"))
        sightings, labels = (df.join(ids, "item_id", "left_semi") for df in (sightings, labels))
    out = items.join(keywords_per_item(sightings), "item_id", "left").join(label_strings(labels, keyword), "item_id", "left")
    return out.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def newest_first(items: DataFrame) -> DataFrame:
    """Order of a page: posted_at as text, undated last, then last_seen; item_id breaks ties."""
    return items.orderBy(F.desc_nulls_last("posted_at"), F.desc_nulls_last("last_seen"), "item_id")


def page(t: Tables, f: Filters, limit: int | None = 20, offset: int = 0, text_chars: int = 400, root: str | None = None) -> DataFrame:
    """A page of items with details; without a limit everything, and the offset is ignored.

    With the dataset's root, screenshot_file holds the full path of each screenshot.
    """
    chosen = newest_first(filtered(t, f))
    if limit:
        chosen = chosen.offset(max(offset, 0)).limit(limit)
    out = with_details(t, chosen, f.keyword, few=bool(limit) and limit <= MOST_ITEMS).withColumn("text", truncated(F.col("text"), text_chars))
    if root:
        out = out.withColumn("screenshot_file", F.concat(F.lit(root.rstrip("/") + "/"), F.nullif("screenshot_path", F.lit(""))))
    return newest_first(out).drop("url_key", "content_key")


def facet(items: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """value, n by falling count; null counts as ``unknown``."""
    out = items.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(limit) if limit else out


def by_month(items: DataFrame) -> DataFrame:
    """value, n per month of posted_date, in order; undated items last as ``unknown``."""
    month = F.coalesce(F.substring("posted_date", 1, 7), F.lit("unknown"))
    return items.groupBy(month.alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def by_keyword(items: DataFrame, sightings: DataFrame) -> DataFrame:
    """value, n: distinct items per keyword without regard to ASCII case, shown in its first spelling."""
    kept = sightings.where(F.col("keyword").isNotNull()).join(items.select("item_id"), "item_id", "left_semi")
    out = kept.groupBy(ascii_lower(F.col("keyword")).alias("k")).agg(F.min("keyword").alias("value"), F.count_distinct("item_id").alias("n"))
    return out.select("value", "n").orderBy(F.desc("n"), "value")


def by_sentiment(items: DataFrame, labels: DataFrame, keyword: str | None = None) -> DataFrame:
    if keyword:
        labels = labels.where(keyword_is(F.col("keyword"), keyword))
    kept = labels.join(items.select("item_id"), "item_id", "left_semi")
    return kept.groupBy(F.col("sentiment").alias("value")).agg(F.count_distinct("item_id").alias("n")).orderBy(F.desc("n"), "value")


def hidden(t: Tables, f: Filters) -> DataFrame:
    """value, n of the content types that the filters hide, the shown ones left out."""
    shown = set(parse_types(f.include_types)) | ({"marketplace"} & set(split_list(f.kind)))
    everything = Filters(**{**f.__dict__, "include_types": "all"})
    typed = filtered(t, everything).where(F.col("content_type").isNotNull() & ~F.col("content_type").isin(sorted(shown)))
    return facet(typed, "content_type")


def totals(items: DataFrame) -> DataFrame:
    """One row: items, first_seen, last_seen, seen_more_than_once, undated."""
    return items.agg(
        F.count("*").alias("items"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.count_if(F.col("times_seen") > 1).alias("seen_more_than_once"), F.count_if(F.col("posted_date").isNull()).alias("undated"),
    )


def not_labelled(items: DataFrame, labels: DataFrame, keyword: str | None = None) -> DataFrame:
    """Items without any label, or without one for the keyword."""
    if keyword:
        labels = labels.where(keyword_is(F.col("keyword"), keyword))
    return items.join(labels.select("item_id"), "item_id", "left_anti")


def seen_spans(sightings: DataFrame) -> DataFrame:
    """item_id, first_seen, last_seen, times_seen (distinct runs), first_run_id, last_run_id.

    The first run is the one of the earliest capture; a capture without a time sorts first. Ties go by run and
    record.
    """
    at = F.struct(F.col("captured_at").isNotNull(), "captured_at", "run_id", "record_id")
    return sightings.groupBy("item_id").agg(
        F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"), F.count_distinct("run_id").alias("times_seen"),
        F.min_by("run_id", at).alias("first_run_id"), F.max_by("run_id", at).alias("last_run_id"),
    )


def counted(items: DataFrame) -> DataFrame:
    """part, value, n, first_seen, last_seen, seen_more_than_once, undated: totals and facets in one pass.

    The total is the part ``totals``; null values count as ``unknown``, but an item without a group is in no group.
    """
    month = F.substring("posted_date", 1, 7)
    parts = {"totals": F.lit(""), "by_kind": F.col("kind"), "by_language": F.col("language"), "by_month": month, "top_groups": F.col("group_name")}
    each = F.array(*[F.struct(F.lit(p).alias("part"), (v if p == "top_groups" else F.coalesce(v, F.lit("unknown"))).alias("value")) for p, v in parts.items()])
    rows = items.select("first_seen", "last_seen", "times_seen", "posted_date", F.explode(each).alias("p")).select("p.*", "first_seen", "last_seen", "times_seen", "posted_date").where("value is not null")
    return rows.groupBy("part", "value").agg(
        F.count("*").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.count_if(F.col("times_seen") > 1).alias("seen_more_than_once"), F.count_if(F.col("posted_date").isNull()).alias("undated"),
    )


def statistics(t: Tables, f: Filters) -> dict[str, DataFrame]:
    """The statistics bundle, one DataFrame per part; totals and facets come from one pass over the items."""
    items = filtered(t, f)
    once = cut(counted(items))

    def part(name: str) -> DataFrame:
        return once.where(F.col("part") == name).select("value", "n").orderBy(F.desc("n"), "value")

    runs = t.runs.where(keyword_is(F.col("keyword"), f.keyword)) if f.keyword else t.runs
    return {
        "totals": once.where("part = 'totals'").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen_more_than_once", "undated")],
        ),
        "runs": runs.agg(F.count("*").alias("runs")), "by_kind": part("by_kind"), "by_language": part("by_language"), "by_month": part("by_month").orderBy("value"),
        "by_keyword": by_keyword(items, t.sightings), "by_sentiment": by_sentiment(items, t.labels, f.keyword),
        "top_groups": part("top_groups").limit(10),
        "not_labelled": not_labelled(items, t.labels, f.keyword).agg(F.count("*").alias("items")), "hidden": hidden(t, f),
    }
