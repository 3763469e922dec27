"""Entity resolution: records of many runs into distinct items, exactly as if imported one after the other.

Records influence each other only through chains of equal keys (run and record, URL key, content key), so the
order-dependent matching runs per connected component. A component is folded as a stream of narrow rows sorted
by import order; what a task holds is the component's open items, never its records. All attributes are then
merged by declarative aggregates.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions import fixed_values as V
from murmura.functions import text as X
from murmura.functions import times, urls
from murmura.functions.content import classify, rules_version
from murmura.functions.language import detect_language
from murmura.operators.items import seen_spans
from murmura.session import cut

FILL_FIELDS = ("post_url", "comment_url", "parent_post_url", "author_name", "author_url", "group_name", "group_url", "time_text", "time_exact", "image_text", "price", "location", "condition")
TIME_FIELDS = ("posted_at", "posted_date", "posted_at_precision", "posted_at_source")


def repaired(records: DataFrame) -> DataFrame:
    """Records with canonical URLs, without interface labels in names, filler in texts and image words in times."""
    def canonical(c: str) -> F.Column:
        return F.when(F.col(c) != "", F.coalesce(urls.canonical_url(F.col(c)), F.col(c))).otherwise(F.col(c))

    label = F.coalesce(F.lower(F.trim("author_name")).isin(list(V.UI_LABELS)), F.lit(False))
    described = F.coalesce(F.lower(F.trim("time_text")).rlike("^(?:may be|no photo description)"), F.lit(False))
    out = records.withColumns({
        **{c: canonical(c) for c in ("post_url", "comment_url", "parent_post_url", "group_url")},
        "author_url": F.when(~label, canonical("author_url")), "author_name": F.when(~label, F.col("author_name")),
        "text": F.when(F.col("text") != "", X.clean_text(F.col("text"))).otherwise(F.col("text")), "time_text": F.when(~described, F.col("time_text")),
    })
    derived = F.when((F.col("kind") == "photo") & (F.col("group_url") != ""), urls.photo_group_post(F.col("post_url"), F.col("group_url")))
    out = out.withColumn("_derived", derived)
    return out.withColumns({"post_url": F.coalesce("_derived", "post_url"), "kind": F.when(F.col("_derived").isNotNull(), "group_post").otherwise(F.col("kind"))}).drop("_derived")


def keyed(records: DataFrame) -> DataFrame:
    """Repaired records with url_key, content_key and their resolved times."""
    key = urls.url_key(*[F.col(c) for c in ("kind", "post_url", "comment_url", "author_url")])
    parent = urls.url_key(F.lit("post"), F.col("parent_post_url"), F.lit(None).cast("string"))
    group = urls.group_of(F.col("group_url"))
    out = records.withColumns({"url_key": key, "_parent": parent, "_group": group})
    out = out.withColumn("content_key", X.content_key(F.col("text"), F.col("kind"), F.col("_group"), F.col("_parent")))
    when = times.resolve(F.col("time_exact"), F.col("time_text"), F.col("captured_at"), F.col("browser_utc_offset_minutes"))
    return out.withColumn("_when", when).select("*", "_when.*").drop("_parent", "_group", "_when")


def components(nodes: DataFrame) -> DataFrame:
    """seq, component of nodes(seq, key): records that share a key directly or through others share a component.

    A key that one record has alone connects nothing and is dropped first; records left without a key are components
    of their own and take no part in the rounds. Smallest labels spread along keys and are then shortened through their
    own labels, so that a chain of n records takes about log n rounds; each round is cut off in the shared folder.
    """
    pairs = nodes.where("key is not null").distinct()
    shared = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    edges = cut(pairs.join(shared.select("key"), "key", "left_semi").select("seq", "key"))
    labels = cut(edges.select("seq").distinct().withColumn("component", F.col("seq")))
    while True:
        near = edges.join(labels, "seq").groupBy("key").agg(F.min("component").alias("least"))
        spread = edges.join(near, "key").groupBy("seq").agg(F.min("least").alias("least"))
        step = labels.join(spread, "seq", "left").select("seq", F.least("component", F.coalesce("least", "component")).alias("c"), F.col("component").alias("before"))
        hop = step.select(F.col("seq").alias("c"), F.col("c").alias("next"))
        step = cut(step.join(hop, "c").select("seq", F.least("c", "next").alias("component"), "before"))
        if step.where("component <> before").isEmpty():
            found = step.select("seq", "component")
            return nodes.select("seq").distinct().join(found, "seq", "left").select("seq", F.coalesce("component", "seq").alias("component"))
        labels = step.select("seq", "component")


class _Alike:
    """The open items of one content key, to be looked up by author and URL in order of creation.

    Heaps of creation numbers, one per author and one for all, each once for every item and once for those whose
    URL key is missing or weak; an entry that no longer holds is dropped when it comes to the top.
    """

    def __init__(self) -> None:
        self.items: dict[int, dict] = {}
        self.heaps: dict[tuple[bool, str | None], list[int]] = defaultdict(list)

    def put(self, item: dict) -> None:
        """Takes an item in, or anew after its URL key or author changed."""
        self.items[item["n"]] = item
        for loose in (False, True)[: 1 + _is_loose(item)]:
            for author in (None, item["author"]):
                heapq.heappush(self.heaps[loose, author], item["n"])

    def _first(self, loose: bool, author: str | None) -> int | None:
        heap = self.heaps.get((loose, author))
        while heap:
            item = self.items[heap[0]]
            if (not loose or _is_loose(item)) and (author is None or item["author"] == author):
                return heap[0]
            heapq.heappop(heap)
        return None

    def find(self, url: str | None, author: str) -> dict | None:
        """The oldest item that may be the same post: one of two URL keys missing or weak, authors that do not differ."""
        loose = url is not None and not _is_weak(url)
        hits = [n for a in ((None,) if not author else ("", author)) if (n := self._first(loose, a)) is not None]
        return self.items[min(hits)] if hits else None


class _Fold:
    """The open items of one component while its records stream by."""

    def __init__(self) -> None:
        self.by_record: dict[str, dict] = {}
        self.by_url: dict[str, dict] = {}
        self.by_content: dict[str, _Alike] = defaultdict(_Alike)
        self.ids: set[str] = set()

    def add(self, record: str, url: str | None, content: str | None, author: str) -> tuple[str, str, bool, bool, str]:
        """(item_id, outcome, whether the record set the item's URL key, whether its key belongs to another item, seed of the id)."""
        prior = self.by_record.get(record)
        item = prior or (self.by_url.get(url) if url else None) or (self.by_content[content].find(url, author) if content else None)
        outcome = "already_imported" if prior else "merged" if item else "new_items"
        clash = sets = changed = False
        if item is None:
            seed = url or content or record
            item = {"n": len(self.ids), "id": self._new_id(seed), "url": None, "content": None, "author": "", "seed": seed}
        if url and (item["url"] is None or (_is_weak(item["url"]) and not _is_weak(url))):
            owner = self.by_url.get(url)
            clash = owner is not None and owner is not item
            if not clash:
                self.by_url.pop(item["url"], None)
                item["url"], sets = url, True
                self.by_url[url] = item
        if author and not item["author"]:
            item["author"], changed = author, True
        if content and item["content"] is None:
            item["content"], changed = content, True
        if changed and item["content"] is not None:
            self.by_content[item["content"]].put(item)
        self.by_record[record] = item
        return item["id"], outcome, sets, clash, item["seed"]

    def _new_id(self, seed: str) -> str:
        n, made = 0, ""
        while not made or made in self.ids:
            made = item_id(seed, n)
            n += 1
        self.ids.add(made)
        return made


ID_DIGITS = 12


def item_id(seed: str, n: int = 0) -> str:
    """Id of an item by what it was first known by; n tells items of one id apart."""
    return "i_" + hashlib.sha1((f"{seed}#{n}" if n else seed).encode()).hexdigest()[:ID_DIGITS]


def _is_loose(item: dict) -> bool:
    return item["url"] is None or _is_weak(item["url"])


def _is_weak(key: str) -> bool:
    return key.startswith("url:/photo")


def _folded(batches):
    component, fold = None, None
    for pdf in batches:
        out = []
        for seq, own, record, url, content, author in pdf.itertuples(index=False, name=None):
            if own != component:
                component, fold = own, _Fold()
            out.append((seq, *fold.add(record, url or None, content or None, author or ""), component))
        yield pd.DataFrame(out, columns=["seq", "item_id", "outcome", "sets_key", "key_clash", "seed", "component"])


def assigned(records: DataFrame) -> DataFrame:
    """seq, item_id, outcome, sets_key, key_clash of keyed records, as if imported in the order of seq."""
    record = F.concat_ws("|", "run_id", "record_id")
    narrow = cut(records.select("seq", record.alias("record"), "url_key", "content_key", F.lower(X.normalize(F.col("author_name"))).alias("author")))
    tagged = F.array(F.concat(F.lit("r:"), "record"), F.concat(F.lit("u:"), "url_key"), F.concat(F.lit("c:"), "content_key"))
    found = components(narrow.select("seq", F.explode(tagged).alias("key")))
    rows = narrow.join(found, "seq").select("seq", "component", "record", "url_key", "content_key", "author")
    rows = rows.repartition("component").sortWithinPartitions("component", "seq")
    folded = rows.mapInPandas(_folded, "seq bigint, item_id string, outcome string, sets_key boolean, key_clash boolean, seed string, component bigint")
    return with_own_ids(cut(folded)).drop("seed", "component")


def with_own_ids(placed: DataFrame) -> DataFrame:
    """placed with ids that no two components share.

    A component makes its ids alone; where items of several have come to one id, the older keeps it. Among 10^8 items
    some twenty do, so the joined table is tiny and the loop ends after a round or two.
    """
    n = 0
    while True:
        items = placed.groupBy("item_id", "component").agg(F.min("seq").alias("_first"), F.first("seed").alias("_seed"))
        shared = items.groupBy("item_id").agg(F.count("*").alias("_n")).where("_n > 1").select("item_id")
        later = items.join(shared, "item_id").withColumn("_k", F.row_number().over(Window.partitionBy("item_id").orderBy("_first"))).where("_k > 1")
        n += 1
        anew = F.concat(F.lit("i_"), F.substring(F.sha1(F.concat("_seed", F.lit("#"), (F.col("_k") + (n - 1)).cast("string"))), 1, ID_DIGITS))
        fixed = cut(later.select("item_id", "component", anew.alias("_id")))
        if fixed.isEmpty():
            return placed
        placed = cut(placed.join(fixed, ["item_id", "component"], "left").withColumn("item_id", F.coalesce("_id", "item_id")).select(placed.columns))


def merged(records: DataFrame, placed: DataFrame) -> DataFrame:
    """Items from keyed records and their assignment, attribute by attribute."""
    rows = records.join(placed.select("seq", "item_id", "sets_key"), "seq")
    kinds = F.array(*[F.lit(k) for k in V.KINDS])
    rank = F.coalesce(F.nullif(F.array_position(kinds, F.col("kind")), F.lit(0)), F.lit(len(V.KINDS) + 1))

    def first(column: str) -> F.Column:
        return F.min_by(column, F.when(F.col(column) != "", F.col("seq")))

    def by_key(column: str) -> F.Column:
        set_here = F.when(F.col("sets_key") & (F.col(column) != ""), F.col("seq"))
        return F.coalesce(F.max_by(column, set_here), first(column))

    filled = {c: (by_key(c) if c in ("post_url", "comment_url") else first(c)) for c in FILL_FIELDS}
    finest = F.struct(times.finer_rank(F.col("posted_at_precision")), "seq")
    items = rows.groupBy("item_id").agg(
        F.max_by("url_key", F.when(F.col("sets_key"), F.col("seq"))).alias("url_key"), first("content_key").alias("content_key"),
        F.coalesce(F.min_by("kind", F.struct(rank, "seq")), F.lit("unknown")).alias("kind"), *[v.alias(c) for c, v in filled.items()],
        F.coalesce(F.max_by("text", F.struct(F.length(F.coalesce("text", F.lit(""))), -F.col("seq"))), F.lit("")).alias("text"),
        F.min_by(F.struct(*TIME_FIELDS), finest).alias("_when"), first("screenshot_path").alias("screenshot_path"),
    )
    return items.select("*", "_when.*").drop("_when")


def sightings_of(records: DataFrame, placed: DataFrame) -> DataFrame:
    """One sighting per item, run and record, the first in import order; its keyword falls back to the run's."""
    rows = records.join(placed.select("seq", "item_id"), "seq")
    first = Window.partitionBy("item_id", "run_id", "record_id").orderBy("seq")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    keyword = F.coalesce(F.nullif("keyword", F.lit("")), F.col("run_keyword"))
    fields = ["source", "search_rank", "kind", "keyword_verified", "matched_in", "matched_terms", "match_snippet", "screenshot_path", "captured_at"]
    return rows.select("item_id", "run_id", "record_id", keyword.alias("keyword"), *fields)


def enriched(items: DataFrame, sightings: DataFrame) -> DataFrame:
    """Items with language, content type and the span in which they were seen."""
    keywords = sightings.where("keyword is not null").groupBy("item_id").agg(F.collect_set("keyword").alias("_keywords"))
    out = items.join(keywords, "item_id", "left").join(seen_spans(sightings), "item_id", "left").withColumn("language", detect_language(F.col("text")))
    typed = F.when(F.col("kind") != "profile", classify(*[F.col(c) for c in ("text", "image_text", "author_name", "_keywords", "kind")]))
    return out.withColumn("_t", typed).select("*", "_t.*").drop("_t", "_keywords")


def reclassified(items: DataFrame, sightings: DataFrame, version: str | None) -> DataFrame:
    """Items with their content types found anew if version is not that of today's rules; else as they are."""
    if version == rules_version():
        return items
    keywords = sightings.where("keyword is not null").groupBy("item_id").agg(F.collect_set("keyword").alias("_keywords"))
    rows = items.drop("content_type", "content_reason").join(keywords, "item_id", "left")
    typed = F.when(F.col("kind") != "profile", classify(*[F.col(c) for c in ("text", "image_text", "author_name", "_keywords", "kind")]))
    return rows.withColumn("_t", typed).select("*", "_t.*").drop("_t", "_keywords").select(items.columns)


def resolved(records: DataFrame) -> dict[str, DataFrame]:
    """items, sightings and outcomes of records(seq, run_id, record_id, run_keyword, …) in import order."""
    ready = cut(keyed(repaired(records)))
    placed = cut(assigned(ready))
    sightings = sightings_of(ready, placed)
    return {"items": enriched(merged(ready, placed), sightings), "sightings": sightings, "outcomes": placed.join(ready.select("seq", "run_id", "record_id"), "seq")}
