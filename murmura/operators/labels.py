"""Labels and exclusions: queues, upserts with validation, restoring after a rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions import fixed_values as V
from murmura.functions.text import ascii_lower, truncated
from murmura.operators.items import Tables, keyword_is, visible_types


def queue_pairs(t: Tables, keyword: str | None = None, run_id: str | None = None, batch_id: str | None = None, include_types: str | None = None) -> DataFrame:
    """Distinct (item_id, keyword) of visible items that have no label for that keyword."""
    sightings = t.sightings
    if keyword:
        sightings = sightings.where(keyword_is(F.col("keyword"), keyword))
    if run_id:
        sightings = sightings.where(F.col("run_id") == run_id)
    runs = t.runs.where(F.col("batch_id") == batch_id) if batch_id else t.runs
    seen = visible_types(F.col("content_type"), include_types)
    items = t.items if seen is None else t.items.where(seen)
    pairs = sightings.join(runs.select("run_id"), "run_id", "left_semi").join(items.select("item_id"), "item_id", "left_semi")
    pairs = pairs.select("item_id", "keyword").distinct().withColumn("_k", ascii_lower(F.col("keyword")))
    done = t.labels.select("item_id", ascii_lower(F.col("keyword")).alias("_k"))
    return pairs.join(done, ["item_id", "_k"], "left_anti").drop("_k")


def label_queue(t: Tables, limit: int = 20, text_chars: int = 1500, **which) -> DataFrame:
    """The first pairs of the queue with what a reader needs to label them; an empty URL counts as missing."""
    pairs = queue_pairs(t, **which).orderBy("item_id", "keyword").limit(limit)
    url = F.coalesce(F.nullif("comment_url", F.lit("")), F.col("post_url"))
    fields = ["kind", "language", "author_name", "group_name", "posted_at", "price", "location", "image_text"]
    items = t.items.select("item_id", *fields, url.alias("url"), truncated(F.col("text"), text_chars).alias("text"))
    return pairs.join(items, "item_id").orderBy("item_id", "keyword")


def remaining(t: Tables, **which) -> DataFrame:
    return queue_pairs(t, **which).agg(F.count("*").alias("remaining"))


def checked(t: Tables, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid labels, rejected labels with an error) of new(item_id, keyword, sentiment, reason, labeler, labeled_at).

    A keyword takes the spelling of the item's sightings; a missing one is filled where the item has just one,
    else the label is rejected. A keyword that no sighting has is accepted as given.
    """
    known = t.items.select("item_id", F.lit(True).alias("_item"))
    spellings = t.sightings.where(F.col("keyword") != "").groupBy("item_id").agg(F.array_sort(F.collect_set("keyword")).alias("_spelt"))
    rows = new.join(known, "item_id", "left").join(spellings, "item_id", "left").withColumn("sentiment", F.lower(F.trim("sentiment")))
    given = F.nullif(F.trim("keyword"), F.lit(""))
    same = F.get(F.filter("_spelt", lambda s: ascii_lower(s) == ascii_lower(given)), F.lit(0))
    spelt = F.coalesce(same, given, F.when(F.size("_spelt") == 1, F.col("_spelt")[0]))
    error = (
        F.when(~F.coalesce(F.col("sentiment").isin(list(V.SENTIMENTS)), F.lit(False)), "unknown sentiment")
        .when(F.col("_item").isNull(), "unknown item")
        .when(spelt.isNull(), "the item has several keywords; say which")
    )
    reason = F.nullif(F.substring(F.trim("reason"), 1, 300), F.lit(""))
    rows = rows.select("item_id", spelt.alias("keyword"), "sentiment", reason.alias("reason"), "labeler", "labeled_at", error.alias("error"))
    return rows.where("error is null").drop("error"), rows.where("error is not null")


def upserted(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels after new ones: per item and keyword without ASCII case a new label replaces an old one, the newest of several wins."""
    both = labels.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    key = [F.col("item_id"), ascii_lower(F.col("keyword"))]
    fields = ["keyword", "sentiment", "reason", "labeler", "labeled_at"]
    row = F.struct("item_id", *fields)
    return both.groupBy(*key).agg(F.max_by(row, F.struct("_new", F.coalesce("labeled_at", F.lit("")), "sentiment")).alias("r")).select("r.*")


def restored(label_log: DataFrame, items: DataFrame, sightings: DataFrame) -> DataFrame:
    """Labels after a rebuild: by item id, else by the first of their refs that a sighting has; others drop out."""
    direct = label_log.join(items.select(F.col("item_id").alias("_direct")), F.col("item_id") == F.col("_direct"), "left")
    refs = label_log.select("item_id", "keyword", F.posexplode("refs").alias("_at", "_ref")).select("item_id", "keyword", "_at", F.col("_ref.run_id").alias("run_id"), F.col("_ref.record_id").alias("record_id"))
    found = refs.join(sightings.select("run_id", "record_id", F.col("item_id").alias("_via")), ["run_id", "record_id"])
    via = found.groupBy("item_id", "keyword").agg(F.min_by("_via", F.struct("_at", "_via")).alias("_via"))
    both = direct.join(via, ["item_id", "keyword"], "left").withColumn("_id", F.coalesce("_direct", "_via")).where("_id is not null")
    fields = ["keyword", "sentiment", "reason", "labeler", "labeled_at"]
    latest = Window.partitionBy("_id", ascii_lower(F.col("keyword"))).orderBy(F.desc_nulls_last("labeled_at"), "sentiment")
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").select(F.col("_id").alias("item_id"), *fields)


def excluded(sightings: DataFrame, item_ids: DataFrame, reason: str, at: str) -> DataFrame:
    """Exclusion rows for every sighting of the given items; a reason is mandatory."""
    if not reason or not reason.strip():
        raise ValueError("an exclusion needs a reason")
    rows = sightings.join(item_ids.select("item_id"), "item_id", "left_semi")
    return rows.select("run_id", "record_id", "item_id", "keyword", F.lit(reason.strip()).alias("reason"), F.lit(at).alias("excluded_at"))


def after_exclusion(t: Tables, exclusions: DataFrame) -> Tables:
    """The tables without excluded sightings; an item that has none left goes with its labels, runs stay as they are."""
    kept = without_excluded(t.sightings, exclusions)
    gone = t.sightings.select("item_id").join(kept.select("item_id"), "item_id", "left_anti").distinct()
    return Tables(t.items.join(gone, "item_id", "left_anti"), kept, t.runs, t.labels.join(gone, "item_id", "left_anti"))


def without_excluded(sightings: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Sightings whose (run_id, record_id) is not excluded."""
    return sightings.join(exclusions.select("run_id", "record_id"), ["run_id", "record_id"], "left_anti")
