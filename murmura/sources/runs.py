"""Reader of run documents: one JSON file per run, with an explicit schema and a stable import order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions.text import slugify
from murmura.session import cut

RUN = (
    "tool STRING, version STRING, run_id STRING, keyword STRING, scope STRING, group_url STRING, group_name STRING, match_mode STRING, source STRING, batch_id STRING, "
    "status STRING, started_at STRING, finished_at STRING, browser_timezone STRING, browser_utc_offset_minutes INT, search_url STRING, "
    "error STRUCT<code STRING, message STRING, hint STRING>, stats MAP<STRING, BIGINT>, warnings ARRAY<STRING>"
)
RECORD = (
    "id STRING, kind STRING, keyword STRING, keyword_verified BOOLEAN, matched_in STRING, matched_terms ARRAY<STRING>, match_snippet STRING, post_url STRING, "
    "comment_url STRING, parent_post_url STRING, author_name STRING, author_url STRING, group_name STRING, group_url STRING, time_text STRING, time_exact STRING, "
    "text STRING, image_text STRING, price STRING, location STRING, condition STRING, screenshot_path STRING, source STRING, search_rank INT, captured_at STRING, "
    "posted_date STRING, language STRING, content_type STRING, screenshot_name STRING"
)
#: What a collector already noted about a record; an import finds it anew.
NOTED = ("posted_date", "language", "content_type", "screenshot_name")
#: A record in a summary, without its text.
COMPACT = (
    "kind", "keyword_verified", "matched_in", "match_snippet", "post_url", "comment_url", "author_name", "group_name", "time_text", "time_exact", "posted_date", "language", "price", "location", "content_type",
    "screenshot_name",
)
DOCUMENT = f"run STRUCT<{RUN}>, results ARRAY<STRUCT<{RECORD}>>, _corrupt STRING"


def documents(spark: SparkSession, root: str, run: str = "*/*") -> DataFrame:
    """Run documents under root/<slug>/<stamp>/results.json with their path; a broken file is one row with _corrupt.

    run names the folder of one run, as <slug>/<stamp>.
    """
    reader = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(f"{root}/{run.strip('/')}/results.json").withColumn("path", F.col("_metadata.file_path"))


def unreadable(docs: DataFrame) -> DataFrame:
    """Paths of files that hold no run; the others are read all the same."""
    return docs.where("_corrupt is not null or run is null").select("path")


_ASKED = ["keyword", "scope", "group_url", "match_mode", "version", "batch_id", "browser_timezone", "browser_utc_offset_minutes", "started_at"]
_CAME = ["status", "finished_at", "stats", "warnings"]


def run_versions(docs: DataFrame) -> DataFrame:
    """One row per readable document with what it says of its run, without its records."""
    folder = F.regexp_extract("path", r"([^/]+)/results\.json$", 1)
    relative = F.regexp_extract("path", r"([^/]+/[^/]+)/results\.json$", 1)
    return docs.where("_corrupt is null and run is not null").select(
        F.coalesce("run.run_id", folder).alias("run_id"), "path", *[F.col(f"run.{c}").alias(c) for c in _ASKED + _CAME], F.size(F.coalesce("results", F.array())).cast("bigint").alias("records"), relative.alias("run_dir")
    )


def merged_runs(versions: DataFrame) -> DataFrame:
    """One row per run. Of several documents of one run, the first in path order gives what it was asked,
    the last what came of it. A missing run_id is the folder's name."""
    return versions.groupBy("run_id").agg(
        *[F.min_by(c, "path").alias({"version": "tool_version"}.get(c, c)) for c in _ASKED],
        *[F.max_by(c, "path").alias(c) for c in _CAME], F.max_by("run_dir", "path").alias("run_dir"), F.max_by("records", "path").alias("records"),
    )


def run_rows(docs: DataFrame) -> DataFrame:
    """The runs of documents, one row each."""
    return merged_runs(run_versions(docs))


def record_rows(docs: DataFrame) -> DataFrame:
    """Records in import order: seq rises with the file's path and the place in it.

    A record without an id gets one from its content.
    """
    folder = F.regexp_extract("path", r"([^/]+)/results\.json$", 1)
    relative = F.regexp_extract("path", r"([^/]+/[^/]+)/results\.json$", 1)
    good = docs.where("_corrupt is null and run is not null")
    rows = good.select("path", F.coalesce("run.run_id", folder).alias("run_id"), F.col("run.keyword").alias("run_keyword"), "run.browser_utc_offset_minutes", relative.alias("run_dir"), F.posexplode("results").alias("pos", "r"))
    given = F.coalesce(F.nullif("r.id", F.lit("")), F.substring(F.sha1(F.to_json("r")), 1, 12))
    shot = F.when(F.col("r.screenshot_path") != "", F.concat("run_dir", F.lit("/"), "r.screenshot_path"))
    flat = rows.select("path", "pos", "run_id", "run_keyword", "browser_utc_offset_minutes", given.alias("record_id"), shot.alias("_shot"), "r.*").drop("id", "screenshot_path", *NOTED).withColumnRenamed("_shot", "screenshot_path")
    return numbered(flat, ["path", "pos"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with seq, a number that rises with order; numbered in parallel from a range partitioning."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())


def ranked(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """rows with their place in order, from 1 on without gaps; equal rows are told apart by nothing.

    Ranges are sorted side by side; only their sizes, one number a partition, come to the driver.
    """
    sorted_rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()))
    ranges = sorted(sorted_rows.groupBy(F.shiftright("_n", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in ranges:
        starts += [F.lit(p), F.lit(before)]
        before += n
    if not starts:
        return sorted_rows.withColumn(name, F.lit(0).cast("bigint")).drop("_n")
    start = F.element_at(F.create_map(*starts), F.shiftright("_n", 33))
    return sorted_rows.withColumn(name, (start + F.col("_n").bitwiseAND((1 << 33) - 1) + 1).cast("bigint")).drop("_n")


def listed(runs: DataFrame, keyword: str | None = None, limit: int = 20) -> DataFrame:
    """Runs newest first, of one keyword by its slug if given; a run without a start comes last."""
    if keyword is not None:
        runs = runs.where(slugify(F.col("keyword")) == slugify(F.lit(keyword)))
    return runs.orderBy(F.desc(F.coalesce("started_at", F.lit(""))), "run_id").limit(limit)


def left_out(stats: Column) -> Column:
    """What the content filter left out, by type: the non-zero skipped_ counters but that of links that are no posts."""
    counters = F.map_filter(stats, lambda k, v: k.startswith("skipped_") & (k != "skipped_not_posts") & (v != 0))
    return F.transform_keys(counters, lambda k, v: F.substring(k, 9, 100))


def is_ok(status: Column) -> Column:
    return F.coalesce(status, F.lit("")) == "completed"


def summaries(runs: DataFrame) -> DataFrame:
    """run_id, keyword, ok, status, records, filtered_out of the runs table."""
    return runs.select("run_id", "keyword", is_ok(F.col("status")).alias("ok"), "status", "records", left_out(F.col("stats")).alias("filtered_out"))


def document_summaries(docs: DataFrame, max_records: int = 50) -> DataFrame:
    """One row per run document: its outcome, counters and first max_records records without their texts."""
    good = docs.where("_corrupt is null and run is not null")
    found = F.coalesce("results", F.array())
    compact = F.transform(F.slice(found, 1, max_records), lambda r: F.struct(*[r[c].alias(c) for c in COMPACT]))
    return good.select(
        is_ok(F.col("run.status")).alias("ok"), "run.run_id", "run.status", "run.error", F.regexp_replace("path", "/results\\.json$", "").alias("run_dir"), F.col("path").alias("results_json"), "run.stats", "run.warnings",
        left_out(F.col("run.stats")).alias("filtered_out"), compact.alias("records"), F.greatest(F.size(found) - max_records, F.lit(0)).alias("records_truncated"),
    )


def import_totals(docs: DataFrame, records: DataFrame, excluded: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: runs, records, new_items, merged, already_imported, excluded, errors of an import.

    records are all of the documents' records, excluded those that exclusions kept out, outcomes what became of the others.
    """
    read = docs.agg(F.count_if(F.expr("_corrupt is null and run is not null")).alias("runs"), F.count_if(F.expr("_corrupt is not null or run is null")).alias("errors"))
    became = outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("new_items", "merged", "already_imported")])
    rows = read
    for part in (records.agg(F.count("*").alias("records")), became, excluded.agg(F.count("*").alias("excluded"))):
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.sum(c).alias(c) for c in ("runs", "records", "new_items", "merged", "already_imported", "excluded", "errors")])
