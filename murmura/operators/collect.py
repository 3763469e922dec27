"""Verify-then-filter over the candidates of one search, and what it leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.content import classify
from murmura.functions.text import match_keyword, text_key, verified_in
from murmura.operators.items import parse_types

EXAMPLES = 50


def judged(candidates: DataFrame, keyword: str, mode: str = "phrase", with_names: bool = False, search: str | None = None) -> DataFrame:
    """Candidates with search_rank, matched_in, match, content_type and content_reason.

    candidates has position, url_key, kind, text, full_text, image_text, name_text, author_name. The rank counts
    distinct candidates in their order; a comment is verified in its own text only, a listing in its title, a
    profile card by its name. search names the column that tells searches apart; each is ranked on its own. Without
    it candidates are those of one search, which a page shows some hundreds of.
    """
    searches = [search] if search else []
    key = F.coalesce("url_key", text_key(F.col("text")))
    first = Window.partitionBy(*searches, "_key").orderBy("position")
    rows = candidates.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_key")
    rows = rows.withColumn("search_rank", F.row_number().over(Window.partitionBy(*(searches or [F.lit(0)])).orderBy("position")))
    fields = ["text", "full_text", "image_text"] + ["name_text"] * with_names
    anywhere = verified_in(keyword, {f: F.col(f) for f in fields}, mode)
    own = verified_in(keyword, {"text": F.col("text")}, mode)
    where = (
        F.when(F.col("kind").isin("comment", "reply"), own)
        .when(F.col("kind") == "marketplace", F.when(own.isNotNull(), "title"))
        .when(F.col("kind") == "profile", F.when(verified_in(keyword, {"n": F.col("name_text")}, mode).isNotNull(), "profile"))
        .otherwise(anywhere)
    )
    rows = rows.withColumn("matched_in", where)
    shown = F.when(F.col("matched_in").isin("full_text", "image_text", "name_text"), F.coalesce(*[F.when(F.col("matched_in") == f, F.col(f)) for f in ("full_text", "image_text", "name_text")])).otherwise(F.col("text"))
    rows = rows.withColumn("match", match_keyword(keyword, shown, mode))
    typed = F.when(F.col("kind") != "profile", classify(F.col("text"), F.col("image_text"), F.col("author_name"), F.array(F.lit(keyword)), F.col("kind")))
    return rows.withColumn("_t", typed).select("*", "_t.*").drop("_t")


def kept(rows: DataFrame, include_types: str | None = None, max_results: int = 20, save_unverified: bool = False) -> DataFrame:
    """The judged candidates that a search keeps: posts, verified, of a type asked for, the first max_results."""
    types = list(parse_types(include_types))
    out = rows.where(F.col("kind") != "unknown")
    if not save_unverified:
        out = out.where("matched_in is not null")
    out = out.where(F.col("content_type").isNull() | F.col("content_type").isin(types)) if types else out.where("content_type is null")
    return out.orderBy("search_rank").limit(max_results)


def skipped(rows: DataFrame, include_types: str | None = None) -> DataFrame:
    """reason, n: how many candidates were no posts, unverified, or of a type that was not asked for."""
    types = list(parse_types(include_types))
    typed = F.col("content_type").isNotNull() & ~F.coalesce(F.col("content_type").isin(types), F.lit(False))
    reason = F.when(F.col("kind") == "unknown", "skipped_not_posts").when(F.col("matched_in").isNull(), "skipped_unverified").when(typed, F.concat(F.lit("skipped_"), "content_type"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).where("reason is not null")


def filtered_examples(rows: DataFrame, include_types: str | None = None) -> DataFrame:
    """The first examples of posts left out for their type."""
    types = list(parse_types(include_types))
    out = rows.where("matched_in is not null and content_type is not null").where(~F.col("content_type").isin(types))
    return out.orderBy("search_rank").limit(EXAMPLES).select("content_type", "content_reason", "kind", "author_name", "url_key", "text")
