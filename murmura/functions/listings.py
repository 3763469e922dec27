"""Marketplace cards and pages as column expressions over their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import fixed_values as V
from murmura.functions.language import detect_language
from murmura.functions.text import clean_text
from murmura.functions.times import bind


def lines(text: Column) -> Column:
    """Trimmed non-empty lines; null text has none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _from(items: Column, start: Column) -> Column:
    return F.when(F.size(items) > start, F.slice(items, start + 1, F.greatest(F.size(items) - start, F.lit(1)))).otherwise(F.slice(items, 1, 0))


def parse_card(text: Column, alt: Column) -> Column:
    """struct(title, price, location): a first line like a price, struck-out prices skipped, the last line the place.

    The image description replaces the title where it ends in the place, as it keeps the title's own breaks.
    """

    def card(items: Column) -> Column:
        priced = F.coalesce(F.get(items, F.lit(0)).rlike(V.LISTING_PRICE), F.lit(False))
        rest = _from(items, F.when(priced, 1).otherwise(0))
        old = F.aggregate(
            rest, F.struct(F.lit(0).alias("n"), F.lit(True).alias("run")),
            lambda s, x: F.struct((s["n"] + F.when(s["run"] & x.rlike(V.LISTING_OLD_PRICE), 1).otherwise(0)).alias("n"), (s["run"] & x.rlike(V.LISTING_OLD_PRICE)).alias("run")),
        )["n"]
        skipped = F.when(priced, F.least(old, F.greatest(F.size(rest) - 2, F.lit(0)))).otherwise(0)

        def fields(left: Column) -> Column:
            place = F.when(F.size(left) >= 2, F.element_at(left, -1))
            joined = F.array_join(F.when(place.isNotNull(), F.slice(left, 1, F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left), " ")
            ending = F.concat(F.lit(" in "), place)
            described = F.nullif(F.trim(F.substring(alt, F.lit(1), F.length(alt) - F.length(ending))), F.lit(""))
            title = F.when(F.coalesce(F.endswith(alt, ending), F.lit(False)), F.coalesce(described, joined)).otherwise(joined)
            return F.struct(title.alias("title"), F.when(priced, F.get(items, F.lit(0))).alias("price"), place.alias("location"))

        return bind(_from(rest, skipped), fields)

    return bind(lines(text), card)


def parse_page(text: Column) -> Column:
    """struct(listed_text, location, condition, description) of a listing page's text."""

    def page(everything: Column) -> Column:
        low = F.transform(everything, F.lower)
        stop = F.array_min(F.filter(F.transform(low, lambda x, i: F.when(x.isin(list(V.LISTING_STOP_LINES)), i)), lambda i: i.isNotNull()))
        return bind(F.when(stop.isNull(), everything).otherwise(F.slice(everything, 1, F.greatest(stop, F.lit(0)))), parts)

    def parts(kept: Column) -> Column:
        low = F.transform(kept, F.lower)
        at = F.array_min(F.filter(F.transform(low, lambda x, i: F.when(x.startswith("listed "), i)), lambda i: i.isNotNull()))
        line = F.get(kept, at)
        pattern = r"(?is)^listed\s+(.*?)(?:\s+in(?:\s+(.+))?)?$"
        listed = F.when(line.isNotNull(), F.regexp_extract(line, pattern, 1))
        place = F.nullif(F.regexp_extract(line, pattern, 2), F.lit(""))
        place = F.coalesce(place, F.when(F.endswith(F.lower(line), F.lit(" in")), F.get(kept, at + 1)))
        details = F.array_position(low, "details")
        has_condition = (details > 0) & (F.get(low, details.cast("int")) == "condition")
        start = details.cast("int") + F.when(F.coalesce(has_condition, F.lit(False)), 2).otherwise(0)
        end = F.array_min(F.filter(F.transform(low, lambda x, i: F.when((i >= start) & ((x == "seller information") | x.contains("location is approximate")), i)), lambda i: i.isNotNull()))
        block = F.filter(F.transform(kept, lambda x, i: F.when((i >= start) & (i < F.coalesce(end, F.size(kept))) & ~F.lower(x).isin(list(V.LISTING_UI_LINES)), x)), lambda x: x.isNotNull())
        return F.struct(
            listed.alias("listed_text"), place.alias("location"),
            F.when(has_condition, F.get(kept, details.cast("int") + 1)).alias("condition"),
            F.when(details > 0, F.nullif(clean_text(F.array_join(block, "\n")), F.lit(""))).alias("description"),
        )

    return bind(lines(text), page)


def with_details(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Listing records with what their pages(post_url, page_text, seller_name, seller_url) add.

    The description joins the text, whose language is found anew where records have one; condition, location, seller
    and time are filled where missing.
    """
    page = pages.select("post_url", parse_page(F.col("page_text")).alias("_p"), "seller_name", "seller_url").dropDuplicates(["post_url"])
    rows = records.join(page, "post_url", "left")
    described = F.concat_ws("\n", F.nullif("text", F.lit("")), "_p.description")
    out = rows.withColumns({
        "text": F.when(F.col("_p.description").isNotNull(), described).otherwise(F.col("text")), "condition": F.coalesce("condition", "_p.condition"), "location": F.coalesce("location", "_p.location"),
        "author_name": F.coalesce("author_name", "seller_name"), "author_url": F.coalesce("author_url", "seller_url"), "time_text": F.coalesce("time_text", "_p.listed_text"),
    }).drop("_p", "seller_name", "seller_url")
    return out.withColumn("language", detect_language(F.col("text"))) if "language" in records.columns else out
