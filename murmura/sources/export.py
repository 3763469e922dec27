"""Exports of items as CSV with a byte order mark, JSON lines or Parquet, plain or with pseudonyms."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions.identity import pseudonym
from murmura.operators.items import ITEM_COLUMNS
from murmura.sources.writer import slug_of

FORMATS = ("csv", "jsonl", "parquet")
URL_COLUMNS = ("author_url", "group_url", "post_url", "comment_url", "parent_post_url")


def anonymous(items: DataFrame, salt: bytes) -> DataFrame:
    """Items with author_id instead of names and URLs; a name inside content_reason is masked."""
    identity = F.coalesce(F.nullif("author_url", F.lit("")), F.col("author_name"))
    masked = F.regexp_replace("content_reason", r"own page \(.*?\)", "own page")
    kept = [c for c in ITEM_COLUMNS if c not in ("author_name", *URL_COLUMNS)]
    columns = [F.col(c) for c in kept]
    columns.insert(kept.index("group_name"), F.col("author_id"))
    return items.withColumns({"author_id": pseudonym(identity, salt), "content_reason": masked}).select(columns)


def default_path(root: str, fmt: str, keyword: str | None = None, anonymize: bool = False) -> str:
    return f"{root}/_exports/items_{slug_of(keyword) if keyword else 'all'}_{datetime.now(UTC):%Y%m%d-%H%M%S}{'_anon' if anonymize else ''}.{fmt}"


def export(items: DataFrame, path: str, fmt: str, salt: bytes | None = None, single: bool = False) -> str:
    """Writes detailed items in the column order of ITEM_COLUMNS; with a salt, anonymously. Returns the path.

    single writes one file, for tools that expect one: all rows then go through one task, so ask for it only where
    the data is small.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    out = anonymous(items, salt) if salt else items.select(*ITEM_COLUMNS)
    if fmt == "csv":
        out = out.withColumn("keywords", F.concat_ws(" | ", "keywords"))
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    if single:
        out = out.coalesce(1)
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True, escape='"', emptyValue="", nullValue="", quoteAll=False)
    elif fmt == "jsonl":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.parquet(path)
    return path
