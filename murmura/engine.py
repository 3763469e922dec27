"""The query-side library: one object over the tables of a dataset, answering with DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmura.operators import entity, items, labels
from murmura.operators.items import Filters, Tables
from murmura.sources import export, runs
from murmura.session import table


class Engine:
    """Queries over items, sightings, runs and labels."""

    def __init__(self, tables: Tables) -> None:
        self.tables = tables

    @classmethod
    def of_parquet(cls, spark: SparkSession, folder: str) -> Engine:
        return cls(Tables(*[table(spark, folder, n) for n in ("items", "sightings", "runs", "labels")]))

    @classmethod
    def of_runs(cls, spark: SparkSession, root: str, exclusions: DataFrame | None = None, label_log: DataFrame | None = None, run: str = "*/*") -> Engine:
        """A dataset built from run documents, or from that of one run; exclusions stay out, labels are restored."""
        docs = runs.documents(spark, root, run)
        records = runs.record_rows(docs)
        if exclusions is not None:
            records = labels.without_excluded(records, exclusions)
        made = entity.resolved(records)
        empty = spark.createDataFrame([], "item_id STRING, keyword STRING, sentiment STRING, reason STRING, labeler STRING, labeled_at STRING")
        kept = labels.restored(label_log, made["items"], made["sightings"]) if label_log is not None else empty
        return cls(Tables(made["items"], made["sightings"], runs.run_rows(docs), kept))

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Engine:
        """The dataset of a folder: its tables if they are there, else built from its run documents.

        FileNotFoundError where there is neither.
        """
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "items.parquet")):
            return cls.of_parquet(spark, root)
        found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*/*/results.json"))
        if found is None or not len(found):
            raise FileNotFoundError(f"no dataset and no run documents under {root}")
        return cls.of_runs(spark, root)

    def save(self, folder: str) -> None:
        """Writes the tables as Parquet, to be opened again."""
        for name, df in self.tables.__dict__.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    def items(self, limit: int | None = 20, offset: int = 0, text_chars: int = 400, root: str | None = None, **filters) -> DataFrame:
        """A page of 1 to MOST_ITEMS items."""
        return items.page(self.tables, Filters(**filters), items.clamped(limit, items.MOST_ITEMS), offset, text_chars, root)

    def reclassified(self, version: str | None) -> Engine:
        """The engine with content types by today's rules, where version (that of the stored types) is another."""
        t = self.tables
        return Engine(Tables(entity.reclassified(t.items, t.sightings, version), t.sightings, t.runs, t.labels))

    def count(self, **filters) -> int:
        return items.filtered(self.tables, Filters(**filters)).count()

    def hidden(self, **filters) -> DataFrame:
        return items.hidden(self.tables, Filters(**filters))

    def statistics(self, **filters) -> dict[str, DataFrame]:
        return items.statistics(self.tables, Filters(**filters))

    def runs(self, keyword: str | None = None, limit: int = 20) -> DataFrame:
        return runs.listed(self.tables.runs, keyword, limit)

    def label_queue(self, limit: int = 20, **which) -> DataFrame:
        """The first 1 to MOST_PAIRS pairs that need a label."""
        return labels.label_queue(self.tables, items.clamped(limit, items.MOST_PAIRS), **which)

    def label_items(self, new: DataFrame) -> tuple[Engine, DataFrame]:
        """(the engine with the valid labels, the rejected ones with their errors)."""
        valid, rejected = labels.checked(self.tables, new)
        t = self.tables
        return Engine(Tables(t.items, t.sightings, t.runs, labels.upserted(t.labels, valid))), rejected

    def exclude(self, item_ids: DataFrame, reason: str, at: str) -> tuple[Engine, DataFrame]:
        """(the engine without the items, the exclusions to keep so that later imports leave them out too)."""
        rows = labels.excluded(self.tables.sightings, item_ids, reason, at)
        return Engine(labels.after_exclusion(self.tables, rows)), rows

    def export(self, path: str, fmt: str, salt: bytes | None = None, single: bool = False, **filters) -> str:
        f = Filters(**filters)
        return export.export(items.newest_first(items.with_details(self.tables, items.filtered(self.tables, f), f.keyword)), path, fmt, salt, single)
