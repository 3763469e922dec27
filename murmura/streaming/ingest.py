"""Incremental ingestion: new run documents as a file stream, each batch resolved with what it touches.

Records can only influence each other through chains of equal keys. A batch therefore needs the earlier records
that its keys reach. Keys are kept twice, by key and by record, in slots of their hash; a chain is followed from its
newest end only and reads no slot that it does not lead to. Only the reached records are resolved anew, and only the
parts of the item and sighting tables that hold their items are rewritten. As matching depends on import order only,
the result equals that of a rebuild with the new runs last.

Items and sightings are read through a manifest, one small file that names the version of every part of both. New
versions are written beside the old ones, then the manifest is replaced in one step: a reader, or a restart after a
crash, sees either both tables before a batch or both after it. A batch that is taken in again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from murmura.operators import entity
from murmura.operators.labels import without_excluded
from murmura.session import cut, remove
from murmura.sources import runs as source
from murmura.sources.writer import exists, get_text, put_text
from murmura.streaming.progress import Progress

RECORD = ["run_id", "record_id"]
KEYS = "run_id STRING, record_id STRING, key STRING"
PLACE = "batch INT, slot INT"
VERSIONED = ("items", "sightings")


def stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """Run documents under root as a stream of files."""
    reader = spark.readStream.schema(source.DOCUMENT).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    return reader.option("maxFilesPerTrigger", files_per_trigger).json(f"{root}/*/*/results.json").withColumn("path", F.col("_metadata.file_path"))


class Ingest:
    """Tables under a state folder, brought up to date batch by batch.

    parts is the number of pieces of items and sightings, slots that of the key and record tables: the more, the less
    a batch reads and rewrites beside what it touches. Give both by the size that the tables will reach.
    """

    def __init__(self, spark: SparkSession, state: str, exclusions: DataFrame | None = None, parts: int = 64, slots: int = 16) -> None:
        self.spark, self.state, self.exclusions, self.parts, self.slots = spark, state.rstrip("/"), exclusions, parts, slots

    # Reading

    def read(self, name: str) -> DataFrame:
        """items, sightings or runs as of the last whole batch."""
        if name == "runs":
            return source.merged_runs(self.spark.read.parquet(f"{self.state}/runs"))
        found = self._manifest()
        versions = found["parts"][name]
        schema = StructType.fromJson(found["schemas"][name])
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.state}/{name}/version={v}/part={p}" for p, v in versions.items()])

    def _manifest(self) -> dict | None:
        path = f"{self.state}/manifest.json"
        if not exists(self.spark, path):
            return None
        return json.loads(get_text(self.spark, path))

    def _slot(self, *columns: str) -> Column:
        return F.pmod(F.hash(*columns), F.lit(self.slots))

    def _slots(self, name: str, wanted: DataFrame, *columns: str) -> DataFrame | None:
        """The slots of a table that hold one of wanted's values; at most ``slots`` numbers come to the driver."""
        if not exists(self.spark, f"{self.state}/{name}"):
            return None
        slots = [r[0] for r in wanted.select(self._slot(*columns)).distinct().collect()]
        ddl = self._record_ddl if name == "records" else KEYS
        return self.spark.read.schema(f"{ddl}, {PLACE}").parquet(f"{self.state}/{name}").where(F.col("slot").isin(slots) if slots else F.lit(False))

    def _put(self, df: DataFrame, name: str, batch_id: int, *by: str) -> None:
        df.withColumn("slot", self._slot(*by)).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.state}/{name}/batch={batch_id}")

    # Taking in

    def add(self, docs: DataFrame, batch_id: int) -> None:
        """Takes in a batch of run documents; the same batch again changes nothing."""
        fresh = source.record_rows(docs).drop("seq")
        self._record_ddl = fresh.schema.toDDL()
        known = self._slots("keys_by_record", fresh, *RECORD)
        if known is not None:
            fresh = fresh.join(known.where(F.col("batch") != batch_id).select(*RECORD), RECORD, "left_anti")
        if self.exclusions is not None:
            fresh = without_excluded(fresh, self.exclusions)
        self._put(fresh, "records", batch_id, *RECORD)
        keys = cut(self._keys(self.spark.read.schema(self._record_ddl).parquet(f"{self.state}/records/batch={batch_id}")))
        self._put(keys, "keys_by_record", batch_id, *RECORD)
        self._put(keys, "keys_by_key", batch_id, "key")
        source.run_versions(docs).write.mode("overwrite").parquet(f"{self.state}/runs/batch={batch_id}")
        self._refresh(self.touched(batch_id), batch_id)

    @staticmethod
    def _keys(records: DataFrame) -> DataFrame:
        rows = entity.keyed(entity.repaired(records))
        keys = F.array(F.concat(F.lit("r:"), "run_id", F.lit("|"), "record_id"), F.concat(F.lit("u:"), "url_key"), F.concat(F.lit("c:"), "content_key"))
        return rows.select(*RECORD, F.explode(F.array_compact(keys)).alias("key"))

    def touched(self, batch_id: int) -> DataFrame:
        """run_id, record_id of the batch's records and of all earlier ones that chains of keys lead to."""
        newest = self.spark.read.schema(KEYS).parquet(f"{self.state}/keys_by_record/batch={batch_id}")
        records, ends = cut(newest.select(*RECORD).distinct()), cut(newest.select("key").distinct())
        seen = ends
        while True:
            met = self._slots("keys_by_key", ends, "key").where(F.col("batch") <= batch_id).join(ends, "key", "left_semi").select(*RECORD).distinct()
            more = cut(met.join(records, RECORD, "left_anti"))
            if more.isEmpty():
                return records
            records = cut(records.unionByName(more))
            theirs = self._slots("keys_by_record", more, *RECORD).where(F.col("batch") <= batch_id).join(more, RECORD, "left_semi").select("key").distinct()
            ends = cut(theirs.join(seen, "key", "left_anti"))
            seen = cut(seen.unionByName(ends))

    def _refresh(self, touched: DataFrame, batch_id: int) -> None:
        records = self._slots("records", touched, *RECORD).where(F.col("batch") <= batch_id).drop("slot").join(touched, RECORD, "left_semi")
        made = entity.resolved(source.numbered(records, ["batch", "path", "pos"]))
        new = {n: cut(made[n].withColumn("part", F.pmod(F.hash("item_id"), F.lit(self.parts)))) for n in VERSIONED}
        before = self._manifest() or {"parts": {n: {} for n in VERSIONED}, "schemas": {}}
        parts = {r[0] for r in new["items"].select("part").distinct().collect()}  # at most self.parts numbers
        gone = None
        if before["parts"]["sightings"]:
            gone = cut(self.read("sightings").join(touched, RECORD, "left_semi").select("item_id").distinct())
            parts |= {r[0] for r in gone.select(F.pmod(F.hash("item_id"), F.lit(self.parts))).distinct().collect()}
        version = f"{batch_id}-{uuid.uuid4().hex[:8]}"  # a batch taken in again must not write over what it reads
        after = {"parts": {}, "schemas": {n: new[n].drop("part").schema.jsonValue() for n in VERSIONED}}
        for name in VERSIONED:
            rows, held = new[name], before["parts"][name]
            if old := [f"{self.state}/{name}/version={held[str(p)]}/part={p}" for p in sorted(parts) if str(p) in held]:
                kept = self.spark.read.schema(rows.drop("part").schema).parquet(*old)
                kept = kept.join(gone, "item_id", "left_anti") if gone is not None else kept
                rows = kept.withColumn("part", F.pmod(F.hash("item_id"), F.lit(self.parts))).unionByName(rows)
            target = f"{self.state}/{name}/version={version}"
            rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(target)
            filled = {r[0] for r in rows.select("part").distinct().collect()}
            after["parts"][name] = {p: v for p, v in held.items() if int(p) not in parts} | {str(p): version for p in sorted(filled)}
        self._swap(before, after)

    def _swap(self, before: dict, after: dict) -> None:
        """Makes the new versions those that are read, then removes parts that no manifest names any more."""
        put_text(self.spark, f"{self.state}/manifest.json", json.dumps(after))
        for name in VERSIONED:
            for p, v in before["parts"][name].items():
                if after["parts"][name].get(p) != v:
                    remove(self.spark, f"{self.state}/{name}/version={v}/part={p}")

    def run(self, root: str, tell: Callable[[str, int], None] | None = None) -> None:
        """Takes in everything new under root and stops; tell(message, documents so far) hears of its progress."""
        listener = Progress(tell) if tell else None
        if listener:
            self.spark.streams.addListener(listener)
        query = stream(self.spark, root).writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.state}/_progress").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            if listener:
                self.spark.streams.removeListener(listener)


def run_folders(root: str) -> list[str]:
    """Run folders under a local root, in import order."""
    return sorted(str(p.parent) for p in Path(root).glob("*/*/results.json"))
