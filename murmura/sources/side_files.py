"""Side files that are kept beside the data: exclusions and labels, made by hand, in any file system that Spark knows."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.sources.writer import exists, get_text, put_text

EXCLUSIONS = "run_id STRING, record_id STRING, item_id STRING, keyword STRING, reason STRING, excluded_at STRING"
LABELS = "item_id STRING, keyword STRING, sentiment STRING, reason STRING, labeler STRING, labeled_at STRING, refs ARRAY<STRUCT<run_id: STRING, record_id: STRING>>"


def _read(spark: SparkSession, path: str, name: str) -> list[dict]:
    if not exists(spark, path):
        return []
    try:
        return json.loads(get_text(spark, path))[name]
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise ValueError(f"{path} can't be read: {e}") from e


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Exclusions of a side file; none if it is missing, ValueError if it can't be read."""
    fields = [f.split()[0] for f in EXCLUSIONS.split(", ")]
    return spark.createDataFrame([tuple(e.get(f) for f in fields) for e in _read(spark, path, "exclusions")], EXCLUSIONS)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a side file with the sightings that they refer to."""
    fields = [f.split()[0] for f in LABELS.split(", ")[:6]]
    rows = [(*[e.get(f) for f in fields], [tuple(r) for r in e.get("refs") or []]) for e in _read(spark, path, "labels")]
    return spark.createDataFrame(rows, LABELS)


def write_side_file(df: DataFrame, path: str, name: str) -> None:
    """Hand-made entries as one readable JSON file, written whole and then moved into place.

    Entries stream through the driver one partition at a time; none are kept there.
    """

    def entries() -> Iterator[str]:
        for k, row in enumerate(df.toLocalIterator()):
            e = row.asDict(recursive=True)
            if e.get("refs"):
                e["refs"] = [[r["run_id"], r["record_id"]] for r in e["refs"]]
            yield (",\n" if k else "\n") + json.dumps(e, ensure_ascii=False)

    head = f'{{"about": {json.dumps(f"{name} set by hand")}, {json.dumps(name)}: ['
    put_text(df.sparkSession, path, head, entries(), "\n]}")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The searches of a batch report, one row each: keyword, scope, group_url, status, run_id, saved, error."""
    fields = ["keyword", "scope", "group_url", "status", "run_id", "saved", "error"]
    rows = [tuple(None if s.get(f) is None else str(s[f]) for f in fields) for s in _read(spark, path, "searches")]
    return spark.createDataFrame(rows, ", ".join(f"{f} STRING" for f in fields)).withColumn("saved", F.col("saved").try_cast("bigint"))
