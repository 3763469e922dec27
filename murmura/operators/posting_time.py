"""One unambiguous UTC posting time per item from mixed writings and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import times
from murmura.operators import zones

STATED = ("posted_at", "time_exact", "time_text")


def utc_text(minute: Column) -> Column:
    return F.date_format(F.timestamp_seconds(minute * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def posting_times(items: DataFrame, runs: DataFrame) -> DataFrame:
    """item_id, posted_utc, how, ambiguous: one row per item.

    how names the field that fixed the time: with a zone of its own (``posted_at``, ``time_exact``), a label
    counted back from first_seen (``ago``), or a clock time read in the run's zone (``local``). A local clock
    time is joined as-of to the exploded offset intervals of browser_timezone: one interval gives the offset; two
    mean that it is ambiguous, which the run's fixed offset resolves if it is one of the two, while otherwise
    posted_utc stays null and ambiguous says why; none means that it does not exist there and fixes nothing.
    Without a zone name, or with one that is no IANA name, the fixed offset counts; without both, or with a null,
    empty, impossible or clockless field, posted_utc is null. Runs that are missing count as runs without a zone.
    Repeated item rows give one output row each. Extra columns are ignored.
    """
    run_side = runs.select(
        F.col("run_id").alias("_run"), zones.known_zone(F.col("browser_timezone")).alias("zone"), F.col("browser_utc_offset_minutes").cast("bigint").alias("fixed")
    ).dropDuplicates(["_run"])
    spans = zones.interval_table(run_side.select("zone"))
    rows = items.select("item_id", F.col("first_run_id").alias("_run"), "first_seen", *STATED).join(run_side, "_run", "left")
    rows = rows.select("item_id", "zone", "fixed", F.floor(times.utc_second(F.col("first_seen")) / 60).alias("seen"), *[times.tidy(F.col(c)).alias(c) for c in STATED])
    # One lambda over the three fields keeps the parser once in the plan; three inlined copies would exceed the
    # size of a generated method.
    rows = rows.select("item_id", "zone", "fixed", "seen", "time_text", F.transform(F.array(*STATED), times.stated_minute).alias("read"))
    rows = zones.as_of(rows, spans, "utc", "zone", "seen", "seen_at")
    # Without a stretch (no zone, or a year without one) the fixed offset is what is left.
    rows = rows.withColumn("seen_shift", F.coalesce(F.col("seen_at.shift"), F.col("fixed")))
    local = F.coalesce(
        *[F.when(F.col("read")[k]["shift"].isNull(), F.col("read")[k]["minute"]) for k in range(len(STATED))],
        times.called_minute(F.col("time_text"), F.col("seen") + F.col("seen_shift")),
    )
    stated = [F.col("read")[k]["minute"] - F.col("read")[k]["shift"] for k in range(len(STATED))]
    rows = rows.select(
        "item_id", "zone", "fixed", local.alias("local"),
        *[s.alias(f"u_{c}") for s, c in zip(stated, STATED, strict=True)],
        (F.col("seen") - times.minutes_ago(F.col("time_text"))).alias("u_ago"),
    )
    rows = zones.as_of(rows, spans, "local", "zone", "local", "at")
    both = F.col("at.hits") > 1
    agreed = F.when((F.col("at.shift") == F.col("fixed")) | (F.col("at.other") == F.col("fixed")), F.col("fixed"))
    shift = F.when(F.col("at").isNull(), F.col("fixed")).when(both, agreed).otherwise(F.col("at.shift"))
    rows = rows.withColumn("u_local", F.col("local") - shift).withColumn("both", F.coalesce(both, F.lit(False)))
    order = ["u_posted_at", "u_time_exact", "u_time_text", "u_local", "u_ago"]
    how = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c[2:])) for c in order])
    unfixed = F.coalesce(how == "local", F.col("both"))
    return rows.select(
        "item_id", utc_text(F.coalesce(*order)).alias("posted_utc"), how.alias("how"),
        (F.col("both") & unfixed).alias("ambiguous"),
        *order,
    )
