"""Best representative of each duplicate group: one surviving record, its fields taken from the best rows.

Every row gets a vector of completeness (of its text and of its image quote), recency (last_seen) and trust (the kind
of URL key). The undominated vectors of a group form its skyline, the first layer; a lexicographic policy picks the
row of each field from it. A field that the layer leaves null, such as a stated time that only dominated rows have,
is filled from the next dominance layer: the skyline of the rows that hold a field which is still null.

Rows are sorted so that a dominating row comes first; a task holds the layers of one group. As a skyline of parts'
skylines is that of the whole, groups of more than ``SALT_ROWS`` rows are first reduced in salted parts.

Defined results: rows with a null key are in no group; a group of one row is left out; a field in which no row has
a usable value has no output row; rows that tie in everything resolve to the smallest item_id.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions import times

SALT_ROWS = 5000
FIELDS = ("text", "time_exact", "image_text", "last_seen")
DIMENSIONS = ("d_text", "d_image", "d_seen", "d_trust")
HELD = "held"  # bits of the FIELDS that a row has a usable value for
#: A text shorter than this share of a damaged copy's length is no complete one: damage may change the length a little.
DAMAGED_SLACK = 0.93

# Interface labels that get copied behind a text.
LABELS = r"See more|See More|See less|See Less|Most relevant|View more comments|See translation|All reactions:?|Write a comment(?:…|\.\.\.)?|Like|Share|Reply|Facepage|Comment|Follow|\d{1,4} ?[hdwm]"
_TAIL = re.compile(rf"(?:[\s·]*(?:{LABELS}))+[\s·]*$")
_CUT = re.compile(r"(?:…|\.\.\.)\s*(?:See [Mm]ore)?\s*$|\bSee [Mm]ore\s*$")
#: Question marks stand for lost letters inside words, as whole words before others, and in rows of words; a word
#: that ends in some may be a question and counts as it stands.
_BROKEN = re.compile("\ufffd|\\w\\?{2,}\\w|(?<!\\S)\\?{2,}\\w|(?<!\\S)\\?{3,}(?=\\s+\\w)|\\?{2,}[ ,.]+\\?")
_OPENING = re.compile(r"says?:? (['\"“‘])")
_CLOSING = {"'": "'", '"': '"', "“": "”", "‘": "’"}


def text_state(text: str | None) -> tuple[int, int, int]:
    """(length if undamaged, length if intact but for a cut or labels, length if broken); -1 where it is not the case."""
    if not text or not text.strip():
        return -1, -1, -1
    if _BROKEN.search(text):
        return -1, -1, len(text)
    bare = _TAIL.sub("", text)
    size = sum(c.isalnum() for c in bare)
    if bare.strip() != text.strip() or _CUT.search(text):
        return -1, size, -1
    return size, size, -1


def quote_length(image_text: str | None) -> int:
    """Length of what an image text quotes; -1 if it quotes nothing or the quote is cut."""
    text = (image_text or "").rstrip()
    for found in _OPENING.finditer(text):
        if text.endswith(_CLOSING[found[1]]) and len(text) - 1 > found.end():
            return len(text) - 1 - found.end()
    return -1


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("whole", "intact", "broken", "length")]))
def _text_state(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(*text_state(v), len(v or "")) for v in values], columns=["whole", "intact", "broken", "length"])


@F.pandas_udf(T.LongType())
def _quote_length(values: pd.Series) -> pd.Series:
    return pd.Series([quote_length(v) for v in values], dtype="int64")


def second_of(text: Column) -> Column:
    """UTC second of a stated moment; without a zone it is UTC; null if it states none."""
    tidy = times.tidy(text)
    seconds = times.group(tidy, r"\d{1,2}:\d{2}:(\d{2}(?:\.\d+)?)", 1).try_cast("double")
    return times.bind(times.stated_minute(tidy), lambda s: (s["minute"] - F.coalesce(s["shift"], F.lit(0))) * 60) + F.coalesce(seconds, F.lit(0.0))


def horizon(runs: DataFrame) -> float:
    """The last UTC second of any run; a moment after it is not real."""
    last = runs.select(F.greatest(*[second_of(F.col(c)) for c in ("started_at", "finished_at", "imported_at")]).alias("s")).agg(F.max("s")).first()[0]
    return float("inf") if last is None else last


#: The dimension that says how good a field's value is; a stated time is there or not.
_QUALITY = {"text": 0, "image_text": 1, "last_seen": 2}


def _policy(row: tuple, field: str) -> tuple:
    """What decides among the rows that hold a field: its own quality, then trust, recency, completeness."""
    _, item, d, _ = row
    own = _QUALITY.get(field)
    return (0.0 if own is None else -d[own], -d[3], -d[2], -d[0], -d[1], item)


class _Skyline:
    """The undominated ones of rows that come in falling order of their dimensions."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, row: tuple) -> None:
        if not any(s[2] != row[2] and all(a >= b for a, b in zip(s[2], row[2], strict=True)) for s in self.rows):
            self.rows.append(row)


class _Group:
    """The layers of the group that is read just now: of all rows, and of those that hold each field."""

    def __init__(self, key: tuple) -> None:
        self.key, self.first = key, _Skyline()
        self.holding = [_Skyline() for _ in FIELDS]

    def add(self, row: tuple) -> None:
        self.first.add(row)
        for k, holders in enumerate(self.holding):
            if row[3] >> k & 1:
                holders.add(row)

    def kept(self) -> list[tuple]:
        """The rows that may be in a layer of the whole group."""
        rows = {r[1:]: r for s in [self.first, *self.holding] for r in s.rows}
        return list(rows.values())

    def best(self) -> list[tuple[str, str]]:
        """(field, item) by the first layer, then by the next one for what it leaves null."""
        out, missing = [], set(range(len(FIELDS)))
        layer = self.first.rows
        while missing and layer:
            filled = {k for k in missing if any(r[3] >> k & 1 for r in layer)}
            out += [(FIELDS[k], min((r for r in layer if r[3] >> k & 1), key=lambda r: _policy(r, FIELDS[k]))[1]) for k in filled]
            missing -= filled
            rest = _Skyline()
            for r in sorted({r[1:]: r for k in missing for r in self.holding[k].rows}.values(), key=lambda r: ([-x for x in r[2]], r[1])):
                rest.add(r)
            layer = rest.rows
        return out


def _groups(batches, width: int):
    """Finished groups of rows that arrive sorted by their first width columns."""
    group = None
    for pdf in batches:
        for values in pdf.itertuples(index=False, name=None):
            key = values[:width]
            if group is None or group.key != key:
                if group is not None:
                    yield group
                group = _Group(key)
            group.add((key, values[width], tuple(values[width + 1 : width + 1 + len(DIMENSIONS)]), int(values[width + 1 + len(DIMENSIONS)])))
    if group is not None:
        yield group


def _frames(rows, columns: list[str], size: int = 5000):
    while chunk := list(islice(rows, size)):
        yield pd.DataFrame(chunk, columns=columns)


def survivors(items: DataFrame, runs: DataFrame, key: str = "content_key", item: str = "item_id") -> DataFrame:
    """key, field_name, item: for each group of two rows or more, the row whose value the survivor takes."""
    several = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = items.select(key, item, *FIELDS, F.col("url_key").alias("_url")).join(several, key)
    last = horizon(runs)
    seen = second_of(F.col("last_seen"))
    stated = times.bind(times.stated_minute(times.tidy(F.col("time_exact"))), lambda s: s["minute"]).isNotNull()
    state = rows.select(
        key, item, "_n", _text_state(F.col("text")).alias("s"), F.coalesce(stated, F.lit(False)).alias("timed"),
        _quote_length(F.col("image_text")).alias("d_image"),
        F.when(seen <= last, seen).otherwise(-1.0).alias("d_seen"),
        F.when(F.col("_url").isNull(), 0).when(F.col("_url").startswith("url:/photo"), 1).otherwise(2).alias("d_trust"),
    )
    extent = state.groupBy(key).agg(F.max("s.intact").alias("_intact"), F.max("s.broken").alias("_broken"))
    complete = (F.col("s.whole") >= F.col("_intact")) & (F.col("s.length") >= DAMAGED_SLACK * F.col("_broken"))
    vectors = state.join(extent, key).select(
        key, item, "_n", F.when(complete, F.col("s.whole")).otherwise(-1).cast("double").alias("d_text"), *[F.col(d).cast("double").alias(d) for d in DIMENSIONS[1:]], "timed"
    )
    usable = {"text": F.col("d_text") >= 0, "time_exact": F.col("timed"), "image_text": F.col("d_image") >= 0, "last_seen": F.col("d_seen") >= 0}
    held = sum((F.when(usable[f], 1 << k).otherwise(0) for k, f in enumerate(FIELDS)), F.lit(0))
    vectors = vectors.withColumn(HELD, held).groupBy(key, "_n", *DIMENSIONS, HELD).agg(F.min(item).alias(item))
    order = [*[F.desc(d) for d in DIMENSIONS], F.desc(HELD)]
    kinds = dict(items.dtypes)
    columns = [key, "_salt", item, *DIMENSIONS, HELD]
    salted = f"{key} {kinds[key]}, _salt int, {item} {kinds[item]}, {', '.join(f'{d} double' for d in DIMENSIONS)}, {HELD} int"

    def reduced(batches):
        yield from _frames(((*group.key, *r[1:2], *r[2], r[3]) for group in _groups(batches, 2) for r in group.kept()), columns)

    def resolved(batches):
        yield from _frames(((group.key[0], *b) for group in _groups(batches, 1) for b in group.best()), [key, "field_name", item])

    # One pass over all groups: small ones have the one salt 0 and are only sorted here.
    parts = (F.col("_n") / SALT_ROWS).cast("int") + 1
    spread_rows = vectors.withColumn("_salt", F.pmod(F.hash(item), parts).cast("int")).select(columns)
    reduced_rows = spread_rows.repartition(key, "_salt").sortWithinPartitions(key, "_salt", *order, item).mapInPandas(reduced, salted)
    merged = reduced_rows.drop("_salt").repartition(key).sortWithinPartitions(key, *order, item)
    return merged.mapInPandas(resolved, f"{key} {kinds[key]}, field_name string, {item} {kinds[item]}")


def surviving_records(items: DataFrame, runs: DataFrame, key: str = "content_key", item: str = "item_id") -> DataFrame:
    """key with the four best values of each group of two rows or more, null where no row has a usable one."""
    best = survivors(items, runs, key, item)
    values = items.select(F.col(item), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])).alias("v")).select(item, "v.*")
    picked = best.join(values, [item, "field_name"])
    return picked.groupBy(key).agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS])
