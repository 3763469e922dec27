"""Deduplicating new batches against all history without going through the history again.

Accepted rows are kept as hashes in bucketed tables. A row belongs to a class of rows that are alike in scope,
author, content, text and post id; copies share a class, and links are found between classes only. A text is a set
of paragraphs: runs of words that end with their sentence or after a word that its own hash marks, so that an edit
changes the paragraph around it and no other. Each class has keys: its post id, its content key and some of its
paragraphs. The paragraphs stand in one fixed order (long ones first); texts that share ``COVER`` of the larger
one's words in paragraphs share one of the first paragraphs of both, so all such links are found.

A batch is joined to the key table bucket by bucket, and only to those parts (``slots``) of it that hold one of the
batch's keys; candidates are verified on the hashes of the classes that were met; the batch's rows and keys are
appended. Slots and buckets come from one hash, so each slot is one file of one bucket and batch.

Two rows are the same post if their URL keys name one post or comment, or if at least one names none (or only a
photo), they share content key or text (``COVER`` of the larger text's words in shared paragraphs, ``MIN_LETTERS``
letters), stand in one group (comments: under one parent post), and their authors do not differ.

Defined results: a null, blank or label author differs from none; rows without a group match by URL key only;
rows of one run are never paired; an empty batch or table changes nothing; row order within a batch does not
matter.
"""

from __future__ import annotations

import base64
import binascii
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import personal
from murmura.llm.visible import canonical, visible
from murmura.session import cut, remove, shared_path

COVER = 0.5
MIN_LETTERS = 12
MEMBERS_PER_SALT = 2000

# Interface labels that stand in place of a name.
NAME_LABELS = frozenset("online status indicator|anonymous participant|anonymous member|group member|verified account|see more|follow|author|admin|moderator|top contributor".split("|"))

_WORD = re.compile(r"\w+")
_ID = re.compile(r"story_fbid=(\d+)|multi_permalinks=(\d+)|/(?:posts|permalink|reel|reels|videos|item|events)/(\d+)|[?&]v=(\d+)", re.I)
_GROUP = re.compile(r"/groups/([^/?#]+)", re.I)


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def post_id(url_key: str | None) -> str | None:
    """The post or comment that a URL key names, whatever its form; null for none and for a photo's."""
    if not url_key or not url_key.strip():
        return None
    key = url_key.strip()
    if key.lower().startswith("comment:"):
        name = key[8:]
        if not re.fullmatch(r"[\d_]+", name):
            try:
                name = base64.b64decode(name + "=" * (-len(name) % 4), validate=True).decode().rpartition(":")[2]
            except (binascii.Error, UnicodeDecodeError, ValueError):
                return f"c:{name}"
        return f"c:{name.rpartition('_')[2]}"
    if found := _ID.search(key):
        return f"p:{next(g for g in found.groups() if g)}"
    return None if key.lower().startswith("url:/photo") else f"u:{key.lower().rstrip('/')}"


def scope_of(kind: str | None, group_url: str | None, parent_url: str | None) -> str | None:
    """Where two rows must both stand to be one post without a common id."""
    if kind in ("comment", "reply"):
        return f"c:{post_id('url:' + parent_url) or parent_url.strip().lower()}" if parent_url and parent_url.strip() else None
    found = _GROUP.search(group_url or "")
    return f"g:{found[1].lower()}" if found else None


def author_of(name: str | None) -> str | None:
    """A name for comparison; null for a missing one and for an interface label."""
    if not name or not name.strip():
        return None
    plain = canonical(name)
    if any(c.isdigit() or c == "@" for c in plain):
        plain = re.sub(r"\[(?:email|phone)\]", " ", personal.redact(plain, personal.NAME_FIELD_TYPES)[0].lower())
    plain = " ".join(_WORD.findall(plain))
    return None if not plain or plain in NAME_LABELS else plain


_MASK64 = (1 << 64) - 1
_ODD = np.array([_hash("odd", k) | 1 for k in range(3)], np.int64).view(np.uint64)
LONGEST = 60  # words of a paragraph at most
ENDS = 3  # one word in so many ends a paragraph
_PLACES = np.array([_hash("place", k) | 1 for k in range(LONGEST)], np.int64).view(np.uint64)
#: Words, and what ends a sentence.
_TOKEN = re.compile(r"\w+|[.!?؟।۔…]\s|\n")
_words: dict[str, int] = {}


def _word(token: str) -> int:
    """Hash of a word; 0 for the end of a sentence."""
    if len(_words) > 1 << 20:
        _words.clear()
    first = token[0]
    made = _words[token] = 0 if not (first.isalnum() or first == "_") else xxhash.xxh64_intdigest(token) | 1
    return made


def _mixed(values: np.ndarray, *seeds: int) -> np.ndarray:
    """values under seeds, as signed 64-bit keys."""
    for k, seed in enumerate(seeds):
        values = (values ^ np.uint64(seed & _MASK64)) * _ODD[k % 3]
        values ^= values >> np.uint64(31)
    return values.view(np.int64)


_NONE = np.empty(0, np.int32)


def paragraphs(text: str | None) -> tuple[int | None, np.ndarray]:
    """(hash of the whole text, its paragraphs in the fixed order); null and nothing for short texts.

    A paragraph is one INT: its number of words in the highest six bits, the rest a hash.
    """
    tokens = _TOKEN.findall(visible(text).casefold()) if text else []
    if not tokens:
        return None, _NONE
    known = _words.get
    every = np.array([h if (h := known(t)) is not None else _word(t) for t in tokens], np.uint64)
    is_word = every != 0
    hashes = every[is_word]
    if sum(map(len, tokens)) - 2 * (len(every) - len(hashes)) < MIN_LETTERS or not len(hashes):
        return None, _NONE
    whole = xxhash.xxh64_intdigest(hashes.tobytes())
    sentence = np.cumsum(~is_word)[is_word]
    ends = ((hashes >> np.uint64(17)) % np.uint64(ENDS)) == 0
    starts = np.flatnonzero(np.r_[True, ends[:-1] | (sentence[1:] != sentence[:-1])])
    sizes = np.diff(np.r_[starts, len(hashes)])
    place = np.arange(len(hashes)) - np.repeat(starts, sizes)
    if (sizes > LONGEST).any():  # cut every LONGEST words
        starts = np.flatnonzero(np.r_[True, (place[1:] % LONGEST == 0)])
        sizes = np.diff(np.r_[starts, len(hashes)])
        place = np.arange(len(hashes)) - np.repeat(starts, sizes)
    sums = np.add.reduceat((hashes ^ (hashes >> np.uint64(29))) * _PLACES[place], starts)
    made = (sizes.astype(np.int64) << 25) | ((sums * _ODD[0]) >> np.uint64(39)).astype(np.int64)
    return whole, np.unique(made)[::-1].astype(np.int32)


def _weights(values: np.ndarray) -> np.ndarray:
    return values >> 25


def _prefix(values: np.ndarray) -> np.ndarray:
    """The first paragraphs, of which a text that shares ``COVER`` of the words must have one among its own first."""
    words = np.cumsum(_weights(values))
    return values[: int(np.searchsorted(words, (1 - COVER) * words[-1], side="right")) + 1].astype(np.uint64) if len(values) else values.astype(np.uint64)


FIELDS = ("item_id", "first_run_id", "url_key", "content_key", "kind", "group_url", "parent_post_url", "author_name", "text")
SCHEMA = (
    "class bigint, item_id string, first_run_id string, post bigint, placed boolean, named boolean, author bigint, content bigint, "
    "parts array<int>, keys array<bigint>, open_keys array<bigint>"
)


def _signed(value: int | None) -> int | None:
    return None if value is None else value - (1 << 64) if value >= 1 << 63 else value


class _Classes:
    """Turns rows into classes with keys; a class that a task has met before gets no keys again."""

    def __init__(self) -> None:
        self.met: set[int] = set()
        self.names: dict[str | None, str | None] = {}

    def row(self, u, c, k, g, p, a, t) -> tuple:
        post, scope = post_id(u), scope_of(k, g, p)
        if len(self.names) > 1 << 18:
            self.names.clear()
        name = self.names[a] if a in self.names else self.names.setdefault(a, author_of(a))
        whole, parts = paragraphs(t) if scope else (None, _NONE)
        own = _hash(post, scope, name, c, whole, *([] if whole is not None else [t]))
        head = (own, _hash(post) if post else None, scope is not None, name is not None, _hash(name) if name is not None else None, _hash(scope, c) if scope and c else None)
        if own in self.met or scope is None:
            keys = np.array([_hash("id", post)] if post and own not in self.met else [], np.int64)
            return head, parts, keys, np.empty(0, np.int64)
        if len(self.met) < 1 << 20:
            self.met.add(own)
        where = xxhash.xxh64_intdigest(scope)
        shared = np.append(_prefix(parts), np.uint64(xxhash.xxh64_intdigest(c))) if c else _prefix(parts)
        # Classes with an author meet others of the same author; one without meets all of its scope (open keys).
        keys = [_mixed(shared, where, xxhash.xxh64_intdigest(name))] if name is not None else []
        if post:
            keys.append(np.array([_hash("id", post)], np.int64))
        return head, parts, np.concatenate(keys) if keys else np.empty(0, np.int64), _mixed(shared, where)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


def _classified(batches):
    made = _Classes()
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(2, len(FIELDS))]
        rows = [made.row(*values) for values in zip(*columns, strict=True)]
        heads = list(zip(*[r[0] for r in rows], strict=True)) or [()] * 6
        long, flag = pa.int64(), pa.bool_()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(heads[0], long), batch.column(0), batch.column(1), pa.array(heads[1], long), pa.array(heads[2], flag), pa.array(heads[3], flag),
                pa.array(heads[4], long), pa.array(heads[5], long), _lists([r[1] for r in rows], pa.int32()), _lists([r[2] for r in rows], long), _lists([r[3] for r in rows], long),
            ],
            names=[f.split()[0] for f in SCHEMA.replace("array<", "").split(", ")],
        )


def classified(rows: DataFrame) -> DataFrame:
    """Rows of items with their class and its keys."""
    return rows.select(*FIELDS).mapInArrow(_classified, SCHEMA)


class History:
    """The accepted rows' classes and keys, in bucketed tables under the shared folder.

    buckets is the number of join tasks, slots (a multiple of it) the number of parts that a batch may leave unread:
    give both by the size that the history will reach. ``with History(spark) as h`` removes the tables in the end.
    """

    def __init__(self, spark: SparkSession, buckets: int = 16, slots: int = 64) -> None:
        if slots % buckets:
            raise ValueError("slots must be a multiple of buckets")
        self.spark, self.path = spark, shared_path(spark, "history")
        self.buckets, self.slots = buckets, slots
        self.name = "history_" + re.sub(r"\W", "_", self.path.rpartition("-")[2])
        self.batches = 0

    def __enter__(self) -> History:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def _slot(self, column: str) -> Column:
        return F.pmod(F.hash(column), F.lit(self.slots))  # the hash that Spark's buckets go by

    def _append(self, df: DataFrame, kind: str, by: str) -> None:
        writer = df.write.mode("append").format("parquet").partitionBy("slot").bucketBy(self.buckets, by)
        writer.option("path", f"{self.path}/{kind}").saveAsTable(f"{self.name}_{kind}")

    def _part(self, kind: str, by: str, wanted: DataFrame) -> DataFrame:
        """The slots of a table that hold one of wanted's values; their numbers, at most ``slots``, come to the driver."""
        slots = [r[0] for r in wanted.select(self._slot(by)).distinct().collect()]
        return self.spark.table(f"{self.name}_{kind}").where(F.col("slot").isin(slots) if slots else F.lit(False))

    def rows(self) -> DataFrame:
        """One row per accepted row, bucketed by class."""
        return self.spark.table(f"{self.name}_rows")

    def keys(self) -> DataFrame:
        """(key, class, open, named, batch), bucketed by key."""
        return self.spark.table(f"{self.name}_keys")

    def accept(self, rows: DataFrame) -> DataFrame:
        """Appends a batch; the verified links (class_a, class_b) that it makes with history and within itself.

        Texts are read once, here. A class that the batch adds a further row to is linked with itself. Keys of the
        open side never meet unless one of the two classes has no author, so that a busy group does not multiply
        its rows.
        """
        number = self.batches
        self._append(classified(rows).withColumn("batch", F.lit(number)).withColumn("slot", self._slot("class")).repartition("slot"), "rows", "class")
        batch = self.rows().where(F.col("batch") == number)
        own = batch.select(F.explode("keys").alias("key"), "class", F.lit(False).alias("open"), "named")
        shared = batch.select(F.explode("open_keys").alias("key"), "class", F.lit(True).alias("open"), "named")
        keys = own.unionByName(shared).withColumn("slot", self._slot("key")).repartition("slot").dropDuplicates(["slot", "key", "class", "open"])
        self._append(keys.withColumn("batch", F.lit(number)), "keys", "key")
        new = self.keys().where(F.col("batch") == number)
        everything = self._part("keys", "key", new).where(F.col("batch") <= number)
        found = self._meet(new.where("not open or not named"), everything)
        if number:
            old = everything.where(F.col("batch") < number)
            found = found.unionByName(self._meet(new.where("open and named"), old.where("open and not named")))
        self.batches += 1
        return self._verified(cut(found.distinct())).unionByName(self._own_links(batch))

    @staticmethod
    def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = left.select("key", F.col("class").alias("x")), right.select("key", F.col("class").alias("y"))
        both = a.join(b, "key").where("x <> y")
        return both.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The candidate links that hold: one post id, or text and author of rows of which one names no post."""
        wanted = pairs.select(F.col("class_a").alias("class")).union(pairs.select("class_b")).distinct()
        part = self._part("rows", "class", wanted)
        side = part.select("class", "post", "author", "content", "parts").join(wanted, "class", "left_semi").dropDuplicates(["class"])
        for x in "ab":
            pairs = pairs.join(side.select(F.col("class").alias(f"class_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in side.columns[1:]]), f"class_{x}")
        words = [F.aggregate(v, F.lit(0), lambda n, p: n + F.shiftright(p, 25)) for v in (F.array_intersect("parts_a", "parts_b"), F.col("parts_a"), F.col("parts_b"))]
        alike = F.coalesce(F.col("content_a") == F.col("content_b"), F.lit(False)) | (words[0] >= COVER * F.greatest(words[1], words[2], F.lit(1)))
        authors = F.col("author_a").isNull() | F.col("author_b").isNull() | (F.col("author_a") == F.col("author_b"))
        nameless = F.col("post_a").isNull() | F.col("post_b").isNull()
        same = F.coalesce(F.col("post_a") == F.col("post_b"), F.lit(False))
        return pairs.where(same | (nameless & authors & alike)).select("class_a", "class_b")

    def _own_links(self, batch: DataFrame) -> DataFrame:
        """Classes of a batch with several rows that are one post: a post id, or a place with a content key or a text of some length."""
        one_post = "post is not null or (placed and (content is not null or size(parts) > 0))"
        added = batch.where(one_post).select("class").distinct()
        counted = self._part("rows", "class", added).select("class").join(added, "class", "left_semi").groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
        return counted.select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))

    def members(self, links: DataFrame) -> DataFrame:
        """class, item_id, first_run_id of the rows of linked classes."""
        wanted = links.select(F.col("class_a").alias("class")).union(links.select("class_b")).distinct()
        return self.rows().select("class", "item_id", "first_run_id").join(wanted, "class", "left_semi")

    def row_pairs(self, links: DataFrame) -> DataFrame:
        """item_a, item_b of different runs behind links of classes; a large class is split over salts."""
        members = self.members(links)
        sizes = members.groupBy("class").agg((F.count("*") / MEMBERS_PER_SALT).cast("int").alias("parts")).withColumnRenamed("class", "class_a")
        a = members.select(F.col("class").alias("class_a"), F.col("item_id").alias("x"), F.col("first_run_id").alias("run_x"))
        b = members.select(F.col("class").alias("class_b"), F.col("item_id").alias("y"), F.col("first_run_id").alias("run_y"))
        salted = links.join(sizes, "class_a").withColumn("salt", F.explode(F.sequence(F.lit(0), "parts"))).drop("parts")
        a = a.join(sizes, "class_a").withColumn("salt", F.pmod(F.hash("x"), F.col("parts") + 1)).drop("parts")
        rows = salted.join(a, ["class_a", "salt"]).join(b, "class_b")
        rows = rows.where("not (run_x <=> run_y) and x <> y and (class_a <> class_b or x < y)")
        return rows.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))

    def drop(self) -> None:
        for kind in ("rows", "keys"):
            self.spark.sql(f"drop table if exists {self.name}_{kind}")
        remove(self.spark, self.path)


def batches_of(items: DataFrame, runs: DataFrame, batches: int) -> list[DataFrame]:
    """items by the import time of their first run, in about equal batches; rows of unknown runs come first."""
    at = runs.select(F.col("run_id").alias("_run"), F.try_to_timestamp("imported_at").cast("double").alias("_at")).dropDuplicates(["_run"])
    rows = items.join(at, items["first_run_id"] == at["_run"], "left").drop("_run").withColumn("_at", F.coalesce("_at", F.lit(0.0)))
    bounds = at.agg(F.percentile_approx("_at", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    edges = [float("-inf"), *(bounds or []), float("inf")]
    return [rows.where((F.col("_at") > low) & (F.col("_at") <= high)).drop("_at") for low, high in zip(edges, edges[1:], strict=False)]


def _links(history: History, items: DataFrame, runs: DataFrame, batches: int) -> DataFrame:
    found = [cut(history.accept(batch)) for batch in batches_of(items.select(*FIELDS), runs, batches)]
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return cut(links.distinct())


def repeated_posts(items: DataFrame, runs: DataFrame, batches: int = 2) -> DataFrame:
    """item_a, item_b: rows of different runs that are the same post, found as the batches arrive in import order."""
    with History(items.sparkSession) as history:
        return cut(history.row_pairs(_links(history, items, runs, batches)))


def classes(items: DataFrame, runs: DataFrame, batches: int = 2) -> DataFrame:
    """item_id, class, links: every row of items with its class of alike rows and the number of linked other classes.

    Copies share a class and are not expanded into pairs; together with ``class_links`` this says as much as the pairs.
    """
    with History(items.sparkSession) as history:
        links = _links(history, items, runs, batches).where("class_a <> class_b")
        ends = links.select(F.col("class_a").alias("class")).unionAll(links.select("class_b")).groupBy("class").agg(F.count("*").alias("links"))
        return cut(history.rows().select("item_id", "class").join(ends, "class", "left").select("item_id", "class", F.coalesce("links", F.lit(0)).alias("links")))


def class_links(items: DataFrame, runs: DataFrame, batches: int = 2) -> DataFrame:
    """class_a, class_b: the links between the classes of ``classes``; a class with itself where its own rows repeat."""
    with History(items.sparkSession) as history:
        return _links(history, items, runs, batches)
