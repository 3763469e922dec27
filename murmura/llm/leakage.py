"""Evaluation texts leaking into training text: documents that contain a held-out passage, fully or partly.

Every window of ``WINDOW`` words of a test item and of a document gets a 64-bit SimHash of its words. The item
fingerprints are indexed by ``RADIUS + 1`` blocks of their bits, so that every document window within the radius
of an item window shares at least one block with it and none is missed. A pair that meets so is verified exactly:
the shingles of ``SHINGLE`` words that item and document share are chained in the order of both, each weighted by
the item words it adds, and the chain must cover at least ``COVER`` of the item's words.

The windows are smaller than the items because a document may hold only half of an item with other text between
its sentences; a window of an item's full length would then lie far from it (the README has the figures).

Defined results: null, empty and wordless texts match nothing; a document with fewer words than a window matches
only through short items; an item shorter than a window matches where its words stand in a row; a repeated
document row gives its rows again, an item at most once per row.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.visible import visible

WINDOW = 7  # odd, so that no bit of a SimHash is a tie
RADIUS = 3
SHINGLE = 3
COVER = 0.5
BLOCK_ITEMS = 20_000  # test items held at once; more are taken block by block
BLOCK_CHARS = 32_000_000  # characters of them, likewise; a longer item is a block of its own
CHUNK_WORDS = 150_000

_WORD = re.compile(r"[^\W_]+")


def leak_words(text: str | None) -> list[str]:
    return _WORD.findall(visible(text).lower()) if text else []


class Words:
    """Numbers of words and the signs of their hashes."""

    def __init__(self) -> None:
        self._ids: dict[str, int] = {}
        self.signs = np.zeros((4096, 64), np.int8)

    def ids(self, words: list[str]) -> list[int]:
        out, known = [], self._ids
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = len(known)
                if k >= len(self.signs):
                    self.signs = np.vstack([self.signs, np.zeros_like(self.signs)])
                bits = np.unpackbits(np.frombuffer(hashlib.blake2b(w.encode(), digest_size=8).digest(), np.uint8))
                self.signs[k] = bits.astype(np.int8) * 2 - 1
            out.append(k)
        return out

    def full(self) -> bool:
        return len(self._ids) > 1 << 20


def simhashes(ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """SimHash of each window of WINDOW consecutive words."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    rows = signs[ids]
    total = rows[:n].copy()
    for k in range(1, WINDOW):
        total += rows[k : k + n]
    return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


class Index:
    """Fingerprints of the windows of some test items under multi-index blocks, and their shingles."""

    def __init__(self, items: list[tuple]) -> None:
        self.vocabulary = Words()
        self.items = [(test, leak_words(text)) for test, text in items]
        prints: dict[int, set[int]] = defaultdict(set)
        self.short: list[tuple[int, str]] = []
        for k, (_, words) in enumerate(self.items):
            if len(words) >= WINDOW:
                for f in simhashes(np.array(self.vocabulary.ids(words)), self.vocabulary.signs).tolist():
                    prints[f].add(k)
            elif words:
                self.short.append((k, f" {' '.join(words)} "))
        self.prints = np.array(sorted(prints), np.uint64)
        self.owners = [sorted(prints[f]) for f in self.prints.tolist()]
        self.width = 64 // (RADIUS + 1)
        self.blocks = []
        for b in range(RADIUS + 1):
            values = self._block(self.prints, b)
            order = np.argsort(values, kind="stable")
            counts = np.bincount(values, minlength=1 << self.width) if len(values) else np.zeros(1 << self.width, int)
            self.blocks.append((order, np.concatenate([[0], np.cumsum(counts)])))
        self.places = [defaultdict(list) for _ in self.items]
        for places, (_, words) in zip(self.places, self.items, strict=True):
            for k in range(len(words) - SHINGLE + 1):
                places[tuple(words[k : k + SHINGLE])].append(k)

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places in prints, numbers of item fingerprints) of all pairs within RADIUS, one pair of arrays per block."""
        out = []
        for b, (order, starts) in enumerate(self.blocks):
            values = self._block(prints, b)
            low, high = starts[values], starts[values + 1]
            hit = np.nonzero(high > low)[0]
            sizes = (high - low)[hit]
            at = np.repeat(hit, sizes)
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            other = order[np.repeat(low[hit], sizes) + within]
            close = np.bitwise_count(prints[at] ^ self.prints[other]) <= RADIUS
            out.append((at[close], other[close]))
        return out

    def coverage(self, item: int, shingles: dict[tuple, list[int]]) -> float:
        """Share of the item's words on the best chain of shingles common to both, in the order of both."""
        words = self.items[item][1]
        pairs = sorted((d, -i) for s, at in self.places[item].items() if s in shingles for i in at for d in shingles[s])
        # Heaviest chain strictly rising in both places; ties in the document take the later item place first.
        ending = [0] * len(words)  # most words of a chain that ends at an item place
        most = [0] * (len(words) + 1)  # Fenwick maxima of the same
        for _, minus in pairs:
            at = -minus
            best, k = 0, at - SHINGLE + 1  # chains whose last shingle does not overlap
            while k > 0:
                best = max(best, most[k])
                k &= k - 1
            best += SHINGLE
            for step in range(1, min(SHINGLE, at + 1)):
                if ending[at - step]:
                    best = max(best, ending[at - step] + step)
            if best > ending[at]:
                ending[at], k = best, at + 1
                while k <= len(words):
                    most[k] = max(most[k], best)
                    k += k & -k
        return max(ending) / len(words)

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(place in texts, item, coverage) of every leak."""
        out: list[tuple[int, int, float]] = []
        batch: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            words = leak_words(text)
            if self.short and words:
                line = f" {' '.join(words)} "
                out += [(k, item, 1.0) for item, run in self.short if run in line]
            if len(words) >= WINDOW:
                batch.append((k, words))
                size += len(words)
            if size >= CHUNK_WORDS:
                out += self._verified(batch)
                batch, size = [], 0
        return out + self._verified(batch)

    def _verified(self, batch: list[tuple[int, list[str]]]) -> list[tuple[int, int, float]]:
        if not batch or not len(self.prints):
            return []
        if self.vocabulary.full():
            self.vocabulary = Words()
        flat = np.fromiter((x for _, words in batch for x in self.vocabulary.ids(words)), np.int64)
        ends = np.cumsum([len(words) for _, words in batch])
        prints = simhashes(flat, self.vocabulary.signs)
        candidates: dict[int, set[int]] = defaultdict(set)
        for at, other in self.near(prints):
            owner = np.searchsorted(ends, at, side="right")
            inside = at + WINDOW <= ends[owner]  # a window over the end of a document is none
            for d, f in set(zip(owner[inside].tolist(), other[inside].tolist(), strict=True)):
                candidates[d].update(self.owners[f])
        out = []
        for d, items in candidates.items():
            k, words = batch[d]
            shingles: dict[tuple, list[int]] = defaultdict(list)
            for i in range(len(words) - SHINGLE + 1):
                shingles[tuple(words[i : i + SHINGLE])].append(i)
            for item in items:
                share = self.coverage(item, shingles)
                if share >= COVER:
                    out.append((k, item, share))
        return out


_built: dict[str, Index] = {}


def _index(stamp: str, items: list[tuple]) -> Index:
    if stamp not in _built:
        _built.clear()
        _built[stamp] = Index(items)
    return _built[stamp]


def leaks(documents: DataFrame, held_out: DataFrame, key: str = "doc_id", text: str = "text", test_key: str = "test_id", test_text: str = "text") -> DataFrame:
    """key, test_key and coverage of every document row that holds at least COVER of a test item's words.

    The test items are the stated query set. They are broadcast in blocks of about BLOCK_ITEMS items and BLOCK_CHARS
    characters; the documents are read once per block and never shuffled.
    """
    spark = documents.sparkSession
    tests = held_out.select(test_key, test_text)
    size = tests.agg(F.count("*"), F.coalesce(F.sum(F.length(test_text)), F.lit(0))).first()
    blocks = max(size[0] // BLOCK_ITEMS, size[1] // BLOCK_CHARS) + 1
    kinds = dict(documents.dtypes)[key], dict(tests.dtypes)[test_key]
    rows = documents.select(key, text)
    parts = []
    for b in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64(test_key, test_text), F.lit(blocks)) == b)
        items = [tuple(r) for r in part.distinct().collect()]
        stamp = hashlib.blake2b(repr(sorted(map(repr, items))).encode()).hexdigest()
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared, stamp=stamp):
            index = _index(stamp, shared.value)
            for batch in batches:
                found = index.leaks(batch.column(1).to_pylist())
                best: dict[tuple, float] = {}
                for k, item, share in found:
                    pair = k, index.items[item][0]
                    best[pair] = max(share, best.get(pair, 0.0))
                at = pa.array([k for k, _ in best], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array([t for _, t in best], type=_ARROW[kinds[1]]), pa.array(list(best.values()), pa.float64())],
                    names=[key, test_key, "coverage"],
                )

        parts.append(rows.mapInArrow(run, f"{key} {kinds[0]}, {test_key} {kinds[1]}, coverage double"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
