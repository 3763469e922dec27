"""Encoding of a corpus with a public byte-level tokenizer.

Text is cut into words by the tokenizer's own pattern. A short word's bytes become parts with the rank of each
adjacent pair in one contiguous array; the array is scanned for its minimum, that boundary is deleted and the two
neighbouring ranks are refreshed, until no pair has a rank. Long words use a heap over linked parts instead, as
repeated scans would take quadratic time. Results of short words are kept per process.

Defined results: null and empty texts give an empty list; strings that look like special tokens are plain text.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; they are not part of this repository.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
# Fixed value: the pattern that cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 96  # bytes of a word up to which the rank array is scanned
KEPT_WORDS = 400_000
NONE = 1 << 60


class Encoder:
    """Ranks of one vocabulary with the words encoded so far."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._cut = regex.compile(PATTERN)
        self._kept: dict[str, tuple[int, ...]] = {}

    def short(self, word: bytes) -> list[int]:
        """Ids of a word by repeated scans of its array of adjacent ranks."""
        rank_of = self.ranks.get
        if (whole := rank_of(word)) is not None:
            return [whole]
        bounds = list(range(len(word) + 1))
        ranks = [rank_of(word[k : k + 2], NONE) for k in range(len(word) - 1)]
        while ranks and (least := min(ranks)) < NONE:
            at = ranks.index(least)
            del bounds[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(word[bounds[at] : bounds[at + 2]], NONE)
            if at:
                ranks[at - 1] = rank_of(word[bounds[at - 1] : bounds[at + 1]], NONE)
        return [self.ranks[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def long(self, word: bytes) -> list[int]:
        """The same ids in n log n: a heap of (rank, place) over linked parts; stale entries are skipped."""
        n, rank_of = len(word), self.ranks.get
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank_of(word[k : k + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n

        def pair(k: int) -> int | None:
            nxt = after[k]
            return rank_of(word[k : end[nxt]]) if nxt < n else None

        while heap:
            rank, k = heapq.heappop(heap)
            if not alive[k] or pair(k) != rank:
                continue
            gone = after[k]
            end[k], after[k], alive[gone] = end[gone], after[gone], 0
            if after[k] < n:
                before[after[k]] = k
            for place in (k, before[k]):
                if place >= 0 and (r := pair(place)) is not None:
                    heapq.heappush(heap, (r, place))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[word[k : end[k]]])
            k = after[k]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; empty for a null or empty one."""
        if not text:
            return []
        out: list[int] = []
        kept, take = self._kept, out.extend
        for word in self._cut.findall(text):
            ids = kept.get(word)
            if ids is None:
                data = word.encode("utf-8", "replace")
                if len(data) > SHORT:
                    take(self.long(data))
                    continue
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                ids = kept[word] = tuple(self.short(data))
            take(ids)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each process."""
    return Encoder(path)


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """key and ids (ARRAY<INT>): one row per row of documents."""
    path = os.path.join(folder or TOKENIZERS, vocabulary)
    rows = documents.select(key, text)
    kind = dict(rows.dtypes)[key]

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            values, offsets = [], [0]
            for t in batch.column(1).to_pylist():
                values += coder.encode(t)
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return rows.mapInArrow(run, f"{key} {kind}, ids array<int>")
