"""Reading level of each English text.

Smoothed unigram language models, one per level, trained on the graded sample texts. A word unseen in a level
falls back to its class there (length and syllables), so that the level of new words follows their shape. A text is
read in stretches: a sentence is cut into equal stretches of at most ``STRETCH`` words, whatever its length, so
that text without marks follows the same rule. Each stretch takes the level of highest posterior likelihood; a
document takes the level that holds most of its words.

Words are read once: the same pass gives each stretch its language (problem 6's code lengths) and its level.

Defined results: null and wordless texts have no level; shares of a document's words sum to 1; ties go to the
plainer level.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.llm import language
from murmura.llm.visible import visible

LEVELS = ("basic", "middle", "advanced")
MIN_WORDS = 40
STRETCH = 12  # most words that are judged together
SAMPLE_LIMIT = 5000  # most graded sample texts that the fit reads
ENGLISH_SHARE = 0.5
SMOOTH = 0.35  # weight of the word class beside the seen words
CACHED_WORDS = 1 << 19  # words whose figures a process keeps

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+(?:[.,]\d+)*")
#: Words and what parts sentences: a mark before a blank, an empty line, a line that begins with a capital, a list or a quote.
_TOKEN = re.compile(rf"{_WORD.pattern}|[.!?][\"'”’)\]]*\s+|\n\s*\n|\n(?=[-*•>\dA-Z])")
_VOWELS = re.compile(r"[aeiouy]+")


def level_words(segment: str) -> list[str]:
    return _WORD.findall(segment.lower())


@lru_cache(maxsize=1 << 18)
def word_class(word: str) -> str:
    """Length and syllable class of a word; numbers have their own."""
    if word[0].isdigit():
        return "#"
    return f"{min(len(word), 14) // 2}/{min(len(_VOWELS.findall(word)), 5)}"


def sample_texts(samples: DataFrame, level: str = "reading_level", text: str = "text") -> list[tuple[str, str]]:
    """(level, text) of at most SAMPLE_LIMIT graded texts, those with the smallest hash."""
    known = samples.where(F.col(level).isin(list(LEVELS)) & F.col(text).isNotNull())
    return [tuple(r) for r in known.orderBy(F.xxhash64(text), text).limit(SAMPLE_LIMIT).select(level, text).collect()]


def fit(texts: list[tuple[str, str]]) -> tuple:
    """Frozen word counts of each level."""
    counts = {name: Counter() for name in LEVELS}
    for name, t in texts:
        counts[name].update(level_words(t))
    return tuple((name, tuple(sorted(counts[name].items()))) for name in LEVELS)


class Grades:
    """Log-likelihood of a word at each level, and its code length in each language, kept per word."""

    def __init__(self, frozen: tuple, model: language.Model) -> None:
        self._model = model
        self._seen = [dict(pairs) for _, pairs in frozen]
        self._total = [sum(s.values()) + 1 for s in self._seen]
        vocabulary = {w for s in self._seen for w in s}
        self._sizes = Counter(word_class(w) for w in vocabulary)
        self._classes = []
        for s in self._seen:
            by_class: Counter[str] = Counter()
            for w, n in s.items():
                by_class[word_class(w)] += n
            self._classes.append(by_class)
        self._forget()

    def _forget(self) -> None:
        self._row: dict[str, int] = {}
        self._table = np.zeros((1024, len(LEVELS) + len(language.LANGUAGES) + 1))
        self._size = 1  # row 0 stands for the end of a sentence

    def logs(self, word: str) -> list[float]:
        """Log-likelihood of a word at each level."""
        kind = word_class(word)
        out = []
        for seen, total, classes in zip(self._seen, self._total, self._classes, strict=True):
            shape = (classes.get(kind, 0) + 0.5) / (total + 0.5 * 84) / (self._sizes.get(kind, 0) + 1)
            out.append(math.log((1 - SMOOTH) * seen.get(word, 0) / total + SMOOTH * shape))
        return out

    def _added(self, token: str) -> int:
        if not token[0].isalnum():
            self._row[token] = 0
            return 0
        word = token.lower()
        if word != token and word in self._row:
            at = self._row[token] = self._row[word]
            return at
        at = self._row[token] = self._row[word] = self._size
        self._size += 1
        if at >= len(self._table):
            self._table = np.vstack([self._table, np.zeros_like(self._table)])
        self._table[at, : len(LEVELS)] = self.logs(word)
        if word[0].isalpha():  # numbers are of no language
            self._table[at, len(LEVELS) :] = self._model.word_costs(word)
        return at

    def graded(self, text: str | None) -> tuple[int, float, tuple[float, ...]]:
        """(words, share of words in English stretches, each level's share of the words)."""
        if len(self._row) >= CACHED_WORDS:  # between texts only: row numbers taken before would go astray
            self._forget()
        known, at = self._row.get, []
        for t in _TOKEN.findall(visible(text or "")):
            n = known(t)
            at.append(self._added(t) if n is None else n)
        rows = np.array(at, np.int64)
        words = rows > 0
        total = int(words.sum())
        if not total:
            return 0, 0.0, (0.0,) * len(LEVELS)
        sentence = np.cumsum(~words)[words]
        rows = rows[words]
        first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        lengths = np.diff(np.r_[first, total])
        pieces = -(-lengths // STRETCH)
        place = np.arange(total) - np.repeat(first, lengths)
        piece = place * np.repeat(pieces, lengths) // np.repeat(lengths, lengths)
        starts = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (sentence[1:] != sentence[:-1])])
        sums = np.add.reduceat(self._table[rows], starts, axis=0)
        sizes = np.diff(np.r_[starts, total])
        level = sums[:, : len(LEVELS)].argmax(axis=1)
        english = sums[:, len(LEVELS) :].argmin(axis=1) == language.LANGUAGES.index("en")
        return total, float(sizes[english].sum()) / total, tuple(float(sizes[level == k].sum()) / total for k in range(len(LEVELS)))


@lru_cache(maxsize=4)
def grades_of(frozen: tuple, languages: tuple) -> Grades:
    return Grades(frozen, language.model_of(languages))


LEVEL = T.StructType(
    [T.StructField("reading_level", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("english", T.DoubleType()), *[T.StructField(n, T.DoubleType()) for n in LEVELS]]
)


def levels_column(text: Column, frozen: tuple, languages: tuple) -> Column:
    """struct(reading_level, words, english, basic, middle, advanced) of a text column.

    english is the share of the words that stand in English stretches.
    """

    @F.pandas_udf(LEVEL)
    def run(values: pd.Series) -> pd.DataFrame:
        grades = grades_of(frozen, languages)
        codes, texts = pd.factorize(values)
        each = []
        for t in [*texts, None]:  # the last stands for null
            n, english, shares = grades.graded(t)
            each.append((LEVELS[max(range(len(LEVELS)), key=shares.__getitem__)] if n else None, n, english, *shares))
        return pd.DataFrame([each[k] for k in codes], columns=LEVEL.names)

    return run(text)


def _may_be_long(text: Column) -> Column:
    """False only for an ASCII text of fewer than MIN_WORDS runs of letters and digits: it has no more words."""
    return text.rlike(r"[^\x00-\x7F]") | (F.regexp_count(text, F.lit("[A-Za-z]+|[0-9]+")) >= MIN_WORDS)


def english_levels(documents: DataFrame, samples: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key with level, words and shares of each text of MIN_WORDS words or more that is mostly English.

    The languages are those of problem 6, fitted on the documents' labels; the graded samples are English.
    """
    graded = sample_texts(samples)
    languages = language.fit(documents, text=text, label=label, key=key, known={"en": [t for _, t in graded]})
    rows = documents.select(key, text).where(_may_be_long(F.col(text)))
    rows = rows.select(key, levels_column(F.col(text), fit(graded), languages).alias("g")).select(key, "g.*")
    return rows.where((F.col("words") >= MIN_WORDS) & (F.col("english") > ENGLISH_SHARE) & F.col("reading_level").isNotNull())


def source_profile(documents: DataFrame, samples: DataFrame, source: str = "source", label: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """source with its number of graded texts and the share of each level; a null source counts as one source."""
    levels = english_levels(documents.select(F.struct(key, source).alias("_k"), label, text), samples, label, "_k", text)
    shares = [F.avg((F.col("reading_level") == n).cast("double")).alias(n) for n in LEVELS]
    return levels.groupBy(F.col(f"_k.{source}").alias(source)).agg(F.count("*").alias("documents"), *shares)
