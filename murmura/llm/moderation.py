"""Abusive, hateful and sexual content: a score for every text, rates per source.

A noisy channel restores disguised words first: the likeliest word through the lattice of letters that each
character may stand for (leetspeak, masked letters, spaced or dotted letters, repetition) under a character language
model of general and offensive words in the scripts of the data. The search is exact Viterbi decoding, best paths
first. What comes out replaces the token if it is as plausible as words are, be it offensive or not.

The restored text is then scored sentence by sentence: word classes and how they stand to each other (an insult
aimed at somebody, harm done to a group) are the features of a logistic model per category and one of whether any
holds, fitted with a smoothing penalty on the labelled samples (at most ``SAMPLE_LIMIT``) and on general training
sentences. The last is a text's score; its category is the likeliest one where the score reaches ``THRESHOLD``.

Defined results: null, empty and wordless texts score 0 in every category, as do texts without any word of the core
classes; a text scores as its worst sentence.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.llm.language import FREQUENT, SEEDS
from murmura.llm.moderation_words import CLASSES, TRAINING
from murmura.llm.visible import visible

CATEGORIES = ("abuse", "hate", "sexual")
THRESHOLD = 0.5
SAMPLE_LIMIT = 5000  # most labelled samples that the fit reads
SMOOTHING = 0.01  # weight of the squared coefficients in the fit
ROUNDS = 60  # Newton steps of the fit at most

# The channel: what a character of a disguised word may stand for.
LEET = {
    "@": "a", "4": "a", "$": "s", "5": "s", "1": "il", "!": "il", "|": "il", "3": "e", "€": "e", "0": "o", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z", "(": "c", "¡": "i",
}
MASKS = "*#%_"
SILENT = ".-'’"  # marks between letters stand for nothing
LEET_BITS, OTHER_BITS, MASK_BITS, NO_LETTER_BITS, REPEAT_BITS = 0.5, 9.0, 1.0, 4.0, 1.0
#: How many times likelier an offensive word is than a common one where somebody disguises a word.
DISGUISED = 12
ORDER = 7  # letters of context
PLAUSIBLE = 5.0  # most bits a letter of a restored word may cost on average

_MARKS = "ً-ٰٕऀ-ःऺ-ॏ"
_LETTER = rf"[^\W\d_][{_MARKS}]*"
_UNIT = rf"(?:{_LETTER}|[@$*!])"
_SUSPECT = re.compile(rf"[@$*|€%+]|[^\W\d_][0-9#!]+[^\W\d_]|(?<![\w-])[0134578][^\W\d_]{{3}}|[^\W\d_]{{3}}[0134578](?!\w)|([^\W\d]|[{_MARKS}])\1\1|(?<!\w){_LETTER}(?:[.\-_ *]{_LETTER}(?!\w)){{2}}")
_SPACED = re.compile(rf"(?<![\w@$*]){_UNIT}([.\-_ *]){_UNIT}(?:\1{_UNIT})++(?![\w@$*])")
_TOKEN = re.compile(r"[^\s,;:?\"“”()\[\]<>/]+")
_CODE = re.compile(r"\d{3}|^\d\d|\d\d$|@[\w.-]+\.\w|^\d+\w$|\w-\d|^#|\d,\d")  # model codes, quantities, tags and addresses are no disguise
_SIGN = re.compile(r"[^\W\d_].*[@$*!|0-9+€#%]\S|[@$*!|0-9+€%].*[^\W\d_]|[^\W\d_]{2}[@$*|0-9€%]$")
_THRICE = re.compile(rf"([^\W\d_]|[{_MARKS}])\1\1")
_STRETCH = re.compile(rf"([^\W\d_]|[{_MARKS}])(?:[.\-']?\1){{3,}}|([.\-'])[.\-']+")
_EDGES = ".,;:?'\"-…।۔؟،"
_PART = re.compile(rf"[^\W_]+(?:[{_MARKS}]+[^\W_]*)*(?:['’][^\W_]+)?")
_SENTENCE = re.compile(r"(?<=[.!?؟।۔…])\s+|\n+")


def plain(text: str) -> str:
    """Lower case without accents and vowel signs, in the visible form."""
    low = visible(text).lower()
    if low.isascii():
        return low
    low = "".join(c for c in unicodedata.normalize("NFD", low) if not "̀" <= c <= "ͯ" and not "ً" <= c <= "ْ")
    return unicodedata.normalize("NFC", low)


# Word classes


@lru_cache(maxsize=1)
def _lexicon() -> tuple[dict[str, int], dict[str, int], dict[str, list[tuple[tuple[str, ...], int]]]]:
    """Bits of the classes of whole words, of stems, and of phrases under their first word."""
    exact: dict[str, int] = defaultdict(int)
    stems: dict[str, int] = defaultdict(int)
    phrases: dict[str, dict[tuple[str, ...], int]] = defaultdict(lambda: defaultdict(int))
    for k, entries in enumerate(CLASSES.values()):
        for entry in plain(entries).split():
            first, *rest = entry.split("_")
            if rest:
                phrases[first][tuple(p.rstrip("*") for p in rest)] |= 1 << k
            elif entry.endswith("*"):
                stems[entry.rstrip("*")] |= 1 << k
            else:
                exact[entry] |= 1 << k
    return dict(exact), dict(stems), {first: list(p.items()) for first, p in phrases.items()}


BIT = {name: 1 << k for k, name in enumerate(CLASSES)}
CORE = BIT["insult"] | BIT["profane"] | BIT["harm"] | BIT["wish"] | BIT["beast"] | BIT["out"] | BIT["sex"] | BIT["genital"] | BIT["nude"] | BIT["lust"] | BIT["heat"] | BIT["mild"] | BIT["ruin"]


@lru_cache(maxsize=1 << 17)
def word_classes(word: str) -> int:
    """Bits of the classes of a word; the suffixed forms of a listed stem belong to it."""
    exact, stems, _ = _lexicon()
    bits = exact.get(word, 0)
    if not bits and word.endswith("s") and len(word) > 3:
        bits = exact.get(word[:-1], 0)
    for k in range(3, len(word) + 1):
        bits |= stems.get(word[:k], 0)
        if k > 24:  # no stem is longer
            break
    return bits


# The noisy channel


class Letters:
    """A character language model: contexts of up to ORDER letters with escape, word start and end marked."""

    def __init__(self, counts: dict[str, float]) -> None:
        tree: dict[str, dict[str, float]] = defaultdict(dict)
        for word, n in counts.items():
            marked = f"^{word}$"
            for k in range(1, len(marked)):
                for order in range(min(k, ORDER) + 1):
                    nexts = tree[marked[k - order : k]]
                    nexts[marked[k]] = nexts.get(marked[k], 0) + n
        self._tree = {c: (n, sum(n.values()), len(n)) for c, n in tree.items()}
        self._known: dict[tuple[str, str], float] = {}

    def bits(self, context: str, letter: str) -> float:
        known = self._known.get((context, letter))
        if known is None:
            if len(self._known) > 1 << 20:
                self._known.clear()
            known = self._known[context, letter] = self._bits(context, letter)
        return known

    def _bits(self, context: str, letter: str) -> float:
        p = 1.0
        for order in range(min(len(context), ORDER), -1, -1):
            known = self._tree.get(context[len(context) - order :])
            if known is None:
                continue
            nexts, seen, kinds = known
            if n := nexts.get(letter):
                return -math.log2(p * n / (seen + kinds))
            p *= kinds / (seen + kinds)
        return -math.log2(p / 64)

    def state(self, done: str) -> str:
        """The longest known context that done ends with; what follows depends on nothing else."""
        return next(c for k in range(max(len(done) - ORDER, 0), len(done) + 1) if (c := done[k:]) in self._tree)


_ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "arabic": "".join(chr(c) for c in range(0x620, 0x6D4) if chr(c).isalpha()),
    "devanagari": "".join(map(chr, [*range(0x901, 0x94E), *range(0x958, 0x960)])),
}


def _alphabet(token: str) -> str:
    """The letters that a mask in the token may hide: those of its script."""
    if any("ऀ" <= c <= "ॿ" for c in token):
        return _ALPHABETS["devanagari"]
    if any("؀" <= c <= "ۿ" for c in token):
        return _ALPHABETS["arabic"]
    return _ALPHABETS["latin"]


@lru_cache(maxsize=1)
def letters() -> tuple[Letters, int]:
    """The language model of disguised words, and the length of the longest word in it."""
    counts: dict[str, float] = defaultdict(float)
    for code in SEEDS:
        for w in _PART.findall(plain(f"{SEEDS[code]} {FREQUENT[code]}")):
            counts[w] += 1
    for name, entries in CLASSES.items():
        weight = DISGUISED if name in ("insult", "profane", "sex", "genital", "nude") else 1
        for entry in plain(entries).split():
            for w in entry.rstrip("*").split("_"):
                counts[w] += weight
                if entry.endswith("*") or (w.isascii() and not w.endswith("s")):
                    counts[f"{w}s"] += weight / 3
    return Letters(counts), max(map(len, counts))


def _readings(char: str, alphabet: str) -> list[tuple[str, float]]:
    if char in LEET:
        return [(x, LEET_BITS if x in LEET[char] else OTHER_BITS) for x in alphabet]  # it may also only hide a letter
    if char in MASKS:
        return [(x, MASK_BITS) for x in alphabet] + [("", NO_LETTER_BITS)]
    return [(char, 0.0)] if char.isalpha() or unicodedata.category(char).startswith("M") else []


def decoded(core: str) -> tuple[float, str]:
    """(bits, word) of the best path through the lattice of a token; (inf, "") where there is none.

    Viterbi decoding with the best partial path taken up first: the first complete one is the best of all.
    """
    model, _ = letters()
    chars = [c for c in core if c not in SILENT]
    lattice = [_readings(c, _alphabet(core)) for c in chars]
    heap = [(0.0, 0, "^", "", "")]
    done: set[tuple[int, str, str]] = set()
    while heap:
        bits, at, state, last, word = heapq.heappop(heap)
        if (at, state, last) in done:
            continue
        done.add((at, state, last))
        if at > len(chars):
            return bits, word
        if at == len(chars):
            heapq.heappush(heap, (bits + model.bits(state, "$"), at + 1, "", "", word))
            continue
        char = chars[at]
        if char == last and char not in LEET and char not in MASKS:  # a repetition may stand for one letter
            heapq.heappush(heap, (bits + REPEAT_BITS, at + 1, state, last, word))
        for letter, cost in lattice[at]:
            if letter:
                heapq.heappush(heap, (bits + cost + model.bits(state, letter), at + 1, model.state(state + letter), char, word + letter))
            else:
                heapq.heappush(heap, (bits + cost, at + 1, state, last, word))
    return math.inf, ""


def _unstretched(token: str) -> str:
    """Letter runs cut to three, which all readings by words outlast at the same cost; runs of marks to one."""
    return _STRETCH.sub(lambda m: m[1] * 3 if m[1] else m[2], token)


@lru_cache(maxsize=200_000)
def restore(token: str) -> str:
    """The likeliest word behind a disguised lower-case token; the token itself if no plausible word is.

    A token without any letter, or with more masks than the longest known word has letters, hides nothing known.
    """
    core = _unstretched(token.strip(_EDGES))
    core = core.rstrip("!") if not any(c in core[:-1] for c in "!@$*|") else core
    read = [c for c in core if c.isalpha() or c in LEET]
    if len(core) < 3 or not any(map(str.isalpha, core)) or len(core) - len(read) > letters()[1]:
        return token
    bits, word = decoded(core)
    if not word or bits > PLAUSIBLE * len(core):
        return token
    return word


@lru_cache(maxsize=1 << 16)
def _disguised(token: str) -> bool:
    token = _unstretched(token.strip(_EDGES))
    if len(token) < 3 or token.isalpha() and _THRICE.search(token) is None:
        return False
    return _CODE.search(token) is None and (_SIGN.search(token) is not None or _THRICE.search(token) is not None)


def _joined(run: str, mark: str) -> str:
    word = run.replace(mark, "")
    made = restore(word) if _disguised(word) or any(c in "@$*!" for c in word) else word
    if len(made) < 3:
        return run
    bits, best = decoded(made)
    return best if word_classes(best) & CORE or bits <= PLAUSIBLE * len(best) - 4 else run


def restored(low: str) -> str:
    """plain text with disguised words restored."""
    if not _SUSPECT.search(low):
        return low
    low = _SPACED.sub(lambda m: _joined(m[0], m[1]), low)
    return _TOKEN.sub(lambda m: restore(m[0]) + m[0][len(m[0].rstrip(_EDGES + "!")) :] if _disguised(m[0]) else m[0], low)


# Scores


FEATURES = (
    "bias", "insult", "insult_you", "insult_called", "insult_is", "mild_you", "mild_many", "profane", "profane_you", "harm_you", "harm_body", "wish", "wish_you", "you", "beast_is", "beast_group", "beast_ruin",
    "out_group", "out_beast", "harm_group", "harm_out", "people", "beast_adjective", "people_ruin", "mild_called", "insult_mild", "insult_out", "sex", "genital", "genital_you", "nude", "nude_you", "nude_pics", "lust", "lust_lust", "lust_you", "lust_pics", "heat_heat", "heat_you", "heat_sex", "sex_pics", "plain", "of_thing",
)


def _near(tokens: list[int], a: int, b: int, before: int, after: int) -> bool:
    """Whether a word of class b stands at most before words before or after words behind one of class a."""
    return any(bits & a and any(x & b for x in [*tokens[max(0, k - before) : k], *tokens[k + 1 : k + 1 + after]]) for k, bits in enumerate(tokens))


def sentence_features(words: list[str]) -> list[float] | None:
    """The features of a sentence; None where it has no word of a core class."""
    phrases = _lexicon()[2]
    tokens = [word_classes(w) for w in words]
    for k, w in enumerate(words):
        for rest, bits in phrases.get(w, ()):
            if tuple(words[k + 1 : k + 1 + len(rest)]) == rest:
                tokens[k] |= bits
    every = 0
    for bits in tokens:
        every |= bits
    if not every & CORE:
        return None
    b = BIT
    of_thing = 0
    named = b["insult"] | b["mild"] | b["profane"]
    for k, bits in enumerate(tokens):
        follows = k + 1 < len(tokens) and tokens[k + 1] & b["thing"] and not tokens[k + 1] & b["insult"]
        if bits & named and (follows or any(tokens[n] & b["is"] and tokens[n - 1] & b["thing"] for n in range(max(k - 2, 1), k))):
            tokens[k] &= ~named  # said of a thing
            of_thing = 1
    every = 0
    for bits in tokens:
        every |= bits
    has = {name: bool(every & bit) for name, bit in b.items()}
    group = b["people"] | b["them"]
    insults = sum(bool(x & b["insult"]) for x in tokens)
    called = insults and not has["thing"] and (bool((tokens[0] | tokens[-1]) & b["insult"]) or len(tokens) <= 4)
    values = (
        1, has["insult"], has["insult"] and has["you"], called, _near(tokens, b["insult"], b["is"], 3, 0), has["mild"] and has["you"], sum(bool(x & (b["mild"] | b["insult"])) for x in tokens) > 1 and has["you"], has["profane"],
        has["profane"] and _near(tokens, b["profane"], b["you"], 3, 3), _near(tokens, b["harm"], b["you"], 3, 3) and not has["plain"], _near(tokens, b["harm"], b["body"], 4, 4) and has["you"], has["wish"], has["wish"] and has["you"], has["you"],
        _near(tokens, b["beast"], b["is"], 3, 1) and bool(every & group), has["beast"] and has["people"], has["beast"] and has["ruin"] and bool(every & group),
        has["out"] and has["people"], has["out"] and has["beast"] and bool(every & group), _near(tokens, b["harm"], group, 4, 5), has["harm"] and has["out"] and bool(every & group), has["people"],
        _near(tokens, b["beast"], b["people"], 0, 2), has["people"] and has["ruin"], bool((tokens[0] | tokens[-1]) & b["mild"]) and not has["thing"], has["insult"] and any(x & b["mild"] and not x & b["insult"] for x in tokens),
        has["insult"] and has["out"] and bool(every & group), has["sex"], has["genital"], has["genital"] and has["you"], has["nude"], has["nude"] and has["you"], has["nude"] and has["pics"],
        has["lust"], sum(bool(x & b["lust"]) for x in tokens) > 1, has["lust"] and has["you"], has["lust"] and has["pics"], sum(bool(x & b["heat"]) for x in tokens) > 1, has["heat"] and has["you"], has["heat"] and (has["lust"] or has["nude"] or has["sex"] or has["genital"]), has["sex"] and has["pics"], has["plain"], of_thing and not has["insult"] and not has["wish"],
    )
    return list(map(float, values))


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic model with a squared penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * SMOOTHING * len(x) / 10
    ridge[0, 0] = 1e-6
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return w


def fit(samples: DataFrame | None = None, category: str = "category", text: str = "text") -> tuple[tuple[float, ...], ...]:
    """Coefficients per category, and of any category last, from the training sentences and at most SAMPLE_LIMIT labelled samples."""
    rows = [tuple(p.strip() for p in line.split("|", 1)) for line in TRAINING.strip().splitlines()]
    if samples is not None:
        known = samples.where(F.col(category).isin([*CATEGORIES, "none"]) & F.col(text).isNotNull())
        rows += [tuple(r) for r in known.orderBy(F.xxhash64(text), text).limit(SAMPLE_LIMIT).select(category, text).collect()]
    x, labels = [], []
    for label, sentence in rows:
        for f in filter(None, map(sentence_features, sentences(restored(plain(sentence))))):
            x.append(f)
            labels.append(label)
    matrix = np.array(x)
    truths = [np.array([float(label == c) for label in labels]) for c in CATEGORIES]
    return tuple(tuple(map(float, _fitted(matrix, y))) for y in [*truths, sum(truths)])


def sentences(low: str) -> list[list[str]]:
    return [words for s in _SENTENCE.split(low) if (words := _PART.findall(s))]


NOTHING = (0.0,) * (len(CATEGORIES) + 1)


def scores(text: str | None, weights: tuple[tuple[float, ...], ...]) -> tuple[float, ...]:
    """(abuse, hate, sexual, any) of a text: the greatest over its sentences."""
    if not text:
        return NOTHING
    low = restored(plain(text))
    phrases = _lexicon()[2]
    if not any(word_classes(w) & CORE or w in phrases for w in set(_PART.findall(low))):
        return NOTHING
    each = [f for words in sentences(low) if (f := sentence_features(words)) is not None]
    if not each:
        return NOTHING
    p = 1 / (1 + np.exp(-np.array(each) @ np.array(weights).T))
    return tuple(float(v) for v in p.max(axis=0))


def category(found: tuple[float, ...]) -> str | None:
    """The likeliest category of scores that reach THRESHOLD."""
    *own, top = found
    return CATEGORIES[own.index(max(own))] if top >= THRESHOLD else None


SCORES = T.StructType([T.StructField(c, T.DoubleType()) for c in CATEGORIES] + [T.StructField("score", T.DoubleType()), T.StructField("category", T.StringType())])


def scores_column(text: Column, weights: tuple[tuple[float, ...], ...]) -> Column:
    """struct(abuse, hate, sexual, score, category) of a text column; category is null below THRESHOLD."""

    @F.pandas_udf(SCORES)
    def run(values: pd.Series) -> pd.DataFrame:
        codes, texts = pd.factorize(values)
        each = []
        for t in [*texts, None]:  # the last stands for null
            each.append((*(s := scores(t, weights)), category(s)))
        return pd.DataFrame([each[k] for k in codes], columns=SCORES.names)

    return run(text)


def scored(rows: DataFrame, weights: tuple[tuple[float, ...], ...], key: str = "item_id", text: str = "text") -> DataFrame:
    """key with its scores; one row per input row."""
    return rows.select(key, scores_column(F.col(text), weights).alias("s")).select(key, "s.*")


def rates(rows: DataFrame, weights: tuple[tuple[float, ...], ...], source: str = "group_name", text: str = "text") -> DataFrame:
    """source, texts, flagged and rate per category: null sources count together as null."""
    s = rows.select(source, scores_column(F.col(text), weights).alias("s")).select(source, "s.*")
    flagged = [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    out = s.groupBy(source).agg(F.count("*").alias("texts"), F.count_if(F.col("score") >= THRESHOLD).alias("flagged"), *flagged)
    return out.withColumn("rate", F.col("flagged") / F.col("texts"))
