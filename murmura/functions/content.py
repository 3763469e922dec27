"""Content type of a post by scored cues, with its reason; every rule is a column expression."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmura.functions import fixed_values as V
from murmura.functions.text import letters, nfkc
from murmura.functions.times import bind

#: Order in which types win a tie.
TIE_ORDER = ("job", "giveaway", "spam", "promotion")


def rules_version() -> str:
    """Changes whenever a cue, a pattern or a threshold changes; items are classified anew then."""
    stated = repr((V.CUES, V.NAMED_CUES, V.SPECIFICATION_LINE, V.OPINION, V.TYPE_THRESHOLD, V.OPINION_POINTS, TIE_ORDER))
    return hashlib.sha1(stated.encode()).hexdigest()[:10]


def java(pattern: str) -> str:
    """A cue pattern for lower-case text with plain blanks: only word characters need Unicode there."""
    return pattern.replace(r"\w", r"[\p{L}\p{N}_]")


def cue_text(text: Column, image_text: Column) -> tuple[Column, Column]:
    """(lower-case text with its lines, the same on one line with plain hyphens)."""
    raw = F.lower(nfkc(F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.coalesce(image_text, F.lit("")))))
    hay = F.regexp_replace(raw, r"(?U)(?<=\w)\+(?=\w)", " ")
    hay = F.regexp_replace(hay, r"[\x{2010}-\x{2015}]", "-")
    return raw, F.regexp_replace(hay, r"(?U)\s+", " ")


def _found(hay: Column, pattern: str, most: int) -> Column:
    every = F.regexp_extract_all(hay, F.lit(java(pattern)), 0)
    return F.slice(F.array_distinct(F.transform(every, lambda x: F.trim(x))), 1, most)


def cues(raw: Column, hay: Column, author_name: Column, keywords: Column) -> dict[str, Column]:
    """Array of struct(cue, points) per type, for the texts of ``cue_text``."""
    out: dict[str, Column] = {}
    for name, rules in V.CUES.items():
        parts = [F.transform(_found(hay, p, most), _worth(points)) for p, points, most in rules]
        if name == "promotion":
            parts += [_when(hay.rlike(java(p)), F.lit(label), points) for label, p, points in V.NAMED_CUES]
            parts.append(_when(F.regexp_count(raw, F.lit(V.SPECIFICATION_LINE)) >= 4, F.lit("specification sheet"), 2))
            parts.append(_when(F.length(hay) - F.length(F.replace(hay, F.lit("#"), F.lit(""))) >= 5, F.lit("many hashtags"), 1))
            author = letters(F.coalesce(author_name, F.lit("")))
            own = F.exists(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: (F.length(letters(k)) >= 3) & F.contains(author, letters(k)))
            parts.append(_when((author != "") & own, F.concat(F.lit("posted by the brand's own page ("), author_name, F.lit(")")), 3))
        every = F.concat(*parts)
        if name != "promotion":  # mostly none of these is there; one search tells
            every = F.when(hay.rlike("|".join(f"(?:{java(p)})" for p, _, _ in rules)), every).otherwise(_none())
        out[name] = every
    return out


def _none() -> Column:
    return F.slice(F.array(F.struct(F.lit("").alias("cue"), F.lit(0).alias("points"))), 1, 0)


def _worth(points: int) -> Callable[[Column], Column]:
    return lambda cue: F.struct(cue.alias("cue"), F.lit(points).alias("points"))


def _when(condition: Column, label: Column, points: int) -> Column:
    one = F.array(F.struct(label.alias("cue"), F.lit(points).alias("points")))
    return F.when(condition, one).otherwise(F.slice(one, 1, 0))


def scored(found: Column, opinion: Column) -> Column:
    """struct(content_type, content_reason): the type with most points at the threshold or above, or nulls.

    found holds the cues of each type in a struct.
    """
    less = F.when(opinion, V.OPINION_POINTS).otherwise(0)
    ranked = []
    for rank, name in enumerate(TIE_ORDER):
        points = F.aggregate(found[name], F.lit(0), lambda s, c: s + c["points"]) - less
        reason = F.substring(F.array_join(F.array_distinct(F.transform(found[name], lambda c: c["cue"])), ", "), 1, 200)
        ranked.append(F.when(points >= V.TYPE_THRESHOLD, F.struct(points.alias("points"), F.lit(-rank).alias("rank"), F.lit(name).alias("content_type"), reason.alias("content_reason"))))
    best = F.array_max(F.array_compact(F.array(*ranked)))
    return F.struct(best["content_type"].alias("content_type"), best["content_reason"].alias("content_reason"))


def classify(text: Column, image_text: Column, author_name: Column, keywords: Column, kind: Column) -> Column:
    """struct(content_type, content_reason) of a post; nulls for an ordinary or blank one.

    A listing is one by its kind. Somebody's own experience or question takes OPINION_POINTS from every type.
    """
    raw, hay = cue_text(text, image_text)
    listing = F.struct(F.lit("marketplace").alias("content_type"), F.lit(V.MARKETPLACE_REASON).alias("content_reason"))
    nothing = F.struct(F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("string").alias("content_reason"))

    def judged(t: Column) -> Column:
        found = F.struct(*[c.alias(name) for name, c in cues(t["raw"], t["hay"], author_name, keywords).items()])
        return F.when(F.trim(t["hay"]) == "", nothing).otherwise(bind(found, lambda f: scored(f, t["hay"].rlike(java(V.OPINION)))))

    # Bound once: the texts would else be derived anew for every rule.
    return F.when(kind == "marketplace", listing).otherwise(bind(F.struct(raw.alias("raw"), hay.alias("hay")), judged))
