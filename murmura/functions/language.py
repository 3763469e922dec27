"""Language of a text by script and function words; rules only, all in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmura.functions import fixed_values as V
from murmura.functions.text import nfkc
from murmura.functions.times import bind

SCRIPTS = {
    "arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}&&\p{L}]",
    "devanagari": r"[\x{0900}-\x{097F}&&\p{L}]",
    "bengali": r"[\x{0980}-\x{09FF}&&\p{L}]",
    "latin": r"[A-Za-z\x{00C0}-\x{024F}&&\p{L}]",
}
_ALL_LETTERS = r"\p{L}"


def script_counts(text: Column) -> dict[str, Column]:
    """Number of letters per script, ``other`` last."""
    counts = {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in SCRIPTS.items()}
    known = counts["arabic"] + counts["devanagari"] + counts["bengali"] + counts["latin"]
    return counts | {"other": F.regexp_count(text, F.lit(_ALL_LETTERS)) - known}


def _first(text: Column, name: str) -> Column:
    pattern = SCRIPTS.get(name)
    if pattern is None:
        pattern = r"[\p{L}&&[^A-Za-z\x{00C0}-\x{024F}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{0900}-\x{09FF}]]"
    return F.length(F.regexp_extract(text, f"(?s)^(.*?){pattern}", 1))


def _one_of(known: list[str]) -> Callable[[Column], Column]:
    return lambda word: word.isin(known)


def detect_language(text: Column) -> Column:
    """en, ur-Latn, ur, ar, fa, hi, bn, tl or und.

    The script with most letters decides, the one seen first on a tie; under three letters the language is
    undetermined. Latin text goes by its function words: two hits make Roman Urdu or Tagalog, whichever has more
    (Roman Urdu on a tie).
    """
    # Each step is bound: the letters and words of a text are found once, not once per rule.
    return bind(nfkc(F.coalesce(text, F.lit(""))), _by_script)


def _by_script(normal: Column) -> Column:
    counts = script_counts(normal)
    ranked = F.array_max(F.array(*[F.struct(c.alias("n"), (-_first(normal, name)).alias("at"), F.lit(name).alias("script")) for name, c in counts.items()]))
    only_latin = F.struct(F.regexp_count(normal, F.lit(_ALL_LETTERS)).alias("n"), F.lit(0).alias("at"), F.lit("latin").alias("script"))
    return bind(F.when(normal.rlike(r"[^\x00-\x7F]"), ranked).otherwise(only_latin), lambda top: _of_script(normal, top))


def _of_script(normal: Column, top: Column) -> Column:
    script = top["script"]
    few = (top["n"] < 3) & (F.regexp_count(normal, F.lit(_ALL_LETTERS)) < 3)
    words = F.transform(F.regexp_extract_all(normal, F.lit(r"(?<!\p{L})[A-Za-z]+(?!\p{L})"), 0), lambda w: F.lower(w))
    return (
        F.when(few, "und")
        .when(script == "arabic", F.when(normal.rlike(f"[{V.URDU_LETTERS}]"), "ur").when(normal.rlike(f"[{V.PERSIAN_LETTERS}]"), "fa").otherwise("ar"))
        .when(script == "devanagari", "hi")
        .when(script == "bengali", "bn")
        .when(script == "latin", bind(bind(words, _hits), _latin))
        .otherwise("und")
    )


def _hits(words: Column) -> Column:
    count = {code: F.size(F.filter(words, _one_of(known))).alias(code) for code, known in (("en", V.ENGLISH), ("ru", V.ROMAN_URDU), ("tl", V.TAGALOG))}
    return F.struct(*count.values())


def _latin(hits: Column) -> Column:
    en, ru, tl = hits["en"], hits["ru"], hits["tl"]
    return (
        F.when((ru >= 2) | (tl >= 2), F.when(ru >= tl, "ur-Latn").otherwise("tl"))
        .when((en >= 1) & (en >= ru) & (en >= tl), "en")
        .when(ru >= 1, "ur-Latn")
        .when(tl >= 1, "tl")
        .otherwise("und")
    )
