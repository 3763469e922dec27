"""Visually identical text with different characters: one consistent form per string.

``canonical`` is the form for comparison: compatibility normalisation, composed, full case folding, mapped
white space, default-ignorable characters removed, look-alike letters mapped. ``visible`` keeps what a reader
can tell apart (case, line breaks, superscripts) and unifies only what looks the same.

Defined results: null stays null, empty stays empty; a text of ignorable characters only becomes empty; joiners
inside emoji sequences and between letters of joining scripts are visible and stay.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.session import cut

# Letters that look like a Latin letter, in the order of the Latin letters beside them.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝӏ", "ABESIJKMHOPCTYXaeopcyxsijhdqwl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj")
LOOKALIKE = str.maketrans(CYRILLIC[0] + GREEK[0], CYRILLIC[1] + GREEK[1])

_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_CONFUSED = regex.compile(rf"[\p{{Latin}}\p{{M}}\p{{Nd}}{CYRILLIC[0]}{GREEK[0]}]+")
# Joiners that show: inside emoji sequences and between letters of joining scripts. They are the first group.
_IGNORABLE = regex.compile(
    "((?<=\\p{Extended_Pictographic}[\ufe0f\U0001f3fb-\U0001f3ff]?)\u200d(?=\\p{Extended_Pictographic})"
    "|(?<=[\\p{Arabic}\\p{Devanagari}\\p{Bengali}])[\u200c\u200d](?=[\\p{Arabic}\\p{Devanagari}\\p{Bengali}]))"
    "|[\\p{Default_Ignorable_Code_Point}\ufeff]"
)
_BLANK = regex.compile(r"[\p{Zs}\t]")
_SPACE = regex.compile(r"\s+")
# Decompositions that change the look of a character.
_LOOKS_OTHER = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")


@lru_cache(maxsize=65536)
def _plain(char: str) -> str:
    form = unicodedata.decomposition(char)
    return char if form.startswith(_LOOKS_OTHER) else unicodedata.normalize("NFKC", char)


def _latin(match: regex.Match) -> str:
    word = match[0]
    return word.translate(LOOKALIKE) if _FOREIGN.search(word) and _CONFUSED.fullmatch(word) else word


def visible(text: str) -> str:
    """What a reader sees of text, one spelling for all spellings that look the same."""
    if text.isascii():
        return text.replace("\t", " ")
    text = _IGNORABLE.sub(lambda m: m[1] or "", text)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFC", "".join([c if c.isascii() else _plain(c) for c in text]))
    text = _BLANK.sub(" ", text)
    if _FOREIGN.search(text):
        text = unicodedata.normalize("NFC", _WORD.sub(_latin, text))
    return text


def canonical(text: str) -> str:
    """The form for comparison: equal for texts that a reader takes for the same, whatever their case and spacing."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", visible(text))
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", text.casefold())).strip()


def _each(values: pd.Series, function) -> pd.Series:
    """function of each distinct value, spread over the rows; null stays null."""
    codes, distinct = pd.factorize(values)
    made = np.array([*map(function, distinct), None], dtype=object)  # a null's code is -1
    return pd.Series(made[codes], dtype=object)


@F.pandas_udf(T.StringType())
def _visible(values: pd.Series) -> pd.Series:
    return _each(values, visible)


@F.pandas_udf(T.StringType())
def _canonical(values: pd.Series) -> pd.Series:
    return _each(values, canonical)


def _hashes(*texts: str) -> tuple[int, ...]:
    return tuple(h - (1 << 64) if h >= 1 << 63 else h for h in (xxhash.xxh64_intdigest(t.encode(), seed=42) for t in texts))  # as Spark's xxhash64


HASHES = T.StructType([T.StructField(n, T.LongType()) for n in ("form", "look", "look_too")])


@F.pandas_udf(HASHES)
def _form_hashes(values: pd.Series) -> pd.DataFrame:
    codes, distinct = pd.factorize(values)
    made = [_hashes(canonical(v), seen := visible(v), f"~{seen}") for v in distinct]
    made.append((0, 0, 0))  # for null; a null among them would turn the hashes into floats
    return pd.DataFrame([made[k] for k in codes], columns=HASHES.names)


def _non_ascii(value: Column) -> Column:
    return value.rlike(r"[^\x00-\x7F]")


def _plain_canonical(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def visible_column(value: Column) -> Column:
    """``visible`` of a column; ASCII rows never leave the JVM."""
    return F.when(_non_ascii(value), _visible(F.when(_non_ascii(value), value))).otherwise(F.translate(value, "\t", " "))


def canonical_column(value: Column) -> Column:
    """``canonical`` of a column; ASCII rows never leave the JVM."""
    return F.when(_non_ascii(value), _canonical(F.when(_non_ascii(value), value))).otherwise(_plain_canonical(value))


GROUP = ["field_name", "form", "look", "look_too"]


def forms(items: DataFrame, fields: tuple[str, ...] = ("text", "author_name")) -> DataFrame:
    """field_name, form, look, look_too, stored, stored_too, item_id: hashes of every value that is not blank.

    form is that of the canonical form, look of the visible one, stored of the value itself (two hashes each where
    equality is decided by them). Forms are made once per distinct value of an Arrow batch, ASCII ones in the JVM.
    """
    values = items.select("item_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("v"))
    values = values.select("item_id", "v.field_name", "v.value").where(F.trim("value") != "")
    value = F.col("value")
    shown = F.translate(value, "\t", " ")
    plain = F.struct(F.xxhash64(_plain_canonical(value)).alias("form"), F.xxhash64(shown).alias("look"), F.xxhash64(F.concat(F.lit("~"), shown)).alias("look_too"))
    hashes = F.when(_non_ascii(value), _form_hashes(F.when(_non_ascii(value), value))).otherwise(plain)
    rows = values.select("item_id", "field_name", hashes.alias("h"), F.xxhash64(value).alias("stored"), F.xxhash64(F.concat(F.lit("~"), value)).alias("stored_too"))
    return rows.select(*GROUP[:1], "h.*", "stored", "stored_too", "item_id")


def _spellings(rows: DataFrame) -> DataFrame:
    """GROUP with its rows and spellings, where there are several spellings; nothing is paired for the others."""
    variants = rows.groupBy(*GROUP, "stored", "stored_too").agg(F.count("*").alias("n"))
    return variants.groupBy(*GROUP).agg(F.sum("n").alias("rows"), F.count("*").alias("kinds")).where("kinds > 1")


def same_looking_classes(items: DataFrame, fields: tuple[str, ...] = ("text", "author_name")) -> DataFrame:
    """field_name, item_id, class, links: each row's field with the class of those that look the same.

    links counts the rows of the class that are stored with other characters; 0 where there are none. Rows are not
    expanded into pairs. Null and blank values have no class and no row.
    """
    rows = cut(forms(items, fields))
    several = _spellings(rows).select(*GROUP, "rows")
    own = rows.join(several, GROUP, "left_semi").groupBy(*GROUP, "stored", "stored_too").agg(F.count("*").alias("same"))
    counted = own.join(several, GROUP).select(*GROUP, "stored", "stored_too", (F.col("rows") - F.col("same")).alias("links"))
    out = rows.join(counted, [*GROUP, "stored", "stored_too"], "left")
    return out.select("field_name", "item_id", F.col("look").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def same_looking_pairs(items: DataFrame, fields: tuple[str, ...] = ("text", "author_name"), rows_per_salt: int = 20000) -> DataFrame:
    """field_name, item_a, item_b: rows whose field looks the same but is stored differently.

    Candidates share the canonical form; an equal visible form confirms them. The tables are read and the forms made
    once; only hashes are kept and shuffled. A group in which all rows are stored alike is dropped before any
    pairing; the rows of a large group are split over salts of about rows_per_salt rows. Null and blank values pair
    with nothing, a row never with itself; an item_id that occurs twice is taken as it comes.
    """
    keyed = cut(forms(items, fields))
    salts = (F.col("rows") / rows_per_salt).cast("int") + 1
    rows = keyed.join(_spellings(keyed).select(*GROUP, salts.alias("salts")), GROUP)
    stored = F.struct("stored", "stored_too")
    left = rows.select(*GROUP, stored.alias("s_a"), F.col("item_id").alias("a"), F.pmod(F.hash("item_id"), F.col("salts")).alias("salt"))
    right = rows.select(*GROUP, stored.alias("s_b"), F.col("item_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = left.join(right, [*GROUP, "salt"]).where("a < b and s_a <> s_b")
    return pairs.select("field_name", F.col("a").alias("item_a"), F.col("b").alias("item_b"))
