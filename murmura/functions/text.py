"""Text as column expressions: normal form, fingerprints, keyword verification, lines and labels.

Only compatibility normalisation needs Python; ASCII values never leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions import fixed_values as V

MODES = ("phrase", "all", "any")
_NOT_WORD = r"[^\p{L}\p{N}]"
_EDGE = "_\\p{L}\\p{N}"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(values)
    made = [*[unicodedata.normalize("NFKC", v) for v in distinct], None]  # a null's code is -1
    return pd.Series([made[k] for k in codes], dtype=object)


def nfkc(text: Column) -> Column:
    """Compatibility composed form; null stays null."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfkc(F.when(other, text))).otherwise(text)


def normalize(text: Column) -> Column:
    """NFKC without zero-width characters, white space as single blanks; null counts as empty."""
    plain = F.translate(nfkc(F.coalesce(text, F.lit(""))), V.ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def letters(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), f"{_NOT_WORD}+", "")


def fingerprint(text: Column, length: int = 160) -> Column:
    """First letters and digits of the normal form, in any script."""
    return F.substring(letters(normalize(text)), 1, length)


def content_key(text: Column, kind: Column, group: Column, parent_key: Column) -> Column:
    """Identity by place and text; null for a fingerprint under 12 characters."""
    print_ = fingerprint(text)
    comment = F.coalesce(kind.isin("comment", "reply"), F.lit(False))
    home = F.lower(F.coalesce(group, F.lit("")))
    where = F.when(comment, F.coalesce(parent_key, home)).otherwise(home)
    raw = F.concat_ws("|", F.when(comment, F.lit("comment")).otherwise(F.lit("post")), where, print_)
    return F.when(F.length(print_) >= 12, F.concat(F.lit("ck_"), F.substring(F.sha1(raw), 1, 16)))


def slugify(text: Column, longest: int = 60) -> Column:
    """Words joined by hyphens; ``keyword`` where nothing is left."""
    slug = F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), rf"[^{_EDGE}]+", "-")
    slug = F.substring(F.regexp_replace(slug, r"^[-_]+|[-_]+$", ""), 1, longest)
    return F.when(slug != "", slug).otherwise("keyword")


def record_id(key: Column) -> Column:
    return F.concat(F.lit("r_"), F.substring(F.sha1(key), 1, 12))


def text_key(text: Column) -> Column:
    return F.sha1(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))))


def truncated(text: Column, length: int = 400) -> Column:
    """The first characters with an ellipsis where something is cut off; length 0 keeps all."""
    if not length:
        return text
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def clean_text(text: Column) -> Column:
    """Text without button labels at line ends and without filler lines."""
    lines = F.split(F.regexp_replace(text, V.BUTTON_TEXT, ""), "\n")
    kept = F.filter(lines, lambda line: ~F.trim(line).isin(list(V.FILLER_LINES)))
    return F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+$", "")


def image_text(descriptions: Column) -> Column:
    """Distinct image descriptions as lines; null when none says anything."""
    kept = F.filter(F.array_distinct(descriptions), lambda d: ~F.lower(F.trim(d)).isin(list(V.NO_IMAGE_TEXT)))
    joined = F.array_join(kept, "\n")
    return F.when(joined != "", joined)


def group_name_from_title(title: Column) -> Column:
    """The first telling part of a tab title, without its counter."""
    parts = F.transform(F.split(F.regexp_replace(F.trim(title), r"^\(\d+\+?\)\s*", ""), r" \| "), lambda x: F.trim(x))
    telling = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(list(V.TITLE_NOISE)))
    return F.substring(F.get(telling, F.lit(0)), 1, 200)


def body_text(text: Column, nested: Column, names: Column) -> Column:
    """A post's own text: without the texts nested in it (comments, shared posts) and the names it links to."""
    order = F.array_sort(F.filter(nested, lambda n: F.trim(n) != ""), lambda a, b: F.length(b) - F.length(a))
    own = F.aggregate(F.coalesce(order, F.array().cast("array<string>")), text, lambda done, part: F.replace(done, part, F.lit("\n")))
    return clean_text(F.regexp_replace(without_names(own, F.coalesce(names, F.array().cast("array<string>"))), r"\n\s*\n+", "\n"))


def without_names(text: Column, names: Column) -> Column:
    """Text with each linked name replaced by a line break, longest names first."""
    order = F.array_sort(F.filter(names, lambda n: n != ""), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(order, text, lambda done, name: F.replace(done, name, F.lit("\n")))


def same_author(a: Column, b: Column) -> Column:
    """Equal normal forms, or one of them missing."""
    x, y = F.lower(normalize(a)), F.lower(normalize(b))
    return (x == "") | (y == "") | (x == y)


# Keyword verification


def plain_normalize(text: str | None) -> str:
    gone = dict.fromkeys(map(ord, V.ZERO_WIDTH))
    return " ".join(unicodedata.normalize("NFKC", text or "").translate(gone).split())


_QUOTES = "\"'“”‘’ "


def keyword_terms(keyword: str, mode: str = "phrase") -> list[str]:
    """The terms that a keyword without its quotes asks for: itself, or its words, each once; none for a blank one."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    whole = plain_normalize(keyword).strip(_QUOTES)
    words: dict[str, None] = {whole: None} if mode == "phrase" else {w: None for w in whole.split()}
    return [w for w in words if w]


def term_pattern(term: str) -> str:
    """A Java pattern for a term as whole words; between its words any symbols or none may stand."""
    chunks = re.findall(r"[^\W_]+|[\W_]+", term)
    words = [k for k, c in enumerate(chunks) if c[0].isalnum()]
    body = []
    for k, chunk in enumerate(chunks):
        inner = words and words[0] < k < words[-1] and k not in words
        body.append(f"{_NOT_WORD}*" if inner else re.sub(r"([^\w\s]|\s)", lambda m: "\\" + m[1], chunk))
    return f"(?iu)(?<![{_EDGE}]){''.join(body)}(?![{_EDGE}])"


def matched_terms(terms: Iterable[str], normal: Column) -> Column:
    """The terms found in a normalised text, in their order."""
    return F.filter(F.array(*[F.when(normal.rlike(term_pattern(t)), F.lit(t)) for t in terms]), lambda t: t.isNotNull())


def match_keyword(keyword: str, text: Column, mode: str = "phrase", context: int = 70) -> Column:
    """struct(ok, matched_terms, snippet); on failure the terms found so far and no snippet.

    The snippet shows context characters on either side of the earliest match, with an ellipsis on cut sides.
    """
    terms = keyword_terms(keyword, mode)
    if not terms:
        return F.struct(F.lit(False).alias("ok"), F.array().cast("array<string>").alias("matched_terms"), F.lit(None).cast("string").alias("snippet"))
    normal = normalize(text)
    found = matched_terms(terms, normal)
    ok = (F.size(found) > 0) if mode == "any" else (F.size(found) == len(terms))
    spans = []
    for t in terms:
        before = F.regexp_extract(normal, f"(?s)^(.*?){term_pattern(t)}", 1)
        here = F.regexp_extract(normal, term_pattern(t), 0)
        spans.append(F.when(normal.rlike(term_pattern(t)), F.struct(F.length(before).alias("start"), (F.length(before) + F.length(here)).alias("end"))))
    first = F.array_min(F.array_compact(F.array(*spans)))
    start, end = F.greatest(first["start"] - context, F.lit(0)), F.least(first["end"] + context, F.length(normal))
    snippet = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(normal, start + 1, end - start), F.when(end < F.length(normal), "…").otherwise(""))
    return F.struct(ok.alias("ok"), found.alias("matched_terms"), F.when(ok, snippet).alias("snippet"))


def matches(keyword: str, text: Column, mode: str = "phrase") -> Column:
    """Whether a keyword matches, without terms and snippet."""
    terms = keyword_terms(keyword, mode)
    if not terms:
        return F.lit(False)
    normal = normalize(text)
    hits = [normal.rlike(term_pattern(t)) for t in terms]
    out = hits[0]
    for hit in hits[1:]:
        out = (out | hit) if mode == "any" else (out & hit)
    return out


def verified_in(keyword: str, columns: dict[str, Column], mode: str = "phrase") -> Column:
    """The name of the first column in which the keyword matches; null for none."""
    return F.coalesce(*[F.when(matches(keyword, c, mode), F.lit(name)) for name, c in columns.items()])


def ascii_lower(text: Column) -> Column:
    """Lower case of ASCII letters only, for comparison without case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_like(text: Column, needle: str) -> Column:
    """LIKE %needle% without ASCII case; the needle's % and _ stay wildcards, a backslash is plain."""
    escaped = needle.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("~", "~~")
    return F.like(ascii_lower(text), F.lit(f"%{escaped}%"), F.lit("~"))
