"""Registered queries of the text problems, all on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import history, language, leakage, moderation, personal, reading, survivors, tokens, visible
from murmura.session import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items whose text or author name looks the same but is stored with other characters."""
    return visible.same_looking_pairs(table(spark, sf_dir, "items"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, item_id, links: the same without expansion into pairs, one row per row and field."""
    return visible.same_looking_classes(table(spark, sf_dir, "items")).drop("class")


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id with the consistent form of its text and author name."""
    items = table(spark, sf_dir, "items")
    return items.select("item_id", visible.canonical_column(items["text"]).alias("text_form"), visible.canonical_column(items["author_name"]).alias("author_form"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_key, field_name and the item whose value the surviving record takes."""
    return survivors.survivors(table(spark, sf_dir, "items"), table(spark, sf_dir, "runs"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each content_key with several rows."""
    return survivors.surviving_records(table(spark, sf_dir, "items"), table(spark, sf_dir, "runs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items of different runs that are the same post."""
    return history.repeated_posts(table(spark, sf_dir, "items"), table(spark, sf_dir, "runs"))


def _moderation(spark: SparkSession, sf_dir: str) -> tuple:
    return moderation.fit(table(spark, sf_dir, "moderation_samples"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id with its class of alike rows and the number of linked other classes, without expansion into pairs."""
    return history.classes(table(spark, sf_dir, "items"), table(spark, sf_dir, "runs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id of every item whose text is abusive, hateful or sexual."""
    items = spread(table(spark, sf_dir, "items").select("item_id", "text"))
    return moderation.scored(items, _moderation(spark, sf_dir)).where(f"score >= {moderation.THRESHOLD}").select("item_id")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id with its score in each category."""
    return moderation.scored(spread(table(spark, sf_dir, "items").select("item_id", "text")), _moderation(spark, sf_dir))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of flagged items per group_name."""
    return moderation.rates(spread(table(spark, sf_dir, "items").select("group_name", "text")), _moderation(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id and language: wrongly or not labelled items, and each language of items that mix several."""
    items = table(spark, sf_dir, "items").select("item_id", "text", "language")
    return language.relabelled(spread(items), language.fit(items))


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id with position, language, confidence and text of each segment in one language."""
    items = table(spark, sf_dir, "items").select("item_id", "text", "language")
    segments = language.segments_column(items["text"], language.fit(items))
    return spread(items).select("item_id", F.posexplode(segments).alias("position", "s")).select("item_id", "position", "s.*")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, field_name and pii_type of every field that holds that type of personal data."""
    found = personal.field_types(spread(table(spark, sf_dir, "items").select("item_id", "text", "author_name", "image_text")))
    return found.where(found["pii_type"].isin("email", "phone", "id_number", "address", "name"))


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id with text, author name and image text, personal data replaced by typed placeholders."""
    items = spread(table(spark, sf_dir, "items").select("item_id", "text", "author_name", "image_text"))
    kinds = {"text": personal.TYPES, "author_name": personal.NAME_FIELD_TYPES, "image_text": personal.TYPES}
    return items.select("item_id", *[personal.redacted_column(items[f], t)["text"].alias(f) for f, t in kinds.items()])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each document by byte_bpe_50k, without special tokens."""
    return tokens.encoded(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and test_id of every document that holds at least half of a held-out item's words."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leakage.leaks(documents, table(spark, sf_dir, "held_out_items")).select("doc_id", "test_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and reading level of every English document of at least 40 words."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return reading.english_levels(documents, table(spark, sf_dir, "reading_samples")).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the reading levels per source."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang"))
    return reading.source_profile(documents, table(spark, sf_dir, "reading_samples"))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_forms": p1_forms, "p2_found": p2_found, "p2_records": p2_records, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p5_scores": p5_scores, "p5_rates": p5_rates, "p6_found": p6_found, "p6_segments": p6_segments, "p7_found": p7_found, "p7_redacted": p7_redacted, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_profile": p10_profile}
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_BLANKS = "\t\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _looks_sql() -> str:
    """The visible form of ``value`` in SQL, as far as the characters of the tables go."""
    x = "regexp_replace(value, '([\\x{2600}-\\x{27BF}\\x{1F300}-\\x{1FAFF}])\\x{200D}', '\\1\ue000', 'g')"
    x = f"regexp_replace({x}, '[\\x{{00AD}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{FE0F}}]', '', 'g')"
    x = f"translate({x}, '{_WIDE}{_BLANKS}', '{_NARROW}{' ' * len(_BLANKS)}')"
    for form, letters in (("\ufb03", "ffi"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb00", "ff"), ("\u2026", "...")):
        x = f"replace({x}, '{form}', '{letters}')"
    (cyrillic, c), (greek, g) = visible.CYRILLIC, visible.GREEK
    return f"replace(nfc_normalize(translate({x}, '{cyrillic}{greek}', '{c}{g}')), '\ue000', '\u200d')"


_LOOKS = (
    "WITH v AS (SELECT item_id, 'text' AS field_name, text AS value FROM items UNION ALL SELECT item_id, 'author_name', author_name FROM items), "
    f"f AS (SELECT item_id, field_name, value, {_looks_sql()} AS looks FROM v WHERE trim(value) <> '') "
)
_SPACES = "[\\t\\n\\v\\f\\r\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000} ]+"


def _form_sql(field: str) -> str:
    """The canonical form, as far as the characters of the tables go: case folds as lower case, but for sharp s and final sigma."""
    folded = f"replace(replace(lower({_looks_sql().replace('value', field)}), 'ß', 'ss'), 'ς', 'σ')"
    return f"regexp_replace(regexp_replace({folded}, '{_SPACES}', ' ', 'g'), '^ | $', '', 'g')"


SQL: dict[str, str] = {
    "p1_found": _LOOKS + "SELECT a.field_name, a.item_id AS item_a, b.item_id AS item_b FROM f a JOIN f b ON a.field_name = b.field_name AND a.looks = b.looks WHERE a.item_id < b.item_id AND a.value <> b.value",
    "p1_classes": _LOOKS + ", n AS (SELECT field_name, looks, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT field_name, looks, value, count(*) AS n FROM f GROUP BY ALL) "
    "SELECT f.field_name, f.item_id, n.n - s.n AS links FROM f JOIN n USING (field_name, looks) JOIN s ON s.field_name = f.field_name AND s.looks = f.looks AND s.value = f.value",
    "p1_forms": f"SELECT item_id, {_form_sql('text')} AS text_form, {_form_sql('author_name')} AS author_form FROM items",
}
