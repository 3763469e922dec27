"""Pseudonyms: a keyed hash of an identity, computed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _padded(salt: bytes, byte: int) -> str:
    import hashlib

    key = hashlib.sha256(salt).digest() if len(salt) > _BLOCK else salt
    return bytes(b ^ byte for b in key.ljust(_BLOCK, b"\0")).hex()


def pseudonym(identity: Column, salt: bytes) -> Column:
    """``a_`` and 12 hex digits of HMAC-SHA256 over the trimmed lower-case identity; null for a missing one.

    The salt's pads are literals of the plan: redact them in logs (spark.sql.redaction.string.regex).
    """
    inner = F.sha2(F.concat(F.unhex(F.lit(_padded(salt, 0x36))), F.encode(F.lower(F.trim(identity)), "utf-8")), 256)
    outer = F.sha2(F.concat(F.unhex(F.lit(_padded(salt, 0x5C))), F.unhex(inner)), 256)
    return F.when(identity != "", F.concat(F.lit("a_"), F.substring(outer, 1, 12)))
