"""Personal information inside free text: typed placeholders in its place, the rest unchanged.

Spans are proposed by regular expressions on a folded copy of the text (look-alikes, full-width digits and
invisible characters resolved, positions kept), confirmed by validators (Luhn for card numbers, mod-97 for
account numbers, the check letter or digit of the identity numbers that have one, digit counts and shapes for the
rest) and weighed by the words around them. A span counts when its score reaches ``ACCEPT``.

Defined results: null stays null with no spans; empty stays empty; overlapping spans resolve to the higher
score, then the longer, then the earlier one; a text is read as a whole, however long.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.llm.visible import CYRILLIC, GREEK

ACCEPT = 0.5
TYPES = ("email", "phone", "id_number", "address", "name", "card", "account")
#: In a name field only these count; the field itself is expected to hold a name.
NAME_FIELD_TYPES = ("email", "phone")

_ONE_TO_ONE = {ord(a): b for a, b in zip(CYRILLIC[0] + GREEK[0], CYRILLIC[1] + GREEK[1], strict=True)}
_GONE = regex.compile("[\\p{Default_Ignorable_Code_Point}\ufeff]")

# Words near a number, by what they make of it (fixed values, in the languages of the data).
PHONE_WORDS = r"call|phone|ph|tel|mob(?:ile)?|cell|whatsapp|number|número|teléfono|telefono|llame|llama|tawag|tumawag|rabta|raabta|contact|sms|text|☎|📞|رابطہ|فون|نمبر|هاتف|اتصل|फोन|नंबर|संपर्क"
ID_WORDS = r"cnic|nic|nicop|passport|pasaporte|pasaporte|licen[cs]e|licencia|lisensya|ssn|national id|identity|id card|id number|identification|dni|cédula|cedula|aadhaar|aadhar|شناختی|पासपोर्ट|आधार"
CODE_WORDS = r"order|ref(?:erence)?|serial|s/?n|item|code|model|firmware|version|meter|reading|invoice|tracking|batch|lot|sku|size|total|page|open|slots|string|voltage|rs|pkr|price|part"
STREET_WORDS = r"street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|drive|blvd|boulevard|close|gali|mohalla|calle|avenida|piso|barangay"
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
BUSINESS_WORDS = (
    "traders repair point supply co depot tools house electronics home services energy mart solar shop store company center centre power "
    "support helpline team desk office page group club market power town city colony school bank housing block enclave extension villa sector phase floor second first third ground"
).split()
FUNCTION_WORDS = "the a an and or from for with at in on of to my our your his her this that it i we you".split()

EMAIL = re.compile(
    r"(?:mailto:)?[a-z0-9][a-z0-9._%+\-]*(?: ?@ ?(?=[a-z0-9\-]+[.\[( ])| ?[\[(] ?at ?[\])] ?| at (?=[a-z0-9\-]+ ?[\[(] ?dot))[a-z0-9\-]+(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[a-z0-9\-]+)*(?:\.| ?[\[(] ?dot ?[\])] ?)[a-z]{2,}",
    re.I,
)
_NUMBER = re.compile(r"(?<![\w@,])(?<![\w][-./])(?:\+|00)?\(?\d(?:(?:[ \-.]|\) ?| ?\()?\d){6,15}(?![\w])(?![-/]\w)(?!,\d)")
_ID_SHAPED = re.compile(r"(?<![\w-])(?:[A-Z]{1,3}-?\d{6,9}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|\d{4} \d{4} \d{4}|\d{5}-\d{7}-\d|\d{3}-\d{2}-\d{4}|\d{4}-\d{4}-\d{4}|\d{5} \d{7} \d|\d{12,13}|\d{9})(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_NEAR_ID = re.compile(rf"(?<!\w)(?:{ID_WORDS})(?!\w)[\s.:#]*(?:(?:card|no|number|nr|num|número|numero|is|was|es|hai|ay)(?!\w)[\s.:#]*){{0,3}}$", re.I)
_NEAR_PHONE = re.compile(rf"(?:(?<!\w)(?:{PHONE_WORDS}))(?!\w)[^.!?\n।؟۔]{{0,25}}$", re.I)
_NEAR_CODE = re.compile(rf"(?<!\w)(?:{CODE_WORDS})(?!\w)[\s.:#]*(?:no|number|nr|code)?[\s.:#]*$", re.I)

_ADDRESS = re.compile(
    r"(?<!\w)(?:"
    r"(?:house|h|plot|flat|apt|apartment|bungalow|shop|makan|casa|bahay)\.? ?(?:no\.?|number|#)? ?\d{1,5}(?:[-/ ]?[a-z])?(?!\w)(?:,? (?:street|gali|block|road|lane|floor|st)\.?,?(?: (?:no\.?|number|#))? ?\d{1,4}[a-z]?"
    r"|,? \d{1,5} (?:[a-z']+ ){1,3}(?:street|st|road|rd|avenue|ave|lane|ln|drive)\b\.?"
    r"|,? (?:[a-z']+ ){1,3}(?:street|st|road|rd|avenue|ave|lane|ln|drive)\b\.?)"
    r"(?:(?:, ?| )(?:near )(?-i:[A-Z][\w-]+)(?: (?-i:[A-Z][\w-]+)){0,2}|, ?(?-i:[A-Z][\w-]+)(?: (?-i:[A-Z][\w-]+)){0,2})?"
    r"|(?:مکان|گھر|فلیٹ|پلاٹ|مكان|منزل|شقة|मकान|घर|फ्लैट|प्लॉट) ?(?:نمبر|رقم|नंबर|नं\.?)? ?#? ?\d{1,5}[a-z]?(?!\w)[،,]? ?(?:گلی|سڑک|روڈ|بلاک|شارع|गली|सड़क|रोड|ब्लॉक)(?: (?:نمبر|رقم|नंबर|नं\.?))? ?#? ?\d{1,4}"
    r"|(?:شارع) (?:[\u0621-\u064a]+ ){1,3}(?:رقم )?\d{1,5}"
    r"|(?:calle|avenida|av\.|carrera) (?:[a-záéíóúñ']+ ){1,3}\d{1,5}(?:, ?(?:piso|apto|casa)\.? ?\d{1,4})?"
    r"|\d{1,5}(?:-?[a-z])? (?:(?-i:[A-Z][a-z']+|[A-Z]+) ){1,3}(?:street|st|road|rd|avenue|ave|lane|ln|drive)\b\.?(?:, ?(?:flat|apt|unit|floor) ?\d{1,4}[a-z]?|, ?(?-i:[A-Z][\w-]*)(?: (?-i:[A-Z][\w-]*)){0,3})?"
    r")",
    re.I,
)

_CAP = r"[\p{Lu}][\p{L}\p{M}'’\-]+"
_NAME = rf"(?P<name>{_CAP}(?: {_CAP}){{1,2}}?)"
# Words before or after a capitalised pair that make it a person's name (fixed values).
_NAME_BEFORE = (
    r"(?:my|our|his|her|their) (?:brother|sister|cousin|uncle|aunt|friend|neighbour|neighbor|husband|wife|son|daughter|father|mother|landlord|landlady|tenant|boss|manager|colleague|teacher|doctor|lawyer|driver|electrician|plumber|partner|nephew|niece)|thanks to|contact person:?|ask for|regards,?|my name is|i am|mr\.?|mrs\.?|ms\.?|dr\.?|"
    r"mere bhai|meri behan|mere dost|mera naam|si|hanapin si|ni|kay|mi (?:vecin[ao]|hermano|hermana|prim[ao]|amig[ao]|tí[ao])|pregunten por|gracias a|me llamo|señora?|salamat kay|shukriya|—|–|signed|attn:?"
)
_NAME_AFTER = r"from the \p{L}+ floor|sahab|sahib|sahiba|se baat|ne lagaya|ang nag|lo instal|has the keys|fitted it|saheb"
_NAME_CUED = regex.compile(rf"(?:^|(?<=[\s(\"'“‘]))(?i:{_NAME_BEFORE}) {_NAME}(?![\p{{L}}])|(?:^|(?<![\p{{L}}])){_NAME} (?i:{_NAME_AFTER})(?![\p{{L}}])|(?:^|(?<![\p{{L}}])){_NAME} (?i:{_NAME_AFTER})")
#: A surname before the given name, with what persons do after it.
_DEEDS = "called|said|says|came|phoned|wrote|lives|told|asked|works|sent|paid|signed|visited|answered"
_NAME_TURNED = regex.compile(rf"(?:^|(?<=[\s(\"'“‘]))(?P<name>{_CAP}, {_CAP})(?= (?:{_DEEDS})(?![\p{{L}}]))")
_TURNED_HINT = re.compile(rf", \S+ (?:{_DEEDS})\b")
_NAME_HINT = regex.compile(rf"(?i)(?<![\p{{L}}])(?:{_NAME_BEFORE}|{_NAME_AFTER})")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pii_type", T.StringType()), T.StructField("score", T.DoubleType())]))
REDACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS)])


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number passes the mod-97 check of its country format."""
    turned = account[4:] + account[:4]
    return turned.isalnum() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def check_letter(number: str) -> bool:
    """Whether the last letter of an identity number fits its digits modulo 23; a leading X, Y or Z counts as 0, 1 or 2."""
    plain = number.replace("-", "").upper()
    digits = plain[:-1].translate(str.maketrans("XYZ", "012"))
    return digits.isdigit() and plain[-1] == CHECK_LETTERS[int(digits) % 23]


def verhoeff(digits: str) -> bool:
    """Whether a digit string passes the Verhoeff check: products in the symmetry group of the pentagon come to 0."""

    def times(a: int, b: int) -> int:
        turned = (a + b) % 5 if a < 5 else (a - b) % 5
        return turned if (a < 5) == (b < 5) else turned + 5

    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        for _ in range(place % 8):
            d = VERHOEFF_STEP[d]
        total = times(total, d)
    return total == 0


def folded(text: str) -> tuple[str, list[int] | None]:
    """text with look-alikes resolved, and the position in text of each of its characters (None: the same)."""
    if text.isascii():
        return text, None
    if not _GONE.search(text) and all(len(unicodedata.normalize("NFKC", c)) == 1 for c in set(text) if not c.isascii()):
        return "".join([_one(c) for c in text]), None
    out, at = [], []
    for k, c in enumerate(text):
        if not _GONE.match(c):
            for x in unicodedata.normalize("NFKC", c):
                out.append(_one(x))
                at.append(k)
    at.append(len(text))
    return "".join(out), at


_singles: dict[str, str] = {}


def _one(c: str) -> str:
    if c.isascii():
        return c
    known = _singles.get(c)
    if known is None:
        x = unicodedata.normalize("NFKC", c)
        x = x if len(x) == 1 else c
        x = _ONE_TO_ONE.get(ord(x), x)
        known = str(unicodedata.digit(x)) if x.isdecimal() else " " if x.isspace() and x != "\n" else x
        _singles[c] = known
    return known


def _numbers(text: str) -> Iterator[tuple[int, int, str, float]]:
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield m.start(), m.end(), "account", 0.95
    for m in _ID_SHAPED.finditer(text):
        before = text[max(0, m.start() - 40) : m.start()]
        if _NEAR_ID.search(before):
            yield m.start(), m.end(), "id_number", 0.95
        elif re.fullmatch(r"[XYZ\d]-?\d{7}-?[A-Z]", m[0]) and check_letter(m[0]) and not _NEAR_CODE.search(before):
            yield m.start(), m.end(), "id_number", 0.7
        elif re.fullmatch(r"[2-9]\d{3} \d{4} \d{4}", m[0]) and verhoeff(m[0].replace(" ", "")) and not _NEAR_CODE.search(before) and not _NEAR_PHONE.search(before):
            yield m.start(), m.end(), "id_number", 0.7
        elif re.fullmatch(r"\d{5}-\d{7}-\d", m[0]) and not _NEAR_CODE.search(before):
            yield m.start(), m.end(), "id_number", 0.8
    for m in _NUMBER.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        before = text[max(0, m.start() - 40) : m.start()]
        if _NEAR_ID.search(before):
            yield m.start(), m.end(), "id_number", 0.95
            continue
        if _NEAR_CODE.search(before):
            continue
        score = 0.55 if re.match(r"\+|00|\(?0\d|\(\d{3}\)", m[0]) else 0.1
        if re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}", m[0]):
            score -= 0.5
        if re.match(r"\d(?: \d){6,}$", m[0]):
            score += 0.3
        if re.match(r"\d{3,5}[-. ]\d{3}[-. ]?\d{3,4}$", m[0]):
            score += 0.15
        if _NEAR_PHONE.search(before) or before.rstrip().endswith("☎"):
            score += 0.45
        if 10 <= len(digits) <= 15:
            score += 0.1
        elif len(digits) < 7 or len(digits) > 15:
            score -= 0.4
        if 13 <= len(digits) <= 19 and luhn(digits) and not m[0].startswith(("+", "0", "(")) and not _NEAR_PHONE.search(before):
            yield m.start(), m.end(), "card", 0.7
        else:
            yield m.start(), m.end(), "phone", score


def _names(text: str) -> Iterator[tuple[int, int, str, float]]:
    for m in _NAME_TURNED.finditer(text) if _TURNED_HINT.search(text) else ():
        if not any(w.lower() in BUSINESS_WORDS or w.lower() in FUNCTION_WORDS for w in m["name"].split(", ")):
            yield *m.span("name"), "name", 0.8
    for m in _NAME_CUED.finditer(text, overlapped=True) if _NAME_HINT.search(text) else ():
        start, end = m.span("name")
        words = m["name"].split()
        score = 0.9 - 0.5 * sum(w.lower().strip("'’-") in BUSINESS_WORDS or w.lower() in FUNCTION_WORDS for w in words)
        following = text[end : end + 20].split()
        if following and following[0].strip(".,").lower() in BUSINESS_WORDS:
            score -= 0.5
        yield start, end, "name", score


def spans(text: str | None, types: tuple[str, ...] = TYPES) -> list[tuple[int, int, str, float]]:
    """(start, end, type, score) of the accepted spans of text, in order, without overlap."""
    if not text:
        return []
    plain, at = folded(text)
    found: list[tuple[int, int, str, float]] = []
    low = plain.lower()
    if "email" in types and ("@" in plain or "at]" in low or "at)" in low or "at ]" in low or "at )" in low or "dot" in low):
        found += [(m.start(), m.end(), "email", 0.9) for m in EMAIL.finditer(plain)]
    has_digit = any(c in plain for c in "0123456789")
    if has_digit:
        found += _numbers(plain)
        if "address" in types:
            found += [(m.start(), m.end(), "address", 0.8) for m in _ADDRESS.finditer(plain)]
    if "name" in types:
        found += _names(plain)
    chosen: list[tuple[int, int, str, float]] = []  # in order, without overlap
    for span in sorted((s for s in found if s[3] >= ACCEPT and s[2] in types), key=lambda s: (-s[3], s[0] - s[1], s[0])):
        at_most = bisect.bisect_left(chosen, span)
        if (not at_most or chosen[at_most - 1][1] <= span[0]) and (at_most == len(chosen) or chosen[at_most][0] >= span[1]):
            chosen.insert(at_most, span)
    if at is None:
        return chosen
    return [(at[a], at[b - 1] + 1, t, s) for a, b, t, s in chosen]


def redact(text: str | None, types: tuple[str, ...] = TYPES) -> tuple[str | None, list[tuple[int, int, str, float]]]:
    """text with a placeholder such as ``[EMAIL]`` for each span, and the spans."""
    found = spans(text, types)
    if not found:
        return text, []
    out, last = [], 0
    for a, b, kind, _ in found:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:], found


def redacted_column(value: Column, types: tuple[str, ...] = TYPES) -> Column:
    """struct(text, spans) of a string column."""

    @F.pandas_udf(REDACTED)
    def run(values: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple] = {}
        rows = []
        for v in values:
            if v not in known:
                known[v] = redact(v, types)
            rows.append(known[v])
        return pd.DataFrame({"text": [r[0] for r in rows], "spans": [[{"start": a, "end": b, "pii_type": t, "score": s} for a, b, t, s in r[1]] for r in rows]})

    return run(value)


def _types_column(value: Column, types: tuple[str, ...]) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(values: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}
        return pd.Series([known[v] if v in known else known.setdefault(v, sorted({s[2] for s in spans(v, types)})) for v in values], dtype=object)

    return run(value)


def field_types(items: DataFrame, id_column: str = "item_id", text_fields: tuple[str, ...] = ("text", "image_text"), name_fields: tuple[str, ...] = ("author_name",)) -> DataFrame:
    """id, field_name, pii_type: one row per row, field and type of personal data in it, however often."""
    kinds = {f: _types_column(F.col(f), TYPES) for f in text_fields} | {f: _types_column(F.col(f), NAME_FIELD_TYPES) for f in name_fields}
    found = items.select(id_column, *[c.alias(f) for f, c in kinds.items()])
    rows = found.select(id_column, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("types")) for f in kinds])).alias("f"))
    return rows.select(id_column, "f.field_name", F.explode("f.types").alias("pii_type"))
