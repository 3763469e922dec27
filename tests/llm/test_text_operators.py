"""The text operators on small fixtures: brute force, reference tokenizers, held-out accuracy, edge cases."""

import difflib
import random
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmura.llm import language, leakage, personal, reading, tokens, visible

VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
LONG = "The pump makes a noise. " * 4000

# 1 look-alikes

SAME = [
    ("Mellow pump", "Ｍｅｌｌｏｗ　ｐｕｍｐ"), ("Mellow pump", "Mеllοw рumр"), ("Mellow pump", "Mel​low pu­mp"), ("café", "café"), ("Jοsé", "José"), ("ﬁne", "fine"),
    ("آب", "آب"), ("see…", "see..."),
]
OTHER = [("Pump", "pump"), ("a.b", "a,b"), ("a\nb", "a b"), ("m²", "m2"), ("👨‍👩‍👧", "👨👩👧"), ("рост", "poct"), ("ко́д", "код")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_looks(a, b):
    assert visible.visible(a) == visible.visible(b) and visible.canonical(a) == visible.canonical(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_looks(a, b):
    assert visible.visible(a) != visible.visible(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_forms_are_stable(text):
    assert visible.canonical(visible.canonical(text)) == visible.canonical(text)
    assert visible.visible(visible.visible(text)) == visible.visible(text)
    assert unicodedata.is_normalized("NFC", visible.visible(text))


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    spell = [lambda s: s, lambda s: s, lambda s: s.replace("e", "е"), lambda s: s.replace(" ", " "), lambda s: s[:2] + "​" + s[2:]]
    rows = [(f"i{k:03}", rng.choice([None, "", " ", *[rng.choice(spell)(t) for t in ("green hose", "old pump here", "Green hose")]]), rng.choice([None, "Ann Lee", "Ann Lее"]), "clash") for k in range(160)]
    df = spark.createDataFrame(rows, "item_id string, text string, author_name string, looks string")
    want = set()
    for f, column in (("text", 1), ("author_name", 2)):
        for x in rows:
            for y in rows:
                a, b = x[column], y[column]
                if x[0] < y[0] and a and b and a.strip() and a != b and visible.visible(a) == visible.visible(b):
                    want.add((f, x[0], y[0]))
    for salt in (20000, 7):
        assert {tuple(r) for r in visible.same_looking_pairs(df, rows_per_salt=salt).collect()} == want
    assert visible.same_looking_pairs(df.limit(0)).count() == 0


def test_columns_equal_functions(spark):
    values = [None, "", "ABC  d", "Mеllοw​ pump", LONG, "\ttab"]
    got = spark.createDataFrame([(v,) for v in values], "t string").select(visible.canonical_column(F.col("t")), visible.visible_column(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if v is None else visible.canonical(v) for v in values]
    assert [r[1] for r in got] == [None if v is None else visible.visible(v) for v in values]


# 6 language


@pytest.fixture(scope="module")
def model():
    return language.model_of(language.freeze(language.seed_counts()))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Nobody was here when we came back from there.", {"en"}), ("Mujhe bata dein ke yeh kab tak mil jaye ga.", {"ur-Latn"}), ("Hindi ko alam kung nasaan ang bahay nila.", {"tl"}), ("No sé dónde está la tienda de ustedes.", {"es"}),
        ("مجھے بتائیں کہ یہ کب تک مل جائے گا۔", {"ur"}), ("मुझे बताइए कि यह कब तक मिलेगा।", {"hi"}), ("لا أعرف أين المتجر ولا كم السعر.", {"ar"}), ("", set()), ("Price? 123", set()),
        ("Nobody was here when we came back. No sé dónde está la tienda de ustedes.", {"en", "es"}), ("Nоbоdy wаs hеrе whеn wе саmе bасk.", {"en"}), ("Form par CNIC no. 35202-1234567-1 likha hai", set()),
    ],
)
def test_sentence_languages(model, text, found):
    assert model.clear_languages(text, "xx") == found


FOREIGN = [
    "Ich habe gestern im Laden gefragt, aber niemand konnte mir sagen, wann die Lieferung kommt.", "Je suis allé au magasin hier mais personne ne voulait me répondre.", "Вчера мы ходили в магазин, но никто нам не ответил.",
    "Ieri siamo andati al negozio ma nessuno ci ha voluto rispondere.", "Kemarin kami pergi ke toko tetapi tidak ada yang mau menjawab.", "Dün mağazaya gittik ama kimse bize cevap vermedi.",
    "دیروز به فروشگاه رفتیم اما هیچ کس جواب ما را نداد.", "গতকাল আমরা দোকানে গিয়েছিলাম কিন্তু কেউ আমাদের উত্তর দেয়নি।", "Wczoraj poszliśmy do sklepu, ale nikt nie chciał nam odpowiedzieć.", "Hôm qua chúng tôi đã đến cửa hàng nhưng không ai trả lời.",
]


def test_other_languages_are_undetermined(model):
    found = [model.best(language.words(t))[0] for t in FOREIGN]
    assert found.count("und") >= 0.9 * len(FOREIGN)  # Indonesian shares its short words with Roman Urdu
    assert sum(model.clear_languages(t, None) == set() for t in FOREIGN) >= 0.9 * len(FOREIGN)
    unseen = {"en": "A musician played violin beside the fountain while we were waiting for her.", "es": "Los científicos descubrieron una galaxia que nadie había visto antes.", "ur": "مسافر نے دریا کے پاس بیٹھ کر اپنا گیت گایا۔", "ar": "جلس المسافر تحت الشجرة وهو يقرأ في كتاب جديد."}
    assert {code: model.best(language.words(t))[0] for code, t in unseen.items()} == {code: code for code in unseen}


def test_a_row_of_names_and_measures_is_no_sentence(model):
    assert model.clear_languages("965 W = Rs 20,250 (Elmira Power) Size 2278 x 1134 mm Solmere Vantis Rs", None) == set()
    assert model.clear_languages("I need help please", None) == {"en"}


def test_costs_do_not_depend_on_the_words_before(monkeypatch):
    texts = [language.SEEDS[c] for c in language.LANGUAGES] * 2
    fresh = [language.Model(language.seed_counts()).costs(language.words(t)).tolist() for t in texts]
    monkeypatch.setattr(language, "CACHED_WORDS", 100)  # the cache fills up within texts again and again
    worn = language.Model(language.seed_counts())
    assert [worn.costs(language.words(t)).tolist() for t in texts] == fresh


def test_code_lengths_are_a_distribution(model):
    # The probabilities of all single bytes after a known context sum to at most 1.
    coder = model._coders[0]
    nexts, seen, kinds = coder._tree[b" t"]
    assert sum(n / (seen + kinds) for n in nexts.values()) + kinds / (seen + kinds) == pytest.approx(1)


def test_relabelled(spark):
    en, es = "Nobody was here when we came back from there.", "No sé dónde está la tienda de ustedes."
    rows = [("right", en, "English"), ("spelt", en, "en_GB"), ("wrong", en, "ar"), ("none", en, None), ("und", en, "und"), ("mixed", f"{en} {es}", "en"), ("null", None, None), ("empty", "", "en"), ("short", "Price?", "ur"), ("null", None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "item_id string, text string, language string, confidence string")
    frozen = language.fit(df)
    got = sorted((r.item_id, r.language) for r in language.relabelled(df, frozen).collect())
    assert got == [("mixed", "en"), ("mixed", "es"), ("none", "en"), ("und", "en"), ("wrong", "en")]
    parts = df.select("item_id", language.segments_column(F.col("text"), frozen).alias("s")).where("item_id = 'mixed'").first().s
    assert [p.language for p in parts] == ["en", "es"] and all(0 < p.confidence <= 1 for p in parts)
    whole = {r.item_id: r.l for r in df.select("item_id", language.language_column(F.col("text"), frozen).alias("l")).collect()}
    assert whole["null"] == ("und", 0.0) and whole["right"].language == "en"
    assert language.relabelled(df.limit(0), language.fit(df.limit(0))).count() == 0


# 7 personal information


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Write to a.b+c@mail.example today", {"email"}), ("a.b (at) mail [dot] example", {"email"}), ("Call me on 0399-1234567.", {"phone"}), ("WhatsApp +92 399 1234567 any time", {"phone"}), ("☎ ０３９９ １２３４５６７", {"phone"}),
        ("0 3 9 9 1 2 3 4 5 6 7", {"phone"}), ("CNIC 35202-1234567-1", {"id_number"}), ("They asked for my passport no. ZZ1234567", {"id_number"}), ("SSN 904-41-3516", {"id_number"}), ("I live at House 12, Street 3, Noor Colony", {"address"}),
        ("Deliver to 119 Old Mill Road, Flat 38A", {"address"}), ("Vivo en Calle Lotus 62, piso 25", {"address"}), ("Thanks to Ann Corpora for the help", {"name"}), ("Ask for Solara Traders at the gate", set()), ("Order ref 123-4567-890", set()),
        ("Rs 123,456 for 12 panels x 550 W", set()), ("Serial no. SN-1234-567890", set()), ("Card 4111 1111 1111 1111 expired", {"card"}), ("IBAN GB82 WEST 1234 5698 7654 32", {"account"}), ("See you in Townville on 2026-03-05", set()), ("My landlord Jordan Blake will open the gate", {"name"}), ("Perez, Maria called twice", {"name"}), ("DNI 12345678Z", {"id_number"}), ("12345678Z is mine", {"id_number"}), ("12345678A is a part", set()),
        ("Passport number is AB1234567", {"id_number"}), ("مکان نمبر 12، گلی نمبر 4", {"address"}), ("मकान नंबर 12, गली नंबर 4", {"address"}), ("Karachi, Lahore are towns", set()), ("Meter 2341 2341 2346", set()), ("", set()), (None, set()), (LONG, set()),
    ],
)
def test_personal(text, kinds):
    assert {s[2] for s in personal.spans(text)} == kinds


def test_check_digits():
    assert personal.verhoeff("2363") and not personal.verhoeff("2364") and not any(personal.verhoeff(f"236{d}") for d in "01245678 9".replace(" ", ""))
    assert personal.check_letter("X1234567L") and personal.check_letter("12345678Z") and not personal.check_letter("12345678T")


def test_spans_take_linear_time():
    import time

    def seconds(n):
        text = "Call 0399-1234567 or mail a@mail.example, thanks. " * n
        began = time.perf_counter()
        assert len(personal.spans(text)) == 2 * n
        return time.perf_counter() - began

    seconds(50)
    assert seconds(4000) < 30 * seconds(400)


def test_redaction(spark):
    text = "Hi​! Mail a​.b@mail.example or call 0399-1234567, thanks"
    assert personal.redact(text)[0] == "Hi​! Mail [EMAIL] or call [PHONE], thanks"
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112") and personal.mod97("GB82WEST12345698765432") and not personal.mod97("GB82WEST12345698765433")
    df = spark.createDataFrame([("a", text, "Ann Lee 0399 1234567", None, "x"), ("b", None, "", "", "x"), ("b", None, "", "", "x")], "item_id string, text string, author_name string, image_text string, types string")
    assert {tuple(r) for r in personal.field_types(df).collect()} == {("a", "text", "email"), ("a", "text", "phone"), ("a", "author_name", "phone")}
    assert [r[0] for r in df.select(personal.redacted_column(F.col("text"))["text"]).collect()][1:] == [None, None]
    assert personal.field_types(df.limit(0)).count() == 0


# 8 tokens

ODD = ["", " ", "  \n\n x", "<|endoftext|>", "don't I'LL 12345678", "पंप خراب 🌞👨‍👩‍👧", "a" * 700, "\x00\x07", "ab " * 300, "é" * 200, "​ "]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_tokens_equal_a_public_encoder(text):
    import tiktoken

    coder = tokens.encoder(VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    assert coder.encode(text) == other.encode_ordinary(text)


@pytest.mark.parametrize("text", ODD)
def test_tokens_of_odd_texts(text):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    coder = tokens.encoder(VOCABULARY)
    assert coder.encode(text) == other.encode(text, add_special_tokens=False).ids
    if text:
        assert coder.long(text.encode()) == coder.short(text.encode())


def test_encoded_table(spark):
    df = spark.createDataFrame([(1, "a pump", "x"), (2, None, "x"), (3, "", "x"), (1, "a pump", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encoded(df).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3] and got[0] == got[1] and got[2][1] == got[3][1] == []
    assert tokens.encoded(df.limit(0)).count() == 0


# 9 leakage

WORDS = [f"w{k}" for k in range(300)]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    tests = [(k, " ".join(rng.choices(WORDS, k=rng.choice([40, 60, 80])))) for k in range(12)] + [(90, "three small words"), (91, ""), (92, None)]
    docs = []
    for k in range(60):
        item = rng.choice(tests[:12])[1].split()
        share = rng.choice([0.1, 0.3, 0.7, 1.0])
        part = item[: int(len(item) * share)]
        if rng.random() < 0.5 and len(part) > 20:
            part[10] = "changed"
            part[18:18] = rng.choices(WORDS, k=15)
        docs.append((k, " ".join(rng.choices(WORDS, k=30) + [w.upper() for w in part] + rng.choices(WORDS, k=20)), "x"))
    docs += [(100, "here are Three, small\nwords again", "x"), (101, None, "x"), (102, "", "x"), (103, "w1", "x")]
    want = {(100, 90)}
    for d, text, _ in docs[:60]:
        words = leakage.leak_words(text)
        for t, item in tests[:12]:
            blocks = difflib.SequenceMatcher(None, leakage.leak_words(item), words, autojunk=False).get_matching_blocks()
            if sum(b.size for b in blocks if b.size >= leakage.SHINGLE) >= leakage.COVER * len(item.split()):
                want.add((d, t))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, coverage string")
    held = spark.createDataFrame(tests, "test_id bigint, text string")
    assert {(r.doc_id, r.test_id) for r in leakage.leaks(df, held).collect()} == want
    assert leakage.leaks(df.limit(0), held).count() == 0 and leakage.leaks(df, held.limit(0)).count() == 0


def test_chains_are_weighted_by_the_words_they_add():
    rng = random.Random(6)
    item = WORDS[:32]
    pieces = [[*item[k : k + 4], f"filler{k}"] for k in (12, 17, 22, 27)]
    text = " ".join(w for piece in [*pieces, item[:12]] for w in piece)  # 8 shingles with 16 words before 10 with 12
    assert leakage.Index([(1, " ".join(item))]).leaks([text]) == [(0, 0, 0.5)]
    for _ in range(200):
        words, found = rng.choices(WORDS[:8], k=20), rng.choices(WORDS[:8], k=40)
        shingles = {}
        for k in range(len(found) - 2):
            shingles.setdefault(tuple(found[k : k + 3]), []).append(k)
        pairs = sorted((d, i) for i in range(len(words) - 2) for d in shingles.get(tuple(words[i : i + 3]), []))
        best = {}
        for d, i in pairs:
            best[d, i] = max([3, *[n + min(3, i - y) for (x, y), n in best.items() if x < d and y < i]])
        assert leakage.Index([(1, " ".join(words))]).coverage(0, shingles) == max(best.values(), default=0) / len(words)


def test_blocks_find_every_near_fingerprint():
    import numpy as np

    rng = np.random.default_rng(1)
    index = leakage.Index([(1, " ".join(WORDS[:100])), (2, " ".join(WORDS[100:200]))])
    near = []
    for f in index.prints[:50]:
        for bits in range(5):
            x = f
            for b in rng.choice(64, bits, replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            near.append(x)
    near = np.array(near, np.uint64)
    found = {(a, b) for at, other in index.near(near) for a, b in zip(at.tolist(), other.tolist(), strict=True)}
    want = {(a, b) for a in range(len(near)) for b in range(len(index.prints)) if bin(int(near[a] ^ index.prints[b])).count("1") <= leakage.RADIUS}
    assert found == want


# 10 reading level


@pytest.fixture(scope="module")
def graded():
    return [(r.reading_level, r.text) for r in pd.read_parquet("/root/testdata/sf0.001/reading_samples.parquet").itertuples()]


def test_reading_levels_hold_out(graded, model):
    grades = reading.Grades(reading.fit([g for k, g in enumerate(graded) if k % 3]), model)
    held = graded[::3]
    right = sum(max(range(3), key=lambda k: grades.graded(text)[2][k]) == reading.LEVELS.index(level) for level, text in held)
    assert right >= 0.9 * len(held)


def test_levels_do_not_depend_on_the_words_before(graded, model, monkeypatch):
    frozen = reading.fit(graded)
    fresh = [reading.Grades(frozen, model).graded(text) for _, text in graded]
    monkeypatch.setattr(reading, "CACHED_WORDS", 150)  # the cache fills up within texts again and again
    worn = reading.Grades(frozen, model)
    assert [worn.graded(text) for _, text in graded] == fresh


def test_long_sentences_follow_the_rule_of_short_ones(graded, model):
    grades = reading.Grades(reading.fit(graded), model)
    basic = " ".join(w for level, text in graded if level == "basic" for w in reading.level_words(text))
    words = basic.split()[:400]
    for n in (40, 59, 60, 61, 62, 120, 400):
        assert grades.graded(" ".join(words[:n]))[2][0] > 0.8
    advanced = next(text for level, text in graded if level == "advanced")
    mixed = " ".join(words[:61]) + " " + " ".join(reading.level_words(advanced)[:30])  # no mark at all
    shares = grades.graded(mixed)[2]
    assert shares[0] > 0.5 > shares[2] > 0.2


def test_lines_are_sentences_and_wrapped_lines_are_not(graded, model):
    grades = reading.Grades(reading.fit(graded), model)
    assert grades.graded("The box was wet\nHe came on time")[0] == 8
    assert len([t for t in reading._TOKEN.findall("The box was wet\nHe came\non time") if not t[0].isalnum()]) == 1


def test_reading_edges(spark):
    samples = spark.read.parquet("/root/testdata/sf0.001/reading_samples.parquet")
    basic = samples.where("reading_level = 'basic'").first().text
    df = spark.createDataFrame([(1, basic, "s", "x"), (2, None, "s", "x"), (3, "", None, "x"), (4, "Too short.", "s", "x"), (5, "मुझे बताइए कि यह कब तक मिलेगा। " * 20, "s", "x"), (1, basic, "s", "x"), (6, basic.replace(".", ""), None, "x")], "doc_id bigint, text string, source string, lang string")
    got = sorted((r.doc_id, r.reading_level) for r in reading.english_levels(df, samples).collect())
    assert got == [(1, "basic"), (1, "basic"), (6, "basic")]
    assert {(r.source, r.documents, r.basic) for r in reading.source_profile(df, samples).collect()} == {("s", 2, 1.0), (None, 1, 1.0)}
    assert reading.english_levels(df.limit(0), samples).count() == 0 and reading.english_levels(df, samples.limit(0)).where("words > 1000000").count() == 0
