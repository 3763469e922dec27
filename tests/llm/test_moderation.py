"""Moderation: disguises, held-out sentences in every category, edge cases."""

import pandas as pd
import pytest

from murmura.llm import moderation, moderation_words

SAMPLES = "/root/testdata/sf0.001/moderation_samples.parquet"
LONG = "The pump makes a noise. " * 4000

# Sentences that are neither in the training sentences nor in the tables.
HELD_OUT = """
abuse | What a complete dunce you are, my friend.
abuse | You lot are a bunch of shameless cheats and halfwits.
abuse | I'll smash your teeth in if you call again.
abuse | Go and hang yourself, weasel.
abuse | Your mother is a whore.
abuse | Nobody would miss you if you were gone.
abuse | Shut up, birdbrain.
abuse | He is a spineless twat and his brother is a wanker.
abuse | What a dipsh1t!
abuse | You b!tch, I will find you and strangle you.
abuse | s.t.u.p.i.d m0r0ns, all of you
abuse | Tum sab nalayak aur besharam ho.
abuse | Teri gardan kaat doonga kamine.
abuse | Abey ullu, muh band rakh.
abuse | Eres una zorra mentirosa.
abuse | Te voy a reventar la cabeza, payaso.
abuse | Largate de aqui, subnormal.
abuse | Walanghiya ka, sasapakin kita.
abuse | Ang engot mo naman.
abuse | تم سب بیوقوف ہو، دفع ہو جاؤ۔
abuse | तुम सब बेशर्म और नालायक हो।
abuse | انت حيوان وكذاب.
hate | Refugees are cockroaches, send them back or burn them.
hate | That clan is a plague, wipe them out.
hate | Never serve those filthy foreigners.
hate | All gypsies are thieves and should be expelled.
hate | People of that religion are savages.
hate | Lynch every one of those migrants.
hate | Yeh muhajir sab chor hain, in ko bhagao.
hate | Esos extranjeros son una plaga, hay que echarlos.
hate | Ang mga dayuhan ay salot, itaboy silang lahat.
hate | یہ قوم گندی ہے، سب کو نکالو۔
hate | ये लोग कीड़े हैं, सबको भगाओ।
hate | هؤلاء المهاجرين حشرات، اطردوهم.
sexual | Free p0rn clips, click now.
sexual | I want you naked in my bed.
sexual | Hookup tonight? Kiss me and lick me all over.
sexual | Topless cam girls live.
sexual | Big cock for you, babe.
sexual | Apni nangi video bhejo jaan.
sexual | Te quiero besar desnuda, estoy cachondo.
sexual | Gusto kong halik at kantot mamaya.
sexual | ننگی ویڈیو بھیجو۔
sexual | नंगी वीडियो भेजो।
sexual | صور عارية للبيع.
none | The motor is dead and nobody picks up the phone.
none | I will kill the breaker and cut the wire tomorrow.
none | This fan sounds like a dying cow.
none | Is the bare copper safe to touch?
none | Their dogs bark all night and the rats eat the insulation.
none | Worst service ever, a waste of money.
none | Support never answers, the manager is rude.
none | The hot plate burned my hand, be careful with your fingers.
none | Please send pictures of your roof and a video of the meter.
none | The doctor removed a lump from her breast.
none | All people in our community welcome the new families.
none | Foreigners pay the same price as everyone.
none | Hit the reset button and beat the dust out of the filter.
none | You are right, it is a stupid design.
none | What a shame, your battery died.
none | The dick smith store has this cable in stock.
none | No pets, no smoking, no returns.
none | My cock crows at five, the hens sleep under the panel.
none | Sab log kehte hain yeh battery achi hai.
none | Kutta taar chaba gaya, ab kya karun?
none | El perro se comio el cable otra vez.
none | Todos los extranjeros pagan lo mismo.
none | Kinagat ng aso ang kable.
none | بجلی نے ہاتھ جلا دیا۔
none | कुत्ते ने तार काट दी।
none | الكلب قطع السلك.
"""


@pytest.fixture(scope="module")
def weights(spark):
    return moderation.fit(spark.read.parquet(SAMPLES))


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("You are a m0r0n", "abuse"), ("Shut up you s.c.u.m.b.a.g, go away", "abuse"), ("What an answer from a b*****d like you", "abuse"), ("You are a moroooon", "abuse"), ("You are a mоrоn", "abuse"),
        ("Eres un 1mbec1l", "abuse"), ("All of them are subhuman trash", "hate"), ("Send me your nud3s tonight", "sexual"), ("Even an idiot-proof manual fails", None), ("Strip the naked wire first", None), ("dumbf4ck", "abuse"),
        ("It is a dumb meter", None), ("The rats chewed the cable", None), ("I hate this fan, it is loud", None), ("A killer price, terrible service", None), ("", None), (None, None), ("🌞 12345", None), (LONG, None),
        ("The prick of a needle hurt; penis cancer clinic open", None), ("This idiot switch is stuck, stupid worthless panel, your support is shit", None), ("تم ایک ک*ینے ہو", "abuse"), ("تو ک.م.ی.ن.ہ ہے", "abuse"), ("तू कमीीीीना है", "abuse"),
    ],
)
def test_moderation(weights, text, category):
    assert moderation.category(moderation.scores(text, weights)) == category


def test_held_out_sentences(weights):
    rows = [tuple(p.strip() for p in line.split("|", 1)) for line in HELD_OUT.strip().splitlines()]
    training = {t.split("|", 1)[1].strip() for t in moderation_words.TRAINING.strip().splitlines()} | set(pd.read_parquet(SAMPLES).text)
    assert not training & {t for _, t in rows}
    found = [(want, moderation.category(moderation.scores(t, weights))) for want, t in rows]
    for category in moderation.CATEGORIES:
        flagged = [f is not None for want, f in found if want == category]
        assert sum(flagged) >= 0.9 * len(flagged), category
        named = [want for want, f in found if f == category]
        assert named.count(category) >= 0.85 * len(named), category
    assert sum(want != "none" for want, f in found if f) >= 0.9 * sum(f is not None for _, f in found)


@pytest.mark.parametrize("token", ["stu" + "u" * 30 + "pid", "s" * 50 + "tupid", "st" + "u-" * 40 + "upid", "i" * 12 + "d" * 12 + "i0" + "t" * 20, "m*r*n", "id**t", "m0r*n", "$tup1d"])
def test_disguised_words_of_any_length(token):
    assert moderation.restored(token) in ("stupid", "idiot", "moron")


@pytest.mark.parametrize("word", ["pr1ce", "n1ght", "b0ught", "m0ther", "w0rk", "*orking", "peop1e", "cuest@", "h@bía"])
def test_common_words_are_restored_too(word):
    made = moderation.restored(moderation.plain(word))
    assert made.isalpha() and made != word
    assert not moderation.word_classes(made) & moderation.CORE


def test_decoding_finds_the_best_path():
    # Against all paths of small lattices.
    from itertools import product

    model, _ = moderation.letters()
    for core in ("f*k", "1d1ot", "m0r*n", "a@b", "s+up1d", "k*m"):
        lattice = [moderation._readings(c, moderation._alphabet(core)) for c in core]
        every = []
        for path in product(*lattice):
            bits, done = 0.0, "^"
            for letter, cost in path:
                bits += cost + (model.bits(done[-moderation.ORDER :], letter) if letter else 0)
                done += letter
            every.append((bits + model.bits(done[-moderation.ORDER :], "$"), done[1:]))
        assert moderation.decoded(core)[0] == pytest.approx(min(every)[0])


def test_long_tokens_that_stand_for_no_word():
    for token in ("ab" * 20_000 + "!", "a.b" * 10_000 + "@", "q*" * 60, "*" * 200, "$20k", "xr-4512", "12kg", "#solar"):
        assert moderation.restored(token) == token


def test_moderation_tables(spark, weights):
    df = spark.createDataFrame([("a", "g", "You are a moron", "x"), ("b", "g", "fine", "x"), ("c", None, None, "x"), ("c", None, None, "x")], "item_id string, group_name string, text string, s string")
    assert {r.item_id for r in moderation.scored(df, weights).where(f"score >= {moderation.THRESHOLD}").collect()} == {"a"} and moderation.scored(df, weights).count() == 4
    assert {(r.group_name, r.texts, r.flagged, r.abuse) for r in moderation.rates(df, weights).collect()} == {("g", 2, 1, 1), (None, 2, 0, 0)}
    assert moderation.rates(df.limit(0), weights).count() == 0
    assert len(moderation.fit(spark.read.parquet(SAMPLES).limit(0))) == len(moderation.CATEGORIES) + 1
