"""Language of each text and of each segment of a mixed text, with a confidence value.

Prediction by partial matching: per language, variable-order byte contexts within a word (its leading blank
starts the context) with escape probabilities (method C) give exact code lengths under frozen statistics. As
contexts end with the word, a word's code length in each language is computed once and reused; a segment costs
the sum of its words, and the cheapest language wins, unless a model of letter pairs that knows no language
(``Background``) is cheaper still: the segment is then in none of LANGUAGES and gets ``und``.

The statistics come from seed sentences and from a bounded sample of labelled rows (``SAMPLE_ROWS`` rows of at most
``SAMPLE_CHARS`` characters): of the sampled rows only those sentences count that the statistics of the round before
assign to the row's label; the first round goes by the seeds.

Defined results: a null, empty or wordless text has no segments and the language ``und`` with confidence 0; text in
no language of LANGUAGES is ``und`` with the confidence of that, and gives no row in ``relabelled``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions import fixed_values as V
from murmura.llm import personal
from murmura.llm.visible import visible

LANGUAGES = ("en", "ur-Latn", "ur", "hi", "tl", "es", "ar")
ORDER = 5
SAMPLE_ROWS = 3000  # most labelled rows that the fit reads, over all languages
SAMPLE_CHARS = 20_000  # longest text that may be in the sample
SENTENCE_WORDS = 4  # least words of a full sentence
OTHER_MARGIN = 1.15  # a language is given up where it costs this much more than none
ROUNDS = 2  # times that the sampled sentences are assigned anew
CACHED_WORDS = 1 << 19  # words whose code lengths a process keeps

# Seed sentences of each language.
SEEDS = {
    "en": "I bought this last week and it does not work at all. The man from the shop told us that we have to wait for two more days. Can you please tell me "
    "where to find a good one? We had been looking for it since the morning, but nobody would answer. It is not the same as the one that was here before. "
    "They should have said so when she asked them. You can keep it if you want, which is fine with me. What is the price of that and who is going to pay for it? "
    "After the rain there was no light in any of the rooms. My friend has a new one too, because his old one broke down. "
    "Thanks to everyone for the quick help, please reply only when you are serious. If it rains again tonight, we will stay at home and cook something for the children. "
    "The committee subsequently considered whether the proposed arrangements were consistent with its earlier decision, notwithstanding several reservations that had been expressed by members. "
    "Although the results of this study remain provisional, they suggest that responsibility for such failures cannot be attributed to a single institution. It has become increasingly apparent that "
    "those who depend upon public services are rarely consulted, and that measures intended to protect them are often inadequate. Under these circumstances, further investigation appears both necessary and urgent.",
    "ur-Latn": "Mujhe yeh cheez bilkul pasand nahi aayi aur ab main kya karun. Aap log kahan se lete hain aur kitne ka milta hai? Bhai jaan yeh kaam kab tak ho jaye ga. "
    "Hum ne kal dukan par ja kar poocha tha lekin us ne jawab nahi diya. Is ki qeemat bohat zyada hai, koi sasti wali batayein. Mera bhai keh raha tha ke agar "
    "bijli chali gayi to phir yeh nahi chale ga. Woh log sirf paise lete hain aur baad mein phone nahi uthate. Tum sab ko pata hai ke teri baat theek thi. "
    "Kya kisi ke paas purana hai to mujhe bata dein. Apni ghar ki tasveer bhejo. Ab tak wapas nahi mila, warna main khud le aata. Aaj barish ho rahi thi is liye bachay ghar par hi rahe. Agar tum subah jaldi uth jao to hum sab mil kar naashta karen ge. Shukriya sahab.",
    "ur": "مجھے یہ چیز بالکل پسند نہیں آئی اور اب میں کیا کروں۔ آپ لوگ کہاں سے لیتے ہیں اور کتنے کا ملتا ہے؟ ہم نے کل دکان پر جا کر پوچھا تھا لیکن اس نے جواب نہیں دیا۔ "
    "اس کی قیمت بہت زیادہ ہے، کوئی سستی والی بتائیں۔ میرا بھائی کہہ رہا تھا کہ اگر بجلی چلی گئی تو پھر یہ نہیں چلے گا۔ وہ لوگ صرف پیسے لیتے ہیں اور بعد میں فون نہیں اٹھاتے۔ "
    "کیا کسی کے پاس پرانا ہے تو مجھے بتا دیں۔ ابھی تک واپس نہیں ملا ہے۔ گرمی میں ٹھیک چل رہا ہے۔",
    "hi": "मुझे यह चीज बिल्कुल पसंद नहीं आई और अब मैं क्या करूं। आप लोग कहां से लेते हैं और कितने का मिलता है? हमने कल दुकान पर जाकर पूछा था लेकिन उसने जवाब नहीं दिया। "
    "इसकी कीमत बहुत ज्यादा है, कोई सस्ती वाली बताइए। मेरा भाई कह रहा था कि अगर बिजली चली गई तो फिर यह नहीं चलेगा। वे लोग सिर्फ पैसे लेते हैं और बाद में फोन नहीं उठाते। "
    "क्या किसी के पास पुराना है तो मुझे बता दें। अभी तक वापस नहीं मिला है।",
    "tl": "Hindi ko nagustuhan ang bagay na ito at hindi ko na alam ang gagawin ko. Saan po kayo bumibili at magkano po ba ito? Pumunta kami sa tindahan kahapon "
    "pero walang sumagot sa amin. Mahal masyado ang presyo, meron ba kayong mas mura? Sabi ng kapatid ko na kapag nawalan ng kuryente ay hindi na ito aandar. "
    "Kumukuha lang sila ng pera at pagkatapos ay ayaw nang sumagot. Kung may luma kayo, pakisabi naman sa akin. Salamat po sa inyong lahat, maganda talaga siya. "
    "Hanggang ngayon wala pa rin, kaya naghihintay lang kami sa bahay. Umulan kaninang umaga kaya hindi nakapasok ang mga bata sa paaralan. Pakidala mo mamaya ang mga gamit nila, dapat maayos na ang lahat bago tayo umalis. Huwag kayong mag-alala, tutulungan namin kayo.",
    "es": "No me gustó nada esta cosa y ahora no sé qué hacer. ¿Dónde la compran ustedes y cuánto cuesta? Ayer fuimos a la tienda pero nadie nos quiso contestar. "
    "El precio es demasiado alto, ¿hay alguna más barata? Mi hermano decía que si se va la luz entonces ya no funciona. Ellos solo cobran el dinero y después no "
    "responden las llamadas. Si alguien tiene uno viejo, por favor avíseme. Todavía no lo han devuelto, aunque lo pedí hace dos semanas. Muchas gracias a todos por "
    "la ayuda, está muy bien. Esta mañana llovió mucho, así que los niños se quedaron en casa. Te voy a decir lo que pasó cuando llegamos a la otra parte de la ciudad. Mándame la dirección esta noche y mañana te llevo todo.",
    "ar": "لم يعجبني هذا الشيء أبدا ولا أعرف ماذا أفعل الآن. من أين تشترون وكم السعر؟ ذهبنا أمس إلى المتجر لكن لم يجبنا أحد. السعر مرتفع جدا، هل يوجد شيء أرخص؟ "
    "قال أخي إنه إذا انقطعت الكهرباء فلن يعمل. هم يأخذون المال فقط ثم لا يردون على الهاتف. إذا كان عند أحدكم جهاز قديم فأخبروني من فضلكم. حتى الآن لم يصل الطلب وأنا في الانتظار منذ أسبوع. شكرا لكم على المساعدة.",
}
# Frequent words of each language.
FREQUENT = {
    "en": " ".join(V.ENGLISH),
    "ur-Latn": " ".join(V.ROMAN_URDU),
    "tl": " ".join(V.TAGALOG) + " na at o si ni kay nang may mga isang isa dalawa tatlo araw gabi oras bata tao babae lalaki bahay tubig pagkain bayan buhay lahat bawat ibang iba mula hanggang tungkol para dahil habang kapag noong "
    "nasa sa akin iyo kanya kanila inyo mo ko ka siyang akong kaming maging gawin ginawa sinabi nakita alam gusto kailangan dapat puwede pwede marami malaki maliit bago luma kahit muli",
    "es": "el la los las un una unos unas de del al a en con por para sin sobre entre hasta desde que como cuando donde quien cual y e o u pero sino porque si no ni ya también muy más menos tan tanto todo toda todos todas otro otra "
    "este esta estos estas ese esa eso aquel aquella lo le les se me te nos mi tu su sus mis yo él ella ellos ellas usted ustedes es son era eran fue fueron ser estar está están estaba hay había ha han he hemos tiene tienen tenía "
    "puede pueden hacer hace hizo decir dice dijo ir va van ver dar sabe quiere debe día días vez veces año años tiempo vida hombre mujer mundo casa parte lugar agua nada algo mismo misma cada mientras después antes ahora siempre nunca aquí allí así bien",
    "hi": "का के की को से में पर ने और या है हैं था थे थी हो होना होता होती होते हुआ हुई हुए यह वह ये वे इस उस इन उन इसे उसे जो जिस जब तब तो भी ही तक कि अगर लेकिन मगर क्योंकि मैं हम तुम आप मेरा मेरी हमारा अपना अपने अपनी एक दो कोई कुछ सब सभी बहुत "
    "कम ज्यादा बड़ा बड़ी छोटा नया पुराना अच्छा नहीं मत क्या कौन कब कहां कैसे क्यों कर करना करता करते किया गया गई गए जा जाना आया आई दिया लिया रहा रही रहे सकता सकते वाला वाले साथ बाद पहले अब आज कल दिन समय घर पानी लोग काम बात देश साल ऊपर नीचे",
    "ur": "کا کے کی کو سے میں پر نے اور یا ہے ہیں تھا تھے تھی ہو ہونا ہوتا ہوتی ہوا ہوئی ہوئے یہ وہ اس ان جو جس جب تب تو بھی ہی تک کہ اگر لیکن مگر کیونکہ ہم تم آپ میرا میری ہمارا اپنا اپنے اپنی ایک دو کوئی کچھ سب بہت کم زیادہ بڑا بڑی چھوٹا نیا پرانا اچھا نہیں "
    "مت کیا کون کب کہاں کیسے کیوں کر کرنا کرتا کرتے گیا گئی گئے جا جانا آیا آئی دیا لیا رہا رہی رہے سکتا سکتے والا والے ساتھ بعد پہلے اب آج کل دن وقت گھر پانی لوگ کام بات ملک سال اوپر نیچے",
    "ar": "من في على إلى عن مع هذا هذه ذلك تلك التي الذي الذين ما لا لم لن قد كان كانت يكون تكون كل بعض غير بين بعد قبل عند حتى إذا إن أن أنا نحن أنت هو هي هم كما لكن أو ثم أي أين متى كيف لماذا ليس هناك هنا حيث منذ خلال حول تحت فوق أكثر أقل جدا يوم اليوم "
    "أمس غدا سنة وقت بيت ماء ناس رجل امرأة عمل كلام بلد جديد قديم كبير صغير جيد كثير قليل واحد اثنان قال يقول ذهب جاء رأى عرف أراد يمكن يجب والله وقد وكان ولا وهو وهي فيه منه عليه له لها لهم به بها",
}
# Other spellings of the language codes.
SPELLINGS = {
    "en": "en eng english en-us en-gb en-in en-au en-ca", "ur-Latn": "ur-latn roman-urdu romanurdu urdu-latn urdu-roman ur-roman", "ur": "ur urd urdu ur-pk ur-in ur-arab",
    "hi": "hi hin hindi hi-in hi-deva", "tl": "tl tgl tagalog fil filipino tl-ph fil-ph", "es": "es spa spanish español espanol castellano es-mx es-es es-ar es-co es-us es-419",
    "ar": "ar ara arabic ar-sa ar-eg ar-ae ar-001",
}
_CODE = {spelling: code for code, names in SPELLINGS.items() for spelling in names.split()}

_SPLIT = re.compile(r"(?:(?<=[.!?؟।۔…])(?<!\bno\.)(?<!\bNo\.)(?<!\bNO\.)(?<!\bst\.)(?<!\bSt\.)(?<!\bST\.)[\"'”’)\]]*\s+|\n+)")
_CODED = re.compile(r"(?<!\S)[^\s\d@#/_]*+[\d@#/_]\S*")
_ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?[ً-ٕऀ-ःऺ-ॏ]*(?:[^\W\d_]*[ً-ٕऀ-ःऺ-ॏ]*)*")


def label_code(label: str | None) -> str | None:
    """The code that a label names, whatever its spelling; the label itself if it names none of LANGUAGES; else null."""
    if label is None or not (tidy := label.strip()):
        return None
    return _CODE.get(re.sub(r"[_ ]+", "-", tidy.lower()), tidy.lower())


def sentences(text: str) -> list[str]:
    return [s for s in _SPLIT.split(text) if s.strip()]


def words(segment: str) -> list[str]:
    """Lower-case words of two letters or more; codes, numbers, tags and links are none."""
    low = _CODED.sub(" ", segment).lower()
    found = _ASCII_WORD.findall(low) if low.isascii() else _WORD.findall(low)
    return [w for w in found if len(w) > 1 or w in "aeiouyو"]


class Coder:
    """Frozen context statistics of one language; ``bits`` gives the code length of a word."""

    def __init__(self, counts: Counter[str]) -> None:
        tree: dict[bytes, dict[int, int]] = defaultdict(dict)
        for word, n in counts.items():
            data = b" " + word.encode() + b" "
            for k in range(1, len(data)):
                for order in range(min(k, ORDER) + 1):
                    nexts = tree[data[k - order : k]]
                    nexts[data[k]] = nexts.get(data[k], 0) + n
        self._tree = {context: (nexts, sum(nexts.values()), len(nexts)) for context, nexts in tree.items()}

    def bits(self, word: str) -> float:
        data, total = b" " + word.encode() + b" ", 0.0
        for k in range(1, len(data)):
            p = 1.0
            for order in range(min(k, ORDER), -1, -1):
                known = self._tree.get(data[k - order : k])
                if known is None:
                    continue
                nexts, seen, kinds = known
                if n := nexts.get(data[k]):
                    p *= n / (seen + kinds)
                    break
                p *= kinds / (seen + kinds)
            else:
                p /= 256
            total -= math.log2(p)
        return total


class Background:
    """What a word costs without any language: letter pairs of all languages together, other letters evenly.

    As every language's own coder beats it on that language, it wins only where none of them fits.
    """

    LETTER = 6.0  # bits of a letter that no seed has: about the size of an alphabet

    def __init__(self, counts: dict[str, Counter[str]]) -> None:
        pairs: dict[str, Counter[str]] = defaultdict(Counter)
        for words_of in counts.values():
            for word, n in words_of.items():
                marked = f" {word} "
                for a, b in zip(marked, marked[1:], strict=False):
                    pairs[a][b] += n
        self._bits = {a: {b: -math.log2(n / (sum(c.values()) + len(c))) for b, n in c.items()} for a, c in pairs.items()}
        self._escape = {a: math.log2((sum(c.values()) + len(c)) / len(c)) + self.LETTER for a, c in pairs.items()}

    def bits(self, word: str) -> float:
        total, last = 0.0, " "
        for c in f"{word} ":
            after = self._bits.get(last)
            total += self.LETTER if after is None else after[c] if c in after else self._escape[last]
            last = c
        return total


class Model:
    """All languages' coders and the background with a cache of word code lengths."""

    def __init__(self, counts: dict[str, Counter[str]]) -> None:
        self._coders = [Coder(counts[code]) for code in LANGUAGES]
        self._background = Background(seed_counts())
        self._row: dict[str, int] = {}
        self._costs = np.zeros((1024, len(LANGUAGES) + 1))

    def costs(self, tokens: list[str]) -> np.ndarray:
        """Code length in bits of the tokens in each language, and without one last."""
        if len(self._row) >= CACHED_WORDS:  # between texts only: row numbers taken before would go astray
            self._row.clear()
        known, at = self._row.get, []
        for t in tokens:
            n = known(t)
            at.append(self._added(t) if n is None else n)
        return self._costs[at].sum(axis=0)

    def _added(self, word: str) -> int:
        at = self._row[word] = len(self._row)
        if at >= len(self._costs):
            self._costs = np.vstack([self._costs, np.zeros_like(self._costs)])
        self._costs[at] = self.word_costs(word)
        return at

    def word_costs(self, word: str) -> list[float]:
        """Exact code lengths of one word, and OTHER_MARGIN times that of the background."""
        return [*[c.bits(word) for c in self._coders], OTHER_MARGIN * self._background.bits(word)]

    def best(self, tokens: list[str]) -> tuple[str, float]:
        """The cheapest language and its posterior, at one bit in four so that long segments do not saturate."""
        return self.verdict(self.costs(tokens)) if tokens else ("und", 0.0)

    @staticmethod
    def verdict(bits: np.ndarray) -> tuple[str, float]:
        at = int(bits.argmin())
        return (LANGUAGES[at] if at < len(LANGUAGES) else "und"), float(1 / np.exp2((bits[at] - bits) / 4).sum())

    def segments(self, text: str | None) -> list[tuple[str, float, str, int]]:
        """(language, confidence, segment, words) of each stretch of sentences in one language, in order."""
        out: list[tuple[str, float, str, int]] = []
        for s in sentences(text or ""):
            if tokens := words(s):
                code, sure = self.best(tokens)
                if len(tokens) < SENTENCE_WORDS and out:
                    code = out[-1][0]
                if out and out[-1][0] == code:
                    before = out.pop()
                    n = before[3] + len(tokens)
                    out.append((code, (before[1] * before[3] + sure * len(tokens)) / n, f"{before[2]} {s}", n))
                else:
                    out.append((code, sure, s, len(tokens)))
        return out

    def sentence_languages(self, text: str) -> set[str]:
        """Languages with at least one full sentence in text, read in its visible form.

        A full sentence has SENTENCE_WORDS words, and one of them is frequent in its language: a row of names,
        codes and measures has none.
        """
        found: set[str] = set()
        for s in sentences(visible(text)):
            tokens = words(s)
            if len(tokens) >= SENTENCE_WORDS and (code := self.best(tokens)[0]) not in found and code != "und" and not common_words()[code].isdisjoint(tokens):
                found.add(code)
        return found

    def clear_languages(self, text: str, label: str | None) -> set[str]:
        """``sentence_languages`` without personal data; it is masked only where it could change the answer."""
        first = self.sentence_languages(text)
        return first if first <= {label} else self.sentence_languages(_MASK.sub("\n", personal.redact(text)[0]))


#: A placeholder, with the words that only name the kind of number before it; it parts the sentence around it.
_MASK = re.compile(rf"(?:(?:\b(?:{personal.ID_WORDS}|card|no|number|driving)\b[\s.:#]*)*)\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME|CARD|ACCOUNT)\]", re.I)


def seed_counts() -> dict[str, Counter[str]]:
    return {code: Counter(words(f"{text} {FREQUENT[code]}")) for code, text in SEEDS.items()}


@lru_cache(maxsize=1)
def common_words() -> dict[str, frozenset[str]]:
    """The words of each language's seeds."""
    return {code: frozenset(c) for code, c in seed_counts().items()}


@lru_cache(maxsize=4)
def model_of(frozen: tuple) -> Model:
    """The model of frozen counts; built once in each process."""
    return Model({code: Counter(dict(pairs)) for code, pairs in frozen})


def freeze(counts: dict[str, Counter[str]]) -> tuple:
    return tuple((code, tuple(sorted(counts[code].items()))) for code in LANGUAGES)


def _base(known: dict[str, list[str]]) -> dict[str, Counter[str]]:
    counts = seed_counts()
    for code, c in counts.items():
        for w in c:
            c[w] *= 3
        for t in known.get(code, ()):
            c.update(words(t))
    return counts


def fit(rows: DataFrame, text: str = "text", label: str = "language", key: str = "item_id", sample_rows: int = SAMPLE_ROWS, known: dict[str, list[str]] | None = None) -> tuple:
    """Frozen counts from the seeds, known texts by language and at most sample_rows labelled rows, those with the smallest hash of key."""
    # A language's share of the sample is bounded on its own, so that the rare ones are seen too.
    share = sample_rows // len(LANGUAGES)
    part = rows.where(F.lower(label).isin([c.lower() for c in LANGUAGES]) & (F.length(text) <= SAMPLE_CHARS))
    part = part.select(F.lower(label).alias("l"), F.col(text).alias("t"), F.xxhash64(key).alias("h"))
    tops = part.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("k") <= share)
    codes = {c.lower(): c for c in LANGUAGES}
    sample = [(codes[lower], tokens) for lower, t in tops.select("l", "t").collect() for s in sentences(t) if len(tokens := words(s)) >= SENTENCE_WORDS]
    counts = _base(known or {})
    for _ in range(ROUNDS):
        model, counts = Model(counts), _base(known or {})
        for code, tokens in sample:
            if LANGUAGES[int(model.costs(tokens)[:-1].argmin())] == code:
                counts[code].update(tokens)
    return freeze(counts)


LANGUAGE = T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())])
SEGMENTS = T.ArrayType(T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("segment", T.StringType())]))


def segments_column(text: Column, frozen: tuple) -> Column:
    """Array of struct(language, confidence, segment) of a text column."""

    @F.pandas_udf(SEGMENTS)
    def run(values: pd.Series) -> pd.Series:
        model = model_of(frozen)
        return pd.Series([[{"language": c, "confidence": p, "segment": s} for c, p, s, _ in model.segments(v)] for v in values], dtype=object)

    return run(text)


def language_column(text: Column, frozen: tuple) -> Column:
    """struct(language, confidence) of a text column as a whole; ``und`` with 0 for wordless text."""

    @F.pandas_udf(LANGUAGE)
    def run(values: pd.Series) -> pd.DataFrame:
        model = model_of(frozen)
        return pd.DataFrame([model.best(words(v or "")) for v in values], columns=["language", "confidence"])

    return run(text)


def relabelled(rows: DataFrame, frozen: tuple, key: str = "item_id", text: str = "text", label: str = "language") -> DataFrame:
    """key, language: for rows whose label is missing or wrong, and for mixed texts, each language with a full sentence."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series, labels: pd.Series) -> pd.Series:
        model, out, known = model_of(frozen), [], {}
        for t, l in zip(texts, labels, strict=True):
            if (t, l) not in known:
                found, code = (model.clear_languages(t, label_code(l)) if t else set()), label_code(l)
                known[t, l] = sorted(found) if len(found) > 1 or (found and code not in found) else []
            out.append(known[t, l])
        return pd.Series(out, dtype=object)

    return rows.select(key, F.explode(run(F.col(text), F.col(label))).alias("language"))
