"""Rules against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import naming as nm
from corpusmill.functions import phonemes as ph
from corpusmill.functions import syllables as sy
from corpusmill.functions import text as tx
from corpusmill.functions import turkish as tr


def each(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


NUMBERS = {"0": "sıfır", "10": "on", "11": "onbir", "100": "yüz", "101": "yüzbir", "200": "ikiyüz", "1000": "bin", "1919": "bindokuzyüzondokuz", "2500": "ikibinbeşyüz", "21000": "yirmibirbin", "1000000": "birmilyon", "007": "yedi", "1" + "0" * 21: " ".join(["bir"] + ["sıfır"] * 21)}


def test_numbers(spark):
    assert each(spark, NUMBERS, tr.number_words) == list(NUMBERS.values())


def test_ordinals(spark):
    want = {"3": "üçüncü", "11": "onbirinci", "20": "yirminci", "30": "otuzuncu", "40": "kırkıncı", "100": "yüzüncü", "104": "yüzdörtüncü", "106": "yüzaltıncı"}
    assert each(spark, want, tr.ordinal_words) == list(want.values())


def test_spoken_numbers(spark):
    want = {0: "sıfır", 1000: "bin", 1100: "bin yüz", -21: "eksi yirmi bir", 2000000: "iki milyon", 10**15: "1000000000000000"}
    assert each(spark, want, tr.spoken_number, "long") == list(want.values())


def test_wordify_turkish(spark):
    want = {"19.05.1919'da 2.500 kişi Samsun'a çıktı.": "ondokuz mayıs bindokuzyüzondokuz'da ikibinbeşyüz kişi Samsun'a çıktı.", "5. sınıf": "beşinci sınıf", "14:30": "ondörtotuz", "3.14": "üçondört", "12abc": "oniki abc", "": ""}
    assert each(spark, want, tr.wordify) == list(want.values())
    assert each(spark, ["Dr. Ali vb. geldi"], lambda c: tr.wordify(c, True)) == ["doktor Ali ve benzeri geldi"]


def test_normalize_turkish(spark):
    text = "19.05.1919'da 2.500 kişi Samsun'a çıktı."
    assert each(spark, [text], lambda c: tr.normalize(c, wordified=True)) == ["ondokuz mayıs bindokuzyüzondokuz'da ikibinbeşyüz kişi samsun'a çıktı ."]
    assert each(spark, ["IĞDIR İzmir", "a... b"], tr.normalize) == ["ığdır izmir", "a ... b"]
    assert each(spark, ["ılık iz"], lambda c: tr.normalize(c, to_upper=True)) == ["ILIK İZ"]


def test_normalize_western(spark):
    assert each(spark, ["Dr. Smith paid $5."], lambda c: tx.normalize_english(tx.wordify_english(c, True))) == ["doctor smith paid dollars 5 ."]
    assert each(spark, ["Hello,world! It's 3.14 (ok)"], tx.normalize_english) == ["hello , world ! it's 3.14 ( ok )"]
    assert each(spark, ["¿Sra. López?"], lambda c: tx.normalize_spanish(tx.wordify_spanish(c, True))) == ["¿ señora lópez ?"]


def test_composition(spark):
    assert each(spark, ["éa", "é", "a b", None], tx.nfc) == ["éa", "é", "a b", None]
    assert each(spark, ["a  b\n"], tx.normalize_universal) == ["a b"]


def test_syllables(spark):
    want = "mer-ha-ba i-stan-bul türk-çe e-ski-şe-hir an-tren-man ma-a-le-sef e-lek-trik dik-kat sa-at kon-trol ka-lem".split()
    got = each(spark, [w.replace("-", "") for w in want], sy.syllables)
    assert ["-".join(x) for x in got] == want
    assert each(spark, ["str", ""], sy.syllables) == [[], []]


@pytest.mark.parametrize("word", ["kalem", "Türkiye'den", "anntrop", "aaa", "qürk", "eğlenceli"])
def test_syllables_join_to_the_word(spark, word):
    (parts,), (clean,), (n,) = (each(spark, [word], f) for f in (sy.syllables, sy.clean, sy.count))
    assert "".join(parts) == clean and len(parts) == n


def test_stress(spark):
    want = {"kalem": "ka-'lem", "ankara": "'an-ka-ra", "evde": "'ev-de", "istanbul": "i-stan-'bul", "at": "'at"}
    assert ["-".join(x) for x in each(spark, want, lambda c: sy.add_stress(sy.syllables(c), c))] == list(want.values())


def test_harmony(spark):
    got = each(spark, ["okul", "elem", "kalem", "kitap", "str"], lambda c: sy.harmony(c)["valid"])
    assert got == [True, True, False, False, False]


def test_rhymes(spark):
    rows = spark.createDataFrame([("kalem", "elem"), ("kalem", "badem"), ("kalem", "okul")], "a string, b string")
    got = [r.n for r in rows.select(sy.matching_end(sy.syllables(F.col("a")), sy.syllables(F.col("b"))).alias("n")).collect()]
    assert got == [1, 0, 0]


def test_phonemes(spark):
    assert len(ph.VOCABULARY) == 49 and ph.VOCABULARY[:4] == ["<PAD>", "<UNK>", "<SOS>", "<EOS>"]
    assert each(spark, ["çağ, 3 ₺"], lambda c: ph.phoneme_string(ph.normalize(c))) == ["'chagh <PAUSE_SHORT> 'uech li-'ra"]
    (ids,) = each(spark, ["ch-a<PAUSE_LONG>X"], ph.to_ids)
    assert [ph.VOCABULARY[i] for i in ids] == ["ch", "-", "a", "<PAUSE_LONG>", "<UNK>"]
    assert each(spark, ["%5 12,50₺ 50% 14:30"], ph.normalize) == ["%beş on iki lira elli kuruş yüzde elli saat on dört otuz"]


def test_names(spark):
    rows = spark.createDataFrame([("Roman", "jean-paul SARTRE", "Şık gün!"), ("", "a", "b")], "g string, a string, t string")
    got = [r.x for r in rows.select(nm.document_name(F.col("g"), F.col("a"), F.col("t")).alias("x")).collect()]
    assert got == ["Roman-Jean_Paul_Sartre-Sik_Gun", nm.FILL_DOCUMENT]


def test_composing_filter_lets_nothing_through():
    """What the quick pattern leaves in the JVM is composed as it is, and joins nothing before it."""
    import re
    import unicodedata

    joining = {int(x, 16) for i in range(0x110000) for d in [unicodedata.decomposition(chr(i))] if d and d[0] != "<" for x in d.split()[1:] if int(x, 16) >= 0x300}
    maybe = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", tx._MAYBE))
    left = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not maybe.match(chr(c))]
    assert len(left) > 20_000
    assert not [c for c in left if unicodedata.normalize("NFC", chr(c)) != chr(c) or unicodedata.combining(chr(c)) or 0x300 <= c in joining and c < 0x3000]


def test_white_space_is_that_of_unicode(spark):
    every = "".join(chr(c) for c in range(0x3001) if not 0xD800 <= c < 0xE000)
    got = each(spark, [every], lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"(?U)\s"), F.lit(0)), ""))
    assert set(got[0]) == set(tx._SPACES)
    assert each(spark, ["\u2003 a \t\u00a0 b\u3000c  "], lambda c: tx.strip(tx.squeeze(c))) == ["a b c"]


def test_abbreviations_as_one_rule_after_another(spark):
    texts = ["Dr. Öz, PROF. x bkz.", "yrd. doç. dr. a", "m.s.a.v. dr.", "t.c.", "nodr. Kg.", "K\u212ag. İ", "vs.vs. no."]

    def chain(c):
        for short, long in sorted(tr.ABBREVIATIONS.items(), key=lambda x: -len(x[0])):
            c = F.regexp_replace(c, rf"(?iuU)\b{__import__('re').escape(short)}(?=\s|[.,!?]|$)", long)
        return c

    assert each(spark, texts, tr.expand_abbreviations) == each(spark, texts, chain)
