import difflib
import random
import unicodedata

from pyspark.sql import functions as F

from textloom.functions import text as X


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_languages(spark):
    texts = ["こんにちは", "안녕하세요", "สวัสดี", "您的验证码", "Привет", "le colis est pour vous", "und das ist für sie", "hello there", "", None, "你好 です"]
    assert column(spark, texts, X.detect_language) == ["ja", "ko", "th", "zh", "ru", "fr", "de", "en", "en", None, "ja"]
    assert column(spark, ["en_US", "cmn-Hans", "JPN", "xx", None], X.language_hint) == ["en", "zh", "ja", "unknown", "unknown"]


def test_junk_reasons(spark):
    texts = ["short", "x " * 400, "!!!! ???? ....", "a" * 30, "oneword99", "{{CODE}} {{URL}}", "a plain message of words", None]
    got = column(spark, texts, lambda t: X.junk_reason(t, F.lit("en")))
    assert got == ["too-short", "too-long", "low-information", "repetitive", "too-few-words", "placeholder-only", None, None]
    assert column(spark, ["验证码您好请查收吧"], lambda t: X.junk_reason(t, F.lit("zh"))) == [None]


def test_signatures(spark):
    near = column(spark, ["Pay 12 EUR now!", "pay 9999 eur  NOW", "验证码 123_a"], X.near_signature)
    assert near[0] == near[1] == "pay0eurnow" and near[2] == "验证码0a"
    a = "[Shop] Your code AB12345678 at https://x.io/1 reply STOP to end"
    b = "[Other] Your code ZZ99999999 at https://y.io/22 reply stop"
    made = column(spark, [a, b, "Your parcel is here", "ＦＵＬＬ ｗｉｄｔｈ", "full width", "état civil de là-bas", None], X.template_signature)
    assert made[0] == made[1] != made[2] and made[3] == made[4] and made[5] == "étatcivildelàbas" and made[6] is None
    assert column(spark, ["é  x \n y"], X.normalize) == [unicodedata.normalize("NFC", "é") + " x y"]


def test_similarity(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c1") for _ in range(rng.randint(0, 30))) for _ in range(50)] + ["ü😀x", "", "ab"]
    got = column(spark, texts, X.shingles)
    assert [set(g) for g in got] == [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    df = spark.createDataFrame([("abcd", "abxd"), (None, "a")], "a string, b string")
    rows = df.select(X.semantic_change("a", "b").alias("v")).collect()
    assert rows[0].v == 1 - difflib.SequenceMatcher(None, "abcd", "abxd").ratio() and rows[1].v is None


def test_rehydration_is_stable(spark):
    texts = ["Call {{PHONE}} or {{EMAIL}}, {{UNKNOWN}}", "no tokens", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.rehydrate("t", F.lit("en")).alias("v"))
    one, two = ([r.v for r in df.orderBy("i").collect()] for _ in range(2))
    assert one == two and "{{PHONE}}" not in one[0] and "{{UNKNOWN}}" in one[0] and one[1:] == texts[1:]


def test_small_functions(spark):
    assert column(spark, ["79927398713", "79927398710", "abc", None], X.luhn) == [True, False, False, False]
    assert column(spark, [" +1-555 01 ", None], X.sender) == ["+155501", None]
    df = spark.createDataFrame([("aXbXc", "X", "_"), ("abc", "X", "_")], "t string, o string, n string")
    assert [r.v for r in df.select(X.replace_first(F.col("t"), F.col("o"), F.col("n")).alias("v")).collect()] == ["a_bXc", "abc"]
    assert column(spark, ["17.4", "18", "2.10.1", "bad"], lambda v: X.version_at_least(v, F.lit("17.5"))) == [False, True, False, False]
    assert column(spark, ["a/b.txt", "../x", "/abs", "a//b", "", None], X.is_safe_path) == [True, False, False, False, False, False]
    v = column(spark, ["hello", "", None], X.hashed_ngrams)
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and not any(v[1]) and v[2] is None
    assert column(spark, ["a"], X.fnv64)[0] == X.fnv1a(b"a")


def test_normal_forms_equal_python(spark):
    texts = ["plain", "é composed", "e\u0301 combined", "\u212b ngström", "ﬁ ligature", "가 \u1100\u1161", "½ ² ª", "\u0958 \u09dc", "か\u3099", "\u2126 \ufb1d", "\U0002f800", None, ""]
    assert column(spark, texts, X.nfc) == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
    every = [chr(c) for c in range(0x20, 0x2FFFF, 7) if not 0xD800 <= c < 0xE000]
    assert column(spark, every, X.nfc) == [unicodedata.normalize("NFC", t) for t in every]
    low = [unicodedata.normalize("NFKC", t) for t in every]
    got = column(spark, every, lambda t: X._normal(t, X._SOME_COMPATIBLE, X._COMPATIBLE, X._nfkc))
    assert got == low


def test_names_and_check_digits(spark):
    assert column(spark, ["Spoken English (US)", "MANDARIN", "Klingon", None], X.language_name) == ["en", "zh", None, None]
    assert column(spark, ["11010519491231002", "1101051949123100", None], X.id_check_digit) == ["X", None, None]


def test_ngrams_equal_loops():
    import numpy as np

    for text in ("", "a", "ab", "hello wörld 你好 😀!", "x" * 300):
        out = np.zeros(64)
        for n in (2, 3, 4):
            for i in range(len(text) - n + 1):
                out[X.fnv1a(text[i : i + n].encode()) % 64] += 1
        out[X.fnv1a(b"flag:1") % 64] = 1
        assert np.allclose(X.ngram_vector(text, (False, True), 64), out / np.sqrt((out * out).sum()))
