from pyspark.sql import functions as F

from textloom.operators import models


def test_personal_model(spark):
    rows = [("spam", "win a big prize now"), ("spam", "win prizes now now"), ("ham", "see you at lunch today"), ("ham", "lunch at noon"), (None, "x"), ("ham", None)]
    df = spark.createDataFrame(rows, "label string, text string")
    assert models.personal_model(df.where("label = 'ham'")) is None and models.personal_model(df.limit(0)) is None
    made = models.personal_scores(models.personal_model(df), spark.createDataFrame([("win the prize",), ("at lunch",), (None,)], "text string")).collect()
    assert [r.decision.label for r in made] == ["spam", "ham"]


def test_text_classifier(spark):
    rows = [("a", "red apple"), ("a", "apple pie"), ("b", "blue car"), ("b", "fast car"), ("c", "green tea"), ("c", "tea cup")]
    df = spark.createDataFrame(rows, "label string, text string")
    model = models.text_classifier(df, 1 << 10)
    assert [r.prediction for r in model.transform(df).orderBy("label").collect()] == [0, 0, 1, 1, 2, 2]


def test_decisions_and_han(spark):
    df = spark.createDataFrame([([0.2, 0.7, 0.1], "你 好 [人名] ok"), ([0.4, 0.4, 0.2], None)], "p array<double>, t string")
    r = df.select(models.decided(F.col("p"), ["x", "y", "z"]).alias("d"), models.unspaced_han(F.col("t"), {"[人名]": "王"}).alias("t")).collect()
    assert (r[0].d.label, r[0].d.accepted, r[0].t) == ("y", True, "你好王 ok") and (r[1].d.label, r[1].d.accepted, r[1].t) == ("x", False, None)


def test_word_pieces(spark):
    v = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##want", "##ed", "run", "!", "好", "cafe"])}
    df = spark.createDataFrame([("Unwanted run!",), ("好 Café zzz",), (None,)], "t string")
    got = [r.r for r in df.select(models.word_pieces(spark, v, 8)("t").alias("r")).collect()]
    assert got[0].ids == [2, 4, 5, 6, 7, 8, 3, 0] and got[0].word == [-1, 0, 0, 0, 1, 2, -1, -1] and got[0].start[4] == 9
    assert got[1].ids[:5] == [2, 9, 10, 1, 3] and got[2].ids == [2, 3, 0, 0, 0, 0, 0, 0] and got[0].mask == [1] * 7 + [0]
