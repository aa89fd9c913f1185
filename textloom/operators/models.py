"""Trained text classifiers, their decisions, and word pieces."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.functions import text as X

#: Least confidence of a decision, by the kind of model.
THRESHOLDS = {"classic": 0.62, "transformer": 0.5, "personal": 0.7}


def decided(probabilities: Column, labels: Sequence[str], kind: str = "classic") -> Column:
    """struct(label, confidence, accepted) of the likeliest label, the first of equals."""
    best = F.array_max(probabilities)
    label = F.element_at(F.array(*map(F.lit, labels)), F.array_position(probabilities, best).cast("int"))
    return F.struct(label.alias("label"), best.alias("confidence"), (best >= THRESHOLDS[kind]).alias("accepted"))


def personal_model(samples: DataFrame, dims: int = 512):
    """Logistic regression on hashed character n-grams of a user's samples (label, text); None under two samples or two labels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    rows = samples.where("label is not null and text is not null")
    n, labels = rows.agg(F.count("*"), F.count_distinct("label")).first()
    if n < 2 or labels < 2:
        return None
    made = rows.withColumn("features", array_to_vector(X.hashed_ngrams("text")))
    return Pipeline(stages=[StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), LogisticRegression(labelCol="y", maxIter=80, regParam=0.01, tol=0.01)]).fit(made)


def personal_scores(model, messages: DataFrame) -> DataFrame:
    """messages with decision, by the personal model."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    labels = model.stages[0].labels
    made = model.stages[1].transform(messages.where("text is not null").withColumn("features", array_to_vector(X.hashed_ngrams("text"))))
    return made.withColumn("decision", decided(vector_to_array("probability"), labels, "personal")).drop("features", "rawPrediction", "probability", "prediction")


def text_classifier(rows: DataFrame, features: int = 1 << 18):
    """Multinomial logistic regression (maximum entropy) on words of rows (label, text): hashed counts, weighted by rarity. All stages are distributed."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    stages = [
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[\p{L}\p{N}]+", gaps=False),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol="y", family="multinomial", maxIter=50, regParam=1e-3),
    ]
    return Pipeline(stages=stages).fit(rows.where("label is not null and text is not null"))


def unspaced_han(text: Column, tokens: dict[str, str]) -> Column:
    """Tokens of an anonymised corpus replaced by plain words, and no spaces between Chinese characters."""
    for a, b in tokens.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"(?<=\p{IsHan})\s+(?=\p{IsHan})", "")


def _split(text: str, lower: bool) -> list[tuple[str, int, int]]:
    """Words, signs and single Chinese characters, with their places."""
    out = []
    for m in re.finditer(r"[一-鿿㐀-䶿]|[^\W_]+|[^\w\s]|_", text):
        for part in re.finditer(r"[一-鿿㐀-䶿]|[^一-鿿㐀-䶿]+", m[0]):
            word = part[0].lower() if lower else part[0]
            out.append((word, m.start() + part.start(), m.start() + part.end()))
    return out


def pieces_of(word: str, vocabulary: dict[str, int], most: int = 100) -> list[str] | None:
    """Longest pieces from the left, later ones with ## before them; None if some place has none."""
    if len(word) > most:
        return None
    out, i = [], 0
    while i < len(word):
        j = len(word)
        while j > i and ("##" if i else "") + word[i:j] not in vocabulary:
            j -= 1
        if j == i:
            return None
        out.append(("##" if i else "") + word[i:j])
        i = j
    return out


def word_pieces(spark, vocabulary: dict[str, int], length: int = 128, lower: bool = True):
    """Arrow function text -> struct(ids, mask, word, start, end): ids between [CLS] and [SEP], cut to length and filled with [PAD]; the number and place of each piece's word, -1 where there's none."""
    sent = spark.sparkContext.broadcast(vocabulary)
    fields = ("ids", "mask", "word", "start", "end")

    @F.pandas_udf(T.StructType([T.StructField(f, T.ArrayType(T.IntegerType())) for f in fields]))
    def run(texts: pd.Series) -> pd.DataFrame:
        v, rows = sent.value, []
        for t in texts:
            rows_of = [(v["[CLS]"], 1, -1, -1, -1)]
            for k, (w, s, e) in enumerate(_split(t or "", lower)):
                plain = "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn") if lower else w
                rows_of += [(v.get(p, v["[UNK]"]), 1, k, s, e) for p in pieces_of(plain, v) or ["[UNK]"]]
            rows_of = rows_of[: length - 1] + [(v["[SEP]"], 1, -1, -1, -1)]
            rows_of += [(v["[PAD]"], 0, -1, -1, -1)] * (length - len(rows_of))
            rows.append([list(c) for c in zip(*rows_of, strict=True)])
        return pd.DataFrame(rows, columns=fields)

    return run


def merged(pieces: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids after all merges: each time the pair of least rank, wherever it is, from the left."""
    while len(pieces) > 1:
        known = [(merges[p], p) for p in zip(pieces[:-1], pieces[1:], strict=True) if p in merges]
        if not known:
            break
        (_, to), (a, b) = min(known)
        out, i = [], 0
        while i < len(pieces):
            if i + 1 < len(pieces) and pieces[i] == a and pieces[i + 1] == b:
                out.append(to)
                i += 2
            else:
                out.append(pieces[i])
                i += 1
        pieces = out
    return pieces


def byte_pairs(spark, vocabulary: dict[str, int], merges: Sequence[tuple[str, str]], length: int = 128, begin: str = "<s>", end: str = "</s>", pad: str = "<pad>", unknown: str = "<unk>", byte_fallback: bool = True):
    """Arrow function text -> struct(ids, mask, word, start, end) by byte-pair encoding of words that begin with a mark for the space before them.

    Ids lie between begin and end, are cut to ``length`` and filled with pad. A character that has no id is spelled in bytes (<0x41>), where all of its bytes have one, else unknown. word is the number
    of each id's word, start and end its place in the text; -1 where there is none.
    """
    ranks = {(vocabulary[a], vocabulary[b]): (k, vocabulary[a + b]) for k, (a, b) in reversed(list(enumerate(merges))) if a in vocabulary and b in vocabulary and a + b in vocabulary}
    sent = spark.sparkContext.broadcast((vocabulary, ranks))  # a tokenizer's own files, of some MB
    fields = ("ids", "mask", "word", "start", "end")

    @F.pandas_udf(T.StructType([T.StructField(f, T.ArrayType(T.IntegerType())) for f in fields]))
    def run(texts: pd.Series) -> pd.DataFrame:
        (v, ranks), rows, seen = sent.value, [], {}

        def ids_of(word: str) -> list[int]:
            out = []
            for c in word:
                if c in v:
                    out.append(v[c])
                    continue
                spelled = [v.get(f"<0x{b:02X}>") for b in c.encode()] if byte_fallback else [None]
                out += [v[unknown]] if None in spelled else spelled
            return merged(out, ranks)

        for t in texts:
            rows_of = [(v[begin], 1, -1, -1, -1)]
            for k, m in enumerate(re.finditer(r" [^ ]*|^[^ ]+", t or "")):
                word = "▁" + m[0].removeprefix(" ")
                if word not in seen:
                    seen[word] = ids_of(word)
                rows_of += [(i, 1, k, m.start() + m[0].startswith(" "), m.end()) for i in seen[word]]
                if len(rows_of) >= length:
                    break
            rows_of = rows_of[: length - 1] + [(v[end], 1, -1, -1, -1)]
            rows_of += [(v[pad], 0, -1, -1, -1)] * (length - len(rows_of))
            rows.append([list(c) for c in zip(*rows_of, strict=True)])
        return pd.DataFrame(rows, columns=fields)

    return run


def span_tags(pieces: Column, spans: Column, outside: str = "O") -> Column:
    """A tag for each piece (start, end): of the first span (token, start, end) that it overlaps, half open; pieces without a place have none."""
    first = lambda p: F.get(F.filter(spans, lambda s: (p["start"] < s["end"]) & (p["end"] > s["start"])), F.lit(0))
    return F.transform(pieces, lambda p: F.when(p["start"] < 0, F.lit(None).cast("string")).otherwise(F.coalesce(first(p)["token"], F.lit(outside))))
