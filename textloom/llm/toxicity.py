"""Toxicity of documents and their sentences by multiple-instance learning.

A sentence's score is the logistic of a weighted sum of its words; a document's
is the noisy-or of its sentences. The weights are fitted to labels of documents
alone, and the same weights then tell which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import extended, need, readable, spool, with_columns
from .textbytes import HashSet, char_before, raw, segment_sums, slices, string_array, words

SENTENCES = T.ArrayType(T.StructType([T.StructField("sentence", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))
_SENTENCES = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


@dataclass
class Model:
    """Weights of words by hash, the bias of a sentence, and the score from which a document counts as toxic."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def sentence_of(data: np.ndarray, off: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretch number of each word start, and the byte at which each stretch begins: stretches end after . ! ? and line ends, and with their text."""
    begin = np.zeros(len(data) + 1, bool)
    begin[1:][_STOP[data]] = True
    begin[off[:-1]] = True
    begin[-1] = False
    at = np.flatnonzero(begin)
    return np.searchsorted(at, starts, "right") - 1, at


def _start(word: np.ndarray, doc: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n: int, least: float = 3.0) -> np.ndarray:
    """First weights: twice the log-odds of words that are more frequent in toxic documents by ``least`` standard errors. From 0 a sentence's slope at the bias is so flat that few labels wouldn't move any."""
    pair = word * np.int64(len(toxic))
    pair += doc
    pair.sort()
    pair = pair[np.flatnonzero(np.diff(pair, prepend=-1))]
    w, d = np.divmod(pair, len(toxic))
    a, b = (np.bincount(w, weights=x[d].astype(float), minlength=n) for x in (toxic, clean))
    p, q = (a + 0.5) / (toxic.sum() + 1), (b + 0.5) / (clean.sum() + 1)
    odds = np.log(p / q)
    return np.where(odds > least * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), np.clip(2 * odds, 0, 8), 0.0)


def train(docs: np.ndarray, sentences: np.ndarray, hashes: np.ndarray, toxic: np.ndarray, prior: float = 0.5, rounds: int = 250, min_docs: int = 3, l1: float = 0.7, noise: float = 0.02, bias: float = -8.0, seed: int = 7) -> Model | None:
    """Fits the noisy-or model; docs and sentences number the words' documents and sentences from 0, toxic is by document.

    ``prior`` is the share of toxic documents, whatever it is in the sample; ``noise`` is the chance that a label is wrong, which keeps the model from explaining every label by
    some rare word; ``bias`` is the score of a sentence without any known word, fixed so that long texts don't add up to toxic ones; ``l1`` is the penalty on a weight, in documents of the smaller kind.
    """
    n = len(toxic)
    if not len(hashes) or toxic.min(initial=1) == toxic.max(initial=0):
        return None
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    keys, counts = np.unique(h[first], return_counts=True)
    keys = keys[counts >= min_docs]
    del order, h, d, first, counts
    at = HashSet(keys).find(hashes)
    known = at >= 0
    at, sent = at[known].astype(np.int32), sentences[known].astype(np.int32)
    sentence_doc = np.zeros(int(sentences.max()) + 1, np.int32)
    sentence_doc[sentences] = docs
    docs = docs[known].astype(np.int32)
    del hashes, sentences, known
    held = np.random.default_rng(seed).random(n) < 0.2
    if toxic[held].min(initial=1) == toxic[held].max(initial=0) or toxic[~held].min(initial=1) == toxic[~held].max(initial=0):
        held[:] = False
    y = toxic.astype(bool)
    share = np.where(y, prior / max(1, (y & ~held).sum()), (1 - prior) / max(1, (~y & ~held).sum())) * ~held
    penalty = l1 * share[y].max()
    w = np.append(_start(at, docs, y & ~held, ~y & ~held, len(keys)), bias)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def forward() -> tuple[np.ndarray, np.ndarray]:
        z = np.bincount(sent, w[at], len(sentence_doc)) + w[-1]
        return z, np.bincount(sentence_doc, _softplus(z), n)

    for k in range(1, rounds + 1):
        z, total = forward()
        clean = np.exp(-total)
        pull = (1 - 2 * noise) * clean * np.where(y, -1 / (1 - noise - (1 - 2 * noise) * clean), 1 / (noise + (1 - 2 * noise) * clean)) * share
        g = pull[sentence_doc] * _sigmoid(z)
        grad = np.append(np.bincount(at, g[sent], len(keys)), 0.0)
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        step = 0.15 / (np.sqrt(v / (1 - 0.999**k)) + 1e-7)
        w -= step * m / (1 - 0.9**k)
        # where the slope is flat the step is wide: without a bound the penalty would bring a weight to 0 at once
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - np.minimum(step[:-1] * penalty, 1.0), 0)
    p = -np.expm1(-forward()[1])
    on = held if held.any() else np.ones(n, bool)
    best, threshold = -1.0, 0.5
    for t in np.round(np.arange(0.05, 1, 0.05), 2):
        said = p[on] >= t
        hit, wrong = (said & y[on]).sum() / max(1, y[on].sum()) * prior, (said & ~y[on]).sum() / max(1, (~y[on]).sum()) * (1 - prior)
        f = 2 * hit / max(1e-9, hit + wrong + prior)
        if f > best + 1e-12 or (abs(f - best) <= 1e-12 and abs(t - 0.5) < abs(threshold - 0.5)):
            best, threshold = f, float(t)
    big = np.abs(w[:-1]) >= 1e-3
    return Model(keys[big], w[:-1][big], float(w[-1]), threshold)


def fit(docs: DataFrame, labels: DataFrame, most: int = 8000, seed: int = 7) -> Model | None:
    """Fits on at most ``most`` labelled documents, half of them of either label where there are as many.

    The sample is the bound documents by hash of doc_id. Labels without doc_id or toxic don't
    count; a document with several labels is toxic if one says so. None if a label is missing.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "toxic")
    docs = readable(docs)
    per = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    per = spool(per, "labels")
    n, n_toxic = per.agg(F.count("*"), F.sum("toxic")).first()
    if not n_toxic or n_toxic == n:
        return None
    order = F.xxhash64("doc_id", F.lit(seed))
    some = per.where("toxic = 1").orderBy(order).limit(most // 2).union(per.where("toxic = 0").orderBy(order).limit(most // 2))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = string_array(batch.column(1))
            for i, j in slices(a):
                part = a.slice(i, j - i)
                h, starts, _, rows, data = words(part)
                s, _ = sentence_of(data, raw(part)[1], starts)
                cut = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(s, pa.int32()))], names=["doc_id", "toxic", "h", "s"])

    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")
    table = sample.mapInArrow(read, "doc_id long, toxic int, h array<long>, s array<int>").toArrow().combine_chunks()
    if not table.num_rows:
        return None
    h, s = table["h"].combine_chunks(), table["s"].combine_chunks()
    n_words = np.diff(np.asarray(h.offsets))
    toxic, doc = np.asarray(table["toxic"]), np.repeat(np.arange(table.num_rows, dtype=np.int32), n_words)
    # sentences are numbered upwards within their document
    s = np.asarray(s.flatten())
    sentence = np.cumsum((np.diff(doc, prepend=-1) != 0) | (np.diff(s, prepend=-1) != 0), dtype=np.int32) - 1
    del table, s
    return train(doc, sentence, np.asarray(h.flatten()).view(np.uint64), toxic, prior=n_toxic / n)


def score(docs: DataFrame, model: Model | None, toxic_only: bool | None = None) -> DataFrame:
    """docs with p_toxic, toxic, n_sentences and offending: the sentences of p at least one half, or the worst one, of a toxic document.

    Whole texts are scored. ``start`` and ``end`` are characters of the text; ``sentence`` counts
    the sentences with a word from 0. A null or empty text has no sentence and p_toxic 0. Columns of
    these names are replaced, others pass through as they are. Without a model (labels of one kind
    only, or none) nothing is toxic. ``toxic_only`` keeps only the toxic documents, or with False
    only the others.
    """
    need(docs, "text")
    docs = readable(docs)
    schema, kept = extended(docs, p_toxic=T.DoubleType(), toxic=T.BooleanType(), n_sentences=T.IntegerType(), offending=SENTENCES)
    m = model or Model(np.zeros(0, np.uint64), np.zeros(0), -100.0, 2.0)
    sent = docs.sparkSession.sparkContext.broadcast((m.keys, m.weights, m.bias, m.threshold))  # bounded by the sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, bias, threshold = sent.value
        known = HashSet(keys)
        values = weights[np.argsort(keys)]
        for batch in batches:
            a = string_array(batch.column("text"))
            for i, j in slices(a):
                part = a.slice(i, j - i)
                h, starts, ends, rows, data = words(part)
                off = raw(part)[1]
                at = known.find(h)
                z = np.where(at >= 0, values[at], 0.0) if len(values) else np.zeros(len(h))
                stretch, _ = sentence_of(data, off, starts)
                first = np.flatnonzero(np.diff(stretch, prepend=-1))  # the first word of each sentence
                bounds = np.append(first, len(h))
                logits = segment_sums(z, bounds) + bias
                # a row's sentences: those whose first word is among its words
                of_row = np.searchsorted(first, rows)
                p = -np.expm1(-segment_sums(_softplus(logits), of_row))
                toxic = p >= threshold
                ps = _sigmoid(logits)
                row = np.repeat(np.arange(j - i), np.diff(of_row))
                bad = toxic[row] & (ps >= 0.5)
                for r in np.flatnonzero(toxic):
                    x, y = of_row[r], of_row[r + 1]
                    if x < y and not bad[x:y].any():
                        bad[x + int(np.argmax(ps[x:y]))] = True
                which = np.flatnonzero(bad)
                if len(which):
                    chars = char_before(data)
                    start = chars[starts[first[which]]] - chars[off[row[which]]]
                    end = chars[ends[bounds[which + 1] - 1]] - chars[off[row[which]]]
                else:
                    start = end = which
                values_ = pa.StructArray.from_arrays([pa.array(which - of_row[row[which]], pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(ps[which], pa.float64())], fields=list(_SENTENCES.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[which], np.arange(j - i + 1)), pa.int32()), values_)
                out = with_columns(batch.slice(i, j - i), kept, {"p_toxic": pa.array(np.where(np.diff(of_row) > 0, p, 0.0)), "toxic": pa.array(toxic & (np.diff(of_row) > 0)), "n_sentences": pa.array(np.diff(of_row), pa.int32()), "offending": lists})
                if toxic_only is not None:
                    out = out.filter(pa.array(toxic & (np.diff(of_row) > 0)) if toxic_only else pa.array(~(toxic & (np.diff(of_row) > 0))))
                yield out

    return docs.mapInArrow(run, schema)
