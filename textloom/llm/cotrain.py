"""Quality of documents by co-training: a classifier of the words and one of the page's metadata teach each other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import extended, need, readable, spool, with_columns
from .textbytes import ALNUM, U64, WS, mix, raw, runs, slices, span_hash, string_array

WORDS, ENDS = 1 << 17, 1 << 12
DIM = WORDS + ENDS + 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
_SIGN = ~ALNUM & ~WS & ~_STOP
LANGS, SOURCES, SIZES = 16, 64, 9
META = 2 * SIZES + LANGS + SOURCES


@dataclass
class Model:
    """Weights of both views, their calibration (slope, shift), the prior's log-odds, and how features of pages are scaled."""

    content: np.ndarray
    meta: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    calibration: tuple[tuple[float, float], tuple[float, float]]
    prior: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def content_features(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of the words of every text, side by side, and where each text's begin: hash of the word, hash of its last two bytes, and whether it repeats the one before."""
    data, off = raw(a)
    starts, ends = runs(~WS[data], off)
    rows = np.searchsorted(starts, off)
    h, _ = span_hash(data, starts, ends)
    last = data[ends - 1].astype(np.uint64) << U64(8) | np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[rows[:-1][rows[:-1] < len(h)]] = False
    out = np.empty((len(h), 2), np.int32)
    out[:, 0] = np.where(again, DIM - 1, (h & U64(WORDS - 1)).astype(np.int64))
    out[:, 1] = WORDS + (mix(last) & U64(ENDS - 1)).astype(np.int64)
    return out.reshape(-1), 2 * rows


def _share(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def _one_hot(column: pa.Array, size: int) -> np.ndarray:
    a = string_array(column.cast(pa.string()))
    data, off = raw(a)
    h, _ = span_hash(data, off[:-1], off[1:])
    out = np.zeros((len(a), size))
    out[np.arange(len(a)), (h % U64(size)).astype(np.int64)] = np.diff(off) > 0
    return out


def meta_features(a: pa.Array, lang: pa.Array, source: pa.Array) -> np.ndarray:
    """A row of figures per page: language and source, its size, and shares of kinds of characters and lines."""
    data, off = raw(a)
    size = np.diff(off)
    n = np.maximum(size, 1)
    words = np.maximum(np.diff(np.searchsorted(runs(~WS[data], off)[0], off)), 1)
    lines = _share(data == 10, off) + 1
    signs = [_share(mask[data], off) / n for mask in (_UPPER, _DIGIT, _STOP, _SIGN, WS)]
    sizes = np.stack([*signs, np.log1p(size), np.log1p(lines), np.log1p(size / words), np.log1p(words / lines)], axis=1)
    return np.concatenate((sizes, np.zeros_like(sizes), _one_hot(lang, LANGS), _one_hot(source, SOURCES)), axis=1)


def _scaled(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sizes as distances from the middle, with and without sign: junk may lie on either side."""
    out = x.copy()
    z = np.clip((x[:, :SIZES] - center) / scale, -8, 8)
    out[:, :SIZES], out[:, SIZES : 2 * SIZES] = z, np.abs(z)
    return out


def train_content(features: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, l2: float = 1e-6, seed: int = 7) -> np.ndarray:
    """Logistic regression on mean weights of a text's features, by mini-batches with steps for each weight; the last weight is the bias."""
    w, seen = np.zeros(DIM + 1), np.full(DIM + 1, 1e-4)
    n = np.maximum(np.diff(bounds), 1)
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for i in range(0, len(y), batch):
            rows = order[i : i + batch]
            count = np.diff(bounds)[rows]
            at = np.repeat(bounds[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
            f, doc = features[at], np.repeat(np.arange(len(rows)), count)
            z = 30 * np.bincount(doc, w[f], len(rows)) / n[rows] + w[-1]
            pull = (_sigmoid(z) - y[rows]) * share[rows] / len(rows)
            g = np.append(np.bincount(f, (30 * pull / n[rows])[doc], DIM), pull.sum()) + l2 * w
            seen += g * g
            w -= 0.1 * g / np.sqrt(seen)
    return w


def train_meta(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the bias."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), x.T @ (share * (p - y)) + ridge * w)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's scaling, with his smoothed targets."""
    if not len(z) or y.all() or not y.any():
        return 1.0, 0.0
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    x, w = np.stack((z, np.ones_like(z)), axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (w - [1, 0]))
        w -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return max(float(w[0]), 0.0), float(w[1])


class _Views:
    """Both views' scores of texts."""

    def __init__(self, content: np.ndarray, meta: np.ndarray, center: np.ndarray, scale: np.ndarray):
        self.content, self.meta, self.center, self.scale = content, meta, center, scale

    def scores(self, text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        f, bounds = content_features(text)
        total = np.concatenate(([0.0], np.cumsum(self.content[f])))
        n = np.diff(bounds)
        z = 30 * (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1) + self.content[-1]
        x = _scaled(meta_features(text, lang, source), self.center, self.scale)
        return z, x @ self.meta[:-1] + self.meta[-1]


def _columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and source; of the last two, one that isn't there is null."""
    return docs.select("doc_id", "text", *((F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")))


def _gather(docs: DataFrame, chosen: DataFrame) -> pa.Table:
    """Features of the chosen documents (doc_id, y), in the driver; there are at most as many as were asked for. Of rows of one doc_id one counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = string_array(batch.column(1))
            for i, j in slices(a):
                cut = [batch.column(k).slice(i, j - i) for k in range(5)]
                f, bounds = content_features(a.slice(i, j - i))
                x = meta_features(a.slice(i, j - i), cut[2], cut[3])
                yield pa.RecordBatch.from_arrays([cut[0], cut[4], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(f)), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * META, pa.int32()), pa.array(x.reshape(-1)))], names=["doc_id", "y", "f", "x"])

    rows = _columns(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang", "source", "y")
    table = rows.mapInArrow(run, "doc_id long, y boolean, f array<int>, x array<double>").toArrow().combine_chunks()
    ids = table["doc_id"].to_numpy()
    return table.take(pa.array(np.sort(np.unique(ids, return_index=True)[1]))).sort_by("doc_id")


class _Set:
    """What one view learns from: labelled documents and those that the other view is sure of."""

    def __init__(self, table: pa.Table):
        self.tables = [table]

    def add(self, table: pa.Table) -> None:
        self.tables.append(table)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t = pa.concat_tables(self.tables).combine_chunks()
        f, x = t["f"].combine_chunks(), t["x"].combine_chunks()
        return np.asarray(f.flatten()), np.asarray(f.offsets, np.int64) - f.offsets[0].as_py(), np.asarray(x.flatten()).reshape(-1, META), np.asarray(t["y"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, rounds: int = 2, grow: int = 1000, sure: float = 0.95, seed: int = 7) -> Model | None:
    """Co-trains both views; None without labels of both kinds.

    At most ``most`` labelled documents (by hash of doc_id) are read, a fifth of them held out for calibration. In each
    of ``rounds`` rounds each view scores every document that isn't in the sample, and gives the other up to ``grow`` of which it is surest,
    good and bad ones in the labels' proportion and none of which it is less than ``sure``. Labels without doc_id or
    quality don't count; a document with several labels is bad if one says so.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    docs = readable(docs)
    spark = docs.sparkSession
    per = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(F.col("quality").cast("int")) > 0).alias("y"))
    sample = spool(per.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most), "quality")
    table = _gather(docs, sample)
    if not table.num_rows or len(set(table["y"].to_pylist())) < 2:
        return None
    y = np.asarray(table["y"].combine_chunks())
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    ids = table["doc_id"].to_numpy()
    held = np.random.default_rng(seed).random(len(ids)) < 0.2
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(ids), bool)
    x = np.stack(table["x"].to_numpy())[:, :SIZES]
    center, scale = np.median(x, axis=0), np.maximum(x.std(axis=0), 1e-6)
    sets = [_Set(table.filter(pa.array(~held))) for _ in range(2)]
    taken = np.sort(ids)

    def train() -> _Views:
        f, bounds, _, y0 = sets[0].arrays()
        _, _, x1, y1 = sets[1].arrays()
        return _Views(train_content(f, bounds, y0), train_meta(_scaled(x1, center, scale), y1), center, scale)

    views = train()
    wanted = (max(1, round(grow * (1 - prior))), max(1, round(grow * prior)))
    for _ in range(rounds):
        found = _surest(docs, views, taken, wanted, sure)
        if not found:
            break
        rows = spark.createDataFrame([(i, s[1]) for s, part in found.items() for i in part], "doc_id long, y boolean")
        given = _gather(docs, rows.groupBy("doc_id").agg(F.min("y").alias("y")))
        got = given["doc_id"].to_numpy()
        for (view, good), part in found.items():
            some = given.filter(pa.array(np.isin(got, part)))
            sets[1 - view].add(some.set_column(1, "y", pa.array(np.full(some.num_rows, good))))
        taken = np.unique(np.concatenate((taken, got)))
        views = train()
    on = table.filter(pa.array(held if held.any() else np.ones(len(ids), bool)))
    part = _Set(on)
    f, bounds, x, y = part.arrays()
    z = 30 * np.array([views.content[f[a:b]].sum() for a, b in zip(bounds[:-1], bounds[1:])]) / np.maximum(np.diff(bounds), 1) + views.content[-1]
    m = _scaled(x, center, scale) @ views.meta[:-1] + views.meta[-1]
    return Model(views.content, views.meta, center, scale, (calibrate(z, y), calibrate(m, y)), float(np.log(prior / (1 - prior))))


def _surest(docs: DataFrame, views: _Views, taken: np.ndarray, wanted: tuple[int, int], sure: float) -> dict[tuple[int, bool], list[int]]:
    """(view, good) -> doc_ids of the documents that it is surest of, among all that aren't taken; ties by doc_id."""
    sent = docs.sparkSession.sparkContext.broadcast((views, taken, wanted, sure))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, taken, wanted, sure = sent.value
        best: dict = {(v, g): (np.zeros(0, np.int64), np.zeros(0)) for v in (0, 1) for g in (False, True)}
        for batch in batches:
            a = string_array(batch.column(1))
            for i, j in slices(a):
                ids = batch.column(0).slice(i, j - i)
                known = np.asarray(ids.is_valid())
                ids = np.asarray(ids.fill_null(0).cast(pa.int64()))
                known &= ~np.isin(ids, taken)
                for v, z in enumerate(views.scores(a.slice(i, j - i), batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i))):
                    p = _sigmoid(z)
                    for good in (False, True):
                        q = p if good else 1 - p
                        at = np.flatnonzero(known & (q >= sure))
                        k, c = np.concatenate((best[v, good][0], ids[at])), np.concatenate((best[v, good][1], q[at]))
                        order = np.lexsort((k, -c))
                        order = order[np.sort(np.unique(k[order], return_index=True)[1])][: wanted[good]]  # a doc_id counts once
                        best[v, good] = k[order], c[order]
        for (v, good), (k, c) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), v), pa.int32()), pa.array(np.full(len(k), good)), pa.array(k), pa.array(c)], names=["view", "good", "doc_id", "p"])

    found = spool(_columns(docs).mapInArrow(run, "view int, good boolean, doc_id long, p double"), "sure")
    out = {}
    for v in (0, 1):
        for good in (False, True):
            top = found.where((F.col("view") == v) & (F.col("good") == good)).groupBy("doc_id").agg(F.max("p").alias("p")).orderBy(F.desc("p"), "doc_id").limit(wanted[good])
            if ids := [r.doc_id for r in top.select("doc_id").collect()]:
                out[v, good] = ids
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with p_content, p_meta, quality (the chance that it's good, from both calibrated views) and keep (quality at least one half).

    Whole texts are scored. The views' calibrated log-odds are added, less the prior's. lang and source may be
    absent or null. A null or empty text, or one of white space, has no content: p_content is the prior and p_meta alone decides.
    Without a model everything has the chance one half and is kept. Columns of these names are replaced, others pass.
    """
    need(docs, "text")
    docs = readable(docs)
    schema, kept = extended(docs, p_content=T.DoubleType(), p_meta=T.DoubleType(), quality=T.DoubleType(), keep=T.BooleanType())
    sent = docs.sparkSession.sparkContext.broadcast(model)
    has = {c: c in docs.columns for c in ("lang", "source")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        views = m and _Views(m.content, m.meta, m.center, m.scale)
        for batch in batches:
            a = string_array(batch.column("text"))
            for i, j in slices(a):
                part = batch.slice(i, j - i)
                if m is None:
                    half = np.full(j - i, 0.5)
                    yield with_columns(part, kept, {"p_content": pa.array(half), "p_meta": pa.array(half), "quality": pa.array(half), "keep": pa.array(np.ones(j - i, bool))})
                    continue
                text = a.slice(i, j - i)
                lang, source = (part.column(c) if has[c] else pa.nulls(j - i, pa.string()) for c in ("lang", "source"))
                z = [s * slope + shift for s, (slope, shift) in zip(views.scores(text, lang, source), m.calibration, strict=True)]
                data, off = raw(text)
                z[0] = np.where(_share(~WS[data], off) > 0, z[0], m.prior)
                q = _sigmoid(z[0] + z[1] - m.prior)
                yield with_columns(part, kept, {"p_content": pa.array(_sigmoid(z[0])), "p_meta": pa.array(_sigmoid(z[1])), "quality": pa.array(q), "keep": pa.array(q >= 0.5)})

    return docs.mapInArrow(run, schema)
