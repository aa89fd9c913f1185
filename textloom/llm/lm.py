"""Language-model scores of documents by deleted interpolation of word bigrams, single words and a uniform share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import need, partitions, readable, spool
from .textbytes import U64, mix, slices, string_array, words

BUCKETS = 64  # one for each factor two of a context's frequency, so that none is shared
_STEPS = 16  # of a factor two, by which probabilities are told apart in held-out counts
_SLICE = 8 << 20
_START = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Vocabulary:
    """Hashes in order, with counts as a word and as a context, of all documents and of those that aren't held out. Two places follow without a hash: the start of a text, and all words that aren't in it, with the counts of one that occurs once."""

    hashes: np.ndarray
    n: np.ndarray
    n_train: np.ndarray
    context: np.ndarray
    context_train: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, h)
        if len(self.hashes):
            at[self.hashes[np.minimum(at, len(self.hashes) - 1)] != h] = len(self.hashes) + 1
        else:
            at[:] = 1
        return at

    def absent(self, pair: np.ndarray) -> np.ndarray:
        """Pairs with a word that isn't in it."""
        none = U64(len(self.hashes) + 1)
        return (pair >> U64(32) == none) | (pair & U64(0xFFFFFFFF) == none)


def bucket(count: np.ndarray) -> np.ndarray:
    """Of a context by its frequency: 0 for one never met, then one for each factor two."""
    return np.minimum(np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def learn(b: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """(BUCKETS, 3) weights of the bigram, word and uniform estimates, by expectation-maximisation on held-out counts n of (bucket, p2, p1). A bucket without any gets those of all together."""
    p = np.stack((p2, p1, np.full(len(p1), p0)), axis=1)
    start = np.array([0.4, 0.5, 0.1])

    def em(which: np.ndarray) -> np.ndarray:
        w, q, m = start.copy(), p[which], n[which].astype(float)
        for _ in range(rounds):
            share = q * w
            share *= (m / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) / m.sum()
            w = np.maximum(w, 1e-6)
            w /= w.sum()
        return w

    every = em(np.ones(len(b), bool)) if len(b) else start
    out = np.tile(every, (BUCKETS, 1))
    for k in np.unique(b):
        out[k] = em(b == k)
    out[0] = out[0] * [0, 1, 1] / max(1e-12, out[0, 1:].sum())
    return out


def log_probability(pair: np.ndarray, word: np.ndarray, context: np.ndarray, total: int, size: int, weights: np.ndarray) -> np.ndarray:
    """Of an occurrence, from counts of its pair, word and context over all documents, less the occurrence itself."""
    c = context.astype(np.int64) - 1
    b = bucket(c)
    p2 = np.where(c > 0, (pair - 1) / np.maximum(c, 1), 0.0)
    p1 = (word.astype(np.int64) - 1) / max(1, total - 1)
    return np.log(weights[b, 0] * p2 + weights[b, 1] * p1 + weights[b, 2] / (size + 1))


def _pack(a: np.ndarray) -> bytes:
    """Bytes of the same weight side by side, compressed."""
    if not len(a):
        return b""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _words(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the first of each text: tokenised in shorter stretches, of which only the hashes stay."""
    made, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in slices(a):
        h, _, _, rows, _ = words(a.slice(i, j - i))
        made.append(h)
        counts.append(np.diff(rows))
    return np.concatenate(made), np.cumsum(np.concatenate(counts))


def _held(batch: pa.RecordBatch, percent: int) -> np.ndarray:
    return np.asarray(batch.column(2)) % 100 < percent


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, a number that is the same for equal texts, so that copies are held out together, and a hash that tells texts apart."""
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("th"), F.xxhash64("text").alias("key"))


def vocabulary_table(docs: DataFrame, held_percent: int = 10) -> DataFrame:
    """(h, n, n_train, context, context_train) of every word, spooled; the start of a text is a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, held = string_array(batch.column(1)), _held(batch, held_percent)
            for i, j in slices(a, _SLICE):
                h, rows = _words(a.slice(i, j - i))
                full = rows[1:] > rows[:-1]
                train = np.repeat(~held[i:j], np.diff(rows))
                inner = np.ones(len(h), bool)
                inner[rows[1:][full] - 1] = False
                keys, at = np.unique(np.append(h, _START), return_inverse=True)
                at, start = at[:-1], at[-1]
                counts = [np.bincount(at[x], minlength=len(keys)) for x in (slice(None), train, inner, inner & train)]
                counts[2][start] += full.sum()
                counts[3][start] += (full & ~held[i:j]).sum()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], names=["h", "n", "n_train", "context", "context_train"])

    counted = _keyed(docs).mapInArrow(run, "h long, n long, n_train long, context long, context_train long")
    return spool(counted.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", "n_train", "context", "context_train"))), "words")


def _vocabulary(table: DataFrame, least: int, n: int, total: int, part_words: int = 1 << 20) -> Vocabulary:
    """The n words that occur ``least`` times or more, gathered by ranges of their hashes, so that little is held twice."""
    names, kind = ("n", "n_train", "context", "context_train"), np.int32 if total < 1 << 31 else np.int64
    hashes, columns = np.empty(n, np.uint64), [np.zeros(n + 2, kind) for _ in names]
    narrow = table.where(F.col("n") >= least).select("h", *(F.col(c).cast("int" if kind is np.int32 else "long") for c in names))
    parts, i = -(-n // part_words), 0
    for k in range(parts):
        top = F.shiftrightunsigned("h", 48)
        t = narrow.where((top >= (k << 16) // parts) & (top < (k + 1 << 16) // parts)).toArrow()
        h = t["h"].to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        hashes[i : i + len(h)] = h[order]
        for to, c in zip(columns, names, strict=True):
            to[i : i + len(h)] = t[c].to_numpy()[order]
        i += len(h)
    start = table.where(F.col("h") == int(_START.astype(np.int64))).first()
    for to, c, one in zip(columns, names, (1, 0, 1, 0), strict=True):
        to[n:] = (start[c] if start else 0), one
    return Vocabulary(hashes, *columns)


def _pairs(a: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context << 32 | word, text) of every word, by places in the vocabulary, and the words of each text."""
    h, rows = _words(a)
    at = v.find(h).astype(np.uint64)
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[rows[:-1][rows[1:] > rows[:-1]]] = len(v.hashes)
    return before << U64(32) | at, np.repeat(np.arange(len(a)), np.diff(rows)), np.diff(rows)


def _by_shard(pair: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by shard and pair, and the shard of each."""
    shard = (mix(pair) % U64(shards)).astype(np.int64)
    order = np.argsort(pair, kind="stable")
    order = order[np.argsort(shard[order], kind="stable")]
    return order, shard[order]


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def _learn_weights(docs: DataFrame, sent, shards: int, held_percent: int, total: int, size: int, rare: DataFrame | None) -> np.ndarray:
    """Pairs with their counts go to their shard, which sends on how many held-out words had which estimates. With rare, which has them of the pairs with an absent word, those stay away."""
    apart = rare is not None

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in batches:
            a, held = string_array(batch.column(1)), _held(batch, held_percent)
            for i, j in slices(a, _SLICE):
                pair, doc, _ = _pairs(a.slice(i, j - i), v)
                if apart:
                    there = ~v.absent(pair)
                    pair, doc = pair[there], doc[there]
                order, shard = _by_shard(pair, shards)
                pair, out = pair[order], held[i:j][doc[order]]
                first = _runs(pair)
                n = np.diff(np.append(first, len(pair)))
                n_held = np.add.reduceat(out, first, dtype=np.int64) if len(first) else n
                s, pair = shard[first], pair[first]
                cut = np.append(_runs(s), len(s))
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([int(s[x])], pa.int32()), pa.array([int(y - x)]), pa.array([_pack(np.diff(pair[x:y], prepend=U64(0)))]), pa.array([_pack(n[x:y].astype(np.uint32))]), pa.array([_pack(n_held[x:y].astype(np.uint32))])], names=["shard", "size", "pairs", "n", "held"])

    def count(table: pa.Table) -> pa.Table:
        v = sent.value
        rows = table.to_pylist()
        pair = np.concatenate([np.cumsum(_unpack(r["pairs"], r["size"], np.uint64), dtype=np.uint64) for r in rows])
        n, held = (np.concatenate([_unpack(r[k], r["size"], np.uint32) for r in rows]).astype(np.int64) for k in ("n", "held"))
        pair, at = np.unique(pair, return_inverse=True)
        held, n = np.bincount(at, held, len(pair)).astype(np.int64), np.bincount(at, n, len(pair)).astype(np.int64)
        n[v.absent(pair)] = 0  # as often as the absent word without the held-out one
        c2, context, word = np.maximum(n - held, 0)[held > 0], v.context_train[(pair[held > 0] >> U64(32)).astype(np.int64)], v.n_train[(pair[held > 0] & U64(0xFFFFFFFF)).astype(np.int64)]
        return _histogram(c2, context, word, held[held > 0], total)

    cells = _keyed(docs).mapInArrow(emit, "shard int, size long, pairs binary, n binary, held binary").groupBy("shard").applyInArrow(count, "b int, q2 int, q1 int, n long")
    return _weights(cells.unionByName(rare) if apart else cells, size)


def _histogram(c2: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray, total: int) -> pa.Table:
    context = context.astype(np.int64)
    b = bucket(context)
    q2, q1 = (np.where(x > 0, np.round(-_STEPS * np.log2(np.maximum(x, 1e-300))), -1).astype(np.int64) for x in (np.where(context > 0, c2 / np.maximum(context, 1), 0), word / max(1, total)))
    cell, at = np.unique((b << 40) | (q2 + 1 << 20) | (q1 + 1), return_inverse=True)
    return pa.table({"b": pa.array(cell >> 40, pa.int32()), "q2": pa.array((cell >> 20 & 0xFFFFF) - 1, pa.int32()), "q1": pa.array((cell & 0xFFFFF) - 1, pa.int32()), "n": pa.array(np.bincount(at, n, len(cell)).astype(np.int64))})


def _weights(cells: DataFrame, size: int) -> np.ndarray:
    # cells are bounded by the steps between 1 and one over the corpus's words, whatever the corpus
    t = cells.groupBy("b", "q2", "q1").agg(F.sum("n").alias("n")).orderBy("b", "q2", "q1").toPandas()
    p2, p1 = (np.where(q.to_numpy() >= 0, 2.0 ** (-q.to_numpy() / _STEPS), 0.0) for q in (t.q2, t.q1))
    return learn(t.b.to_numpy(), p2, p1, 1 / (size + 1), t.n.to_numpy())


def score(docs: DataFrame, held_percent: int = 10, shards: int | None = None, broadcast_words: int = 8_000_000, shard_words: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, log_prob and perplexity of every row of docs.

    A word is a run outside white space, in lower case, by its letters and digits. Its probability mixes the maximum-likelihood
    estimates of the pair with the word before (or the text's start), of the word, and one over the number of distinct words; the weights depend on
    the frequency of the context. They are learned on the documents whose text hashes to the held-out
    percentage, against counts of the others; scores then rest on counts of all documents, less the scored occurrence itself.

    A null or empty text, or one without words, has 0 words, log_prob 0 and a null perplexity. Rows with null or repeated doc_id
    are scored each. Copies of a text count as often as they occur. Other columns are not read; an empty table gives no rows.

    Pairs go to their shard once as counts, for the weights, and once with the texts that they're in. Words that occur twice or more
    are sent to workers; of one that they don't have, all counts are known. Where over ``broadcast_words`` occur twice, the most
    frequent of them are sent, and the few pairs with one of the others are joined as rows, with the same scores.
    """
    need(docs, "doc_id", "text")
    docs = readable(docs)
    spark = docs.sparkSession
    table = vocabulary_table(docs, held_percent)
    size, total, total_train = table.agg(F.sum(F.when(F.col("n") > 0, 1)), F.sum("n"), F.sum("n_train")).first()
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.IntegerType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perplexity", T.DoubleType())])
    if not total:
        return docs.select("doc_id", F.lit(0).alias("n_words"), F.lit(0.0).alias("log_prob"), F.lit(None).cast("double").alias("perplexity"))
    least, sent_words = 2, table.where("n >= 2").count()
    if sent_words > broadcast_words:
        least, sent_words = _most_frequent(table, broadcast_words)
    sent = spark.sparkContext.broadcast(_vocabulary(table, least, sent_words, total))  # at most broadcast_words words
    shards = shards or max(partitions(spark), -(-total // shard_words))
    apart = least > 2
    seen, known = _rare(docs, table, sent, held_percent) if apart else (None, None)
    weights = _learn_weights(docs, sent, shards, held_percent, total_train or 0, size, _rare_cells(known, total_train or 0) if apart else None)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, part, number = sent.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            a = string_array(batch.column(1))
            for i, j in slices(a, _SLICE):
                pair, doc, n_words = _pairs(a.slice(i, j - i), v)
                if apart:
                    there = ~v.absent(pair)
                    pair, doc = pair[there], doc[there]
                order, shard = _by_shard(pair, shards)
                pair, doc = pair[order], doc[order].astype(np.uint32)
                first = _runs(pair)
                n = np.diff(np.append(first, len(pair))).astype(np.uint32)
                cut = np.searchsorted(shard, np.arange(shards + 1))
                own = np.searchsorted(first, cut)
                home = number % shards
                for s in range(shards):
                    x, y, p, q = cut[s], cut[s + 1], own[s], own[s + 1]
                    if x == y and s != home:
                        continue
                    whose = batch.column(0).slice(i, j - i) if s == home else batch.column(0).slice(0, 0)
                    ids, keys = (pa.ListArray.from_arrays(pa.array([0, len(whose)], pa.int32()), x) for x in (whose, batch.column(3).slice(i if s == home else 0, len(whose))))
                    counts = pa.array([n_words.tolist() if s == home else []], pa.list_(pa.int32()))
                    blobs = [_pack(np.diff(pair[first[p:q]], prepend=U64(0))), _pack(n[p:q]), _pack(doc[x:y])]
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part << 32 | number]), pa.array([int(q - p)]), pa.array([int(y - x)]), *(pa.array([b], pa.binary()) for b in blobs), ids, keys, counts], names=["shard", "slice", "size", "n_pairs", "pairs", "n", "docs", "ids", "keys", "n_words"])
                number += 1

    def answer(batch: pa.Table) -> pa.Table:
        v = sent.value
        sizes = batch["size"].to_pylist()
        pairs = [np.cumsum(_unpack(p, k, np.uint64), dtype=np.uint64) for p, k in zip(batch["pairs"].to_pylist(), sizes, strict=True)]
        ns = [_unpack(p, k, np.uint32) for p, k in zip(batch["n"].to_pylist(), sizes, strict=True)]
        known, at = np.unique(np.concatenate(pairs), return_inverse=True)
        count = np.bincount(at, np.concatenate(ns), len(known))
        count[v.absent(known)] = 1
        value = log_probability(count, v.n[(known & U64(0xFFFFFFFF)).astype(np.int64)], v.context[(known >> U64(32)).astype(np.int64)], total, size, weights)
        made, bounds = [], np.concatenate(([0], np.cumsum(sizes)))
        for k, (docs_, m) in enumerate(zip(batch["docs"].to_pylist(), batch["n_pairs"].to_pylist(), strict=True)):
            d = _unpack(docs_, m, np.uint32)
            sums = np.bincount(d, np.repeat(value[at[bounds[k] : bounds[k + 1]]], ns[k])) if len(d) else np.zeros(0)
            some = np.flatnonzero(sums)
            made.append((len(some), _pack(np.diff(some, prepend=0).astype(np.uint32)), _pack(sums[some])))
        return pa.table({"slice": batch["slice"], "size": pa.array([m[0] for m in made], pa.int64()), "docs": pa.array([m[1] for m in made], pa.binary()), "sums": pa.array([m[2] for m in made], pa.binary()), "ids": batch["ids"], "keys": batch["keys"], "n_words": batch["n_words"]})

    def gather(table: pa.Table) -> pa.Table:
        ids, n = table["ids"].combine_chunks().flatten(), np.asarray(table["n_words"].combine_chunks().flatten())
        total_ = np.zeros(len(n))
        for k, d, s in zip(table["size"].to_pylist(), table["docs"].to_pylist(), table["sums"].to_pylist(), strict=True):
            total_[np.cumsum(_unpack(d, k, np.uint32))] += _unpack(s, k, np.float64)
        mean = total_ / np.maximum(n, 1)
        return pa.table({"doc_id": ids, "key": table["keys"].combine_chunks().flatten(), "n_words": pa.array(n, pa.int32()), "log_prob": total_, "perplexity": pa.array(np.exp(-mean), mask=n == 0)})

    ids = T.ArrayType(kind)
    emitted = T.StructType([T.StructField(*f) for f in (("shard", T.IntegerType()), ("slice", T.LongType()), ("size", T.LongType()), ("n_pairs", T.LongType()), ("pairs", T.BinaryType()), ("n", T.BinaryType()), ("docs", T.BinaryType()), ("ids", ids), ("keys", T.ArrayType(T.LongType())), ("n_words", T.ArrayType(T.IntegerType())))])
    answered = T.StructType([T.StructField(*f) for f in (("slice", T.LongType()), ("size", T.LongType()), ("docs", T.BinaryType()), ("sums", T.BinaryType()), ("ids", ids), ("keys", T.ArrayType(T.LongType())), ("n_words", T.ArrayType(T.IntegerType())))])
    gathered = T.StructType([out.fields[0], T.StructField("key", T.LongType()), *out.fields[1:]])
    scored = _keyed(docs).mapInArrow(emit, emitted).groupBy("shard").applyInArrow(answer, answered).groupBy("slice").applyInArrow(gather, gathered)
    if not apart:
        return scored.drop("key")
    rest = _rare_sums(docs, seen, known, total, size, weights)
    scored = scored.drop("perplexity").join(rest, "key", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("rest", F.lit(0.0)))
    return scored.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.exp(-F.col("log_prob") / F.col("n_words"))).alias("perplexity"))


def _most_frequent(table: DataFrame, most: int) -> tuple[int, int]:
    """(least, words): so many words, at most ``most``, occur ``least`` times or more."""
    # a row for each count that occurs: at most about the root of twice the corpus's words
    counts = table.where("n > 0").groupBy("n").count().orderBy(F.desc("n")).collect()
    least, words_ = counts[0].n + 1, 0
    for n, k in counts:
        if words_ + k > most:
            break
        least, words_ = n, words_ + k
    return max(least, 3), words_


def _rare(docs: DataFrame, table: DataFrame, sent, held_percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the pairs with a word that isn't sent: (key, v, w, held, k) by text, and their counts and those of their words, both spooled."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            a, held = string_array(batch.column(1)), _held(batch, held_percent)
            for i, j in slices(a, _SLICE):
                h, rows = _words(a.slice(i, j - i))
                there = vocabulary.find(h) < len(vocabulary.hashes)
                before, before_there = np.empty_like(h), np.ones_like(there)
                before[1:], before_there[1:] = h[:-1], there[:-1]
                first = rows[:-1][rows[1:] > rows[:-1]]
                before[first], before_there[first] = _START, True
                some = np.flatnonzero(~(there & before_there))
                row = np.repeat(np.arange(i, j), np.diff(rows))[some]
                yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(row)), pa.array(before[some].view(np.int64)), pa.array(h[some].view(np.int64)), pa.array(held[row])], names=["key", "v", "w", "held"])

    seen = spool(_keyed(docs).mapInArrow(emit, "key long, v long, w long, held boolean").groupBy("key", "v", "w", "held").agg(F.count("*").alias("k")), "pairs")
    counted = seen.groupBy("v", "w").agg(F.sum("k").alias("c2"), F.sum(F.when(F.col("held"), F.col("k")).otherwise(0)).alias("c2_held"))
    left, right = table.select(F.col("h").alias("v"), "context", "context_train"), table.select(F.col("h").alias("w"), "n", "n_train")
    return seen, spool(counted.join(left, "v").join(right, "w"), "counts")


def _rare_cells(known: DataFrame, total_train: int) -> DataFrame:
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c2, held, context, word = (np.asarray(b.column(k)) for k in ("c2", "c2_held", "context_train", "n_train"))
                yield from _histogram((c2 - held)[held > 0], context[held > 0], word[held > 0], held[held > 0], total_train).to_batches()

    return known.mapInArrow(cells, "b int, q2 int, q1 int, n long")


def _rare_sums(docs: DataFrame, seen: DataFrame, known: DataFrame, total: int, size: int, weights: np.ndarray) -> DataFrame:
    """(key, rest): what the pairs with a word that isn't sent add to the log_prob of a text."""

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = log_probability(*(np.asarray(b.column(k)) for k in ("c2", "n", "context")), total, size, weights)
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("w"), pa.array(value)], names=["v", "w", "value"])

    sums = seen.join(known.mapInArrow(logs, "v long, w long, value double"), ["v", "w"]).groupBy("key").agg(F.sum(F.col("k") * F.col("value")).alias("sum"))
    copies = _keyed(docs).groupBy("key").count()
    return sums.join(copies, "key").select("key", (F.col("sum") / F.col("count")).alias("rest"))
