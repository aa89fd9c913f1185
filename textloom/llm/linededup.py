"""Line dedup: a sharded minimal perfect hash over distinct lines instead of a join of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import extended, fresh, need, partitions, readable, spool, with_columns
from .textbytes import U64, WS, mix, raw, slices, span_hash, string_array

_NO_DOC = (1 << 63) - 1
INDEX = "shard int, n_keys long, n_lines long, levels array<int>, bits binary, ranks binary, prints binary, counts binary, owners binary"


def _level(keys: np.ndarray, k: int, size: int) -> np.ndarray:
    """Slot of each key at level k: the high half of a fresh hash, scaled to the level's size."""
    return (((mix(keys + U64(k * 0x9E3779B97F4A7C15 + 1 & 0xFFFFFFFFFFFFFFFF)) >> U64(32)) * U64(size)) >> U64(32)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: levels of bits, a key at the first level where it's alone; its rank among set bits is its index."""

    def __init__(self, levels: list[int], bits: np.ndarray, ranks: np.ndarray):
        self.levels, self.bits, self.ranks = levels, bits, ranks

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, parts, k = [], [], 0
        while len(keys):
            size = max(64, -(-int(len(keys) * gamma) // 64) * 64)
            at = _level(keys, k, size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(size)
            parts.append(alone)
            keys = keys[~alone[at]]
            k += 1
            if k > 200:
                raise ValueError("keys must be distinct")
        flags = np.concatenate(parts) if parts else np.zeros(0, bool)
        words = np.packbits(flags, bitorder="little").view(np.uint64)
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words))[:-1])).astype(np.uint32) if len(words) else np.zeros(0, np.uint32)
        return cls(levels, words, ranks)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key below the number of keys; of an unknown key any, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for k, size in enumerate(self.levels):
            if not len(left):
                break
            at = base + _level(keys[left], k, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word[hit] & ((U64(1) << bit[hit]) - U64(1)))
            out[left[hit]] = self.ranks[at[hit] >> 6].astype(np.int64) + below
            left = left[~hit]
            base += size
        return out


class Shard:
    """Counts, and owners of repeated lines, by line hash. The owner is the least document with the line."""

    def __init__(self, row):
        self.hash = PerfectHash(list(row.levels), np.frombuffer(row.bits, np.uint64), np.frombuffer(row.ranks, np.uint32))
        self.prints, self.counts, self.owners = (np.frombuffer(b, t) for b, t in ((row.prints, np.uint32), (row.counts, np.uint32), (row.owners, np.int64)))
        self.n_owners = np.concatenate(([0], np.cumsum(self.counts > 1)))

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and owner of each key; 0 for a key that isn't there."""
        at = self.hash.index(keys)
        some = at >= 0
        some[some] = self.prints[at[some]] == _print(keys[some])
        counts, owners = np.zeros(len(keys), np.int64), np.full(len(keys), _NO_DOC)
        counts[some] = self.counts[at[some]]
        many = counts > 1
        owners[many] = self.owners[self.n_owners[at[many]]]
        return counts, owners


def _print(keys: np.ndarray) -> np.ndarray:
    return (keys * U64(0xC2B2AE3D27D4EB4F) >> U64(32)).astype(np.uint32)


def build_shard(shard: int, keys: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> dict:
    """One row of the index."""
    made = PerfectHash.build(keys)
    at = made.index(keys)
    order = np.argsort(at)
    keys, counts, owners = keys[order], counts[order], owners[order]
    return {"shard": shard, "n_keys": len(keys), "n_lines": int(counts.sum()), "levels": made.levels, "bits": made.bits.tobytes(), "ranks": made.ranks.tobytes(), "prints": _print(keys).tobytes(), "counts": np.minimum(counts, 0xFFFFFFFF).astype(np.uint32).tobytes(), "owners": owners[counts > 1].tobytes()}


def lines_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash of the trimmed line or 0 where that is empty, first line of each row and the end). Every row has a line more than it has line ends."""
    data, off = raw(a)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((off[:-1], breaks + 1)), kind="stable")
    # of equal starts (an empty row and the next, or a row that ends in a line end) order doesn't matter: the ends are sorted too
    ends = np.sort(np.concatenate((breaks, off[1:])), kind="stable")
    per_row = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
    rows = np.concatenate(([0], np.cumsum(per_row)))
    inside = ~WS[data]
    ahead = np.concatenate(([0], np.cumsum(inside)))
    full = ahead[ends] > ahead[starts]
    solid = np.flatnonzero(inside)
    h = np.zeros(len(starts), np.uint64)
    if full.any():
        first, last = solid[ahead[starts[full]]], solid[ahead[ends[full]] - 1] + 1
        h[full] = span_hash(data, first, last)[0] | U64(1)
    return starts, ends, h, rows


def _stretches(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches in which none of the columns changes."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(change)
    yield from zip(at.tolist(), [*at[1:].tolist(), len(change)], strict=True)


def _ids(column) -> np.ndarray:
    return np.asarray(column.fill_null(_NO_DOC).cast(pa.int64()))


def count_lines(docs: DataFrame) -> DataFrame:
    """(h, n, owner) of every distinct line that isn't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, ids = string_array(batch.column(1)), _ids(batch.column(0))
            for i, j in slices(a):
                _, _, h, rows = lines_of(a.slice(i, j - i))
                doc = np.repeat(ids[i:j], np.diff(rows))[h != 0]
                h = h[h != 0]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(h)))), pa.array(doc[first])], names=["h", "n", "owner"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, n long, owner long").groupBy("h").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))


def _shard_of(h, shards: int):
    return F.pmod(F.shiftrightunsigned(h, 17), F.lit(shards)).cast("int")


def build_index(docs: DataFrame, shards: int | None = None, shard_lines: int = 1_000_000) -> DataFrame:
    """The spooled index, a row per shard of about ``shard_lines`` distinct lines: perfect hash, fingerprints, counts and owners in the order of the hash, and how many lines there are in all."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([build_shard(int(pdf.shard.iloc[0]), pdf.h.to_numpy().view(np.uint64), pdf.n.to_numpy(), pdf.owner.to_numpy())])

    counted = spool(count_lines(docs), "counts")
    shards = shards or max(1, -(-counted.count() // shard_lines))
    return spool(counted.withColumn("shard", _shard_of(F.col("h"), shards)).groupBy("shard").applyInPandas(build, INDEX).withColumn("shards", F.lit(shards)), "lines")


def dedup(docs: DataFrame, min_count: int = 4, shards: int | None = None, broadcast_bytes: int = 32 << 20, task_lines: int = 4_000_000) -> DataFrame:
    """docs with text less the repeated lines, n_lines and n_removed.

    A line, trimmed of white space at its ends, that occurs ``min_count`` times or more in the table stays
    only at its first place in the document of the least doc_id that has it; elsewhere it is removed
    with its line end. Empty lines stay and aren't counted. Every document is kept, if its
    text becomes empty.

    A null text stays null with no lines; a null doc_id counts as the greatest. Rows of the same
    doc_id count as one document, and each may keep the line. Columns named n_lines or n_removed are replaced, others pass.

    An index of up to ``broadcast_bytes`` is sent to every worker; beyond that, line hashes go to their
    shard, each document's once, and only the removed lines come back to the documents. A shard with more than ``task_lines`` lines, as one with a very frequent line, is in several
    tasks. Both ways give the same rows.
    """
    need(docs, "doc_id", "text")
    docs = readable(docs)
    spark = docs.sparkSession
    index = build_index(docs, shards)
    schema, kept = extended(docs, n_lines=T.IntegerType(), n_removed=T.IntegerType())
    schema["text"].nullable = True
    size = sum(F.length(c) for c in ("bits", "ranks", "prints", "counts", "owners"))
    total, shards = index.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max("shards"), F.lit(1))).first()

    def cut(batch: pa.RecordBatch, gone_of) -> Iterator[pa.RecordBatch]:
        a = string_array(batch.column("text"))
        for i, j in slices(a):
            part = a.slice(i, j - i)
            starts, ends, h, rows = lines_of(part)
            gone = gone_of(i, j, h, rows)
            data, off = raw(part)
            text, removed = [], np.add.reduceat(gone, rows[:-1], dtype=np.int64) if len(gone) else np.zeros(0, np.int64)
            view = data.tobytes() if removed.any() else b""
            for r in np.flatnonzero(removed):
                text.append(b"\n".join(view[starts[k] : ends[k]] for k in range(rows[r], rows[r + 1]) if not gone[k]).decode(errors="replace"))
            column = batch.column("text").slice(i, j - i)
            if len(text):
                at = removed > 0
                choice = np.full(j - i, 0)
                choice[at] = np.arange(len(text))
                column = pc.if_else(pa.array(at), pa.array(text, column.type).take(pa.array(choice)), column)
            null = np.asarray(batch.column("text").slice(i, j - i).is_null())
            n = np.where(null, 0, np.diff(rows))
            arrays = {k: batch.column(k).slice(i, j - i) for k in kept} | {"text": column, "n_lines": pa.array(n, pa.int32()), "n_removed": pa.array(removed, pa.int32())}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    def repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """True at each line that its own document has had before."""
        order = np.lexsort((np.arange(len(h)), h, doc))
        again = np.zeros(len(h), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        return again

    if total <= broadcast_bytes:
        sent = spark.sparkContext.broadcast(index.collect())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = {r.shard: Shard(r) for r in sent.value}
            for batch in batches:
                ids = _ids(batch.column("doc_id"))

                def gone(i, j, h, rows, ids=ids):
                    out = np.zeros(len(h), bool)
                    row = np.repeat(np.arange(i, j), np.diff(rows))
                    some = np.flatnonzero(h)
                    shard = ((h[some] >> U64(17)) % U64(shards)).astype(np.int64)
                    for s in np.unique(shard):
                        at = some[shard == s]
                        counts, owners = of[int(s)].probe(h[at])
                        out[at] = (counts >= min_count) & (owners != ids[row[at]])
                        own = at[(counts >= min_count) & (owners == ids[row[at]])]
                        out[own] = repeated(h[own], row[own])
                    return out

                yield from cut(batch, gone)

        return docs.mapInArrow(run, schema)

    # rows of one doc_id and one text share their fate, so these two are the key on which removed lines come back
    key_name, doc_name, gone_name, own_name, right_key = fresh(docs, "__key", "__doc", "__gone", "__own", "__right")
    keyed = docs.withColumn(key_name, F.xxhash64("text"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, ids, key = string_array(batch.column("text")), _ids(batch.column("doc_id")), np.asarray(batch.column(2))
            for i, j in slices(a):
                _, _, h, rows = lines_of(a.slice(i, j - i))
                row = np.repeat(np.arange(i, j), np.diff(rows))
                some = np.flatnonzero(h)
                some = some[np.unique(np.stack((row[some].astype(np.uint64), h[some])), axis=1, return_index=True)[1]] if len(some) else some
                yield pa.RecordBatch.from_arrays([pa.array(((h[some] >> U64(17)) % U64(shards)).astype(np.int32)), pa.array(h[some].view(np.int64)), pa.array(ids[row[some]]), pa.array(key[row[some]])], names=["shard", "h", "doc", "key"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard comes before the lines that ask it; lines pass through."""
        names, shard = ["h", "doc", "key", "own"], None
        for batch in batches:
            at = batch.column(0)
            for begin, end in _stretches(np.asarray(at), np.asarray(batch.column(1)), np.asarray(batch.column(2))):
                part = batch.slice(begin, end - begin)
                if part.column(2)[0].as_py() == 0:
                    shard = Shard(type("Row", (), part.column("index")[0].as_py()))
                    continue
                counts, owners = shard.probe(part.column("h").to_numpy().view(np.uint64))
                many = pa.array(counts >= min_count)
                yield pa.RecordBatch.from_arrays([*(part.column(k).filter(many) for k in names[:3]), pa.array(owners == part.column("doc").to_numpy()).filter(many)], names=names)

    asked = keyed.select("doc_id", "text", key_name).mapInArrow(hashes, "shard int, h long, doc long, key long")
    # tasks of a shard by its number of lines: a row per shard, of which there are as many as the distinct lines fill
    tasks = index.select("shard", F.ceil(F.col("n_lines") / task_lines).cast("int").alias("tasks"))
    parts = index.withColumn("tasks", F.ceil(F.col("n_lines") / task_lines).cast("int"))
    held = [c for c in index.columns if c not in ("shard", "shards")]
    shards_ = parts.select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("turn"), F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("h", "doc", "key")), F.struct(*held).alias("index"))
    lines = asked.join(tasks, "shard").select("shard", F.pmod(F.xxhash64("doc", "key"), F.col("tasks")).cast("int").alias("turn"), F.lit(1).alias("kind"), "h", "doc", "key", F.lit(None).cast(shards_.schema["index"].dataType).alias("index"))
    answers = shards_.union(lines).repartition(partitions(spark), "shard", "turn").sortWithinPartitions("shard", "turn", "kind").mapInArrow(probe, "h long, doc long, key long, own boolean")
    per_doc = answers.groupBy("doc", "key").agg(F.collect_set(F.when(~F.col("own"), F.col("h"))).alias(gone_name), F.collect_set(F.when(F.col("own"), F.col("h"))).alias(own_name)).withColumnsRenamed({"doc": doc_name, "key": right_key})
    joined = keyed.join(per_doc, (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC)) == F.col(doc_name)) & (F.col(key_name) == F.col(right_key)), "left").drop(doc_name, right_key, key_name)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(np.asarray(c.fill_null([]).value_lengths()), np.asarray(c.fill_null([]).flatten()).view(np.uint64)) for c in (batch.column(gone_name), batch.column(own_name))]

            def gone(i, j, h, rows, lists=lists):
                row = np.repeat(np.arange(i, j), np.diff(rows))
                out = np.zeros(len(h), bool)
                for which, (lengths, values) in enumerate(lists):
                    ends = np.concatenate(([0], np.cumsum(lengths)))
                    pairs = np.repeat(np.arange(i, j), lengths[i:j]).astype(np.uint64)
                    known = np.sort(mix(values[ends[i] : ends[j]] + pairs * U64(0x9E3779B97F4A7C15)))
                    if len(known):
                        asked_ = mix(h + row.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
                        at = np.minimum(np.searchsorted(known, asked_), len(known) - 1)
                        hit = np.flatnonzero((known[at] == asked_) & (h != 0))
                        out[hit] = True if which == 0 else repeated(h[hit], row[hit])
                return out

            yield from cut(batch, gone)

    return joined.mapInArrow(apply, schema)


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents
), keyed AS (SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(12) || chr(13)) AS k FROM pieces),
counted AS (SELECT k, count(*) AS n, min(doc_id) AS owner FROM keyed WHERE k <> '' GROUP BY k),
marked AS (
    SELECT keyed.doc_id, keyed.pos, keyed.line,
        coalesce(n >= 4 AND (keyed.doc_id <> owner OR row_number() OVER (PARTITION BY keyed.doc_id, keyed.k ORDER BY keyed.pos) > 1), false) AS gone
    FROM keyed LEFT JOIN counted ON keyed.k = counted.k
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
    count(*)::INTEGER AS n_lines, (count(*) FILTER (WHERE gone))::INTEGER AS n_removed
FROM marked GROUP BY doc_id
"""
