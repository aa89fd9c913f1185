"""Near-duplicate documents: SimHash fingerprints of 128 bits, compared exactly by stretches of bits or tile by tile."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import components, fresh, local_labels, need, partitions, readable, spool
from .textbytes import U64, mix, slices, string_array, words

RADIUS = 22
_SPREAD = sum(((np.arange(256, dtype=np.uint64) >> U64(b)) & U64(1)) << U64(8 * b) for b in range(8))


def fingerprints(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) words of the fingerprint and the number of distinct words of each text: each distinct word in lower case votes on every bit, ties are 0."""
    n = len(a)
    out, sizes = np.zeros((n, 2), np.uint64), np.zeros(n, np.int64)
    for i, j in slices(a):
        h, _, _, rows, _ = words(a.slice(i, j - i))
        row = np.repeat(np.arange(j - i), np.diff(rows))
        if not len(h):
            continue
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[first], row[first]
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        sizes[i:j] = np.diff(bounds)
        # counters of one byte, eight to a word: rows are cut into blocks of at most 255 votes, and the blocks then added
        place = np.arange(len(h)) - bounds[row]
        block = np.flatnonzero(place % 255 == 0)
        octets = np.stack((mix(h), mix(h ^ U64(0xA0761D6478BD642F))), axis=1).view(np.uint8)
        votes = np.empty((len(block), 16), np.uint64)
        for k in range(16):
            votes[:, k] = np.add.reduceat(_SPREAD[octets[:, k]], block)
        counts = votes.view(np.uint8).reshape(len(block), 128)
        some = np.flatnonzero(np.diff(bounds))
        total = np.add.reduceat(counts.astype(np.int32), np.searchsorted(block, bounds[some]), axis=0)
        bits = 2 * total > np.diff(bounds)[some][:, None]
        out[i + some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out, sizes


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool, tile: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of fingerprints at most radius bits apart; both in order of their population count. With same, only positions in a before those in b."""
    ones_a, ones_b = (np.bitwise_count(x).sum(axis=1).astype(int) for x in (a, b))
    high = 16  # rows at a time, so that the buffers stay in the processor's cache
    buffer, count, near = np.empty((high, tile), np.uint64), np.empty((high, tile), np.uint8), np.empty((high, tile), bool)
    for j in range(0, len(b), tile):
        right0, right1 = np.ascontiguousarray(b[j : j + tile, 0]), b[j : j + tile, 1]
        low, most = ones_b[j] - radius, ones_b[min(len(b), j + tile) - 1] + radius
        n = len(right0)
        for i in range(0, min(len(a), j + tile) if same else len(a), high):
            left = a[i : i + high]
            m = len(left)
            if ones_a[i + m - 1] < low or ones_a[i] > most:  # counts of ones differ beyond the radius in the whole tile
                continue
            x, c, f = buffer[:m, :n], count[:m, :n], near[:m, :n]
            np.bitwise_xor(left[:, :1], right0[None, :], out=x)
            np.bitwise_count(x, out=c)
            np.less_equal(c, radius, out=f)
            at = np.flatnonzero(f if f.base is None else np.ascontiguousarray(f))
            if len(at):
                p, q = np.divmod(at, n)
                full = c[p, q].astype(int) + np.bitwise_count(left[p, 1] ^ right1[q])
                ok = full <= radius
                if same:
                    ok &= p + i < q + j
                if ok.any():
                    yield p[ok] + i, q[ok] + j


def _cut(radius: int, m: int) -> list[tuple[int, int, int]]:
    """(first bit, width, most) of m stretches of the 128 bits: two fingerprints at most radius apart differ in at most so many bits of one of them."""
    at = [128 * k // m for k in range(m + 1)]
    return [(at[k], at[k + 1] - at[k], (radius + 1) * (k + 1) // m - (radius + 1) * k // m - 1) for k in range(m)]


def _stretch(f: np.ndarray, first: int, width: int) -> np.ndarray:
    word, shift = divmod(first, 64)
    v = f[:, word] >> U64(shift)
    if shift + width > 64:
        v = v | f[:, word + 1] << U64(64 - shift)
    return (v & U64((1 << width) - 1)).astype(np.int64)


@cache
def _masks(width: int, most: int) -> np.ndarray:
    """All numbers of so many bits of which at most ``most`` are set, 0 first."""
    every = [np.zeros(1, np.int64)] if most >= 0 else [np.zeros(0, np.int64)]
    for n in range(1, most + 1):
        every.append(np.array([sum(1 << b for b in x) for x in combinations(range(width), n)], np.int64))
    return np.concatenate(every)


def indexed_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool, m: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``close_pairs``, in no order, by an index of each of m stretches of bits: rows that differ in few bits of one are compared. A pair is given for the first stretch by which it is met."""
    cuts = _cut(radius, m)
    for k, (first, width, least) in enumerate(cuts):
        va, vb = _stretch(a, first, width), _stretch(b, first, width)
        order_a, order_b = np.argsort(va, kind="stable"), np.argsort(vb, kind="stable")
        # the half that holds less of the stretch tells more of the rest
        half = 0 if first + width // 2 >= 64 else 1
        a0, b0, a1, b1 = a[order_a, half], b[order_b, half], a[order_a, 1 - half], b[order_b, 1 - half]
        bounds = np.zeros((1 << width) + 1, np.int32)
        np.cumsum(np.bincount(vb, minlength=1 << width), out=bounds[1:])
        va = va[order_a]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(va)), bool), va[1:] != va[:-1])))
        size, values = np.diff(np.append(start, len(va))), va[start]
        for mask in _masks(width, least):
            other = values ^ mask
            low = bounds[other]
            n = bounds[other + 1] - low
            if same and mask:
                n[other < values] = 0  # met from the other side
            some = np.flatnonzero(n)
            if not len(some):
                continue
            row = np.repeat(start[some], size[some]) + _count_up(size[some])
            low, n = np.repeat(low[some], size[some]), np.repeat(n[some], size[some]).astype(np.int64)
            ends = np.cumsum(n)
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + most, "right")))
                p = np.repeat(row[i:j], n[i:j])
                q = np.repeat(low[i:j] - (ends[i:j] - n[i:j] - (ends[i] - n[i])), n[i:j]) + np.arange(len(p))
                i = j
                near = np.bitwise_count(a0[p] ^ b0[q])
                at = np.flatnonzero(near <= radius)
                p, q = p[at], q[at]
                ok = near[at].astype(int) + np.bitwise_count(a1[p] ^ b1[q]) <= radius
                p, q = order_a[p[ok]], order_b[q[ok]]
                if same:
                    if not mask:
                        p, q = p[p < q], q[p < q]
                    p, q = np.minimum(p, q), np.maximum(p, q)
                for first_, width_, least_ in cuts[:k]:
                    if len(p):
                        later = np.bitwise_count(_stretch(a[p] ^ b[q], first_, width_)) > least_
                        p, q = p[later], q[later]
                if len(p):
                    yield p, q


def _count_up(n: np.ndarray) -> np.ndarray:
    """0 to n[k] - 1 for each k in turn."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _cheapest(a: np.ndarray, b: np.ndarray, radius: int, same: bool, sample: int = 256) -> int:
    """The number of stretches by which ``indexed_pairs`` is fastest, 0 if tiles are. The rows that meet are estimated from a sample of a, which decides on speed alone."""
    best, cost = 0, 4.0 * len(a) * len(b)  # nanoseconds
    rows = a[:: max(1, len(a) // sample)]
    for m in range(7, 13):
        cuts = _cut(radius, m)
        looked = sum(comb(w, n) for _, w, most in cuts for n in range(most + 1))
        if looked > 20_000 or 30.0 * looked * len(a) + 40_000.0 * looked > cost:
            continue
        met = 0
        for first, width, most in cuts:
            held = np.bincount(_stretch(b, first, width), minlength=1 << width)
            v = _stretch(rows, first, width)
            met += sum(int(held[v ^ x].sum()) for x in _masks(width, most))
        now = 30.0 * looked * len(a) + 40_000.0 * looked + 20.0 * met * len(a) / len(rows)
        if now < cost:
            best, cost = m, now
    return best


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``close_pairs``, by an index where that costs less than all comparisons."""
    m = _cheapest(a, b, radius, same)
    return indexed_pairs(a, b, radius, same, m) if m else close_pairs(a, b, radius, same)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, hi, lo, n_distinct) of every document, spooled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, n = fingerprints(string_array(batch.column(1)))
            f = f.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(n)], names=["doc_id", "text_hash", "hi", "lo", "n_distinct"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(k, T.LongType()) for k in ("text_hash", "hi", "lo", "n_distinct"))])
    return spool(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema), "fingerprints")


def groups(docs: DataFrame, radius: int = RADIUS, band_rows: int = 131_072) -> DataFrame:
    """doc_id, text_hash, group_id, n_links and keep of every row of docs, without its text.

    Fingerprints at most ``radius`` of 128 bits apart are linked, and so are their groups; ``group_id`` is the
    least doc_id of the group (null if there is none), ``n_links`` the number of other rows at most ``radius`` bits from this one, copies among them,
    and ``keep`` is true in exactly one row of the group, the first by doc_id and text hash.
    No link is missed: fingerprints in order of population count are cut into bands, and every pair of bands is compared
    by stretches of bits, in one of which two at most ``radius`` apart differ little (or, where that costs more,
    all with all, passing over tiles whose counts differ beyond the radius). Only a spanning forest of the links is sent on.

    Texts without a word (null, empty, signs only) have no fingerprint: each such row is a group of its
    own. Equal rows are one group, of which one row has keep. A null doc_id comes last. Other columns are not read.
    """
    need(docs, "doc_id", "text")
    docs = readable(docs)
    return _grouped(fingerprint_table(docs), radius, band_rows)


def _grouped(table: DataFrame, radius: int, band_rows: int) -> DataFrame:
    spark = table.sparkSession
    some = table.where("n_distinct > 0")
    fps = spool(some.groupBy("hi", "lo").agg(F.count("*").alias("rows")).withColumn("ones", F.bit_count("hi") + F.bit_count("lo")), "distinct")
    n = fps.count()
    roots = near = None
    if n > 1:
        bands = max(min(16, -(-n // 1024)), -(-n // band_rows))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyspark

            got = [b for b in batches if b.num_rows]
            if got:
                t = pa.Table.from_batches(got)
                ones = t["ones"].to_numpy()
                order = np.argsort(ones, kind="stable")
                f = np.stack((t["hi"].to_numpy(), t["lo"].to_numpy()), axis=1)[order]
                rows = t["rows"].to_numpy()[order]
                yield pa.RecordBatch.from_arrays([pa.array([pyspark.TaskContext.get().partitionId()], pa.int32()), pa.array([int(ones.min())], pa.int32()), pa.array([int(ones.max())], pa.int32()), pa.array([f.tobytes()]), pa.array([rows.tobytes()])], names=["band", "low", "high", "fps", "rows"])

        banded = spool(fps.repartitionByRange(bands, "ones", "hi").mapInArrow(gather, "band int, low int, high int, fps binary, rows binary"), "bands")
        ends = banded.select("band", "low", "high").orderBy("band").toPandas()  # a row per band: few, as each is large
        # bands are in order of population counts, so the partners of each are the bands from first to last
        low, high = ends.low.to_numpy(), ends.high.to_numpy()
        first, last = np.searchsorted(high, low - radius, "left"), np.searchsorted(low, high + radius, "right") - 1
        reach = spark.createDataFrame([(int(b), int(ends.band[i]), int(ends.band[j])) for b, i, j in zip(ends.band, first, last, strict=True)], "band int, first int, last int")
        ranged = banded.join(reach, "band")
        # a band goes once to each pair that it is in, and nothing moves again; numbers between bands that no band has meet nothing
        left = ranged.select(F.col("band").alias("x"), F.explode(F.sequence("band", "last")).alias("y"), F.lit(0).alias("side"), "fps", "rows")
        right = ranged.where("first < band").select(F.explode(F.sequence(F.col("first"), F.col("band") - 1)).alias("x"), F.col("band").alias("y"), F.lit(1).alias("side"), "fps", "rows")
        tasks = left.union(right).repartition(max(partitions(spark), bands * (bands + 1) // 4), "x", "y").sortWithinPartitions("x", "y", "side")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A spanning forest of the links (ah, al, bh, bl), and the rows near to each fingerprint: those have no b but n."""
            a = b = rows_a = None
            before_ = None
            for batch in batches:
                for k in range(batch.num_rows):
                    x, y, side = (batch.column(c)[k].as_py() for c in ("x", "y", "side"))
                    b, rows_b = np.frombuffer(batch.column("fps")[k].as_buffer(), np.uint64).reshape(-1, 2), np.frombuffer(batch.column("rows")[k].as_buffer(), np.int64)
                    if side == 0:
                        a, rows_a, before_ = b, rows_b, (x, y)
                    if side == 0 and x < y or before_ != (x, y):
                        continue
                    shift = 0 if x == y else len(a)
                    label = np.arange(len(a) if x == y else len(a) + len(b))
                    near_a, near_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
                    links = []
                    for p, q in near_pairs(a, b, radius, x == y):
                        np.add.at(near_a, p, rows_b[q])
                        np.add.at(near_b, q, rows_a[p])
                        fresh = label[p] != label[q + shift]
                        if fresh.any():
                            before = np.unique(np.concatenate((label[p[fresh]], label[q[fresh] + shift])))
                            label = local_labels(len(label), p[fresh], q[fresh] + shift, label)
                            gone = before[label[before] != before]
                            links.append(np.stack((label[gone], gone), 1))
                    if links:
                        e = np.concatenate(links)
                        every = a if x == y else np.concatenate((a, b))
                        u, v = every[e[:, 0]].view(np.int64), every[e[:, 1]].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), pa.array(v[:, 0]), pa.array(v[:, 1]), pa.nulls(len(u), pa.int64())], names=["ah", "al", "bh", "bl", "n"])
                    for f, n in ((a, near_a), (b, near_b)):
                        if len(at := np.flatnonzero(n)):
                            u, none = f[at].view(np.int64), pa.nulls(len(at), pa.int64())
                            yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), none, none, pa.array(n[at])], names=["ah", "al", "bh", "bl", "n"])

        both = spool(tasks.mapInArrow(compare, "ah long, al long, bh long, bl long, n long"), "links")
        links = both.where("n is null")
        near = both.where("n is not null").groupBy(F.col("ah").alias("hi"), F.col("al").alias("lo")).agg(F.sum("n").alias("near"))
        # nodes are numbered by a hash of the fingerprint
        number = lambda x, y: F.xxhash64(x, y)
        found = components(links.select(number("ah", "al").alias("a"), number("bh", "bl").alias("b")))
        roots = found.select(F.col("node"), F.col("root"))
    own = some.join(fps.select("hi", "lo", "rows"), ["hi", "lo"])
    own = own.withColumn("near", F.lit(0)) if near is None else own.join(near, ["hi", "lo"], "left")
    own = own.withColumns({"node": F.xxhash64("hi", "lo"), "n_links": F.col("rows") - 1 + F.coalesce("near", F.lit(0))})
    if roots is None:
        rooted = own.withColumn("root", F.col("node"))
    else:
        rooted = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    lone = "n_distinct = 0"
    best = rooted.groupBy("root").agg(F.min(first).alias("best"))
    # a row among equal rows: only rows that are repeated whole are numbered
    same = F.row_number().over(_window())
    out = rooted.withColumn("turn", same).join(best, "root").select(
        "doc_id", "text_hash", F.col("best.doc_id").alias("group_id"), "n_links", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")) & (F.col("turn") == 1)).alias("keep")
    )
    return out.union(table.where(lone).select("doc_id", "text_hash", F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keep")))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "text_hash").orderBy("hi")


def deduplicated(docs: DataFrame, radius: int = RADIUS, band_rows: int = 131_072) -> DataFrame:
    """docs with one document of each group, as ``groups`` has it; all columns as they are."""
    need(docs, "doc_id", "text")
    docs = readable(docs)
    found = spool(groups(docs, radius, band_rows), "groups")
    away = found.groupBy("doc_id", "text_hash").agg(F.max("keep").alias("stays"), F.count("*").alias("n"), F.sum(F.col("keep").cast("long")).alias("kept"))
    gone, thin = away.where("not stays"), away.where("stays and kept < n")
    match = lambda d, k: d["doc_id"].eqNullSafe(k["doc_id"]) & (F.xxhash64(d["text"]) == k["text_hash"])
    left = docs.join(gone, match(docs, gone), "left_anti")
    if thin.isEmpty():
        return left
    # rows equal in doc_id and text, of which one stays
    single = left.join(thin, match(left, thin), "left_anti")
    (name,) = fresh(docs, "__key")
    repeated = left.join(thin, match(left, thin), "left_semi").withColumn(name, F.xxhash64("text")).dropDuplicates(["doc_id", name]).drop(name)
    return single.unionByName(repeated)
