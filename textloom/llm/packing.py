"""Packing of documents into training windows by non-negative least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import need, partitions, readable, spool


#: The least squares have a row per bin and a column per combination, of which there are about a twelfth of the square of the bins: 90 MB at this number.
MOST_BINS = 512


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with least |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(w).max(initial=0)))
    for _ in range(3 * n):
        free = ~passive & (w > tol)
        if not free.any():
            break
        passive[np.argmax(np.where(free, w, -np.inf))] = True
        while True:
            on = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (s > 0).all():
                break
            bad = s <= 0
            step = (x[on][bad] / np.maximum(x[on][bad] - s[bad], 1e-300)).min()
            x[on] += step * (s - x[on])
            gone = on[x[on] <= 1e-12]
            if not len(gone):
                gone = on[bad]
            x[gone], passive[gone] = 0, False
        x[:] = 0
        x[on] = s
        w = a.T @ (b - a @ x)
    return x


def shapes(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Combinations of up to depth bins, largest first, that fill a window of so many bins."""
    out: list[tuple[int, ...]] = []

    def extend(made: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(made)
        elif len(made) < depth:
            for b in range(min(left, made[-1] if made else left), 0, -1):
                if b * (depth - len(made)) >= left:
                    extend((*made, b), left - b)

    extend((), bins)
    return out


def plan(histogram: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use up the histogram exactly; histogram[i] pieces have the bin i + 1.

    Least squares choose the repeats of combinations that fill the window; they are rounded
    and lowered where they use more than there is, and what is left is packed greedily,
    largest piece first, each window filled with the largest pieces that still fit.
    """
    bins, left = len(histogram), histogram.astype(np.int64).copy()
    if not left.sum():
        return []
    combos = shapes(bins, depth)
    a = np.zeros((bins, len(combos)))
    for j, c in enumerate(combos):
        for b in c:
            a[b - 1, j] += 1
    weight = np.sqrt(np.arange(1, bins + 1) / bins)[:, None]  # waste counts by its length
    scale = max(1.0, float(histogram.max()))
    repeats = np.round(nnls(a * weight, histogram / scale * weight[:, 0]) * scale).astype(np.int64)
    used = (a @ repeats).astype(np.int64)
    for b in np.flatnonzero(used > left):
        for j in sorted(np.flatnonzero((a[b] > 0) & (repeats > 0)), key=lambda j: -repeats[j]):
            if (over := used[b] - left[b]) <= 0:
                break
            less = min(repeats[j], -(-over // int(a[b, j])))
            repeats[j] -= less
            used -= (a[:, j] * less).astype(np.int64)
    out = [(combos[j], int(repeats[j])) for j in np.flatnonzero(repeats)]
    left -= used
    while left.any():
        made, room, have = [], bins, left.copy()
        while room and have[:room].any():
            b = int(np.flatnonzero(have[:room])[-1]) + 1
            made.append(b)
            have[b - 1] -= 1
            room -= b
        need_ = np.bincount(np.array(made) - 1, minlength=bins)
        times = int((left[need_ > 0] // need_[need_ > 0]).min())
        out.append((tuple(made), times))
        left -= need_ * times
    return out


def pack(docs: DataFrame, window: int = 2048, granule: int = 16, depth: int = 3) -> DataFrame:
    """One row per packed piece: pack_id, slot, doc_id, piece, start_word, n_words, pack_offset.

    Lengths are whole words of ``text`` (runs outside ``[\\t\\n\\f\\r ]``, as in the other operators). A longer text is cut into full
    windows and a rest; each piece is held in units of ``granule`` words and starts at
    ``pack_offset`` of its window. Every word of every document is in exactly one piece.

    A null or empty text, or one of white space, has no piece. A null doc_id is packed as null.
    Rows repeated or of the same doc_id are packed each. Other columns are not read, whatever their names.
    An empty table gives no rows. More than ``MOST_BINS`` granules in a window are refused.
    """
    if window % granule or window // granule > MOST_BINS:
        raise ValueError(f"window must be a multiple of granule, at most {MOST_BINS} times as long")
    need(docs, "doc_id", "text")
    docs = readable(docs)
    spark, bins = docs.sparkSession, window // granule
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\t\n\f\r ]+")), F.lit(0))
    lengths = spool(docs.select("doc_id", n.cast("long").alias("n")).where("n > 0"), "lengths")
    pieces = lengths.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / window))).alias("piece")).select(
        "doc_id", "n", "piece", F.least(F.lit(window), F.col("n") - F.col("piece") * window).cast("int").alias("n_words")
    )
    buckets = 4 * partitions(spark)
    pieces = pieces.withColumns({"bin": F.ceil(F.col("n_words") / granule).cast("int"), "bucket": F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")})
    per = pieces.groupBy("bin", "bucket").agg(F.count("*").alias("n_pieces"))
    histogram = np.zeros(bins, np.int64)
    for row in per.groupBy("bin").agg(F.sum("n_pieces").alias("n")).collect():  # a row per bin
        histogram[row["bin"] - 1] = row["n"]
    slots, at, pack_id = [], np.zeros(bins, np.int64), 0
    for made, times in plan(histogram, depth):
        offset = 0
        for slot, b in enumerate(made):
            slots.append((b, int(at[b - 1]), int(at[b - 1]) + times, pack_id, slot, offset * granule))
            at[b - 1] += times
            offset += b
        pack_id += times
    # as many rows as there are combinations in use, whatever the input
    slots_df = spark.createDataFrame(slots, "bin int, low long, high long, base long, slot int, pack_offset int")
    before = per.select("bin", "bucket", (F.sum("n_pieces").over(Window.partitionBy("bin").orderBy("bucket")) - F.col("n_pieces")).alias("before"))
    order = Window.partitionBy("bin", "bucket").orderBy("doc_id", "piece", "n")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(before, ["bin", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    s = F.broadcast(slots_df).alias("s")
    p = ranked.alias("p")
    return p.join(s, (F.col("p.bin") == F.col("s.bin")) & (F.col("p.rank") >= F.col("s.low")) & (F.col("p.rank") < F.col("s.high"))).select(
        (F.col("s.base") + F.col("p.rank") - F.col("s.low")).alias("pack_id"), "slot", "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * window).alias("start_word"), "n_words", "pack_offset"
    )
