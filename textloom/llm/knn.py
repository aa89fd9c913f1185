"""Exact k nearest neighbours by a Voronoi join of queries with all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import need, spool

_EPS = np.finfo(np.float64).eps


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64())
    return np.asarray(flat).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by a product of matrices, and a bound on their error.

    Both sides are taken from the middle of ``b``, as the product loses what is small against the vectors' own lengths. A sum of dim products of rounded factors is off by at most
    about dim + 2 roundings of the sum of their sizes, of which there are three, each at most the greater of the lengths' squares, doubled in the mixed one.
    """
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    d = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
    error = 8 * (a.shape[1] + 4) * _EPS * (aa.max(initial=0) + bb.max(initial=0))
    # what the differences themselves lost when they were rounded
    error += 8 * _EPS * (np.abs(middle).max(initial=0) + 1e-300) * np.sqrt(a.shape[1]) * (np.sqrt(aa.max(initial=0)) + np.sqrt(bb.max(initial=0)))
    return np.maximum(d, 0, out=d), float(error)


def nearest(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, row of the neighbour, distance), by distance and then id, without pairs of one id. Distances that decide are measured directly, difference by difference."""
    rows, found, dist = [], [], []
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        if not len(data):
            continue
        d, error = squared(q, data)
        d[query_ids[i : i + 256][:, None] == data_ids[None, :]] = np.inf
        m = min(k, d.shape[1])
        kth = np.partition(d, m - 1, axis=1)[:, m - 1]
        for r in range(len(q)):
            at = np.flatnonzero((d[r] <= kth[r] + 2 * error) & (d[r] < np.inf))
            exact = np.sqrt(((data[at] - q[r]) ** 2).sum(axis=1))
            order = np.lexsort((data_ids[at], exact))[:k]
            rows.append(np.full(len(order), i + r))
            found.append(at[order])
            dist.append(exact[order])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(dist)


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind = vectors.schema[vector_col].dataType
    # four bytes a number where the column has no more: distances are computed in eight either way
    to = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(to).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & whole)


def _least(cell: np.ndarray, to: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the k least distances of each cell, one for each id."""
    order = np.lexsort((to, ids, cell))
    one = np.ones(len(order), bool)
    one[1:] = (cell[order][1:] != cell[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[one]
    order = order[np.lexsort((ids[order], to[order], cell[order]))]
    first = np.flatnonzero(np.diff(cell[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    order = order[rank < k]
    return cell[order], to[order], ids[order]


def knn_join(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", group_queries: int = 1024, block_rows: int = 32_768) -> DataFrame:
    """(id, neighbor_id, rank, distance): for every row of ``queries`` (all of vectors, unless given) the k rows of vectors of least Euclidean distance, ties by id.

    Vectors belong to the cell of their closest pivot. From each cell's summary (the k + 1 least distances of its members, of different ids, to the pivot) and a query's distances to the pivots
    follows a bound on the distance of the query's k-th neighbour. Cells of queries that are close form a group; a vector is sent to a group only if, by the triangle inequality or by the plane
    midway between two pivots, it can lie within the bound of one of its cells. A group's vectors are cut into blocks of about ``block_rows``, each block is solved with the
    group's queries, and the best k of the blocks' answers count. Nothing is sampled but the pivots, which don't change the result; all bounds allow for rounding, and
    distances that decide are measured difference by difference.

    Ids are integers, else the call fails. A null vector, one with a null, NaN or infinity in it, or of another length than most of vectors is left out, as is a null id. Rows of one id aren't each
    other's neighbours; each is a query and a neighbour of others. With fewer than k others there are fewer rows. Other columns are not read.
    """
    need(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    if not isinstance(id_type, T.IntegralType):
        raise ValueError(f"{id_col} must be an integer, not {id_type.simpleString()}")
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("neighbor_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    data = _clean(vectors, id_col, vector_col)
    lengths = data.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths or not lengths[0]["n"]:
        return spark.createDataFrame([], out)
    dim, n = lengths[0]["n"], lengths[0]["count"]
    data = data.where(F.size("v") == dim)
    kind = data.schema["v"].dataType.simpleString()
    asked = data if queries is None else _clean(queries, id_col, vector_col).where(F.size("v") == dim)
    # a number of its own for each query, which holds as the table is read again
    asked = spool(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], out)
    # at most 2048 pivots: so much goes to every worker, whatever the table
    pivots = pivots or int(max(1, min(2048, max(n**0.5 / 2, n / 2000))))
    chosen = np.unique(np.array([r.v for r in data.orderBy(F.xxhash64("id"), "id").limit(min(pivots, 2048)).collect()], float), axis=0)
    sent = spark.sparkContext.broadcast(chosen)

    def placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Cell, distance to its pivot, and by how much another's square may be less after all."""
        p = sent.value
        made = [squared(x[i : i + 4096], p) for i in range(0, len(x), 4096)]
        cell = np.concatenate([d.argmin(1) for d, _ in made])
        return cell, np.sqrt(((x - p[cell]) ** 2).sum(1)), 2 * max(error for _, error in made)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least distances of each cell, of this task's rows."""
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for batch in batches:
            if batch.num_rows:
                cell, to, _ = placed(_vectors(batch.column(1)))
                best = _least(*(np.concatenate(v) for v in zip(best, (cell, to, batch.column(0).to_numpy()), strict=True)), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int32()), pa.array(best[1]), pa.array(best[2])], names=["cell", "to", "id"])

    per_id = data.mapInArrow(summarise, "cell int, to double, id long").groupBy("cell", "id").agg(F.min("to").alias("to"))
    ranked = per_id.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("to", "id"))).where(F.col("rank") <= k + 1)
    table = ranked.select("cell", "to").toPandas()  # k + 1 numbers for each pivot
    cells, to = table.cell.to_numpy(), table.to.to_numpy() * (1 + 4 * dim * _EPS)
    summary = spark.sparkContext.broadcast((cells, to))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its cell, its distance to the pivot and a bound on that of its k-th neighbour."""
        cells, to = summary.value
        for batch in batches:
            x = _vectors(batch.column(1))
            if not len(x):
                continue
            cell, own, slip = placed(x)
            limit = np.full(len(x), np.inf)
            for i in range(0, len(x), 1024):
                d, error = squared(x[i : i + 1024], sent.value)
                far = np.sqrt(d[:, cells] + error) + to[None, :]
                if far.shape[1] > k:  # k + 1 ids, of which one may be the query's
                    limit[i : i + 1024] = np.partition(far, k, axis=1)[:, k]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(own * (1 + 4 * dim * _EPS)), pa.array(limit), pa.array(np.full(len(x), slip))], names=["q", "id", "v", "cell", "own", "limit", "slip"])

    bounded = spool(asked.mapInArrow(bound, f"q long, id long, v {kind}, cell int, own double, limit double, slip double"), "bounded")
    per_cell = bounded.groupBy("cell").agg(F.max("own").alias("own"), F.max("limit").alias("limit"), F.max("slip").alias("slip"), F.count("*").alias("n")).orderBy("cell").toPandas()  # a row for each pivot
    group_of = _groups(chosen[per_cell.cell.to_numpy()], per_cell.n.to_numpy(), group_queries)
    groups = int(group_of.max()) + 1
    rules = spark.sparkContext.broadcast((per_cell.cell.to_numpy(), per_cell.own.to_numpy(), per_cell.limit.to_numpy(), per_cell.slip.to_numpy(), group_of, groups))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with the groups that it may have a query of."""
        asking, radius, limit, slip, group_of, groups = rules.value
        p = sent.value
        between = np.sqrt(((p[:, None, :] - p[asking][None, :, :]) ** 2).sum(2)) if len(p) * len(asking) * dim < 1 << 24 else np.sqrt(np.stack([((p - a) ** 2).sum(1) for a in p[asking]], axis=1))
        for batch in batches:
            x = _vectors(batch.column(1))
            for i in range(0, len(x), 1024):
                part = x[i : i + 1024]
                d, error = squared(part, p)
                own = d.argmin(1)
                to = d[:, asking]
                near = np.sqrt(np.maximum(to - error, 0)) - radius[None, :] <= limit[None, :]
                # a query lies on its pivot's side of the plane midway between the pivots of its cell and the vector's; rounding may have put either on the wrong one
                apart = between[own]
                plane = np.divide(to - d[np.arange(len(part)), own][:, None] - 4 * error, 2 * apart * (1 + 1e-9), out=np.full_like(to, -np.inf), where=apart > 0)
                near &= plane <= limit[None, :] * (1 + 1e-9) + np.divide(slip[None, :], apart, out=np.zeros_like(to), where=apart > 0)
                into = np.zeros((len(part), groups), bool)
                for g in range(groups):
                    into[:, g] = near[:, group_of == g].any(axis=1)
                row, g = np.nonzero(into)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32()), pa.array(g, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), batch.column(1).slice(i, len(part)), lists], names=["id", "v", "groups"])

    needed = spool(data.mapInArrow(replicate, f"id long, v {kind}, groups array<int>").where(F.size("groups") > 0), "needed")
    sizes = needed.select(F.explode("groups").alias("g")).groupBy("g").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    blocks = {r.g: r.blocks for r in sizes.collect()}  # a row for each group
    small = spark.createDataFrame([(int(c), int(g), blocks.get(int(g), 0)) for c, g in zip(per_cell.cell, group_of, strict=True)], "cell int, g int, blocks int")
    per_group = spark.createDataFrame(sorted(blocks.items()), "g int, blocks int")
    right = needed.select("id", "v", F.explode("groups").alias("g")).join(F.broadcast(per_group), "g").select("g", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block"), "id", "v")
    # queries of a crowded cell are in parts too, so that a task has a bounded number of either
    parts = {int(g): max(1, -(-int(m) // (2 * group_queries))) for g, m in per_cell.assign(g=group_of).groupby("g").n.sum().items()}
    turn = spark.createDataFrame(sorted(parts.items()), "g int, parts int")
    left = bounded.join(F.broadcast(small), "cell").join(F.broadcast(turn), "g").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).where("blocks > 0").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "q", "id", "v")
    right = right.join(F.broadcast(turn), "g").select("g", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")

    def solve(ask: pa.Table, have: pa.Table) -> pa.Table:
        q, ids, x = (ask[c].combine_chunks() for c in ("q", "id", "v"))
        there, y = have["id"].combine_chunks().to_numpy(), _vectors(have["v"].combine_chunks())
        row, at, dist = nearest(_vectors(x), ids.to_numpy(), y, there, k) if len(q) and len(there) else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"q": q.take(pa.array(row)), id_col: ids.take(pa.array(row)), "neighbor_id": pa.array(there[at], pa.int64()), "distance": pa.array(dist)})

    wide = T.StructType([T.StructField("q", T.LongType()), T.StructField(id_col, T.LongType()), T.StructField("neighbor_id", T.LongType()), T.StructField("distance", T.DoubleType())])
    found = left.groupBy("g", "block", "part").cogroup(right.groupBy("g", "block", "part")).applyInArrow(solve, wide)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k)
    return best.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in out.fields))


def _groups(pivots: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """A group for each cell that is asked from: cells around centers far apart from one another, as many as there are times ``most`` queries."""
    wanted = min(len(pivots), int(-(-n.sum() // most)))
    far, centers = np.full(len(pivots), np.inf), []
    group = np.zeros(len(pivots), np.int64)
    for g in range(wanted):
        at = int(np.argmax(n)) if g == 0 else int(np.argmax(far))
        centers.append(at)
        d = ((pivots - pivots[at]) ** 2).sum(1)
        group[d < far] = g
        far = np.minimum(far, d)
    return np.unique(group, return_inverse=True)[1].reshape(-1)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (
    SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbor_id) AS rank FROM d)
SELECT vec_id, neighbor_id, rank::INTEGER AS rank, round(dist, 6) AS distance FROM r WHERE rank <= 10
"""
