"""What the operators share: the shared folder, spooled tables, added columns and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and everything runs in one process, as in tests, one of our own, which goes when the process ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(shared_dir, "own", None)
        if not at:
            own = tempfile.mkdtemp(prefix="textloom-")
            atexit.register(shutil.rmtree, own, True)
            at = shared_dir.own = f"file://{own}"
    return at.rstrip("/")


_spooled: list[str] = []


def spool(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing. ``clear`` removes what was written."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _spooled.append(at)
    return spark.read.schema(df.schema).parquet(at)


def spooled() -> int:
    """How many tables have been spooled, to be given to ``clear``."""
    return len(_spooled)


def remove(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Removes the tables spooled since then. Results that haven't been written yet can't be read any more."""
    for at in _spooled[since:]:
        remove(spark, at)
    del _spooled[since:]


def readable(docs: DataFrame) -> DataFrame:
    """docs with the bytes of text that aren't UTF-8 read as U+FFFD, the rule of all operators."""
    return docs.withColumn("text", F.make_valid_utf8("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def need(df: DataFrame, *columns: str) -> None:
    """Fails early where a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that df doesn't have: underscores are added until none of its columns is so called, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def extended(df: DataFrame, **added: T.DataType) -> tuple[T.StructType, list[str]]:
    """Schema of df with columns added, and the columns kept: one of an added name is replaced."""
    kept = [f for f in df.schema.fields if f.name not in added]
    return T.StructType(kept + [T.StructField(k, v) for k, v in added.items()]), [f.name for f in kept]


def with_columns(batch: pa.RecordBatch, kept: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + list(added.values()), names=kept + list(added))


def local_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Connected components of 0..n-1: each gets the least member as its label."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while not np.array_equal(up := label[label], label):
            label = up


def components(edges: DataFrame, on_driver: int = 200_000) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the component's least node.

    Up to ``on_driver`` edges are solved in the driver's memory; beyond that the same
    labels come from rounds of star contraction (large star, small star), each spooled.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    edges = spool(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if edges.limit(on_driver + 1).count() <= on_driver:
        table = edges.toPandas()
        nodes, at = np.unique(np.concatenate((table.a.to_numpy(), table.b.to_numpy())), return_inverse=True)
        label = local_labels(len(nodes), at[: len(table)], at[len(table) :])
        rows = pa.table({"node": pa.array(nodes), "root": pa.array(nodes[label])})
        schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
        return spark.createDataFrame(rows.to_pandas(), schema) if len(nodes) else spark.createDataFrame([], schema)
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("x"), "low").where("x <> low").select(F.col("x").alias("a"), F.col("low").alias("b")).distinct()
        edges = spool(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
        before = now
