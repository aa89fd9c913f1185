"""Label noise by distance to the labels' centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def centroids(df: DataFrame, least: int = 8, vector: str = "embedding", label: str = "label") -> DataFrame:
    """label and centroid (mean, at unit length) of every label with so many rows."""
    each = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    n = each.groupBy(label).agg(F.count("*").alias("n"))
    mean = each.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    made = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    return made.withColumn("__n", norm).select(label, F.transform("c", lambda x: x / F.col("__n")).alias("centroid")).join(n.where(F.col("n") >= least), label)


def margins(df: DataFrame, cents: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label, own and other (cosine with the row's own centroid and the best of others) and margin; labels without centroid have none. Centroids are one per label, and broadcast as one row."""
    one = cents.agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c"))).alias("cs"))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) + 1e-12
    dot = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    made = df.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(one)).withColumn("__n", norm)
    made = made.withColumn("__s", F.transform("cs", lambda s: F.struct(s["l"].alias("l"), (dot(s["c"]) / F.col("__n")).alias("v"))))
    pick = lambda same: F.array_max(F.transform(F.filter("__s", (lambda s: s["l"] == F.col(label)) if same else (lambda s: s["l"] != F.col(label))), lambda s: s["v"]))
    return made.select(key, label, pick(True).alias("own"), pick(False).alias("other")).withColumn("margin", F.col("own") - F.col("other"))


def noise_bands(df: DataFrame, floor: float = -0.15, gray_keep: float = 0.7, key: str = "vec_id", label: str = "label") -> DataFrame:
    """margins with band: label-noise below the floor; of those below 0 the best share of each label is kept and the rest is gray-zone-drop; null where kept."""
    gray = (F.col("margin") >= floor) & (F.col("margin") < 0)
    w = Window.partitionBy(label, gray)
    made = df.withColumns({"__n": F.count("*").over(w), "__r": F.row_number().over(w.orderBy(F.desc("margin"), key)), "__g": gray})
    kept = F.floor(F.col("__n") * gray_keep + 0.9999)
    return made.withColumn("band", F.when(F.col("margin") < floor, "label-noise").when(F.col("__g") & (F.col("__r") > kept), "gray-zone-drop")).drop("__n", "__r", "__g")
