"""Reading and writing message corpora."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

ROW = T.StructType([T.StructField(n, t) for n, t in (("text", T.StringType()), ("label", T.StringType()), ("source", T.StringType()), ("sourceLabel", T.StringType()), ("language", T.StringType()), ("textLanguage", T.StringType()), ("predictedLabel", T.StringType()), ("predictedConfidence", T.DoubleType()), ("agreement", T.IntegerType()), ("modelVersion", T.StringType()), ("schemaVersion", T.IntegerType()))])


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that there are, in any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            out.append(p)
    return out


def read_rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of JSON of several files, in order: file, place, and the columns of a row.

    Blank lines and rows without text or label are left out, as are files that aren't there; a line that isn't JSON ends the read.
    source is the file's name unless the row has one; the hint of a language is textLanguage, else language. place is the line's offset in rows
    within the file as Spark reads it, so it orders rows of one file and split.
    """
    found = existing(spark, paths)
    names = ("text", "label", "source", "source_label", "language", "predicted_label", "predicted_confidence", "agreement", "model_version", "schema_version")
    parts = []
    for k, path in enumerate(found):
        df = spark.read.schema(ROW).option("mode", "FAILFAST").json(path)
        clean = df.where("text is not null and text <> '' and label is not null and label <> ''")
        columns = ["text", "label", F.coalesce(F.nullif("source", F.lit("")), F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")), "sourceLabel", F.coalesce("textLanguage", "language"), "predictedLabel", "predictedConfidence", "agreement", "modelVersion", "schemaVersion"]
        parts.append(clean.select(F.lit(k).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), *((F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(columns, names, strict=True))))
    if not parts:
        return spark.createDataFrame([], "file int, block long, place long, " + ", ".join(f"{n} {'double' if n == 'predicted_confidence' else 'int' if n in ('agreement', 'schema_version') else 'string'}" for n in names))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of ``read_rows`` with ord, their place over all files, from 0: rows of a task are counted, and a row's place is what came before its task and within it. No row moves."""
    numbered = rows.withColumns({"__part": F.spark_partition_id(), "__spot": F.expr("monotonically_increasing_id() & 8589934591")})
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("n"), F.min(F.struct("file", "block", "place")).alias("at"))
    before, at = {}, 0
    for r in sizes.orderBy("at").collect():  # a row per task of the read
        before[r["__part"]] = at
        at += r["n"]
    start = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else None
    return numbered.withColumn("ord", (start[F.col("__part")] + F.col("__spot")).cast("long") if before else F.lit(0).cast("long")).drop("__part", "__spot")


def limited(rows: DataFrame, most: int | None, *order: str) -> DataFrame:
    """The first rows by their order (ord, unless given), or all."""
    return rows if most is None else rows.orderBy(*(order or ("ord",))).limit(most)


def read_strict(spark: SparkSession, path: str, *required: str) -> DataFrame:
    """Lines of JSON, each of which must have the required fields; an empty file is an error too."""
    df = spark.read.schema(ROW).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    bad = ~F.lit(True)
    for c in required or ("text", "label"):
        bad = bad | F.coalesce(F.trim(c) == "", F.lit(True))
    return df.withColumn("text", F.when(bad, F.raise_error(F.lit(f"invalid row in {path}"))).otherwise(F.col("text")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, doubled quotes and line ends within quotes; short rows are filled with empty text, blank rows are left out."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path).na.fill("")
    return df.select(*(F.replace(F.col(f"`{c}`"), F.lit("\r"), F.lit("")).alias(c.replace("\r", "")) for c in df.columns))


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """text of each line that isn't blank, and as label the file's name without its ending."""
    return spark.read.text(path).select(F.trim("value").alias("text"), F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("label")).where("text <> ''")


def read_flagged_tsv(spark: SparkSession, path: str, flag: str = "1") -> DataFrame:
    """Text after the first tab of lines whose flag is the given one."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(parts[0] == flag).select(F.try_element_at(parts, F.lit(2)).alias("text")).where("text is not null")


TAXONOMY = "schemaVersion int, groups array<struct<id string, title string, systemAction string, leaves array<struct<id string, title string, titles map<string,string>, systemAction string>>>>"


def taxonomy_leaves(df: DataFrame) -> DataFrame:
    """A row per leaf: label, title, titles, group_id, group_title and action, its own or the group's."""
    g = df.select(F.explode("groups").alias("g"))
    leaf = g.select("g", F.explode("g.leaves").alias("l"))
    return leaf.select(F.col("l.id").alias("label"), F.col("l.title").alias("title"), F.col("l.titles").alias("titles"), F.col("g.id").alias("group_id"), F.col("g.title").alias("group_title"), F.coalesce("l.systemAction", "g.systemAction").alias("action"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return taxonomy_leaves(spark.read.schema(TAXONOMY).option("multiLine", True).json(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records of landed pages of a remote query: an error in a page fails the read."""
    df = spark.read.schema("serverErrorCode string, continuationMarker string, records array<struct<recordName string, recordType string, fields map<string, struct<value string, type string>>>>").option("multiLine", True).json(path)
    ok = df.withColumn("records", F.when(F.col("serverErrorCode").isNotNull(), F.raise_error(F.concat(F.lit("server error "), "serverErrorCode")).cast(df.schema["records"].dataType)).otherwise(F.col("records")))
    return ok.select(F.explode("records").alias("r")).select("r.*")


def paged(fetch: Callable[[int, str | None], dict], since: int | None = None, most: int | None = None, size: int = 200, created: str = "createdAt") -> Iterator[dict]:
    """Records of a remote query, page by page: created after ``since``, in order of creation, ``most`` at most. fetch(size, marker) gives a page with records, and continuationMarker or serverErrorCode.

    A page with an error ends the read; so does one without a marker. It is a generator for a task or the driver that lands pages; ``read_pages`` reads what has landed.
    """
    if size > 200:
        raise ValueError("a page has 200 records at most")
    marker, n, last = None, 0, None
    while most is None or n < most:
        page = fetch(size if most is None else min(size, most - n), marker)
        if page.get("serverErrorCode"):
            raise ValueError(f"server error {page['serverErrorCode']}")
        for record in page.get("records", []):
            at = int(record["fields"][created]["value"])
            if since is not None and at <= since:
                continue
            if last is not None and at < last:
                raise ValueError("records out of order")
            last = at
            yield record
            n += 1
            if most is not None and n >= most:
                return
        marker = page.get("continuationMarker")
        if not marker:
            return


def since(records: DataFrame, after: int | None, most: int | None = None, created: str = "createdAt") -> DataFrame:
    """Flattened records (createdAt) created after that time, in order of creation, ``most`` at most."""
    made = records if after is None else records.where(F.col(created) > after)
    return made if most is None else made.orderBy(created, "recordName").limit(most)


def flattened(records: DataFrame, strings: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Fields of records as columns; numbers that are text are read as numbers, others are null."""
    value = lambda n: F.col("fields")[n]["value"]
    return records.select("recordName", *(value(n).alias(n) for n in strings), *(value(n).try_cast("double").alias(n) for n in numbers))


def read_reports(spark: SparkSession, pattern: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON files of a pattern with their path; none is an error."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(pattern).withColumn("path", F.col("_metadata.file_path"))
    if df.isEmpty():
        raise ValueError(f"no reports at {pattern}")
    return df


def write_rows(df: DataFrame, path: str, columns: Sequence[str] = ("text", "label", "language", "source", "sourceLabel")) -> None:
    """Lines of JSON of these columns, nulls kept."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.option("ignoreNullFields", False).json(path)


def write_curated(curated: DataFrame, kept: str, rejected: str | None = None, report: str | None = None) -> None:
    """What ``curation.curated_rows`` gives, as lines of JSON: the kept rows with their five columns, the rejected with their reason, and a report of counts by source and reason."""
    write_rows(curated.where("reason is null"), kept)
    if rejected:
        write_rows(curated.where("reason is not null"), rejected, ("text", "label", "source", "language", "reason"))
    if report:
        n = curated.groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.count_if("rehydrated").alias("rehydrated"))
        n.coalesce(1).orderBy("source", "reason").write.json(report)


def write_metrics(parts: dict[str, DataFrame], path: str) -> None:
    """Lines of JSON of several tables of metrics, each with the kind that it is."""
    made = None
    for kind, df in parts.items():
        one = df.select(F.lit(kind).alias("kind"), *df.columns)
        made = one if made is None else made.unionByName(one, allowMissingColumns=True)
    if made is not None:
        made.write.json(path)


def canonical_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Compact JSON of the columns, keys in order; struct and map columns are written as they are."""
    return F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"})


def ordered_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: n and the SHA-256 of the rows' own digests in order. Two levels, so that no more than the digests of a part come together."""
    each = df.select(F.sha2(canonical_json(df, columns), 256).alias("d"))
    part = each.groupBy(F.substring("d", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"), F.count("*").alias("n"))
    return part.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def folder_digest(spark: SparkSession, path: str) -> DataFrame:
    """Of each file under a folder: path, n_bytes and SHA-256 of its bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder, without reading them."""
    files_ = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files_.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def without(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, int]:
    """What is left of df less the ids, and how many rows go: ids that aren't there count nothing."""
    gone = df.join(ids.select(key).distinct(), key, "left_semi").count()
    return df.join(ids.select(key).distinct(), key, "left_anti"), gone


class SampleStore:
    """An append-only store of samples: a folder of Parquet."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "id string, label string, text string, created_at long"):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def load(self) -> DataFrame:
        there = existing(self.spark, [self.path])
        return self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)

    def count(self) -> int:
        return self.load().count()

    def clear(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.path)


#: What pages show in all.
MOST_SHOWN = 200


def is_last_page(n: int, shown: int, size: int = 30, most: int = MOST_SHOWN) -> bool:
    """Whether a page of n rows, after which ``shown`` have been shown in all, ends the list: it is short, or there are enough."""
    return n < size or shown >= most


def page_after(df: DataFrame, anchor, order: str, key: str, size: int = 30, seen: DataFrame | None = None, shown: int = 0, most: int = MOST_SHOWN) -> DataFrame:
    """The next page, newest first, before the anchor; rows already seen are left out. Of what has been shown before counts how much is left of ``most``."""
    made = df.where(F.col(order) < F.lit(anchor)) if anchor is not None else df
    if seen is not None:
        made = made.join(seen.select(key).distinct(), key, "left_anti")
    size = max(0, min(size, most - shown))
    return made.orderBy(F.desc(order), F.desc(key)).limit(size)


def with_order(df: DataFrame, *columns: str) -> DataFrame:
    """df with ord: the place of each row by the columns."""
    return df.withColumn("ord", F.row_number().over(Window.orderBy(*columns)).cast("long"))
