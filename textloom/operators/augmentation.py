"""Rows made from rows: replacements and boundary cases admitted in order, templates and products."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions import text as X

from .curation import digest, holdout_flags


class Admission:
    """Admits candidates one by one by their keys: what is in the holdout, or like an admitted one, is refused, and a refused one leaves no trace."""

    def __init__(self) -> None:
        self.labels: dict[bytes, str] = {}
        self.nears: set[tuple[str, bytes]] = set()
        self.templates: set[tuple[str, bytes]] = set()

    def reason(self, label: str, low: bytes, near: bytes, template: bytes | None, exact: bool, rough: bool) -> str | None:
        """Why the candidate is refused; None admits it. template is None where nothing is left of the text."""
        checks = (
            ("holdout-exact", exact),
            ("holdout-near", rough),
            ("cross-label-conflict", self.labels.get(low, label) != label),
            ("near-duplicate", (label, near) in self.nears),
            ("template-duplicate", template is not None and (label, template) in self.templates),
        )
        for name, hit in checks:
            if hit:
                return name
        self.labels[low] = label
        self.nears.add((label, near))
        if template is not None:
            self.templates.add((label, template))
        return None


def admitted(candidates: Iterable, per_label: int, per_row: int, least_change: float) -> Iterator[tuple[int, str | None]]:
    """(id, reason) of the candidates that are considered, which come in order: base rows, boundary rows, then the replacements of each base row.

    ``per_label`` bounds what is admitted beyond the base of a label, and ``per_row`` the replacements of a base row; a replacement beyond either isn't considered.
    """
    gate, made, variants = Admission(), Counter(), Counter()
    for c in candidates:
        full = c.phase > 0 and made[c.label] >= per_label
        if c.phase == 2 and (full or variants[c.ord] >= per_row):
            continue
        if c.phase == 2 and c.change < least_change:
            yield c.id, "too-similar"
            continue
        why = "label-cap" if full else gate.reason(c.label, c.low, c.near, c.template, c.in_exact, c.in_near)
        if c.phase and why is None:
            made[c.label] += 1
            variants[c.ord] += c.phase == 2
        yield c.id, why


def augment(base: DataFrame, rules: Sequence[dict], boundary: Sequence[dict] = (), holdout: DataFrame | None = None, per_label: int = 120, per_row: int = 1, least_change: float = 0.04) -> DataFrame:
    """ord, family, label, text and reason of every candidate considered, reason null where it is admitted; base has ord, text, label and language.

    Candidates, their keys and how much they change are made by all tasks. Admission depends on everything admitted before, across labels, so it is one ordered pass, over digests and not
    texts: base sets are curated and capped per source, label and language before, which bounds them by the taxonomy whatever the corpus.
    """
    spark = base.sparkSession
    clean = base.where("text is not null and label is not null").select("ord", "text", "label", "language")
    none = F.lit(None)
    parts = [clean.select(F.lit(0).alias("phase"), "ord", F.lit(0).alias("k"), F.lit("base").alias("family"), "label", "text", none.cast("string").alias("before"))]
    if boundary:
        given = [(k, "boundary:" + (b.get("family") or "unspecified"), b["label"], b["text"]) for k, b in enumerate(boundary)]
        parts.append(spark.createDataFrame(given, "k int, family string, label string, text string").select(F.lit(1).alias("phase"), none.cast("long").alias("ord"), "k", "family", "label", "text", none.cast("string").alias("before")))
    swaps = [(r, a, b) for r in rules for a, b in r["replacements"]]
    if swaps:
        made = [
            F.when(F.col("label").isin(*r["labels"]) & F.col("language").isin(*r["languages"]) & F.contains("text", F.lit(a)), F.struct(F.lit(k).alias("k"), F.lit(f"replacement:{r['id']}").alias("family"), X.replace_first(F.col("text"), F.lit(a), F.lit(b)).alias("text")))
            for k, (r, a, b) in enumerate(swaps)
        ]
        found = clean.select("ord", "label", F.col("text").alias("before"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("s"))
        parts.append(found.select(F.lit(2).alias("phase"), "ord", "s.k", "s.family", "label", "s.text", "before"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("change", F.when(F.col("phase") == 2, X.semantic_change("before", F.when(F.col("phase") == 2, F.col("text")))).otherwise(1.0)).drop("before")
    every = every.withColumn("id", F.xxhash64("phase", "ord", "k"))
    keyed = every.select("id", "phase", "ord", "k", "label", "change", X.once(X.normalize(F.col("text"))).alias("text"))
    held = holdout.select(X.normalize(F.col("text")).alias("text")) if holdout is not None else spark.createDataFrame([], "text string")
    keys = holdout_flags(keyed, held).select("id", "phase", "ord", "k", "label", "change", "in_exact", "in_near", digest(F.lower("text")).alias("low"), digest(X.near_signature(F.col("text"))).alias("near"), digest(F.nullif(X.template_signature(F.col("text")), F.lit(""))).alias("template"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one pass over batches: what is kept are the digests of admitted rows
        rows = (row for pdf in batches for row in pdf.itertuples(index=False))
        said: list[tuple[int, str | None]] = []
        for one in admitted(rows, per_label, per_row, least_change):
            said.append(one)
            if len(said) == 10_000:
                yield pd.DataFrame(said, columns=["id", "reason"])
                said = []
        if said:
            yield pd.DataFrame(said, columns=["id", "reason"])

    answers = keys.repartition(1).sortWithinPartitions("phase", "ord", "k").mapInPandas(run, "id long, reason string")
    return every.join(answers, "id").select("ord", "family", "label", "text", "reason")


def augmentation_report(considered: DataFrame) -> DataFrame:
    """Rows by family, label and reason."""
    return considered.groupBy("family", "label", "reason").agg(F.count("*").alias("n"))


def product(spark: SparkSession, **parts: Sequence[str]) -> DataFrame:
    """Every combination of the parts, a column each."""
    df = None
    for name, values in parts.items():
        one = spark.createDataFrame([(v,) for v in values], f"{name} string")
        df = one if df is None else df.crossJoin(F.broadcast(one))
    return df


def first_per_signature(df: DataFrame, most: int, seed: str = "7") -> DataFrame:
    """Of rows (ord, language, text) the first of each near signature, and of each language so many by hash."""
    from .curation import top_per_group

    made = top_per_group(df.withColumn("__s", X.near_signature(F.col("text"))), ["language", "__s"], [F.col("ord")], 1)
    return top_per_group(made, ["language"], [F.sha2(F.concat_ws("\x1f", F.lit(seed), "text"), 256), F.col("ord")], most).drop("__s")


def fill(template: Column, slots: dict[str, Sequence[str]], key: Column) -> Column:
    """A template with each {slot} filled from its values, by hash of key."""
    for k, (name, values) in enumerate(slots.items()):
        pick = F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(key, F.lit(k)), F.lit(len(values))) + 1).cast("int"))
        template = F.replace(template, F.lit("{" + name + "}"), pick)
    return template


def with_spans(df: DataFrame, values: Sequence[tuple[str, str]]) -> DataFrame:
    """Carrier texts (ord, text) with a value put after them, and its exact span: tag, start and end."""
    pick = F.element_at(F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(v).alias("value")) for t, v in values)), (F.pmod(F.xxhash64("ord"), F.lit(len(values))) + 1).cast("int"))
    made = df.withColumn("__v", pick)
    start = F.length("text") + 1
    return made.select("ord", F.concat_ws(" ", "text", F.col("__v.value")).alias("text"), F.col("__v.tag").alias("tag"), start.alias("start"), (start + F.length("__v.value")).alias("end"))


def synthetic(templates: DataFrame, slots: dict[str, Sequence[str]], per_label: int) -> DataFrame:
    """Exactly so many rows of each label and language (label, language, template), made unique by a number where texts repeat."""
    from pyspark.sql import Window

    w = Window.partitionBy("label", "language").orderBy("template")
    made = templates.withColumns({"__t": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy("label", "language"))})
    made = made.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(per_label - 1)))).where(F.col("n") % F.col("__n") == F.col("__t"))
    made = made.withColumn("text", fill(F.col("template"), slots, F.concat_ws("|", "label", "language", F.col("n").cast("string"))))
    again = F.row_number().over(Window.partitionBy("label", "language", "text").orderBy("n"))
    return made.withColumn("__again", again).select("label", "language", "n", F.when(F.col("__again") > 1, F.concat_ws(" ", "text", F.col("__again").cast("string"))).otherwise(F.col("text")).alias("text"))
