"""Quality filters, duplicates, holdouts, samples, splits and reports of labelled rows.

Rows are told apart by ``ord``, the order in which they came: the first of equals wins. Windows and joins
shuffle digests of texts, not texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions import text as X

from . import embedding


def digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def first_reason(*reasons: Column) -> Column:
    """One reason a row: the first that isn't null."""
    return F.coalesce(*reasons)


def assessment_reason(labels: Sequence[str] | None = None, keep: float = 0.25, text: str = "text") -> Column:
    """Of columns label, text, predicted_label, predicted_confidence, agreement and model_version: invalid-assessment, or a sure disagreement that the hash sample drops."""
    predicted, sure, agree = F.col("predicted_label"), F.col("predicted_confidence"), F.col("agreement")
    some = predicted.isNotNull() | sure.isNotNull() | agree.isNotNull()
    known = predicted.isin(*labels) if labels is not None else predicted.isNotNull()
    valid = known & sure.between(0, 1) & agree.isin(0, 1) & ((agree == 1) == (predicted == F.col("label")))
    dropped = (agree == 0) & (sure >= 0.8) & (X.hash_fraction(F.col("label"), F.col(text), F.col("model_version")) >= min(max(keep, 0.0), 1.0))
    return F.when(some, F.when(~F.coalesce(valid, F.lit(False)), "invalid-assessment").when(dropped, "remote-disagreement-downsample"))


def _held_out(df: DataFrame, holdout: DataFrame, low: str, near: str, most: int = 1_000_000) -> DataFrame:
    """df with in_exact and in_near, by its digests of the text in lower case and of the near signature. Keys are broadcast up to ``most`` of them."""
    rough_key = digest(X.near_signature(F.col("text")))
    keys = holdout.where("text is not null").select(F.explode(F.array(F.struct(F.lit(True).alias("whole"), digest(F.lower("text")).alias("key")), F.struct(F.lit(False).alias("whole"), rough_key.alias("key")))).alias("k")).select("k.*").distinct()
    small = keys.limit(most + 1).count() <= most
    hint = F.broadcast if small else lambda x: x
    exact = hint(keys.where("whole").select(F.col("key").alias("__exact"), F.lit(True).alias("in_exact")))
    rough = hint(keys.where("not whole").select(F.col("key").alias("__near"), F.lit(True).alias("in_near")))
    made = df.join(exact, F.col(low) == F.col("__exact"), "left").join(rough, F.col(near) == F.col("__near"), "left")
    return made.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_exact", "in_near")}).drop("__exact", "__near")


def holdout_flags(df: DataFrame, holdout: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df (with text) and in_exact, in_near: whether its text, or its near signature, is in the holdout."""
    made = df.withColumns({"__e": digest(F.lower("text")), "__n": digest(X.near_signature(F.col("text")))})
    return _held_out(made, holdout, "__e", "__n", most).drop("__e", "__n")


def conflicting(df: DataFrame, key: Column, label: str = "label") -> DataFrame:
    """df with conflict: whether its key is seen with more than one label."""
    w = Window.partitionBy("__key")
    made = df.withColumn("__key", digest(key))
    return made.withColumn("conflict", F.min(label).over(w) != F.max(label).over(w)).drop("__key")


def dedupe_cascade(df: DataFrame, steps: Sequence[tuple[str, Sequence[str]]], reason: str = "reason", ord_: str = "ord") -> DataFrame:
    """Rows without a reason go through the steps (reason, key columns) in turn; all but the first of a key get the step's reason. A row with a null key passes."""
    for name, keys in steps:
        open_ = reduce(and_, (F.col(k).isNotNull() for k in keys), F.col(reason).isNull())
        # rows that don't take part are spread by their own order
        spread = F.when(open_, F.lit(-1).cast("long")).otherwise(F.col(ord_).cast("long"))
        w = Window.partitionBy("__in", "__open", *keys).orderBy(ord_)
        df = df.withColumns({"__open": spread, "__in": open_})
        df = df.withColumn(reason, F.when(F.col("__in") & (F.row_number().over(w) > 1), name).otherwise(F.col(reason))).drop("__open", "__in")
    return df


def _prepared(rows: DataFrame, labels: Sequence[str] | None, keep: float) -> DataFrame:
    """ord, label, source, language and text of every row in normal form, its early reason, and placeholders filled where there is none."""
    keys = [c for c in ("predicted_label", "predicted_confidence", "agreement", "model_version") if c in rows.columns]
    made = rows.select("ord", "label", "source", "language", *([F.col("text").alias("raw")] if keys else []), X.once(X.normalize(F.col("text"))).alias("text"), *keys)
    known = F.col("label").isin(*labels) if labels is not None else F.col("label").isNotNull()
    early = [F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty"), F.when(~F.coalesce(known, F.lit(False)), "unknown-label")]
    if keys:
        early.append(assessment_reason(labels, keep, "raw"))
    early.append(F.when(X.placeholder_only(F.col("text")), "placeholder-only"))
    made = made.withColumn("early", first_reason(*early)).drop(*keys, "raw")
    made = made.withColumn("language", F.when(F.col("early").isNotNull() | F.coalesce(F.col("language").isin(*X.LANGUAGES), F.lit(False)), F.col("language")).otherwise(X.detect_language(F.col("text"))))
    made = made.withColumn("rehydrated", F.col("early").isNull() & F.coalesce(F.col("text").rlike(X.PLACEHOLDER), F.lit(False)))
    filled = F.when(F.col("rehydrated"), X.collapse(X.rehydrate(F.when(F.col("rehydrated"), F.col("text")), F.col("language")))).otherwise(F.col("text"))
    return made.select("ord", "label", "source", "language", "early", "rehydrated", X.once(filled).alias("text"))


def curate(rows: DataFrame, holdout: DataFrame, labels: Sequence[str] | None = None, languages: Sequence[str] = X.LANGUAGES, min_length: int = 8, max_length: int = 500, keep: float = 0.5, cap: int = 500, margins: DataFrame | None = None) -> DataFrame:
    """ord, label, source, language, rehydrated and reason of every row (ord, text, label, source, language, and an assessment if there is one); a kept row has no reason.

    The first check that fails gives the one reason, in this order: empty, unknown-label, invalid-assessment, remote-disagreement-downsample and placeholder-only, of the text in normal form;
    then an unsupported language is detected and placeholders are filled, and of the text so made: the junk reasons, language (not among ``languages``), cross-label-conflict,
    holdout-exact, holdout-near, duplicate, near-duplicate, template-duplicate (each kept row counts as the first of its keys), source-cap (``cap`` rows of a source, label and language, 0 for all) and
    label-noise or gray-zone-drop, where ``margins`` (ord, label, margin) are given. Windows and joins shuffle digests of the texts; ``curated_rows`` adds the texts.
    """
    if bad := sorted(set(languages) - set(X.LANGUAGES)):
        raise ValueError(f"unknown languages: {bad}")
    made = _prepared(rows, labels, keep)
    text = F.col("text")
    keyed = made.select(
        "ord", "label", "source", "language", "rehydrated",
        first_reason(F.col("early"), F.lit(None)).alias("early"),
        first_reason(X.junk_reason(text, F.col("language"), min_length, max_length), F.when(~F.coalesce(F.col("language").isin(*languages), F.lit(False)), "language")).alias("junk"),
        digest(F.lower("text")).alias("low"), digest(text).alias("exact"), digest(X.near_signature(text)).alias("near"), digest(F.nullif(X.template_signature(text), F.lit(""))).alias("template"),
        F.unhex(F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in ("source", "label", "language", "text"))), 256)).alias("cap"),
    )
    flagged = _held_out(keyed, holdout.select(X.normalize(F.col("text")).alias("text")), "low", "near")
    # rows that went before have no say in conflicts
    w = Window.partitionBy("__open", "low")
    flagged = flagged.withColumn("__open", F.when(F.col("early").isNull(), F.lit(-1).cast("long")).otherwise(F.col("ord").cast("long"))).withColumn("conflict", F.min("label").over(w) != F.max("label").over(w))
    reason = first_reason(F.col("early"), F.col("junk"), F.when(F.col("conflict"), "cross-label-conflict"), F.when(F.col("in_exact"), "holdout-exact"), F.when(F.col("in_near"), "holdout-near"))
    open_rows = flagged.select("ord", "label", "source", "language", "rehydrated", reason.alias("reason"), "exact", "near", "template", "cap")
    done = dedupe_cascade(open_rows, [("duplicate", ["label", "exact"]), ("near-duplicate", ["label", "near"]), ("template-duplicate", ["label", "template"])])
    if cap > 0:
        done = capped(done, cap, "cap")
    done = done.drop("exact", "near", "template", "cap")
    if margins is not None:
        bands = embedding.noise_bands(margins.join(done.where("reason is null").select("ord"), "ord", "left_semi"), key="ord").select("ord", "band")
        done = done.join(bands, "ord", "left").withColumn("reason", F.coalesce("reason", "band")).drop("band")
    return done


def curated_rows(rows: DataFrame, decisions: DataFrame, labels: Sequence[str] | None = None, keep: float = 0.5) -> DataFrame:
    """What ``curate`` decided, with the text of each row as it was decided on, and its source label where there is one."""
    extra = [c for c in ("source_label",) if c in rows.columns]
    made = _prepared(rows, labels, keep).select("ord", "text")
    if extra:
        made = made.join(rows.select("ord", *extra), "ord")
    return decisions.join(made, "ord")


def capped(df: DataFrame, most: int, key: str) -> DataFrame:
    """Rows without a reason beyond the first ``most`` of their source, label and language, in order of key, get the reason source-cap."""
    open_ = F.col("reason").isNull()
    w = Window.partitionBy("__open", "source", "label", "language").orderBy(key, "ord")
    made = df.withColumn("__open", F.when(open_, F.lit(-1).cast("long")).otherwise(F.col("ord").cast("long")))
    return made.withColumn("reason", F.when(open_ & (F.row_number().over(w) > most), "source-cap").otherwise(F.col("reason"))).drop("__open")


def rejection_counts(curated: DataFrame) -> DataFrame:
    """source, reason and n; the reason of a kept row is kept."""
    return curated.groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], most: int | Column) -> DataFrame:
    """The first rows of each group; all for a limit of 0 or less."""
    if isinstance(most, int) and most <= 0:
        return df
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def source_cap(df: DataFrame, most: int) -> DataFrame:
    """At most so many rows of each source, label and language: those of least SHA-256."""
    key = F.sha2(F.concat_ws("\x1f", "source", "label", "language", "text"), 256)
    return top_per_group(df.withColumn("digest", key), ["source", "label", "language"], [F.col("digest"), F.col("ord")], most)


def supplement_cap(df: DataFrame, most: int, labels: Sequence[str] | None = None) -> DataFrame:
    """At most so many rows of each label, of the labels that are asked for."""
    if labels is not None:
        df = df.where(F.col("label").isin(*labels))
    return top_per_group(df.withColumn("digest", F.sha2(F.concat_ws("\x1f", "label", "text"), 256)), ["label"], [F.col("digest"), F.col("ord")], most)


def split(df: DataFrame, fraction: float, group: str = "label", seed: str = "7", clamp: bool = False) -> DataFrame:
    """df with part: validation or train, within each group by hash. Groups under five rows train; with clamp at least one row is on either side."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col("ord").cast("string")), 256)
    # ranks within a group and the first digits of the hash, after as many as there are under lower digits: no task sorts a whole group
    made = df.withColumns({"__k": F.unhex(key), "__b": F.substring(key, 1, 3)})
    w = Window.partitionBy(group)
    sizes = made.groupBy(group, "__b").agg(F.count("*").alias("__m")).withColumns({"__n": F.sum("__m").over(w), "__before": F.sum("__m").over(w.orderBy("__b")) - F.col("__m")}).withColumnRenamed(group, "__group").withColumnRenamed("__b", "__bucket").drop("__m")
    made = made.join(sizes, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__b") == F.col("__bucket"))).withColumn("__r", F.col("__before") + F.row_number().over(Window.partitionBy(group, "__b").orderBy("__k", "ord")))
    take = F.greatest(F.lit(1), F.least(F.floor(F.col("__n") * fraction + 0.5), F.col("__n") - 1)) if clamp else F.floor(F.col("__n") * fraction)
    return made.withColumn("part", F.when((F.col("__n") >= 5) & (F.col("__r") <= take), "validation").otherwise("train")).select(*df.columns, "part")


def round_robin(df: DataFrame, buckets: Sequence[str], most: int) -> DataFrame:
    """One row of each bucket in turn, buckets in order of their names, until there are so many."""
    made = df.withColumn("turn", F.row_number().over(Window.partitionBy(*buckets).orderBy("ord")))
    return made.orderBy("turn", *buckets).limit(most)


def round_robin_sources(df: DataFrame, most: int, seed: str = "7") -> DataFrame:
    """label, source, ord and place: for each label so many rows, taken from its sources in turn; a source that runs out leaves the circle, and the turn passes to the next in place."""
    import pandas as pd

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = [list(g.ord) for _, g in pdf.sort_values(["source", "__h", "ord"]).groupby("source", sort=True)]
        names, out, at = sorted(pdf.source.unique()), [], 0
        while queues and len(out) < most:
            out.append((pdf.label.iloc[0], names[at], queues[at].pop(0), len(out)))
            if queues[at]:
                at = (at + 1) % len(queues)
            else:
                queues.pop(at)
                names.pop(at)
                at = at % len(queues) if queues else 0
        return pd.DataFrame(out, columns=["label", "source", "ord", "place"])

    made = df.where("label is not null and source is not null").withColumn("__h", F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col("ord").cast("string")), 256))
    # no source can give more than the limit
    made = top_per_group(made, ["label", "source"], [F.col("__h"), F.col("ord")], most)
    return made.select("label", "source", "ord", "__h").groupBy("label").applyInPandas(take, "label string, source string, ord long, place int")


def shuffled(df: DataFrame, seed: str = "7") -> DataFrame:
    """df with place: an order by hash of ord."""
    return df.withColumn("digest", F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col("ord").cast("string")), 256))


def similar_pairs(df: DataFrame, least: float = 0.92, min_length: int = 12) -> DataFrame:
    """(a, b, dice) of rows (ord, label, text) of one label that are alike: each row with the first of its canonical text, at 1, and first rows whose three-letter shingles overlap enough.

    Exact, and without all pairs of copies. Sets that overlap so have at least ``least / (2 - least)`` of either in common, so they share one of the shingles that are rarest in each, as many as that
    share leaves out, and one: only such pairs are compared.
    """
    made = df.select("ord", "label", X.canonical(F.col("text")).alias("c")).where("c <> '' and label is not null").withColumn("k", digest(F.col("c")))
    first = made.groupBy("label", "k").agg(F.min("ord").alias("a"), F.first("c").alias("c"))
    same = made.join(first.select("label", "k", "a"), ["label", "k"]).where("ord <> a").select("a", F.col("ord").alias("b"), F.lit(1.0).alias("dice"))
    long = first.where(F.length("c") >= min_length).select("label", "a", X.shingles(F.col("c")).alias("s")).withColumn("n", F.size("s"))
    grams = long.select("label", "a", "n", F.explode("s").alias("g"))
    share = least / (2 - least)
    rare = grams.join(grams.groupBy("label", "g").agg(F.count("*").alias("f")), ["label", "g"])
    prefix = F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    keys = rare.withColumn("r", F.row_number().over(Window.partitionBy("label", "a").orderBy("f", "g"))).where(F.col("r") <= prefix).select("label", "g", "a", "n")
    x, y = (keys.select("label", "g", F.col("a").alias(v), F.col("n").alias(f"n_{v}")) for v in ("a", "b"))
    pairs = x.join(y, ["label", "g"]).where(f"a < b and n_a >= {share} * n_b - 1e-9 and n_b >= {share} * n_a - 1e-9").select("label", "a", "b").distinct()
    sets = long.select("label", "a", "s")
    near = pairs.join(sets.withColumnRenamed("s", "x"), ["label", "a"]).join(sets.select("label", F.col("a").alias("b"), F.col("s").alias("y")), ["label", "b"])
    return same.unionByName(near.select("a", "b", X.dice(F.col("x"), F.col("y")).alias("dice")).where(F.col("dice") >= least))


def coverage(df: DataFrame, labels: DataFrame, languages: Sequence[str]) -> DataFrame:
    """A row per label, with a count per language; labels without rows too."""
    made = df.groupBy("label").pivot("language", list(languages)).agg(F.count(F.lit(1)))
    return labels.select("label").distinct().join(made, "label", "left").na.fill(0)


def coverage_gaps(df: DataFrame, labels: DataFrame, languages: DataFrame, least: int) -> DataFrame:
    """label, language and n of the combinations with under ``least`` rows."""
    n = df.groupBy("label", "language").agg(F.count("*").alias("n"))
    every = F.broadcast(labels.select("label").distinct()).crossJoin(F.broadcast(languages.select("language").distinct()))
    return every.join(n, ["label", "language"], "left").na.fill(0, ["n"]).where(F.col("n") < least)


def concentration(df: DataFrame, template: str = "template") -> DataFrame:
    """Rows, distinct templates and their ratio by label and language."""
    made = df.groupBy("label", "language").agg(F.count("*").alias("n_rows"), F.count_distinct(template).alias("n_templates"))
    return made.withColumn("concentration", F.round(F.col("n_rows") / F.greatest("n_templates", F.lit(1)), 3))


def dominant_language(df: DataFrame, sample: int = 500, share: float = 0.9) -> DataFrame:
    """The language of at least that share of every n-th row, in order of ord; no row if there's none."""
    n = df.count()
    stride = max(n // sample, 1)
    made = df.withColumn("__i", F.row_number().over(Window.orderBy("ord")) - 1) if "position" not in df.columns else df.withColumn("__i", F.col("position"))
    taken = made.where(F.col("__i") % stride == 0).groupBy("language").agg(F.count("*").alias("n"))
    return taken.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).where(F.col("share") >= share)


def exported(df: DataFrame, labels: Sequence[str], min_length: int = 4, max_length: int = 1000) -> DataFrame:
    """ord, text, label and reason of submitted rows: unknown label, bad length, or a repeated (label, text); the text is trimmed and its white space collapsed."""
    made = df.withColumn("text", X.collapse(F.col("text")))
    reason = F.when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "unknown-label").when(~F.coalesce(F.length("text").between(min_length, max_length), F.lit(False)), "bad-length")
    made = made.withColumns({"reason": reason, "__t": digest(F.col("text"))})
    return dedupe_cascade(made, [("duplicate", ["label", "__t"])]).drop("__t")


#: What an export has of a sample: no assessment, no group, no identity.
EXPORTED = ("text", "label", "locale", "text_language", "model_version", "source", "schema_version", "created_at")


def export_columns(df: DataFrame) -> DataFrame:
    """The columns of an export, those that aren't there as null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in EXPORTED))


def relabelled_by(df: DataFrame, cases: Sequence[tuple[Sequence[str], Sequence[str], Sequence[str], str]]) -> DataFrame:
    """Rows get the label of the first case (labels, markers, vetoes, new label) that applies: one of the labels, a marker in the text, and no veto."""
    low = F.lower("text")
    has = lambda words: low.rlike("|".join(rf"\Q{w}\E" for w in words)) if words else F.lit(False)
    moved = first_reason(*(F.when(F.col("label").isin(*labels) & has(markers) & ~has(vetoes), to) for labels, markers, vetoes, to in cases))
    return df.withColumn("label", F.coalesce(moved, F.col("label")))


def relabelled(df: DataFrame, markers: Sequence[str], from_labels: Sequence[str], to: str, veto: Sequence[str] = ()) -> DataFrame:
    """Rows of some labels whose text has a marker, and none of the vetoes, get another label, and lose their assessment."""
    has = lambda words: F.lower("text").rlike("|".join(rf"\Q{w}\E" for w in words)) if words else F.lit(False)
    moved = F.coalesce(F.col("label").isin(*from_labels) & has(markers) & ~has(veto), F.lit(False))
    return df.withColumns({"label": F.when(moved, to).otherwise(F.col("label")), "relabelled": moved, **{c: F.when(~moved, F.col(c)) for c in ("predicted_label", "predicted_confidence", "agreement") if c in df.columns}})
