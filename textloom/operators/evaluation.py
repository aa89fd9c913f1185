"""Accuracy, errors, spans, latencies, release gates and the choice of a candidate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Upper bounds of latency buckets in ms; a latency belongs to the first that it's below.
BOUNDS = (150, 250, 500, 600, 750, 900, 1000)
OVER = 9999


def accuracy(df: DataFrame, *by: str) -> DataFrame:
    """n, n_correct and accuracy of predicted against label, by the columns."""
    made = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("n_correct"))
    return made.withColumn("accuracy", F.round(F.col("n_correct") / F.col("n"), 6))


def weakest(df: DataFrame, by: str = "label", most: int = 12) -> DataFrame:
    """The labels of least accuracy, ties by name."""
    return accuracy(df, by).orderBy("accuracy", by).limit(most)


def pooled(accuracies: DataFrame, *by: str) -> DataFrame:
    """Accuracy over several sets: all that is correct over all there is, not the mean of the sets' shares."""
    made = accuracies.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"))
    return made.withColumn("accuracy", F.round(F.col("n_correct") / F.greatest("n", F.lit(1)), 6))


def tag_accuracy(df: DataFrame) -> DataFrame:
    """Of each true tag: n, n_correct and accuracy of predicted."""
    return accuracy(df.withColumnRenamed("tag", "label"), "label").withColumnRenamed("label", "tag")


def confusions(df: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent wrong pairs."""
    return df.where(F.col("label") != F.col("predicted")).groupBy("label", "predicted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "predicted").limit(most)


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of rows of the same keys that both predict alike."""
    both = a.select(*keys, F.col("predicted").alias("x")).join(b.select(*keys, F.col("predicted").alias("y")), list(keys))
    return both.agg(F.count("*").alias("n"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("agreement"))


def action_metrics(df: DataFrame, tournament: bool = False) -> DataFrame:
    """Of action and predicted_action: accuracy, benign messages sent to junk, false promotions and recall of junk. In a tournament a promotion counts as benign."""
    truth, said = F.col("action"), F.col("predicted_action")
    benign = truth.isin("none", "transaction", "promotion") if tournament else truth.isin("none", "transaction")
    count = F.count_if
    made = df.agg(
        F.count("*").alias("n"),
        F.round(F.avg((truth == said).cast("int")), 6).alias("action_accuracy"),
        count(benign & (said == "junk")).alias("benign_to_junk"),
        count((truth != "promotion") & (said == "promotion")).alias("fp"),
        count(truth != "promotion").alias("negatives"),
        count((truth == "junk") & (said == "junk")).alias("hits"),
        count(truth == "junk").alias("junk"),
    )
    one = F.lit(1)
    return made.select("n", "action_accuracy", "benign_to_junk", F.round(F.col("fp") / F.greatest("negatives", one), 6).alias("promotion_fpr"), F.round(F.col("hits") / F.greatest("junk", one), 6).alias("junk_recall"))


def micro_prf(df: DataFrame, outside: str = "O") -> DataFrame:
    """Precision, recall and F1 of tag against predicted; a wrong tag is both a miss and a false alarm."""
    t, p = F.col("tag"), F.col("predicted")
    made = df.agg(F.count_if((t != outside) & (t == p)).alias("tp"), F.count_if((p != outside) & (t != p)).alias("fp"), F.count_if((t != outside) & (t != p)).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return made.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def clean_false_positives(df: DataFrame, sentence: str, outside: str = "O") -> DataFrame:
    """Share of sentences without a tag in which one is predicted."""
    per = df.groupBy(sentence).agg(F.max((F.col("tag") != outside).cast("int")).alias("some"), F.max((F.col("predicted") != outside).cast("int")).alias("said"))
    return per.where("some = 0").agg(F.count("*").alias("n_clean"), F.round(F.coalesce(F.avg("said"), F.lit(0.0)), 6).alias("fpr"))


def bucket(ms: Column) -> Column:
    """The bound of the latency's bucket; OVER from 1000 on."""
    out = None
    for b in BOUNDS:
        out = F.when(ms < b, b) if out is None else out.when(ms < b, b)
    return F.when(ms.isNotNull(), out.otherwise(OVER))


def histogram(df: DataFrame, *by: str, ms: str = "latency_ms") -> DataFrame:
    return df.where(F.col(ms).isNotNull()).groupBy(*by, bucket(F.col(ms)).alias("bound")).agg(F.count("*").alias("n"))


def histogram_quantiles(hist: DataFrame, *by: str, shares: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """Upper bounds of quantiles: of the first bucket that brings the running count to max(1, ceil(n * share)); and of the maximum."""
    w = Window.partitionBy(*by)
    made = hist.where("n > 0").withColumns({"total": F.sum("n").over(w), "run": F.sum("n").over(w.orderBy("bound"))})
    wanted = [F.min(F.when(F.col("run") >= F.greatest(F.lit(1), F.ceil(F.col("total") * s)), F.col("bound"))).alias(f"p{round(s * 100)}") for s in shares]
    return made.groupBy(*by).agg(F.max("total").alias("n"), *wanted, F.max("bound").alias("highest"))


def checked(hist: DataFrame) -> DataFrame:
    """A histogram as it is, unless a bucket is unknown, a count negative, or something took a second or more: then the read fails."""
    bad = F.when(~F.col("bound").isin(*BOUNDS, OVER), "unknown bucket").when(F.col("n") < 0, "negative count").when((F.col("bound") == OVER) & (F.col("n") > 0), "a query took a second or more")
    return hist.withColumn("n", F.when(bad.isNotNull(), F.raise_error(bad).cast("long")).otherwise(F.col("n")))


def sample_percentile(df: DataFrame, share: float, *by: str, value: str = "value") -> DataFrame:
    """The value at place ceil((n - 1) * share), from 0, in order: found by rank, without lists."""
    w = Window.partitionBy(*by)
    made = df.where(F.col(value).isNotNull()).withColumns({"__n": F.count("*").over(w), "__r": F.row_number().over(w.orderBy(value)) - 1})
    return made.where(F.col("__r") == F.ceil((F.col("__n") - 1) * share)).select(*by, F.col("__n").alias("n"), F.col(value).alias("percentile"))


def release_aggregate(events: DataFrame, by: str = "release") -> DataFrame:
    """Counts, memory and errors of each release from events (seq, is_cold, footprint, fallback, error, watchdog); footprints of 0 don't count."""
    fp = F.when(F.col("footprint") > 0, F.col("footprint"))
    seq = F.when(F.col("footprint") > 0, F.col("seq"))
    return events.groupBy(by).agg(
        F.count_if("is_cold").alias("cold"),
        F.count_if(~F.col("is_cold")).alias("warm"),
        F.count("fallback").alias("fallbacks"),
        F.count("error").alias("errors"),
        F.count_if("watchdog").alias("watchdogs"),
        F.min_by(fp, seq).alias("first_footprint"),
        F.max_by(fp, seq).alias("latest_footprint"),
        F.max(fp).alias("peak_footprint"),
    ).withColumn("drift", F.col("latest_footprint") - F.col("first_footprint"))


def release_histograms(events: DataFrame, by: str = "release", ms: str = "latency_ms") -> DataFrame:
    """A row for each count of a release: kind (cold, warm, fallback or error), its bucket or code as name, and n."""
    kinds = F.array(
        F.when(F.col(ms).isNotNull(), F.struct(F.when(F.col("is_cold"), "cold").otherwise("warm").alias("kind"), bucket(F.col(ms)).cast("string").alias("name"))),
        F.when(F.col("fallback").isNotNull(), F.struct(F.lit("fallback").alias("kind"), F.col("fallback").cast("string").alias("name"))),
        F.when(F.col("error").isNotNull(), F.struct(F.lit("error").alias("kind"), F.col("error").cast("string").alias("name"))),
    )
    made = events.select(by, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return made.groupBy(by, F.col("k.kind").alias("kind"), F.col("k.name").alias("name")).agg(F.count("*").alias("n"))


def one_release(releases: DataFrame, variant: str = "transformer", sequence: int | None = None) -> DataFrame:
    """The release of the variant, and of that sequence if there is one; fails unless it is exactly one."""
    made = releases.where(F.col("variant") == variant)
    if sequence is not None:
        made = made.where(F.col("sequence") == sequence)
    if (n := len(made.select(F.lit(1)).take(2))) != 1:
        raise ValueError("no matching release" if n == 0 else "more than one matching release")
    return made


#: What a device must have shown before its figures count, and what it must have passed, on the processor alone or with an accelerator.
DEVICE_FIELDS = tuple("cold_p95 cold_p99 cold_max warm_p95 warm_p99 contention_p99 jetsam_count memory_drift memory_drift_share cold_runs warm_queries compute_units trace_count".split())
STRESS = {True: ("cpu_stress_passed",), False: ("gpu_contention_passed", "low_power_passed", "memory_pressure_passed")}
LEAST_COLD, LEAST_WARM = 30, 10_000


def device_metrics(benchmarks: DataFrame, extensions: DataFrame, key: str = "device") -> DataFrame:
    """A row per device of both tables with derived figures, and problems: fields without a value, too few runs, units that differ, stress not passed.

    benchmarks: key, compute_units, accelerated, costliest, cpu_cost, baseline, average and peak bytes, and increases where they were measured, else the difference to the baseline, 0 at least.
    extensions: key, DEVICE_FIELDS and the stress flags.
    """
    e = extensions.withColumnRenamed("compute_units", "extension_units")
    made = benchmarks.join(e, key)
    cpu = F.col("extension_units") == "cpuOnly"
    fields = ["extension_units" if f == "compute_units" else f for f in DEVICE_FIELDS]
    passed = lambda names: reduce(and_, (F.coalesce(F.col(n), F.lit(False)) for n in names))
    accelerated = F.coalesce(F.col("accelerated"), F.lit(False)) & (F.col("trace_count") > 0)
    on_cpu = (F.col("compute_units") == "cpuOnly") & (F.col("costliest") == "cpu") & (F.col("cpu_cost") > 0)
    rise = lambda name, of: F.coalesce(F.col(name), F.greatest(F.lit(0), F.coalesce(of, F.lit(0)) - F.coalesce("baseline", F.lit(0))))
    stress = F.when(cpu, passed(STRESS[True])).otherwise(passed(STRESS[False]))
    problems = [F.when(F.col(f).isNull(), F.lit("missing " + ("compute_units" if f == "extension_units" else f))) for f in fields]
    problems += [F.when(F.col("cold_runs") < LEAST_COLD, F.lit("cold runs")), F.when(F.col("warm_queries") < LEAST_WARM, F.lit("warm queries")), F.when(~F.col("compute_units").eqNullSafe(F.col("extension_units")), F.lit("compute units differ")), F.when(~F.coalesce(stress, F.lit(False)), F.lit("stress"))]
    return made.withColumns(
        {
            "runtime_verified": F.coalesce(accelerated, F.lit(False)) | F.coalesce(on_cpu, F.lit(False)),
            "average_increase": rise("average_increase", F.col("average")),
            "peak_increase": rise("peak_increase", F.col("peak")),
            "stress_passed": F.coalesce(stress, F.lit(False)),
            "problems": F.filter(F.array(*problems), lambda p: p.isNotNull()),
        }
    )


def with_device_metrics(reports: DataFrame, metrics: DataFrame, key: str = "profile") -> DataFrame:
    """Reports with the metrics of their device in place of any that they had; metrics with problems fail."""
    sound = metrics.withColumn(key, F.when(F.size("problems") > 0, F.raise_error(F.concat_ws(", ", "problems")).cast(metrics.schema[key].dataType)).otherwise(F.col(key))).drop("problems")
    taken = [c for c in sound.columns if c != key]
    return reports.drop(*taken).join(sound, key, "left")


def detector_gate(df: DataFrame, least_f1: float = 0.9, most_clean: float = 0.02) -> DataFrame:
    """df (f1, clean_fpr, regression_fpr) with passed: the worse of both shares of false alarms counts; without a value it fails."""
    worst = F.greatest("clean_fpr", "regression_fpr")
    return df.withColumn("passed", F.coalesce((F.col("f1") >= least_f1) & (worst <= most_clean) & F.col("clean_fpr").isNotNull() & F.col("regression_fpr").isNotNull(), F.lit(False)))


def differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(side, key): missing, what is expected and not found, and unexpected, what is found and not expected."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.exceptAll(b).select(F.lit("missing").alias("side"), key).union(b.exceptAll(a).select(F.lit("unexpected").alias("side"), key))


def is_subset(some: Column, every: Column) -> Column:
    """Whether all of one array are in the other."""
    return F.size(F.array_except(some, every)) == 0


def gates(checks: Sequence[tuple[str, Column]]) -> Column:
    """Names of the checks that fail; one without a value fails."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks)), lambda x: x.isNotNull())


def evidence(aggregates: DataFrame, least_cold: int, least_warm: int) -> DataFrame:
    """Aggregates with memory drift and the release's failures."""
    made = aggregates.withColumn("drift_bytes", F.greatest(F.lit(0), F.col("drift"))).withColumn("drift_share", F.round(F.col("drift_bytes") / F.col("first_footprint"), 6))
    return made.withColumn("failures", gates([("cold-runs", F.col("cold") >= least_cold), ("warm-queries", F.col("warm") >= least_warm), ("errors", F.col("errors") == 0), ("watchdogs", F.col("watchdogs") == 0), ("drift", F.col("drift_share") <= 0.1)]))


def _at_least(name: str, column: str, value: float) -> tuple[str, Column]:
    return name, F.coalesce(F.col(column), F.lit(0.0)) >= value


def _at_most(name: str, column: str, value: float) -> tuple[str, Column]:
    return name, F.coalesce(F.col(column), F.lit(float("inf"))) <= value


QUALITY_FLOORS = {"fixed_accuracy": 0.99, "promotion_accuracy": 0.98, "billing_accuracy": 0.9, "billing_action_accuracy": 0.95, "conversation_accuracy": 1.0, "conversation_action_accuracy": 1.0, "agreement": 0.985, "action_fixed_accuracy": 0.99, "action_promotion_accuracy": 0.98, "action_billing_accuracy": 0.95, "action_conversation_accuracy": 1.0, "scam_recall": 1.0, "rules_override_rate": 1.0}
QUALITY_CEILINGS = {"fixed_drop": 0.01, "promotion_drop": 0.01, "zh_drop": 0.015, "en_drop": 0.015, "ja_drop": 0.015, "benign_to_junk": 0.0, "promotion_fpr": 0.01}
MB = 1024 * 1024
DEVICE_CEILINGS = {"peak_increase": 256 * MB, "average_increase": 256 * MB, "p95": 150, "p99": 250, "cold_p95": 750, "cold_p99": 900, "warm_p95": 150, "warm_p99": 250, "jetsam_count": 0, "memory_drift": 16 * MB, "memory_drift_share": 0.1}
FLAGS = ("probabilities_finite", "probability_sums_valid", "readable_cases", "runtime_verified", "stress_passed")


def candidate_checks(columns: Sequence[str]) -> list[tuple[str, Column]]:
    """The checks of a candidate on the columns that there are; a drop is the baseline's less the candidate's."""
    out = [_at_least(c, c, v) for c, v in QUALITY_FLOORS.items() if c in columns]
    out += [_at_most(c, c, v) for c, v in (QUALITY_CEILINGS | DEVICE_CEILINGS).items() if c in columns]
    out += [(c, F.col(c)) for c in FLAGS if c in columns]
    if "cold_max" in columns:
        out.append(("cold_max", F.coalesce(F.col("cold_max"), F.lit(float("inf"))) < 1000))
    if {"download_bytes", "baseline_download_bytes"} <= set(columns):
        out += [("resources", F.col("download_bytes") <= 0.75 * F.col("baseline_download_bytes")), ("download_bytes", F.col("download_bytes") > 0)]
    return out


def is_quality_failure(failures: Column) -> Column:
    """Whether one of the failures is of quality: only then is a costlier way tried."""
    names = [*QUALITY_FLOORS, *QUALITY_CEILINGS]
    return F.size(F.array_intersect(failures, F.array(*map(F.lit, names)))) > 0


def near_least(df: DataFrame, columns: Sequence[str], slack: float = 1.05) -> DataFrame:
    """Rows within slack of the least of the first column, then among those of the next, and so on."""
    for c in columns:
        df = df.withColumn("__least", F.min(c).over(Window.partitionBy())).where(F.col(c) <= slack * F.col("__least")).drop("__least")
    return df


def select_candidate(profiles: DataFrame, reports: DataFrame, baseline: DataFrame, resources: Sequence[str] = ("peak_increase", "download_bytes", "p95")) -> DataFrame:
    """A row per profile with its failures, whether it's eligible, and which one is chosen.

    profiles: profile, fallback (the profile tried when this one fails on quality), on_failure (only then enabled), releasable.
    reports: profile and figures. baseline: one row of baseline_ columns. A profile without report fails.
    """
    known = profiles.join(reports, "profile", "left").crossJoin(F.broadcast(baseline))
    figures = [c for c in reports.columns if c != "profile"]
    missing = F.coalesce(*(F.col(c).cast("string") for c in figures)).isNull()
    made = known.withColumn("failures", F.when(missing, F.array(F.lit("report-missing"))).otherwise(gates(candidate_checks(known.columns))))
    opened = made.where(is_quality_failure(F.col("failures")) & F.col("fallback").isNotNull()).select(F.col("fallback").alias("profile")).distinct().withColumn("__open", F.lit(True))
    made = made.join(opened, "profile", "left").withColumn("enabled", ~F.col("on_failure") | F.coalesce("__open", F.lit(False))).drop("__open")
    made = made.withColumn("eligible", F.col("enabled") & F.col("releasable") & (F.size("failures") == 0))
    best = near_least(made.where("eligible"), resources).orderBy(F.desc("promotion_accuracy"), "profile").limit(1).select("profile", F.lit(True).alias("__best"))
    return made.join(best, "profile", "left").select("profile", "failures", "enabled", "eligible", F.coalesce("__best", F.lit(False)).alias("chosen"))


def probabilities_valid(p: Column) -> Column:
    """All finite, and their sum between 0.99 and 1.01."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.forall(p, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & total.between(0.99, 1.01), F.lit(False))
