"""Metrics of predictions, latencies and memory, release gates and the choice of a candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import text as X
from textloom.operators import evaluation as E

from .corpus import _DETECTED
from .registry import query, table


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("label"), X.detect_language(F.col("text")).alias("predicted"))


@query(_DETECTED.replace("doc_id, lang", "doc_id, source, lang") + "SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = detected) AS n_correct, round(count(*) FILTER (WHERE lang = detected) / count(*), 6) AS accuracy FROM d GROUP BY source")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accuracy(_predicted(spark, sf_dir), "source")


@query(_DETECTED + "SELECT lang AS label, detected AS predicted, count(*) AS n FROM d WHERE lang <> detected GROUP BY 1, 2 ORDER BY n DESC, label, predicted LIMIT 10")
def confusion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusions(_predicted(spark, sf_dir), 10)


@query("SELECT count(*) AS n, round(avg((event_type = CASE WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END)::INTEGER), 6) AS agreement FROM events")
def baseline_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return E.agreement(e.select("event_id", F.col("event_type").alias("predicted")), e.select("event_id", F.expr("case when event_id % 4 = 0 then 'view' else event_type end").alias("predicted")), ["event_id"])


_ACTIONS = "CASE event_type WHEN 'click' THEN 'promotion' WHEN 'error' THEN 'junk' WHEN 'view' THEN 'none' ELSE 'transaction' END"
_SAID = f"CASE WHEN event_id % 7 = 0 THEN 'junk' WHEN event_id % 5 = 0 THEN 'promotion' ELSE {_ACTIONS} END"


@query(f"""WITH a AS (SELECT {_ACTIONS} AS t, {_SAID} AS p FROM events) SELECT count(*) AS n, round(avg((t = p)::INTEGER), 6) AS action_accuracy, count(*) FILTER (WHERE t IN ('none', 'transaction') AND p = 'junk') AS benign_to_junk,
round(count(*) FILTER (WHERE t <> 'promotion' AND p = 'promotion') / greatest(count(*) FILTER (WHERE t <> 'promotion'), 1), 6) AS promotion_fpr, round(count(*) FILTER (WHERE t = 'junk' AND p = 'junk') / greatest(count(*) FILTER (WHERE t = 'junk'), 1), 6) AS junk_recall FROM a""")
def action_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.action_metrics(table(spark, sf_dir, "events").select(F.expr(_ACTIONS).alias("action"), F.expr(_SAID).alias("predicted_action")))


_TAG = "CASE WHEN event_type IN ('view', 'click') THEN 'O' ELSE event_type END"
_PRED = f"CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 13 = 0 THEN 'O' ELSE {_TAG} END"


@query(f"""WITH a AS (SELECT {_TAG} AS t, {_PRED} AS p FROM events), c AS (SELECT count(*) FILTER (WHERE t <> 'O' AND t = p) AS tp, count(*) FILTER (WHERE p <> 'O' AND t <> p) AS fp, count(*) FILTER (WHERE t <> 'O' AND t <> p) AS fn FROM a)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.micro_prf(table(spark, sf_dir, "events").select(F.expr(_TAG).alias("tag"), F.expr(_PRED).alias("predicted")))


@query(f"""WITH a AS (SELECT event_id // 3 AS s, max(({_TAG} <> 'O')::INTEGER) AS has, max(({_PRED} <> 'O')::INTEGER) AS said FROM events GROUP BY 1) SELECT count(*) AS n_clean, round(coalesce(avg(said), 0), 6) AS fpr FROM a WHERE has = 0""")
def false_positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.clean_false_positives(table(spark, sf_dir, "events").select(F.expr("event_id div 3").alias("s"), F.expr(_TAG).alias("tag"), F.expr(_PRED).alias("predicted")), "s")


_BUCKET = "CASE " + " ".join(f"WHEN value * 10 < {b} THEN {b}" for b in E.BOUNDS) + f" ELSE {E.OVER} END"


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "cast(user_id % 5 as int) as release", "value * 10 as latency_ms")


@query(f"SELECT (user_id % 5)::INTEGER AS release, {_BUCKET} AS bound, count(*) AS n FROM events GROUP BY 1, 2")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.histogram(_latencies(spark, sf_dir), "release")


@query(f"""WITH h AS (SELECT (user_id % 5)::INTEGER AS release, {_BUCKET} AS bound, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY release) AS total, sum(n) OVER (PARTITION BY release ORDER BY bound) AS run FROM h)
SELECT release, max(total)::BIGINT AS n, min(bound) FILTER (WHERE run >= greatest(1, ceil(total * 0.95))) AS p95, min(bound) FILTER (WHERE run >= greatest(1, ceil(total * 0.99))) AS p99, max(bound) AS highest FROM r GROUP BY release""")
def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.histogram_quantiles(latency_histogram(spark, sf_dir), "release")


@query("""WITH r AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i FROM events) SELECT event_type, n, value AS percentile FROM r WHERE i = ceil((n - 1) * 0.95)""")
def sample_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sample_percentile(table(spark, sf_dir, "events"), 0.95, "event_type")


_EVENTS = """e AS (SELECT (user_id % 5)::INTEGER AS release, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS is_cold, CASE WHEN event_type = 'view' THEN 0 ELSE round(value * 100)::BIGINT * 10000 END AS footprint,
    event_type = 'click' AS fallback, event_type = 'error' AS error, event_type = 'signup' AND value > 200 AS watchdog FROM events),
a AS (SELECT release, count(*) FILTER (WHERE is_cold) AS cold, count(*) FILTER (WHERE NOT is_cold) AS warm, count(*) FILTER (WHERE fallback) AS fallbacks, count(*) FILTER (WHERE error) AS errors, count(*) FILTER (WHERE watchdog) AS watchdogs,
    arg_min(footprint, seq) FILTER (WHERE footprint > 0) AS first_footprint, arg_max(footprint, seq) FILTER (WHERE footprint > 0) AS latest_footprint, max(footprint) FILTER (WHERE footprint > 0) AS peak_footprint FROM e GROUP BY release)"""


@query(f"WITH {_EVENTS} SELECT *, latest_footprint - first_footprint AS drift FROM a")
def release_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").selectExpr("cast(user_id % 5 as int) as release", "event_id as seq", "row_number() over (partition by user_id order by event_id) = 1 as is_cold", "case when event_type = 'view' then 0L else cast(round(value * 100) as bigint) * 10000 end as footprint", "case when event_type = 'click' then 'timeout' end as fallback", "case when event_type = 'error' then 'model' end as error", "event_type = 'signup' and value > 200 as watchdog")
    return E.release_aggregate(made)


@query(f"""WITH {_EVENTS}, d AS (SELECT *, greatest(0, latest_footprint - first_footprint) AS drift_bytes, round(greatest(0, latest_footprint - first_footprint) / first_footprint, 6) AS drift_share FROM a)
SELECT release, drift_bytes, drift_share, array_to_string(list_filter([CASE WHEN cold < 30 THEN 'cold-runs' END, CASE WHEN warm < 1000 THEN 'warm-queries' END, CASE WHEN errors > 0 THEN 'errors' END, CASE WHEN watchdogs > 0 THEN 'watchdogs' END, CASE WHEN drift_share > 0.1 THEN 'drift' END], lambda x: x IS NOT NULL), ',') AS failures FROM d""")
def release_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evidence(release_aggregate(spark, sf_dir), 30, 1000).select("release", "drift_bytes", "drift_share", F.array_join("failures", ",").alias("failures"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as profile", "(1000 - p_partkey % 13) / 1000 as fixed_accuracy", "(1000 - p_partkey % 29) / 1000 as promotion_accuracy", "(p_partkey % 7) / 100 as fixed_drop",
        "cast(p_size * 10000000 as double) as peak_increase", "cast(p_retailprice as double) as download_bytes", "cast(p_partkey % 40 * 5 as double) as p95", "p_partkey % 5 <> 0 as runtime_verified",
    )


_C = """c AS (SELECT p_partkey::VARCHAR AS profile, (1000 - p_partkey % 13) / 1000 AS fa, (1000 - p_partkey % 29) / 1000 AS pa, (p_partkey % 7) / 100 AS fd, p_size * 10000000.0 AS peak, p_retailprice AS dl, p_partkey % 40 * 5.0 AS p95, p_partkey % 5 <> 0 AS rv FROM part),
f AS (SELECT *, list_filter([CASE WHEN fa < 0.99 THEN 'fixed_accuracy' END, CASE WHEN pa < 0.98 THEN 'promotion_accuracy' END, CASE WHEN fd > 0.01 THEN 'fixed_drop' END, CASE WHEN peak > 268435456 THEN 'peak_increase' END, CASE WHEN p95 > 150 THEN 'p95' END, CASE WHEN NOT rv THEN 'runtime_verified' END, CASE WHEN dl > 0.75 * 2000 THEN 'resources' END], lambda x: x IS NOT NULL) AS failures FROM c)"""


@query(f"WITH {_C} SELECT profile, array_to_string(list_sort(failures), ',') AS failures FROM f")
def candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _candidates(spark, sf_dir).withColumn("baseline_download_bytes", F.lit(2000.0))
    return made.select("profile", F.array_join(F.array_sort(E.gates(E.candidate_checks(made.columns))), ",").alias("failures"))


@query(f"""WITH {_C}, g AS (SELECT *, len(list_intersect(failures, ['fixed_accuracy', 'promotion_accuracy', 'fixed_drop'])) > 0 AS q FROM f), o AS (SELECT DISTINCT (profile::BIGINT + 1)::VARCHAR AS profile FROM g WHERE q AND profile::BIGINT % 2 = 0),
e AS (SELECT g.*, (profile::BIGINT % 2 = 0 OR profile IN (SELECT profile FROM o)) AS enabled FROM g), k AS (SELECT *, enabled AND len(failures) = 0 AS eligible FROM e),
s1 AS (SELECT * FROM k WHERE eligible AND peak <= 1.05 * (SELECT min(peak) FROM k WHERE eligible)), s2 AS (SELECT * FROM s1 WHERE dl <= 1.05 * (SELECT min(dl) FROM s1)), s3 AS (SELECT * FROM s2 WHERE p95 <= 1.05 * (SELECT min(p95) FROM s2)),
b AS (SELECT profile FROM s3 ORDER BY pa DESC, profile LIMIT 1) SELECT profile, enabled, eligible, profile IN (SELECT profile FROM b) AS chosen FROM k""")
def candidate_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _candidates(spark, sf_dir)
    k = F.col("profile").cast("long")
    profiles = reports.select("profile", F.when(k % 2 == 0, (k + 1).cast("string")).alias("fallback"), (k % 2 == 1).alias("on_failure"), F.lit(True).alias("releasable"))
    baseline = spark.range(1).select(F.lit(2000.0).alias("baseline_download_bytes"))
    return E.select_candidate(profiles, reports, baseline).drop("failures")


@query("SELECT event_id, abs(value / 500 + (1 - value / 500) - 1) <= 0.01 AND user_id % 10 <> 0 AS valid FROM events")
def probability_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.array(F.col("value") / 500, 1 - F.col("value") / 500, F.when(F.col("user_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.lit(0.0)))
    return table(spark, sf_dir, "events").select("event_id", E.probabilities_valid(p).alias("valid"))
