"""Contracts between parts: differences of labels, rules as a table, releases, devices, tokens and samples that are exported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import text as X
from textloom.operators import curation, decisions, evaluation as E, models
from textloom.sources import files
from textloom.streaming import events as stream

from .corpus import _DETECTED, _ROWS, rows
from .evaluation import _BUCKET, _predicted
from .messages import _CLASSIFIED, _MATCHED, _messages, RULES, WORDS
from .registry import query, table


@query(_DETECTED + "SELECT source AS label, count(*) AS n, count(*) FILTER (WHERE lang = detected) AS n_correct, round(count(*) FILTER (WHERE lang = detected) / count(*), 6) AS accuracy FROM d GROUP BY 1 ORDER BY accuracy, label LIMIT 12")
def weakest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.weakest(_predicted(spark, sf_dir).select(F.col("source").alias("group"), F.col("label"), "predicted"), "group").withColumnRenamed("group", "label")


@query(_DETECTED + """, every AS (SELECT 'documents' AS set, lang, lang = detected AS ok FROM d UNION ALL SELECT 'quarter', lang, doc_id % 2 = 0 FROM d WHERE doc_id % 4 = 0)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE ok) AS n_correct, round(count(*) FILTER (WHERE ok) / count(*), 6) AS accuracy FROM every GROUP BY lang""")
def pooled_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two sets of predictions: by the detector on all documents, and made up for every fourth."""
    made = _predicted(spark, sf_dir).select("doc_id", F.col("label").alias("lang"), "label", "predicted")
    other = made.where("doc_id % 4 = 0").withColumn("predicted", F.when(F.col("doc_id") % 2 == 0, F.col("label")))
    return E.pooled(E.accuracy(made, "lang").unionByName(E.accuracy(other, "lang")), "lang")


_TAGS = "CASE WHEN event_type IN ('view', 'click') THEN 'O' ELSE event_type END"
_SAID = f"CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 13 = 0 THEN 'O' ELSE {_TAGS} END"


@query(f"WITH a AS (SELECT {_TAGS} AS tag, {_SAID} AS p FROM events) SELECT tag, count(*) AS n, count(*) FILTER (WHERE tag = p) AS n_correct, round(count(*) FILTER (WHERE tag = p) / count(*), 6) AS accuracy FROM a GROUP BY tag")
def tag_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tag_accuracy(table(spark, sf_dir, "events").select(F.expr(_TAGS).alias("tag"), F.expr(_SAID).alias("predicted")))


@query(f"""WITH e AS (SELECT (user_id % 5)::INTEGER AS release, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS is_cold, ({_BUCKET})::VARCHAR AS b, CASE WHEN event_type = 'click' THEN 'timeout' END AS f, CASE WHEN event_type = 'error' THEN 'e' || event_id % 3 END AS x FROM events)
SELECT release, CASE WHEN is_cold THEN 'cold' ELSE 'warm' END AS kind, b AS name, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT release, 'fallback', f, count(*) FROM e WHERE f IS NOT NULL GROUP BY ALL
UNION ALL SELECT release, 'error', x, count(*) FROM e WHERE x IS NOT NULL GROUP BY ALL""")
def release_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").selectExpr("cast(user_id % 5 as int) as release", "row_number() over (partition by user_id order by event_id) = 1 as is_cold", "value * 10 as latency_ms", "case when event_type = 'click' then 'timeout' end as fallback", "case when event_type = 'error' then concat('e', event_id % 3) end as error")
    return E.release_histograms(made)


@query(f"""WITH h AS (SELECT (user_id % 5)::INTEGER AS release, {_BUCKET} AS bound FROM events WHERE value * 10 < 1000), g AS (SELECT release, bound, count(*) AS n FROM h GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY release) AS total, sum(n) OVER (PARTITION BY release ORDER BY bound) AS run FROM g)
SELECT release, max(total)::BIGINT AS n, min(bound) FILTER (WHERE run >= greatest(1, ceil(total * 0.95))) AS p95, min(bound) FILTER (WHERE run >= greatest(1, ceil(total * 0.99))) AS p99, max(bound) AS highest FROM r GROUP BY release""")
def checked_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    fast = table(spark, sf_dir, "events").selectExpr("cast(user_id % 5 as int) as release", "value * 10 as latency_ms").where("latency_ms < 1000")
    return E.histogram_quantiles(E.checked(E.histogram(fast, "release")), "release")


_KNOWN = "SELECT 'src' || n_nationkey AS label FROM nation WHERE n_nationkey < 22"


@query(f"SELECT 'missing' AS side, label FROM ({_KNOWN} EXCEPT SELECT source FROM documents) UNION ALL SELECT 'unexpected', source FROM (SELECT source FROM documents EXCEPT {_KNOWN})")
def label_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").where("n_nationkey < 22").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("label"))
    return E.differences(known, table(spark, sf_dir, "documents").select(F.col("source").alias("label")), "label")


@query("""SELECT o_custkey, len(list_filter(list_distinct(list(o_orderpriority)), lambda p: p NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))) = 0 AS valid FROM orders GROUP BY o_custkey""")
def label_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("some"))
    return per.select("o_custkey", E.is_subset(F.col("some"), F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))).alias("valid"))


@query(f"WITH {_MATCHED} SELECT conv_id, turn, rule_id, CASE rule_id WHEN 'r1' THEN 'none' WHEN 'r2' THEN 'promotion' WHEN 'r3' THEN 'junk' END AS action FROM m")
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.match_rules(_messages(spark, sf_dir), spark.createDataFrame(RULES, decisions.RULE)).select("conv_id", "turn", "rule_id", "action")


@query(f"""WITH {_MATCHED}, {_CLASSIFIED}, j AS (SELECT c.conv_id, c.turn, rule_id, raw, confidence FROM (SELECT * FROM k) c JOIN m ON c.conv_id = m.conv_id AND c.turn = m.turn)
SELECT conv_id, turn, CASE WHEN rule_id IS NOT NULL THEN NULL WHEN confidence < 0.65 THEN 'transaction.other' ELSE raw END AS label, CASE WHEN rule_id IS NOT NULL THEN 1.0 ELSE confidence END AS confidence,
    CASE WHEN rule_id IS NOT NULL THEN 'rule' WHEN confidence < 0.65 THEN 'fallback' ELSE 'keywords' END AS source,
    CASE rule_id WHEN 'r1' THEN 'none' WHEN 'r2' THEN 'promotion' WHEN 'r3' THEN 'junk' ELSE CASE WHEN confidence < 0.65 THEN 'none' WHEN raw = 'promotion' THEN 'promotion' WHEN raw = 'spam' THEN 'junk' ELSE 'transaction' END END AS action FROM j""")
def message_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decisions.decided(_messages(spark, sf_dir), RULES, decisions.keyword_label(F.col("text"), WORDS))
    return made.select("conv_id", "turn", "label", "confidence", "source", "action")


_LEGAL = "contains(lower(text), 'license') AND NOT contains(lower(text), 'gnu')"


@query(f"""SELECT doc_id, CASE source WHEN 'src1' THEN 'news' WHEN 'src2' THEN CASE WHEN contains(lower(text), 'http') THEN 'promotion' ELSE 'mail' END ELSE CASE WHEN {_LEGAL} THEN 'legal' WHEN contains(lower(text), 'the ') THEN 'english' END END AS label FROM documents
WHERE source IN ('src1', 'src2') OR ({_LEGAL}) OR contains(lower(text), 'the ')""")
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = decisions.label_from_file(F.col("source"), F.col("text"), {"src1": "news", "src2": "mail"}, [("legal", ("license",), ("gnu",)), ("english", ("the ",), ())], {"src2": [("promotion", ("http",), ())]})
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label")).where("label is not null")


@query("""SELECT doc_id AS ord, CASE WHEN source IN ('src1', 'src3') AND regexp_matches(lower(text), 'license|rights') THEN 'legal' WHEN source = 'src2' AND contains(lower(text), 'http') THEN 'link'
    WHEN source = 'src2' AND regexp_matches(lower(text), 'the |und ') AND NOT contains(lower(text), 'la ') THEN 'plain' ELSE source END AS label FROM documents""")
def relabel_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [(("src1", "src3"), ("license", "rights"), (), "legal"), (("src2",), ("http",), (), "link"), (("src2",), ("the ", "und "), ("la ",), "plain")]
    return curation.relabelled_by(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("label"), "text"), cases).select("ord", "label")


@query(f"WITH {_ROWS} SELECT ord, label FROM (SELECT ord, label, row_number() OVER (PARTITION BY label ORDER BY sha256(label || chr(31) || text), ord) AS k FROM r WHERE label IN ('0', '1')) WHERE k <= 30")
def supplement_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.supplement_cap(rows(spark, sf_dir), 30, ["0", "1"]).select("ord", "label")


@query("SELECT text, source AS label, NULL AS locale, lang AS text_language, NULL AS model_version, 'corpus' AS source, NULL AS schema_version, n_chars AS created_at FROM documents")
def exported_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("text", F.col("source").alias("label"), F.col("lang").alias("text_language"), F.lit("corpus").alias("source"), F.col("n_chars").alias("created_at"), "doc_id")
    return curation.export_columns(made)


@query("SELECT p_partkey AS sequence, p_name AS name FROM part WHERE p_partkey = 7")
def single_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sequence"), F.col("p_name").alias("name"), F.lit("transformer").alias("variant"))
    return E.one_release(made, sequence=7).select("sequence", "name")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 <> 2 THEN 'unsupported-schema' WHEN p_partkey % 3 <> 2 THEN 'unsupported-abi' WHEN p_size < 10 THEN 'app-too-old' WHEN p_size > 45 THEN 'app-too-new'
    WHEN p_size // 10 < 2 OR (p_size // 10 = 2 AND p_size % 10 < 5) THEN 'system-too-old' WHEN p_partkey % 7 < 3 THEN 'release-rollback' ELSE 'compatible' END AS verdict FROM part""")
def release_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    verdict = X.compatibility(size % 5, key % 3, size, F.lit(10), F.lit(45), F.concat_ws(".", F.expr("p_size div 10"), size % 10), F.lit("2.5"), key % 7, F.lit(3))
    return table(spark, sf_dir, "part").select("p_partkey", verdict.alias("verdict"))


_DIGITS = "lpad(c_custkey::VARCHAR, 17, '1')"
_SUM = " + ".join(f"substr({_DIGITS}, {k + 1}, 1)::INTEGER * {w}" for k, w in enumerate(X._ID_WEIGHTS))


@query(f"SELECT c_custkey, substr('10X98765432', ({_SUM}) % 11 + 1, 1) AS digit FROM customer")
def id_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.id_check_digit(F.lpad(F.col("c_custkey").cast("string"), 17, "1")).alias("digit"))


@query("SELECT n_nationkey, CASE " + " ".join(f"WHEN contains(lower(n_name || ' ' || n_comment), '{n}') THEN '{c}'" for n, c in X.NAMES.items()) + " END AS code FROM (SELECT *, CASE n_nationkey % 4 WHEN 0 THEN 'Spoken: English' WHEN 1 THEN 'GERMAN and french' WHEN 2 THEN 'none' ELSE 'Thai' END AS n_comment FROM nation)")
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("case n_nationkey % 4 when 0 then 'Spoken: English' when 1 then 'GERMAN and french' when 2 then 'none' else 'Thai' end")
    return table(spark, sf_dir, "nation").select("n_nationkey", X.language_name(F.concat_ws(" ", "n_name", said)).alias("code"))


@query("SELECT c_custkey, replace(replace(trim(' ' || c_name || ' - ' || c_custkey), '-', ''), ' ', '') AS sender FROM customer")
def sender_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.sender(F.concat(F.lit(" "), F.col("c_name"), F.lit(" - "), F.col("c_custkey").cast("string"))).alias("sender"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', '', 'g'), '\p{Nd}+', '#', 'g')) AS digest FROM documents")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.canonical(F.col("text")), 256).alias("digest"))


@query("SELECT page_id, regexp_matches(url, '^[0-9a-f]{64}$') AS digest, length(url) > 0 AND NOT regexp_matches(url, '(^|/)(\\.{0,2})(/|$)') AND NOT contains(url, chr(92)) AS safe FROM pages")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.is_sha256(F.col("url")).alias("digest"), X.is_safe_path(F.col("url")).alias("safe"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'de ' || n_name WHEN n_nationkey % 3 = 1 THEN 'zh ' || n_name ELSE 'fr ' || n_name END AS title FROM nation")
def localized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("n_nationkey"), F.col("n_name")
    titles = F.when(key % 3 == 0, F.create_map(F.lit("de"), F.concat(F.lit("de "), name), F.lit("en"), name)).when(key % 3 == 1, F.create_map(F.lit("zh"), F.concat(F.lit("zh "), name), F.lit("en"), name)).otherwise(F.create_map(F.lit("fr"), F.concat(F.lit("fr "), name), F.lit("it"), name))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.localized(titles, ["de", "es"]).alias("title"))


@query("SELECT event_id::VARCHAR AS \"recordName\", event_type AS kind, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events WHERE event_id > 100")
def flattened_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda v: F.struct(v.cast("string").alias("value"), F.lit("STRING").alias("type"))
    fields = F.create_map(F.lit("kind"), cell(F.col("event_type")), F.lit("value"), cell(F.when(F.col("event_id") % 3 == 0, F.lit("none")).otherwise(F.col("value").cast("string"))), F.lit("createdAt"), cell(F.col("event_id")))
    records = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("recordName"), F.lit("S").alias("recordType"), fields.alias("fields"))
    made = files.since(files.flattened(records, ["kind"], ["value", "createdAt"]), 100)
    return made.select("recordName", "kind", "value")


_UNITS = "CASE WHEN s_suppkey % 3 = 0 THEN 'cpuOnly' ELSE 'all' END"
_PASSED = "s_suppkey % 7 <> 0"


@query(f"""WITH d AS (SELECT s_suppkey AS device, {_UNITS} AS units, CASE WHEN s_suppkey % 11 = 0 THEN 'other' ELSE {_UNITS} END AS extension_units, s_suppkey % 2 = 0 AS accelerated, s_suppkey % 5 AS traces, 1000 * (s_suppkey % 13) AS average, 4000 AS baseline,
    20 + s_suppkey % 40 AS cold, 9990 + s_suppkey AS warm, {_PASSED} AS passed FROM supplier)
SELECT device, (accelerated AND traces > 0) OR units = 'cpuOnly' AS runtime_verified, greatest(0, average - 4000)::BIGINT AS average_increase, passed AS stress_passed,
    array_to_string(list_filter([CASE WHEN cold < 30 THEN 'cold runs' END, CASE WHEN warm < 10000 THEN 'warm queries' END, CASE WHEN units <> extension_units THEN 'compute units differ' END, CASE WHEN NOT passed THEN 'stress' END], lambda x: x IS NOT NULL), ', ') AS problems FROM d""")
def device_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    benchmarks = s.selectExpr("s_suppkey as device", f"{_UNITS} as compute_units", "s_suppkey % 2 = 0 as accelerated", "case when s_suppkey % 3 = 0 then 'cpu' else 'gpu' end as costliest", "1.0D as cpu_cost", "4000L as baseline", "1000 * (s_suppkey % 13) as average", "5000L as peak", "cast(null as bigint) as average_increase", "7L as peak_increase")
    rest = [f"1.0D as {f}" for f in E.DEVICE_FIELDS if f not in ("cold_runs", "warm_queries", "compute_units", "trace_count")]
    extensions = s.selectExpr("s_suppkey as device", f"case when s_suppkey % 11 = 0 then 'other' else {_UNITS} end as compute_units", "s_suppkey % 5 as trace_count", "20 + s_suppkey % 40 as cold_runs", "9990 + s_suppkey as warm_queries", *rest, *(f"{_PASSED} as {f}" for some in E.STRESS.values() for f in some))
    return E.device_metrics(benchmarks, extensions).select("device", "runtime_verified", "average_increase", "stress_passed", F.array_join("problems", ", ").alias("problems"))


@query("SELECT p_partkey, p_size >= 45 AND greatest(p_size % 3, p_partkey % 4) / 100 <= 0.02 AND p_partkey % 10 <> 0 AS passed FROM part")
def detector_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size / 50D as f1", "p_size % 3 / 100D as clean_fpr", "case when p_partkey % 10 <> 0 then p_partkey % 4 / 100D end as regression_fpr")
    return E.detector_gate(made).select("p_partkey", "passed")


@query("""WITH w AS (SELECT event_id, event_id % 40 AS s, event_id % 40 + event_id % 6 + 1 AS e FROM events)
SELECT event_id, CASE WHEN s < 12 AND e > 5 THEN 'A' WHEN s < 20 AND e > 10 THEN 'B' WHEN s < 33 AND e > 25 THEN 'C' ELSE 'O' END AS tag FROM w""")
def piece_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array(*(F.struct(F.lit(t).alias("token"), F.lit(a).alias("start"), F.lit(b).alias("end")) for t, a, b in (("A", 5, 12), ("B", 10, 20), ("C", 25, 33))))
    piece = F.array(F.struct((F.col("event_id") % 40).cast("int").alias("start"), (F.col("event_id") % 40 + F.col("event_id") % 6 + 1).cast("int").alias("end")))
    return table(spark, sf_dir, "events").select("event_id", F.get(models.span_tags(piece, spans), F.lit(0)).alias("tag"))


def _default_case(value: int) -> str:
    cases = " ".join(f"WHEN regexp_matches(low, '{'|'.join(words)}') THEN " + (f"'{label}'" if value == 0 else str(sure)) for label, words, sure in decisions.KEYWORDS)
    return f"CASE {cases} ELSE " + (f"'{decisions.DEFAULT[0]}'" if value == 0 else str(decisions.DEFAULT[1])) + " END"


@query(f"""WITH {_MATCHED}, k AS (SELECT conv_id, turn, {_default_case(0)} AS raw, ({_default_case(1)})::DOUBLE AS confidence FROM (SELECT *, lower(text) AS low FROM conversations)),
c AS (SELECT m.conv_id, m.turn, rule_id, confidence, CASE WHEN confidence < 0.65 THEN 'transaction.other' ELSE raw END AS label FROM k JOIN m ON k.conv_id = m.conv_id AND k.turn = m.turn),
a AS (SELECT *, CASE rule_id WHEN 'r1' THEN 'none' WHEN 'r2' THEN 'promotion' WHEN 'r3' THEN 'junk' ELSE CASE WHEN label = 'promotion' THEN 'promotion' WHEN label = 'spam' THEN 'junk' WHEN confidence >= 0.65 THEN 'transaction' ELSE 'none' END END AS action FROM c)
SELECT conv_id, turn, rule_id, label, confidence, action, CASE WHEN action = 'promotion' THEN CASE WHEN label = 'promotion' THEN 'offers' ELSE 'others' END WHEN action = 'transaction' THEN
    CASE WHEN label LIKE 'finance.%' THEN 'finance' WHEN label IN ('life.express', 'transaction.order') THEN 'orders' WHEN label LIKE 'work.%' THEN 'reminders' ELSE 'other' END ELSE 'none' END AS sub_action FROM a""")
def streamed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision of a stream, run here on the table."""
    return stream.decided(_messages(spark, sf_dir), RULES).select("conv_id", "turn", "rule_id", "label", "confidence", "action", "sub_action")


@query()
def semantic_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each message of a conversation is from its first."""
    made = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("first"))
    rest = table(spark, sf_dir, "conversations").join(made, "conv_id")
    return rest.select("conv_id", "turn", X.semantic_change(F.col("first"), F.col("text")).alias("change"))


@query()
def rehydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted documents with invented values in place of their tokens."""
    from textloom.operators import redaction

    made = table(spark, sf_dir, "documents").select("doc_id", "lang", redaction.redact_plain(F.col("text")).alias("text"))
    return made.select("doc_id", X.rehydrate(F.col("text"), F.col("lang")).alias("text"))


@query()
def personal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by a model of their senders' own words."""
    made = _messages(spark, sf_dir).where("text is not null")
    model = models.personal_model(made.select(F.col("sender").alias("label"), "text"))
    return models.personal_scores(model, made).select("conv_id", "turn", "decision.label", "decision.confidence", "decision.accepted")
