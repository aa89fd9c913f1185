"""Curation of documents: quality, duplicates, holdouts, samples, splits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import text as X
from textloom.operators import augmentation, curation, embedding, redaction

from .registry import query, table

MAX_LENGTH = 20_000


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, text, label, language and source of every document; its label is its quality, or none."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("ord"), "text", F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("label"), F.col("lang").alias("language"), "source")


_ROWS = """r AS (
    SELECT d.doc_id AS ord, d.text, coalesce(l.quality::VARCHAR, 'none') AS label, d.lang AS language, d.source
    FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""


def _near(t: str) -> str:
    return rf"substring(regexp_replace(regexp_replace(lower({t}), '\p{{Nd}}+', '0', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g'), 1, 80)"


_JUNK = rf"""CASE WHEN length(text) < 8 THEN 'too-short' WHEN length(text) > {MAX_LENGTH} THEN 'too-long'
    WHEN length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / greatest(length(text), 1) < 0.3 THEN 'low-information'
    WHEN length(text) > 20 AND len(list_distinct(regexp_extract_all(text, '(?s).'))) / length(text) < 0.15 THEN 'repetitive'
    WHEN language IN ('en', 'es', 'pt', 'fr', 'de', 'id', 'vi', 'ru') AND len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_'']+')) < 2 THEN 'too-few-words'
    WHEN regexp_matches(text, '\{{\{{[A-Z_]+\}}\}}') AND NOT regexp_matches(regexp_replace(text, '\{{\{{[A-Z_]+\}}\}}', '', 'g'), '[\p{{L}}\p{{N}}]') THEN 'placeholder-only' END"""

def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _normal(t: str) -> str:
    return rf"trim(regexp_replace(nfc_normalize({t}), '[\s\p{{Z}}\x{{0B}}\x{{85}}]+', ' ', 'g'))"


def _detected(table_: str, t: str = "text") -> str:
    """CTEs that end in d: the rows of the table with detected."""
    marks = {code: " + ".join(["0", *(f"CASE WHEN contains(low, '{a}') THEN 2 ELSE 0 END" for a in accents)]) for code, (_, accents) in X.MARKERS.items()}
    scores = ", ".join(f"len(list_intersect(ws, {_list(stops)})) + {marks[code]} AS s_{code}" for code, (stops, _) in X.MARKERS.items())
    best = f"greatest({', '.join('s_' + c for c in X.MARKERS)})"
    return rf"""w AS (SELECT *, lower({t}) AS low, list_distinct(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_'']+')) AS ws FROM {table_}),
s AS (SELECT *, {scores} FROM w),
d AS (SELECT * EXCLUDE (low, ws, {', '.join('s_' + c for c in X.MARKERS)}), CASE WHEN {t} IS NULL THEN NULL {' '.join(f"WHEN regexp_matches({t}, '{p}') THEN '{c}'" for c, p in X.SCRIPTS)}
    WHEN {best} < 2 THEN 'en' {' '.join(f"WHEN s_{c} = {best} THEN '{c}'" for c in X.MARKERS)} END AS detected FROM s)"""


def _template(t: str) -> str:
    """For texts whose compatible form is their own. Characters between words are doubled, so that two neighbours don't share one."""
    w, n = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    made = f"lower({t})"
    for pattern, to, every in (
        (rf"https?://\S+|{w}[\p{{L}}\p{{N}}_.+-]*@{w}[\p{{L}}\p{{N}}_.-]*\.[a-z]{{2,}}", " dynamicurl ", ", 'g'"),
        (r"^\s*(?:\[[^\]]{1,30}\]|【[^】]{1,30}】|official\s*:|公式\s*[:：])\s*", "", ""),
        (rf"(?:reply|txt)\s+stop(?:{n}.*)?$|回复\s*[a-z]\s*退订.*$|配信停止.*$", "", ""),
        (rf"({n})", r"\1\1", ", 'g'"),
        (rf"(^|{n})[a-z]{{1,5}}--[a-z0-9]{{6,}}({n}|$)", r"\1 dynamicid \2", ", 'g'"),
        (rf"(^|{n})[a-z]{{1,5}}_?[a-z0-9]{{6,}}({n}|$)", r"\1 dynamicid \2", ", 'g'"),
        (r"\p{Nd}+", " dynamicnumber ", ", 'g'"),
        (r"[^\p{L}\p{N}]+", "", ", 'g'"),
    ):
        made = f"regexp_replace({made}, '{pattern}', '{to}'{every})"
    return made


def _curated(rows_: str, labels: str, assessed: str = "NULL", cap: int = 500) -> str:
    """The full order of checks over r (ord, text, label, language, source)."""
    only = r"regexp_matches(text, '\{\{[A-Z_]+\}\}') AND NOT regexp_matches(regexp_replace(text, '\{\{[A-Z_]+\}\}', '', 'g'), '[\p{L}\p{N}]')"

    def first(before: str, keys: str, name: str, more: str = "true") -> str:
        return f"CASE WHEN {before} IS NULL AND {more} AND row_number() OVER (PARTITION BY {before} IS NULL, label, {keys} ORDER BY ord) > 1 THEN '{name}' ELSE {before} END"

    return rf"""WITH {rows_}, h AS (SELECT lower({_normal('text')}) AS e, {_near(_normal('text'))} AS n FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT * EXCLUDE (text), text AS raw, {_normal('text')} AS text FROM r),
e AS (SELECT *, CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN label IS NULL OR label NOT IN ({labels}) THEN 'unknown-label' ELSE coalesce({assessed}, CASE WHEN {only} THEN 'placeholder-only' END) END AS early FROM t),
{_detected('e')}, l AS (SELECT * REPLACE (CASE WHEN early IS NOT NULL OR coalesce(list_contains({_list(X.LANGUAGES)}, language), false) THEN language ELSE detected END AS language) FROM d),
f AS (SELECT ord, label, source, language, text, {_near('text')} AS near, {_template('text')} AS template, coalesce(early, {_JUNK},
        CASE WHEN min(label) OVER (PARTITION BY early IS NULL, lower(text)) <> max(label) OVER (PARTITION BY early IS NULL, lower(text)) THEN 'cross-label-conflict' END,
        CASE WHEN lower(text) IN (SELECT e FROM h) THEN 'holdout-exact' END, CASE WHEN {_near('text')} IN (SELECT n FROM h) THEN 'holdout-near' END) AS reason0 FROM l),
a AS (SELECT *, {first('reason0', 'text', 'duplicate')} AS reason1 FROM f), b AS (SELECT *, {first('reason1', 'near', 'near-duplicate')} AS reason2 FROM a),
c AS (SELECT *, {first('reason2', 'template', 'template-duplicate', "template <> ''")} AS reason3 FROM b),
z AS (SELECT *, CASE WHEN reason3 IS NULL AND row_number() OVER (PARTITION BY reason3 IS NULL, source, label, language ORDER BY sha256(coalesce(source, '') || chr(31) || label || chr(31) || coalesce(language, '') || chr(31) || text), ord) > {cap} THEN 'source-cap' ELSE reason3 END AS reason FROM c)
"""


_DOCUMENTS = _curated(_ROWS, "'0', '1', 'none'")


@query(_DOCUMENTS + "SELECT ord, label, language, reason FROM z")
def curate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curate(rows(spark, sf_dir), table(spark, sf_dir, "benchmark"), ["0", "1", "none"], max_length=MAX_LENGTH).select("ord", "label", "language", "reason")


@query(_DOCUMENTS + "SELECT language, coalesce(reason, 'kept') AS reason, count(*) AS n FROM z GROUP BY 1, 2")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate_documents(spark, sf_dir).groupBy("language", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(_DOCUMENTS + "SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM z GROUP BY 1, 2")
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.rejection_counts(curation.curate(rows(spark, sf_dir), table(spark, sf_dir, "benchmark"), ["0", "1", "none"], max_length=MAX_LENGTH))


_TURNS = """r AS (SELECT conv_id * 1000 + turn AS ord, CASE WHEN conv_id % 11 = 3 THEN '{{CODE}} - {{URL}}' ELSE text END AS text, role AS label, CASE WHEN conv_id % 5 = 0 THEN 'xx' ELSE 'en' END AS language, 's' || (conv_id % 3) AS source,
    CASE WHEN turn % 2 = 0 THEN role ELSE 'assistant' END AS pl, (conv_id % 10) / 10 + 0.15 AS pc, (turn % 2 = 0 OR role = 'assistant')::INTEGER AS ag FROM conversations)"""
_ASSESSED = """CASE WHEN pl NOT IN ('user', 'assistant') OR pc > 1 THEN 'invalid-assessment'
    WHEN ag = 0 AND pc >= 0.8 AND ('0x' || substr(sha256(label || chr(31) || raw || chr(31) || 'v1'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 >= 0.5 THEN 'remote-disagreement-downsample' END"""


@query(_curated(_TURNS, "'user', 'assistant'", _ASSESSED, 200) + "SELECT ord, label, language, reason FROM z")
def curate_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn as ord", "case when conv_id % 11 = 3 then '{{CODE}} - {{URL}}' else text end as text", "role as label", "case when conv_id % 5 = 0 then 'xx' else 'en' end as language", "concat('s', conv_id % 3) as source",
        "case when turn % 2 = 0 then role else 'assistant' end as predicted_label", "(conv_id % 10) / 10 + 0.15D as predicted_confidence", "cast(turn % 2 = 0 or role = 'assistant' as int) as agreement", "'v1' as model_version",
    )
    return curation.curate(made, table(spark, sf_dir, "benchmark"), ["user", "assistant"], max_length=MAX_LENGTH, cap=200).select("ord", "label", "language", "reason")


@query(f"SELECT doc_id, {_near('text')} AS near FROM documents")
def near_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.near_signature(F.col("text")).alias("near"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '[\s\p{Z}\x{0B}\x{85}]+', ' ', 'g'))) AS digest FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalize(F.col("text")), 256).alias("digest"))


@query(f"SELECT doc_id, sha256({_template('text')}) AS digest FROM documents")
def template_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.template_signature(F.col("text")), 256).alias("digest"))


_DETECTED = f"WITH {_detected('documents')}\n"


@query(_DETECTED + "SELECT doc_id, detected FROM d")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.detect_language(F.col("text")).alias("detected"))


@query(_DETECTED + "SELECT lang, count(*) AS n, count(*) FILTER (WHERE lang = detected) AS n_correct, round(count(*) FILTER (WHERE lang = detected) / count(*), 6) AS accuracy FROM d GROUP BY lang")
def language_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.evaluation import accuracy

    docs = table(spark, sf_dir, "documents")
    return accuracy(docs.select("lang", F.col("lang").alias("label"), X.detect_language(F.col("text")).alias("predicted")), "lang")


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(text, '{X.SCRIPTS[0][1]}') THEN 'ja' WHEN regexp_matches(text, '{X.SCRIPTS[3][1]}') THEN 'zh' WHEN text IS NOT NULL THEN 'en' END AS core,
CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'unknown' END AS hint FROM documents""")
def core_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.core_language(F.col("text")).alias("core"), X.language_hint(F.concat(F.upper("lang"), F.lit("_XX"))).alias("hint"))


@query(rf"""WITH h AS (SELECT lower(text) AS e, {_near('text')} AS n FROM benchmark WHERE text IS NOT NULL)
SELECT doc_id, lang FROM documents WHERE lower(text) NOT IN (SELECT e FROM h) AND {_near('text')} NOT IN (SELECT n FROM h)""")
def holdout_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = curation.holdout_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.where(~F.col("in_exact") & ~F.col("in_near")).select("doc_id", "lang")


@query(rf"""WITH h AS (SELECT lower(text) AS e, {_near('text')} AS n FROM benchmark WHERE text IS NOT NULL)
SELECT count(*) FILTER (WHERE lower(text) IN (SELECT e FROM h)) AS n_exact,
    count(*) FILTER (WHERE lower(text) NOT IN (SELECT e FROM h) AND {_near('text')} IN (SELECT n FROM h)) AS n_near FROM documents""")
def holdout_guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = curation.holdout_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.agg(F.count_if("in_exact").alias("n_exact"), F.count_if(~F.col("in_exact") & F.col("in_near")).alias("n_near"))


@query(f"WITH {_ROWS} SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY label, text ORDER BY ord) AS k FROM r) WHERE k = 1")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir).select("ord", "label", curation.digest(F.col("text")).alias("t"))
    return curation.top_per_group(made, ["label", "t"], [F.col("ord")], 1).select("ord")


@query(f"WITH {_ROWS} SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY label, {_near('text')} ORDER BY ord) AS k FROM r) WHERE k = 1")
def dedupe_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir).select("ord", "label", X.near_signature(F.col("text")).alias("t"))
    return curation.top_per_group(made, ["label", "t"], [F.col("ord")], 1).select("ord")


@query(rf"""WITH {_ROWS}, k AS (SELECT *, {_near('text')} AS near, {_template('text')} AS template FROM r),
a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label, text ORDER BY ord) > 1 THEN 'duplicate' END AS r1 FROM k),
b AS (SELECT *, CASE WHEN r1 IS NULL AND row_number() OVER (PARTITION BY r1 IS NULL, label, near ORDER BY ord) > 1 THEN 'near-duplicate' ELSE r1 END AS r2 FROM a)
SELECT ord, CASE WHEN r2 IS NULL AND template <> '' AND row_number() OVER (PARTITION BY r2 IS NULL, label, template ORDER BY ord) > 1 THEN 'template-duplicate' ELSE r2 END AS reason FROM b""")
def dedupe_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir).select("ord", "label", F.lit(None).cast("string").alias("reason"), curation.digest(F.col("text")).alias("exact"), curation.digest(X.near_signature(F.col("text"))).alias("near"), X.template_signature(F.col("text")).alias("template"))
    made = made.withColumn("template", curation.digest(F.nullif("template", F.lit(""))))
    return curation.dedupe_cascade(made, [("duplicate", ["label", "exact"]), ("near-duplicate", ["label", "near"]), ("template-duplicate", ["label", "template"])]).select("ord", "reason")


@query(f"WITH {_ROWS} SELECT ord, label FROM (SELECT ord, label, min(label) OVER (PARTITION BY lower(text)) <> max(label) OVER (PARTITION BY lower(text)) AS c FROM r) WHERE c")
def cross_label_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.conflicting(rows(spark, sf_dir).select("ord", "label", "text"), F.lower("text")).where("conflict").select("ord", "label")


@query(f"""WITH {_ROWS} SELECT ord, digest FROM (SELECT ord, digest, row_number() OVER (PARTITION BY source, label, language ORDER BY digest, ord) AS k
FROM (SELECT *, sha256(source || chr(31) || label || chr(31) || language || chr(31) || text) AS digest FROM r)) WHERE k <= 5""")
def source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.source_cap(rows(spark, sf_dir), 5).select("ord", "digest")


@query(f"""WITH {_ROWS} SELECT ord, label FROM (SELECT ord, label, row_number() OVER (PARTITION BY label ORDER BY sha256(label || chr(31) || text), ord) AS k FROM r) WHERE k <= 50""")
def supplement_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.supplement_cap(rows(spark, sf_dir), 50).select("ord", "label")


@query(f"""WITH {_ROWS}, p AS (SELECT ord, label, text, CASE WHEN ord % 3 = 0 THEN label ELSE 'other' END AS predicted, (ord % 10) / 10 + 0.15 AS sure, (ord % 3 = 0)::INTEGER AS agree FROM r),
q AS (SELECT *, ('0x' || substr(sha256(label || chr(31) || text || chr(31) || 'v1'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS share FROM p)
SELECT ord, CASE WHEN sure > 1 THEN 'invalid-assessment' WHEN agree = 0 AND sure >= 0.8 AND share >= 0.25 THEN 'remote-disagreement-downsample' END AS reason FROM q""")
def disagreement_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir).selectExpr("ord", "label", "text", "case when ord % 3 = 0 then label else 'other' end as predicted_label", "(ord % 10) / 10 + 0.15D as predicted_confidence", "cast(ord % 3 = 0 as int) as agreement", "'v1' as model_version")
    return made.select("ord", curation.assessment_reason(["0", "1", "none", "other"], 0.25).alias("reason"))


def _split(take: str) -> str:
    return f"""WITH {_ROWS}, k AS (SELECT ord, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY sha256('7' || chr(31) || ord::VARCHAR), ord) AS i FROM r)
SELECT ord, label, CASE WHEN n >= 5 AND i <= {take} THEN 'validation' ELSE 'train' END AS part FROM k"""


@query(_split("floor(n * 0.1)"))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.split(rows(spark, sf_dir).select("ord", "label"), 0.1)


@query(_split("greatest(1, least(floor(n * 0.1 + 0.5), n - 1))"))
def stratified_split_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.split(rows(spark, sf_dir).select("ord", "label"), 0.1, clamp=True)


@query(f"WITH {_ROWS} SELECT ord, label, language, turn::INTEGER AS turn FROM (SELECT *, row_number() OVER (PARTITION BY label, language ORDER BY ord) AS turn FROM r) ORDER BY turn, label, language LIMIT 64")
def calibration_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.round_robin(rows(spark, sf_dir).select("ord", "label", "language"), ["label", "language"], 64)


@query()
def source_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.round_robin_sources(rows(spark, sf_dir).select("ord", "label", "source"), 100)


@query(f"WITH {_ROWS} SELECT ord, sha256('7' || chr(31) || ord::VARCHAR) AS digest FROM r ORDER BY digest")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.shuffled(rows(spark, sf_dir).select("ord")).orderBy("digest")


_LANGS = ("de", "en", "es", "fr", "zh")


@query(f"WITH {_ROWS} SELECT label, {', '.join(f'''count(*) FILTER (WHERE language = '{c}') AS {c}''' for c in _LANGS)} FROM r GROUP BY label UNION ALL SELECT 'unseen', 0, 0, 0, 0, 0")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir).select("label", "language")
    labels = made.select("label").distinct().union(spark.createDataFrame([("unseen",)], "label string"))
    return curation.coverage(made, labels, _LANGS)


@query(f"""WITH {_ROWS}, e AS (SELECT l.label, g.language FROM (SELECT DISTINCT label FROM r) l, (SELECT unnest(['de', 'en', 'es', 'fr', 'zh']) AS language) g)
SELECT e.label, e.language, count(r.ord) AS n FROM e LEFT JOIN r ON r.label = e.label AND r.language = e.language GROUP BY 1, 2 HAVING count(r.ord) < 100""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir).select("ord", "label", "language")
    return curation.coverage_gaps(made, made.select("label"), spark.createDataFrame([(c,) for c in _LANGS], "language string"), 100)


@query(f"""WITH {_ROWS}, k AS (SELECT label, language, {_template('text')} AS t FROM r) SELECT label, language, count(*) AS n_rows, count(DISTINCT t) AS n_templates, round(count(*) / greatest(count(DISTINCT t), 1), 3) AS concentration FROM k GROUP BY 1, 2""")
def source_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.concentration(rows(spark, sf_dir).select("label", "language", curation.digest(X.template_signature(F.col("text"))).alias("template")))


@query(f"WITH {_ROWS} SELECT source, label, count(*) AS n FROM r GROUP BY GROUPING SETS ((source, label), (source), (label))")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir).select("source", "label")
    return made.groupingSets([["source", "label"], ["source"], ["label"]], "source", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {_ROWS}, k AS (SELECT language, (row_number() OVER (ORDER BY ord) - 1) % greatest(count(*) OVER () // 500, 1) = 0 AS taken FROM r),
g AS (SELECT language, count(*) AS n FROM k WHERE taken GROUP BY 1) SELECT * FROM (SELECT language, n, n / sum(n) OVER () AS share FROM g) WHERE share >= 0.5""")
def dominant_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.dominant_language(rows(spark, sf_dir).select("ord", "language"), share=0.5)


@query(r"""WITH t AS (SELECT doc_id AS ord, source AS label, trim(regexp_replace(text, '[\s\p{Z}\x{0B}\x{85}]+', ' ', 'g')) AS text FROM documents),
a AS (SELECT *, CASE WHEN label NOT IN ('src0', 'src1', 'src2', 'src3') THEN 'unknown-label' WHEN NOT length(text) BETWEEN 4 AND 1000 THEN 'bad-length' END AS why FROM t)
SELECT ord, label, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY why IS NULL, label, text ORDER BY ord) > 1 THEN 'duplicate' ELSE why END AS reason FROM a""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("label"), "text")
    return curation.exported(docs, ["src0", "src1", "src2", "src3"]).select("ord", "label", "reason")


@query("""SELECT doc_id AS ord, CASE WHEN source IN ('src1', 'src2') AND regexp_matches(lower(text), 'license|rights') AND NOT regexp_matches(lower(text), 'gnu') THEN 'legal' ELSE source END AS label,
source IN ('src1', 'src2') AND regexp_matches(lower(text), 'license|rights') AND NOT regexp_matches(lower(text), 'gnu') AS relabelled FROM documents""")
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("label"), "text")
    return curation.relabelled(docs, ["license", "rights"], ["src1", "src2"], "legal", ["gnu"]).select("ord", "label", "relabelled")


_CANON = r"regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', '', 'g'), '\p{Nd}+', '#', 'g')"


@query(rf"""WITH c AS (SELECT page_id AS ord, split_part(url, '://', 1) AS label, {_CANON.replace('text', 'url')} AS c FROM pages),
k AS (SELECT label, c, min(ord) AS ord, CASE WHEN length(c) >= 3 THEN list_distinct(list_transform(range(1, length(c) - 1), lambda i: substring(c, i, 3))) ELSE [] END AS s FROM c WHERE c <> '' GROUP BY label, c)
SELECT k.ord AS a, c.ord AS b, 1.0::DOUBLE AS dice FROM c JOIN k ON c.label = k.label AND c.c = k.c WHERE c.ord <> k.ord
UNION ALL SELECT a, b, dice FROM (SELECT x.ord AS a, y.ord AS b, 2 * len(list_intersect(x.s, y.s))::DOUBLE / (len(x.s) + len(y.s)) AS dice FROM k x JOIN k y ON x.label = y.label AND x.ord < y.ord AND least(length(x.c), length(y.c)) >= 12) WHERE dice >= 0.92""")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.split_part("url", F.lit("://"), F.lit(1)).alias("label"), F.col("url").alias("text"))
    return curation.similar_pairs(pages)


_CENTROIDS = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label), n AS (SELECT label, count(*) AS n FROM e GROUP BY label HAVING count(*) >= 8),
u AS (SELECT c.label, list_transform(c, lambda t: t / (sqrt(list_dot_product(c, c)) + 1e-12)) AS c, n FROM c JOIN n ON c.label = n.label),
k AS (SELECT e.vec_id, e.label, u.label AS l, list_dot_product(e.v, u.c) / (sqrt(list_dot_product(e.v, e.v)) + 1e-12) AS s FROM e, u),
g AS (SELECT vec_id, label, max(s) FILTER (WHERE l = label) AS own, max(s) FILTER (WHERE l <> label) AS other FROM k GROUP BY 1, 2)
"""


@query(_CENTROIDS + "SELECT label, i::INTEGER AS i, round(v, 5) AS v, n FROM (SELECT label, n, unnest(c) AS v, generate_subscripts(c, 1) - 1 AS i FROM u)")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = embedding.centroids(table(spark, sf_dir, "embeddings"))
    return made.select("label", "n", F.posexplode("centroid").alias("i", "v")).withColumn("v", F.round("v", 5))


@query(_CENTROIDS + "SELECT vec_id, label, round(own, 4) AS own, round(other, 4) AS other FROM g")
def centroid_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return embedding.margins(e, embedding.centroids(e)).select("vec_id", "label", F.round("own", 4).alias("own"), F.round("other", 4).alias("other"))


@query(_CENTROIDS + """SELECT vec_id, label, CASE WHEN margin < -0.15 THEN 'label-noise' WHEN margin < 0 AND i > floor(n * 0.7 + 0.9999) THEN 'gray-zone-drop' END AS band
FROM (SELECT *, count(*) OVER (PARTITION BY label, z) AS n, row_number() OVER (PARTITION BY label, z ORDER BY margin DESC, vec_id) AS i FROM (SELECT vec_id, label, own - other AS margin, own - other >= -0.15 AND own - other < 0 AS z FROM g))""")
def label_noise_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return embedding.noise_bands(embedding.margins(e, embedding.centroids(e))).select("vec_id", "label", "band")


def _re2(p: str) -> str:
    return p.replace("'", "''")


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{_re2(redaction.URL)}', '{{{{URL}}}}', 'g'), '{_re2(redaction.EMAIL)}', '{{{{EMAIL}}}}', 'g'), '{_re2(redaction.AMOUNT)}', '{{{{AMOUNT}}}}', 'g') AS text FROM documents""")
def redact_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redaction.redact_plain(F.col("text")).alias("text"))


@query()
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", redaction.sanitizer()(F.col("text")).alias("r"))
    return made.select("doc_id", "r.text", "r.spans")


#: What the base set of an augmentation has at most of a source, label and language.
BASE_CAP = 500


@query()
def augment_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = curation.source_cap(rows(spark, sf_dir), BASE_CAP).drop("digest")
    rules = [{"replacements": [["the ", "some of these "]], "id": "the", "languages": ["en"], "labels": ["0", "1", "none"]}]
    made = augmentation.augment(base, rules, holdout=table(spark, sf_dir, "benchmark"), least_change=0.0)
    return augmentation.augmentation_report(made)


@query("""SELECT doc_id AS ord, text || ' ' || v.value AS text, v.tag AS tag, length(text) + 1 AS start, length(text) + 1 + length(v.value) AS "end" FROM documents, (SELECT 'CODE' AS tag, '482913' AS value) v""")
def injected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmentation.with_spans(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text"), [("CODE", "482913")])


@query()
def hashed_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.hashed_ngrams(F.col("text")).alias("features"))
