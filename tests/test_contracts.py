"""Order of curation, releases, devices, tokens and decisions against plain expectations."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import curation, decisions, evaluation, models


def curated(spark, rows, holdout=(), **how):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord long, text string, label string, source string, language string")
    held = spark.createDataFrame([(t,) for t in holdout], "text string")
    return [r.reason for r in curation.curate(df.repartition(3), held, **how).orderBy("ord").collect()]


def test_order_of_reasons(spark):
    rows = [
        ("", "x", "s", "en"), (None, "zz", "s", "en"), ("a fine message here", "zz", "s", "en"), ("{{A}}", "x", "s", "en"), ("{{CODE}} - !", "x", "s", "en"), ("tiny", "x", "s", "en"),
        ("one message of two", "x", "s", "en"), ("ONE message of two", "y", "s", "en"), ("one message of two", "zz", "s", "en"), ("it is held out, this", "x", "s", "en"), ("it is held out this!", "x", "s", "en"),
        ("first of its kind 12", "x", "s", "en"), ("first of its kind 12", "x", "s", "en"), ("first of its kind 99", "x", "s", "en"), ("pay at https://a.example/1 today", "x", "s", "en"), ("pay at https://b.example/2/zz today", "x", "s", "en"),
        ("привет это сообщение", "x", "s", "xx"), ("{{PHONE}} called for you", "x", "s", "en"),
    ]
    got = curated(spark, rows, ["it is held out, this", None], labels=["x", "y"], languages=["en"])
    assert got == [
        "empty", "empty", "unknown-label", "placeholder-only", "placeholder-only", "too-short",
        "cross-label-conflict", "cross-label-conflict", "unknown-label", "holdout-exact", "holdout-near",
        None, "duplicate", "near-duplicate", None, "template-duplicate",
        "language", None,
    ]
    assert curated(spark, rows[:3], labels=None)[2] is None
    with pytest.raises(ValueError):
        curated(spark, rows, languages=["en", "tlh"])


def test_caps_and_margins_come_last(spark):
    words = "alpha bravo carlo delta eagle fever gamma hotel india".split()
    rows = [(f"a message about {w} only", "x", "s", "en") for w in words] + [(f"a message about {w} too", "x", "t", "en") for w in words[:2]]
    got = curated(spark, rows, cap=4)
    assert got.count("source-cap") == 5 and got[9:] == [None, None] and curated(spark, rows[::-1], cap=4)[::-1][:9].count("source-cap") == 5
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord long, text string, label string, source string, language string")
    margins = spark.createDataFrame([(0, "x", -0.5), (1, "x", -0.1), (2, "x", -0.12), (3, "x", 0.4)], "ord long, label string, margin double")
    made = {r.ord: r.reason for r in curation.curate(df, spark.createDataFrame([], "text string"), cap=0, margins=margins).collect()}
    assert made[0] == "label-noise" and made[3] is None and made[5] is None and [made[1], made[2]].count("gray-zone-drop") == 0


def test_one_release(spark):
    df = spark.createDataFrame([("transformer", 1), ("transformer", 2), ("classic", 3)], "variant string, sequence int")
    assert evaluation.one_release(df, sequence=2).first().sequence == 2 and evaluation.one_release(df, "classic").first().sequence == 3
    for how in ({}, {"sequence": 9}):
        with pytest.raises(ValueError):
            evaluation.one_release(df, **how)


def test_checked_histograms(spark):
    df = spark.createDataFrame([(150, 3), (1000, 1)], "bound int, n long")
    assert evaluation.checked(df).agg(F.sum("n")).first()[0] == 4
    for bad in ((evaluation.OVER, 1), (150, -1), (77, 1)):
        with pytest.raises(Exception, match="second|negative|unknown"):
            evaluation.checked(df.union(spark.createDataFrame([bad], "bound int, n long"))).collect()


def test_device_metrics(spark):
    b = spark.createDataFrame([("d", "all", True, "gpu", 0.0, 100, 150, 400, None, 7), ("e", "cpuOnly", False, "cpu", 2.0, 100, 50, None, None, None)], "device string, compute_units string, accelerated boolean, costliest string, cpu_cost double, baseline long, average long, peak long, average_increase long, peak_increase long")
    row = {f: 1.0 for f in evaluation.DEVICE_FIELDS}
    rows = [row | {"device": "d", "compute_units": "all", "cold_runs": 30.0, "warm_queries": 10_000.0, "cpu_stress_passed": None, **{f: True for f in evaluation.STRESS[False]}}, row | {"device": "e", "compute_units": "all", "warm_p95": None, "cpu_stress_passed": True, **{f: f != "low_power_passed" for f in evaluation.STRESS[False]}}]
    kinds = ", ".join(f"{f} {'string' if f in ('device', 'compute_units') else 'boolean' if f.endswith('passed') else 'double'}" for f in rows[0])
    e = spark.createDataFrame([tuple(r[k] for k in rows[0]) for r in rows], kinds)
    got = {r.device: r for r in evaluation.device_metrics(b, e).collect()}
    assert (got["d"].runtime_verified, got["d"].average_increase, got["d"].peak_increase, got["d"].problems) == (True, 50, 7, [])
    assert (got["e"].average_increase, got["e"].peak_increase) == (0, 0) and set(got["e"].problems) == {"missing warm_p95", "cold runs", "warm queries", "compute units differ", "stress"}
    reports = spark.createDataFrame([("d", 0.5), ("f", 0.7)], "device string, accuracy double")
    metrics = evaluation.device_metrics(b, e)
    assert {r.device: r.peak_increase for r in evaluation.with_device_metrics(reports, metrics.where("device = 'd'"), "device").collect()} == {"d": 7, "f": None}
    with pytest.raises(Exception, match="stress"):
        evaluation.with_device_metrics(spark.createDataFrame([("e", 0.5)], "device string, accuracy double"), metrics, "device").collect()


def test_rule_table_equals_expression(spark):
    messages = spark.createDataFrame([("+1-555", "win now"), ("Bank", "code 12"), (None, None), ("ab", "WIN")], "sender string, text string")
    rules = [
        {"id": "low", "enabled": True, "priority": 1, "sender": None, "text": {"kind": "contains", "pattern": "WIN"}, "action": "junk", "createdAt": 1},
        {"id": "plus", "enabled": True, "priority": 9, "sender": {"kind": "exact", "pattern": "+1-555"}, "text": None, "action": "none", "createdAt": 3},
        {"id": "broken", "enabled": True, "priority": 99, "sender": None, "text": {"kind": "regex", "pattern": "("}, "action": "junk", "createdAt": 0},
        {"id": "both", "enabled": True, "priority": 5, "sender": {"kind": "prefix", "pattern": "B"}, "text": {"kind": "regex", "pattern": r"CODE\s\d+"}, "action": "transaction", "createdAt": 0},
        {"id": "empty", "enabled": True, "priority": 50, "sender": {"kind": "contains", "pattern": ""}, "text": None, "action": "junk", "createdAt": 0},
    ]
    a = [tuple(r) for r in decisions.first_rule(messages, rules).collect()]
    b = [tuple(r) for r in decisions.match_rules(messages, spark.createDataFrame(rules, decisions.RULE)).collect()]
    assert a == b and [r[2] for r in a] == ["plus", "both", None, "low"]
    assert decisions.match_rules(messages, spark.createDataFrame([], decisions.RULE)).where("rule_id is null").count() == 4


def test_decided(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('[{"label": "spam", "keywords": ["WINNER"], "confidence": 0.9}, {"label": "work.meeting", "keywords": ["meet"], "confidence": 0.5}]')
    rules = decisions.read_keyword_rules(spark, str(path))
    assert rules == (("spam", ("winner",), 0.9), ("work.meeting", ("meet",), 0.5))
    messages = spark.createDataFrame([("a", "a winner"), ("a", "we meet"), ("System", "winner")], "sender string, text string")
    stop = [{"id": "r", "enabled": True, "priority": 1, "sender": {"kind": "exact", "pattern": "system"}, "text": None, "action": "none", "createdAt": 0}]
    made = decisions.decided(messages, stop, decisions.keyword_label(F.col("text"), rules)).collect()
    assert [(r.label, r.source, r.action) for r in made] == [("spam", "keywords", "junk"), ("transaction.other", "fallback", "none"), (None, "rule", "none")]
    abstains = F.struct(F.lit(decisions.ABSTAIN).alias("label"), F.lit(0.1).alias("confidence"), F.lit("model").alias("source"))
    assert {(r.label, r.source, r.action) for r in decisions.decided(messages, [], abstains).collect()} == {(decisions.ABSTAIN, "model", "none")}


def test_byte_pairs(spark):
    parts = ["<s>", "</s>", "<pad>", "<unk>", "▁", "a", "b", "c", "ab", "▁ab", "abc", "<0xC3>", "<0xA9>"]
    vocabulary = {p: k for k, p in enumerate(parts)}
    run = models.byte_pairs(spark, vocabulary, [("a", "b"), ("▁", "ab"), ("ab", "c")], length=8)
    df = spark.createDataFrame([("ab abc",), ("é z",), ("ab " * 9,), ("",), (None,)], "t string").repartition(1)
    rows = [r.r for r in df.select(run("t").alias("r")).collect()]
    name = {k: p for p, k in vocabulary.items()}
    assert [name[i] for i in rows[0].ids] == ["<s>", "▁ab", "▁ab", "c", "</s>", "<pad>", "<pad>", "<pad>"] and list(rows[0].mask) == [1] * 5 + [0] * 3
    assert list(rows[0].word)[:5] == [-1, 0, 1, 1, -1] and list(zip(rows[0].start, rows[0].end))[1:4] == [(0, 2), (3, 6), (3, 6)]
    assert [name[i] for i in rows[1].ids][:7] == ["<s>", "▁", "<0xC3>", "<0xA9>", "▁", "<unk>", "</s>"]
    assert all(len(r.ids) == 8 and sum(r.mask) <= 8 for r in rows) and [name[i] for i in rows[2].ids][-1] == "</s>" and sum(rows[3].mask) == sum(rows[4].mask) == 2
    spans = F.array(F.struct(F.lit("X").alias("token"), F.lit(2).alias("start"), F.lit(4).alias("end")))
    piece = F.arrays_zip("r.start", "r.end")
    tags = df.limit(1).select(run("t").alias("r")).select(models.span_tags(piece, spans).alias("tags")).first().tags
    assert tags[:5] == [None, "O", "X", "X", None]
