from llm_brute import decontaminated, line_deduped, near_groups, toxic_probability
from test_llm_operators import check_packed

import corpus_pipeline
from textloom.llm import simhash, toxicity

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    if model is not None:
        rows = [(d, t) for d, t in rows if toxic_probability(t, model)[0] < model.threshold]
    rows = [(d, t) for d, t, _, gone in line_deduped(rows) if not gone or t.strip(" \t\f\r\n")]
    root = near_groups([t for _, t in rows], simhash.RADIUS)
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    cleaned = [(d, *decontaminated(t, items)) for d, t in rows]
    lengths = {d: len(t.split()) for d, t, n, gone in cleaned if gone < n or not gone}
    got = corpus_pipeline.run(spark, DIR).collect()
    check_packed(got, lengths, 2048)


def test_stages_keep_columns(spark, messy):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[0] == "toxicity"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        assert stage(spark, docs.limit(0), DIR).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DIR).count() == 0
