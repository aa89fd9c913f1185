"""Bytes that aren't UTF-8, long runs, repeated rows, and what exchange between views is good for."""

import itertools
import random

import numpy as np
import pytest
from llm_brute import prose
from pyspark.sql import functions as F

from textloom.llm import common, cotrain, decontaminate, linededup, lm, packing, simhash, substrings, tokenids, toxicity
from textloom.llm.tokenids import ShardReader


@pytest.fixture(scope="module")
def broken(spark):
    """Texts whose bytes aren't UTF-8 in the middle of words, at line ends and alone, some of them alike."""
    rng = random.Random(6)
    bodies = [prose(rng, 70).encode() for _ in range(6)]
    rows = [(k, b[:90] + b"\xe9\xff " + b[90:] + b"\ncaf\xe9 one\n\xc3") for k, b in enumerate(bodies)]
    rows += [(6, rows[0][1]), (7, b"\xff"), (8, b"\xed\xa0\x80 x"), (9, b"plain text"), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s")})


def test_one_rule_for_bytes_that_are_not_utf8(spark, broken):
    whole = {r.doc_id: r.text for r in common.readable(broken).collect()}
    assert "�" in whole[0] and whole[9] == "plain text" and whole[10] is None and set(whole[7]) == {"�"}
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(6)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    assert cotrain.score(broken, cotrain.fit(broken, labels)).count() == 11
    bench = broken.where("doc_id in (1, 7)").select("text")
    clean = {r.doc_id: r for r in decontaminate.decontaminate(broken, bench).collect()}
    assert clean[1].removed_words == clean[1].n_words > 60 and clean[9].text == "plain text" and clean[2].removed_words == 0
    assert {r.doc_id for r in substrings.repeats(broken).collect()} == {0, 6}
    for size in (1 << 20, 0):
        lines = {r.doc_id: r for r in linededup.dedup(broken, broadcast_bytes=size).collect()}
        assert len(lines) == 11 and lines[3].n_removed == 2 and lines[0].n_removed == 0 and "�" in lines[3].text
    assert lm.score(broken).where("log_prob is null").count() == 0
    kept = {r.doc_id for r in simhash.deduplicated(broken).collect()}
    assert 0 in kept and 6 not in kept and 7 in kept
    assert {r.doc_id: r.n_links for r in simhash.groups(broken).collect()}[6] >= 1
    assert toxicity.score(broken, toxicity.fit(broken, labels)).count() == 11
    for row in tokenids.encode(broken).collect():
        reader = ShardReader(row)
        for i, d in enumerate(reader.doc_ids):
            assert tokenids.encoding(tokenids.VOCABULARY).decode(reader[i].tolist()) == (whole[d] or "")
    assert {r.doc_id for r in packing.pack(broken).collect()} == set(range(10))


@pytest.mark.parametrize("text", [" " * 3_000_000, "a" + " " * 3_000_000 + "b", "\n" * 1_000_000 + "end", "!" * 300_000, "x" * 300_000, "7" * 300_000])
def test_long_runs_round_trip(text):
    encoder = tokenids.Encoder(tokenids.VOCABULARY)
    ids, n = encoder.texts([text, "a b"])
    assert encoder.encoding.decode(ids[: n[0]].tolist()) == text and encoder.encoding.decode(ids[n[0] :].tolist()) == "a b"


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(spark)


def test_spooled_tables_can_be_removed(spark):
    n = common.spooled()
    df = common.spool(spark.range(5).toDF("x"), "some")
    assert df.count() == 5 and common.spooled() == n + 1
    common.clear(spark, n)
    assert common.spooled() == n
    with pytest.raises(Exception):
        spark.read.schema("x long").parquet(df.inputFiles()[0]).count()


def test_repeated_documents_do_not_fill_the_exchange(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 40) if i % 2 else "buy cheap ### now!! " * 12, "en", "s") for i in range(60)] + [(999, prose(rng, 40), "en", "s")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen = []
    original = cotrain._surest
    try:
        cotrain._surest = lambda *a: seen.append(original(*a)) or seen[-1]
        assert cotrain.fit(df, labels, grow=8) is not None
    finally:
        cotrain._surest = original
    given = [ids for found in seen for ids in found.values()]
    assert given and all(len(ids) == len(set(ids)) for ids in given) and max(map(len, given)) > 1


def test_views_teach_each_other(spark):
    """Words of few labelled documents cover little; what metadata is sure of, by its source, brings in the rest."""
    rng = random.Random(8)
    good, bad = ([f"{p}{a}{b}" for a in "bcdfghklmn" for b in ("ano", "eru", "ilo", "oma", "ute")] for p in ("za", "qu"))
    rows = []
    for i in range(900):
        y = i % 2
        rows.append((i, " ".join(rng.choice((bad, good)[y]) for _ in range(6)), "en", ("junk", "news")[y] if rng.random() < 0.97 else "mixed", y))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, y int").repartition(3)
    labels = df.where("doc_id < 20").select("doc_id", F.col("y").alias("quality"))
    right = {}
    for rounds in (0, 2):
        made = cotrain.score(df, cotrain.fit(df, labels, rounds=rounds, grow=300, sure=0.8)).where("doc_id >= 20")
        right[rounds] = made.agg(F.avg(((F.col("p_content") >= 0.5) == (F.col("y") == 1)).cast("int"))).first()[0]
    assert right[2] > right[0] and right[2] > 0.95


def test_plan_is_near_the_least_number_of_windows():
    """Against the best packing of few pieces, found by trying all."""

    def least(pieces, bins):
        best = len(pieces)

        def put(left, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if not left:
                best = len(rooms)
                return
            for k, room in enumerate(rooms):
                if room >= left[0] and room not in rooms[:k]:
                    put(left[1:], [*rooms[:k], room - left[0], *rooms[k + 1 :]])
            put(left[1:], [*rooms, bins - left[0]])

        put(sorted(pieces, reverse=True), [])
        return best

    rng, total, best = np.random.default_rng(4), 0, 0
    for _ in range(25):
        h = rng.integers(0, 3, 8)
        pieces = list(itertools.chain.from_iterable([b + 1] * n for b, n in enumerate(h)))
        made = sum(n for _, n in packing.plan(h))
        assert made >= least(pieces, 8)
        total, best = total + made, best + least(pieces, 8)
    assert total <= 1.1 * best
    with pytest.raises(ValueError):
        packing.pack(None, window=65_536, granule=16)
