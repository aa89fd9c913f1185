import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import files
from textloom.streaming import events


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_lenient_rows(spark, tmp_path):
    a = write(tmp_path / "a.ndjson", [{"text": "t1", "label": "l", "extra": 1}, "", {"text": "t2"}, {"text": "t3", "label": "l", "source": "s", "language": "en", "textLanguage": "fr"}])
    got = files.read_rows(spark, [a, str(tmp_path / "missing.ndjson")]).orderBy("file", "place").collect()
    assert [(r.text, r.source, r.language) for r in got] == [("t1", "a", None), ("t3", "s", "fr")]
    assert files.read_rows(spark, [str(tmp_path / "none")]).count() == 0
    with pytest.raises(Exception):
        files.read_rows(spark, [write(tmp_path / "b.ndjson", ["{bad"])]).collect()


def test_strict_rows(spark, tmp_path):
    with pytest.raises(Exception):
        files.read_strict(spark, write(tmp_path / "a.ndjson", [{"text": " ", "label": "l"}])).collect()
    assert files.read_strict(spark, write(tmp_path / "b.ndjson", [{"text": "t", "label": "l"}])).count() == 1


def test_csv_lines_tsv(spark, tmp_path):
    c = files.read_csv(spark, write(tmp_path / "a.csv", ["a,b", '"x ""q""\ny",2', "", "3"]))
    assert [tuple(r) for r in c.collect()] == [('x "q"\ny', "2"), ("3", "")]
    (tmp_path / "lines").mkdir()
    write(tmp_path / "lines" / "spam.txt", ["one", "", "two"])
    assert sorted((r.text, r.label) for r in files.read_labelled_lines(spark, str(tmp_path / "lines")).collect()) == [("one", "spam"), ("two", "spam")]
    assert [r.text for r in files.read_flagged_tsv(spark, write(tmp_path / "f.tsv", ["1\ta\tb", "0\tc", "1"])).collect()] == ["a\tb"]


def test_pages_and_flattening(spark, tmp_path):
    page = {"records": [{"recordName": "r1", "recordType": "S", "fields": {"text": {"value": "t", "type": "STRING"}, "n": {"value": "1.5", "type": "X"}, "m": {"value": "x", "type": "X"}}}], "continuationMarker": "m"}
    r = files.flattened(files.read_pages(spark, write(tmp_path / "p.json", [page])), ["text"], ["n", "m"]).first()
    assert (r.text, r.n, r.m) == ("t", 1.5, None)
    with pytest.raises(Exception):
        files.read_pages(spark, write(tmp_path / "e.json", [{"serverErrorCode": "BAD"}])).collect()


def json_lines(path):
    """The lines of all parts: some may be empty."""
    return [json.loads(line) for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_sinks_store_and_digests(spark, tmp_path):
    df = spark.createDataFrame([("t", "l", None)], "text string, label string, language string")
    files.write_rows(df, str(tmp_path / "out"))
    assert json_lines(tmp_path / "out") == [{"text": "t", "label": "l", "language": None, "source": None, "sourceLabel": None}]
    store = files.SampleStore(spark, str(tmp_path / "store"))
    assert store.count() == 0
    one = spark.createDataFrame([("1", "l", "t", 1)], store.schema)
    store.append(one)
    store.append(one)
    assert store.count() == 2
    store.clear()
    assert store.count() == 0
    d = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    x, y = (files.ordered_digest(k, ["a", "b"]).first() for k in (d, d.repartition(7).orderBy(F.desc("a"))))
    assert x == y and x.n == 50
    left, gone = files.without(d, spark.createDataFrame([(1,), (99,)], "a int"), "a")
    assert (left.count(), gone) == (49, 1)
    assert d.select(files.canonical_json(d)).first()[0] == '{"a":0,"b":"0"}'


def run_stream(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_tables(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.createDataFrame([(f"s{i % 3}", i) for i in range(12)], "session string, seq long").coalesce(1).write.parquet(at)
    made = run_stream(spark, events.cold_starts_stream(spark.readStream.schema("session string, seq long").parquet(at)), tmp_path, "cold")
    batch = events.cold_starts(spark.read.parquet(at))
    assert sorted(map(tuple, made.collect())) == sorted((r.session, r.seq, r.is_cold) for r in batch.collect())


def test_unseen_samples(spark, tmp_path):
    at = str(tmp_path / "in")
    rows = [("1", "a", "Your code is 1234 thank you"), ("2", "a", "your CODE is 999 thank you!"), ("3", "b", "Your code is 1234 thank you"), ("4", "a", None), ("5", "a", "something else entirely here")]
    spark.createDataFrame(rows, "id string, label string, text string").coalesce(1).write.parquet(at)
    made = run_stream(spark, events.unseen_samples(spark.readStream.schema("id string, label string, text string").parquet(at)), tmp_path, "unseen")
    assert sorted(r.id for r in made.collect()) == ["1", "3", "5"]


def test_csv_without_carriage_returns(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes(b'a,b\r\n"one\r\ntwo",3\r\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "w.csv")).collect()] == [("one\ntwo", "3")]


def test_order_over_files(spark, tmp_path):
    paths = [write(tmp_path / f"{n}.json", [{"text": f"{n}{k}", "label": "l"} for k in range(30)] + [{"text": "", "label": "l"}]) for n in "ba"]
    got = files.in_order(files.read_rows(spark, paths))
    assert [r.text for r in got.orderBy("ord").collect()] == [f"{n}{k}" for n in "ba" for k in range(30)]
    assert sorted(r.ord for r in got.collect()) == list(range(60))
    assert [r.text for r in files.limited(got, 3).collect()] == ["b0", "b1", "b2"] and files.limited(got, None).count() == 60
    assert files.in_order(files.read_rows(spark, [])).count() == 0


def test_paged_queries(spark):
    records = [{"recordName": f"r{k}", "fields": {"createdAt": {"value": k // 2}}} for k in range(450)]

    def fetch(size, marker):
        at = int(marker or 0)
        return {"records": records[at : at + size], "continuationMarker": str(at + size) if at + size < len(records) else None}

    assert len(list(files.paged(fetch))) == 450 and [r["recordName"] for r in files.paged(fetch, most=205)] == [f"r{k}" for k in range(205)]
    assert [r["recordName"] for r in files.paged(fetch, since=222)] == [f"r{k}" for k in range(446, 450)]
    with pytest.raises(ValueError, match="BAD"):
        list(files.paged(lambda size, marker: {"serverErrorCode": "BAD"}))
    with pytest.raises(ValueError, match="order"):
        list(files.paged(lambda size, marker: {"records": records[:1:-1]}))
    df = spark.createDataFrame([(f"r{k}", float(k)) for k in range(9)], "recordName string, createdAt double")
    assert [r.recordName for r in files.since(df, 3, 2).collect()] == ["r4", "r5"] and files.since(df, None).count() == 9
    assert [r.recordName for r in files.page_after(df, None, "createdAt", "recordName", shown=195).collect()] == ["r8", "r7", "r6", "r5", "r4"]
    assert files.is_last_page(29, 59) and files.is_last_page(30, 200) and not files.is_last_page(30, 60)


def test_curated_sinks(spark, tmp_path):
    from textloom.operators import curation

    rows = spark.createDataFrame([(0, "a message to be kept", "x", "s", "en"), (1, "short", "x", "s", "en"), (2, "your code is {{CODE}} now", "x", "t", "en")], "ord long, text string, label string, source string, language string")
    made = curation.curated_rows(rows, curation.curate(rows, spark.createDataFrame([], "text string")))
    files.write_curated(made, str(tmp_path / "kept"), str(tmp_path / "gone"), str(tmp_path / "report"))
    kept = json_lines(tmp_path / "kept")
    assert len(kept) == 2 and all(set(r) == {"text", "label", "source", "sourceLabel", "language"} for r in kept) and not any("{{" in r["text"] for r in kept)
    assert json_lines(tmp_path / "gone") == [{"text": "short", "label": "x", "source": "s", "language": "en", "reason": "too-short"}]
    assert json_lines(tmp_path / "report") == [{"source": "s", "reason": "kept", "n": 1, "rehydrated": 0}, {"source": "s", "reason": "too-short", "n": 1, "rehydrated": 0}, {"source": "t", "reason": "kept", "n": 1, "rehydrated": 1}]
    files.write_metrics({"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([("l", 0.5)], "label string, accuracy double")}, str(tmp_path / "metrics"))
    assert sorted(json_lines(tmp_path / "metrics"), key=str) == [{"kind": "a", "x": 1}, {"kind": "b", "label": "l", "accuracy": 0.5}]
    assert files.folder_bytes(spark, str(tmp_path / "gone")) > 50
