"""What the findings of the third round were about: rows beyond the small tables, and odd ones."""

import datetime
import unicodedata

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import redaction
from textloom.plans import catalog


def same_as_sql(spark, name, folder, **tables):
    """The rows of a query over tables written to the folder, which are those of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, str(folder))
    cur = con.execute(catalog.ORACLE_SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    key = lambda r: [(x is not None, x) for x in r]
    got = sorted(map(tuple, df.collect()), key=key)
    assert got == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=key)
    return got


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_intervals_of_odd_rows(spark, tmp_path, zone):
    t = lambda *x: datetime.datetime(*x)
    rows = [
        (1, t(2024, 1, 2, 3, 59, 59, 999999), 1, "view"), (2, t(2024, 1, 2, 8), 1, "click"), (3, t(2024, 1, 9), 1, "signup"), (4, None, 1, "purchase"), (5, None, 2, "error"),
        (6, t(2023, 12, 31, 22, 30), 3, "view"), (7, t(2023, 12, 31, 23, 59, 59), 3, "error"), (8, t(2022, 11, 30, 0, 10), 3, None), (None, t(2024, 1, 1), 3, "click"), (9, t(2024, 1, 1), None, "view"), (11, t(2024, 1, 3), 4, None),
    ]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = same_as_sql(spark, "interval_merge", tmp_path, events=events)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (1, 192, 196, "purchase") in got and (3, -2, 7, "click") in got


def test_luhn_of_long_keys(spark, tmp_path):
    keys = [0, 18, 99_999, 100_000, 100_008, 899_999, 123_456_789_012, -18, -59, None]
    got = same_as_sql(spark, "luhn_valid", tmp_path, customer=spark.createDataFrame([(k,) for k in keys], "c_custkey long"))
    assert (100_000, True) in got and (100_008, False) in got
    assert not spark.range(1).select(X.luhn(F.lit("100000")).alias("v")).first().v


def test_ngrams_in_slices(spark):
    texts = [None if i % 97 == 5 else f"code {i} " * (i % 7) for i in range(2 * X.SLICE + 10)]
    made = list(X.hashed_ngrams.func(iter([pa.array(texts), pa.array([], pa.string()), pa.array(texts[:3])])))
    assert [len(m) for m in made] == [X.SLICE, X.SLICE, 10, 3]
    plain = [None if t is None else list(X.ngram_vector(t, (False, "code" in t, False))) for t in texts]
    assert [v for m in made for v in m.to_pylist()] == plain + plain[:3]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert [r.v for r in df.select("i", X.hashed_ngrams("t").alias("v")).orderBy("i").collect()] == plain


def test_redaction_in_slices(spark):
    texts = [None if i % 89 == 7 else "mail a@example.com " * (i % 4) for i in range(X.SLICE + 20)]
    made = list(redaction.sanitizer().func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert [len(m) for m in made] == [X.SLICE, 20]
    rows = [r for m in made for r in m.to_pylist()]
    assert [r["text"] for r in rows] == [t if t is None else t.replace("a@example.com", "{{EMAIL}}") for t in texts]
    assert [None if r["spans"] is None else [(s["token"], s["start"], s["end"]) for s in r["spans"]] for r in rows] == [None if t is None else redaction.merge_spans(redaction.spans_of(t)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = [r.r for r in df.select("i", redaction.sanitizer()("t").alias("r")).orderBy("i").collect()]
    assert [(r.text, r.spans and [s.token for s in r.spans]) for r in got] == [(r["text"], r["spans"] and [s["token"] for s in r["spans"]]) for r in rows]


def test_normal_forms_are_sought_once(spark):
    texts = ["", "plain", "plain\n", "é\n", "é\n", "ﬁ\n", "x ", "漢字 ", "漢" * 5000 + "²", "K", "\U0001f600 ﬁ", "à" * 3000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for form, column in (("NFC", X.nfc(F.col("t"))), ("NFKC", X._normal(F.col("t"), X._SOME_COMPATIBLE, X._COMPATIBLE, X._nfkc))):
        made = df.select("i", column.alias("v"))
        assert [r.v for r in made.orderBy("i").collect()] == [t if t is None else unicodedata.normalize(form, t) for t in texts]
        assert made._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 2
    # no step of the signatures looks through texts for any of many ranges, which took three quarters of the time of reason_counts
    assert "[^" + X._COMPATIBLE not in df.select(X.template_signature(F.col("t")))._jdf.queryExecution().analyzed().toString()
