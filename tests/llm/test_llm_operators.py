import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_brute import components, decontaminated, hashes, line_deduped, near_groups, prose, toxic_probability
from pyspark.sql import functions as F

from textloom.llm import common, cotrain, decontaminate, knn, linededup, lm, packing, simhash, substrings, tokenids, toxicity
from textloom.llm.textbytes import raw, string_array, words

SCHEMA = "doc_id long, text string"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)


# 1 co-training


def labelled(spark, seed=3, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, 60) if good else " ".join([rng.choice(["buy", "cheap", "now!!", "CLICK"])] * 3 + ["###"] * 5) * 10
        rows.append((i, text, "en", "web", int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, good int")
    return df, df.where("doc_id < 120").select("doc_id", F.col("good").alias("quality"))


def test_cotrain_learns(spark):
    df, labels = labelled(spark)
    made = cotrain.score(df, cotrain.fit(df, labels, grow=40)).where("doc_id >= 120")
    assert made.where("keep = (good = 1)").count() / made.count() > 0.97
    again = cotrain.score(df, cotrain.fit(df, labels, grow=40)).where("doc_id >= 120")
    assert sorted(map(tuple, made.select("doc_id", "quality").collect())) == sorted(map(tuple, again.select("doc_id", "quality").collect()))


def test_cotrain_odd_input(spark, messy):
    df, labels = labelled(spark)
    model = cotrain.fit(df, labels)
    out = cotrain.score(messy, model)
    assert out.count() == messy.count() and out.where("quality is null or keep is null").count() == 0
    assert set(out.columns) == set(messy.columns) | {"p_content", "p_meta", "quality", "keep"}
    ones = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert cotrain.fit(messy, ones) is None
    assert cotrain.score(messy, None).where("keep").count() == messy.count()
    assert cotrain.score(messy.limit(0), model).count() == 0 and cotrain.fit(messy.limit(0), labels) is None
    assert cotrain.score(messy.select("doc_id", "text"), model).count() == messy.count()
    mixed = spark.createDataFrame([(8, 1), (9, 0), (10, 1), (11, 0), (5, 1)], "doc_id long, quality int")
    assert cotrain.score(messy, cotrain.fit(messy, mixed)).count() == messy.count()


# 2 decontamination


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["Aa", "bb.", "c-c", "dé", "—", "ee"]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (3, 6, 9, 20, 30)] + ["", None]
    texts = []
    for _ in range(60):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))
        it = rng.choice(items[:5]).split(" ")
        i = rng.randint(0, len(it))
        texts.append(t + rng.choice([" ", "\n"]) + " ".join(it[i:]) + "  " + t[:10])
    texts += [None, "", items[3], items[4] + "\n"]
    bench = spark.createDataFrame([(t,) for t in items + items[:2]], "text string")
    for group_words in (500_000, 10):
        got = {r.doc_id: (r.text, r.n_words, r.removed_words) for r in decontaminate.decontaminate(docs_of(spark, texts), bench, group_words=group_words).collect()}
        assert got == {i: decontaminated(t, items) for i, t in enumerate(texts)}


def test_decontaminate_odd_input(spark, messy):
    bench = messy.where("doc_id between 8 and 10").select("text")
    out = decontaminate.decontaminate(messy, bench)
    assert out.count() == messy.count()
    assert {r.doc_id for r in out.where("removed_words > 0").collect()} >= {8, 9, 10}
    assert out.where("doc_id is null and n_words = 0").first().text is None
    assert decontaminate.decontaminate(messy, bench.limit(0)).where("removed_words > 0").count() == 0
    assert decontaminate.decontaminate(messy.limit(0), bench).count() == 0


# 3 substrings


def test_compact_windows_hold_every_minimum():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 30, 30, 34, 60])
    order = rng.permutation(60).astype(np.uint64) << np.uint64(30) | np.arange(60, dtype=np.uint64)
    for least in (1, 5, 26):
        found = {c: (l, r) for c, l, r in zip(*(x.tolist() for x in substrings.compact_windows(order, bounds, least)))}
        for a, b in zip(bounds[:-1], bounds[1:]):
            for i in range(a, b):
                for j in range(i + least - 1, b):
                    c = i + int(np.argmin(order[i : j + 1]))
                    l, r = found[c]
                    assert a <= l <= i and j <= r < b and int(np.argmin(order[l : r + 1])) + l == c


def planted(seed, n=60):
    rng = random.Random(seed)
    shared = [prose(rng, 70).split(" ") for _ in range(6)]
    texts = []
    for k in range(n):
        body = prose(rng, rng.randint(20, 120)).split(" ")
        if k % 2:
            p = list(rng.choice(shared))
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p))] = "changed"
            i = rng.randint(0, len(body))
            body[i:i] = p
        texts.append(" ".join(body))
    return texts + [texts[1], texts[1], prose(rng, 10), prose(rng, 10), "", None]


def plain_words(text):
    return [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in (text or "").split()) if w]


def common_run(a, b):
    """The longest run of words in both, and where it is in a."""
    best, before = (0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = before[j] + 1
                best = max(best, (now[j + 1], i + 1))
        before = now
    return best[0], best[1] - best[0]


@pytest.mark.parametrize("how", [{}, {"tile_rows": 3}, {"often": 1}])
def test_substrings_against_brute_force(spark, how):
    texts = planted(5)
    got = substrings.repeats(docs_of(spark, texts), **how).collect()
    where = {}
    for r in got:
        where.setdefault(r.doc_id, []).append(r)
    ws = [plain_words(t) for t in texts]
    exact, linked = set(), {i: set() for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(len(texts)):
            n, at = common_run(ws[i], ws[j]) if i != j else (0, 0)
            if n >= 45:  # every exact passage is listed whole, and in one class on either side
                exact.add((i, j))
                linked[i].add(texts[j])
                mine = [r for r in where[i] if r.start_word <= at and at + n <= r.end_word]
                assert mine and {r.class_id for r in mine} & {r.class_id for r in where[j]}
    assert len(exact) > 60
    for i, rows in where.items():  # and what is listed has much in common with another text of its class
        for r in rows:
            part = ws[i][r.start_word : r.end_word]
            assert len(part) >= 45 and r.n_copies == sum(texts[i] == t for t in texts) - 1
            grams = {tuple(part[k : k + 5]) for k in range(len(part) - 4)}
            others = [j for j in where if j != i and any(x.class_id == r.class_id for x in where[j])]
            assert max(len(grams & {tuple(ws[j][k : k + 5]) for k in range(len(ws[j]) - 4)}) for j in others) >= 0.55 * 41
            assert r.n_links <= len(set(texts)) and r.class_id <= i
    # of the copies of one passage with up to two words changed all are found
    assert {i for i in range(1, 60, 2)} <= set(where) and not set(where) & {i for i in range(0, 60, 2)}
    assert len(got) == len({(r.doc_id, r.start_word) for r in got})


def test_substrings_hot_passage(spark):
    """One passage in 30 texts, twice in some, amid texts that share a short sentence only, and a text that occurs 40 times."""
    rng = random.Random(4)
    shared, short = prose(rng, 60), prose(rng, 20)
    texts = [f"{prose(rng, 50)} {shared} {prose(rng, 30)}" + (f" {shared}" if k % 3 == 0 else "") for k in range(30)]
    texts += [f"{prose(rng, 60)} {short} {prose(rng, 60)}" for _ in range(40)]
    texts += [prose(rng, 90)] * 40
    for how in ({}, {"tile_rows": 8}, {"often": 2}):
        got = substrings.repeats(docs_of(spark, texts), **how).collect()
        assert sorted(r.doc_id for r in got) == sorted([*range(30), *range(0, 30, 3), *range(70, 110)])
        assert {(r.class_id, r.n_links, r.n_copies) for r in got} == {(0, 29, 0), (70, 0, 39)}
        assert all(r.start_word <= 50 and r.end_word >= 110 or r.start_word <= 140 and r.end_word >= 200 for r in got if r.doc_id < 30)


def test_agreement_against_loops():
    rng = np.random.default_rng(2)
    least, share = 41, 0.6

    def plain(a, b):
        """Shingles of a in runs of three that b has within eight places, then the stretches that are dense enough."""
        n = len(a)
        hit = np.zeros(n, bool)
        for i in range(n - 2):
            for j in range(max(0, i - 8), min(n - 2, i + 9)):
                if (a[i : i + 3] == b[j : j + 3]).all() and a[i : i + 3].all():
                    hit[i : i + 3] = True
        found = [(x, y) for x in range(n) for y in range(x + least - 1, n) if hit[x] and hit[y] and hit[x : y + 1].sum() >= share * (y - x + 1) - 1e-9]
        return (min(x for x, _ in found), max(y for _, y in found)) if found else None

    a = rng.integers(1, 255, (120, 81)).astype(np.uint8)
    b = rng.integers(1, 255, (120, 81)).astype(np.uint8)
    for k in range(120):
        lo, hi = rng.integers(0, 40), rng.integers(40, 81)
        b[k, lo:hi] = a[k, lo:hi]
        for _ in range(rng.integers(0, 5)):
            i = rng.integers(0, 76)
            b[k, i : i + 5] = rng.integers(1, 255, 5)
        if k % 4 == 0:
            b[k, 45:] = b[k, 43:-2]
        if k % 7 == 0:
            b[k, 70:] = 0
    linked, *ends = substrings.agreement(substrings._grams(a), substrings._grams(b), least, share)
    assert 20 < linked.sum() < 110
    for k in range(120):
        x, y = plain(a[k], b[k]), plain(b[k], a[k])
        assert linked[k] == bool(x and y)
        if linked[k]:
            assert (ends[0][k], ends[1][k]) == x and (ends[2][k], ends[3][k]) == y


def test_hits_in_one_pass_a_shift():
    """The grams in common are those of a comparison row by row, in much less time."""

    def plain(a, b):
        n = a.shape[1]
        hit_a, hit_b = np.zeros(a.shape, bool), np.zeros(a.shape, bool)
        for s in range(-substrings.SHIFT, substrings.SHIFT + 1):
            x, y = slice(max(0, s), n + min(0, s)), slice(max(0, -s), n - max(0, s))
            same = (a[:, x] == b[:, y]) & (a[:, x] > 0)
            hit_a[:, x] |= same
            hit_b[:, y] |= same
        return hit_a, hit_b

    def seconds(f, *x):
        began = time.perf_counter()
        f(*x)
        return time.perf_counter() - began

    rng = np.random.default_rng(6)
    for most in (2, 9, 1 << 24):
        a, b = (rng.integers(0, most, (8192, 79)).astype(np.uint32) for _ in range(2))
        b[:4000, 5:] = a[:4000, :-5]
        for k in (0, 1, 1023, 1025, 8192):
            for x, y in zip(substrings._hits(a[:k], b[:k]), plain(a[:k], b[:k]), strict=True):
                assert np.array_equal(x, y)
    parts = lambda f: min(seconds(f, a, b) for _ in range(5))
    assert parts(substrings._hits) < 0.7 * parts(plain)


def test_substrings_odd_input(spark, messy):
    got = substrings.repeats(messy).collect()
    assert {r.doc_id for r in got} == {5, 6} and all(r.class_id == 5 and r.n_copies == 1 and r.n_links == 0 and (r.start_word, r.end_word) == (0, 60_000) for r in got) and len(got) == 2
    assert substrings.repeats(messy.limit(0)).count() == 0


# 4 line dedup


def lines(seed, n=40):
    rng = random.Random(seed)
    pool = ["Home | About", " Home | About\t", "All rights reserved", "one", "", "  ", "café", "x" * 300]
    return ["\n".join(rng.choice(pool + [f"own {k} {i}" for i in range(6)]) for _ in range(rng.randint(0, 8))) for k in range(n)] + [None, "", "\n", "one\none\none\none\none"]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_line_dedup_against_brute_force(spark, broadcast_bytes):
    rows = list(enumerate(lines(2)))
    got = sorted(map(tuple, linededup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), broadcast_bytes=broadcast_bytes, shards=3).collect()), key=lambda r: r[0])
    assert got == line_deduped(rows)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_line_dedup_odd_input(spark, messy, broadcast_bytes):
    out = linededup.dedup(messy, broadcast_bytes=broadcast_bytes)
    assert out.count() == messy.count() and set(out.columns) == set(messy.columns) | {"n_lines", "n_removed"}
    assert sorted(map(str, [tuple(r) for r in out.select("doc_id", "text").collect()])) == sorted(str(r[:2]) for r in line_deduped([tuple(r) for r in messy.select("doc_id", "text").collect()]))
    assert linededup.dedup(messy.limit(0), broadcast_bytes=broadcast_bytes).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    made = linededup.PerfectHash.build(keys)
    assert sorted(made.index(keys)) == list(range(len(keys)))


# 5 language model


def brute_lm(rows, weights, size):
    seqs = [[None, *hashes(t)] for _, t in rows]
    uni, ctx, bi = Counter(), Counter(), Counter()
    for s in seqs:
        uni.update(s[1:])
        ctx.update(s[:-1])
        bi.update(zip(s[:-1], s[1:]))
    total = sum(uni.values())
    out = []
    for (d, _), s in zip(rows, seqs):
        logp = 0.0
        for v, w in zip(s[:-1], s[1:]):
            c = ctx[v] - 1
            b = min(int(math.log2(c)) + 1 if c > 0 else 0, lm.BUCKETS - 1)
            p = weights[b][0] * ((bi[v, w] - 1) / c if c else 0) + weights[b][1] * (uni[w] - 1) / (total - 1) + weights[b][2] / (size + 1)
            logp += math.log(p)
        out.append((d, len(s) - 1, logp))
    return out


def test_lm_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(150)] + ["", None, "word", "Word word."]
    texts += texts[:3]
    rows, seen = list(enumerate(texts)), {}
    original = lm._weights
    monkeypatch.setattr(lm, "_weights", lambda cells, size: seen.setdefault((len(seen), size), original(cells, size)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    a = {r.doc_id: r for r in lm.score(df, shards=3).collect()}
    b = {r.doc_id: r for r in lm.score(df, broadcast_words=0).collect()}
    (_, size), weights = next(iter(seen.items()))
    assert np.allclose(weights, list(seen.values())[1]) and np.allclose(weights.sum(axis=1), 1)
    for d, n, logp in brute_lm(rows, weights, size):
        for r in (a[d], b[d]):
            assert r.n_words == n and abs(r.log_prob - logp) < 1e-3 + 1e-6 * abs(logp)
            assert (r.perplexity is None) == (n == 0)


def test_lm_sends_only_frequent_words(spark, monkeypatch):
    """With a vocabulary over what is sent, pairs of words that are sent don't become rows, and scores stay the same."""
    rng = random.Random(18)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(1, 60))) for _ in range(200)] + ["", None, "once", "once more"]
    df = spark.createDataFrame(list(enumerate(texts + texts[:20])), SCHEMA).repartition(3)
    seen, original = {}, lm._rare
    monkeypatch.setattr(lm, "_rare", lambda *a: seen.setdefault(len(seen), original(*a)))
    want = {r.doc_id: r for r in lm.score(df).collect()}
    assert not seen  # of words that occur once nothing is sent or joined
    n_words = sum(r.n_words for r in want.values())
    for most in (0, 5, 100):
        got = {r.doc_id: r for r in lm.score(df, broadcast_words=most).collect()}
        assert got.keys() == want.keys()
        for d, r in got.items():
            assert r.n_words == want[d].n_words and abs(r.log_prob - want[d].log_prob) < 1e-6 and (r.perplexity is None) == (want[d].perplexity is None)
    rows = [pairs.agg({"k": "sum"}).first()[0] for pairs, _ in seen.values()]
    assert rows[0] == n_words and rows[1] < 0.9 * n_words and rows[2] < 0.6 * n_words


def test_weights_raise_held_out_likelihood():
    rng = np.random.default_rng(0)
    b, p2, p1, n = rng.integers(0, 4, 200), rng.random(200), rng.random(200) * 0.01, rng.integers(1, 9, 200)
    p2[b == 0] = 0
    w = lm.learn(b, p2, p1, 1e-4, n)
    like = lambda w: (n * np.log(w[b, 0] * p2 + w[b, 1] * p1 + w[b, 2] * 1e-4)).sum()
    for other in ([0.4, 0.5, 0.1], [0.9, 0.05, 0.05], [0.2, 0.7, 0.1]):
        assert like(w) >= like(np.tile(other, (lm.BUCKETS, 1))) - 1e-6


def test_lm_odd_input(spark, messy):
    for most in (8_000_000, 0):
        out = lm.score(messy, broadcast_words=most)
        assert out.count() == messy.count()
        assert {r.n_words for r in out.where("doc_id in (0, 1, 2, 4)").collect()} == {0}
    assert lm.score(messy.limit(0)).count() == 0
    assert lm.score(messy.where("doc_id < 3")).where("log_prob = 0").count() == 3


# 6 SimHash


@pytest.mark.parametrize("band_rows", [131_072, 20])
def test_simhash_against_brute_force(spark, band_rows):
    rng = random.Random(9)
    base = [prose(rng, 80) for _ in range(25)]
    texts = base + [t + " extra" for t in base[:10]] + base[:5] + ["", None, "..."] + [prose(rng, 5) for _ in range(10)]
    root = near_groups(texts, simhash.RADIUS)
    got = {r.doc_id: (r.group_id, r.keep) for r in simhash.groups(docs_of(spark, texts), band_rows=band_rows).collect()}
    assert got == {i: (root[i], root[i] == i) for i in range(len(texts))}
    assert sorted(r.doc_id for r in simhash.deduplicated(docs_of(spark, texts)).collect()) == sorted(set(root))


@pytest.mark.parametrize("radius", [0, 3, 22, 40])
def test_indexed_pairs_are_all_pairs(radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    near = np.repeat(f[:100], 6, axis=0)
    for _ in range(radius):
        near[np.arange(600), rng.integers(0, 2, 600)] ^= np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)
    f = np.concatenate((f, near, np.zeros((40, 2), np.uint64) | np.arange(40, dtype=np.uint64)[:, None]))
    f = np.unique(f[np.argsort(np.bitwise_count(f).sum(axis=1), kind="stable")], axis=0)
    f = f[np.argsort(np.bitwise_count(f).sum(axis=1), kind="stable")]
    listed = lambda found: sorted(x for p, q in found for x in zip(p.tolist(), q.tolist(), strict=True))
    for a, b, same in ((f, f, True), (f[:400], f[400:], False)):
        apart = np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2)
        want = [(p, q) for p, q in zip(*(x.tolist() for x in np.nonzero(apart <= radius)), strict=True) if p < q or not same]
        assert listed(simhash.close_pairs(a, b, radius, same)) == want
        for m in (7, 8, 12):
            assert listed(simhash.indexed_pairs(a, b, radius, same, m, most=1000)) == want


def test_many_fingerprints_are_not_all_compared():
    """Of evenly spread fingerprints the index meets a small part, and is taken; where all agree in most bits, tiles are."""
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, (60_000, 2), dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, (60_000, 2), dtype=np.uint64)
    assert simhash._cheapest(f, f, simhash.RADIUS, True) > 0
    assert simhash._cheapest(f & np.uint64(0xFF), f & np.uint64(0xFF), simhash.RADIUS, True) == 0


def test_star_contraction_equals_the_driver(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, two = (sorted(map(tuple, common.components(df, on_driver=n).collect())) for n in (10**6, 0))
    assert one == two


def test_simhash_odd_input(spark, messy):
    out = simhash.groups(messy)
    assert out.count() == messy.count() and out.where("keep").count() == out.where("keep").select("doc_id", "text_hash").count()
    kept = simhash.deduplicated(messy)
    assert kept.columns == messy.columns and kept.where("doc_id in (5, 6)").count() == 1
    assert kept.where("doc_id in (0, 1, 2, 4)").count() == 4 and simhash.groups(messy.limit(0)).count() == 0


# 7 toxicity


def toxic_corpus(seed=4, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = [prose(rng, 8).replace(".", "").replace("\n", " ") for _ in range(rng.randint(1, 12))]
        bad = rng.random() < 0.2
        if bad:
            s[rng.randrange(len(s))] += " vile " + rng.choice(["scumbag", "filth"])
        rows.append((i, ". ".join(s) + ".", int(bad)))
    return rows


def test_toxicity_finds_documents_and_sentences(spark):
    rows = toxic_corpus()
    df = spark.createDataFrame(rows, SCHEMA + ", bad int")
    model = toxicity.fit(df, df.where("doc_id < 250").select("doc_id", F.col("bad").alias("toxic")))
    got = toxicity.score(df, model).collect()
    assert np.mean([r.toxic == (r.bad == 1) for r in got if r.doc_id >= 250]) > 0.97
    for r in got:
        p, n = toxic_probability(r.text, model)
        assert abs(p - r.p_toxic) < 1e-9 and n == r.n_sentences
        if r.toxic and r.bad:
            assert any("vile" in r.text[s.start : s.end] for s in r.offending)
            assert all("vile" in r.text[s.start : s.end] for s in r.offending if s.p > 0.9)


def test_toxicity_odd_input(spark, messy):
    df = spark.createDataFrame(toxic_corpus(), SCHEMA + ", bad int")
    model = toxicity.fit(df, df.select("doc_id", F.col("bad").alias("toxic")))
    out = toxicity.score(messy, model)
    assert out.count() == messy.count() and out.where("doc_id in (0, 1, 2, 4) and (toxic or n_sentences > 0)").count() == 0
    assert toxicity.fit(messy, spark.createDataFrame([(None, 1), (8, None), (9, 0)], "doc_id long, toxic int")) is None
    assert toxicity.score(messy, None).where("toxic").count() == 0 and toxicity.score(messy.limit(0), model).count() == 0
    assert toxicity.fit(messy.limit(0), messy.limit(0).select("doc_id", F.lit(1).alias("toxic"))) is None


# 8 token ids


def test_token_ids_round_trip(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(0, 200)) for _ in range(40)] + ["", None, "  two  spaces\n\n\ttab", "it's I'll 3,000.50 naïve 你好 😀 x", "\0zero", " ", "a\r\nb", "<|endoftext|>"]
    rows = tokenids.encode(docs_of(spark, texts), shard_ids=500).collect()
    enc, seen = tokenids.encoding(tokenids.VOCABULARY), {}
    for r in rows:
        reader = tokenids.ShardReader(r)
        assert len(reader) == r.n_docs
        for i, d in enumerate(reader.doc_ids):
            seen[d] = reader[i].tolist()
    assert len(rows) >= 3 and set(seen) == set(range(len(texts)))
    for d, ids in seen.items():
        assert ids == enc.encode(texts[d] or "", disallowed_special=()) and enc.decode(ids) == (texts[d] or "")


def test_elias_fano():
    rng = np.random.default_rng(2)
    for values in ([], [0], [0, 0, 0], [5], np.sort(rng.integers(0, 10**9, 3000)), np.repeat([7, 8], 700)):
        ef = tokenids.EliasFano.build(np.array(values, np.int64))
        assert [ef.select(i) for i in range(len(values))] == list(values) == ef.all().tolist()
    big = np.sort(rng.integers(0, 10**9, 3000))
    ef = tokenids.EliasFano.build(big)
    size = len(ef.low) + ef.high.nbytes + ef.samples.nbytes
    assert size * 8 / 3000 < 2.5 + np.log2(1e9 / 3000)
    with pytest.raises(IndexError):
        ef.select(3000)


def test_token_ids_odd_input(spark, messy):
    rows = tokenids.encode(messy).collect()
    assert sum(r.n_docs for r in rows) == messy.count() and sum(r.doc_ids.count(None) for r in rows) == 2
    assert tokenids.encode(messy.limit(0)).count() == 0


# 9 nearest neighbours


def brute_knn(rows, k):
    out = []
    for i, v in rows:
        d = sorted((math.dist(v, w), j) for j, w in rows if j != i)[:k]
        out += [(i, j, r + 1) for r, (_, j) in enumerate(d)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"pivots": 1}, {"pivots": 25, "group_queries": 7, "block_rows": 11}])
@pytest.mark.parametrize("offset", [0, 1e6])
def test_knn_against_brute_force(spark, how, offset):
    """Clusters, ties and, with an offset, vectors that differ little against their lengths."""
    rng = np.random.default_rng(1)
    v = np.concatenate((rng.integers(0, 4, (120, 3)), rng.normal(size=(80, 3)) * (5 if not offset else 0.01) + 20)) + offset
    v = v.astype(np.float32 if not offset else float)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{'double' if offset else 'float'}>").repartition(3)
    plain = brute_knn(rows, 7)
    assert sorted((r.vec_id, r.neighbor_id, r["rank"]) for r in knn.knn_join(df, k=7, **how).collect()) == plain
    some = knn.knn_join(df, df.where("vec_id % 10 = 0"), k=7, **how).collect()
    assert sorted((r.vec_id, r.neighbor_id, r["rank"]) for r in some) == [r for r in plain if r[0] % 10 == 0]


def test_knn_prunes_clusters(spark):
    """Few vectors are sent to a group of queries that is far from them, and the answers stay exact."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 16)) * 100
    v = np.concatenate([c + rng.normal(size=(60, 16)) for c in centers])
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(3)
    made = knn.knn_join(df, k=4, pivots=40, group_queries=60)
    assert sorted((r.vec_id, r.neighbor_id, r["rank"]) for r in made.collect()) == brute_knn(rows, 4) and made.schema["vec_id"].dataType.simpleString() == "int"


def test_knn_odd_input(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.5]), (3, None), (None, [0.0, 0.0]), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 0.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cell": F.lit(1), "id": F.lit("x"), "rank": F.lit(0)})
    got = sorted((r.vec_id, r.neighbor_id) for r in knn.knn_join(df, k=5).collect())
    assert got == [(1, 2), (1, 2), (2, 1), (2, 1)]
    assert knn.knn_join(df.limit(0)).count() == 0 and knn.knn_join(df.where("vec_id = 3")).count() == 0 and knn.knn_join(df, df.limit(0)).count() == 0
    far = df.union(spark.createDataFrame([(8, [float("inf"), 0.0]), (9, [0.0, float("-inf")])], "vec_id long, embedding array<float>").withColumns({"cell": F.lit(1), "id": F.lit("x"), "rank": F.lit(0)}))
    assert sorted((r.vec_id, r.neighbor_id) for r in knn.knn_join(far, k=5).collect()) == got
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    assert [(r.neighbor_id, r.distance) for r in knn.knn_join(same, same.where("vec_id = 7"), k=3, block_rows=20, group_queries=5).orderBy("rank").collect()] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    with pytest.raises(ValueError):
        knn.knn_join(df.withColumn("vec_id", F.lit("x")))


# 10 packing


def check_packed(rows, lengths, window):
    """Every word once, nothing beyond a window, no two pieces in one place."""
    used = {}
    for r in rows:
        used.setdefault(r.pack_id, []).append((r.pack_offset, r.pack_offset + r.n_words))
        assert r.start_word == r.piece * window
    for spans in used.values():
        spans.sort()
        assert spans[-1][1] <= window and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    words_of = Counter()
    for r in rows:
        words_of[r.doc_id] += r.n_words
    assert words_of == Counter({d: n for d, n in lengths.items() if n})
    return len(used)


def test_packing(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.choice([3, 20, 31, 64, 100, 150, 256, 300])) for _ in range(300)] + ["", None, " "]
    rows = packing.pack(docs_of(spark, texts), window=256, granule=16).collect()
    lengths = {i: len((t or "").split()) for i, t in enumerate(texts)}
    n = check_packed(rows, lengths, 256)
    assert n <= 1.1 * sum(-(-min(256, k - p) // 16) * 16 for k in lengths.values() for p in range(0, k, 256)) / 256 + 2
    assert sorted({r.pack_id for r in rows}) == list(range(n))


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(0)
    for _ in range(10):
        a, b = rng.random((8, 14)), rng.random(8) * 10
        x, y = packing.nnls(a, b), np.zeros(14)
        step = 1 / np.linalg.norm(a.T @ a, 2)
        for _ in range(20_000):
            y = np.maximum(0, y - step * a.T @ (a @ y - b))
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


def test_plan_uses_the_histogram_up():
    rng = np.random.default_rng(3)
    for _ in range(20):
        h = rng.integers(0, 50, 16)
        made = packing.plan(h)
        used = np.zeros(16, int)
        for combo, n in made:
            assert sum(combo) <= 16 and n > 0
            for b in combo:
                used[b - 1] += n
        assert used.tolist() == h.tolist()


def test_packing_odd_input(spark, messy):
    rows = packing.pack(messy).collect()
    assert sum(r.n_words for r in rows if r.doc_id == 5) == 120_000 and any(r.doc_id is None for r in rows)
    assert packing.pack(messy.limit(0)).count() == 0


# what they share


def test_words_of_bytes():
    h, starts, ends, rows, data = words(pa.array(["Ab, c!", "", "AB C", "..."]))
    assert len(h) == 4 and h[0] == h[2] and h[1] == h[3] and rows.tolist() == [0, 2, 2, 4, 4]
    assert raw(pa.array([], pa.string()))[1].tolist() == [0]
