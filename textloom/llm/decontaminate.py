"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import extended, fresh, need, readable
from .textbytes import ALNUM, U64, WS, HashSet, mix, raw, runs, slices, span_hash, string_array

_PAIR = U64(0x9FB21C651E98DF25)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Automaton:
    """Suffix automaton of several token sequences. ``limit[v]`` is the match length in state v from which a span goes; ``above[v]`` the length of the longest shorter suffix that goes by itself."""

    def __init__(self, items: list[tuple[list[int], int]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        for tokens, _ in items:
            last = 0
            for t in tokens:
                last = self._extend(last, t)
        limit = [1 << 30] * len(self.next)
        for tokens, least in items:
            v = 0
            for t in tokens:
                v = self.next[v][t]
                limit[v] = min(limit[v], least)
        order = sorted(range(1, len(limit)), key=self.length.__getitem__)
        for v in reversed(order):
            limit[self.link[v]] = min(limit[self.link[v]], limit[v])
        above = [0] * len(limit)
        for v in order:
            up = self.link[v]
            above[v] = self.length[up] if up > 0 and self.length[up] >= limit[up] else above[max(up, 0)]
        self.limit, self.above = limit, above

    def _extend(self, p: int, t: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[p].get(t)) is not None:
            return q if length[q] == length[p] + 1 else self._clone(p, q, t)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and t not in nxt[p]:
            nxt[p][t] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][t]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, t)
        return cur

    def _clone(self, p: int, q: int, t: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(t) == q:
            nxt[p][t] = c
            p = link[p]
        return c

    def spans(self, tokens: list[int]) -> list[tuple[int, int]]:
        """Merged spans of tokens to remove: the stream's longest matches that reach their limit."""
        v, l, out = 0, 0, []
        nxt, link, length, limit, above = self.next, self.link, self.length, self.limit, self.above
        for i, t in enumerate(tokens):
            while v and t not in nxt[v]:
                v = link[v]
                l = length[v]
            v = nxt[v].get(t, 0)
            l = l + 1 if v else 0
            m = l if l >= limit[v] else above[v]
            if m and v:
                start = i + 1 - m
                while out and out[-1][1] >= start:
                    start = min(start, out.pop()[0])
                out.append((start, i + 1))
        return out


def tokens_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word in lower case without signs, 0 where nothing is left; word starts and ends in bytes of ``a``; first word of each row and the end)."""
    data, off = raw(a)
    starts, ends = runs(~WS[data], off)
    rows = np.searchsorted(starts, off)
    plain = a
    if (data >= 128).any():
        plain = pc.replace_substring_regex(pc.utf8_lower(a), pattern=r"[^\x00-\x7F\pL\pN]", replacement="\x01")
        low, low_off = raw(plain)
        s, e = runs(~WS[low], low_off)
        if len(s) != len(starts):  # should lower case ever move a word's bounds: word by word
            view = data.tobytes()
            plain = pc.replace_substring_regex(pc.utf8_lower(pa.array([view[x:y].decode(errors="replace") for x, y in zip(starts, ends, strict=True)], pa.string())), pattern=r"[^\x00-\x7F\pL\pN]", replacement="\x01")
            low, edges = raw(plain)
            s, e = edges[:-1], edges[1:]
    else:
        low, s, e = raw(pc.ascii_lower(a))[0], starts, ends
    h, n = span_hash(low, s, e, ALNUM[low])
    h |= U64(1)
    h[n == 0] = 0
    return h, starts, ends, rows


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _PAIR + h[1:]) if len(h) else h


class Detector:
    """What workers need of some test items: vocabulary, known pairs of words, and the automaton."""

    def __init__(self, items: list[np.ndarray], min_length: int, coverage: float, floor: int):
        self.vocabulary = HashSet(np.concatenate(items) if items else np.zeros(0, np.uint64))
        self.pairs = HashSet(np.concatenate([_pairs(x) for x in items]) if items else np.zeros(0, np.uint64))
        limits = [limit(len(x), min_length, coverage, floor) for x in items]
        self.least = min(limits, default=1 << 30)
        self.automaton = Automaton([(self.vocabulary.find(x).tolist(), n) for x, n in zip(items, limits, strict=True)])

    def spans(self, h: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        """Spans of the words h to remove. A stretch whose neighbours all are pairs of a test item is streamed through the automaton; outside such stretches no match has two words."""
        if len(h) < self.least or not len(self.vocabulary.keys):
            return
        known = self.pairs.find(_pairs(h)) >= 0
        inner = rows[1:-1]
        known[inner[(inner > 0) & (inner < len(h))] - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        for i, j in zip(edge[::2], edge[1::2], strict=True):
            if j - i + 1 >= self.least:
                for s, e in self.automaton.spans(self.vocabulary.find(h[i : j + 1]).tolist()):
                    yield int(i) + s, int(i) + e


def limit(n: int, min_length: int, coverage: float, floor: int) -> int:
    """Words of a match from which it goes, for an item of n words: min_length, or less where that covers enough of the item."""
    return min(min_length, max(floor, int(np.ceil(round(coverage * n, 9)))))


def detectors(benchmark: DataFrame, min_length: int, coverage: float, floor: int, group_words: int = 500_000) -> list[Detector]:
    """Items, read in the driver a group at a time, in automata of at most so many words each (or one item)."""
    out, group, size, seen = [], [], 0, set()
    for row in readable(benchmark.select("text")).where("text is not null").distinct().toLocalIterator():
        h = tokens_of(pa.array([row.text]))[0]
        h = h[h != 0]
        if len(h) < floor or h.tobytes() in seen:
            continue
        seen.add(h.tobytes())
        if group and size + len(h) > group_words:
            out.append(Detector(group, min_length, coverage, floor))
            group, size = [], 0
        group.append(h)
        size += len(h)
    if group or not out:
        out.append(Detector(group, min_length, coverage, floor))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_length: int = 13, coverage: float = 0.8, floor: int = 5, group_words: int = 500_000) -> DataFrame:
    """docs with text less the passages of test items; n_words, removed_words and spans (word positions of what went).

    Words are runs outside ``[\\t\\n\\f\\r ]``, compared in lower case without anything but letters and digits;
    words with none of these aren't counted. A stretch of words goes if it is in an item and has
    ``min_length`` words, or covers at least ``coverage`` of the item and has ``floor`` words. A word goes with the
    white space after it; a word without letters or digits goes if both its neighbours do.

    A null text stays null; bytes that aren't UTF-8 are read as U+FFFD, here and in the items. An empty or null item, or one of under ``floor`` words, matches nothing; repeated
    items count once. Other columns pass, those named as the added ones are replaced. Every row is kept.
    Items over ``group_words`` words in all are split over several automata and passes of the same plan.
    """
    need(docs, "text")
    need(benchmark, "text")
    docs = readable(docs)
    spark = docs.sparkSession
    found = detectors(benchmark, min_length, coverage, floor, group_words)
    df, (held,) = docs, fresh(docs, "__spans")
    for g, detector in enumerate(found):
        sent = spark.sparkContext.broadcast(detector)
        last = g == len(found) - 1
        schema, kept = extended(df, **({"n_words": T.IntegerType(), "removed_words": T.IntegerType(), "spans": SPANS} if last else {held: SPANS}))
        if last:
            schema = T.StructType([f for f in schema.fields if f.name != held])
            schema["text"].nullable = True
        kept = [k for k in kept if k != held]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last, first=g == 0, kept=kept) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a = string_array(batch.column("text"))
                before = None if first else batch.column(held).to_pylist()
                for i, j in slices(a):
                    yield _one(batch, a, i, j, sent.value, before, "spans" if last else held, last, kept)

        df = df.mapInArrow(run, schema)
    return df


def _one(batch: pa.RecordBatch, a: pa.Array, i: int, j: int, detector: Detector, before: list | None, name: str, last: bool, kept: list[str]) -> pa.RecordBatch:
    part = a.slice(i, j - i)
    h, starts, ends, rows = tokens_of(part)
    solid = np.flatnonzero(h)
    first = np.searchsorted(solid, rows)  # first counted word of each row
    gone = np.zeros(len(solid) + 1, bool)
    for s, e in detector.spans(h[solid], first):
        gone[s:e] = True
    for r, spans in enumerate(before[i:j] if before else []):
        for x in spans or []:
            gone[first[r] + x["start"] : first[r] + x["end"]] = True
    n = np.diff(first)
    inner = gone[:-1]
    edge = inner.copy()
    edge[1:] &= ~inner[:-1]
    starts_row = first[:-1][n > 0]
    edge[starts_row] = inner[starts_row]
    s = np.flatnonzero(edge)
    stop = ~inner
    bounds = np.flatnonzero(stop)
    row = np.searchsorted(first, s, "right") - 1
    nxt = np.searchsorted(bounds, s)
    e = np.minimum(np.where(nxt < len(bounds), bounds[np.minimum(nxt, len(bounds) - 1)] if len(bounds) else len(inner), len(inner)), first[row + 1])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(s - first[row], pa.int32()), pa.array(e - first[row], pa.int32())], fields=list(_SPANS.value_type)))
    columns = {k: batch.column(k).slice(i, j - i) for k in kept}
    if not last:
        return pa.RecordBatch.from_arrays([*columns.values(), lists], names=[*columns, name])
    removed = np.bincount(row, e - s, j - i).astype(np.int64)
    if len(s):
        data, off = raw(part)
        whole = data.tobytes()
        texts = np.flatnonzero(removed)
        made = []
        for r in texts:
            # bytes from the start of a span's first word up to the word after its last
            keep, at = [], int(off[r])
            for k in np.flatnonzero(row == r):
                x = int(starts[solid[s[k]]])
                y = int(solid[e[k]]) if e[k] < first[r + 1] else None
                if y is None:  # up to the next word that isn't counted, or the row's end
                    y = int(solid[e[k] - 1]) + 1
                elif y > int(solid[e[k] - 1]) + 1:
                    y = int(solid[e[k] - 1]) + 1
                keep.append(whole[at:x])
                at = int(starts[y]) if y < rows[r + 1] else int(off[r + 1])
            keep.append(whole[at : int(off[r + 1])])
            made.append(b"".join(keep).decode(errors="replace"))
        choice = np.zeros(j - i, np.int64)
        choice[texts] = np.arange(len(texts))
        columns["text"] = pc.if_else(pa.array(removed > 0), pa.array(made, columns["text"].type).take(pa.array(choice)), columns["text"])
    return pa.RecordBatch.from_arrays([*columns.values(), pa.array(n, pa.int32()), pa.array(removed, pa.int32()), lists], names=[*columns, "n_words", "removed_words", "spans"])


ORACLE_SQL = r"""
WITH piece AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[^\t\n\f\r ]+[\t\n\f\r ]*')) AS p, generate_subscripts(regexp_extract_all(text, '[^\t\n\f\r ]+[\t\n\f\r ]*'), 1) AS k FROM documents
), word AS (
    SELECT doc_id, p, k, regexp_replace(lower(p), '[^\p{L}\p{N}]', '', 'g') AS w,
        sum(CASE WHEN regexp_replace(lower(p), '[^\p{L}\p{N}]', '', 'g') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS i
    FROM piece
), doc AS (SELECT doc_id, list(w ORDER BY i) AS ws FROM word WHERE w <> '' GROUP BY doc_id),
item AS (
    SELECT ws, len(ws) AS n, least(13, greatest(5, ceil(round(0.8 * len(ws), 9))))::INTEGER AS t FROM (
        SELECT list_filter(list_transform(regexp_extract_all(text, '[^\t\n\f\r ]+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '') AS ws FROM benchmark)
    WHERE len(ws) >= 5
), item_gram AS (SELECT DISTINCT t, array_to_string(ws[s : s + t - 1], ' ') AS g FROM (SELECT t, ws, unnest(range(1, n - t + 2)) AS s FROM item)),
doc_gram AS (
    SELECT doc_id, t, s, array_to_string(ws[s : s + t - 1], ' ') AS g
    FROM (SELECT doc_id, ws, t, unnest(range(1, len(ws) - t + 2)) AS s FROM doc, (SELECT DISTINCT t FROM item) WHERE len(ws) >= t)
), gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + t)) AS i FROM doc_gram JOIN item_gram USING (t, g)),
marked AS (
    SELECT word.doc_id, k, p, w, CASE WHEN w <> '' THEN a.i IS NOT NULL ELSE a.i IS NOT NULL AND b.i IS NOT NULL END AS gone
    FROM word LEFT JOIN gone a ON a.doc_id = word.doc_id AND a.i = word.i LEFT JOIN gone b ON b.doc_id = word.doc_id AND b.i = word.i + 1
)
SELECT d.doc_id, any_value(regexp_extract(d.text, '^[\t\n\f\r ]*')) || coalesce(string_agg(p, '' ORDER BY k) FILTER (WHERE NOT gone), '') AS text,
    (count(*) FILTER (WHERE w <> ''))::INTEGER AS n_words, (count(*) FILTER (WHERE w <> '' AND gone))::INTEGER AS removed_words
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""
