"""The operators again, plainly and slowly."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex

from textloom.llm.textbytes import words

WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("n", "rt", "st", "x", "lo")]
CLASH = ("shard", "h", "th", "key", "__key", "span", "node", "root", "group_id", "keep", "n_words", "spans", "toxic", "p_toxic", "n_lines", "bin", "bucket", "rank", "slot", "quality", "p_meta", "ids", "n")
PIECE = re.compile(r"[^\t\n\f\r ]+[\t\n\f\r ]*")


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + (rng.choice([".", ".\n", ",", "", ""]) if k % 7 == 6 else ""))
    return " ".join(out)


def hashes(text):
    return [int(h) for h in words(pa.array([text or ""], pa.string()))[0]]


def components(n, pairs):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(n)]


def decontaminated(text, items, least=13, coverage=0.8, floor=5):
    """(text, words, removed words)"""
    if text is None:
        return None, 0, 0
    norm = lambda w: regex.sub(r"[^\p{L}\p{N}]", "", w.lower())
    pieces = PIECE.findall(text)
    ws = [norm(p) for p in pieces]
    at = [k for k, w in enumerate(ws) if w]
    solid, gone = [ws[k] for k in at], set()
    for item in items:
        it = [w for w in map(norm, PIECE.findall(item or "")) if w]
        if len(it) < floor:
            continue
        t = min(least, max(floor, math.ceil(round(coverage * len(it), 9))))
        grams = {tuple(it[k : k + t]) for k in range(len(it) - t + 1)}
        for k in range(len(solid) - t + 1):
            if tuple(solid[k : k + t]) in grams:
                gone.update(range(k, k + t))
    out, i = [re.match(r"[\t\n\f\r ]*", text)[0]], -1
    for p, w in zip(pieces, ws):
        if w:
            i += 1
            drop = i in gone
        else:
            drop = i in gone and i + 1 in gone
        if not drop:
            out.append(p)
    return "".join(out) if gone else text, len(solid), len(gone)


def line_deduped(rows, least=4):
    """[(doc_id, text, lines, removed)] of rows (doc_id, text)"""
    trim = lambda x: x.strip(" \t\f\r\n")
    order = lambda d: (d is None, d)
    count, owner = Counter(), {}
    for d, t in rows:
        for x in map(trim, t.split("\n") if t is not None else []):
            if x:
                count[x] += 1
                owner[x] = min(owner.get(x, d), d, key=order)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        kept, seen, lines = [], set(), t.split("\n")
        for line in lines:
            x = trim(line)
            if x and count[x] >= least and (owner[x] != d or x in seen):
                continue
            seen.add(x)
            kept.append(line)
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def fingerprint(text):
    from textloom.llm.textbytes import mix

    hs = sorted(set(hashes(text)))
    if not hs:
        return None
    votes = [0] * 128
    for h in hs:
        a, b = (int(mix(np.array([x], np.uint64))[0]) for x in (h, h ^ 0xA0761D6478BD642F))
        for k in range(64):
            votes[k] += a >> k & 1
            votes[64 + k] += b >> k & 1
    return sum(1 << k for k, v in enumerate(votes) if 2 * v > len(hs))


def near_groups(texts, radius):
    """The first of each text's group; one without words is alone."""
    f = [fingerprint(t) for t in texts]
    return components(len(texts), [(i, j) for i in range(len(f)) for j in range(i) if f[i] is not None and f[j] is not None and (f[i] ^ f[j]).bit_count() <= radius])


def toxic_probability(text, model):
    weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
    clean, n = 1.0, 0
    for s in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$", text or ""):
        hs = hashes(s)
        if hs:
            n += 1
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weights.get(h, 0.0) for h in hs))))
    return (1 - clean if n else 0.0), n
