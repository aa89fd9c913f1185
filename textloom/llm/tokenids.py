"""Token ids in binary shards with Elias-Fano document boundaries."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from .common import need, readable
from .textbytes import slices, string_array

#: Where the vocabulary lies on the workers, and the pattern of its pre-tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cuts where the pattern always does: each unit is some whole pre-tokens, so ids of units joined are the ids of the text.
_UNIT = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
_CACHE = 400_000


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Known(dict):
    """Numbers of keys; one that's new gets the next number and is noted."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


def unit_keys(text: str) -> list[str]:
    """The text's units. As most follow a space, the key of one that does is without it; of one that doesn't it begins with a zero byte, or is a line end."""
    if not text:
        return []
    found = ("\0" + text).replace("\n", " \n \0").split(" ")
    # plain: single spaces and line ends between words, and no other white space
    if "" in found or "\0" in found or "\0" in text or len(text.split()) + text.count("\n") != len(found):
        return ["\0" + u for u in _UNIT.findall(text)]
    return found


def _text(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key == "\n" else " " + key


class Encoder:
    """Ids of texts; units met before are looked up."""

    def __init__(self, path: str):
        self.encoding = encoding(path)
        self.wide = self.encoding.max_token_value > 0xFFFF
        (self.line_end,) = self.encoding.encode_ordinary("\n")
        self._clear()

    def _encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def _learn(self, units: list[str]) -> None:
        """Appends the ids of new units. A line end between units without one is a pre-token of its own, so one call encodes them all."""
        words = [u for u in units if not u.isspace()]
        blank = np.array([u.isspace() for u in units], bool)
        flat = self._encode("".join(u + "\n" for u in words))
        cut = np.flatnonzero(flat == self.line_end)
        n = np.zeros(len(units), np.int64)
        n[~blank] = np.diff(cut, prepend=-1) - 1
        # white space is one pre-token; the pattern itself would backtrack over a long run of it
        made = [np.array(self.encoding._encode_single_piece(u), np.int32) for u in units if u.isspace()]
        n[blank] = [len(x) for x in made]
        ids = np.empty(int(n.sum()), np.int32)
        of = np.repeat(blank, n)
        ids[~of] = flat[flat != self.line_end]
        if made:
            ids[of] = np.concatenate(made)
        self.lengths = np.concatenate((self.lengths, n))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(n) - n))
        self.ids = np.concatenate((self.ids, ids))

    def _clear(self) -> None:
        self.known = _Known()
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of each."""
        if len(self.known) > _CACHE:
            self._clear()
        known, keys, counts = self.known, [], []
        for t in texts:
            found = unit_keys(t)
            keys += found
            counts.append(len(found))
        at = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        if known.fresh:
            self._learn([_text(k) for k in known.fresh])
            known.fresh = []
        length = self.lengths[at]
        ends = np.cumsum(length)
        out = self.ids[np.repeat(self.starts[at] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        total = np.concatenate(([0], ends))
        bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        return out, total[bounds[1:]] - total[bounds[:-1]]


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a value, with select of any value.

    Each value's low bits lie side by side; its high bits are the zeros before its one in ``high``. Of
    every SAMPLE-th one the position is kept, and select scans on from there by whole words.
    """

    SAMPLE = 256

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-(int(ones[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, universe, bits, np.packbits(low.astype(np.uint8).reshape(-1), bitorder="little"), high, ones[:: cls.SAMPLE].astype(np.uint32 if len(flags) < 1 << 32 else np.uint64))

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // self.SAMPLE])
        left = i % self.SAMPLE
        w = at >> 6
        word = int(self.high[w]) >> (at & 63) << (at & 63)
        while (c := word.bit_count()) <= left:
            left -= c
            w += 1
            word = int(self.high[w])
        for _ in range(left):
            word &= word - 1
        one = (w << 6) + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a = i * self.low_bits
        b = a + self.low_bits
        return int.from_bytes(self.low[a >> 3 : (b + 7) >> 3].tobytes(), "little") >> (a & 7) & (1 << self.low_bits) - 1

    def all(self) -> np.ndarray:
        """Every value."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (ones - np.arange(self.n) << self.low_bits) + bits @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def fields(self) -> dict:
        return {"ef_universe": self.universe, "ef_low_bits": self.low_bits, "ef_low": self.low.tobytes(), "ef_high": self.high.tobytes(), "ef_samples": self.samples.tobytes()}


class ShardReader:
    """Reads documents of one row of ``encode``."""

    def __init__(self, row):
        get = row.__getitem__
        self.doc_ids = get("doc_ids")
        self.ids = np.frombuffer(get("ids"), np.uint32 if get("id_bytes") == 4 else np.uint16)
        high = np.frombuffer(get("ef_high"), np.uint64)
        self.ends = EliasFano(get("n_docs"), get("ef_universe"), get("ef_low_bits"), np.frombuffer(get("ef_low"), np.uint8), high, np.frombuffer(get("ef_samples"), np.uint32 if len(high) < 1 << 26 else np.uint64))

    def __len__(self) -> int:
        return self.ends.n

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def schema(doc_id: T.DataType) -> T.StructType:
    fields = [("shard", T.StringType()), ("n_docs", T.LongType()), ("n_ids", T.LongType()), ("id_bytes", T.IntegerType()), ("doc_ids", T.ArrayType(doc_id)), ("ids", T.BinaryType()), ("ef_universe", T.LongType()), ("ef_low_bits", T.IntegerType()), ("ef_low", T.BinaryType()), ("ef_high", T.BinaryType()), ("ef_samples", T.BinaryType())]
    return T.StructType([T.StructField(*f) for f in fields])


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, shard_ids: int = 8_000_000) -> DataFrame:
    """A row per shard: ids of its documents' texts side by side, doc_ids in that order, and their ends in Elias-Fano code.

    Ids are two bytes each, or four where the vocabulary needs it. A shard closes with the stretch of documents, of about 1 MB of text,
    that brings it to ``shard_ids``; no row is moved between partitions. ``shard`` is partition-number. A text is encoded whole,
    so decoding its ids gives it back to the byte. A null or empty text has no ids, and its end equals the one before;
    null and repeated doc_ids are kept in place. Other columns are not read. An empty table gives no shard.
    """
    need(docs, "doc_id", "text")
    docs = readable(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[pa.Array] = []
        size = 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            ends = np.cumsum(np.concatenate(counts))
            ef = EliasFano.build(ends)
            kind = np.uint32 if encoder.wide else np.uint16
            whose = pa.concat_arrays(names)
            row = {"shard": f"{part}-{number}", "n_docs": len(ends), "n_ids": len(flat), "id_bytes": np.dtype(kind).itemsize, "doc_ids": None, "ids": flat.astype(kind).tobytes(), **ef.fields()}
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(whose)], pa.int32()), whose) if k == "doc_ids" else pa.array([v], types[k]) for k, v in row.items()]
            return pa.RecordBatch.from_arrays(arrays, names=list(row))

        types = {"shard": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64(), "id_bytes": pa.int32(), "ids": pa.binary(), "ef_universe": pa.int64(), "ef_low_bits": pa.int32(), "ef_low": pa.binary(), "ef_high": pa.binary(), "ef_samples": pa.binary()}
        for batch in batches:
            a = string_array(batch.column(1))
            for i, j in slices(a, 1 << 20):
                made, n = encoder.texts(a.slice(i, j - i).to_pylist())
                ids.append(made.astype(np.uint32 if encoder.wide else np.uint16))
                counts.append(n)
                names.append(batch.column(0).slice(i, j - i))
                size += len(made)
                if size >= shard_ids:
                    yield close()
                    ids, counts, names, size, number = [], [], [], 0, number + 1
        if counts:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(run, schema(docs.schema["doc_id"].dataType))
