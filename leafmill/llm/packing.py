"""Best-fit packing of token sequences: patterns by non-negative least squares, residuals by best fit.

1. Spark tokenises every text and cuts what exceeds the capacity; a cut document's first piece is the shorter one.
2. Spark counts pieces by length. The histogram has at most `capacity` rows, whatever the corpus, and goes to the driver.
3. The driver enumerates the patterns of at most three lengths that fill a sequence exactly, fits repeat counts to the
   histogram by non-negative least squares, rounds them, and packs the residual counts by best fit, longest first. All
   of this works on counts of lengths, never on pieces.
4. Spark numbers the pieces of each length (in salted groups, so that one common length is no single task) and looks up
   the slot of each number: sequence and offset.

Nulls and empty texts are the end id alone. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_slices, materialize, partitions, table

#: White space other than the space and the line feed.
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_MARKS = frozenset(".,;:!?")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def split_units(text: str) -> list[str]:
    """The text cut before each lone space (non-space characters on both sides), without these spaces.

    Byte-level pre-tokenisation always ends a match there, so each unit can be encoded by itself.
    """
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD_SPACE.search(text):
        return _LONE_SPACE.split(text)
    return text.split(" ")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class UnitEncoder(dict):
    """Token ids of texts by a byte-level BPE model; what recurs is encoded once.

    Keys are units after a lone space, or (unit,) for one that starts a text; values are their numbers. A new unit is
    pre-tokenised, and each of its pre-tokens that is new goes through the tokenizer's model. A text that holds one of the
    tokenizer's added tokens goes through the tokenizer whole.
    """

    UNITS, IDS = 400_000, 6_000_000

    def __init__(self, tokenizer, pattern: str):
        super().__init__()
        import regex

        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.split = regex.compile(pattern).findall
        self.characters = byte_characters()
        self.added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.known: dict[str, list[int]] = {}
        self.new_ids: list[int] = []
        self.new_counts: list[int] = []
        self.starts, self.counts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, unit) -> int:
        n = len(self.new_ids)
        if unit.__class__ is tuple:
            found = self.split(unit[0])
        elif unit.isalpha():  # letters are one pre-token, and so is a mark that ends them
            found = (" " + unit,)
        elif unit[-1:] in _MARKS and unit[:-1].isalpha():
            found = (" " + unit[:-1], unit[-1])
        else:
            found = self.split(" " + unit)
        for w in found:
            ids = self.known.get(w)
            if ids is None:
                tokens = self.model.tokenize(w.encode().decode("latin-1").translate(self.characters))
                ids = self.known[w] = [t.id for t in tokens]
            self.new_ids += ids
        self.new_counts.append(len(self.new_ids) - n)
        k = self[unit] = len(self)
        return k

    def flush(self) -> None:
        if not self.new_counts:
            return
        counts = np.array(self.new_counts, np.int64)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.pool = np.concatenate([self.pool, np.array(self.new_ids, np.uint32)])
        self.new_ids, self.new_counts = [], []

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        gc.disable()  # many small lists and no cycles: scanning them costs more than the encoding
        for at in range(0, len(texts), 512):
            if len(self) > self.UNITS or len(self.pool) > self.IDS:
                self.reset()
            numbers = []
            for t in texts[at : at + 512]:
                if any(a in t for a in self.added):
                    numbers.append(None)
                    continue
                first, *rest = split_units(t) if t else [""]
                u = np.empty(len(rest) + 1, np.int64)
                u[0] = self[(first,)]
                u[1:] = np.fromiter(map(self.__getitem__, rest), np.int64, len(rest))
                numbers.append(u)
            self.flush()
            for t, u in zip(texts[at : at + 512], numbers, strict=True):
                if u is None:
                    yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                    continue
                n = self.counts[u]
                ends = np.cumsum(n)
                yield self.pool[np.arange(ends[-1]) + np.repeat(self.starts[u] - ends + n, n)]


@lru_cache(maxsize=2)
def unit_encoder(tokenizer_file: str) -> UnitEncoder:
    import public_tokenizers
    from tokenizers import Tokenizer

    return UnitEncoder(Tokenizer.from_file(tokenizer_file), public_tokenizers.PATTERN)


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of each (doc_id, text): doc_id, piece, start, length, ids_crc32 and, on request, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = unit_encoder(tokenizer_file)
        for b in in_slices(batches):
            cols: list[list] = [[], [], [], [], [], []]
            docs_of = b.column(0).to_pylist()
            texts = [x or "" for x in b.column(1).to_pylist()]
            for doc, ids in zip(docs_of, enc.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                n, first = len(ids), len(ids) % capacity or capacity
                s, k = 0, 0
                while s < n:
                    e = first if k == 0 else s + capacity
                    for c, v in zip(cols, (doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e].astype(np.int32) if with_ids else None), strict=True):
                        c.append(v)
                    s, k = e, k + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:5], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays) if with_ids else 5])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (a, b, c) of lengths, a >= b >= c and 0 for none, that add up to the capacity."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True
    found = []
    for a in lengths[(lengths < capacity) & (lengths >= capacity / 3)]:
        rest = capacity - a
        b = np.arange(min(a, rest), (rest + 1) // 2 - 1, -1)
        c = rest - b
        ok = (b > 0) & there[b] & there[c]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit_counts(hist: np.ndarray, patterns: np.ndarray, sweeps: int = 80) -> np.ndarray:
    """Non-negative least squares of the histogram by the patterns: steepest coordinates first, disjoint ones together."""
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    a, b, c = patterns.T
    used = (c > 0).astype(np.int64)
    norm = 2 + used + 2 * (a == b) + 2 * ((b == c) & (c > 0)) + 2 * (a == c)
    r = hist.astype(float)
    r[0] = 0
    for _ in range(sweeps):
        step = np.maximum((r[a] + r[b] + r[c]) / norm, -x)
        gain = step * step * norm
        top = np.argpartition(gain, -min(4000, len(gain)))[-4000:]
        top = top[np.argsort(-gain[top])]
        if gain[top[0]] < 0.25:
            break
        taken: set[int] = set()
        for j in top.tolist():
            own = {int(v) for v in patterns[j] if v}
            if gain[j] < 0.25 or own & taken:
                continue
            taken |= own
            x[j] += step[j]
            for v in patterns[j]:
                if v:
                    r[v] -= step[j]
    return x


def round_counts(hist: np.ndarray, patterns: np.ndarray, x: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts that the histogram can serve, largest first; takes them out of the histogram."""
    out = []
    for j in np.argsort(-x):
        want = int(x[j] + 0.5)
        if want < 1:
            break
        p = tuple(int(v) for v in patterns[j] if v)
        n = min([want, *(int(hist[v]) // p.count(v) for v in set(p))])
        if n > 0:
            for v in p:
                hist[v] -= n
            out.append((p, n))
    return out


def best_fit(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal sequences are filled together."""
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # open sequences by room left
    for length in range(capacity, 0, -1):
        left = int(hist[length])
        at = length
        while left:
            while at <= capacity and not room[at]:
                at += 1
            if at > capacity:
                each = capacity // length
                full, some = divmod(left, each)
                for k, n in ((each, full), (some, 1 if some else 0)):
                    if n:
                        p = (length,) * k
                        room[capacity - length * k][p] = room[capacity - length * k].get(p, 0) + n
                break
            p, n = room[at].popitem()
            k = min(at // length, left) if n == 1 else 1
            if n > 1:  # each sequence takes as many as fit, as best fit would give them one after another
                k = min(at // length, max(1, left // n))
                n2 = min(n, left // k)
                if n2 < n:
                    room[at][p] = n - n2
                n = n2
            q = p + (length,) * k
            room[at - length * k][q] = room[at - length * k].get(q, 0) + n
            left -= n * k
    return [(p, n) for r in room for p, n in r.items()]


def plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used, for a histogram by length (index 0 unused)."""
    left = hist.astype(np.int64).copy()
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(left[:capacity]), capacity)
    out += round_counts(left, patterns, fit_counts(left, patterns))
    return out + best_fit(left, capacity)


def slots(strategy: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, end number, copies a sequence, first sequence, offset), by length and number."""
    rows, taken, base = [], {}, 0
    for p, n in strategy:
        at = 0
        for v in sorted(set(p), reverse=True):
            m, s = p.count(v), taken.get(v, 0)
            rows.append((v, s, s + n * m, m, base, at))
            taken[v], at = s + n * m, at + v * m
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, length and more; a stored table, as it is read twice) with sequence_id and offset."""
    spark = pieces.sparkSession
    hist = np.zeros(capacity + 1, np.int64)
    salts = max(16, partitions(spark))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        hist[r["length"]] = r["n"]
    lookup = slots(plan(hist, capacity))
    firsts = sizes.select("length", "_salt", (F.sum("n").over(W.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_first"))
    numbered = (
        salted.withColumn("_k", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
        .join(firsts, ["length", "_salt"])  # partitioned as the window is
        .withColumn("_number", F.col("_first") + F.col("_k"))
        .drop("_salt", "_k", "_first")
    )
    names = [*pieces.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lookup[:, 0] * (1 << 44) + lookup[:, 1]
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_number"))
            s = lookup[np.searchsorted(key, length * (1 << 44) + number, side="right") - 1]
            k = number - s[:, 1]
            seq, off = s[:, 4] + k // s[:, 3], s[:, 5] + (k % s[:, 3]) * length
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, pieces.select(names).schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    pieces = materialize(token_pieces(docs, tokenizer_file, capacity, end_id), "pieces")
    return pack(pieces, capacity)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
