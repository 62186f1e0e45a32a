"""Two Bloom filters, of keys seen once and keys seen again, built in Spark; the second one is the result. And, for more keys than a
filter holds, how many keys of each row recur, told by slices of the keys that grow in number with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import give_back

SLICES = 64
#: Bits of a filter at most: 64 MB.
MOST_BITS = 1 << 29


def filter_bits(keys: int) -> int:
    """Bits for about so many keys, a power of two with fixed bounds."""
    return 1 << int(np.clip(int(keys * 16).bit_length(), 20, MOST_BITS.bit_length() - 1))


def repeat_filter(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, least: int = 2) -> np.ndarray:
    """The filter, as bytes of bits, of hashes found in two rows or more (or, with least 1, in any); hashes() yields each row's distinct ones.

    Tasks send the positions that they set, by slice; each slice is merged apart. bits / 8 bytes reach the driver.
    """
    width = bits // SLICES

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[np.ndarray]) -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(found) & np.uint64(bits - 1), return_counts=True)
            at = at.astype(np.uint32)
            cut = np.searchsorted(at, np.arange(SLICES + 1, dtype=np.int64) * width)
            parts = [(k, at[a:b].tobytes(), at[a:b][n[a:b] > 1].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "once", "twice"])

        found: list[np.ndarray] = []
        n = 0
        for b in batches:
            for h in hashes(b):
                found.append(h)
                n += len(h)
                if n >= 1_000_000:
                    yield rows(found)
                    found, n = [], 0
        if n:
            yield rows(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task gets all rows of its slices, and keeps two bitmaps for each."""
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            for k, once, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = maps.setdefault(k, np.zeros((2, width), bool))
                one = np.frombuffer(once, np.uint32) - np.uint32(k * width)
                m[1, one] |= m[0, one]
                m[0, one] = True
                m[1, np.frombuffer(twice, np.uint32) - np.uint32(k * width)] = True
        if maps:
            yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([np.packbits(m[least - 1]).tobytes() for m in maps.values()], pa.binary())], names=["slice", "twice"])

    merged = df.mapInArrow(seen, "slice int, once binary, twice binary").repartition(SLICES, "slice").mapInArrow(merge, "slice int, twice binary")
    out = np.zeros((SLICES, width // 8), np.uint8)
    for k, twice in zip(*merged.toArrow().columns, strict=True):  # bits / 8 bytes
        out[k.as_py()] = np.frombuffer(twice.as_buffer(), np.uint8)
    return out.reshape(-1)


def may_repeat(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter holds."""
    at = hashes & np.uint64(len(filter_bytes) * 8 - 1)
    return (filter_bytes[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1


#: Keys of a slice, about, and places in it; keys and rows that a task sends at once.
SLICE_KEYS, PLACES, SENT_KEYS, SENT_ROWS = 1 << 20, 1 << 24, 500_000, 1 << 16
#: Of the rows sent at once: their ids, how many keys must recur, and how many are known to.
_OWNERS = np.dtype([("id", np.int64), ("least", np.int64), ("known", np.int64)])


def packed(at: np.ndarray) -> bytes:
    """Sorted places by their steps, 16 bits each; a step of 65,535 or more is cut."""
    step = np.diff(at, prepend=0)
    more = step // 65_535
    out = np.full(len(at) + int(more.sum()), 65_535, np.uint16)
    out[np.cumsum(more + 1) - 1] = step % 65_535
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, np.uint16)
    return np.cumsum(step, dtype=np.int64)[step < 65_535]


def recurring(df: DataFrame, keyed: Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray]]], total: int) -> DataFrame:
    """(id, hits): the rows of which `least` keys or more may recur in another, and how many may; keyed() yields (id, least, distinct
    hashes) of each row, some `total` hashes in all. df is read in the same order whenever it is read.

    Tasks send the places of their keys by slice, with the rows that they are of. A slice has a bounded number of keys, so that
    a task holds it whole; it sends back which rows were hit, and those are counted where the rows' ids are. Of some 6 % of the keys
    another one shares the place.
    """
    slices = max(16, -(-total // SLICE_KEYS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sent, n = TaskContext.get().partitionId() << 32, 0, 0
        rows: list[tuple[int, int]] = []
        keys: list[np.ndarray] = []

        def parts() -> pa.RecordBatch:
            every = np.concatenate(keys)
            of = np.repeat(np.arange(len(keys), dtype=np.uint64), [len(k) for k in keys])
            part = ((every >> np.uint64(24)) & np.uint64(0xFFFFFFFF)) * np.uint64(slices) >> np.uint64(32)
            v = part << np.uint64(40) | (every & np.uint64(PLACES - 1)) << np.uint64(16) | of
            del every, part, of
            v.sort()
            # two of one place tell the slice enough; the others are known to recur
            same = v >> np.uint64(16)
            sure = np.zeros(len(v), bool)
            sure[2:] = same[2:] == same[:-2]
            owners = np.zeros(len(rows), _OWNERS)
            owners["id"], owners["least"] = zip(*rows, strict=True)
            owners["known"] = np.bincount((v[sure] & np.uint64(0xFFFF)).astype(np.int64), minlength=len(rows))
            v = v[~sure]
            at, of = (v >> np.uint64(16) & np.uint64(PLACES - 1)).astype(np.int64), (v & np.uint64(0xFFFF)).astype(np.uint16)
            cut = np.searchsorted(v >> np.uint64(40), np.arange(slices + 1, dtype=np.uint64))
            found = [(k, packed(at[a:b]), of[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            found.append((-1 - sent % slices, None, owners.tobytes()))
            cols = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays([cols[0], pa.array([task + sent] * len(found), pa.int64()), *cols[1:]], names=["slice", "batch", "at", "of"])

        for b in batches:
            for i, least, hashes in keyed(b):
                rows.append((i, least))
                keys.append(hashes)
                n += len(hashes)
                if n >= SENT_KEYS or len(rows) == SENT_ROWS:
                    yield parts()
                    rows, keys, n, sent = [], [], 0, sent + 1
                    give_back()
        if rows:
            yield parts()
        give_back()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for b in batches:
            for k, batch, at, of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(k, []).append((batch, at, of))
        for k in list(held):
            rows = held.pop(k)
            if k < 0:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, *_ in rows], pa.int64()), pa.nulls(len(rows), pa.binary()), pa.array([x for *_, x in rows], pa.binary())], names=["batch", "hit", "owners"])
                continue
            once, twice = np.zeros(PLACES, bool), np.zeros(PLACES, bool)
            for _, data, _ in rows:
                at = unpacked(data)
                twice[at] |= once[at]
                twice[at[1:][at[1:] == at[:-1]]] = True
                once[at] = True
            hit = [(batch, np.frombuffer(of, np.uint16)[twice[unpacked(data)]].tobytes()) for batch, data, of in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in hit], pa.int64()), pa.array([x for _, x in hit], pa.binary()), pa.nulls(len(hit), pa.binary())], names=["batch", "hit", "owners"])
        give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: dict[int, np.ndarray] = {}
        owners: dict[int, np.ndarray] = {}
        for b in batches:
            for batch, hit, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own is not None:
                    owners[batch] = np.frombuffer(own, _OWNERS)
                elif hit:
                    n = hits.setdefault(batch, np.zeros(SENT_ROWS, np.int32))
                    np.add.at(n, np.frombuffer(hit, np.uint16), 1)
        for batch, own in owners.items():
            n = own["known"] + (hits[batch][: len(own)] if batch in hits else 0)
            ok = n >= own["least"]
            yield pa.RecordBatch.from_arrays([pa.array(own["id"][ok]), pa.array(n[ok])], names=["id", "hits"])

    answers = df.mapInArrow(send, "slice int, batch long, at binary, of binary").repartition(slices, "slice").mapInArrow(answer, "batch long, hit binary, owners binary")
    return answers.repartition(max(16, -(-total // (8 * SENT_KEYS))), "batch").mapInArrow(count, "id long, hits long")
