"""Suffix-array dedup: bytes of every string of `length` bytes that starts more than once in the corpus.

The suffix array is sparse. A suffix is sorted only if its first half-window (length / 2 bytes) has the least hash of
some window of `length` bytes, so equal windows hold equal suffixes at equal offsets and no repeat is missed, and only
if two Bloom filters say that its start may recur.

1. Equal texts are one text; those that have copies lose everything, and one copy stands for all in the sort.
2. Tasks sort the suffixes of their texts into runs, one for each bucket of suffix starts, and send them front-coded: the
   bytes that each shares with the one before are sent as a number. Each suffix carries the bytes on its left.
   Suffixes of a start that is very common go to several buckets, each for some windows, by what surrounds the start.
3. A bucket's runs are merged by a loser tree that knows the common prefix of each run's head with the last output, and
   compares bytes only beyond it. Out come the sorted suffixes and their common prefixes.
4. In a group of suffixes with a common start, a window that begins o bytes before them is repeated if another suffix
   shares length - o bytes on the right (told by the common prefixes alone) and o bytes on the left.
5. The repeated windows of each text are joined to it and its bytes cut.

Matches never cross documents. Null texts are empty; texts shorter than a window keep everything unless other rules
apply. Rows with equal ids are judged by their own texts. Other columns pass through, but for those that have the name of a
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, materialize, mix, partitions, table, texts_of
from .filters import filter_bits, may_repeat, repeat_filter

LENGTH = 200
#: Texts sampled to find starts that are hot, in how many of them one is hot, and hot starts at most. This only balances
#: the work: a start's suffixes are dealt one way or the other with the same result.
HOT_SAMPLE, HOT_TEXTS, HOT_STARTS = 4000, 16, 1 << 16
#: A bucket for each so many bytes of text, at least: its task holds the suffixes of one bucket, front-coded.
BUCKET_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE)))
        down = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))))
    return up, down


_UP, _DOWN = _powers(1 << 16)
_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def start_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position of x (uint8), in pieces that overlap by k - 1."""
    n = len(x) - k + 1
    out = np.empty(max(n, 0), np.uint64)
    step = len(_UP) - 1 - k
    with np.errstate(over="ignore"):
        for at in range(0, n, step):
            m = min(step, n - at)
            sums = np.zeros(m + k, np.uint64)
            np.cumsum(_CODES[x[at : at + m + k - 1]] * _UP[: m + k - 1], out=sums[1:])
            out[at : at + m] = (sums[k:] - sums[: m]) * _DOWN[:m]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(29)
    return out


def _sliding(x: np.ndarray, w: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """ufunc over each w neighbours of x."""
    blocks = -(-len(x) // w)
    grid = np.full(blocks * w, np.uint64(fill))
    grid[: len(x)] = x
    grid = grid.reshape(blocks, w)
    left = ufunc.accumulate(grid, 1).reshape(-1)
    right = ufunc.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return ufunc(right[: len(x) - w + 1], left[w - 1 : len(x)])


def sampled_starts(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes to sort, and the hashes of their starts (length / 2 bytes).

    A position is taken if its hash is the least in some window of length bytes that holds its start.
    """
    k = length // 2
    w = length - k + 1
    if len(x) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = start_hashes(x, k)
    least = _sliding(h, w, np.minimum, 0xFFFFFFFFFFFFFFFF)
    ends = np.zeros(w - 1, np.uint64)
    most = _sliding(np.concatenate([ends, least, ends]), w, np.maximum, 0)
    at = np.flatnonzero(most == h)
    return at, h[at]


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row of a sorted matrix shares with the row before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 4096):
        b = min(len(rows), a + 4096)
        differ = rows[a:b] != rows[a - 1 : b - 1]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


#: The columns of a run, with their types; `rest` holds what each suffix does not share with the one before.
_RUN = (("lcp", np.uint16), ("node", np.int64), ("more", np.int64), ("at", np.int64), ("right", np.uint16), ("left", np.uint16))


def encode_run(right: np.ndarray, left: np.ndarray, columns: dict[str, np.ndarray]) -> bytes:
    """A sorted run, front-coded."""
    n, width = right.shape
    lcp = common_prefixes(right)
    keep = np.arange(width)[None, :] >= lcp[:, None]
    columns = columns | {"lcp": lcp}
    return b"".join([np.array([n, width, left.shape[1]], np.int64).tobytes(), *(columns[c].astype(t).tobytes() for c, t in _RUN), left.tobytes(), right[keep].tobytes()])


class Run:
    """A front-coded run; its suffixes are decoded one after another, as the merge asks for them."""

    def __init__(self, data: bytes):
        n, width, side = np.frombuffer(data, np.int64, 3).tolist()
        at = 24
        for c, t in _RUN:
            setattr(self, c, np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
        self.lefts = np.frombuffer(data, np.uint8, n * side, at).reshape(n, side)
        self.prefixes = self.lcp.tolist()
        self.rest, self.width, self.here, self.done, self.last = memoryview(data)[at + n * side :], width, 0, 0, b""

    def __len__(self) -> int:
        return len(self.prefixes)

    def __getitem__(self, at: int) -> bytes:
        if at == self.done:
            shared = self.prefixes[at]
            end = self.here + self.width - shared
            self.last = self.last[:shared] + bytes(self.rest[self.here : end])
            self.here, self.done = end, at + 1
        elif at != self.done - 1:
            raise IndexError("a run is read in order")
        return self.last


def shared_beyond(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of one length that share `known` bytes."""
    x, y = a[known:], b[known:]
    if x == y:
        return len(a)
    return len(a) - (((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) >> 3)


def merge_runs(runs: list, prefixes: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """The order (run, place) of the sorted runs' strings, and each one's common prefix with the one before.

    A loser tree: each match keeps its loser and the prefix that the loser shares with the winner. On the way up a
    string meets losers that, like itself, are described by what they share with the last output; the one that shares
    more is less, and only strings that share the same are compared, beyond what they share.
    """
    k = 1 << max(len(runs) - 1, 0).bit_length()
    done = None
    heads: list[bytes | None] = [r[0] if r else done for r in runs] + [done] * (k - len(runs))
    places = [0] * k
    loser, loser_lcp = [0] * k, [0] * k

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner, its prefix, loser, its prefix with the winner; ties to the smaller run."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, la, b, 0
        if x is None:
            return b, lb, a, 0
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        n = shared_beyond(x, y, la)
        if n == len(x):
            return (a, la, b, n) if a < b else (b, la, a, n)
        return (a, la, b, n) if x[n] < y[n] else (b, la, a, n)

    winners = [(r, 0) for r in range(k)]
    level = k
    while level > 1:
        level //= 2
        up = []
        for j in range(level):
            (a, la), (b, lb) = winners[2 * j], winners[2 * j + 1]
            w, lw, lo, ll = play(a, la, b, lb)
            loser[level + j], loser_lcp[level + j] = lo, ll
            up.append((w, lw))
        winners = up
    w, lw = winners[0]
    order, lcps = [], []
    while heads[w] is not None:
        order.append((w, places[w]))
        lcps.append(lw)
        places[w] += 1
        at = places[w]
        if at < len(runs[w]):
            heads[w], lw = runs[w][at], prefixes[w][at]
        else:
            heads[w], lw = None, -1
        node = (k + w) >> 1
        while node:
            lo, ll = loser[node], loser_lcp[node]
            if heads[lo] is None:
                pass
            elif lw > ll:
                pass
            elif lw < ll:
                loser[node], loser_lcp[node], w, lw = w, max(lw, 0), lo, ll
            else:
                w, lw, loser[node], loser_lcp[node] = play(w, lw, lo, ll)
            node >>= 1
    return order, lcps


def repeated(lcp: np.ndarray, left: np.ndarray, right_n: np.ndarray, left_n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sorted suffix the least and most o so that the window from o bytes before it is repeated; -1 if none."""
    k = length // 2
    n = len(lcp)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    group = np.cumsum(lcp < k)
    same = np.append(group[1:] == group[:-1], False)
    rows = np.flatnonzero(same | np.append(False, same[:-1]))
    size = np.bincount(group, minlength=group[-1] + 1 if n else 0)
    pairs = rows[size[group[rows]] == 2][::2]
    if len(pairs):
        differ = left[pairs] != left[pairs + 1]
        l = np.where(differ.any(1), differ.argmax(1), left.shape[1])
        l = np.minimum(l, np.minimum(left_n[pairs], left_n[pairs + 1]))
        r = np.minimum(lcp[pairs + 1], np.minimum(right_n[pairs], right_n[pairs + 1]))
        good = l + r >= length
        for side in (0, 1):
            low[pairs[good] + side], high[pairs[good] + side] = np.maximum(length - r[good], 0), l[good]
    rows = rows[size[group[rows]] > 2]
    if len(rows):
        prefix, own_left, rn, ln = lcp[rows].copy(), left[rows], right_n[rows], left_n[rows]
        prefix[np.append(True, group[rows][1:] != group[rows][:-1])] = 0
        left_hash = np.zeros(len(rows), np.uint64)
        for o in range(0, length - k + 1):
            if o:
                left_hash = mix(left_hash * _BASE + own_left[:, o - 1].astype(np.uint64) + np.uint64(1))
            fits = np.flatnonzero((rn >= length - o) & (ln >= o))
            if len(fits) < 2:
                continue
            key = mix(left_hash[fits] + np.cumsum(prefix < length - o)[fits].astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53))
            order = np.argsort(key, kind="stable")
            twice = key[order][1:] == key[order][:-1]
            hit = rows[fits[order[np.append(twice, False) | np.append(False, twice)]]]
            low[hit] = np.where(low[hit] < 0, o, low[hit])
            high[hit] = o
    return low, high


def _bytes_hash(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    h = np.full(len(rows), 7, np.uint64)
    for k in range(rows.shape[1]):
        h = mix(h * _BASE + rows[:, k].astype(np.uint64) + np.uint64(1))
    return h


def deal(right: np.ndarray, left: np.ndarray, cols: dict[str, np.ndarray], h: np.ndarray, hot: np.ndarray, buckets: int, length: int) -> Iterator[tuple]:
    """The suffixes with the buckets that they go to: one by their start, or for hot starts several.

    A repeated window from o bytes before its suffix has all of its length bytes in common with another one. Copies of a
    hot suffix serve ranges of o: each goes by the bytes that every window of its range holds, and carries no more bytes
    on the left than they do. So the suffixes of one start spread by what surrounds it, and those that are alike in what
    a range needs become one in each task. Ranges have buckets of their own, so no suffix meets a copy of itself.
    """
    at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    is_hot = hot[at] == h if len(hot) else np.zeros(len(h), bool)
    to = lambda x: ((x >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    rest = np.flatnonzero(~is_hot)
    if len(rest):
        yield right[rest], left[rest], {c: v[rest] for c, v in cols.items()} | {"bucket": to(h[rest])}
    own = np.flatnonzero(is_hot)
    edges = [0, 1, *(e for e in (4, 16, 48) if e < length - length // 2), length - length // 2 + 1]
    for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True) if len(own) else (), 1):
        some = own[(cols["left"][own] >= a) & (cols["right"][own] >= length - b + 1)]
        if not len(some):
            continue
        key = mix(h[some] ^ mix(_bytes_hash(right[some, : length - b + 1]) + _bytes_hash(left[some, :a]) * _BASE + np.uint64(a)))
        near = left[some].copy()
        near[:, b - 1 :] = 0
        yield right[some], near, {c: v[some] for c, v in cols.items()} | {"left": np.minimum(cols["left"][some], b - 1), "bucket": to(key) + part * buckets}


def hot_starts(texts: DataFrame, n_texts: int, length: int) -> np.ndarray:
    """Hashes of the starts that many of a sample of the texts (node, text) share, sorted."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            found = [np.unique(sampled_starts(np.frombuffer(t, np.uint8), length)[1]) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["start"])

    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(max(1, n_texts // HOT_SAMPLE))) == 0).select("text")
    counts = some.mapInArrow(starts, "start long").groupBy("start").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_TEXTS)
    top = counts.orderBy(F.desc("n"), "start").limit(HOT_STARTS).collect()
    return np.sort(np.array([r["start"] for r in top], np.int64).view(np.uint64))


def _write_runs(held: list[tuple], length: int) -> Iterator[tuple]:
    """Rows (bucket, run, node, start, end) of the suffixes held: a run for each bucket, and the spans of equal ones."""
    if not held:
        return
    right, left = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    cols = {c: np.concatenate([h[2][c] for h in held]) for c in ("node", "more", "at", "right", "left", "bucket")}
    held.clear()
    whole = np.ascontiguousarray(np.concatenate([right, left], 1)).view(f"S{right.shape[1] + left.shape[1]}").reshape(-1)
    order = np.lexsort((whole, cols["bucket"]))
    del whole
    right, left, cols = right[order], left[order], {c: v[order] for c, v in cols.items()}
    n = len(right)
    equal = np.zeros(n, bool)  # like the one before, in all that is sent but its place
    equal[1:] = (right[1:] == right[:-1]).all(1) & (left[1:] == left[:-1]).all(1) & (cols["right"][1:] == cols["right"][:-1]) & (cols["left"][1:] == cols["left"][:-1]) & (cols["bucket"][1:] == cols["bucket"][:-1])
    copied = np.flatnonzero((equal | np.append(equal[1:], False)) & (cols["right"] + cols["left"] >= length))
    node, more, start, end = cols["node"][copied], cols["more"][copied], cols["at"][copied] - cols["left"][copied], cols["at"][copied] + cols["right"][copied]
    by = np.lexsort((start, more, node))
    last: list[int] | None = None
    for d, e, x, y in zip(node[by].tolist(), more[by].tolist(), start[by].tolist(), end[by].tolist(), strict=True):
        if last and last[:2] == [d, e] and x <= last[3]:
            last[3] = max(last[3], y)
        else:
            if last:
                yield last[0] & 0xFFFFF, None, *last
            last = [d, e, x, y]
    if last:
        yield last[0] & 0xFFFFF, None, *last  # dealt by text, as one start may be common
    kept = np.flatnonzero(~equal)
    cut = np.flatnonzero(np.diff(cols["bucket"][kept], prepend=-1, append=-2))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = kept[a:b]
        yield int(cols["bucket"][own[0]]), encode_run(right[own], left[own], {c: v[own] for c, v in cols.items()}), None, None, None, None


_ROWS = "bucket int, run binary, node long, more long, start long, end long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), *[pa.int64()] * 4]
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "run", "node", "more", "start", "end"])


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(node, more, start, end): spans of the texts (node long, more long, text) in which every byte is in a repeated window.

    node and more name a text together. texts is read more than once; its texts differ from one another.
    """
    spark = texts.sparkSession
    k = length // 2
    whole = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count("*").alias("m")).first()
    size = whole["n"]

    def starts(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for t in texts_of(b):
            yield sampled_starts(np.frombuffer(t, np.uint8), length)[1]

    sent = spark.sparkContext.broadcast(repeat_filter(texts.select("text"), starts, filter_bits(size // (k // 2))))
    hot = spark.sparkContext.broadcast(hot_starts(texts, whole["m"], length))
    buckets = max(16, partitions(spark), size // BUCKET_BYTES)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in in_slices(batches):
            for node, more, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b), strict=True):
                x = np.frombuffer(t, np.uint8)
                at, h = sampled_starts(x, length)
                hit = may_repeat(sent.value, h)
                at, h = at[hit], h[hit]
                if not len(at):
                    continue
                wide = np.concatenate([np.zeros(k, np.uint8), x, np.zeros(length, np.uint8)])
                right = wide[at[:, None] + np.arange(k, k + length)]
                left = wide[at[:, None] + np.arange(k - 1, -1, -1)]
                cols = {"node": np.full(len(at), node), "more": np.full(len(at), more), "at": at, "right": np.minimum(len(x) - at, length), "left": np.minimum(at, k)}
                for part in deal(right, left, cols, h, hot.value, buckets, length):
                    held.append(part)
                    n += len(part[0])  # a hot start is dealt several times
                    if n >= 60_000:
                        yield _batch(list(_write_runs(held, length)))
                        held, n = [], 0
        yield _batch(list(_write_runs(held, length)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[bytes]] = {}
        for b in batches:
            known = [r for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[1] is None]
            if known:
                yield _batch(known)
            for bucket, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if run is not None:
                    own.setdefault(bucket, []).append(run)
        for bucket in sorted(own):
            read = [Run(x) for x in own.pop(bucket)]
            order, lcps = merge_runs(read, [r.prefixes for r in read])
            base = np.cumsum([0, *map(len, read)])
            at = np.array([base[r] + p for r, p in order], np.int64)
            cols = {c: np.concatenate([getattr(r, c) for r in read])[at].astype(np.int64) for c in ("node", "more", "at", "right", "left")}
            low, high = repeated(np.array(lcps, np.int64), np.concatenate([r.lefts for r in read])[at], cols["right"], cols["left"], length)
            hit = np.flatnonzero(high >= 0)
            m = len(hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, bucket, np.int32)), pa.nulls(m, pa.binary()), *(pa.array(c) for c in (cols["node"][hit], cols["more"][hit], cols["at"][hit] - high[hit], cols["at"][hit] - low[hit] + length))],
                names=["bucket", "run", "node", "more", "start", "end"],
            )

    sorted_runs = texts.select("node", "more", "text").mapInArrow(runs, _ROWS).repartition(buckets, "bucket")
    return sorted_runs.mapInArrow(merge, _ROWS).select("node", "more", "start", "end")


def remove_repeats(docs: DataFrame, length: int = LENGTH, out: tuple[str, str, str, str] = ("kept", "n_bytes", "n_removed", "spans"), as_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) with kept binary, n_bytes, n_removed and spans (starts and ends) of the bytes removed.

    These four take the names in `out`; columns of docs with such a name are left out. With as_text, kept is a string, in
    which a character goes as a whole if a byte of it is cut, and the column text is left out.
    """
    fields = docs.schema.fields
    names = [f.name for f in fields if f.name not in out and not (as_text and f.name == "text")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a text is told by 128 bits
    rows = docs.select(*names, text.alias("_text")).withColumn("_node", F.xxhash64("_text", F.octet_length("_text"))).withColumn("_more", F.xxhash64(F.lit(length), "_text"))
    key = ["node", "more"]
    long = rows.filter(F.octet_length("_text") >= length).select(F.col("_node").alias("node"), F.col("_more").alias("more"), F.col("_text").alias("text"))
    copies = materialize(long.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key), "copied-texts")
    # one of each text: those with copies pass a shuffle, whose map side keeps one of each
    many = long.join(copies, key, "left_semi").groupBy(*key).agg(F.first("text").alias("text"))
    many = materialize(many, "texts-with-copies")
    single = long.join(copies, key, "left_anti")
    found = repeated_spans(single.unionByName(many), length)
    own = found.groupBy(*key).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))  # at most as many as the text is long
    whole = copies.select(*key, F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("_spans"))
    cut = materialize(own.join(copies, key, "left_anti").unionByName(whole).withColumn("_hit", F.lit(True)), "spans")
    cut = cut.withColumnsRenamed({"node": "_cut", "more": "_cut_more"})
    joined = rows.join(cut, (rows["_node"] == cut["_cut"]) & (rows["_more"] == cut["_cut_more"]), "left").select(*names, "_text", "_hit", "_spans")
    kept = [f for f in fields if f.name in names]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*kept, T.StructField(out[0], T.StringType() if as_text else T.BinaryType()), T.StructField(out[1], T.LongType()), T.StructField(out[2], T.LongType()), T.StructField(out[3], span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            left, n_bytes, n_removed, cuts = [], [], [], []
            for t, hit, parts in zip(texts_of(b, "_text"), b.column(len(names) + 1).to_pylist(), b.column(len(names) + 2).to_pylist(), strict=True):
                removed: list[list[int]] = [[0, len(t)]] if hit and parts is None else []
                for x in sorted((x["start"], x["end"]) for x in parts or []):
                    if removed and x[0] <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], x[1])
                    else:
                        removed.append([*x])
                edges = [0, *(e for r in removed for e in r), len(t)]
                rest = b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                left.append(rest.decode("utf-8", "ignore") if as_text else rest)
                n_bytes.append(len(t))
                n_removed.append(sum(z - a for a, z in removed))
                cuts.append([{"start": a, "end": z} for a, z in removed])
            kinds = [pa.string() if as_text else pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            made = [pa.array(c, k) for c, k in zip((left, n_bytes, n_removed, cuts), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *made], names=[*names, *out])

    return joined.mapInArrow(run, schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that start twice or more."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with its text cut; a character of which a byte is cut goes as a whole. All other columns stay."""
    left = remove_repeats(docs, length, ("_left", "_n_bytes", "_n_removed", "_removed"), as_text=True)
    return left.select(*[F.col("_left").alias(c) if c == "text" else c for c in docs.columns])
