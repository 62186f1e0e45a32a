"""Language-model scores: a gated recurrent network over word classes, with a class-factored output.

Texts are tokenised once: Spark stores them in chunks of about CHUNK tokens, each a small dictionary of 64-bit word
hashes and the tokens' places in it. Every later pass reads chunks and looks up dictionaries only.

Counts come first, from every training token. At most VOCABULARY words, the most frequent ones, are known to all tasks;
the others are joined when their counts are needed, so nothing that grows goes to the driver. A frequent word's class
is itself for the SINGLES most frequent, else its group of documents (training documents are grouped by k-means on
their use of the commonest words; rounds run over all of them, only the first centres come from a sample) and its range
of frequency; all other words are one class.

P(word | past) = P(class | state) P(word | class): the network gives the first factor by a softmax over classes, the
training counts the second; in the class of other words a word has (c + 1) / (its tokens + its words + 1), which leaves
room for unseen ones. The network is a gated recurrent unit in numpy. Tasks train on whole training documents in lanes,
by truncated backpropagation over windows of WINDOW tokens with the state carried across them, and their weights are
averaged after each of a few rounds, which together see every training document once. Scoring carries the state through
the whole document as well.

Null and empty texts are their end alone. Rows whose doc_id is null are training rows. Repeated rows count each.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, materialize, most_frequent, summed, table, texts_of

VOCABULARY, SINGLES, GROUPS, RANGES, HIDDEN = 1 << 17, 60, 6, 5, 16
WINDOW, LANES, RATE, ANCHORS, FIRST_CENTRES, CENTRE_ROUNDS = 16, 384, 0.012, 64, 2000, 4
#: Tokens of a chunk, of a batch that the network trains on, and parts of the training documents by their ids' hashes.
CHUNK, BATCH, PARTS = 1 << 19, 2_000_000, 1 << 20
#: Training lays longer texts out as several, as a lane of one text alone is slow; scoring never does.
SEGMENT = 2048
#: Sixteenths of the training documents in each round.
ROUNDS = ((0,), (1, 2), (3, 4, 5, 6, 7), tuple(range(8, 16)))
#: The end of a text, as a token.
END = np.uint64(1)


def held_out(doc_id, folds: int = 7, fold: int = 2):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


class Places(dict):
    """The place of each word in a chunk's dictionary; None, the end of a text, is the first."""

    def __init__(self):
        super().__init__({None: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_CHUNKS = "ids array<bigint>, part binary, size binary, words binary, at binary"


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in chunks: ids; a part of each document, -1 for held-out ones; tokens of each; a dictionary of word
    hashes; and the place in it of every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        places = Places()
        ids, part, size, at = [], [], [], []
        n = 0

        def chunk() -> pa.RecordBatch:
            words = np.fromiter((int(END) if w is None else xxhash.xxh3_64_intdigest(w) for w in places), np.uint64, len(places))
            values = (np.array(part, np.int32), np.array(size, np.int64), words, np.concatenate(at))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["ids", "part", "size", "words", "at"])

        for b in in_slices(batches, 200):
            words: list[bytes | None] = []
            for t in texts_of(b):
                own = t.lower().split()
                words += own
                words.append(None)
                size.append(len(own) + 1)
            at.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
            ids += b.column(0).to_pylist()
            part += b.column(2).to_pylist()
            n += len(words)
            if n >= CHUNK:
                yield chunk()
                places = Places()
                ids, part, size, at, n = [], [], [], [], 0
        if ids:
            yield chunk()

    part = F.when(held_out(F.col("doc_id")), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", part.alias("part")).mapInArrow(run, _CHUNKS)


class Chunk:
    """A row of chunks()."""

    def __init__(self, ids: list, part: bytes, size: bytes, words: bytes, at: bytes):
        self.ids, self.part, self.size = ids, np.frombuffer(part, np.int32), np.frombuffer(size, np.int64)
        self.words, self.at = np.frombuffer(words, np.uint64), np.frombuffer(at, np.uint32)
        self.ends = np.cumsum(self.size)

    @property
    def document(self) -> np.ndarray:
        """The number of each token's document."""
        return np.repeat(np.arange(len(self.size)), self.size)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over each document of a value for each word."""
        return np.add.reduceat(values[self.at], self.ends - self.size)


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for b in batches:
        for k in range(b.num_rows):
            yield Chunk(*(c[k].as_py() for c in b.columns))


class Network:
    """Gated recurrent unit from classes to classes."""

    #: Rows of the output layer that are worked on together, so that they stay in a core's cache.
    ROWS = 1024

    def __init__(self, classes: int, hidden: int = HIDDEN, weights: list[np.ndarray] | None = None):
        rng = np.random.default_rng(7)
        self.hidden, self.classes = hidden, classes
        f = np.float32
        self.w = weights or [
            (rng.normal(0, 0.3, (classes + 1, 3 * hidden))).astype(f),  # the last row starts a text
            (rng.normal(0, 1 / math.sqrt(hidden), (hidden, 3 * hidden))).astype(f),
            (rng.normal(0, 0.1, (hidden, classes))).astype(f),
            np.zeros(classes, f),
        ]

    def steps(self, xs: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each row of xs (time, lane); the state starts anew where the input is a text's start."""
        wx, u = self.w[0], self.w[1]
        k = self.hidden
        kind = np.result_type(wx, h)
        out = np.empty((*xs.shape, k), kind)
        fresh = xs == self.classes
        restarts = fresh.any(1).tolist()
        half = kind.type(0.5)
        for t, x in enumerate(xs):
            if restarts[t]:
                h = np.where(fresh[t][:, None], kind.type(0), h)
            g, a = wx.take(x, 0), h @ u
            zr = g[:, : 2 * k] + a[:, : 2 * k]
            zr *= half
            np.tanh(zr, zr)
            zr *= half
            zr += half
            z, r = zr[:, :k], zr[:, k:]
            n = r * a[:, 2 * k :]
            n += g[:, 2 * k :]
            np.tanh(n, n)
            new = np.subtract(h, n, out[t])
            new *= z
            new += n
            if keep is not None:
                keep.append((h, z, r, n, a[:, 2 * k :]))
            h = new
        return out

    def log_probabilities(self, states: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of the next classes."""
        out = np.empty(len(ys), states.dtype)
        o = np.empty((min(self.ROWS, len(ys)), self.classes), states.dtype)
        for at in range(0, len(ys), self.ROWS):
            y = ys[at : at + self.ROWS]
            own = o[: len(y)]
            np.matmul(states[at : at + self.ROWS], self.w[2], out=own)
            own += self.w[3]
            found = own[np.arange(len(y)), y]
            np.exp(own, own)
            out[at : at + self.ROWS] = found - np.log(own.sum(1))
        return out

    def gradients(self, xs: np.ndarray, ys: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Of the mean loss over a window, and the last state; xs are the inputs of the states that predict ys."""
        wx, u, v, c = self.w
        k, kept = self.hidden, []
        states = self.steps(xs, h, kept)
        flat, target = states.reshape(-1, k), ys.reshape(-1)
        weight = (mask.reshape(-1, 1) / max(mask.sum(), 1)).astype(states.dtype)
        dv, dc, dstates = np.zeros_like(v), np.zeros_like(c), np.empty_like(states)
        dflat = dstates.reshape(-1, k)
        buffer = np.empty((min(self.ROWS, len(flat)), self.classes), states.dtype)
        for at in range(0, len(flat), self.ROWS):
            own, y = flat[at : at + self.ROWS], target[at : at + self.ROWS]
            e = buffer[: len(own)]
            np.matmul(own, v, out=e)
            e += c
            np.exp(e, e)
            e *= weight[at : at + self.ROWS] / e.sum(1, keepdims=True)
            e[np.arange(len(y)), y] -= weight[at : at + self.ROWS, 0]
            dv += own.T @ e
            dc += e.sum(0)
            np.matmul(e, v.T, out=dflat[at : at + self.ROWS])
        du, dg = np.zeros_like(u), np.empty((*xs.shape, 3 * k), states.dtype)
        later, back = np.zeros_like(h), np.ascontiguousarray(u.T)
        da = np.empty((h.shape[0], 3 * k), states.dtype)
        for t in range(len(xs) - 1, -1, -1):
            before, z, r, n, an = kept[t]
            d = dstates[t]
            d += later
            g = dg[t]
            dz, dr, dn = g[:, :k], g[:, k : 2 * k], g[:, 2 * k :]
            np.multiply(n, n, dn)
            np.subtract(1, dn, dn)
            dn *= d
            later = d * z
            dn *= 1 - z
            np.subtract(before, n, dz)
            dz *= later
            dz *= 1 - z
            np.multiply(dn, an, dr)
            dr *= r
            dr *= 1 - r
            da[:, : 2 * k] = g[:, : 2 * k]
            np.multiply(dn, r, da[:, 2 * k :])
            du += before.T @ da
            later += da @ back
            fresh = xs[t] == self.classes
            if fresh.any():
                later[fresh] = 0
        x = xs.reshape(-1)
        if self.classes < 256:
            x = x.astype(np.uint8)  # sorted by radix
        order = np.argsort(x, kind="stable")
        first = np.flatnonzero(np.diff(x[order].astype(np.int32), prepend=-1))
        dwx = np.zeros_like(wx)
        dwx[x[order][first]] = np.add.reduceat(dg.reshape(-1, 3 * k).take(order, 0), first)
        return [dwx, du, dv, dc], states[-1]


class Lanes:
    """Texts laid end to end in lanes of about one length, the longest lane first; a text's first input is its start.

    Every text has one token or more.
    """

    def __init__(self, texts: list[np.ndarray], most: int, start: int):
        self.size = np.array([len(t) for t in texts], np.int64)
        n = min(most, len(texts))
        loads = [(0, k) for k in range(n)]
        self.lane, self.at = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i in np.argsort(-self.size, kind="stable").tolist():
            load, k = heapq.heappop(loads)
            self.lane[i], self.at[i] = k, load
            heapq.heappush(loads, (load + int(self.size[i]), k))
        load = np.zeros(n, np.int64)
        for length, k in loads:
            load[k] = length
        order = np.argsort(-load, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.load = load[order]
        self.begin = np.cumsum(self.load) - self.load
        self.at += self.begin[rank[self.lane]]  # one lane after another, so a long text widens no other lane
        self.ys, self.xs = np.zeros(self.size.sum(), np.int32), np.full(self.size.sum(), start, np.int32)
        for a, t in zip(self.at.tolist(), texts, strict=True):
            self.ys[a : a + len(t)] = t
            self.xs[a + 1 : a + len(t)] = t[:-1]

    def windows(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, inputs, targets, mask) by (time, lane), of the lanes that go on."""
        for at in range(0, int(self.load.max(initial=0)), length):
            n = int(np.searchsorted(-self.load, -at, side="left"))
            time = np.arange(at, min(at + length, int(self.load[0])))[:, None]
            mask = time < self.load[:n]
            places = np.where(mask, self.begin[:n] + time, 0)
            yield places, self.xs[places], self.ys[places], mask.astype(np.float32)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over each text of values by place."""
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return total[self.at + self.size] - total[self.at]


class Trainer:
    """Adam over windows."""

    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate, self.t, self.seen = net, rate, 0, 0
        self.m = [np.zeros_like(w) for w in net.w]
        self.v = [np.zeros_like(w) for w in net.w]

    def learn(self, texts: list[np.ndarray]) -> None:
        laid = Lanes(texts, LANES, self.net.classes)
        h = np.zeros((len(laid.load), self.net.hidden), np.float32)
        for _, x, y, mask in laid.windows(WINDOW):
            grads, h = self.net.gradients(x, y, mask, h[: x.shape[1]])
            self.seen += int(mask.sum())
            self.t += 1
            for w, m, v, g in zip(self.net.w, self.m, self.v, grads, strict=True):
                np.clip(g, -0.1, 0.1, out=g)
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                w -= np.float32(self.rate / (1 - 0.9**self.t)) * m / (np.sqrt(v / np.float32(1 - 0.99**self.t)) + np.float32(1e-6))


def network_scores(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text's classes."""
    laid = Lanes(texts, 2 * LANES, net.classes)
    out = np.zeros(len(laid.ys), np.float32)
    h = np.zeros((len(laid.load), net.hidden), np.float32)
    for places, x, y, mask in laid.windows(4 * WINDOW):
        states = net.steps(x, h[: x.shape[1]])
        h = states[-1]
        there = mask.reshape(-1) > 0
        out[places.reshape(-1)[there]] = net.log_probabilities(states.reshape(-1, net.hidden), y.reshape(-1))[there]
    return laid.sums(out)


class Vocabulary:
    """Numbers of the frequent words, and what their classes and probabilities are."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, v: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.n, self.v = n, v
        self.rest_n, self.rest_v = n - int(counts.sum()), v - len(words)
        self.classes, self.class_of, self.in_class = 0, np.zeros(0, np.int32), np.zeros(0)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each word hash, or the vocabulary's size for other words."""
        n = len(self.words)
        if not n:
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), n - 1)
        return np.where(self.words[at] == words, at, n)

    def set_classes(self, by_group: np.ndarray) -> None:
        """Classes from the counts of each word in each group of documents."""
        n = len(self.words)
        share = (by_group + 0.01) / (by_group.sum(0) + 1)
        group = share.argmax(1) if n else np.zeros(0, int)
        top = np.argsort(-self.counts, kind="stable")  # words are sorted, so ties go by word
        self.class_of = np.zeros(n + 1, np.int32)
        singles = set(top[:SINGLES].tolist()) | set(np.flatnonzero(self.words == END).tolist())
        k = 0
        for w in sorted(singles):
            self.class_of[w], k = k, k + 1
        rest = top[[w not in singles for w in top.tolist()]] if n else top
        for g in range(by_group.shape[1]):
            own = rest[group[rest] == g]
            if len(own):
                mass = np.cumsum(np.sqrt(self.counts[own]))
                part = np.minimum((mass / mass[-1] * RANGES).astype(int), RANGES - 1)
                for p in np.unique(part):
                    self.class_of[own[part == p]], k = k, k + 1
        self.class_of[n] = k
        self.classes = k + 1
        total = np.bincount(self.class_of[:n], weights=self.counts, minlength=self.classes)
        self.in_class = np.append(np.log10(self.counts / total[self.class_of[:n]]), -math.log10(self.rest_n + self.rest_v + 1))


def count_words(stored: DataFrame) -> DataFrame:
    """(word, c): training counts of all words, and of the end, in stored chunks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in read_chunks(batches):
            c = np.bincount(x.at[np.repeat(x.part >= 0, x.size)], minlength=len(x.words))
            there = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(x.words[there].view(np.int64)), pa.array(c[there])], names=["word", "c"])

    return stored.mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def anchor_vectors(x: Chunk, anchors: np.ndarray) -> np.ndarray:
    """A unit vector for each document of a chunk: roots of the shares of the anchors among its words."""
    n = len(anchors)
    at = np.minimum(np.searchsorted(anchors, x.words), n - 1)
    of = np.where(anchors[at] == x.words, at, n)[x.at]
    v = np.bincount(x.document * (n + 1) + of, minlength=len(x.size) * (n + 1)).reshape(-1, n + 1)[:, :n]
    return np.sqrt(v / np.maximum(v.sum(1, keepdims=True), 1))


def document_groups(stored: DataFrame, anchors: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Centres of groups of training documents by their use of the anchors: k-means whose rounds run over all of them.

    The first centres are documents far from one another among some FIRST_CENTRES with the least hashes.
    """
    n = len(anchors)
    train = stored.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first()["n"]
    below = max(1, PARTS * FIRST_CENTRES // max(train, 1))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in read_chunks(batches):
            own = np.flatnonzero((x.part >= 0) & (x.part < below))
            v = anchor_vectors(x, anchors)[own]
            yield pa.RecordBatch.from_arrays([pa.array(x.part[own], pa.int32()), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["part", "x"])

    found = stored.mapInArrow(first, "part int, x array<double>").orderBy("part", "x").limit(FIRST_CENTRES).toArrow()
    x = np.array(found.column("x").to_pylist()).reshape(-1, n)
    if not len(x):
        return np.zeros((groups, n))
    centres = [x[0]]
    while len(centres) < groups:  # the point furthest from those taken
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, 1))])
    c = np.array(centres)
    for _ in range(CENTRE_ROUNDS):

        def add(batches: Iterator[pa.RecordBatch], c=c) -> np.ndarray:
            total = np.zeros((groups, n))
            for x in read_chunks(batches):
                v = anchor_vectors(x, anchors)[x.part >= 0]
                own = (v @ c.T).argmax(1)
                total += np.eye(groups)[own].T @ v
            return total

        total = summed(stored, add, (groups, n), np.float64)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-9), c)
    return c


def fit(stored: DataFrame, counts: DataFrame) -> tuple[Vocabulary, Network]:
    """Vocabulary and trained network of the training rows in stored chunks; counts is a stored table (word, c)."""
    spark = stored.sparkSession
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts, VOCABULARY)
    vocab = Vocabulary(top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy(), sums["n"], sums["v"])
    common = np.lexsort((vocab.words, -vocab.counts))[:ANCHORS]
    anchors = np.sort(vocab.words[common]) if len(common) else np.array([END])
    centres = document_groups(stored, anchors)
    sent = spark.sparkContext.broadcast(vocab)

    def by_group(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        vocab = sent.value
        n = len(vocab.words)
        total = np.zeros((n + 1) * GROUPS, np.int64)
        for x in read_chunks(batches):
            group = (anchor_vectors(x, anchors) @ centres.T).argmax(1)
            train = np.repeat(x.part >= 0, x.size)
            key = vocab.numbers(x.words)[x.at[train]] * GROUPS + np.repeat(group, x.size)[train]
            total += np.bincount(key, minlength=len(total))
        return total.reshape(n + 1, GROUPS)[:n]

    vocab.set_classes(summed(stored, by_group, (len(vocab.words), GROUPS), np.int64).astype(float))
    sent.destroy()
    net = Network(vocab.classes)
    sent = spark.sparkContext.broadcast(vocab)
    sizes = [w.size for w in net.w]
    for k, folds in enumerate(ROUNDS):

        def train_task(batches: Iterator[pa.RecordBatch], k=k, folds=folds, weights=net.w) -> np.ndarray | None:
            vocab = sent.value
            trainer = Trainer(Network(vocab.classes, weights=[w.copy() for w in weights]), RATE / (1 + k))
            texts: list[np.ndarray] = []
            n = 0
            for x in read_chunks(batches):
                kind = vocab.class_of[vocab.numbers(x.words)]
                for i in np.flatnonzero((x.part >= 0) & np.isin(x.part % 16, folds)).tolist():
                    own = kind[x.at[x.ends[i] - x.size[i] : x.ends[i]]]
                    texts += [own[k : k + SEGMENT] for k in range(0, len(own), SEGMENT)]
                    n += len(own)
                if n > BATCH:
                    trainer.learn(texts)
                    texts, n = [], 0
            if texts:
                trainer.learn(texts)
            if trainer.seen:
                return np.append(np.concatenate([w.reshape(-1) for w in trainer.net.w]).astype(float) * trainer.seen, trainer.seen)
            return None

        total = summed(stored, train_task, (sum(sizes) + 1,), np.float64)
        if total[-1]:
            parts = np.split((total[:-1] / total[-1]).astype(np.float32), np.cumsum(sizes)[:-1])
            net.w = [p.reshape(w.shape) for p, w in zip(parts, net.w, strict=True)]
    sent.destroy()
    return vocab, net


def score_chunks(stored: DataFrame, counts: DataFrame, vocab: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document of the stored chunks."""
    spark = stored.sparkSession
    sent = spark.sparkContext.broadcast((vocab, net))
    schema = "row long, doc_id long, n_tokens long, known long, base double, score double, words array<bigint>, times array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab, net = sent.value
        other, row = len(vocab.words), (TaskContext.get().partitionId() + 1) << 40
        one = np.append(np.log10(vocab.counts + 1.0), 0.0)  # of other words, the join adds it

        def finish(held: list[Chunk]) -> Iterator[pa.RecordBatch]:
            nonlocal row
            numbers = [vocab.numbers(x.words) for x in held]
            texts = [kind[x.at[e - n : e]] for x, own in zip(held, numbers, strict=True) for kind in [vocab.class_of[own]] for e, n in zip(x.ends.tolist(), x.size.tolist(), strict=True)]
            found = network_scores(net, texts) / math.log(10)
            done = 0
            for x, own in zip(held, numbers, strict=True):
                m = len(x.size)
                far = own == other
                tokens = np.flatnonzero(far[x.at])
                pairs, times = np.unique(np.searchsorted(x.ends, tokens, side="right") * len(x.words) + x.at[tokens], return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(m + 1) * len(x.words)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in (x.words[pairs % len(x.words)].view(np.int64), times)]
                score = found[done : done + m] + x.sums(vocab.in_class[own])
                values = [np.arange(row, row + m), pa.array(x.ids, pa.int64()), x.size, x.sums((~far).astype(np.int64)), x.sums(one[own]), score]
                yield pa.RecordBatch.from_arrays([*map(pa.array, values), *lists], names=[c.split()[0] for c in schema.split(", ")])
                row, done = row + m, done + m

        held: list[Chunk] = []
        for x in read_chunks(batches):  # several at once, so that their long texts share the time
            held.append(x)
            if sum(len(y.at) for y in held) >= BATCH:
                yield from finish(held)
                held = []
        if held:
            yield from finish(held)

    scored = materialize(stored.mapInArrow(run, schema), "scores")
    pairs = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    rest = pairs.join(counts, "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    whole = math.log10(vocab.n + vocab.v + 1)
    return scored.drop("words", "times").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + more).alias("n_known"), (F.col("base") + logs - F.col("n_tokens") * whole).alias("base_score"), (F.col("score") + logs).alias("score")
    )


def score_documents(docs: DataFrame) -> tuple[DataFrame, Vocabulary, Network]:
    """doc_id, n_tokens, n_known, base_score and score of every (doc_id, text), with the fitted model."""
    stored = materialize(chunks(docs), "tokens")
    counts = materialize(count_words(stored), "word-counts")
    vocab, net = fit(stored, counts)
    return score_chunks(stored, counts, vocab, net), vocab, net


def op9_recurrent_model(spark, sf_dir: str) -> DataFrame:
    """Every document's log probability by the recurrent model, and by the counts alone."""
    out, vocab, _ = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(int(vocab.n)).cast("long").alias("train_tokens"), "base_score", "score")
