"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fit, on at most `sample` labelled rows of each class, the ones with the smallest hashes: all their terms (whole
lower-cased words without marks around them) are the features. Document frequencies of these terms are counted over all documents; a
term's weight is its inverse document frequency times a factor from 0 to 1 that grows with the chi-square of its counts
in the examples of either class, so terms that tell nothing about the label count little, and none is left out. Examples
become unit vectors in an inverted index: each term's postings lie in blocks of examples, with the largest weight of each
block. The bound on rows keeps the index small, so every task gets it.

Score: the cosine with every example of a block is bounded by the sum of the query's weights times the block's largest;
the most promising blocks come first, then those that may still hold one of the k nearest. The votes of the nearest,
weighted by cosine and drawn to the rate of examples without any term, become a probability by a logistic curve that is
fitted to the examples' own leave-one-out votes, with the classes weighted as in all labels. Labels of rows in the
held-out fold, and lang, source and doc_id, are never used.

Null texts are empty; they, and texts without any term of the examples, get the rate of such examples. Labels that are
null, not 0 or 1, or without a document are left out; several labels of one doc_id are the largest. With labels of one
class alone every score is that class, without any label 0. Terms are told apart by 64-bit hashes. Columns called score
or evidence are replaced; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, materialize, summed, table, texts_of

SAMPLE, NEIGHBOURS, BLOCK = 1000, 15, 128
#: Chi-square at which a term counts a quarter, and the least that any term counts.
HALF, LEAST = 20.0, 1e-4
_EDGES = b".,;:!?|\"'()[]{}<>*_-#/\\"


def term_of(word: bytes) -> bytes:
    """A word's term: the word without marks around it; empty for marks alone."""
    return word.strip(_EDGES)


class TermHashes(dict):
    """The 64-bit hash of each word's term, 0 for none; emptied when it grows past a bound."""

    LIMIT = 200_000

    def find(self, word: bytes) -> int:
        import xxhash

        term = term_of(word)
        return xxhash.xxh3_64_intdigest(term) if term else 0

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.find(word)
        return found

    def of_words(self, texts: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
        """The text's number and what is found for each word of the texts."""
        if len(self) > self.LIMIT:
            self.clear()
        words: list[bytes] = []
        size = []
        for t in texts:
            own = t.lower().split()
            words += own
            size.append(len(own))
        return np.repeat(np.arange(len(texts)), size), np.fromiter(map(self.__getitem__, words), kind, len(words))


class TermNumbers(TermHashes):
    """The number of each word's term among the known ones, -1 for others."""

    def __init__(self, known: np.ndarray):
        super().__init__()
        self.known = dict(zip(known.tolist(), range(len(known)), strict=True))

    def find(self, word: bytes) -> int:
        return self.known.get(super().find(word), -1)

    def of(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The distinct terms of each text and how often each occurs."""
        text, term = self.of_words(texts, np.int64)
        there = term >= 0
        each = max(len(self.known), 1)
        key, counts = np.unique(text[there] * each + term[there], return_counts=True)
        cut = np.searchsorted(key, np.arange(len(texts) + 1) * each)
        key %= each
        return [(key[a:b], counts[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The whole numbers of many ranges, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class BlockMaxIndex:
    """Unit vectors (terms, weights) by term: its postings in blocks of examples, each with the largest weight in it.

    vectors come in an order that puts like ones together, so that few blocks can hold the nearest of a query.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(vectors)
        self.blocks = -(-self.n // BLOCK)
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        order = np.lexsort((example, terms))
        terms, self.example, self.weight = terms[order], example[order].astype(np.int32), weights[order].astype(np.float32)
        pair = terms * max(self.blocks, 1) + self.example // BLOCK
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        self.start, self.size = first.astype(np.int64), np.diff(np.append(first, len(pair)))
        self.block = (self.example[first] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.pairs = np.searchsorted(terms[first], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k largest cosines above 0 and their examples; ties to the smaller number."""
        size = self.pairs[terms + 1] - self.pairs[terms] if self.n else np.zeros(0, np.int64)
        if not size.sum():
            return np.zeros(0), np.zeros(0, np.int64)
        at, q = ranges(self.pairs[terms], size), np.repeat(weights, size)
        block = self.block[at]
        bound = np.bincount(block, q * self.most[at], self.blocks)
        score = np.zeros(self.n)
        left = bound > 0
        kth = 0.0
        while True:  # the best blocks, then all that can still matter
            go = np.flatnonzero(left & (bound >= kth - 1e-6))
            if not len(go):
                break
            if kth == 0 and len(go) > 3:
                go = go[np.argsort(-bound[go], kind="stable")[:3]]
            left[go] = False
            chosen = np.zeros(self.blocks, bool)
            chosen[go] = True
            some = chosen[block]
            own = at[some]
            rows = ranges(self.start[own], self.size[own])
            score += np.bincount(self.example[rows], self.weight[rows] * np.repeat(q[some], self.size[own]), self.n)
            if without >= 0:
                score[without] = 0
            if np.count_nonzero(score) >= k:
                kth = float(np.partition(score, -k)[-k])
        found = np.flatnonzero((score > 0) & (score >= kth))
        top = found[np.lexsort((found, -score[found]))[:k]]
        return score[top], top


class Model:
    """Everything that a task needs to score a text."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], rate: float):
        """Sorted hashes of the terms and their weights; examples (doc_id, label, term numbers, counts); rate of label 1."""
        self.known, self.term_weight = known, weight
        share = np.mean([e[1] for e in examples]) if examples else 0.0
        # the sample has other class sizes than all labels: weights that restore them
        self.class_weight = np.array([(1 - rate) / max(1 - share, 1e-9), rate / max(share, 1e-9)])
        bare = np.array([y for _, y, t, _ in examples if not len(t)], int)
        self.bare = float((self.class_weight[bare] @ bare + rate) / (self.class_weight[bare].sum() + 1)) if examples else rate
        held = [(d, y, *self.vector(t, n)) for d, y, t, n in examples if len(t)]
        held.sort(key=lambda x: (int(x[2][np.argmax(x[3])]), x[0]))  # those with one strongest term together
        self.ids, self.labels = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        self.index = BlockMaxIndex([x[2:] for x in held], len(known))
        votes = np.array([self.vote(*self.index.nearest(x[2], x[3], NEIGHBOURS, without=e)) for e, x in enumerate(held)])
        self.slope, self.shift = self.calibrate(votes, self.labels)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.term_weight[terms]
        return terms, w / max(float(np.linalg.norm(w)), 1e-300)

    def vote(self, cosines: np.ndarray, near: np.ndarray) -> float:
        y = self.labels[near]
        w = cosines * self.class_weight[y]
        return float((w @ y + 0.5 * self.bare) / (w.sum() + 0.5))

    def calibrate(self, votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and shift of a logistic curve from votes to labels, by Newton's method with a small penalty."""
        if not len(y):
            return 1.0, 0.0
        x = np.stack([self.log_odds(votes), np.ones(len(y))], 1)
        w = self.class_weight[y]
        beta = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (w * (p - y)) + 1.0 * (beta - [1.0, 0.0])
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.eye(2), grad)
            beta -= step
            if np.abs(step).max() < 1e-9:
                break
        return float(max(beta[0], 0.05)), float(beta[1])

    @staticmethod
    def log_odds(v):
        v = np.clip(v, 1e-4, 1 - 1e-4)
        return np.log(v / (1 - v))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[float, int]]]:
        """Probability of label 1, and the nearest examples as (cosine, doc_id)."""
        cosines, near = self.index.nearest(*self.vector(terms, counts), NEIGHBOURS)
        if not len(near):
            return self.bare, []
        p = 1 / (1 + math.exp(-(self.slope * float(self.log_odds(self.vote(cosines, near))) + self.shift)))
        return p, list(zip(cosines.tolist(), self.ids[near].tolist(), strict=True))


def held_out(doc_id, folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def chi_squares(n0: np.ndarray, n1: np.ndarray, all0: int, all1: int) -> np.ndarray:
    """Chi-square of each term: in how many of the examples of either class it is."""
    n = all0 + all1
    return (n1 * (all0 - n0) - n0 * (all1 - n1)) ** 2 * n / ((n0 + n1) * (n - n0 - n1) * all0 * all1 + 1e-9)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of (doc_id, text) rows and their labels outside the held-out fold."""
    spark = docs.sparkSession
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if not sizes.get(0) or not sizes.get(1):
        return Model(np.zeros(0, np.uint64), np.zeros(0), [], rate)
    some = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]

    def examples_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes()
        for b in in_slices(batches):
            text, h = hashes.of_words(texts_of(b), np.uint64)
            found = [np.unique(h[(text == k) & (h > 0)], return_counts=True) for k in range(b.num_rows)]
            cols = [pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.int32).tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["doc_id", "y", "terms", "counts"])

    chosen = rows.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))  # 2 * sample rows at most
    held = materialize(chosen.mapInArrow(examples_of, "doc_id long, y int, terms binary, counts binary"), "examples").toArrow()
    unique = {d: (d, y, np.frombuffer(t, np.uint64), np.frombuffer(n, np.int32)) for d, y, t, n in sorted(zip(*(c.to_pylist() for c in held.columns), strict=True))}
    examples = list(unique.values())
    known, number = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for _, _, t, _ in examples)]), return_inverse=True)
    ends = np.cumsum([0, *(len(t) for _, _, t, _ in examples)])
    examples = [(d, y, number[a:b], n) for (d, y, _, n), a, b in zip(examples, ends[:-1], ends[1:], strict=True)]
    n0, n1 = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for _, y, t, _ in examples if y == k)]), minlength=len(known)).astype(float) for k in (0, 1))
    chi = chi_squares(n0, n1, sum(y == 0 for _, y, *_ in examples), sum(y == 1 for _, y, *_ in examples))
    sent = spark.sparkContext.broadcast(known)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """In how many of a task's documents each term is, and how many documents there are."""
        numbers, n = TermNumbers(sent.value), np.zeros(len(sent.value) + 1, np.int64)
        for b in in_slices(batches):
            held = [t for t, _ in numbers.of(texts_of(b))]
            n += np.bincount(np.concatenate(held), minlength=len(n))
            n[-1] += len(held)
        return n

    df = summed(rows.select("text"), frequencies, (len(known) + 1,), np.int64)
    sent.destroy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    return Model(known, idf * ((chi / (chi + HALF)) ** 2 + LEAST), examples, rate)


def score_documents(docs: DataFrame, model: Model, evidence: bool = True) -> DataFrame:
    """docs with score, and on request with evidence: the nearest examples, as cosine and doc_id."""
    fields = [f for f in docs.schema.fields if f.name not in ("score", "evidence")]
    names = [f.name for f in fields]
    near = T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("cosine", T.DoubleType()), T.StructField("doc_id", T.LongType())])))
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), *([near] if evidence else [])])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        numbers = TermNumbers(m.known)
        for b in in_slices(batches):
            found = [m.score(*x) for x in numbers.of(texts_of(b))]
            cols = [*b.columns, pa.array([s for s, _ in found], pa.float64())]
            if evidence:
                kind = pa.list_(pa.struct([("cosine", pa.float64()), ("doc_id", pa.int64())]))
                cols.append(pa.array([[{"cosine": s, "doc_id": d} for s, d in e] for _, e in found], kind))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def op10_nearest_examples(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, decision at 0.3, and evidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
