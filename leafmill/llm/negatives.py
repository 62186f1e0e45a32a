"""Hard-negative mining with an R-tree packed by sort-tile-recursive order.

1. Vectors become whole numbers; rows of one label with equal vectors are one point with its smallest ids (no list needs
   more of them), so copies, however many, are no large group.
2. Points are laid in tiles by Spark: sorted by label, by slabs of one coordinate and along a second one, dealt by range,
   and cut in blocks. Each block becomes one row that holds an R-tree: its leaves are tiles over further coordinates, a
   node has the bounding box of its points and the range of their labels. Nothing here needs a label or a slab in one task.
3. Anchors come in blocks of bounded size, which are sent to all tasks; the trees stay where they are. A box bounds an
   anchor's inner products from both sides, coordinate by coordinate. Each anchor walks a tree best first by a queue of
   upper bounds and leaves out boxes of the wrong label, boxes outside all of its score windows, and boxes strictly below
   the kth score of each window; what it has found in one tree of a task bounds its walk through the next.
4. A first walk finds an anchor's positives, which give the windows of the second one; Spark merges the lists of tasks.

Rows with a null id, label or vector, or with null or non-finite components, take no part, nor do empty vectors; vectors of
different lengths are not compared. Rows with the anchor's own id are not "other" rows. Rows of one id that differ are rows
of their own, and anchors of their own; those of one id and one score in a list are one. Fewer rows than asked for give
shorter lists. Scores beyond a long stop at its ends. Ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, shared_dir, table
from .topk import whole_numbers

#: Points of a block, anchors sent at once (and their bytes), bytes of the sample that places the tiles, and slabs at most.
BLOCK, ANCHORS, ANCHOR_BYTES, SAMPLE_BYTES, SLABS = 8192, 4096, 8 << 20, 4 << 20, 64
LEAF, FANOUT, AXES = 32, 8, 6
_LONG = 1 << 63


class RTree:
    """Points in tile order with their bounding boxes; nodes are leaves first, level by level up to the root, the last one."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.order = self._tiles(x, np.lexsort((labels,)), labels)
        self.x, self.labels = x[self.order], labels[self.order]
        edges = np.arange(0, len(x), LEAF)
        lo, hi = np.minimum.reduceat(self.x, edges), np.maximum.reduceat(self.x, edges)
        least, most = np.minimum.reduceat(self.labels, edges), np.maximum.reduceat(self.labels, edges)
        start, end = edges, np.minimum(edges + LEAF, len(x))
        levels, base = [(lo, hi, least, most, start, end)], 0
        self.leaves = len(edges)
        while len(levels[-1][0]) > 1:
            lo, hi, least, most, *_ = levels[-1]
            n = len(lo)
            edges = np.arange(0, n, FANOUT)
            levels.append((np.minimum.reduceat(lo, edges), np.maximum.reduceat(hi, edges), np.minimum.reduceat(least, edges), np.maximum.reduceat(most, edges), base + edges, base + np.minimum(edges + FANOUT, n)))
            base += n
        self.lo, self.hi, self.least, self.most, self.start, self.end = (np.concatenate(c) for c in zip(*levels, strict=True))

    @staticmethod
    def _tiles(x: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Sort-tile-recursive order of each label's rows; a slab is cut along the coordinate that varies most in it."""
        axes = min(AXES, x.shape[1])

        def tile(part: np.ndarray, at: int) -> Iterator[np.ndarray]:
            if len(part) <= LEAF or at == axes:
                yield part
                return
            part = part[np.argsort(x[part, int(x[part].astype(float).var(0).argmax())], kind="stable")]
            pages = -(-len(part) // LEAF)
            slabs = int(np.ceil(pages ** (1 / (axes - at)) - 1e-9))
            width = -(-pages // slabs) * LEAF
            for s in range(0, len(part), width):
                yield from tile(part[s : s + width], at + 1)

        edges = np.flatnonzero(np.diff(labels[rows])) + 1
        return np.concatenate([p for part in np.split(rows, edges) for p in tile(part, 0)])

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each row of q with the points of each box."""
        up, down, lo, hi = np.maximum(q, 0), np.minimum(q, 0), self.lo.astype(float), self.hi.astype(float)
        slack = 1e-9 * (1 + np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T)
        end = float(_LONG - 1024)  # scores stop there as well
        return np.minimum(up @ lo.T + down @ hi.T - slack, end), np.maximum(up @ hi.T + down @ lo.T + slack, -end)


class Window:
    """The best rows of an anchor whose scores are in a window; ties to the smaller id."""

    def __init__(self, lo: float | int, hi: float | int, k: int):
        self.lo, self.hi, self.k = lo, hi, k
        self.found: list[tuple[int, int]] = []
        self.least: float | int = lo  # scores below it are of no use

    def offer(self, scores, ids: list[list[int]], own: int) -> None:
        for j in np.flatnonzero((scores >= self.least) & (scores <= self.hi)).tolist():
            new = [(-int(scores[j]), v) for v in ids[j] if v != own]
            self.found = sorted({*self.found, *new})[: self.k]
            if len(self.found) == self.k:
                self.least = max(self.lo, -self.found[-1][0])


def scores_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    size = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * x.shape[1]
    if size < 2**53:
        return x.astype(float) @ q.astype(float)
    return x @ q if size < 2**62 else np.clip(x.astype(object) @ q.astype(object), -_LONG, _LONG - 1)


def search(tree: RTree, ids: list[list[int]], q: np.ndarray, own: list[int], labels: list[int], windows: list[list[Window]], same: bool) -> int:
    """Offer the anchors' windows the tree's points of the same label, or of the others; returns the number of points compared."""
    if not len(q):
        return 0
    low, high = tree.bounds(q.astype(float))
    wide = max(float(np.abs(tree.x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * q.shape[1], 1) >= 2**53
    x = tree.x if wide else tree.x.astype(float)
    points = q if wide else q.astype(float)
    mixed = tree.least < tree.most
    leaves, start, end, compared, root = tree.leaves, tree.start.tolist(), tree.end.tolist(), 0, len(tree.lo) - 1
    for a, mine in enumerate(windows):
        if not mine:
            continue
        label = labels[a]
        fit = ((tree.least <= label) & (tree.most >= label)) if same else (mixed | (tree.least != label))
        top = max(w.hi for w in mine)
        fit = (fit & (low[a] <= top)).tolist()
        upper, lower = high[a].tolist(), low[a].tolist()
        queue = [(-upper[root], root)] if fit[root] else []
        while queue:
            bound, node = heapq.heappop(queue)
            bound = -bound
            if bound < min(w.least for w in mine):
                break
            if not any(bound >= w.least and lower[node] <= w.hi for w in mine):
                continue
            s, e = start[node], end[node]
            if node >= leaves:
                for c in range(s, e):
                    if fit[c]:
                        heapq.heappush(queue, (-upper[c], c))
                continue
            compared += e - s
            scores = scores_of(x[s:e], points[a]) if wide else x[s:e] @ points[a]
            took = ids[s:e]
            if mixed[node]:
                right = np.flatnonzero((tree.labels[s:e] == label) == same)
                scores, took = scores[right], [took[j] for j in right.tolist()]
            for w in mine:
                w.offer(scores, took, own[a])
    return compared


def _axes(points: DataFrame, n: int) -> tuple[Column, Column]:
    """Slab and place along it of each point: the two coordinates that vary most in a bounded sample, and quantiles of the first."""
    dim = points.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
    sample = [r["v"] for r in points.orderBy(F.xxhash64("v"), "v").limit(max(64, min(20_000, SAMPLE_BYTES // (8 * dim)))).select("v").collect()]
    slab, second = F.lit(0), F.lit(0).cast("long")
    slabs = min(SLABS, int(np.ceil(np.sqrt(n / BLOCK))))
    lengths = sorted({len(v) for v in sample}, key=lambda d: -sum(len(v) == d for v in sample))[:16]
    for d in lengths:
        x = np.array([v for v in sample if len(v) == d], float)
        first, *rest = np.argsort(-x.var(0), kind="stable")[:2].tolist()
        cuts = sorted({int(c) for c in np.quantile(x[:, first], np.arange(1, slabs) / slabs)})
        own = F.size("v") == d
        if cuts:
            at = F.element_at("v", first + 1)
            slab = F.when(own, F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c, at=at: c <= at))).otherwise(slab)
        if rest:
            second = F.when(own, F.element_at("v", rest[0] + 1)).otherwise(second)
    return slab, second


_TREE = "dim int, least long, most long, n long, data binary"


def packed(points: DataFrame) -> DataFrame:
    """(dim, least, most, n, data): the R-trees over points (label, v, ids), stored."""
    slab, second = _axes(points, points.count())
    order = ["_dim", "label", "_slab", "_second", "_hash"]
    laid = points.select("label", "v", "ids", F.size("v").alias("_dim"), slab.alias("_slab"), second.alias("_second"), F.xxhash64("v").alias("_hash"))
    dealt = laid.repartitionByRange(partitions(points.sparkSession), *order).sortWithinPartitions(*order).select("label", "v", "ids")

    def grown(rows: list[tuple]) -> pa.RecordBatch:
        labels, vectors, ids = zip(*rows, strict=True)
        x, labels = np.array(vectors, np.int64), np.array(labels, np.int64)
        tree = RTree(x, labels)
        small = np.abs(x.astype(float)).max(initial=0) < 1 << 15
        tree.x = tree.x.astype(np.int16) if small else tree.x
        tree.lo, tree.hi = (c.astype(tree.x.dtype) for c in (tree.lo, tree.hi))
        data = pickle.dumps((tree, [ids[k] for k in tree.order.tolist()]))
        del tree
        cols = [pa.array([x.shape[1]], pa.int32()), *(pa.array([int(c)], pa.int64()) for c in (labels.min(), labels.max(), len(x))), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _TREE.split(", ")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) == BLOCK or len(row[1]) != len(held[0][1])):
                    yield grown(held)
                    held = []
                held.append(row)
        if held:
            yield grown(held)

    return materialize(dealt.mapInArrow(build, _TREE), "r-trees")


def _walk(trees: DataFrame, anchors, windows: Callable[[object], list[list[Window]]], same: bool) -> DataFrame:
    """(anchor, window, vec_id, score): each task's best rows in each window of each anchor sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = anchors.value
        own, labels, vectors = sent[:3]
        lists = windows(sent)
        sizes = np.array([len(v) for v in vectors])
        rows_of: dict[int, tuple[list[int], np.ndarray]] = {}
        for b in batches:
            for dim, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if dim not in rows_of:
                    at = np.flatnonzero(sizes == dim).tolist()
                    rows_of[dim] = at, np.array([vectors[k] for k in at], np.int64).reshape(len(at), dim)
                at, q = rows_of[dim]
                tree, ids = pickle.loads(data.as_py())
                tree.x = tree.x.astype(np.int64)
                for s in range(0, len(at), 512):
                    part = at[s : s + 512]
                    search(tree, ids, q[s : s + 512], [own[k] for k in part], [labels[k] for k in part], [lists[k] for k in part], same)
        out = [(a, w, v, -s) for a, mine in enumerate(lists) for w, x in enumerate(mine) for s, v in x.found]
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "window", "vec_id", "score"])

    return trees.select("dim", "data").mapInArrow(run, "anchor long, window long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k)


_PAIRS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows and anchors (vec_id, label, v).

    Negatives are of another label and score from low to high per cent of the positive.
    """
    spark = rows.sparkSession
    keep = max(positives + 1, negatives)
    place = F.row_number().over(W.partitionBy("label", "v").orderBy("vec_id"))
    points = rows.dropDuplicates(["vec_id", "label", "v"]).withColumn("_k", place).filter(F.col("_k") <= keep).groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = materialize(points, "labelled-points")
    trees = packed(points)
    discard(points)
    asked = materialize(anchors.dropDuplicates(["vec_id", "label", "v"]), "anchors")
    shape = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
    blocks = -(-shape["n"] // max(1, min(ANCHORS, ANCHOR_BYTES // (8 * shape["dim"]))))
    out = f"{shared_dir(spark)}/leafmill-negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], _PAIRS).write.parquet(out)
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)) == block).orderBy("vec_id", "label", "v")
        some = [(r["vec_id"], r["label"], r["v"]) for r in own.collect()]  # a block of bounded size
        if not some:
            continue
        ids, labels, vectors = (list(c) for c in zip(*some, strict=True))
        sent = spark.sparkContext.broadcast((ids, labels, vectors))
        near = trees.filter(F.array_size(F.filter(F.array(*map(F.lit, sorted(set(labels)))), lambda x: x.between(F.col("least"), F.col("most")))) > 0) if len(set(labels)) <= 1000 else trees
        found = _first(_walk(near, sent, lambda s: [[Window(-float("inf"), float("inf"), positives)] for _ in s[0]], True), positives)
        good = found.select("anchor", "vec_id", "score").collect()  # `positives` rows an anchor of the block at most
        scores: list[list[int]] = [[] for _ in ids]
        for p in sorted({(r["anchor"], r["score"]) for r in good}):
            scores[p[0]].append(p[1])
        sent_too = spark.sparkContext.broadcast((ids, labels, vectors, scores))

        def windows(s, low=low, high=high, negatives=negatives) -> list[list[Window]]:
            return [[Window(-(-low * p // 100), high * p // 100, negatives) for p in mine] for mine in s[3]]

        hard = _first(_walk(trees, sent_too, windows, False), negatives)
        pairs = [(r["anchor"], scores[r["anchor"]].index(r["score"]), ids[r["anchor"]], r["vec_id"], r["score"]) for r in good]
        known = spark.createDataFrame(pairs, "anchor long, window long, anchor_id long, positive_id long, positive_score long")
        listed = hard.join(known, ["anchor", "window"])
        listed.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        sent.destroy()
        sent_too.destroy()
    discard(trees, asked)
    return spark.read.schema(_PAIRS).parquet(out)


def op12_rtree_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives for every anchor, rows whose id is divisible by 100, of the rows with relabelled ones among them."""
    rows = table(spark, sf_dir, "embeddings").filter("label IS NOT NULL")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vectors = whole_numbers(rows.select("vec_id", label.alias("_label"), "embedding"), keep=["_label"]).withColumnRenamed("_label", "label")
    return hard_negatives(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), anchors AS (
  SELECT row_number() OVER () AS a, * FROM v WHERE vec_id % 100 = 0
), scores AS (
  SELECT a, q.vec_id AS anchor_id, q.label = p.label AS same, p.vec_id, list_dot_product(q.v, p.v)::BIGINT AS score
  FROM anchors q JOIN v p ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
), positives AS (
  SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS rank FROM (SELECT DISTINCT * FROM scores WHERE same)) WHERE rank <= 5
), negatives AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, positive_id, positive_score ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN (SELECT DISTINCT a, vec_id, score FROM scores WHERE NOT same) s
    ON p.a = s.a AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
