"""Exact top-k search by inner product with dual cover trees.

1. Vectors become whole numbers. Rows with equal vectors are one point of the index, with the k + 1 smallest ids (no
   query can have more of them in its result), so copies, however many, are no large group.
2. A bounded sample of points are cell centres; Spark deals points and queries to the cell of the nearest centre, and a
   large cell to several blocks. Each block becomes one row that holds its cover tree, built once.
3. A cover tree's node has a centre and a covering radius; its children are a greedy net of centres that lie more than
   radius / BASE apart and cover it. A node that would need more than FANOUT of them is a leaf: it does not split.
4. Each query block first searches one data block of its own cell, which gives every query a kth score to start with.
   Then it goes to the cells that can hold something better: <cq,cp> + |cq| rp + |cp| rq + rq rp bounds every inner
   product of two balls. Query blocks meet a data block in groups of bounded size.
5. The search walks both trees together. A pair of nodes is left out when its bound is below the worst kth score of the
   node's queries; else the wider of the two is split, and two leaves are compared by one matrix product.
6. Spark merges the k best of each query and data block.

Vectors that are null or empty or hold null or non-finite components take no part, nor do rows without id; vectors of
different lengths are not compared. Rows with the query's own id are not its candidates. Fewer than k candidates give
fewer rows. Ties go to the smaller id; repeated rows are one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows of a data block and of a query block, query blocks that meet a data block at once, and cells with their bytes at most.
DATA_BLOCK, QUERY_BLOCK, TOGETHER, CELLS, CENTRE_BYTES = 8192, 1024, 16, 1024, 8 << 20
LEAF, FANOUT, BASE = 16, 96, 1.5


class Tree:
    """A cover tree over the rows of x; its nodes are ranges of the reordered rows, parents before children."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        y = x.astype(np.float64)
        norms = (y * y).sum(1)

        def distances(at: int, rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(norms[rows] + norms[at] - 2 * (y[rows] @ y[at]), 0)) * (1 + 1e-9) + 1e-6

        first = int(((y - y.mean(0)) ** 2).sum(1).argmin())
        nodes = [[0, len(x), first, float(distances(first, self.order).max()), 0, 0]]
        at = 0
        while at < len(nodes):
            start, end, centre, radius, *_ = nodes[at]
            rows = self.order[start:end]
            if end - start > LEAF and radius > 1e-3:
                best, owner = distances(centre, rows), np.zeros(end - start, np.int64)
                net = [centre]
                while best.max() > radius / BASE and len(net) <= FANOUT:
                    net.append(int(rows[best.argmax()]))
                    d = distances(net[-1], rows)
                    less = d < best
                    owner[less], best[less] = len(net) - 1, d[less]
                if 1 < len(net) <= FANOUT:
                    by = np.argsort(owner, kind="stable")
                    self.order[start:end] = rows[by]
                    edges = np.searchsorted(owner[by], np.arange(len(net) + 1)) + start
                    nodes[at][4:] = [len(nodes), len(nodes) + len(net)]
                    nodes += [[int(a), int(b), c, float(best[owner == k].max()), 0, 0] for k, (a, b, c) in enumerate(zip(edges[:-1], edges[1:], net, strict=True))]
            at += 1
        self.x = x[self.order]
        self.start, self.end, centres, self.radius, self.child, self.last = (np.array(c) for c in zip(*nodes, strict=True))
        self.centre = y[centres]
        self.norm = np.sqrt((self.centre**2).sum(1))


class Best:
    """The k best candidates of each query so far; ties to the smaller id."""

    def __init__(self, own: np.ndarray, k: int):
        self.k, self.own = k, own
        self.found: list[list[tuple[int, int]]] = [[] for _ in own]
        self.kth = np.full(len(own), -np.inf)
        self.compared = 0

    def offer(self, at: int, scores: np.ndarray, ids: list[list[int]]) -> None:
        """Scores of the queries from `at` on with points of these ids."""
        self.compared += scores.size
        n, k = scores.shape[1], self.k
        least = self.kth[at : at + len(scores)]
        if n > k + 1:  # the own row may be among the first
            least = np.maximum(least, np.partition(scores, n - k - 1, axis=1)[:, n - k - 1])
        query, point = np.nonzero(scores >= least[:, None])
        for i in np.unique(query).tolist():
            q, mine = at + i, point[query == i].tolist()
            new = ((-int(scores[i, j]), v) for j in mine for v in ids[j] if v != self.own[q])
            self.found[q] = sorted({*self.found[q], *new})[:k]
            if len(self.found[q]) == k:
                self.kth[q] = -self.found[q][-1][0]


def dual_search(q: Tree, p: Tree, ids: list[list[int]], best: Best) -> None:
    """Offer every point of p that may be among a query's k best; ids by point and queries in the trees' orders."""
    whole = max(float(np.abs(q.x).max()) * float(np.abs(p.x).max()) * q.x.shape[1], 1) < 2**52
    x, y = (t.x.astype(np.float64) if whole else t.x for t in (q, p))
    slack = 1e-9 * (1 + (q.norm[0] + q.radius[0]) * (p.norm[0] + p.radius[0]))

    def visit(a: int, nodes: np.ndarray) -> None:
        """Compare a query node with data nodes, the most promising first."""
        bound = p.centre[nodes] @ q.centre[a] + q.norm[a] * p.radius[nodes] + (p.norm[nodes] + p.radius[nodes]) * q.radius[a] + slack
        for j in np.argsort(-bound, kind="stable").tolist():
            b, lo, hi = int(nodes[j]), int(q.start[a]), int(q.end[a])
            if bound[j] < best.kth[lo:hi].min():  # the group's worst kth score
                return
            if p.last[b] and (p.radius[b] >= q.radius[a] or not q.last[a]):
                visit(a, np.arange(p.child[b], p.last[b]))
            elif q.last[a]:
                for c in range(q.child[a], q.last[a]):
                    visit(c, np.array([b]))
            else:
                for s in range(int(p.start[b]), int(p.end[b]), 4096):
                    e = min(s + 4096, int(p.end[b]))
                    for u in range(lo, hi, 256):
                        best.offer(u, x[u : min(u + 256, hi)] @ y[s:e].T, ids[s:e])

    visit(0, np.array([0]))


def whole_numbers(df: DataFrame, vector: str = "embedding", scale: int = 256, keep: list[str] | None = None) -> DataFrame:
    """(vec_id, v) and the columns to keep of the rows whose vectors are whole: each component becomes floor(scale * component)."""
    x = F.col(vector)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return df.filter(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"), *(keep or []))


class Cells:
    """The nearest centre of a vector among those of its length; -1 for a length without centres."""

    def __init__(self, centres: list[list[int]]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(c) for c in centres}:
            own = [k for k, c in enumerate(centres) if len(c) == n]
            self.by_length[n] = np.array(own), np.array([centres[k] for k in own], float)

    def of(self, vectors: list[list[int]]) -> np.ndarray:
        out = np.full(len(vectors), -1, np.int64)
        size = np.array([len(v) for v in vectors])
        for n, (own, centres) in self.by_length.items():
            at = np.flatnonzero(size == n)
            if len(at):
                x = np.array([vectors[k] for k in at], float)
                out[at] = own[((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)]
        return out


def _dealt(rows: DataFrame, cells, names: list[str]) -> DataFrame:
    """rows with the cell of each vector v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.schema.get_field_index("v")).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array([len(x) for x in v], np.int32)), pa.array(cells.value.of(v))], names=[*names, "dim", "cell"])

    return rows.select(*names).mapInArrow(run, rows.select(*names).schema.add("dim", "integer").add("cell", "long"))


def _in_blocks(dealt: DataFrame, sizes: dict[tuple[int, int], int], most: int, key: str) -> DataFrame:
    """dealt with the block of each row in its cell, so that a block has some `most` rows."""
    parts = F.lit(1)
    large = [(d, c, -(-n // most)) for (d, c), n in sizes.items() if n > most]
    if large:
        spark = dealt.sparkSession
        known = F.broadcast(spark.createDataFrame(large, "dim int, cell long, parts int"))  # a row a cell at most
        dealt = dealt.join(known, ["dim", "cell"], "left")
        parts = F.coalesce("parts", F.lit(1))
    return dealt.withColumn("block", F.pmod(F.xxhash64(key), parts).cast("int")).drop("parts")


def _sizes(dealt: DataFrame) -> dict[tuple[int, int], int]:
    return {(r["dim"], r["cell"]): r["n"] for r in dealt.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell and length


_BLOCK = "dim int, cell long, block int, norm double, radius double, centre array<double>, data binary"


def _trees(rows: DataFrame, ids: str) -> DataFrame:
    """One row for each block of (v, ids): its cover tree with the ids in the tree's order."""

    def build(t: pa.Table) -> pa.Table:
        v = np.array(t.column("v").to_pylist(), np.int64)
        tree = Tree(v)
        small = np.abs(v).max() < 1 << 15
        tree.x = tree.x.astype(np.int16) if small else tree.x
        own = t.column(ids).to_pylist()
        data = pickle.dumps((tree, [own[k] for k in tree.order.tolist()]))
        values = [t.column(c)[0].as_py() for c in ("dim", "cell", "block")]
        values += [float(tree.norm[0]), float(tree.radius[0]), tree.centre[0].tolist(), data]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.binary()]
        return pa.table([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

    return rows.select("dim", "cell", "block", "v", ids).groupBy("dim", "cell", "block").applyInArrow(build, _BLOCK)


def _loaded(data: bytes) -> tuple[Tree, list]:
    tree, ids = pickle.loads(data)
    tree.x = tree.x.astype(np.int64)
    return tree, ids


def _rows(best: Best) -> Iterator[tuple[int, int, int]]:
    for q, found in zip(best.own.tolist(), best.found, strict=True):
        for s, v in found:
            yield q, v, -s


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products; both sides (vec_id long, v array<long>)."""
    spark = vectors.sparkSession
    first = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    points = vectors.dropDuplicates(["vec_id", "v"]).withColumn("_k", first).filter(F.col("_k") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = materialize(points, "points")
    shape = points.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
    wanted = max(1, min(-(-shape["n"] // DATA_BLOCK), CELLS, CENTRE_BYTES // (8 * shape["dim"])))
    centres = points.orderBy(F.xxhash64("v"), "v").limit(wanted).select("v")
    cells = spark.sparkContext.broadcast(Cells([r["v"] for r in centres.collect()]))  # CELLS vectors at most
    dealt = materialize(_dealt(points, cells, ["v", "ids"]), "dealt-points")
    sizes = _sizes(dealt)
    data = materialize(_trees(_in_blocks(dealt, sizes, DATA_BLOCK, "v"), "ids"), "data-trees")
    asked = materialize(_dealt(queries.dropDuplicates(["vec_id", "v"]), cells, ["vec_id", "v"]), "dealt-queries")
    asked = materialize(_trees(_in_blocks(asked, _sizes(asked), QUERY_BLOCK, "vec_id"), "vec_id"), "query-trees")

    # one data block of the own cell gives each query its first kth score
    home = data.filter("block = 0").select("dim", "cell", F.col("data").alias("points"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, cell, block, radius, norm, centre, q_data, p_data = (c.to_pylist() for c in b.columns)
            for r in range(b.num_rows):
                q, own = _loaded(q_data[r])
                best = Best(np.array(own, np.int64), k)
                if p_data[r] is not None:
                    p, ids = _loaded(p_data[r])
                    dual_search(q, p, ids, best)
                cols = [[dim[r]], [cell[r]], [block[r]], [norm[r]], [radius[r]], [centre[r]], [float(best.kth.min())], [pickle.dumps((q, best))]]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["dim", "cell", "block", "norm", "radius", "centre", "worst", "data"])

    started = asked.join(home, ["dim", "cell"], "left").select("dim", "cell", "block", "radius", "norm", "centre", "data", "points")
    started = materialize(started.mapInArrow(start, "dim int, cell long, block int, norm double, radius double, centre array<double>, worst double, data binary"), "started")

    # a ball for each cell: the first block's centre, and a radius that reaches over all of its blocks
    first_block = F.row_number().over(W.partitionBy("dim", "cell").orderBy("block")) == 1
    heads = data.withColumn("_head", first_block).filter("_head").select("dim", "cell", F.col("centre").alias("c"), F.col("norm").alias("n"))
    away = F.sqrt(F.aggregate(F.zip_with("centre", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    balls = data.select("dim", "cell", "block", "centre", "radius").join(heads, ["dim", "cell"]).groupBy("dim", "cell").agg(F.first("c").alias("c"), F.first("n").alias("n"), F.max(away + F.col("radius")).alias("radius"), F.collect_list("block").alias("blocks"))
    known = spark.sparkContext.broadcast([(r["dim"], r["cell"], np.array(r["c"]), r["n"], r["radius"], sorted(r["blocks"])) for r in balls.collect()])  # a row for each cell

    def goes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The data blocks that each query block has still to search."""
        for b in batches:
            for dim, cell, block, norm, radius, centre, worst in zip(*(c.to_pylist() for c in b.columns), strict=True):
                to = []
                for d, c, at, n, r, blocks in known.value:
                    if d == dim and float(at @ np.array(centre)) + norm * r + (n + r) * radius + 1e-6 * (1 + norm * n) >= worst:
                        to += [(c, x) for x in blocks if (c, x) != (cell, 0)]
                m = len(to)
                cols = [pa.array([dim] * m, pa.int32()), pa.array([c for c, _ in to], pa.int64()), pa.array([x for _, x in to], pa.int32()), pa.array([cell] * m, pa.int64()), pa.array([block] * m, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["dim", "cell", "block", "q_cell", "q_block"])

    salts = max(1, -(-started.count() // TOGETHER))
    pairs = started.drop("data").mapInArrow(goes, "dim int, cell long, block int, q_cell long, q_block int")
    keys = ("dim", "cell", "block", "group")
    pairs = materialize(pairs.withColumn("group", F.pmod(F.xxhash64("q_cell", "q_block"), F.lit(salts))), "block-pairs")
    left = data.select("dim", "cell", "block", "data").join(pairs.select(*keys).distinct(), ["dim", "cell", "block"]).toDF("in_dim", "in_cell", "in_block", "data", "in_group")
    right = pairs.join(started.select("dim", F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), F.col("data").alias("queries")), ["dim", "q_cell", "q_block"]).select(*keys, "queries")

    def table_of(rows) -> pa.Table:
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    def compare(points: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if points.num_rows and asked.num_rows:
            p, ids = _loaded(points.column("data")[0].as_py())
            for x in asked.column("queries"):
                q, best = pickle.loads(x.as_py())
                before = {*_rows(best)}
                dual_search(q, p, ids, best)
                rows.extend(r for r in _rows(best) if r not in before)
        return table_of(rows)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield from table_of(_rows(pickle.loads(x.as_py())[1])).to_batches()

    names = "query_id long, vec_id long, score long"
    found = left.groupBy("in_dim", "in_cell", "in_block", "in_group").cogroup(right.groupBy(*keys)).applyInArrow(compare, names).unionByName(started.select("data").mapInArrow(begun, names))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_dual_cover_trees(spark, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose id is divisible by 50."""
    vectors = whole_numbers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v, p.v)::BIGINT AS score
  FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
