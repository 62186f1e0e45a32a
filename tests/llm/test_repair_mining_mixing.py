"""Operators 11 to 13 against their SQL on hostile tables, and against plain loops where SQL can't go."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import mixing, negatives, repair

CONVERSATIONS = "conv_id long, turn long, role string, text string, n int, runs string"


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def sql_rows(sql, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rel = con.sql(sql)
    order = sorted(rel.columns)
    return sorted((tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall()), key=repr)


def conversation_rows(seed=5):
    rng = random.Random(seed)
    texts = ["Fine.", "Cut off", "", " \t\n", "Why?", "No!", "…", "x" * 5000 + ".", "again and again."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "sys", "ua"]
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 9)):
            role = ("system" if t == 0 and rng.random() < 0.3 else ("user", "assistant")[t % 2]) if rng.random() < 0.8 else rng.choice(roles)
            rows.append((c, t if rng.random() < 0.95 else None, role, rng.choice(texts) if rng.random() < 0.6 else f"text {c} {t}."))
    for t in range(1500):  # a third of all rows
        rows.append((7000, t * (3 if t > 900 else 1), ("user", "assistant")[t % 2 if t % 11 else 0], f"line {t % 700}" + ".!"[t % 2] * (t % 5 > 0)))
    rows += [(7001, 4, "user", "Same row.")] * 400 + [(7002, None, "assistant", "Same.")] * 30 + [(None, None, None, None)] * 3 + [(None, 2, "user", "a."), (7003, -(1 << 62), "user", "a."), (7003, 1 << 62, "assistant", "b.")]
    rows += [(7004, 3, r, t) for r in ("user", "assistant") for t in ("b.", "a.", "a")]
    rng.shuffle(rows)
    return [(*r, 1, "x") for r in rows]


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("conversations"))
    spark.createDataFrame(conversation_rows(), CONVERSATIONS).repartition(6).write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("segment", [4096, 5])
def test_repair_equals_sql(spark, conversations, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment)
    assert rows_of(repair.op11_run_length_repair(spark, conversations)) == sql_rows(repair.OP11_SQL, conversations, "conversations")


def test_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op11_run_length_repair(spark, str(tmp_path)).count() == 0


def _cheapest(symbols):
    """All edits of a short list of symbols, by brute force: the least cost, then the least audit."""
    found = []
    letter = {"s": 0, "u": 1, "a": 2}

    def walk(k, state, cost, audit, inserts):
        if found and cost > min(found)[0]:
            return
        if k == len(symbols) and state in (0, 3):
            found.append((cost, audit))
        if inserts < 2:
            walk(k, repair.NEXT[state], cost + 5, audit + "I", inserts + 1)
        if k < len(symbols):
            (c, fault) = symbols[k]
            walk(k + 1, state, cost + 2, audit + "D", 0)
            if fault != 2:
                more = 5 * (fault == 1)
                if c in letter and (c, state) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)}:
                    walk(k + 1, {"s": 1, "u": 2, "a": 3}[c], cost + more, audit + "K", 0)
                walk(k + 1, repair.NEXT[state], cost + more + 1, audit + "R", 0)

    walk(0, 0, 0, "", 0)
    return min(found)


def test_runs_find_the_cheapest_edits():
    rng = random.Random(2)
    for _ in range(250):
        symbols = []
        while len(symbols) < rng.randint(0, 6):
            f = rng.choice([0, 0, 0, 1, 2])
            symbols += [("x" if f == 2 else rng.choice("suax"), f)] * rng.randint(1, 3)
        symbols = symbols[:6]
        runs = tuple((s, len(list(g))) for s, g in itertools.groupby(symbols))
        assert (repair.total(runs), repair.unrolled(runs, repair.END, 0, True)[0]) == _cheapest(symbols), symbols


def test_a_run_of_a_million_is_advanced_by_powers():
    runs = ((("u", 0), 1_000_000), (("a", 0), 1))
    audit, state = repair.unrolled(runs, repair.END, 0, True)
    assert len(audit) == 1_000_001 and state == 3 and repair.total(runs) == 499_999 + 2
    single = tuple(itertools.repeat(("u", 0), 64))
    assert repair.unrolled(tuple((s, 1) for s in single), repair.END, 0, True) == repair.unrolled(((("u", 0), 64),), repair.END, 0, True)
    whole = repair.matrix(runs)
    assert min(whole[0][s] + repair.END[s] for s in range(4)) == repair.total(runs)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, v string, ids int"


def embedding_rows(seed=4, n=1500, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        x = (centres[i % 12] + 0.1 * rng.normal(size=dim)).round(2)
        rows.append((i, x.tolist(), int(rng.integers(10)) if i % 3 else 4))
    rows += [(5000 + i, [0.5] * dim, 4) for i in range(400)] + [(9000 + i, [0.5] * dim, 5 + i % 2) for i in range(30)]
    rows += [(100, rows[100][1], rows[100][2])] * 3 + [(200, rows[7][1], 3), (200, rows[8][1], 3), (None, [0.5] * dim, 4), (20000, None, 1), (20100, [], 1), (20200, [0.5] * dim, None)]
    rows += [(20300, [None, *[0.1] * (dim - 1)], 1), (20400, [float("nan")] * dim, 1), (20500, [float("inf")] * dim, 1), (20600, [1.0, 2.0], 1), (20601, [1.0, 2.0], 1), (20602, [0.5, 1.0], 2), (-700, [0.25] * dim, 9), (20700, [0.0] * dim, 77)]
    return [(*r, "x", 1) for r in rows]


@pytest.fixture(scope="module")
def embeddings(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("embeddings"))
    spark.createDataFrame(embedding_rows(), EMBEDDINGS).repartition(5).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize(("block", "anchors"), [(8192, 4096), (100, 7)])
def test_negatives_equal_sql(spark, embeddings, monkeypatch, block, anchors):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    found = rows_of(negatives.op12_rtree_negatives(spark, embeddings))
    assert found == sql_rows(negatives.OP12_SQL, embeddings, "embeddings") and len(found) > 300


def test_negatives_of_nothing(spark, tmp_path):
    spark.createDataFrame([], EMBEDDINGS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert negatives.op12_rtree_negatives(spark, str(tmp_path)).count() == 0


def test_boxes_hold_scores_and_leave_out_most_of_clustered_points():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(64, 12)) * 300
    x = (centres[rng.integers(64, size=8000)] + rng.normal(size=(8000, 12)) * 8).astype(np.int64)
    labels = np.sort(rng.integers(3, size=8000))
    tree = negatives.RTree(x, labels)
    q = x[rng.integers(8000, size=40)]
    low, high = tree.bounds(q.astype(float))
    products = q @ tree.x.T
    for k in range(tree.leaves):
        s, e = tree.start[k], tree.end[k]
        assert (low[:, k] <= products[:, s:e].min(1)).all() and (high[:, k] >= products[:, s:e].max(1)).all()
    lists = [[negatives.Window(0, int(p.max()) // 2, 10)] for p in products]
    ids = [[int(v)] for v in tree.order]
    compared = negatives.search(tree, ids, q, [-1] * 40, [1] * 40, lists, False)
    assert compared < 0.3 * 40 * 8000
    for p, (w,) in zip(products, lists, strict=True):
        fits = sorted((-int(s), int(v)) for s, v, lab in zip(p, tree.order, tree.labels, strict=True) if lab != 1 and 0 <= s <= w.hi)
        assert w.found == fits[:10]


def test_scores_beyond_a_long_stop_at_its_ends(spark):
    big = (1 << 62) + 3
    rows = [(0, 1, [big, 2]), (1, 1, [big, 1]), (2, 2, [1, 0]), (3, 2, [big // 4, 0])]
    vectors = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    found = negatives.hard_negatives(vectors, vectors.filter("vec_id = 0"), low=0, high=100).collect()
    assert {(r["positive_score"], r["negative_id"], r["negative_score"]) for r in found} == {((1 << 63) - 1, 3, (1 << 63) - 1), ((1 << 63) - 1, 2, big)}


DOCS = "doc_id long, text string, lang string, source string, size string, target int, _h int"


def mixing_rows(seed=6):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), ["", "b", "é", "Z", "a", None, "tiny", "zero"][min(7, int(rng.expovariate(0.5)))]) for i in range(900)]
    rows = [(d, "" if s == "zero" else t, s) for d, t, s in rows]
    rows += [(5000, "one", "copies")] * 600 + [(None, "two words", None)] * 40 + [(None, None, "b"), (6000, None, None), (6001, "\x0b\t w x ", "b"), (6002, "long " * 30000, "b")]
    return [(d, t, "en", s, "x", 1, 2) for d, t, s in rows]


@pytest.fixture(scope="module")
def mixed_docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("mixing"))
    spark.createDataFrame(mixing_rows(), DOCS).repartition(7).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize(("slices", "exact", "small"), [(4096, 4096, 50_000), (8, 5, 2)])
def test_mix_equals_sql(spark, mixed_docs, monkeypatch, slices, exact, small):
    for name, value in (("SLICES", slices), ("EXACT", exact), ("SMALL", small)):
        monkeypatch.setattr(mixing, name, value)
    found = rows_of(mixing.op13_water_filling(spark, mixed_docs))
    assert found == sql_rows(mixing.OP13_SQL, mixed_docs, "documents")
    taken = Counter()
    for _, size, source_size, taken_words, goal in found:  # columns by name
        assert 0 <= taken_words <= 2 * size and goal <= 2 * source_size
        taken[source_size, goal] += taken_words
    assert all(abs(taken[k] - k[1]) <= 1 for k in taken)


def test_water_filling_clamps_in_rounds(spark):
    rows = [("a", 10, 3), ("b", 100, 1), ("c", 1000, 2), ("d", 0, 3), ("e", 10000, 1)]
    out = mixing.water_filling(spark.createDataFrame(rows, "s string, source_size long, weight int"), (3, 2), 2)
    got = {r["s"]: r["target"] for r in out.collect()}
    assert got == {"a": 20.0, "b": 200.0, "c": 2000.0, "d": 0.0, "e": 14445.0}


def test_mix_of_nothing_and_of_empty_texts(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/0/documents.parquet")
    assert mixing.op13_water_filling(spark, f"{tmp_path}/0").count() == 0
    spark.createDataFrame([(1, None, "en", "s", "", 1, 1), (2, "", "en", None, "", 1, 1)], DOCS).write.parquet(f"{tmp_path}/1/documents.parquet")
    assert {tuple(r) for r in mixing.op13_water_filling(spark, f"{tmp_path}/1").collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


def test_copies_have_the_words_taken(spark, mixed_docs):
    docs = mixing.sized(spark.read.parquet(f"{mixed_docs}/documents.parquet").filter("doc_id < 5000 OR doc_id = 6002"))
    mixed = mixing.mix(docs.select("doc_id", "source", "size", "text")).filter("doc_id IS NOT NULL")
    texts = mixing.copies(mixed)
    words = {r["doc_id"]: r["n"] for r in texts.groupBy("doc_id").agg(F.sum(mixing.words("text")).alias("n")).collect()}
    taken = {r["doc_id"]: r["taken"] for r in mixed.filter("taken > 0").collect()}
    assert words == taken
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(whole[r["doc_id"]].startswith(r["text"]) for r in texts.collect())


def test_native_plan(spark, mixed_docs):
    plan = mixing.op13_water_filling(spark, mixed_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan


def test_hash_of_the_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind.", 1), (1, 1, "assistant", "Hello.", 1), (1, 2, "assistant", "Hi.", 1)]
    r = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")).first()
    assert (r["audit"], r["cost"], r["illegal"]) == ("KRK", 1, 2)
    assert r["repaired_sha256"] == hashlib.sha256(b"system:Be kind.\nuser:Hello.\nassistant:Hi.").hexdigest()
