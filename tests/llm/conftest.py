import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, score string, n int, key string"


def sample_rows(seed: int = 3, n: int = 120):
    """Null, empty and very long texts, repeated rows, null and equal ids, copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(90))
    line = "Common Line " + "x" * 30
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 160)))
        if i % 5 == 0:
            t = t + "\n" + line
        if i % 7 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        rows.append([i, t])
    for i in range(12):  # copies and near copies
        rows.append([n + i, rows[i][1]])
        w = rows[i + 20][1].split(" ")
        rows.append([n + 20 + i, " ".join([*w[:-1], "changed"])])
    rows += [[900, None], [901, ""], [902, "   \n \t"], [903, "\n\n"], [904, "one"], [905, "ONE"], [906, "a" * 900], [907, "ab " * 9000], [908, "😀é" * 300], [909, passage], [910, passage]]
    rows += [[None, passage + " tail"], [None, None], [1, rows[1][1]], [1, rows[1][1]]]
    return [(d, t, "en", "s", len(t or ""), "x", "y", 1, None) for d, t in rows]


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(docs, no_docs, spark, tmp_path_factory):
    """Folders of tables as the queries read them: one with the sample rows, one empty."""
    out = []
    for k, d in enumerate((docs, no_docs)):
        at = str(tmp_path_factory.mktemp(f"tables{k}"))
        d.write.parquet(f"{at}/documents.parquet")
        labels = [(i, 1, int(i % 6 == 0)) for i in range(0, 130)] + [(5, 1, None), (None, 1, 1), (100000, 0, 1)]
        spark.createDataFrame(labels if not k else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        pages = [(1, "http://a.example/x", "<html><body><nav><a href='/'>m</a></nav><article><h1>T &amp; u</h1><p>a<p>b<b>c</article></body></html>"), (2, None, None), (3, "http://a.example/y", ""), (None, "x", "<p>only")]
        spark.createDataFrame(pages if not k else [], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
        vectors = [(i, [((i * j) % 17) / 17 for j in range(1, 9)], 0) for i in range(300)] + [(300 + i, [0.5] * 8, 0) for i in range(40)]
        vectors += [(900, None, 0), (901, [], 0), (902, [None, 1.0], 0), (903, [float("nan")] * 8, 0), (950, [1.0, 2.0], 0), (None, [0.5] * 8, 0), (3, [3 * j % 17 / 17 for j in range(1, 9)], 0)]
        spark.createDataFrame(vectors if not k else [], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
        turns = [(c, t, ("user", "assistant")[t % 2], f"Line {c} {t}.") for c in range(40) for t in range(5)] + [(None, None, None, None), (3, 3, "assistant", "Line 3 3."), (41, None, "", ""), (41, 7, "tool", "x" * 30000)]
        spark.createDataFrame(turns if not k else [], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
        out.append(at)
    return out
