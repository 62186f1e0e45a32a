"""The pipeline's stages against brute-force versions of what each decides."""

from collections import Counter

import corpus_pipeline as pipeline
from test_operators import brute_classes


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, docs, folder):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "line-dedup", "ngram-jaccard-join", "suffix-array-dedup", "best-fit-packing"]
    for n, f in pipeline.STAGES[:-1]:
        out = f(spark, docs, folder[0])
        assert out.columns == pipeline.COLUMNS, n
        assert f(spark, docs.limit(0), folder[1]).count() == 0
    assert pipeline.run(spark, folder[1]).count() == 0
    assert pipeline.run(spark, folder[0]).count() > 0


def test_one_document_of_each_class_stays(spark, docs, rows, folder):
    kept = rows_of(pipeline.drop_near_copies(spark, docs, folder[0]))
    found = brute_classes(rows)
    want = [(d, t) for d, t, *_ in rows if d is None or found[d][1] == d]
    assert Counter(map(repr, kept)) == Counter(map(repr, want))


def test_lines_stay_in_their_first_document(spark, docs, rows, folder):
    kept = rows_of(pipeline.drop_lines(spark, docs, folder[0]))
    line = "Common Line " + "x" * 30
    assert sum(line in (t or "") for _, t in kept) == 1 and any(line in (t or "") for d, t in kept if d == 0)
    assert {d for d, *_ in rows} == {d for d, _ in kept}


def test_repeats_go(spark, docs, rows, folder):
    kept = rows_of(pipeline.drop_repeats(spark, docs, folder[0]))
    seen = Counter((t or "").encode()[i : i + 200] for _, t, *_ in rows for i in range(len((t or "").encode()) - 199))
    assert not any(seen[(t or "").encode()[i : i + 200]] > 1 for _, t in kept for i in range(len((t or "").encode()) - 199))
