"""Fences by mark and length, blocks inside quotes, and bursts in a stream."""

import random
from datetime import datetime, timedelta

from leafmill.operators import layout as L
from leafmill.operators import markup as M
from leafmill.streaming import streams as S


def docs(spark, *text):
    return spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")


def told(blocks, *columns):
    return [tuple(r[c] for c in columns) for r in blocks.orderBy("doc_id", "block_no").collect()]


def test_fences_pair_by_mark_and_length(spark):
    text = "````py\n```\n~~~\nx\n````` no\n`````\nafter\n~~~\n```\n~~~~\n``` a`b\n```\nopen"
    assert told(M.md_blocks(docs(spark, text)), "kind", "language", "text") == [("code", "py", "```\n~~~\nx\n````` no"), ("paragraph", None, "after"), ("code", "", "```"), ("paragraph", None, "``` a`b"), ("code", "", "open")]


def test_fences_equal_a_loop(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["```", "````", "~~~", "~~~~", "``` x", "a", "b"]) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    want = []
    for k, t in enumerate(texts):
        mark, held = "", []
        for line in t.split("\n"):
            run = line.split(" ")[0] if line[0:1] in ("`", "~") else ""
            if mark and run.startswith(mark) and run == line:
                mark, held = "", []
            elif mark:
                held.append(line)
                if len(held) > 1:
                    want.pop()
                want.append((k, "\n".join(held)))
            elif run:
                mark = run
    assert told(M.md_blocks(docs(spark, *texts)).filter("kind = 'code'"), "doc_id", "text") == want


def test_blocks_inside_quotes(spark):
    text = "> # h\n> - [x] a\n>   1. b\n> > ```js\n> > > c\n> d\n\n> p\nq\n>> ~~~\n>> e\n>> ~~~\n>> | a |\n>> | - |\n- i\n      ```\n      k\n      ```\n"
    assert told(M.md_containers(docs(spark, text, "", None)), "quote_level", "kind", "text") == [
        (1, "heading", "h"), (1, "bullet", "a"), (1, "ordered", "b"), (2, "code", "> c"), (1, "paragraph", "d"), (1, "paragraph", "p"), (0, "paragraph", "q"), (2, "code", "e"), (2, "table", "| a |\n| - |"), (0, "bullet", "i"), (0, "code", "      k"),
    ]


def test_stream_bursts_equal_the_batch_twin(spark, tmp_path):
    rng, day, rows = random.Random(9), datetime(2024, 1, 1), []
    for key in range(6):
        at, run = day, 0
        for n in range(60):
            at += timedelta(seconds=rng.choice([1, 5, 9, 10, 11, 40]))
            edit = rng.random() < 0.8
            run += not edit
            rows.append((key, n, at, edit, run))
    e = spark.createDataFrame(rows, "key long, id long, ts timestamp, edit boolean, run long")
    e.write.parquet(f"{tmp_path}/all")
    got = S.run_closed(S.stream_bursts(S.read_stream(spark, f"{tmp_path}/all"), 10, "1 day"), "bursts")
    assert sorted(map(tuple, got.select("key", "started", "n").collect())) == sorted(map(tuple, L.edit_bursts(e.drop("run"), 10).select("key", "started", "n").collect()))


def test_late_edits_are_dropped(spark, tmp_path):
    at = f"{tmp_path}/in"
    one = lambda *r: spark.createDataFrame([(1, datetime(2024, 1, 1, 0, m), True, 0) for m in r], "key long, ts timestamp, edit boolean, run long").coalesce(1)
    one(0, 1).write.parquet(at)
    stream = S.stream_bursts(S.read_stream(spark, at), 90, "5 minutes")
    write = lambda: stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    write()
    one(50).write.mode("append").parquet(at)
    write()
    one(2, 49, 55).write.mode("append").parquet(at)  # the first is later than the delay, the second is not
    one(59).write.mode("append").parquet(at)
    write()
    got = sorted((r.started.minute, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 2), (49, 2)]
