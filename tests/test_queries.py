"""Every query outside the training-data operators against its SQL, and small cases with known answers."""

from collections import Counter

import pytest
from leafmill import registry
from leafmill.functions import exprs as E
from leafmill.operators import html as H
from leafmill.operators import layout as L
from leafmill.operators import text as X
from leafmill.plans.documents import cap_blocks, migrate_overlay_anchor
from leafmill.sources import admission as A
from leafmill.sources.tables import scan_corpus, write_rendered
from pyspark.sql import Window
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def values(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6)
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        elif "int" in str(df[c].dtype).lower():
            df[c] = df[c].astype("float64")
    return Counter(map(repr, df.astype(str).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, D).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_paragraphs(spark):
    got = X.txt_paragraphs(docs(spark, "first\r\nsecond\r\n", "a\nb\nc", "", None, "x\ry")).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.text) for r in got] == [(0, "first"), (0, "second"), (1, "a"), (1, "b"), (1, "c"), (4, "x\ry")]
    assert [r.text for r in X.to_plain_text(X.txt_paragraphs(docs(spark, "a\nb\nc"))).collect()] == ["a\nb\nc"]


def test_stats_of_empty_text(spark):
    assert [tuple(r)[1:] for r in X.doc_stats(docs(spark, None, "a b\tc\n")).orderBy("doc_id").collect()] == [(0, 0, 0, 1, 0), (4, 5, 3, 2, 1)]


def test_tokens_of_headers(spark):
    given = dict(page=F.lit(3), pages=F.lit(10), date=F.lit("2026-05-05"), time=F.lit("14:30"), title=F.lit("T {PAGE}"), author=F.lit("A"), file=F.lit("f"))
    cases = {"- {PAGE} / {NUMPAGES} -": "- 3 / 10 -", "{page}": "3", "{  PAGE  }": "3", "{UNKNOWN_TOKEN}": "{UNKNOWN_TOKEN}", r"\{PAGE\}": "{PAGE}", r"\{ {PAGE} \}": "{ 3 }", "{PAGE": "{PAGE", "{제목}{저자}{파일명}": "T {PAGE}Af", "{날짜} {시간}": "2026-05-05 14:30"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", E.resolve_tokens(F.col("t"), **given).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases
    assert spark.range(1).select(E.resolve_tokens(F.lit(None).cast("string"), **given).alias("r")).first().r == ""


def test_cap(spark):
    blocks = X.txt_paragraphs(docs(spark, "x\n" * 200))
    assert cap_blocks(blocks, 50).count() == 51 and cap_blocks(blocks, 0).count() == 200
    assert cap_blocks(blocks, 50).orderBy(F.desc("pos")).first().warning


def test_overlay_anchor(spark):
    df = spark.createDataFrame([(0, 350.0), (0, 600.0), (0, 320.0), (1, 40.0)], "page int, y double")
    once = migrate_overlay_anchor(df, 297.0)
    assert [tuple(r) for r in once.collect()] == [(1, 53.0), (2, 6.0), (1, 23.0), (1, 40.0)]
    assert [tuple(r) for r in migrate_overlay_anchor(once, 297.0).collect()] == [tuple(r) for r in once.collect()]


def test_external_references(spark):
    refs = ["https://x/y.png?text=a", "data:image/png;base64,AA", "images/a.png", "C:\\a.png", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in refs], "p string").select(E.is_external_ref(F.col("p"))).collect()] == [True, True, False, False, False]


def page(spark, html):
    return spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")


def test_html_blocks(spark):
    b = H.html_blocks(page(spark, "<html><head><title>t</title><style>x</style></head><body><script>1</script><p>a &amp; <b>b</b></p><ul><li>x</li><li>y</li></ul><blockquote><p>1</p><blockquote><p>2</p></blockquote></blockquote></body></html>"))
    assert [(r.kind, r.list_level, r.quote_level, r.text) for r in b.orderBy("block_no").collect()] == [("paragraph", 0, 0, "a & b"), ("item", 1, 0, "x"), ("item", 1, 0, "y"), ("paragraph", 0, 1, "1"), ("paragraph", 0, 2, "2")]
    runs = H.html_runs(page(spark, '<body><p>a <b>c</b> <a href="/u">d</a></p>')).orderBy("pos").collect()
    assert [(r.text, r.bold, r.url) for r in runs] == [("a ", False, None), ("c", True, None), ("d", False, "/u")]


def test_forced_breaks(spark):
    def pages(*forced):
        rows = [(1, k, 10, f) for k, f in enumerate(forced)]
        return [r.page for r in L.paginate_natural(spark.createDataFrame(rows, "doc_id int, pos int, height long, forced boolean"), 1000).orderBy("pos").collect()]

    assert pages(False, True, False) == [0, 1, 1] and pages(True, False) == [0, 0] and pages(False, True, True) == [0, 1, 2]


def test_manifest(spark):
    parts = spark.createDataFrame([("p", "a", "t", "1"), ("p", "b", "t", "2")], "pkg string, path string, media_type string, content string")
    m = A.build_manifest(parts)
    assert all(len(r.sha256) == 64 for r in m.collect())
    changed = parts.filter("path = 'a'").withColumn("content", F.lit("x"))
    assert {r.path: r.status for r in A.verify_manifest(changed, m).collect()} == {"a": "tampered", "b": "missing"}
    assert {r.path: r.status for r in A.verify_manifest(changed, m, verify=False).collect()} == {"a": "ok", "b": "missing"}


def test_sealed_parts(spark):
    parts = spark.createDataFrame([("a", bytearray(b"secret"))], "path string, content binary")
    sealed = A.seal_parts(parts, A.derive_key("word", b"salt", 1000))
    sealed.cache()
    assert bytes(A.unseal_parts(sealed, A.derive_key("word", b"salt", 1000)).first().content) == b"secret"
    assert A.unseal_parts(sealed, A.derive_key("other", b"salt", 1000)).first().status == "wrong-key"


def test_binary_files(spark):
    df = spark.createDataFrame([(1, bytearray(b"\0" * 60 + b"a" * 940)), (2, bytearray(b"\0" * 40 + b"a" * 960)), (3, bytearray(b"")), (4, None)], "k int, content binary")
    assert [r.rejected for r in A.binary_reject(df).orderBy("k").collect()] == [True, False, False, False]


def test_sink(spark, tmp_path):
    out = str(tmp_path / "out")
    write_rendered(docs(spark, "a\nb", "é"), out)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a\nb", "é"]
    assert scan_corpus(spark, f"{D}/documents.parquet").count() == 200


def test_number_styles(spark):
    df = spark.createDataFrame([(1,), (4,), (19,)], "n int")
    got = [[r[0] for r in df.select(E.number_text(F.col("n"), s)).collect()] for s in ("decimal", "alpha_lower", "roman_upper", "roman_lower")]
    assert got == [["1", "4", "19"], ["a", "d", "s"], ["I", "IV", "XIX"], ["i", "iv", "xix"]]


def test_entry():
    import __spark_entry__ as e

    assert {"a1_doc_stats", "p3_html_blocks"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_paginate_like_a_plain_loop(spark):
    import random

    rng = random.Random(0)
    rows = [(d, k, rng.choice([300, 900, 2500, 6000, 12000]), rng.random() < 0.15) for d in range(12) for k in range(rng.randint(1, 30))]
    body, columns, tolerance = 10000, 2, 200
    want = {}
    for d in {r[0] for r in rows}:
        top, prev, least, fill = 0, -1, 0, {}
        for _, k, h, forced in sorted(r for r in rows if r[0] == d):
            slot, breaks = max(least, top // body), forced and prev >= 0
            if breaks:
                slot = least = max(slot, (prev // columns + 1) * columns)
            if not breaks and top + h > (slot + 1) * body + tolerance and h < body:
                slot += 1
            while 0 < h < body and fill.get(slot, 0) + h > body + tolerance:
                slot += 1
            fill[slot] = min(body, fill.get(slot, 0) + min(h, body))
            want[d, k] = (slot // columns, slot % columns)
            prev, top = slot, top + h
    df = spark.createDataFrame(rows, "doc_id int, pos int, height long, forced boolean")
    assert {(r.doc_id, r.pos): (r.page, r.col) for r in L.paginate(df, body, columns, tolerance).collect()} == want
    assert {r.page for r in L.paginate(df, body, columns, tolerance, most_blocks=0).collect()} == {0}


def test_packages(spark, tmp_path):
    import zipfile

    from leafmill.operators.office import package_parts

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("mimetype", "m")
        z.writestr("word/document.xml", "<w/>")
    (tmp_path / "b.docx").write_bytes(b"no package")
    files = scan_corpus(spark, str(tmp_path), "binary").withColumnRenamed("doc_id", "path")
    got = package_parts(files).collect()
    assert sorted((r.path, r.size, bytes(r.content)) for r in got) == [("mimetype", 1, b"m"), ("word/document.xml", 4, b"<w/>")]


def test_declared_character_sets(spark):
    rows = []
    for k, (name, codec, text) in enumerate([("euc-kr", "euc-kr", "한글"), ("ks_c_5601-1987", "cp949", "똠방각하"), ("windows-1252", "cp1252", "“naïve” €"), ("Shift_JIS", "shift_jis", "日本"), ("gb18030", "gb18030", "中文"), ("no-such-set", "utf-8", "é")]):
        rows.append((k, bytearray(f"<meta charset={name}><p>".encode() + text.encode(codec)), text))
    got = A.detect_encoding(spark.createDataFrame([r[:2] for r in rows], "k int, content binary")).orderBy("k").collect()
    assert [r.text.split("<p>")[1] for r in got] == [r[2] for r in rows]
    assert [r.encoding for r in got] == ["euc-kr", "ks_c_5601-1987", "windows-1252", "shift_jis", "gb18030", "utf-8"]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_output_names_like_a_plain_loop(spark):
    import random

    rng = random.Random(1)
    existing = {("a", k) for k in (0, 1, 2, 4, 12000, 12001)} | {("b", k) for k in range(0, 9, 2)}
    wanted = [(i, rng.choice("abc")) for i in range(60)]
    taken, want = set(existing), {}
    for i, name in wanted:
        k = next(k for k in range(100) if (name, k) not in taken)
        taken.add((name, k))
        want[i] = f"{name}-{k}.txt" if k else f"{name}.txt"
    files = [(f"{n}-{k}" if k else n, "txt") for n, k in existing] + [("a-01", "txt"), ("a-x", "txt")]
    got = A.safe_output_names(spark.createDataFrame([(i, n, "txt") for i, n in wanted], "id long, name string, ext string"), spark.createDataFrame(files, "name string, ext string"))
    assert {r.id: r.target for r in got.collect()} == want
    many = [(f"d-{k}" if k else "d", "txt") for k in range(12_000)]
    got = A.safe_output_names(spark.createDataFrame([(1, "d", "txt")], "id long, name string, ext string"), spark.createDataFrame(many, "name string, ext string"))
    assert got.first().target == "d-12000.txt"


def test_undo_like_a_plain_loop(spark):
    import random

    from leafmill.streaming.streams import undo_state

    rng = random.Random(2)
    rows = [(key, n, rng.choice(["push", "push", "undo", "redo", "other"])) for key in range(8) for n in range(rng.randint(1, 60))]
    want = {}
    for key, _, action in sorted(rows):
        undo, redo = want.get(key, (0, 0))
        if action == "push":
            undo, redo = min(undo + 1, 7), 0
        elif action == "undo" and undo:
            undo, redo = undo - 1, redo + 1
        elif action == "redo" and redo:
            undo, redo = undo + 1, redo - 1
        want[key] = (undo, redo)
    got = undo_state(spark.createDataFrame(rows, "key int, n int, action string"), 7).collect()
    assert {r.key: (r.undo, r.redo) for r in got} == want


def test_bursts_end_at_other_actions(spark):
    rows = [(1, 0, "00:00:00", True), (1, 1, "00:00:01", True), (1, 2, "00:00:01", False), (1, 3, "00:00:02", True), (1, 4, "00:00:09", True), (1, 5, "00:00:10", True)]
    df = spark.createDataFrame(rows, "key int, id int, t string, edit boolean").withColumn("ts", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")))
    assert sorted(r.n for r in L.edit_bursts(df, 1.5).collect()) == [1, 2, 2]


def test_hits_by_running_sums(spark):
    got = X.find_all(docs(spark, "ababab\nxabx").transform(X.txt_paragraphs), "ab").collect()
    assert sorted((r.pos, r.hit, r.off) for r in got) == [(0, 0, 0), (0, 1, 2), (0, 2, 4), (1, 0, 1)]


def test_numbers_without_one_task(spark):
    rows = [(x, x % 7) for x in range(500)]
    got = X.numbered(spark.createDataFrame(rows, "x int, k int").repartition(9), ["k", "x"], "n", 4).collect()
    assert [(r.k, r.x) for r in sorted(got, key=lambda r: r.n)] == sorted((k, x) for x, k in rows) and sorted(r.n for r in got) == list(range(4, 504))


def test_numbers_of_many_rows(spark):
    """Ranges of several partitions, more columns than the order, and adaptive merging: exactly 1 to n in order."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = spark.range(400_000).select(((F.col("id") * 7919) % 400_009).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    got = X.numbered(rows, ["k"], "n")
    place = F.row_number().over(Window.orderBy("k"))
    assert got.count() == 400_000 and got.select("n").distinct().count() == 400_000
    assert got.withColumn("place", place).filter("n <> place").count() == 0
    found = X.dedupe_resources(spark.range(400_000).select(F.col("id").alias("pos"), (F.col("id") % 250_000).cast("string").alias("content")))
    assert found.count() == 400_000 and found.agg(F.max("number")).first()[0] == 250_000
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_declarations_behind_a_long_comment(spark):
    from leafmill.operators.codecs import has_doctype_entities

    texts = ["<!--" + "x" * 9000 + "--><!DOCTYPE a [<!ENTITY b 'c'>]><a/>", "<!DOCTYPE a><a/>", "<a/>"]
    assert [r.c for r in docs(spark, *texts).select(has_doctype_entities(F.col("text")).alias("c")).collect()] == [5, 0, 0]


def test_conversion_codes(spark):
    from leafmill.operators.codecs import convert_corpus, default_registry

    rows = [(1, "txt", "md", "a*b\nc"), (2, "txt", "pdf", "x"), (3, "txt", "md", ""), (4, "xml", "txt", "<!DOCTYPE a [<!ENTITY x 'y'>]><a><p>t</p></a>"), (5, "xml", "txt", "<a><p>t &amp; u</p><p>v</p></a>"), (6, "docx", "txt", "<AppVersion>12.0</AppVersion><w:p><w:r><w:t>x</w:t></w:r></w:p>")]
    d = spark.createDataFrame(rows, "doc_id long, from string, to string, text string")
    got = {r.doc_id: (r.text, r.code) for r in convert_corpus(default_registry(spark), d, [("txt", "md"), ("xml", "txt"), ("docx", "txt")]).collect()}
    assert got == {1: ("a\\*b\n\nc", 0), 2: (None, 3), 3: (None, 4), 4: (None, 5), 5: ("t & u\nv", 0), 6: (None, 6)}


def test_conversion_moves_texts_once(spark, monkeypatch):
    """Requests are stored and dealt as whole texts; reader, writer and join go on by that key, without blocks stored or shuffled."""
    from leafmill.operators import codecs

    names = []
    real = codecs.stored
    monkeypatch.setattr(codecs, "stored", lambda df, name, by=None: names.append(name) or real(df, name, by))
    monkeypatch.setattr(codecs, "TEXT_EACH", 50)
    rows = [(i, a, b, t) for i in range(20) for a, t in (("txt", f"a{i}\nb"), ("html", f"<p>a{i}</p><p>b</p>")) for b in ("txt", "md", "html")] + [(None, "txt", "", "x"), (7, "", "txt", "y")]
    pairs = [(a, b) for a in ("txt", "html") for b in ("txt", "md", "html")]
    out = codecs.convert_corpus(codecs.default_registry(spark), spark.createDataFrame(rows, "doc_id long, from string, to string, text string"), pairs)
    plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert names == ["requests"] and "ENSURE_REQUIREMENTS" not in plan and plan.count("REPARTITION_BY_NUM") == 2 * len(pairs), plan
    got = {(r["doc_id"], r["from"], r["to"]): (r["text"], r["code"]) for r in out.collect()}
    assert len(got) == len(rows) and got[3, "html", "txt"] == ("a3\nb", 0) and got[4, "txt", "md"] == ("a4\n\nb", 0)
    assert got[None, "txt", ""] == got[7, "", "txt"] == (None, 3)


def test_conversion_keeps_structure(spark):
    """HTML to Markdown and back is HTML to HTML; ids may repeat or be null, and each request is answered once."""
    from leafmill.operators.codecs import convert_corpus, default_registry

    page = (
        '<h2>T *x*</h2><p>a<br>b</p><ul><li>i</li><li>j</li></ul><ol start="3"><li>k</li><li>l</li></ol><ul><li><input type="checkbox" checked>m</li><li><input type="checkbox">n</li></ul>'
        '<blockquote><p>q</p></blockquote><pre><code class="language-py">x = 1\n  ```\n</code></pre><hr><img src="a.png" alt="pic"><p>end &amp; [z]</p>'
    )
    rows = [(1, "html", "md", page), (1, "html", "html", page), (None, "html", "txt", page), (1, "html", "html", page), (2, "html", "txt", "<script>x</script>"), (3, None, "txt", "x"), (4, "md", "xhtml", "# a\n\n> - b")]
    d = spark.createDataFrame(rows, "doc_id long, from string, to string, text string")
    pairs = [("html", "md"), ("html", "html"), ("html", "txt"), ("md", "xhtml")]
    got = [(r["doc_id"], r["to"], r["text"], r["code"]) for r in convert_corpus(default_registry(spark), d, pairs).collect()]
    assert len(got) == len(rows) and len([x for x in got if x[1] == "html"]) == 2
    of = {(a, b): (t, c) for a, b, t, c in got}
    assert of[2, "txt"] == (None, 0) and of[3, "txt"] == (None, 3)
    assert of[None, "txt"][0] == "T *x*\na\nb\ni\nj\nk\nl\nm\nn\nq\nx = 1\n  ```\n\npic\nend & [z]"
    assert "<h1>a</h1>" in of[4, "xhtml"][0] and "<blockquote>\n<ul>\n<li>b</li>\n</ul>\n</blockquote>" in of[4, "xhtml"][0]
    md = spark.createDataFrame([(9, of[1, "md"][0])], "doc_id long, text string")
    assert default_registry(spark).convert(md, "md", "html").first()["text"] == of[1, "html"][0]
    empty = convert_corpus(default_registry(spark), d.limit(0), pairs)
    assert empty.count() == 0 and convert_corpus(default_registry(spark), d, []).filter("code <> 3").count() == 0


def test_files_of_documents(spark, tmp_path):
    out = str(tmp_path / "files")
    write_rendered(docs(spark, "a\nb", "c"), out, "txt", files=True)
    got = spark.read.text(out, wholetext=True)
    assert sorted((r.doc_id, r.value) for r in got.collect()) == [(0, "a\nb\n"), (1, "c\n")]


def test_markdown_runs(spark):
    from leafmill.operators.markup import md_blocks, md_runs

    got = md_runs(docs(spark, "plain **bold** and *italic* end", "H~2~O x^2^  \nnext __b__ snake_case_name _e_ ``a ` b``", "![a](b.png)<https://x.y>$a$")).orderBy("doc_id", "run_no").collect()
    runs = [[(r.kind, r.text) for r in got if r.doc_id == k] for k in range(3)]
    assert runs[0] == [("plain", "plain "), ("strong", "bold"), ("plain", " and "), ("em", "italic"), ("plain", " end")]
    assert runs[1] == [("plain", "H"), ("sub", "2"), ("plain", "O x"), ("sup", "2"), ("break", "\n"), ("plain", "next "), ("strong", "b"), ("plain", " snake_case_name "), ("em", "e"), ("plain", " "), ("code", "a ` b")]
    assert runs[2] == [("image", "a"), ("autolink", "https://x.y"), ("math", "a")]
    blocks = md_blocks(docs(spark, "Title\n===\n\ntext\nmore\n\n```py x\na\n\nb\n```\n- [x] t\n- [ ] u\n\n$$\nE\n$$\n---\n")).orderBy("block_no").collect()
    assert [(b.kind, b.level, b.text, b.checked, b.language) for b in blocks] == [
        ("heading", 1, "Title", None, None), ("paragraph", 0, "text\nmore", None, None), ("code", 0, "a\n\nb", None, "py"), ("bullet", 1, "t", True, None), ("bullet", 1, "u", False, None), ("math", 0, "E", None, None), ("rule", 0, "", None, None)
    ]


def test_html_elements(spark):
    page = lambda h: spark.createDataFrame([(1, h)], "page_id long, html string")
    e = H.html_elements(page("<head><title>t</title></head><body><ul><li>a</li><li>b</li></ul><ol><li>1<ul><li>deep</li></ul></li><li>2</li></ol><ul><li><input type=checkbox checked>x</li><li><input type='checkbox'>y</li></ul><blockquote><p>1</p><blockquote><p>2</p></blockquote></blockquote><script>no</script><p>a <b>b</b><br>c</p>")).orderBy("block_no").collect()
    assert [(r.text, r.list_kind, r.list_level, r.number, r.checked, r.quote_level) for r in e] == [
        ("a", "bullet", 1, None, None, 0), ("b", "bullet", 1, None, None, 0), ("1", "ordered", 1, 1, None, 0), ("deep", "bullet", 2, None, None, 0), ("2", "ordered", 1, 2, None, 0), ("x", "bullet", 1, None, True, 0), ("y", "bullet", 1, None, False, 0),
        ("1", None, 0, None, None, 1), ("2", None, 0, None, None, 2), ("a b\nc", None, 0, None, None, 0),
    ]
    runs = H.html_runs(page("<body><p>x<u>u</u><del>s</del>H<sub>2</sub><sup>3</sup><code>c</code><mark>m</mark><br><a href=q>l</a><img src=i alt=p></p>")).orderBy("pos").collect()
    assert [(r.text, [k for k in H.STYLES if r[k]], r.url) for r in runs] == [
        ("x", [], None), ("u", ["underline"], None), ("s", ["strike"], None), ("H", [], None), ("2", ["sub"], None), ("3", ["sup"], None), ("c", ["mono"], None), ("m", ["mark"], None), ("\n", [], None), ("l", ["underline"], "q"), ("[p](i)", [], None)
    ]


def tasks_of(df):
    return df.rdd.getNumPartitions()


def test_tasks_grow_with_the_input(spark, tmp_path, monkeypatch):
    """What is made of items and documents is taken apart in tasks of bounded size, whatever the session's number of partitions."""
    from leafmill.plans import documents, layouts, structures, trees

    monkeypatch.setattr(structures, "ITEMS_EACH", 700)
    monkeypatch.setattr(documents, "TEXT_EACH", 20_000)
    n_items, n_chars = spark.read.parquet(f"{D}/lineitem.parquet").count(), spark.read.parquet(f"{D}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    for page in (structures.item_tables, trees.nested_pages, trees.office_packages, trees.styled_pages):
        assert tasks_of(page(spark, D)) == -(-n_items // 700)
    for page in (layouts.marked_pages, structures.json_docs, structures.plain_lines):
        assert tasks_of(page(spark, D)) == -(-n_chars // 20_000)


@pytest.mark.parametrize("name", ["p7_html_cells", "p13_md_tables", "a11_table_shape", "p21_office_cells", "p17_office_runs", "p17_office_blocks", "p12_md_inline", "p3_html_elements", "r2_elements_to_markdown"])
def test_one_shuffle(spark, name):
    """The rows are dealt once, as small as they come; markup and its parts go on by the same key."""
    plan = registry.QUERIES[name](spark, D)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") <= (2 if name == "p21_office_cells" else 1), plan
