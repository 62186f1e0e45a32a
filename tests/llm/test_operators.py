"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import filters, fingerprints, html_extract, jaccard, line_dedup, lm, packing, suffix_dedup, topk, toxicity
from leafmill.llm.common import mix
from leafmill.llm.components import connected_components
from leafmill.llm.queries import ORACLES, QUERIES

SPACE = b" \t\n\x0b\x0c\r"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def collected(df):
    return [r.asDict() for r in df.collect()]


def many(values):
    return Counter(map(repr, values))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folder, name):
    assert QUERIES[name](spark, folder[1]).count() == 0


@pytest.mark.parametrize("texts_in_common", [16, 2])
def test_suffix_dedup(spark, folder, rows, monkeypatch, texts_in_common):
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", texts_in_common)
    seen = defaultdict(int)
    texts = [(t or "").encode() for _, t, *_ in rows]
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] += 1
    want = []
    for (d, *_), t in zip(rows, texts):
        cut = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                cut[i : i + 200] = True
        kept = bytes(c for c, x in zip(t, cut) if not x)
        spans = int((np.diff(cut.astype(int), prepend=0) == 1).sum())
        want.append((d, len(t), len(t) - len(kept), spans, sha(kept)))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in collected(QUERIES["op1_suffix_dedup"](spark, folder[0]))]
    assert many(got) == many(want)


@pytest.mark.parametrize("all_hot", [False, True])
@pytest.mark.parametrize("size", [8, 40])
def test_suffix_core_on_small_windows(all_hot, size):
    rng = np.random.default_rng(0)
    for _ in range(60):
        parts = [bytes(rng.integers(0, 3, rng.integers(3, 40)).astype(np.uint8)) for _ in range(4)]
        texts = list(dict.fromkeys(b"".join(parts[i] if rng.random() < 0.6 else bytes(rng.integers(0, 200, 9).astype(np.uint8)) for i in rng.integers(0, 4, rng.integers(1, 5))) for _ in range(6)))
        length, k = size, size // 2
        n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        held = []
        for d, t in enumerate(texts):
            x = np.frombuffer(t, np.uint8)
            at, h = suffix_dedup.sampled_starts(x, length)
            wide = np.concatenate([np.zeros(k, np.uint8), x, np.zeros(length, np.uint8)])
            cols = {"node": np.full(len(at), d), "more": np.full(len(at), d + 7), "at": at, "right": np.minimum(len(x) - at, length), "left": np.minimum(at, k)}
            if len(at):
                hot = np.unique(h) if all_hot else np.zeros(0, np.uint64)
                held.append(list(suffix_dedup.deal(wide[at[:, None] + np.arange(k, k + length)], wide[at[:, None] + np.arange(k - 1, -1, -1)], cols, h, hot, 7, length)))
        cut = [np.zeros(len(t), bool) for t in texts]
        by_bucket = defaultdict(list)
        for part in (held[::2], held[1::2]):
            for row in suffix_dedup._write_runs([x for xs in part for x in xs], length):
                if row[1] is None:
                    assert row[3] == row[2] + 7
                    cut[row[2]][row[4] : row[5]] = True
                else:
                    by_bucket[row[0]].append(row[1])
        for coded in by_bucket.values():
            whole = [list(suffix_dedup.Run(x)) for x in coded]
            runs = [suffix_dedup.Run(x) for x in coded]
            order, lcps = suffix_dedup.merge_runs(runs, [r.prefixes for r in runs])
            assert [whole[a][b] for a, b in order] == sorted(s for r in whole for s in r)
            base = np.cumsum([0, *map(len, runs)])
            at = np.array([base[a] + b for a, b in order])
            c = {k: np.concatenate([getattr(r, k) for r in runs])[at].astype(np.int64) for k in ("node", "at", "right", "left")}
            low, high = suffix_dedup.repeated(np.array(lcps), np.concatenate([r.lefts for r in runs])[at], c["right"], c["left"], length)
            for j in np.flatnonzero(high >= 0):
                cut[c["node"][j]][c["at"][j] - high[j] : c["at"][j] - low[j] + length] = True
        for t, got in zip(texts, cut):
            want = np.zeros(len(t), bool)
            for i in range(len(t) - length + 1):
                if n[t[i : i + length]] > 1:
                    want[i : i + length] = True
            assert (got == want).all()


def test_repeats_go_beside_clashing_columns(spark):
    t = "word " * 60
    docs = spark.createDataFrame([(1, t + "one", 5, "k", 2), (2, t + "two", 6, "l", 3), (3, None, None, None, None)], "doc_id long, text string, n_bytes int, kept string, spans int")
    got = collected(suffix_dedup.without_repeats(docs))
    assert many(r.values() for r in got) == many({**r, "text": r["text"] and {1: "one", 2: "two"}[r["doc_id"]]}.values() for r in collected(docs.fillna({"text": ""})))


def test_bpe(spark, folder, rows):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = [tuple(r.values()) for r in collected(QUERIES["op2_bpe_round_trip"](spark, folder[0]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))]
    assert many(got) == many(want)


def test_bpe_cuts_long_texts_safely():
    from leafmill.llm import bpe

    rng = random.Random(1)
    text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "1", "!", "é", "'s"]) for _ in range(5000))
    parts = list(bpe.safe_pieces(text, 50))
    assert "".join(parts) == text and len(parts) > 20
    assert list(bpe.safe_pieces("", 50)) == [""]


def test_packing(spark, folder, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want, total = [], 0
    for d, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        s, k = 0, 0
        while s < len(ids):
            e = len(ids) % 2048 or 2048 if k == 0 else s + 2048
            want.append((d, k, s, e - s, zlib.crc32(ids[s:e].tobytes())))
            s, k = e, k + 1
        total += len(ids)
    got = collected(QUERIES["op3_best_fit_packing"](spark, folder[0]))
    assert many((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == many(want)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= total / 2048 * 1.05 + 1


def test_packing_matches_added_tokens(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.json")
    t, mark = Tokenizer.from_file(file), "<|endoftext|>"
    texts = ["plain text", f"a {mark} b", mark, f"{mark}{mark}\nx", f"one\u00a0two{mark}", "a <|endoftext| > b", "", f"word {mark} " * 3000]
    ids = {k: t.encode(x, add_special_tokens=False).ids + [0] for k, x in enumerate(texts)}
    assert ids[1] == [64, 220, 50256, 275, 0]
    got = defaultdict(list)
    for r in packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), file, with_ids=True).orderBy("doc_id", "piece").collect():
        got[r["doc_id"]] += r["ids"]
    assert got == ids


def test_packing_plan_uses_every_piece():
    rng = np.random.default_rng(2)
    for n in (1, 7, 500, 20000):
        hist = np.bincount(rng.integers(1, 2049, n), minlength=2049)
        used = np.zeros(2049, int)
        for p, k in packing.plan(hist, 2048):
            assert sum(p) <= 2048
            for v in p:
                used[v] += k
        assert (used == hist).all()


def test_html(spark, folder):
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in collected(QUERIES["op4_consensus_paths"](spark, folder[0]))}
    assert got == {1: ("http://a.example/x", "T & u\na\nbc", 10), 2: (None, "", 0), 3: ("http://a.example/y", "", 0), None: ("x", "only", 4)}


def test_html_leaves_out_what_is_not_article():
    h = """<body><header>Site</header><div class="cookie-notice">We use cookies</div><div id=content><article><p>One&nbsp;two<p>Three<ul><li>x<li>y</ul>
    <aside>side</aside><form>f</form><div class="ad-slot">buy</div><script>1 < 2</script></article><section class="comments"><p>a reader says a lot of things</p></section></div><footer>c"""
    p = html_extract.Page(h)
    assert p.text(p.path(p.choice())) == "One two\nThree\nx\ny"


def test_html_keeps_the_whole_article(spark):
    long, rest, story = "long text " * 40, "the rest of it " * 3, "a story told elsewhere " * 30
    parted = f"<body><article><h1>T</h1><div class=content><p>{long}</p></div><div>{rest}</div></article></body>"
    teaser = f"<body><article><p>short teaser</p></article><div class=story><p>{story}</p></div></body>"
    no_article = f"<body><div class=page><h1>T</h1><div class=content><p>{long}</p></div><div>{rest}</div></div><footer>f</footer></body>"
    nested = f"<body><main><h1>T</h1><article><p>{long}</p></article></main></body>"
    usual = f"<body><article><p>{long}</p></article></body>"
    rows = [(k, "http://h.example/", h) for k, h in enumerate([parted, teaser, no_article, nested, *[usual] * 5])]
    rows += [(100 + k, f"http://own{k}.example/", r[2]) for k, r in enumerate(rows[:4])]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = [f"T\n{long.strip()}\n{rest.strip()}", f"short teaser\n{story.strip()}", f"T\n{long.strip()}\n{rest.strip()}", f"T\n{long.strip()}"]
    for k, text in enumerate(want):
        assert got[k] == got[100 + k] == text


def test_html_frames_and_names():
    text = lambda h: html_extract.Page(h).text(None)
    assert text("<body><form id=all><nav>menu</nav><article><h1>T</h1><p>the body of it</p></article></form>") == "T\nthe body of it"
    assert text("<body><p>long text here it is</p><form><p>mail me</p></form><p>end</p>") == "long text here it is\nend"
    assert text("<form><label>name</label></form>") == ""
    inside = "<article><div class='related-work'>a</div><div class='notice-text'>b</div><div class='ad-slot'>x</div><div class='related-posts'>y</div><p>c</article>"
    assert text(inside) == "a\nb\nc"
    assert text("<p title=\"a > b\">x</p><p title='it\"s'>y</p><p title=\"open>z</p>") == "x\ny\nz"


def test_html_competing_paths_of_a_host(spark):
    """The path of most pages wins and is used where it holds the page's own choice."""
    one = "<body><div class=wrap><div class=page{k}><div class=story><p>{t}</p></div></div><div class=more><p>{m}</p></div></div></body>"
    few = "<body><div class=wrap><div class=story><p>{t}</p></div></div></body>"
    rows = [(k, "http://h.example/", one.format(k=k, t=f"text {k}", m="more")) for k in range(7)] + [(k, "http://h.example/", few.format(t=f"text {k}")) for k in range(7, 11)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"text {k}\nmore" if k < 7 else f"text {k}" for k in range(11)}
    paths = {r["path"] for r in html_extract.winning_paths(spark.createDataFrame([("h", r[2]) for r in rows], "host string, html string")).collect()}
    assert paths == {"body div.wrap"}


@pytest.mark.parametrize("part", ["<a ", "<div>", "<div>a", "<p title='", "<li>x<ul>", "<script>", '<a ">'])
def test_html_takes_time_in_proportion(part):
    import time

    took = []
    for n in (50_000, 400_000):
        began = time.process_time()
        p = html_extract.Page(part * (n // len(part)))
        p.text(p.path(p.choice()))
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_html_by_join(spark, folder):
    pages = spark.read.parquet(f"{folder[0]}/pages.parquet")
    a, b = (html_extract.extract(pages, small_bytes=s).select("page_id", "text").collect() for s in (1 << 20, -1))
    assert many(a) == many(b)


@pytest.mark.parametrize("block", [8192, 30])
def test_top_k(spark, folder, monkeypatch, block):
    monkeypatch.setattr(topk, "DATA_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 1 + block // 10)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    monkeypatch.setattr(topk, "CELLS", 4)  # so that cells have several blocks
    table = [r for r in spark.read.parquet(f"{folder[0]}/embeddings.parquet").collect()]
    whole = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in table if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    whole = [(v, list(x)) for v, x in {(v, tuple(x)) for v, x in whole}]
    want = []
    for q, x in whole:
        if q % 50 == 0:
            s = sorted({(-sum(a * b for a, b in zip(x, y)), v) for v, y in whole if v != q and len(x) == len(y)})[:5]
            want += [(q, k + 1, v, -n) for k, (n, v) in enumerate(s)]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collected(QUERIES["op5_dual_cover_trees"](spark, folder[0]))]
    assert many(got) == many(want)


def test_cover_tree_covers():
    x = np.random.default_rng(0).normal(size=(900, 5))
    t = topk.Tree(x)
    assert sorted(t.order.tolist()) == list(range(900)) and (t.x == x[t.order]).all() and len(t.start) > 20
    for k in range(len(t.start)):
        own = t.x[t.start[k] : t.end[k]]
        assert (np.linalg.norm(own - t.centre[k], axis=1) <= t.radius[k] + 1e-9).all()
        if t.last[k]:
            c = range(t.child[k], t.last[k])
            assert [t.start[k], *(t.end[j] for j in c)] == [*(t.start[j] for j in c), t.end[k]]  # they part its rows
            apart = np.linalg.norm(t.centre[c][:, None] - t.centre[c][None], axis=2) + 100 * np.eye(len(c))
            assert apart.min() > t.radius[k] / topk.BASE - 1e-5 and max(t.radius[j] for j in c) <= t.radius[k] / topk.BASE + 1e-5


@pytest.mark.parametrize("clusters, share", [(40, 0.3), (0, 1.0)])
def test_dual_search_prunes_and_is_exact(clusters, share):
    rng = np.random.default_rng(1)
    if clusters:
        centres = rng.normal(size=(clusters, 16)) * 256
        x = np.floor(centres[rng.integers(0, clusters, 6000)] + rng.normal(size=(6000, 16)) * 8).astype(np.int64)
    else:
        x = np.floor(rng.normal(size=(3000, 16)) * 256).astype(np.int64)
    x, own = np.concatenate([x, x[:100]]), np.arange(0, len(x), 20)  # some points twice
    q, p = topk.Tree(x[own]), topk.Tree(x)
    best = topk.Best(own[q.order], 5)
    topk.dual_search(q, p, [[int(v)] for v in p.order], best)
    for i, v in enumerate(best.own.tolist()):
        s = x @ x[v]
        order = [j for j in np.lexsort((np.arange(len(x)), -s))[:7].tolist() if j != v][:5]
        assert best.found[i] == [(-int(s[j]), j) for j in order]
    assert best.compared <= share * len(own) * len(x)


@pytest.mark.parametrize("small", [1 << 24, -1])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup(docs, rows, small, keep):
    rows = [r for r in rows if r[0] is not None]
    lines = [[(x, x.strip(SPACE).lower()) for x in (t or "").encode().split(b"\n")] for _, t, *_ in rows]
    n, first = Counter(), {}
    for (d, *_), own in zip(rows, lines):
        for k in {k for _, k in own if k}:
            n[k] += 1
            first[k] = min(first.get(k, d), d)
    want = []
    for (d, *_), own in zip(rows, lines):
        kept, stays = [], set()
        for x, k in own:
            if not k or n[k] < 3:
                kept.append(x)
            elif keep == "first" and first[k] == d and k not in stays:
                stays.add(k)
                kept.append(x)
        want.append((d, b"\n".join(kept).decode(), len(own), len(own) - len(kept)))
    got = line_dedup.dedup_lines(docs.filter("doc_id IS NOT NULL"), min_docs=3, keep=keep, bits=1 << 16, small_bytes=small)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert many((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in collected(got)) == many(want)


def brute_classes(rows):
    sets, docs = {}, [(d, t) for d, t, *_ in rows if d is not None]
    for d, t in docs:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    ids = sorted(sets)
    label = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = {d: x if v == y else v for d, v in label.items()}
    return {d: (len(sets[d]), label[d]) for d in ids}


def test_jaccard(spark, folder, rows):
    got = collected(QUERIES["op7_ngram_jaccard"](spark, folder[0]))
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_classes(rows)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_jaccard_splits_large_regions(spark, monkeypatch):
    rng = random.Random(5)
    base = [[str(rng.randint(0, 99999)) for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(90):
        w = list(base[i % 3])
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "REGION", 6)
    monkeypatch.setattr(jaccard, "PART", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    for rounds in (1, 3):
        monkeypatch.setattr(jaccard, "ROUNDS", rounds)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")))}
        assert got == brute_classes(rows)


def test_jaccard_joins_a_star_of_near_copies_around_its_source(spark, monkeypatch):
    """Copies are near to their source and not to one another; few pairs are compared to tie them all."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(200), 4):
            w[k] = f"n{i}-{k}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "REGION", 20)
    monkeypatch.setattr(jaccard, "PART", 40)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    paired = []
    block_pairs = jaccard._block_pairs
    monkeypatch.setattr(jaccard, "_block_pairs", lambda r: paired.append(r.count()) or block_pairs(r))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == brute_classes(rows) and {c for _, c in got.values()} == {0}
    assert sum(paired) == 0


def test_jaccard_leaves_out_copies_edited_too_much_for_any_link(spark, monkeypatch):
    """Of a set of which a ninth is its own, no set of its size is near: such copies are in no region, not copied to cells and paired."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(5, 195, 6), 4 if i % 3 else 5):
            w[k] = f"n{i}-{k}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "REGION", 20)
    monkeypatch.setattr(jaccard, "PART", 40)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    paired = []
    block_pairs = jaccard._block_pairs
    monkeypatch.setattr(jaccard, "_block_pairs", lambda r: paired.append(r.count()) or block_pairs(r))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == brute_classes(rows) and len({c for _, c in got.values()}) == 51
    assert sum(paired) == 0


def test_jaccard_suspects_stay_few_when_shingles_outgrow_the_largest_filter(spark, monkeypatch):
    monkeypatch.setattr(filters, "MOST_BITS", 1 << 20)
    monkeypatch.setattr(filters, "SLICE_KEYS", 1 << 16)
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 6000))) for _ in range(300)]
    rows = [*enumerate(texts), (300, texts[7]), (301, texts[9] + " one two"), (None, texts[11])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).cache()
    none = spark.sparkContext.broadcast(jaccard.Frequent(pa.table({"word": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})))
    sent, _ = jaccard.suspects(docs, none, 300 * 6000, 5, 80)
    assert {r["node"] for r in collected(sent.select("node"))} == {jaccard.set_key(jaccard.shingles(t.encode())) for t in (texts[7], texts[9], rows[301][1])}


def test_recurring_counts_keys_of_rows_however_they_are_sent(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [int(k) for k in rng.choice(1 << 12, 40, replace=False)] + list(range(9000, 9000 + i % 50))) for i in range(200)]
    seen = Counter(k for _, keys in rows for k in keys)

    def keyed(b):
        for i, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield i, 25, mix(np.array(keys, np.uint64))

    want = {i: n for i, keys in rows if (n := sum(seen[k] > 1 for k in keys)) >= 25}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "id long, keys array<long>").repartition(parts).cache()
        got = {r["id"]: r["hits"] for r in collected(filters.recurring(df, keyed, 12_000))}
        assert all(0 <= got[i] - n <= 3 for i, n in want.items()) and len(got) <= len(want) + 10


def test_places_are_packed_by_steps():
    for at in ([], [0], [0, 0, 65_534, 65_535, 131_070, 1 << 24], [65_535], [1 << 23, (1 << 24) - 1]):
        assert filters.unpacked(filters.packed(np.array(at, np.int64))).tolist() == at


def test_jaccard_keeps_partners_of_other_sizes(spark):
    """A text with a fifth of its own shingles still links with one that is a part of it; sets of one size only up to a ninth."""
    members = spark.createDataFrame([(1, 1, 100, 80), (1, 2, 80, 80), (1, 3, 100, 88), (2, 4, 100, 89), (2, 5, 100, 89), (2, 6, 100, 88), (3, 7, 100, 100)], "region long, id long, n long, held long")
    assert {r["id"] for r in collected(jaccard.partnered(members, 80))} == {1, 2, 3, 4, 5}


def test_jaccard_ties_texts_of_one_id(spark):
    texts = [" ".join(f"{k}{i}" for i in range(60)) for k in "abc"]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[1] + " more"), (9, texts[0] + " more"), (7, texts[2]), (5, None), (4, "x")]
    got = collected(jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert many((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == many([(5, 56, 3), (5, 56, 3), (3, 57, 3), (9, 57, 3), (7, 56, 7), (5, 0, 5), (4, 1, 4)])


def test_regions_join_exactly():
    rng = np.random.default_rng(1)
    for _ in range(60):
        base = [np.unique(rng.integers(0, 2**60, rng.integers(5, 60)).astype(np.uint64)) for _ in range(3)]
        sets = []
        for _ in range(25):
            b = base[rng.integers(0, 3)]
            s = np.unique(np.concatenate([b[rng.random(len(b)) > rng.choice([0, 0.03, 0.1])], rng.integers(0, 2**60, 3).astype(np.uint64)]))
            sets.append(s)

        def classes(links):
            label = list(range(len(sets)))
            for i, j in links:
                a, c = label[i], label[j]
                label = [a if x == c else x for x in label]
            m = {}
            return [m.setdefault(x, len(m)) for x in label]

        all_pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard.near(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
        assert classes(all_pairs) == classes(jaccard.join_region(sets))


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    label = {v: v for e in edges for v in e if e[0] != e[1]}
    for a, b in edges:
        if a != b:
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == label and len(got) == len(label)


def test_fingerprints(spark, folder, rows):
    got = collected(QUERIES["op8_weighted_sampling"](spark, folder[0]))
    order = sorted(((d if d is not None else -(2**63), t or "") for d, t, *_ in rows), key=lambda x: (-x[0], x[1]))
    want = []
    for (d, t), (_, following) in zip(order, [*order[1:], order[0]]):
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (fingerprints.signature(x.encode()) for x in (t, new, following))
        want.append((None if d == -(2**63) else d, len(t), sha(new.encode()), a.tobytes().hex(), b.tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    assert many(tuple(r.values()) for r in got) == many(want)


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(4)
    errors = []
    for _ in range(40):
        a = [str(rng.randint(0, 9)) for _ in range(300)] + [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        b = a[: rng.randint(100, 500)] + [f"v{rng.randint(0, 10**6)}" for _ in range(100)]
        x, y = (dict(zip(*map(np.ndarray.tolist, fingerprints.weighted_terms(" ".join(t).encode())))) for t in (a, b))
        true = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
        errors.append(fingerprints.likeness(*(fingerprints.signature(" ".join(t).encode()) for t in (a, b))) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_signatures_tell_all_terms_apart(monkeypatch):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000, np.uint64)
    for other in (a ^ np.uint64(1 << 40), a ^ np.uint64(1 << 63)):  # the low bits alike
        for weight in (np.ones(3000, np.int64), rng.integers(1, 9, 3000)):
            got = []
            for terms in (a, other):
                monkeypatch.setattr(fingerprints, "weighted_terms", lambda text, terms=terms, weight=weight: (terms, weight))
                got.append(fingerprints.signature(b""))
            assert fingerprints.likeness(*got) < 0.04


def test_variates_have_their_distributions():
    h = [fingerprints.hashes(fingerprints.mix(np.arange(5000, dtype=np.uint64)), k) for k in fingerprints.slot_keys()]
    z, y, x = map(fingerprints.exponential, h)
    c, q = z + y, np.log1p(y / z)
    r = q + x
    b = 1 - q / r
    for v, mean, var in ((c, 2, 2), (r, 2, 2), (b, 0.5, 1 / 12)):
        assert abs(v.mean() - mean) < 0.02 and abs(v.var() - var) < 0.05
    for u, v in ((c, r), (c, b), (r, b)):
        assert abs(np.corrcoef(u.ravel(), v.ravel())[0, 1]) < 0.01
    neighbours = np.corrcoef(c[:, :40], rowvar=False) - np.eye(40)
    assert np.abs(neighbours).max() < 0.08


def test_language_model_counts(spark, folder, rows):
    got = collected(QUERIES["op9_recurrent_model"](spark, folder[0]))
    words = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows]
    c = Counter(w for own, h in zip(words, held) if not h for w in own)
    n, v = sum(c.values()), len(c)
    want = [(d, h, len(own), sum(c[w] > 0 for w in own), n, round(float(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in own)), 6)) for (d, *_), own, h in zip(rows, words, held)]
    assert many((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == many(want)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


@pytest.mark.parametrize("words", [1 << 17, 50])
def test_language_model_scores_by_a_plain_loop(spark, docs, rows, monkeypatch, words):
    import xxhash

    monkeypatch.setattr(lm, "VOCABULARY", words)
    monkeypatch.setattr(lm, "CHUNK", 5000)
    found, vocab, net = lm.score_documents(docs.select("doc_id", "text"))
    got = collected(found)
    hashed = [[*(xxhash.xxh3_64_intdigest(w) for w in (t or "").encode().lower().split()), int(lm.END)] for _, t, *_ in rows]
    c = Counter(w for (d, *_), own in zip(rows, hashed) if d is None or zlib.crc32(str(d).encode()) % 7 != 2 for w in own)
    number = {w: k for k, w in enumerate(vocab.words.tolist())}
    assert len(number) == len(c) if words > len(c) else len(number) <= words
    wx, u, v, b = (w.astype(float) for w in net.w)
    k, rest = net.hidden, [c[w] for w in c if w not in number]
    classes = Counter()
    for w, j in number.items():
        classes[int(vocab.class_of[j])] += c[w]
    want = []
    for (d, *_), own in zip(rows, hashed):
        h, x, total = np.zeros(k), net.classes, 0.0
        for w in own:
            g, a = wx[x], h @ u
            z, r = 1 / (1 + np.exp(-(g[:k] + a[:k]))), 1 / (1 + np.exp(-(g[k : 2 * k] + a[k : 2 * k])))
            n = np.tanh(g[2 * k :] + r * a[2 * k :])
            h = n + z * (h - n)
            o = h @ v + b
            x = int(vocab.class_of[number.get(w, len(number))])
            inside = c[w] / classes[x] if w in number else (c[w] + 1) / (sum(rest) + len(rest) + 1)
            total += (o[x] - np.log(np.exp(o).sum())) / np.log(10) + np.log10(inside)
        want.append((d if d is not None else -1, len(own), total))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["score"]) for r in got)
    for x, y in zip(got, sorted(want), strict=True):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-3 + 1e-4 * abs(y[2])


def test_language_model_gradients():
    rng = np.random.default_rng(0)
    net = lm.Network(5, 4)
    net.w = [w.astype(np.float64) for w in net.w]
    xs, ys, mask, h = rng.integers(0, 5, (3, 2)), rng.integers(0, 5, (3, 2)), np.ones((3, 2)), rng.normal(0, 1, (2, 4))
    mask[2, 1] = 0

    def loss():
        lp = net.log_probabilities(net.steps(xs, h).astype(float).reshape(-1, 4), ys.reshape(-1))
        return -(lp * mask.reshape(-1)).sum() / mask.sum()

    grads, _ = net.gradients(xs, ys, mask, h)
    for k, w in enumerate(net.w):
        at = tuple(rng.integers(0, d) for d in w.shape)
        old, e = w[at], 1e-3
        w[at] = old + e
        up = loss()
        w[at] = old - e
        down = loss()
        w[at] = old
        assert abs((up - down) / 2 / e - grads[k][at]) < 1e-3


def test_language_model_beats_counts_on_held_out_texts(spark):
    rng = random.Random(2)
    speech = [[f"{k}{i}" for i in range(40)] for k in "ab"]
    rows = [(i, " ".join(rng.choice(speech[i % 2]) for _ in range(80))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lm.score_documents(docs)[0].filter(lm.held_out(F.col("doc_id"))).collect()
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_toxicity_finds_held_out_examples(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(800):
        w = [rng.choice(words) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            w[rng.randrange(60)] = "vilemord" + rng.choice(["", "s", "ing", "ed", "er"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i]["score"] >= 0.3) == (i % 6 == 0) for i in held)
    assert 0 <= got[1000]["score"] == got[1001]["score"] < 0.3
    assert all(e["doc_id"] % 6 == 0 for e in got[held[0] if held[0] % 6 == 0 else next(i for i in held if i % 6 == 0)]["evidence"])


@pytest.mark.parametrize("block", [128, 7])
def test_nearest_is_exact(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(0)

    def vector():
        t = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        w = rng.random(len(t)) ** 4
        return t, w / np.sqrt((w * w).sum())

    examples = sorted((vector() for _ in range(1500)), key=lambda v: v[0][np.argmax(v[1])])
    index = toxicity.BlockMaxIndex(examples, 60)
    full = np.zeros((1500, 60))
    for e, (t, w) in enumerate(examples):
        full[e, t] = w
    for j in range(60):
        t, w = examples[j] if j % 2 else vector()
        own = full[:, t] @ w
        if j % 2:
            own[j] = 0
        want = np.sort(own)[::-1][:15]
        assert np.allclose(index.nearest(t, w, 15, j if j % 2 else -1)[0], want[want > 0], atol=1e-5)


def test_toxicity_scores_by_brute_force(spark, folder, rows):
    """Every step again with dictionaries: chi-squares, document frequencies, cosines, votes, calibration."""
    from math import exp, log, sqrt

    def terms(t):
        c = Counter()
        for w in (t or "").encode().lower().split():
            w = w.strip(toxicity._EDGES)
            if w:
                c.update([w])
        return c

    label = {i: int(i % 6 == 0) for i in range(130) if zlib.crc32(str(i).encode()) % 4 != 2}
    all_labels = [*label.values()] + [1] * (zlib.crc32(b"100000") % 4 != 2)  # the second label of 5 is null
    rate = sum(all_labels) / len(all_labels)
    text = {d: t for d, t, *_ in rows if d in label}
    counts = {d: terms(t) for d, t in text.items()}
    size = Counter(label[d] for d in text)
    seen = {y: Counter(t for d in text if label[d] == y for t in counts[d]) for y in (0, 1)}
    df, n = Counter(t for _, x, *_ in rows for t in terms(x)), len(rows)
    weight = {}
    for t in seen[0] | seen[1]:
        a, c = seen[1][t], seen[0][t]
        chi = (a * (size[0] - c) - c * (size[1] - a)) ** 2 * len(text) / ((a + c) * (len(text) - a - c) * size[0] * size[1] + 1e-9)
        weight[t] = (log((1 + n) / (1 + df[t])) + 1) * ((chi / (chi + 20)) ** 2 + 1e-4)

    def vector(c):
        v = {t: (1 + log(k)) * weight[t] for t, k in c.items() if t in weight}
        norm = sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {d: vector(c) for d, c in counts.items()}
    back = {y: (rate if y else 1 - rate) / (size[y] / len(text)) for y in (0, 1)}
    empty = [label[d] for d in text if not vectors[d]]
    bare = (sum(back[y] * y for y in empty) + rate) / (sum(back[y] for y in empty) + 1)

    def vote(v, own=None):
        near = sorted(((sum(x * w.get(t, 0) for t, x in v.items()), d) for d, w in vectors.items() if d != own), reverse=True)
        near = [(s, d) for s, d in near[:15] if s > 0]
        if not near:
            return None
        w = [s * back[label[d]] for s, d in near]
        return (sum(x * label[d] for x, (_, d) in zip(w, near)) + 0.5 * bare) / (sum(w) + 0.5)

    odds = lambda p: log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    held = [d for d in text if vectors[d]]
    x = [(odds(bare if (v := vote(vectors[d], d)) is None else v), label[d], back[label[d]]) for d in held]
    slope, shift = 1.0, 0.0
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for o, y, w in x:
            p = 1 / (1 + exp(-(slope * o + shift)))
            g0, g1 = g0 + w * (p - y) * o, g1 + w * (p - y)
            h00, h01, h11 = h00 + w * p * (1 - p) * o * o, h01 + w * p * (1 - p) * o, h11 + w * p * (1 - p)
        g0, g1, h00, h11 = g0 + slope - 1, g1 + shift, h00 + 1, h11 + 1
        det = h00 * h11 - h01 * h01
        slope, shift = slope - (g0 * h11 - g1 * h01) / det, shift - (g1 * h00 - g0 * h01) / det
    docs, labels = (spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert abs(model.slope - max(slope, 0.05)) < 1e-2 and abs(model.shift - shift) < 1e-2, (model.slope, model.shift, slope, shift, model.bare, bare)
    got = {repr((r["doc_id"], r["text"])): r["score"] for r in toxicity.score_documents(docs, model).collect()}
    for d, t, *_ in rows:
        v = vote(vector(terms(t)))
        want = bare if v is None else 1 / (1 + exp(-(max(slope, 0.05) * odds(v) + shift)))
        assert abs(got[repr((d, t))] - want) < 2e-3, (d, got[repr((d, t))], want)


def test_toxicity_tells_words_with_one_beginning_apart(spark):
    """A label that hangs on the end of a word: internal and international, constitution and constituent."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    pairs = [("internal", "international"), ("constitution", "constituent")]
    rows = [(i, " ".join([rng.choice(words) for _ in range(40)] + [pairs[i // 2 % 2][i % 2]])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, labels), evidence=False).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2)


def test_toxicity_with_labels_of_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for y in (0, 1):
        labels = spark.createDataFrame([(i, y) for i in range(40)], "doc_id long, toxic int")
        assert {r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()} == {float(y)}


def test_toxicity_query(spark, folder, rows):
    got = collected(QUERIES["op10_nearest_examples"](spark, folder[0]))
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = QUERIES[name](spark, d).toPandas(), c.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert Counter(map(repr, got[names].astype(str).itertuples(index=False))) == Counter(map(repr, want[names].astype(str).itertuples(index=False)))
