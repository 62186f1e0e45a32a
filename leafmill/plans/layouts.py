"""Queries over pages, layout and history, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import html as H
from ..operators import layout as L
from ..operators import text as X
from ..sources.tables import read_table
from .documents import LINES, dealt_paragraphs, docs, paragraphs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def long(df, *columns: str):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def pages(spark, d):
    return read_table(spark, d, "pages")


RX = H.TOKEN.replace("'", "''")
BLOCK = ", ".join(f"'{t}'" for t in H.BLOCK_TAGS)
INLINE = ", ".join(f"'{t}'" for t in H.INLINE_BLOCKS)
TOKENS = f"""toks AS (
  SELECT page_id, i - 1 AS pos, t[i] AS tok FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i
    FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{RX}') AS t FROM pages))
), tokens AS (
  SELECT page_id, pos, tok, CASE WHEN tok LIKE '<!--%' THEN 'comment' WHEN tok LIKE '<!%' THEN 'declaration'
      WHEN tok LIKE '<%' AND tok NOT LIKE '</%' AND nm IN ('script', 'style') THEN 'raw'
      WHEN tok LIKE '</%' THEN 'close' WHEN tok LIKE '<%' THEN 'tag' ELSE 'text' END AS kind,
    CASE WHEN tok LIKE '<%' THEN nm ELSE '' END AS name
  FROM (SELECT *, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS nm FROM toks)
)"""


def _open(*names: str) -> str:
    n = ", ".join(f"'{x}'" for x in names)
    return f"sum(CASE WHEN name IN ({n}) AND kind = 'tag' THEN 1 WHEN name IN ({n}) AND kind = 'close' THEN -1 ELSE 0 END) OVER w"


DECODE = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"""
BODY = f"""{TOKENS}, body AS (
  SELECT t.*, sum(CASE WHEN name IN ({BLOCK}) AND kind IN ('tag', 'close') THEN 1 ELSE 0 END) OVER w AS bid,
    {_open("b", "strong")} AS bold, {_open("i", "em")} AS italic, {_open("blockquote")} AS quote, {_open("ul", "ol")} AS depth, {_open("a")} AS linked,
    last_value(CASE WHEN name = 'a' AND kind = 'tag' THEN regexp_extract(tok, '(?i)href\\s*=\\s*"([^"]*)"', 1) END IGNORE NULLS) OVER w AS href
  FROM tokens t JOIN (SELECT page_id, coalesce(max(pos) FILTER (WHERE name = 'body' AND kind = 'tag'), 0) AS s FROM tokens GROUP BY 1) USING (page_id)
  WHERE pos >= s AND kind IN ('tag', 'close', 'text')
  WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), placed AS (
  SELECT *, max(CASE WHEN name IN ({BLOCK}) AND kind = 'tag' THEN name END) OVER (PARTITION BY page_id, bid) AS context FROM body
), rows_ AS (
  SELECT page_id, min(pos) AS pos, max(CASE WHEN context IN ({INLINE}) THEN context ELSE 'text' END) AS tag, max(depth)::INT AS list_level,
    max(quote)::INT AS quote_level, {DECODE.format("string_agg(tok, '' ORDER BY pos)")} AS text
  FROM placed WHERE kind = 'text' GROUP BY page_id, CASE WHEN context IN ({INLINE}) THEN bid ELSE -1 - pos END
), blocks AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS block_no,
    CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'li' THEN 'item' WHEN tag = 'text' THEN 'text' ELSE 'paragraph' END AS kind,
    CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN tag[2:2]::INT ELSE 0 END AS outline, list_level, quote_level, text
  FROM rows_ WHERE text <> ''
)"""


@query(f"WITH {TOKENS} SELECT * FROM tokens")
def p2_html_tokens(spark, d):
    return long(H.html_tokens(pages(spark, d)), "pos")


@query(f"WITH {BODY} SELECT * FROM blocks")
def p3_html_blocks(spark, d):
    return long(H.html_blocks(pages(spark, d)), "block_no")


RUN = DECODE.format("tok")[5:-1]


STYLE_SUMS = ", ".join(f"{_open(*names)} > 0 AS {k}" for k, names in H.STYLES.items())


@query(f"""WITH {BODY}, styled AS (SELECT page_id, pos, kind, name, tok, linked, href, {STYLE_SUMS} FROM (SELECT * EXCLUDE (bold, italic) FROM placed) WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT page_id, pos, text, {", ".join(H.STYLES)}, url FROM (SELECT *, CASE WHEN kind = 'text' THEN {RUN} WHEN kind = 'tag' AND name = 'br' THEN chr(10) END AS text, CASE WHEN linked > 0 THEN href END AS url FROM styled)
WHERE trim(text, ' ') <> ''""")
def p4_html_runs(spark, d):
    return long(H.html_runs(pages(spark, d)), "pos")


@query(f"""WITH {BODY} SELECT page_id, pos, href AS url, {DECODE.format('tok')} AS text,
  count(*) OVER (PARTITION BY page_id) AS on_page, count(*) OVER (PARTITION BY href) AS to_target FROM placed WHERE kind = 'text' AND linked > 0 AND {DECODE.format('tok')} <> ''""")
def p5_html_links(spark, d):
    return long(H.link_counts(H.html_links(pages(spark, d))), "pos")


@query(f"""WITH {TOKENS}, t AS (SELECT *, sum(CASE WHEN kind <> 'text' AND name IN ('p', 'para', 'title', 'section', 'li', 'row', 'td', 'div', 'h1') THEN 1 ELSE 0 END)
  OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS bid FROM tokens WHERE kind IN ('tag', 'close', 'text')),
r AS (SELECT page_id, bid, {DECODE.format("string_agg(tok, '' ORDER BY pos)")} AS text FROM t WHERE kind = 'text' GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY bid) AS n, text FROM r WHERE text <> ''""")
def p16_xml_paragraphs(spark, d):
    return long(H.xml_paragraphs(pages(spark, d)), "n")


@query(f"WITH {BODY} SELECT page_id, block_no, outline, text FROM blocks WHERE outline BETWEEN 1 AND 6")
def f4_outline(spark, d):
    return long(H.outline(H.html_blocks(pages(spark, d))), "block_no")


@query(f"WITH {BODY} SELECT page_id, min_by(text, block_no) AS title FROM blocks WHERE outline = 1 GROUP BY 1")
def a5_first_h1_title(spark, d):
    return H.html_blocks(pages(spark, d)).filter("outline = 1").groupBy("page_id").agg(F.min_by("text", "block_no").alias("title"))


ITEMS = "items AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY block_no)::BIGINT AS list_no FROM (SELECT *, CASE WHEN block_no - lag(block_no) OVER w = 1 AND list_level = lag(list_level) OVER w THEN 0 ELSE 1 END AS new FROM blocks WHERE kind = 'item' WINDOW w AS (PARTITION BY page_id ORDER BY block_no)))"


@query(f"WITH {BODY}, {ITEMS} SELECT page_id, list_no, max(list_level) AS level, min(block_no) AS first_block, count(*) AS items FROM items GROUP BY 1, 2")
def w1_list_groups(spark, d):
    return long(H.list_groups(H.html_blocks(pages(spark, d))), "first_block")


@query(f"WITH {BODY}, {ITEMS} SELECT page_id, block_no, row_number() OVER (PARTITION BY page_id, list_no ORDER BY block_no) AS n FROM items")
def w3_list_numbers(spark, d):
    return long(H.list_numbers(H.html_blocks(pages(spark, d))), "block_no", "n")


@query(f"""WITH {BODY} SELECT page_id, string_agg(repeat('> ', quote_level) || CASE WHEN outline > 0 THEN repeat('#', outline) || ' ' WHEN kind = 'item' THEN repeat('  ', greatest(list_level - 1, 0)) || '- ' ELSE '' END
  || regexp_replace(text, '([\\\\`*_\\[\\]<>#~|^])', '\\\\\\1', 'g'), chr(10) || chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY 1""")
def r2_to_markdown(spark, d):
    return H.to_markdown(H.html_blocks(pages(spark, d)))


@query(f"""WITH {TOKENS}, n AS (SELECT page_id, name, count(*) AS n FROM tokens WHERE kind IN ('tag', 'raw') AND name <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, name) AS r FROM n)
SELECT page_id, string_agg(name || '=' || n, ', ' ORDER BY r) AS tags FROM r WHERE r <= 8 GROUP BY 1""")
def a9_ingest_diagnostics(spark, d):
    return H.ingest_diagnostics(H.html_tokens(pages(spark, d)))


PAPERS = ", ".join(f"('{k}', {w}::DOUBLE, {h}::DOUBLE)" for k, (w, h) in L.PAPERS.items())


@query(f"""WITH papers(paper, w, h) AS (VALUES {PAPERS}), names AS (SELECT list(paper) AS n FROM papers),
s AS (SELECT o_orderkey AS id, n[o_orderkey % 36 + 1] AS paper, o_orderkey % 2 = 1 AS landscape, (o_orderkey % 4 * 10)::DOUBLE AS margin, (o_orderkey % 3 + 1)::INT AS columns, 5.0::DOUBLE AS gap FROM orders, names),
g AS (SELECT id, paper, columns, CASE WHEN landscape THEN h ELSE w END * 96.0::DOUBLE / 25.4::DOUBLE AS pw, CASE WHEN landscape THEN w ELSE h END * 96.0::DOUBLE / 25.4::DOUBLE AS ph,
  margin * 96.0::DOUBLE / 25.4::DOUBLE AS m, CASE WHEN columns > 1 THEN gap * 96.0::DOUBLE / 25.4::DOUBLE ELSE 0 END AS gw FROM s JOIN papers USING (paper)),
c AS (SELECT *, CASE WHEN columns > 1 THEN greatest(10, (greatest(1, pw - 2 * m) - gw * (columns - 1)) / columns) ELSE greatest(1, pw - 2 * m) END AS cw, unnest(range(0, columns))::INT AS k FROM g)
SELECT id, paper, k, round(pw, 4) AS page_w, round(ph, 4) AS page_h, round(cw, 4) AS column_w, round(k * (cw + gw), 4) AS x FROM c""")
def j4_page_geometry(spark, d):
    names = F.array(*map(F.lit, L.PAPERS))
    k = F.col("o_orderkey")
    s = read_table(spark, d, "orders").select(
        k.alias("id"), F.element_at(names, (k % 36 + 1).cast("int")).alias("paper"), (k % 2 == 1).alias("landscape"), (k % 4 * 10).cast("double").alias("margin"), (k % 3 + 1).cast("int").alias("columns"), F.lit(5.0).alias("gap")
    )
    return L.page_geometry(s)


STYLE = ", ".join(f"({k}, {v[0]}::DOUBLE, {v[1]}, {v[2]}, {v[3]}::DOUBLE, {v[4]}::DOUBLE, {v[5]}::DOUBLE)" for k, v in L.OUTLINE.items())


@query(f"""WITH {BODY}, style(level, p, bold, italic, before, after, line_height) AS (VALUES {STYLE})
SELECT page_id, block_no, outline AS level, CASE WHEN block_no % 7 = 0 THEN 9.5 ELSE p END AS size_pt, CASE WHEN block_no % 5 = 0 THEN block_no % 2 = 0 ELSE bold END AS bold, italic, CASE WHEN block_no % 3 = 0 THEN 1.5 ELSE before END AS before, after, line_height FROM blocks JOIN style ON outline = level""")
def j3_apply_outline_style(spark, d):
    b = H.html_blocks(pages(spark, d)).select("page_id", "block_no", F.col("outline").alias("level"), F.when(F.col("block_no") % 7 == 0, 9.5).alias("size_pt"), F.when(F.col("block_no") % 5 == 0, F.col("block_no") % 2 == 0).alias("bold"), F.when(F.col("block_no") % 3 == 0, 1.5).alias("before"))
    return long(L.apply_outline_style(b), "block_no")


LADDER = ", ".join(f"({k}, {w}::DOUBLE)" for k, w in enumerate(L.WIDTHS))


@query(f"""WITH ladder(k, w) AS (VALUES {LADDER}), v AS (SELECT DISTINCT l_orderkey, l_linenumber, (l_quantity::DOUBLE / 4 - 1) AS pt FROM lineitem)
SELECT l_orderkey, l_linenumber, pt, CASE WHEN pt <= 0 THEN 0.12 ELSE (SELECT arg_min(w, abs(w - pt * 0.3527777778::DOUBLE) * 1e6 + k * 1e-9) FROM ladder) END AS mm FROM v""")
def j11_snap_to_standard(spark, d):
    v = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") / 4 - 1).alias("pt")).distinct()
    return L.snap_to_standard(v)


@query(f"""WITH {LINES}, b AS (SELECT doc_id, pos, greatest(1, ceil(length(text) / 80.0))::BIGINT * 1800 AS height, pos % 10 = 4 AS forced FROM lines),
n AS (SELECT *, (sum(height) OVER w - height)::BIGINT // 20000 AS nat FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT *, lag(nat) OVER w AS prev FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
j AS (SELECT *, forced AND prev IS NOT NULL AS brk, sum((forced AND prev IS NOT NULL)::INT) OVER w AS j FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, max(CASE WHEN brk THEN greatest(nat // 2, prev // 2 + 1) - j END) OVER w + j AS fp FROM j WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT *, greatest(nat, coalesce(max(CASE WHEN brk THEN greatest(nat, fp * 2) END) OVER w, 0)) AS slot FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos::INT AS pos, (slot // 2)::BIGINT AS page, (slot % 2)::BIGINT AS col FROM s""")
def w6_paginate_natural(spark, d):
    b = L.block_heights(paragraphs(spark, d)).withColumn("forced", F.col("pos") % 10 == 4)
    return L.paginate_natural(b, 20000, 2)


NUMBERED = f"""{LINES}, h AS (SELECT doc_id, pos, (pos * 7 % 3 + 1)::INT AS level FROM lines),
g AS (SELECT *, sum((level < 2)::INT) OVER w AS g2, sum((level < 3)::INT) OVER w AS g3 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS n1, sum((level = 2)::INT) OVER (PARTITION BY doc_id, g2 ORDER BY pos) AS n2,
  sum((level = 3)::INT) OVER (PARTITION BY doc_id, g3 ORDER BY pos) AS n3 FROM g)"""


@query(f"""WITH {NUMBERED} SELECT doc_id, pos::INT AS pos, level, n1 || CASE WHEN level > 1 THEN '.' || n2 ELSE '' END || CASE WHEN level > 2 THEN '.' || n3 ELSE '' END AS number FROM n""")
def w4_outline_numbers(spark, d):
    h = paragraphs(spark, d).select("doc_id", "pos", (F.col("pos") * 7 % 3 + 1).cast("int").alias("level"))
    return L.outline_numbers(h)


@query(f"""WITH {LINES}, b AS (SELECT doc_id, pos, text, (sum(greatest(1, ceil(length(text) / 80.0))::BIGINT * 1800) OVER (PARTITION BY doc_id ORDER BY pos) - greatest(1, ceil(length(text) / 80.0))::BIGINT * 1800)::BIGINT // 20000 AS page FROM lines)
SELECT doc_id, (pos % 3 + 1)::INT AS level, text, (page + 1)::BIGINT AS page FROM b WHERE pos % 5 = 0 AND pos % 3 + 1 <= 2""")
def w5_build_toc(spark, d):
    b = L.block_heights(paragraphs(spark, d)).withColumn("forced", F.lit(False))
    placed = L.paginate_natural(b, 20000).select("doc_id", "pos", "page")
    heads = b.filter("pos % 5 = 0").withColumn("level", (F.col("pos") % 3 + 1).cast("int")).filter("level <= 2")
    return heads.join(placed, ["doc_id", "pos"]).select("doc_id", "level", "text", (F.col("page") + 1).alias("page"))


@query("""WITH s AS (SELECT doc_id, source, greatest(1, ceil(n_chars / 2000.0))::INT AS n FROM documents), p AS (SELECT *, unnest(range(0, n)) AS i FROM s)
SELECT doc_id, i::INT AS page, 'header' AS part, 'left' AS slot, source AS text FROM p
UNION ALL SELECT doc_id, i::INT, 'footer', 'center', '- ' || (i + 5) || ' / ' || n || ' -' FROM p""")
def w10_page_headers(spark, d):
    """Header and footer slots of each page, numbered from 5, with tokens filled in; empty slots are skipped."""
    s = docs(spark, d).select("doc_id", "source", F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 2000.0)).cast("int").alias("n"))
    p = s.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page"), F.col("n").alias("pages"), F.col("source").alias("title"))
    return L.page_headers(p, [("header", "left", "{TITLE}"), ("header", "center", ""), ("footer", "center", "- {PAGE} / {numpages} -")], 5)


@query("""SELECT key, id, age, undo, redo FROM (SELECT user_id AS key, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age,
  lag(event_id) OVER w AS undo, lead(event_id) OVER w AS redo FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE age <= 20""")
def w12_snapshot_history(spark, d):
    return L.snapshot_history(read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts"), 20).withColumn("age", F.col("age").cast("long"))


@query("""WITH r AS (SELECT round(l_quantity::DOUBLE / 3, 1) AS size, l_returnflag AS face, l_orderkey * 10 + l_linenumber AS o FROM lineitem),
f AS (SELECT size, face, min(o) AS first, count(*) AS uses FROM r GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (ORDER BY first, size, face) AS style_id FROM f WHERE NOT (size = 5 AND face = 'N'))
SELECT size, face, uses, style_id FROM n UNION ALL SELECT size, face, uses, 0 FROM f WHERE size = 5 AND face = 'N'""")
def a7_intern_styles(spark, d):
    """Sizes, rounded to a tenth, and faces of runs; 5 and N is the default."""
    r = read_table(spark, d, "lineitem").select((F.col("l_quantity").cast("double") / 3).alias("size"), F.col("l_returnflag").alias("face"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return L.intern_styles(r, ["size", "face"], ["at"], {"size": 5.0, "face": "N"}, 1)


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 1)::INT AS page, l_quantity::DOUBLE * 7 AS y_mm FROM lineitem),
c AS (SELECT *, page * 1010.0::DOUBLE + y_mm * 96.0::DOUBLE / 25.4::DOUBLE AS y FROM i)
SELECT l_orderkey, l_linenumber, page, y_mm, round(y, 6) AS y_dip, floor(y / 1010)::BIGINT AS back_page, round(least(y - floor(y / 1010) * 1010, 1000) * 25.4::DOUBLE / 96.0::DOUBLE, 6) AS back_y_mm FROM c""")
def l10_page_coordinates(spark, d):
    i = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).cast("int").alias("page"), (F.col("l_quantity").cast("double") * 7).alias("y_mm"))
    return L.page_coordinates(i, 1000.0)


@query("""WITH e AS (SELECT user_id AS key, event_id AS id, ts, event_id % 5 <> 0 AS edit, CASE WHEN event_id % 5 = 0 OR (lag(event_id) OVER w) % 5 <> 0 AND ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, id)::BIGINT AS burst FROM e)
SELECT key, burst, min(ts) AS started, count(*) AS n FROM b WHERE edit GROUP BY 1, 2""")
def st4_edit_bursts(spark, d):
    """Four of five events are edits; the others close a burst."""
    return L.edit_bursts(read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", (F.col("event_id") % 5 != 0).alias("edit")), 1800)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st4_hourly_events(spark, d):
    e = read_table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


ESCAPE_MD = "regexp_replace({}, '([\\\\`*_\\[\\]<>#~|^])', '\\\\\\1', 'g')"
ESCAPE_HTML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
LETTERS = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))"


# ---- All blocks of pages -------------------------------------------------------------------------------------------

#: By line number modulo 8: the markup of a line, and the elements that it stands for: kind, outline, list_kind, list_level,
#: number, checked, quote_level, language, text and src; {t} is the line.
MARKUP = [
    "<h2>{t}</h2>", "<p>{t}<br/>{t}</p>", "<ul><li>{t}</li><li>u</li></ul>", '<ol start="5"><li>{t}</li><li value=9><input type="checkbox" checked>{t}</li></ol>',
    "<blockquote><p>{t}</p><blockquote><p>q</p></blockquote></blockquote>", '<pre><code class="language-py">\n{t}  ``` &lt;x\n</code></pre>', '<hr><iframe src="u/7"></iframe>', "<img src='a.png' alt=\"{t}\"><div>{t}</div>",
]
ELEMENTS = [
    (0, 0, "heading", 2, None, 0, None, None, 0, None, "{t}", None), (1, 0, "paragraph", 0, None, 0, None, None, 0, None, "{t}\n{t}", None), (2, 0, "item", 0, "bullet", 1, None, None, 0, None, "{t}", None),
    (2, 1, "item", 0, "bullet", 1, None, None, 0, None, "u", None), (3, 0, "item", 0, "ordered", 1, 5, None, 0, None, "{t}", None), (3, 1, "item", 0, "ordered", 1, 9, True, 0, None, "{t}", None),
    (4, 0, "paragraph", 0, None, 0, None, None, 1, None, "{t}", None), (4, 1, "paragraph", 0, None, 0, None, None, 2, None, "q", None), (5, 0, "code", 0, None, 0, None, None, 0, "py", "{t}  ``` <x", None),
    (6, 0, "rule", 0, None, 0, None, None, 0, None, "", ""), (6, 1, "media", 0, None, 0, None, None, 0, None, "[iframe u/7]", "u/7"), (7, 0, "image", 0, None, 0, None, None, 0, None, "{t}", "a.png"), (7, 1, "text", 0, None, 0, None, None, 0, None, "{t}", None),
]


def _sql(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


ELEMENT_ROWS = f"""made AS (SELECT doc_id AS page_id, pos, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS t FROM lines),
shapes(k, sub, kind, outline, list_kind, list_level, number, checked, quote_level, language, shape, src) AS (VALUES {", ".join("(" + ", ".join(map(_sql, e)) + ")" for e in ELEMENTS)}),
e AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos, sub) AS block_no, kind, outline, list_kind, list_level, number, checked, quote_level, language, replace(shape, '{{t}}', t) AS text, src
  FROM made JOIN shapes ON k = pos % 8 WHERE t <> '')"""


def marked_pages(spark, d):
    """A page for each document, with its lines in all kinds of elements by turns."""
    t = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    line = F.element_at(F.array(*map(F.lit, MARKUP)), (F.col("pos") % 8 + 1).cast("int"))
    rows = dealt_paragraphs(spark, d).withColumn("t", t).filter("t <> ''").select("doc_id", "pos", F.replace(line, F.lit("{t}"), F.col("t")).alias("x"))
    body = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("r"))
    html = F.concat(F.lit("<html><head><title>no</title><style>p {}</style></head><body>"), F.array_join(F.transform("r", lambda x: x["x"]), "\n"), F.lit("</body></html>"))
    return body.select(F.col("doc_id").alias("page_id"), html.alias("html"))


@query(f"WITH {LINES}, {ELEMENT_ROWS} SELECT * REPLACE (checked::VARCHAR AS checked) FROM e")
def p3_html_elements(spark, d):
    return long(H.html_elements(marked_pages(spark, d)), "block_no").withColumn("checked", F.col("checked").cast("string"))


LISTED = "coalesce(block_no - lag(block_no) OVER w = 1 AND list_level = lag(list_level) OVER w AND list_kind = lag(list_kind) OVER w, false)"


@query(f"""WITH {LINES}, {ELEMENT_ROWS}, i AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY block_no)::BIGINT AS list_no FROM (SELECT *, {LISTED} AS goes_on FROM e WHERE kind = 'item' WINDOW w AS (PARTITION BY page_id ORDER BY block_no)))
SELECT page_id, list_no, max(list_kind) AS list_kind, max(list_level) AS level, min(block_no) AS first_block, count(*) AS items, CASE WHEN max(list_kind) = 'ordered' AND arg_min(number, block_no) <> 1 THEN arg_min(number, block_no) END AS start FROM i GROUP BY 1, 2""")
def w1_element_lists(spark, d):
    return long(H.element_lists(H.html_elements(marked_pages(spark, d))), "first_block")


MD_TEXT = "replace(regexp_replace(text, '([\\\\`*_\\[\\]<>#~|^])', '\\\\\\1', 'g'), chr(10), '  ' || chr(10))"


ELEMENTS_MD = f"""WITH {LINES}, {ELEMENT_ROWS}, b AS (SELECT *, CASE kind WHEN 'heading' THEN repeat('#', outline) || ' ' || {MD_TEXT} WHEN 'item' THEN repeat('  ', list_level - 1) || CASE list_kind WHEN 'ordered' THEN number || '. ' ELSE '- ' END
  || CASE WHEN checked THEN '[x] ' ELSE '' END || {MD_TEXT} WHEN 'code' THEN '````' || language || chr(10) || text || chr(10) || '````' WHEN 'rule' THEN '---' WHEN 'image' THEN '![' || text || '](' || src || ')' ELSE {MD_TEXT} END AS body FROM e),
l AS (SELECT page_id, block_no, CASE WHEN lag(kind) OVER w IS NULL THEN '' WHEN kind = 'item' AND lag(kind) OVER w = 'item' THEN chr(10) ELSE chr(10) || chr(10) END || repeat('> ', quote_level) || body AS line FROM b WINDOW w AS (PARTITION BY page_id ORDER BY block_no))
SELECT page_id, sha256(string_agg(line, '' ORDER BY block_no)) AS sha256 FROM l GROUP BY 1"""


@query(ELEMENTS_MD)
def r2_elements_to_markdown(spark, d):
    return H.elements_to_markdown(H.html_elements(marked_pages(spark, d))).select("page_id", F.sha2("text", 256).alias("sha256"))


def _elements_html(xhtml: bool) -> str:
    end, head = (" />", """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml"><body>' || chr(10)""") if xhtml else (">", "'<!DOCTYPE html>' || chr(10) || '<html><body>' || chr(10)")
    box = f'<input type="checkbox" disabled="disabled" checked="checked"{end} ' if xhtml else '<input type="checkbox" disabled checked> '
    t = ESCAPE_HTML.format("text")
    t = f"""replace(replace({t}, '"', '&quot;'), '''', '&apos;')""" if xhtml else t
    t = f"CASE WHEN kind = 'code' THEN {t} ELSE replace({t}, chr(10), '<br{end}') END"
    return f"""WITH {LINES}, {ELEMENT_ROWS}, g AS (SELECT *, {t} AS x, CASE WHEN kind = 'item' THEN list_kind || ':' || list_level || ':' || quote_level END AS grp FROM e),
n AS (SELECT *, lag(grp) OVER w AS g0, lead(grp) OVER w AS g1, coalesce(lag(quote_level) OVER w, 0) AS q0, coalesce(lead(quote_level) OVER w, 0) AS q1 FROM g WINDOW w AS (PARTITION BY page_id ORDER BY block_no)),
l AS (SELECT page_id, block_no, repeat('<blockquote>' || chr(10), greatest(quote_level - q0, 0)) || CASE WHEN kind = 'item' AND g0 IS DISTINCT FROM grp THEN CASE list_kind WHEN 'ordered' THEN '<ol' || CASE WHEN number <> 1 THEN ' start="' || number || '"' ELSE '' END || '>' ELSE '<ul>' END || chr(10) ELSE '' END
  || CASE kind WHEN 'item' THEN '<li>' || CASE WHEN checked THEN '{box}' ELSE '' END || x || '</li>' WHEN 'heading' THEN '<h' || outline || '>' || x || '</h' || outline || '>' WHEN 'code' THEN '<pre><code class="language-' || language || '">' || x || '</code></pre>'
    WHEN 'rule' THEN '<hr{end}' WHEN 'image' THEN '<img src="' || src || '" alt="' || text || '"{end}' ELSE '<p>' || x || '</p>' END
  || CASE WHEN kind = 'item' AND g1 IS DISTINCT FROM grp THEN chr(10) || CASE list_kind WHEN 'ordered' THEN '</ol>' ELSE '</ul>' END ELSE '' END || repeat(chr(10) || '</blockquote>', greatest(quote_level - q1, 0)) AS line FROM n)
SELECT page_id, sha256({head} || string_agg(line, chr(10) ORDER BY block_no) || chr(10) || '</body></html>' || chr(10)) AS sha256 FROM l GROUP BY 1"""


@query(_elements_html(False))
def r3_elements_to_html(spark, d):
    return H.elements_to_html(H.html_elements(marked_pages(spark, d))).select("page_id", F.sha2("text", 256).alias("sha256"))


@query(_elements_html(True))
def r4_elements_to_xhtml(spark, d):
    return H.elements_to_html(H.html_elements(marked_pages(spark, d)), xhtml=True).select("page_id", F.sha2("text", 256).alias("sha256"))


@query(f"""WITH {LINES}, {ELEMENT_ROWS},
plain AS (SELECT d.doc_id, d.doc_id % 4 AS t, coalesce(d.text, '') = '' AS none, string_agg(l.text, chr(10) ORDER BY l.pos) AS txt, string_agg({ESCAPE_MD.format("l.text")}, chr(10) || chr(10) ORDER BY l.pos) AS md,
  '<!DOCTYPE html>' || chr(10) || '<html><body>' || chr(10) || string_agg('<p>' || {ESCAPE_HTML.format("l.text")} || '</p>', chr(10) ORDER BY l.pos) || chr(10) || '</body></html>' || chr(10) AS html FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY 1, 2, 3),
page AS (SELECT page_id, 'txt' AS "to", sha256(string_agg(text, chr(10) ORDER BY block_no)) AS sha256 FROM e GROUP BY 1 UNION ALL SELECT page_id, 'md', sha256 FROM ({ELEMENTS_MD})
  UNION ALL SELECT page_id, 'html', sha256 FROM ({_elements_html(False)}) UNION ALL SELECT page_id, 'xhtml', sha256 FROM ({_elements_html(True)}))
SELECT 'txt' AS "from", ['txt', 'md', 'html', 'docx'][t + 1] AS "to", doc_id, CASE WHEN none THEN 4 WHEN t = 3 THEN 3 ELSE 0 END AS code, CASE WHEN NOT none THEN sha256(CASE t WHEN 0 THEN txt WHEN 1 THEN md WHEN 2 THEN html END) END AS sha256 FROM plain
UNION ALL SELECT 'html', "to", page_id, 0, sha256 FROM page WHERE "to" = ['txt', 'md', 'html', 'xhtml'][page_id % 4 + 1]
UNION ALL SELECT 'xml', 'txt', doc_id, CASE WHEN doc_id % 5 = 0 THEN 5 ELSE 0 END, CASE WHEN doc_id % 5 <> 0 AND {LETTERS} <> '' THEN sha256({LETTERS}) END FROM documents
UNION ALL SELECT 'docx', 'txt', doc_id, CASE WHEN doc_id % 7 = 0 THEN 6 ELSE 0 END, CASE WHEN doc_id % 7 <> 0 THEN sha256({LETTERS}) END FROM documents""")
def s12_convert_corpus(spark, d):
    """Documents, pages, XML and DOCX documents made of the texts, each converted to the format asked for, with the hash of what
    came out and the outcome: 0 done, 3 no such pair, 4 empty, 5 damaged or not allowed, 6 too old."""
    from ..operators.codecs import convert_corpus, default_registry

    letters = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    t, one = docs(spark, d), lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % len(x) + 1).cast("int"))
    plain = t.select("doc_id", F.lit("txt").alias("from"), one("txt", "md", "html", "docx").alias("to"), F.coalesce("text", F.lit("")).alias("text"))
    page = marked_pages(spark, d).select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")).select("doc_id", F.lit("html").alias("from"), one("txt", "md", "html", "xhtml").alias("to"), "text")
    kind = F.when(F.col("doc_id") % 5 == 0, '<!DOCTYPE d [<!ENTITY a "b">]>').otherwise("")
    xml = t.select("doc_id", F.lit("xml").alias("from"), F.lit("txt").alias("to"), F.concat(kind, F.lit("<d><p>"), letters, F.lit("</p></d>")).alias("text"))
    version = F.when(F.col("doc_id") % 7 == 0, "14.0300").otherwise("16.0000")
    docx = t.select("doc_id", F.lit("docx").alias("from"), F.lit("txt").alias("to"), F.concat(F.lit("<Properties><AppVersion>"), version, F.lit("</AppVersion></Properties><w:body><w:p><w:r><w:t>"), letters, F.lit("</w:t></w:r></w:p></w:body>")).alias("text"))
    pairs = [("txt", x) for x in ("txt", "md", "html", "docx")] + [("html", x) for x in ("txt", "md", "html", "xhtml")] + [("xml", "txt"), ("docx", "txt")]
    done = convert_corpus(default_registry(spark), plain.unionByName(page).unionByName(xml).unionByName(docx), pairs)
    return done.select("from", "to", "doc_id", "code", F.sha2("text", 256).alias("sha256"))
