"""Queries over markup, packages, notes and streams. Their inputs are made from the tables, and the SQL reads the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import html as H
from ..operators import inline as I
from ..operators import joins as J
from ..operators import markup as M
from ..operators import text as X
from ..operators.layout import WIDTHS, split_overlay
from ..sources.tables import dealt, read_table
from ..streaming import streams as S
from .documents import LINES, STATS, dealt_paragraphs, docs, paragraphs
from .layouts import BODY, pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def joined(rows, key: str, order: str, line, sep: str = "\n"):
    """One text for each key from lines in order."""
    r = rows.withColumn("_line", line).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "_line"))).alias("r"))
    return r.select(key, F.array_join(F.transform("r", lambda x: x["_line"]), sep).alias("text"))


# ---- Markdown -------------------------------------------------------------------------------------------------------

#: Letters only, so that no line is markup by itself.
PLAIN = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), '^ +', ''))"


def plain_lines(spark, d):
    t = F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z]+", " "), "^ +", ""))
    return dealt_paragraphs(spark, d).withColumn("t", t).filter("t <> ''")


@query(f"""WITH {LINES}, l AS (SELECT doc_id, pos, {PLAIN} AS t FROM lines), k AS (SELECT doc_id, pos, t, pos % 11 AS k FROM l WHERE t <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS block_no,
  ['heading', 'bullet', 'ordered', 'quote', 'code', 'paragraph', 'heading', 'heading', 'table', 'math', 'html'][k + 1] AS kind, [2, 1, 1, 2, 0, 0, 1, 2, 0, 0, 0][k + 1]::INT AS level,
  CASE WHEN k = 1 THEN (pos % 4 = 1)::VARCHAR END AS checked, CASE WHEN k = 2 THEN pos::INT END AS number, CASE WHEN k = 4 THEN 'py' END AS language,
  CASE k WHEN 8 THEN '| ' || t || ' | x |' || chr(10) || '| --- | :-: |' WHEN 9 THEN t || chr(10) || '+ 1' WHEN 10 THEN '<div>' || t || '</div>' ELSE t END AS text FROM k""")
def p11_md_blocks(spark, d):
    """Lines of documents as all kinds of blocks by their number."""
    t = F.col("t")
    task = F.when(F.col("pos") % 4 == 1, "- [x] ").otherwise("- [ ] ")
    shapes = [
        F.concat(F.lit("## "), t, F.lit(" ##")), F.concat(task, t), F.concat(F.col("pos").cast("string"), F.lit(". "), t), F.concat(F.lit("> > "), t), F.concat(F.lit("```py\n"), t, F.lit("\n```")), t, F.concat(t, F.lit("\n===")),
        F.concat(t, F.lit("\n---")), F.concat(F.lit("| "), t, F.lit(" | x |\n| --- | :-: |")), F.concat(F.lit("$$\n"), t, F.lit("\n+ 1\n$$")), F.concat(F.lit("<div>"), t, F.lit("</div>")),
    ]
    line = F.element_at(F.array(*shapes), (F.col("pos") % 11 + 1).cast("int"))
    return M.md_blocks(joined(plain_lines(spark, d), "doc_id", "pos", line, "\n\n")).withColumn("checked", F.col("checked").cast("string"))


@query(f"""WITH {LINES}, l AS (SELECT doc_id, pos, {PLAIN} AS t, pos % 6 AS k FROM lines), s(k, sub, quote_level, kind, level, number, language, shape) AS (VALUES
  (0, 0, 0, 'code', 0, NULL, 'py', '```' || chr(10) || '~~~' || chr(10) || '?' || chr(10) || '> q'), (1, 0, 1, 'heading', 2, NULL, NULL, '?'), (1, 1, 1, 'paragraph', 0, NULL, NULL, 'on' || chr(10) || 'more'), (1, 2, 2, 'paragraph', 0, NULL, NULL, 'deep'),
  (2, 0, 1, 'ordered', 1, 7, NULL, '?'), (2, 1, 1, 'bullet', 2, NULL, NULL, 'in'), (3, 0, 1, 'code', 0, NULL, '', '?' || chr(10) || '> x'), (3, 1, 0, 'paragraph', 0, NULL, NULL, 'after'), (4, 0, 0, 'bullet', 1, NULL, NULL, '?'), (4, 1, 0, 'code', 0, NULL, 'c', '  x'), (5, 0, 0, 'paragraph', 0, NULL, NULL, '?'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub)::INT AS block_no, quote_level, kind, level, number, language, replace(shape, '?', t) AS text FROM l JOIN s USING (k) WHERE t <> ''""")
def p11_md_containers(spark, d):
    """Lines in fences that hold shorter and other fences, in headings, lists and fences inside quotes, and in items with code."""
    t = F.col("t")
    shapes = [
        F.concat(F.lit("````py\n```\n~~~\n"), t, F.lit("\n> q\n`````")), F.concat(F.lit("> ## "), t, F.lit("\n> on\n> more\n>> deep")), F.concat(F.lit("> 7. "), t, F.lit("\n>   - in")),
        F.concat(F.lit("> ~~~\n> "), t, F.lit("\n> > x\nafter")), F.concat(F.lit("- "), t, F.lit("\n  ```c\n  x\n  ```")), t,
    ]
    line = F.element_at(F.array(*shapes), (F.col("pos") % 6 + 1).cast("int"))
    return M.md_containers(joined(plain_lines(spark, d), "doc_id", "pos", line, "\n\n")).drop("checked")


@query(f"""WITH {LINES}, l AS (SELECT doc_id, pos, {PLAIN} AS t FROM lines)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS run_no, ['strong', 'em', 'strike', 'code', 'link', 'math', 'sub', 'sup', 'break', 'strong'][pos % 10 + 1] AS kind,
  CASE WHEN pos % 10 = 8 THEN chr(10) ELSE t END AS text, CASE WHEN pos % 10 = 4 THEN 'u/' || pos END AS url FROM l WHERE t <> ''""")
def p12_md_runs(spark, d):
    """Lines of documents as runs of all kinds by their number."""
    k, t = F.col("pos") % 10, F.col("t")
    wrap = lambda m: F.concat(F.lit(m), t, F.lit(m))
    line = F.lit("")
    for n, x in enumerate([wrap("**"), wrap("*"), wrap("~~"), wrap("`"), F.concat(F.lit("["), t, F.lit("](u/"), F.col("pos").cast("string"), F.lit(")")), wrap("$"), wrap("~"), wrap("^"), F.lit("  \n"), wrap("__")]):
        line = F.when(k == n, x).otherwise(line)
    return M.md_runs(joined(plain_lines(spark, d), "doc_id", "pos", line, ""))


#: Runs of generated nestings: (k, no, text before, whether the line is in it, text after, styles, kind, url).
_NESTED = [
    (0, [("", 1, " ", "b", "text", 0), ("mid", 0, "", "bi", "text", 0), (" ", 0, "", "b", "text", 0), ("link ", 0, "", "bu", "text", 1), ("c*d", 0, "", "bu", "code", 1), (" end", 0, "", "", "text", 0)]),
    (1, [("", 1, "", "bi", "text", 0), (" x", 0, "", "i", "text", 0)]),
    (2, [("", 1, " ", "i", "text", 0), ("b", 0, "", "bi", "text", 0)]),
    (3, [("", 1, " H", "s", "text", 0), ("2", 0, "", "sl", "text", 0), ("O", 0, "", "s", "text", 0), (" x", 0, "", "", "text", 0), ("2", 0, "", "p", "text", 0)]),
    (4, [("snake_case_", 1, " ", "", "text", 0), ("b", 0, "", "b", "text", 0), (" ", 0, "", "", "text", 0), ("i", 0, "", "i", "text", 0)]),
    (5, [("*", 1, "* 2 * 3 [x]( & ]", "", "text", 0)]),
    (6, [("[", 1, "](u/p.png) ", "", "text", 0), ("in ", 0, "", "u", "text", 1), ("bold ", 0, "", "bu", "text", 1), ("both", 0, "", "biu", "text", 1)]),
]
_NESTED_ROWS = ", ".join(
    f"({k}, {n}, '{a}', {own}, '{b}', {', '.join(str(x in st).lower() for x in 'bislpu')}, '{kind}', {url})" for k, runs in _NESTED for n, (a, own, b, st, kind, url) in enumerate(runs)
)


@query(f"""WITH {LINES}, l AS (SELECT doc_id, pos, {PLAIN} AS t FROM lines), r(k, run_no, a, own, b, bold, italic, strike, sub, sup, underline, kind, has_url) AS (VALUES {_NESTED_ROWS})
SELECT doc_id, pos::INT AS block_no, run_no::INT AS run_no, kind, a || CASE WHEN own = 1 THEN t ELSE '' END || b AS text, bold, italic, strike, sub, sup, underline, CASE WHEN has_url = 1 THEN 'u/' || pos END AS url
FROM l JOIN r ON pos % 7 = k WHERE t <> ''""")
def p12_md_inline(spark, d):
    """Lines of documents inside nested emphasis, links, images and marks without a partner."""
    t, url = F.col("t"), F.concat(F.lit("](u/"), F.col("pos").cast("string"), F.lit(")"))
    shapes = [
        F.concat(F.lit("**"), t, F.lit(" *mid* [link `c*d`"), url, F.lit("** end")), F.concat(F.lit("***"), t, F.lit("** x*")), F.concat(F.lit("*"), t, F.lit(" **b***")), F.concat(F.lit("~~"), t, F.lit(" H~2~O~~ x^2^")),
        F.concat(F.lit("snake_case_"), t, F.lit(" __b__ _i_")), F.concat(F.lit("\\*"), t, F.lit("\\* 2 * 3 [x]( &amp; ]")), F.concat(F.lit("![*"), t, F.lit("*](u/p.png) [in **bold _both_**"), url),
    ]
    line = F.element_at(F.array(*shapes), (F.col("pos") % 7 + 1).cast("int"))
    return I.md_inline(plain_lines(spark, d).select("doc_id", F.col("pos").cast("int").alias("block_no"), line.alias("text")))


#: A table for each order, with a row for each item.
ITEMS = """i AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, max(l_returnflag || l_linestatus) AS name FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INT AS r FROM i)"""


#: Rows of lineitem that one task makes into tables and takes apart again.
ITEMS_EACH = 25_000


def items(spark, d, key: str):
    """The items of each order, dealt by order: what follows goes on by order without another shuffle."""
    i = read_table(spark, d, "lineitem")
    i = i.select(F.col("l_orderkey").alias(key), F.col("l_linenumber").alias("k"), F.concat("l_returnflag", "l_linestatus").alias("name"))
    return dealt(i, key, read_table(spark, d, "lineitem").count(), ITEMS_EACH).groupBy(key, "k").agg(F.max("name").alias("name"))


@query(f"""WITH {ITEMS}, rows_ AS (SELECT doc_id, r, k::VARCHAR AS a, CASE WHEN r % 3 = 0 THEN '' ELSE name END AS b FROM n UNION ALL SELECT DISTINCT doc_id, 0, 'key', 'a|b' FROM n)
SELECT doc_id, 1 AS table_no, r AS row_no, 0 AS cell_no, r = 0 AS is_header, 'right' AS align, a AS text FROM rows_
UNION ALL SELECT doc_id, 1, r, 1, r = 0, 'left', b FROM rows_ UNION ALL SELECT doc_id, 1, r, 2, false, 'none', 'more' FROM n WHERE r % 3 = 1""")
def p13_md_tables(spark, d):
    """Every third row lacks a cell, which is padded; another third has one beyond the rule."""
    cells = F.when(F.col("r") % 3 == 0, F.lit(" |")).when(F.col("r") % 3 == 1, F.concat(F.lit(" | "), "name", F.lit(" | more |"))).otherwise(F.concat(F.lit(" | "), "name", F.lit(" |")))
    n = items(spark, d, "doc_id").withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("k")))
    body = joined(n, "doc_id", "k", F.concat(F.lit("| "), F.col("k").cast("string"), cells))
    t = body.select("doc_id", F.concat(F.lit("text before\n\n| key | a\\|b |\n| ---: | :--- |\n"), "text", F.lit("\n\nafter")).alias("text"))
    out = M.md_tables(t)
    return out.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("table_no", "row_no", "cell_no")], "is_header", "align", "text")


@query("""SELECT doc_id, 1 AS block_no, CASE WHEN doc_id % 3 = 0 THEN 'paragraph' ELSE 'image' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'see [' || source || '](img/' || doc_id || '.png) here' ELSE source END AS text,
  CASE WHEN doc_id % 3 <> 0 THEN 'img/' || doc_id || '.png' END AS url, CASE WHEN doc_id % 3 <> 0 THEN 'image/png' END AS media FROM documents""")
def p14_md_images(spark, d):
    """A paragraph with an image alone, or with one inside its text."""
    image = F.concat(F.lit("!["), "source", F.lit("](img/"), F.col("doc_id").cast("string"), F.lit(".png)"))
    t = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see "), image, F.lit(" here"))).otherwise(image).alias("text"))
    return M.md_images(t).withColumn("block_no", F.col("block_no").cast("int"))


# ---- HTML -----------------------------------------------------------------------------------------------------------


def item_tables(spark, d):
    row = F.concat(F.lit("<tr><td>"), F.col("k").cast("string"), F.lit('</td><td rowspan="1" colspan="2">'), "name", F.lit("</td></tr>"))
    body = joined(items(spark, d, "page_id"), "page_id", "k", row, "")
    head = "<table><thead><tr><th>key</th><th colspan=2>name &amp; all</th></tr></thead><tbody>"
    return body.select("page_id", F.concat(F.lit(head), "text", F.lit("</tbody></table>")).alias("html"))


@query(f"""WITH {ITEMS}, rows_ AS (SELECT doc_id, r, k::VARCHAR AS a, name AS b FROM n UNION ALL SELECT DISTINCT doc_id, 0, 'key', 'name & all' FROM n)
SELECT doc_id AS page_id, r AS row_no, 0 AS cell_no, r = 0 AS is_header, 1 AS row_span, 1 AS col_span, a AS text FROM rows_ UNION ALL SELECT doc_id, r, 1, r = 0, 1, 2, b FROM rows_""")
def p7_html_cells(spark, d):
    return M.html_cells(item_tables(spark, d)).drop("table_no")


@query("SELECT l_orderkey AS page_id, count(DISTINCT l_linenumber) + 1 AS n_rows, 3::BIGINT AS n_cols, 1::BIGINT AS n_heads, 3 * (count(DISTINCT l_linenumber) + 1) AS grid FROM lineitem GROUP BY 1")
def a11_table_shape(spark, d):
    return M.table_shape(M.html_cells(item_tables(spark, d)), "page_id").drop("table_no")


@query("""SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 0 THEN 'image/jpeg' ELSE 'image/gif' END AS media, source AS alt, round((doc_id % 500) * 25.4::DOUBLE / 96.0::DOUBLE, 3) AS width_mm,
  CASE WHEN doc_id % 2 = 1 THEN length(source)::INT END AS inline_bytes FROM documents""")
def p6_html_images(spark, d):
    src = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a/"), "source", F.lit(".JPG?x=1"))).otherwise(F.concat(F.lit("data:image/gif;base64,"), F.base64(F.col("source").cast("binary"))))
    h = F.concat(F.lit('<body><p>t<img src="'), src, F.lit('" alt="'), "source", F.lit('" width="'), (F.col("doc_id") % 500).cast("string"), F.lit('"></p></body>'))
    return M.html_images(docs(spark, d).select(F.col("doc_id").alias("page_id"), h.alias("html"))).select("page_id", "media", "alt", "width_mm", "inline_bytes")


@query("""SELECT o_custkey AS page_id, 'footnote' AS note_kind, 'fn-' || o_orderkey AS note_id, o_orderstatus AS text, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS ordinal FROM orders""")
def p8_html_notes(spark, d):
    key = F.col("o_orderkey").cast("string")
    li = F.concat(F.lit('<li class="x" id="fn-'), key, F.lit('">'), "o_orderstatus", F.lit(' <a href="#fnref-'), key, F.lit('">back</a></li>'))
    body = joined(read_table(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), "o_orderkey", "o_orderstatus"), "page_id", "o_orderkey", li, "\n")
    return M.html_notes(body.select("page_id", F.concat(F.lit("<p>t</p><ol>"), "text", F.lit("</ol>")).alias("html")))


@query("""SELECT p_partkey AS id, 'width' AS property, p_size || 'px' AS value, round(p_size * (25.4::DOUBLE / 96.0::DOUBLE), 4) AS mm FROM part
UNION ALL SELECT p_partkey, 'margin-top', p_size || 'pt', round(p_size * (25.4::DOUBLE / 72.0::DOUBLE), 4) FROM part UNION ALL SELECT p_partkey, 'color', p_brand, NULL FROM part""")
def p10_css_declarations(spark, d):
    size = F.col("p_size").cast("string")
    style = F.concat(F.lit("WIDTH: 1cm; color:"), "p_brand", F.lit("; margin-top : "), size, F.lit("pt;width:"), size, F.lit("px;"))
    return M.css_declarations(read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), style.alias("style")))


HTML_LINE = """CASE WHEN kind = 'item' AND NOT coalesce(lag(kind) OVER w = 'item', false) THEN '<ul>' || chr(10) ELSE '' END || '<' || tag || '>' || e || '</' || tag || '>'
  || CASE WHEN kind = 'item' AND NOT coalesce(lead(kind) OVER w = 'item', false) THEN chr(10) || '</ul>' ELSE '' END"""


def _html_sql(head: str, escape: str) -> str:
    return f"""WITH {BODY}, t AS (SELECT *, CASE WHEN outline > 0 THEN 'h' || outline WHEN kind = 'item' THEN 'li' ELSE 'p' END AS tag, {escape} AS e FROM blocks),
l AS (SELECT page_id, block_no, {HTML_LINE} AS line FROM t WINDOW w AS (PARTITION BY page_id ORDER BY block_no))
SELECT page_id, sha256({head} || string_agg(line, chr(10) ORDER BY block_no) || chr(10) || '</body></html>' || chr(10)) AS sha256 FROM l GROUP BY 1"""


ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(_html_sql("'<!DOCTYPE html>' || chr(10) || '<html><body>' || chr(10)", ESCAPED))
def r3_to_html(spark, d):
    return M.to_html(H.html_blocks(pages(spark, d))).select("page_id", F.sha2("text", 256).alias("sha256"))


@query(_html_sql("""'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml"><body>' || chr(10)""", f"""replace(replace({ESCAPED}, '"', '&quot;'), '''', '&apos;')"""))
def r4_to_xhtml(spark, d):
    return M.to_html(H.html_blocks(pages(spark, d)), xhtml=True).select("page_id", F.sha2("text", 256).alias("sha256"))


# ---- JSON documents and packages ------------------------------------------------------------------------------------


def json_docs(spark, d):
    """Lines of documents as blocks whose kind is given by $type, by kind, or not at all."""
    k = F.col("doc_id") % 3
    b = F.struct(F.when(k == 0, "paragraph").alias("$type"), F.when(k == 1, "Paragraph").otherwise(F.when(k == 0, "other")).alias("kind"), "text", F.when(F.col("pos") % 5 == 0, 1).alias("outline"))
    rows = dealt_paragraphs(spark, d).withColumn("b", b).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "b"))).alias("r"))
    return rows.select("doc_id", F.to_json(F.struct(F.transform("r", lambda x: x["b"]).alias("blocks"))).alias("json"))


@query(f"WITH {LINES} SELECT doc_id, pos::INT AS pos, 'paragraph' AS kind, text, CASE WHEN pos % 5 = 0 THEN 1 ELSE 0 END AS outline, false AS error FROM lines")
def p18_json_blocks(spark, d):
    return M.json_blocks(json_docs(spark, d))


@query(f"WITH {LINES} SELECT doc_id, pos::INT AS pos, 'paragraph' AS kind, text, CASE WHEN pos % 5 = 0 THEN 1 ELSE 0 END AS outline, false AS error FROM lines")
def p19_blocks_to_json(spark, d):
    """Blocks to JSON and back."""
    return M.json_blocks(M.blocks_to_json(M.json_blocks(json_docs(spark, d))))


@query(f"WITH {LINES} SELECT doc_id AS pkg, pos::INT AS pos, CASE WHEN pos % 3 = 0 THEN 2 WHEN pos % 3 = 1 THEN 4 ELSE 0 END AS outline, pos % 4 = 3 AS page_break, {PLAIN} AS text FROM lines")
def p17_office_paragraphs(spark, d):
    t = F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z]+", " "), "^ +", ""))
    style = F.when(F.col("pos") % 3 == 0, '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>').when(F.col("pos") % 3 == 1, '<w:pPr><w:outlineLvl w:val="3"/></w:pPr>').otherwise("")
    x = F.concat(F.lit("<w:p>"), style, F.when(F.col("pos") % 4 == 3, '<w:r><w:br w:type="page"/></w:r>').otherwise(""), F.lit('<w:r><w:t xml:space="preserve">'), t, F.lit("</w:t></w:r></w:p>"))
    parts = joined(dealt_paragraphs(spark, d), "doc_id", "pos", x, "")
    return M.office_paragraphs(parts.select(F.col("doc_id").alias("pkg"), F.concat(F.lit("<w:body>"), "text", F.lit("</w:body>")).alias("content")))


def package_parts(spark, d):
    """A few parts for each document: some packages lack one, some are encrypted, some are old."""
    k = F.col("doc_id")
    hwpx = k % 5 == 0
    hwpx_version = F.concat(F.lit('<hv application="H" xmlVersion="'), F.when(k % 15 == 0, "1.1").when(k % 15 == 5, "1.2").otherwise("1.10"), F.lit('"/>'))
    version = F.concat(F.lit("<Properties><Application>W</Application><AppVersion>"), F.when(k % 7 == 0, "14.0300").when(k % 7 == 1, "").otherwise("16.0000"), F.lit("</AppVersion></Properties>"))
    core = F.concat(F.lit("<c><dc:title>"), "source", F.lit("</dc:title><dc:creator>"), F.when(k % 2 == 0, F.col("lang")).otherwise(""), F.lit("</dc:creator>"), F.when(k % 2 == 0, F.concat(F.lit('<dcterms:created t="x">2024-01-0'), (k % 9 + 1).cast("string"), F.lit("T10:00:00Z</dcterms:created>"))).otherwise(""), F.lit("</c>"))
    spine = F.lit('<opf><item id="b" href="Contents/section1.xml"/><item id="a" href="Contents/section0.xml"/><spine><itemref idref="a"/><itemref idref="b"/></spine></opf>')
    plain = F.lit('<opf><item id="section1" href="Contents/x1.xml"/><item id="section0" href="Contents/x0.xml"/></opf>')
    pairs = [
        (F.lit("mimetype"), F.lit("m")), (F.when((k % 11 != 0) & ~hwpx, "word/document.xml"), F.lit("<w/>")), (F.when(hwpx, "version.xml"), hwpx_version), (F.when(k % 13 == 0, "encryption.xml"), F.lit("x")), (F.lit("docProps/app.xml"), version),
        (F.lit("docProps/core.xml"), core), (F.when(k % 3 != 2, "content.hpf"), F.when(k % 3 == 0, spine).otherwise(plain)), (F.lit("Contents/Section9.xml"), F.lit("s")), (F.lit("Contents/section8.xml"), F.lit("s")),
    ]
    parts = F.array(*[F.struct(p.alias("path"), c.alias("content")) for p, c in pairs])
    return docs(spark, d).select(k.alias("pkg"), F.explode(parts).alias("p")).select("pkg", "p.path", "p.content").filter("path IS NOT NULL")


@query("SELECT doc_id AS pkg, CASE WHEN doc_id % 13 = 0 THEN 5 WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 15 = 0 THEN 6 ELSE 0 END WHEN doc_id % 11 = 0 THEN 5 WHEN doc_id % 7 = 0 THEN 6 ELSE 0 END AS code FROM documents")
def s6_package_admission(spark, d):
    return J.package_admission(package_parts(spark, d))


@query("""SELECT doc_id AS pkg, k::INT AS pos, CASE doc_id % 3 WHEN 0 THEN ['Contents/section0.xml', 'Contents/section1.xml'][k + 1] WHEN 1 THEN ['Contents/x0.xml', 'Contents/x1.xml'][k + 1]
  ELSE ['Contents/section8.xml', 'Contents/Section9.xml'][k + 1] END AS path FROM documents, (SELECT unnest([0, 1]) AS k)""")
def s7_spine_sections(spark, d):
    return J.spine_sections(package_parts(spark, d))


@query("""SELECT doc_id AS pkg, ['Contents/section8.xml', '\\Contents\\section8.xml', 'CONTENTS/SECTION9.XML', 'other/section8.xml', 'none'][doc_id % 5 + 1] AS ref,
  CASE doc_id % 5 WHEN 2 THEN 'Contents/Section9.xml' WHEN 4 THEN NULL ELSE 'Contents/section8.xml' END AS path FROM documents""")
def s8_resolve_part_path(spark, d):
    ref = F.element_at(F.array(*map(F.lit, ("Contents/section8.xml", "\\Contents\\section8.xml", "CONTENTS/SECTION9.XML", "other/section8.xml", "none"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return J.resolve_part_path(docs(spark, d).select(F.col("doc_id").alias("pkg"), ref.alias("ref")), package_parts(spark, d)).select("pkg", "ref", "path")


@query("""SELECT doc_id AS pkg, source AS title, CASE WHEN doc_id % 2 = 0 THEN lang END AS author, 'ko-KR' AS language, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-01 10:00:00' + to_days((doc_id % 9)::INT) END AS created,
  NULL::TIMESTAMP AS modified, 'W' AS application, CASE WHEN doc_id % 15 = 0 THEN '1.1' WHEN doc_id % 15 = 5 THEN '1.2' WHEN doc_id % 5 = 0 THEN '1.10' WHEN doc_id % 7 = 0 THEN '14.0300' WHEN doc_id % 7 = 1 THEN NULL ELSE '16.0000' END AS version FROM documents""")
def s15_package_metadata(spark, d):
    return J.package_metadata(package_parts(spark, d))


@query("""SELECT l_orderkey AS pkg, l_linenumber AS id, CASE WHEN l_linenumber <= 4 THEN 'font' || l_linenumber ELSE 'Default' END AS font, CASE WHEN l_linenumber <= 4 THEN l_linenumber * 100 ELSE 1000 END::INT AS size,
  CASE WHEN l_linenumber % 2 = 0 THEN 'right' ELSE 'left' END AS align, CASE WHEN l_linenumber = 1 THEN 0.4 ELSE 0.12 END::DOUBLE AS border_mm FROM lineitem""")
def j5_resolve_style_ids(spark, d):
    """Character, paragraph and border styles of paragraphs; some packages lack some ids."""
    p = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pkg"), F.col("l_linenumber").alias("id"))
    ids = p.distinct()
    char = ids.filter("id <= 4").select("pkg", "id", F.concat(F.lit("font"), F.col("id").cast("string")).alias("font"), (F.col("id") * 100).cast("int").alias("size"))
    para = ids.filter("id % 2 = 0").select("pkg", "id", F.lit("right").alias("align"))
    border = ids.filter("id = 1").select("pkg", "id", F.lit(0.4).alias("border_mm"))
    out = J.resolve_style_ids(p, char, {"font": "Default", "size": 1000})
    return J.resolve_style_ids(J.resolve_style_ids(out, para, {"align": "left"}), border, {"border_mm": 0.12})


# ---- Notes, resources, provenance -----------------------------------------------------------------------------------


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS number FROM orders)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE number END AS number, CASE WHEN l_linenumber = 7 THEN '' ELSE '[' || number || ']' END AS mark FROM lineitem JOIN n ON l_orderkey = o_orderkey""")
def j1_resolve_notes(spark, d):
    """Orders are notes of customers, items refer to them; the seventh of an order refers to none."""
    o = read_table(spark, d, "orders")
    notes = o.select(F.col("o_custkey").alias("doc_id"), F.lit("footnote").alias("kind"), F.col("o_orderkey").cast("string").alias("note_id"), F.col("o_orderkey").alias("ordinal"))
    i = read_table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    ident = F.when(F.col("l_linenumber") == 7, "gone").otherwise(F.col("l_orderkey").cast("string"))
    refs = i.select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("doc_id"), F.lit("footnote").alias("kind"), ident.alias("note_id"))
    return J.resolve_notes(refs, notes).select("l_orderkey", "l_linenumber", "number", "mark")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey))::INT AS number FROM orders")
def w11_note_numbers(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").cast("string").alias("note_id"), F.col("o_orderkey").alias("ordinal"))
    return J.note_numbers(o).select(F.col("ordinal").alias("o_orderkey"), "number")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'https://x/' || doc_id WHEN doc_id % 5 = 1 THEN 'gone/' || doc_id ELSE 'img/' || doc_id END AS path,
  CASE WHEN doc_id % 5 > 1 THEN octet_length(encode(coalesce(text, '')))::INT END AS size, CASE WHEN doc_id % 5 > 1 THEN sha256(coalesce(text, '')) END AS sha256, CASE WHEN doc_id % 5 = 0 THEN 'external' WHEN doc_id % 5 = 1 THEN 'missing' ELSE 'ok' END AS status FROM documents""")
def j2_rehydrate_resources(spark, d):
    k = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("https://x/"), k)).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("gone/"), k)).otherwise(F.concat(F.lit("img/"), k))
    parts = docs(spark, d).select("doc_id", F.concat(F.lit("img/"), k).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return J.rehydrate_resources(docs(spark, d).select("doc_id", path.alias("path")), parts, E.is_external_ref(F.col("path"))).select("doc_id", "path", "size", F.sha2("content", 256).alias("sha256"), "status")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN '*' WHEN 'view' THEN 'o' ELSE 'Web_' || event_type END AS text FROM events")
def j6_resolve_emoji(spark, d):
    catalogue = spark.createDataFrame([("Web", "click", "*"), ("Web", "view", "o")], "section string, name string, glyph string")
    runs = read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("Web_"), "event_type").alias("key"))
    return J.resolve_emoji(runs, catalogue).select(F.col("id").alias("event_id"), "text")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 2 = 0 THEN lang END AS author, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS editor,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 9 ELSE 1 END::BIGINT AS created, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 2 END::BIGINT AS modified, doc_id % 3 = 0 AS dirty FROM documents""")
def j7_apply_metadata_updates(spark, d):
    """Updates with an author in spaces and a blank editor for every third document."""
    one = F.lit(1).cast("long")
    old = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("author"), F.col("source").alias("editor"), one.alias("created"), (one + 1).alias("modified"))
    new = docs(spark, d).filter("doc_id % 3 = 0").select("doc_id", F.lit("  new ").alias("author"), F.lit("  ").alias("editor"), F.lit(9).cast("long").alias("at"))
    return J.apply_metadata_updates(old, new)


def anchored(spark, d):
    b = paragraphs(spark, d).select("doc_id", F.col("pos").cast("string").alias("node_id"), F.element_at(F.array(*map(F.lit, ("clean", "modified", "opaque", "degraded"))), (F.col("pos") % 4 + 1).cast("int")).alias("status"))
    a = b.filter("doc_id % 2 = 0").select("doc_id", "node_id", F.when(F.col("doc_id") % 4 == 0, "docx").otherwise("hwpx").alias("format"))
    return b, a.unionByName(docs(spark, d).filter("doc_id % 2 = 0").select("doc_id", F.lit("x").alias("node_id"), F.lit("docx").alias("format")))


@query(f"""WITH {LINES} SELECT doc_id, pos::VARCHAR AS node_id, CASE WHEN doc_id % 2 = 0 THEN 'anchored' ELSE 'unanchored' END AS state FROM lines
UNION ALL SELECT doc_id, 'x', 'orphan' FROM documents WHERE doc_id % 2 = 0""")
def j8_provenance_join(spark, d):
    return J.provenance_join(*anchored(spark, d))


@query(f"""WITH {LINES}, s AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'docx' WHEN doc_id % 2 = 0 THEN 'hwpx' END AS format, CASE WHEN doc_id % 2 = 0 THEN 'anchored' ELSE 'unanchored' END AS state FROM lines
UNION ALL SELECT 'docx', 'orphan' FROM documents WHERE doc_id % 2 = 0) SELECT format, state, count(*) AS n FROM s GROUP BY 1, 2""")
def j8_provenance_coverage(spark, d):
    return J.provenance_coverage(*anchored(spark, d))


@query(f"""WITH {LINES} SELECT doc_id, pos::VARCHAR AS node_id, CASE WHEN pos % 4 = 0 AND doc_id % 4 = 0 THEN 'reuse' WHEN pos % 4 = 2 AND doc_id % 4 = 0 THEN 're-emit' WHEN pos % 4 = 2 THEN 'placeholder'
  WHEN pos % 4 = 3 THEN 'degraded' ELSE 'reserialise' END AS action FROM lines""")
def j9_export_plan(spark, d):
    b, a = anchored(spark, d)
    return J.export_plan(b, a, "docx")


@query(f"""WITH {LINES} SELECT doc_id, count(*) FILTER (WHERE pos % 4 = 0) AS clean, count(*) FILTER (WHERE pos % 4 = 1) AS modified, count(*) FILTER (WHERE pos % 4 = 2) AS opaque,
  count(*) FILTER (WHERE pos % 4 = 3) AS degraded FROM lines GROUP BY 1""")
def a10_status_rollup(spark, d):
    b, _ = anchored(spark, d)
    return J.status_rollup(b)


# ---- Streams --------------------------------------------------------------------------------------------------------


@query(STATS)
def st1_stream_ingest(spark, d):
    return S.run_available(S.stream_ingest(S.read_stream(spark, f"{d}/documents.parquet")), "ingest")


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS sha256 FROM documents")
def st2_stream_dedupe(spark, d):
    """With an event time and bounded state; here no copy comes later than the delay."""
    t = S.read_stream(spark, f"{d}/documents.parquet").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")))
    return S.run_available(S.stream_dedupe(t, "at", "1000 days"), "dedupe")


@query("""WITH p AS (SELECT user_id AS job, event_id, (greatest(0, least(100, event_id % 140 - 20)))::INT AS percent, event_type AS message FROM events WHERE event_id % 4 <> 0)
SELECT job, arg_max(percent, event_id) AS percent, arg_max(message, event_id) AS message FROM p GROUP BY 1""")
def st3_progress(spark, d):
    """A stream of progress lines made of events, a quarter of them malformed; the last state of each job."""
    line = F.when(F.col("event_id") % 4 == 0, "PROGRESS:x:bad").otherwise(F.concat(F.lit("PROGRESS:"), (F.col("event_id") % 140 - 20).cast("string"), F.lit(":"), "event_type"))
    e = S.read_stream(spark, f"{d}/events.parquet").select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), line.alias("line"))
    return S.run_latest(S.stream_progress(e), "progress")


@query()
def st5_undo_state(spark, d):
    """Events as pushes, undos and redos of each user; a fold of states, which SQL does not say."""
    action = F.element_at(F.array(*map(F.lit, ("push", "push", "undo", "redo"))), (F.col("event_id") % 4 + 1).cast("int"))
    return S.undo_state(read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), action.alias("action")), 20)


# ---- Formats and layout ---------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 4 ELSE 0 END AS code, CASE WHEN coalesce(text, '') <> '' THEN
  sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\n$', ''), '\\r(\\n|$)', '\\1', 'g'), '([\\\\`*_\\[\\]<>#~|^])', '\\\\\\1', 'g'), '\\n', chr(10) || chr(10), 'g')) END AS sha256 FROM documents""")
def u1_codec_registry(spark, d):
    """Plain text to Markdown by registered formats."""
    from ..operators.codecs import default_registry

    return default_registry(spark).convert(docs(spark, d).select("doc_id", "text"), "txt", "md").select("doc_id", "code", F.sha2("text", 256).alias("sha256"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'textbox' WHEN 1 THEN 'table' WHEN 2 THEN 'image' ELSE 'shape' END AS kind,
  l_linenumber % 4 = 0 OR (l_linenumber % 4 = 1 AND l_quantity > 10) OR (l_linenumber % 4 > 1 AND l_quantity > 25) AS overlay FROM lineitem""")
def f2_split_overlay(spark, d):
    """Body and overlay by kind and wrap mode; text boxes always float, tables unless they wrap as blocks."""
    kind = F.element_at(F.array(*map(F.lit, ("textbox", "table", "image", "shape"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    wrap = F.when(kind == "table", F.when(F.col("l_quantity") > 10, "square").otherwise("block")).otherwise(F.when(F.col("l_quantity") > 25, "behind").otherwise("inline"))
    b = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), wrap.alias("wrap"))
    return split_overlay(b).select("l_orderkey", "l_linenumber", "kind", "overlay")


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%H:%M') WHEN 2 THEN (event_id % 9 + 1)::VARCHAR WHEN 3 THEN '12' WHEN 4 THEN user_id::VARCHAR WHEN 5 THEN event_type ELSE '' END AS text FROM events""")
def l4_fields(spark, d):
    """Field placeholders of runs: date, time, page, pages, author and title, and an unknown one."""
    f = F.element_at(F.array(*map(F.lit, ("date", "time", "page", "pages", "author", "Title", "other"))), (F.col("event_id") % 7 + 1).cast("int"))
    text = E.field_text(f, at=F.col("ts"), page=F.col("event_id") % 9 + 1, pages=F.lit(12), author=F.col("user_id"), title=F.col("event_type"))
    return read_table(spark, d, "events").select("event_id", text.alias("text"))


@query(f"""WITH {LINES}, q AS (SELECT doc_id, pos, (pos % 4)::INT AS level FROM lines), l AS (SELECT doc_id, pos, unnest(range(1, level + 1))::INT AS depth FROM q WHERE level > 0),
n AS (SELECT *, CASE WHEN pos - lag(pos) OVER w = 1 THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id, depth ORDER BY pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, depth ORDER BY pos)::BIGINT AS grp FROM n)
SELECT doc_id, depth, grp, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos FROM g GROUP BY 1, 2, 3""")
def w2_quote_groups(spark, d):
    """Runs of quoted blocks at each depth, with quote levels by line number."""
    return X.quote_groups(paragraphs(spark, d).withColumn("level", (F.col("pos") % 4).cast("int")))


@query()
def w7_paginate(spark, d):
    """Exact pages of every paragraph; the fold over slots' fills is tested against a plain loop instead of SQL."""
    from ..operators import layout as L

    b = L.block_heights(paragraphs(spark, d)).withColumn("forced", F.col("pos") % 10 == 4)
    return L.paginate(b, 20000, 2)


@query(f"""WITH {ITEMS}, rows_ AS (SELECT doc_id AS pkg, r, k::VARCHAR AS a, name AS b FROM n UNION ALL SELECT DISTINCT doc_id, 0, 'key', 'name' FROM n)
SELECT pkg, 0 AS table_no, r AS row_no, 0 AS cell_no, r = 0 AS is_header, 1 AS col_span, 25.4::DOUBLE AS width_mm, a AS text FROM rows_
UNION ALL SELECT pkg, 0, r, 1, r = 0, 2, 50.8, b FROM rows_""")
def p21_office_tables(spark, d):
    from ..operators import office as O

    def cell(text, width, span=""):
        return F.concat(F.lit(f'<w:tc><w:tcPr><w:tcW w:w="{width}"/>{span}</w:tcPr><w:p><w:r><w:t>'), text, F.lit("</w:t></w:r></w:p></w:tc>"))

    wide = '<w:gridSpan w:val="2"/>'
    row = F.concat(F.lit("<w:tr>"), cell(F.col("k").cast("string"), 1440), cell(F.col("name"), 2880, wide), F.lit("</w:tr>"))
    head = F.concat(F.lit("<w:tr><w:trPr><w:tblHeader/></w:trPr>"), cell(F.lit("key"), 1440), cell(F.lit("name"), 2880, wide), F.lit("</w:tr>"))
    body = joined(items(spark, d, "pkg"), "pkg", "k", row, "")
    return O.office_tables(body.select("pkg", F.concat(F.lit("<w:body><w:tbl>"), head, "text", F.lit("</w:tbl></w:body>")).alias("content")))


@query("""SELECT doc_id AS pkg, 0 AS pos, 'word/media/' || doc_id || '.png' AS path, CASE WHEN doc_id % 4 > 0 THEN octet_length(encode(coalesce(text, '')))::INT END AS size,
  CASE WHEN doc_id % 4 > 0 THEN sha256(coalesce(text, '')) END AS sha256 FROM documents""")
def p22_office_images(spark, d):
    """A picture in each document, every fourth without its part."""
    from ..operators import office as O

    k = F.col("doc_id").cast("string")
    pairs = [
        (F.lit("word/document.xml"), F.concat(F.lit('<w:drawing><a:blip x="1" r:embed="r'), k, F.lit('"/></w:drawing>'))),
        (F.lit("word/_rels/document.xml.rels"), F.concat(F.lit('<Relationships><Relationship Id="r'), k, F.lit('" Target="media/'), k, F.lit('.png"/></Relationships>'))),
        (F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("word/media/"), k, F.lit(".png"))), F.coalesce("text", F.lit(""))),
    ]
    parts = docs(spark, d).select(F.col("doc_id").alias("pkg"), F.explode(F.array(*[F.struct(p.alias("path"), c.alias("content")) for p, c in pairs])).alias("p")).select("pkg", "p.*").filter("path IS NOT NULL")
    return O.office_images(parts)


@query("""SELECT doc_id AS pkg, 'x:chart' AS kind, doc_id % 3 + 1 AS n, '[x:chart]' AS label FROM documents UNION ALL SELECT doc_id, 'w:sdt', 1, '[w:sdt]' FROM documents WHERE doc_id % 2 = 0""")
def p23_opaque_islands(spark, d):
    from ..operators import office as O

    charts = F.repeat(F.lit('<x:chart a="1">c</x:chart>'), (F.col("doc_id") % 3 + 1).cast("int"))
    c = F.concat(F.lit("<w:body><w:p><w:r><w:t>t</w:t></w:r></w:p>"), charts, F.when(F.col("doc_id") % 2 == 0, "<w:sdt/>").otherwise(""), F.lit("</w:body>"))
    return O.opaque_islands(docs(spark, d).select(F.col("doc_id").alias("pkg"), c.alias("content")))


LADDER = ", ".join(f"({k}, {w}::DOUBLE)" for k, w in enumerate(WIDTHS))


@query(f"""WITH ladder(k, w) AS (VALUES {LADDER}), v AS (SELECT l_orderkey * 10 + l_linenumber AS o, l_quantity::DOUBLE / 4 - 1 AS l, l_linenumber::DOUBLE AS r, l_discount AS fill FROM lineitem),
w AS (SELECT pt, CASE WHEN pt <= 0 THEN 0.12 ELSE (SELECT arg_min(w, abs(w - pt * 0.3527777778::DOUBLE) * 1e6 + k * 1e-9) FROM ladder) END AS mm FROM (SELECT l AS pt FROM v UNION SELECT r FROM v UNION SELECT 1.0 UNION SELECT 0.0)),
f AS (SELECT a.mm AS left_mm, b.mm AS right_mm, fill, min(o) AS first, count(*) AS uses FROM v JOIN w a ON a.pt = l JOIN w b ON b.pt = r GROUP BY 1, 2, 3)
SELECT left_mm, right_mm, (SELECT mm FROM w WHERE pt = 1) AS top_mm, 0.12::DOUBLE AS bottom_mm, fill, uses, (row_number() OVER (ORDER BY first, left_mm, right_mm, fill) + 3)::BIGINT AS fill_id FROM f""")
def a8_intern_border_fills(spark, d):
    from ..operators import office as O

    c = read_table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), (F.col("l_quantity").cast("double") / 4 - 1).alias("left_pt"), F.col("l_linenumber").cast("double").alias("right_pt"),
        F.lit(1.0).alias("top_pt"), F.lit(0.0).alias("bottom_pt"), F.col("l_discount").alias("fill"),
    )
    return O.intern_border_fills(c, "at")


@query("""SELECT doc_id || '.zip' AS pkg, 'mimetype' AS path, 5::BIGINT AS size, sha256('a/zip') AS sha256 FROM documents UNION ALL SELECT doc_id || '.zip', 'content/text.txt', octet_length(encode(coalesce(text, '')))::BIGINT, sha256(coalesce(text, '')) FROM documents""")
def s5_package_parts(spark, d):
    """Documents packed as ZIP files, and their parts."""
    from ..operators import office as O

    packed = O.zip_parts(docs(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), F.array(
        F.struct(F.lit("mimetype").alias("path"), F.lit("a/zip").cast("binary").alias("content")), F.struct(F.lit("content/text.txt").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    ).alias("parts")))
    return O.package_parts(packed).select("pkg", "path", "size", F.sha2("content", 256).alias("sha256"))


@query("SELECT doc_id, 'txt' AS format, sha256(coalesce(text, '')) AS sha256 FROM documents")
def s14_write_rendered(spark, d):
    """Documents written by the sink, one row each, and read back."""
    from ..sources.tables import write_rendered

    at = S.shared_path(spark, "rendered")
    write_rendered(docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), at, "txt")
    return spark.read.parquet(at).select("doc_id", "format", F.sha2("text", 256).alias("sha256"))


@query("""WITH e AS (SELECT user_id AS key, event_id, ts, event_id % 5 <> 0 AS edit, count(*) FILTER (event_id % 5 = 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WHERE edit WINDOW w AS (PARTITION BY key, run ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY key, run ORDER BY ts, event_id) AS burst FROM s)
SELECT key, min(ts) AS started, count(*) AS n FROM b GROUP BY key, run, burst""")
def st4_stream_bursts(spark, d):
    """Bursts of edits as a stream over stored events, which hold the number of other actions before each; nothing is late."""
    from ..sources.tables import shared_path

    e = read_table(spark, d, "events").withColumns({"key": F.col("user_id"), "edit": F.col("event_id") % 5 != 0})
    run = F.sum((~F.col("edit")).cast("int")).over(W.partitionBy("key").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    at = shared_path(spark, "edits")
    e.select("key", F.col("ts").cast("timestamp").alias("ts"), "edit", run.alias("run")).write.parquet(at)
    everything = S.run_closed(S.stream_bursts(S.read_stream(spark, at), 1800, "3650 days"), "bursts")
    return everything.withColumn("started", F.col("started").cast("timestamp_ntz"))
