"""Markdown, tables, images, styles, JSON documents and office parts, as line and token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import decode_entities, escape_html, media_type
from .html import html_tokens


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


QUOTES, FENCE = r"^(?:\s{0,3}>\s?)+", r"^\s*(`{3,}|~{3,})"


def _fenced_lines(docs: DataFrame, containers: bool) -> DataFrame:
    """Lines with role, open or close for fences and drop where a quote ends that has an open fence, and quote, the depth of quotes.

    A fence is closed by one of its own mark, at least as long and with nothing behind it; a fold over the lines that may be
    fences pairs them, inside the row of their document. With containers, quotes are taken off the lines.
    """
    marks = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, "(" + QUOTES + ")", 1), "[^>]", "")) if containers else F.lit(0)
    plain = lambda x: F.regexp_replace(x, QUOTES, "") if containers else x
    fence = FENCE if containers else FENCE.replace(r"\s*", r"\s{0,3}", 1)
    t = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    t = t.withColumn("rows", F.transform("lines", lambda x, i: F.struct(i.alias("i"), plain(x).alias("x"), marks(x).alias("q"))))
    leaves = lambda r: (r["q"] < F.coalesce(F.get("rows", r["i"] - 1)["q"], F.lit(0))) if containers else F.lit(False)
    t = t.withColumn("rows", F.filter("rows", lambda r: r["x"].rlike(fence) | leaves(r)))
    start = F.expr("named_struct('mark', '', 'q', 0, 'out', cast(array() as array<struct<i:int,role:string>>))")

    def step(s, r):
        run, opened = F.regexp_extract(r["x"], fence, 1), (s["mark"] != "") & (r["q"] >= s["q"])
        closes = opened & (r["q"] == s["q"]) & (run != "") & run.startswith(s["mark"]) & ~r["x"].rlike(r"^\s*(?:`{3,}+|~{3,}+)\s*\S")
        opens = ~opened & (run != "") & ~r["x"].rlike(r"^\s*`{3,}+[^`]*`")
        role = F.when(closes, "close").when(opens, "open").when((s["mark"] != "") & ~opened, "drop")
        mark = F.when(closes, "").when(opens, run).when(opened, s["mark"]).otherwise("")
        out = F.when(role.isNotNull(), F.concat(s["out"], F.array(F.struct(r["i"].alias("i"), role.alias("role"))))).otherwise(s["out"])
        return F.struct(mark.alias("mark"), F.when(opens, r["q"]).otherwise(s["q"]).alias("q"), out.alias("out"))

    t = t.withColumn("roles", F.map_from_entries(F.aggregate("rows", start, step, lambda s: s["out"])))
    t = t.select("doc_id", "roles", F.posexplode("lines").alias("line_no", "raw_line")).withColumns({"role": F.try_element_at("roles", F.col("line_no")), "quote": marks(F.col("raw_line"))}).drop("roles")
    so_far = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumns({"state": F.last("role", ignorenulls=True).over(so_far), "held": F.last(F.when(F.col("role") == "open", F.col("quote")), ignorenulls=True).over(so_far)})
    t = t.withColumns({"fence": F.coalesce(F.col("role").isin("open", "close"), F.lit(False)), "inside": F.coalesce((F.col("state") == "open") & F.col("role").isNull(), F.lit(False))})
    if not containers:
        return t.withColumnRenamed("raw_line", "line")
    t = t.withColumn("quote", F.when(F.col("inside"), F.col("held")).otherwise(F.col("quote")))
    some = F.regexp_replace("raw_line", F.concat(F.lit(r"^(?:\s{0,3}>\s?){0,"), F.col("quote").cast("string"), F.lit("}")), F.lit(""))
    return t.withColumn("line", F.when(F.col("quote") == 0, F.col("raw_line")).otherwise(some)).drop("raw_line")


def md_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, kind, level, checked, number, language, text): headings, items, quotes, code, tables, math, HTML,
    rules and paragraphs.

    Headings by marks before or a line of = or - below; bullet and numbered items with task marks; quotes by depth; fences
    by mark and length, with the language that they name; tables by their bars; display math between lines of $$; HTML
    lines; other lines that touch are one paragraph. Lazy continuation and reference links are not told apart, nor is what
    quotes hold: see md_containers.
    """
    return _blocks(_fenced_lines(docs, False)).drop("quote_level")


def md_containers(docs: DataFrame) -> DataFrame:
    """md_blocks with quote_level: headings, items, fences, tables and all other blocks inside quotes too, at any indentation of
    fences, so that those in items are code. A quote that ends closes its fence; null and empty texts have no blocks."""
    return _blocks(_fenced_lines(docs, True))


def _blocks(t: DataFrame) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy("line_no")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    line, inside = F.col("line"), F.col("inside")
    t = t.withColumn("dollars", ~inside & ~F.col("fence") & (F.trim("line") == "$$")).withColumn("maths", F.sum(F.col("dollars").cast("int")).over(so_far))
    info = F.when(F.col("role") == "open", F.regexp_extract("line", r"^\s*(?:```+|~~~+)\s*([^\s`]*)", 1))
    t = t.withColumn("info", F.last(info, ignorenulls=True).over(so_far))
    kind = (
        F.when(F.col("fence"), "fence").when(inside, "code").when(F.col("dollars"), "fence").when(F.col("maths") % 2 == 1, "math").when(F.trim("line") == "", "blank").when(line.rlike(r"^#{1,6}\s+"), "heading")
        .when(line.rlike(r"^\s{0,3}([-*_])\s*(\1\s*){2,}$"), "rule").when(line.rlike(r"^\s*[-*+]\s+"), "bullet").when(line.rlike(r"^\s*\d+[.)]\s+"), "ordered")
        .when(line.rlike(r"^\s{0,3}>"), "quote").when(line.rlike(r"^\s*\|.*\|\s*$"), "table").when(line.rlike(r"^\s{0,3}</?[A-Za-z][^>]*>|^\s{0,3}<!--"), "html").otherwise("paragraph")
    )
    t = t.withColumn("kind", kind)
    below = line.rlike(r"^\s{0,3}(=+|-{2,})\s*$") & (F.lag("kind").over(w) == "paragraph") & (F.lag("quote").over(w) == F.col("quote"))
    t = t.withColumn("below", F.coalesce(below, F.lit(False)))
    under = F.when(F.lead("below").over(w), F.when(F.lead("line").over(w).contains("="), 1).otherwise(2))
    t = t.withColumn("under", under).filter("NOT below").withColumn("kind", F.when(F.col("under").isNotNull(), "heading").otherwise(F.col("kind")))
    t = t.withColumns({"prev": F.lag("kind").over(w), "prev_quote": F.lag("quote").over(w)})
    joins = F.col("kind").isin("paragraph", "code", "table", "math", "html") & (F.col("kind") == F.col("prev")) & (F.col("quote") == F.col("prev_quote"))
    t = t.filter("kind NOT IN ('blank')").withColumn("new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    t = t.withColumn("bid", F.sum("new").over(so_far))
    rows = t.filter("kind <> 'fence'").groupBy("doc_id", "bid").agg(F.max("kind").alias("kind"), F.max("quote").alias("quote_level"), F.max("under").alias("under"), F.max("info").alias("info"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("r"))
    raw = F.array_join(F.transform("r", lambda x: x["line"]), "\n")
    rows = rows.withColumn("raw", raw)
    text = (
        F.when((F.col("kind") == "heading") & F.col("under").isNotNull(), F.trim("raw"))
        .when(F.col("kind") == "heading", F.regexp_replace("raw", r"^#{1,6}\s+|\s+#+\s*$", "")).when(F.col("kind").isin("bullet", "ordered"), F.regexp_replace("raw", r"^\s*(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?", ""))
        .when(F.col("kind") == "quote", F.regexp_replace("raw", r"^(?:\s{0,3}>\s?)+", "")).when(F.col("kind") == "rule", "").otherwise(F.col("raw"))
    )
    level = (
        F.when(F.col("kind") == "heading", F.coalesce("under", F.length(F.regexp_extract("raw", r"^(#+)", 1)))).when(F.col("kind").isin("bullet", "ordered"), F.floor(F.length(F.regexp_extract("raw", r"^(\s*)", 1)) / 2) + 1)
        .when(F.col("kind") == "quote", F.length(F.regexp_replace(F.regexp_extract("raw", r"^((?:\s{0,3}>\s?)+)", 1), r"[^>]", ""))).otherwise(0)
    )
    mark = F.regexp_extract("raw", r"^\s*(?:[-*+]|\d+[.)])\s+\[([ xX])\]", 1)
    checked = F.when(F.col("kind").isin("bullet", "ordered") & (mark != ""), F.lower(mark) == "x")
    number = F.when(F.col("kind") == "ordered", F.regexp_extract("raw", r"^\s*(\d+)", 1).try_cast("int"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("bid"))
    return rows.select("doc_id", n.alias("block_no"), "quote_level", "kind", level.cast("int").alias("level"), checked.alias("checked"), number.alias("number"), F.when(F.col("kind") == "code", F.col("info")).alias("language"), text.alias("text"))


def md_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run_no, kind, text, url): strong, em, strike, sub, sup, code, image, link, autolink, math, break and plain runs
    of a text. Emphasis inside emphasis is not told apart."""
    under = r"(?<!\w)_[^_\s](?:[^_]*[^_\s])?_(?!\w)"
    rx = (
        r" {2,}\n|\\\n|\*\*[^*]+\*\*|__[^_]+__|" + under + r"|~~[^~]+~~|~[^~\n]+~|\^[^\^\n]+\^|\*[^*\s][^*]*\*|``.+?``|`[^`]+`|!?\[[^\]]*\]\([^)]*\)|<(?:https?://|mailto:)[^>]+>|\$[^$\n]+\$|"
        r"(?:(?! {2,}\n|\\\n|__|" + under + r")[^*`\[<!$~^])+|."
    )
    t = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?s)" + rx), F.lit(0))).alias("run_no", "tok"))
    tok = F.col("tok")
    whole = lambda rx: tok.rlike(r"(?s)^" + rx + "$")
    kind = (
        F.when(whole(r"( {2,}|\\)\n"), "break").when(whole(r"\*\*.+\*\*") | whole("__.+__"), "strong").when(whole("~~.+~~"), "strike").when(whole("~.+~"), "sub").when(whole(r"\^.+\^"), "sup")
        .when(whole(r"\*.+\*") | whole("_.+_"), "em").when(whole("`.+`"), "code").when(whole(r"!\[.*\]\(.*\)"), "image").when(whole(r"\[.*\]\(.*\)"), "link").when(whole("<(https?://|mailto:).+>"), "autolink").when(whole(r"\$.+\$"), "math").otherwise("plain")
    )
    inner = lambda n: F.substr(tok, F.lit(n + 1), F.length(tok) - 2 * n)
    text = (
        F.when(kind == "break", "\n").when(kind.isin("strong", "strike") | whole("``.+``"), inner(2)).when(kind.isin("em", "code", "autolink", "math", "sub", "sup"), inner(1))
        .when(kind.isin("image", "link"), F.regexp_extract("tok", r"(?s)^!?\[(.*?)\]", 1)).otherwise(tok)
    )
    url = F.when(kind.isin("image", "link"), F.regexp_extract("tok", r"(?s)\]\((.*)\)$", 1)).when(kind == "autolink", text)
    return t.select("doc_id", "run_no", kind.alias("kind"), text.alias("text"), url.alias("url"))


def md_images(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, kind, text, url, media): paragraphs; one that is only an image is an image, and images within
    text become [alt](url)."""
    rx = r"(?s)^\s*!\[([^\]]*)\]\(([^)\s]*)(?:\s+\"[^\"]*\")?\)\s*$"
    p = md_blocks(docs).filter("kind = 'paragraph'")
    image = F.col("text").rlike(rx)
    url = F.when(image, F.regexp_extract("text", rx, 2))
    text = F.when(image, F.regexp_extract("text", rx, 1)).otherwise(F.regexp_replace("text", r"!(\[[^\]]*\]\([^)]*\))", "$1"))
    media = F.when(image, media_type(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.(\w+)$", 1)))
    return p.select("doc_id", "block_no", F.when(image, "image").otherwise("paragraph").alias("kind"), text.alias("text"), url.alias("url"), media.alias("media"))


def md_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, cell_no, is_header, align, text): pipe tables, told by their row of dashes.

    Rows with fewer cells than the rule are padded; cells beyond it have no alignment.
    """
    w = W.partitionBy("doc_id").orderBy("line_no")
    t = _lines(docs).withColumn("pipe", F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    t = t.withColumn("new", (F.col("pipe") & ~F.coalesce(F.lag("pipe").over(w), F.lit(False))).cast("int"))
    t = t.withColumn("table_no", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).filter("pipe")
    t = t.withColumn("rule", F.col("line").rlike(r"^\s*\|(\s*:?-+:?\s*\|)+\s*$"))
    own = W.partitionBy("doc_id", "table_no").orderBy("line_no")
    t = t.withColumn("r", F.row_number().over(own) - 1)
    t = t.withColumn("cells", F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"))
    width = F.max(F.when(F.col("rule"), F.size("cells"))).over(W.partitionBy("doc_id", "table_no"))
    short = F.greatest(F.coalesce(width, F.lit(0)) - F.size("cells"), F.lit(0))
    t = t.withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), short)))
    t = t.select("doc_id", "table_no", "r", "rule", F.posexplode("cells").alias("cell_no", "text"))
    aligned = t.filter("rule").select("doc_id", "table_no", "cell_no", F.when(F.trim("text").rlike("^:-+:$"), "center").when(F.trim("text").rlike("-:$"), "right").when(F.trim("text").rlike("^:"), "left").otherwise("none").alias("align"))
    ruled = t.filter("rule").select("doc_id", "table_no").distinct()  # lines of bars without a rule are no table
    body = t.filter("NOT rule").join(ruled, ["doc_id", "table_no"], "left_semi").join(aligned, ["doc_id", "table_no", "cell_no"], "left")
    text = F.trim(F.replace("text", F.lit("\\|"), F.lit("|")))
    return body.select("doc_id", "table_no", F.when(F.col("r") == 0, 0).otherwise(F.col("r") - 1).alias("row_no"), "cell_no", (F.col("r") == 0).alias("is_header"), F.coalesce("align", F.lit("none")).alias("align"), text.alias("text"))


def html_cells(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, cell_no, is_header, row_span, col_span, text): cells of flat HTML tables."""
    w = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = html_tokens(pages)
    opens = lambda *n: (F.col("name").isin(*n) & (F.col("kind") == "tag")).cast("int")
    shuts = lambda *n: (F.col("name").isin(*n) & (F.col("kind") == "close")).cast("int")
    t = t.withColumns({"table_no": F.sum(opens("table")).over(w), "tr": F.sum(opens("tr")).over(w), "td": F.sum(opens("td", "th")).over(w), "inside": F.sum(opens("td", "th") - shuts("td", "th")).over(w)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "tok")))), lambda x: x["tok"]), "")
    span = lambda a: F.max(F.when(opens("td", "th") == 1, F.coalesce(F.regexp_extract("tok", a + r'\s*=\s*"?(\d+)', 1).try_cast("int"), F.lit(1))))
    cells = t.filter("inside > 0").groupBy("page_id", "table_no", "tr", "td").agg(text.alias("raw"), F.max(F.when(opens("th") == 1, True)).alias("th"), span("rowspan").alias("row_span"), span("colspan").alias("col_span"))
    row = W.partitionBy("page_id", "table_no")
    return cells.select(
        "page_id", "table_no", (F.dense_rank().over(row.orderBy("tr")) - 1).alias("row_no"), (F.row_number().over(W.partitionBy("page_id", "table_no", "tr").orderBy("td")) - 1).alias("cell_no"),
        F.min(F.coalesce("th", F.lit(False))).over(W.partitionBy("page_id", "table_no", "tr")).alias("is_header"), "row_span", "col_span", F.trim(decode_entities(F.col("raw"))).alias("text"),
    )


def table_shape(cells: DataFrame, key: str) -> DataFrame:
    """Rows, most columns with spans, header rows and grid size of each table."""
    rows = cells.groupBy(key, "table_no", "row_no").agg(F.sum("col_span").alias("width"), F.min(F.col("is_header").cast("int")).alias("head"))
    return rows.groupBy(key, "table_no").agg(F.count("*").alias("n_rows"), F.max("width").alias("n_cols"), F.sum("head").alias("n_heads"), (F.count("*") * F.max("width")).alias("grid"))


def html_images(pages: DataFrame) -> DataFrame:
    """(page_id, pos, src, alt, media, width_mm, inline_bytes): images; sizes from px, data URIs decoded."""
    t = html_tokens(pages).filter("name = 'img' AND kind = 'tag'")
    get = lambda a: F.regexp_extract("tok", r'(?i)\b' + a + r'\s*=\s*"([^"]*)"', 1)
    src = get("src")
    kind = F.when(src.startswith("data:"), F.regexp_extract(src, "^data:([^;,]*)", 1)).otherwise(media_type(F.regexp_extract(F.regexp_replace(src, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1)))
    data = F.when(src.rlike("^data:[^,]*;base64,"), F.unbase64(F.regexp_extract(src, ",(.*)$", 1)))
    return t.select("page_id", "pos", src.alias("src"), decode_entities(get("alt")).alias("alt"), kind.alias("media"), F.round(get("width").try_cast("double") * 25.4 / 96.0, 3).alias("width_mm"), F.length(data).alias("inline_bytes"))


def html_notes(pages: DataFrame) -> DataFrame:
    """(page_id, note_kind, note_id, ordinal, text): notes in items whose id is fn-N or en-N, without back-links."""
    whole = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?s)<li[^>]*\bid="(?:fn|en)-[^"]+"[^>]*>.*?</li>'), F.lit(0))
    t = pages.select("page_id", F.posexplode(whole).alias("p", "raw"))
    ident = F.regexp_extract("raw", r'\bid="((?:fn|en)-[^"]+)"', 1)
    plain = F.regexp_replace(F.regexp_replace("raw", r'(?s)<a[^>]*href="#(?:fn|en)ref[^"]*"[^>]*>.*?</a>', ""), "<[^>]*>", "")
    kind = F.when(ident.startswith("fn-"), "footnote").otherwise("endnote")
    out = t.select("page_id", kind.alias("note_kind"), ident.alias("note_id"), "p", F.trim(decode_entities(plain)).alias("text"))
    return out.withColumn("ordinal", F.row_number().over(W.partitionBy("page_id", "note_kind").orderBy("p"))).drop("p")


def css_declarations(styles: DataFrame) -> DataFrame:
    """(id, property, value, mm): declarations of (id, style); the last of a property wins; lengths in millimetres."""
    t = styles.select("id", F.posexplode(F.split("style", ";")).alias("k", "d")).filter(F.col("d").contains(":"))
    t = t.select("id", "k", F.lower(F.trim(F.regexp_extract("d", r"^([^:]*):", 1))).alias("property"), F.trim(F.regexp_extract("d", r":(.*)$", 1)).alias("value"))
    t = t.withColumn("last", F.max("k").over(W.partitionBy("id", "property"))).filter("k = last")
    number, unit = F.regexp_extract("value", r"^(-?[0-9.]+)", 1).try_cast("double"), F.regexp_extract("value", r"(mm|cm|px|pt|in)$", 1)
    factor = F.when(unit == "mm", 1.0).when(unit == "cm", 10.0).when(unit == "px", 25.4 / 96).when(unit == "pt", 25.4 / 72).when(unit == "in", 25.4)
    return t.select("id", "property", "value", F.round(number * factor, 4).alias("mm"))


BLOCK_JSON = "struct<`$type`:string,kind:string,text:string,outline:int>"


def json_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, text, outline, error): blocks of JSON documents; the kind is $type, else kind, else paragraph."""
    known = ("paragraph", "table", "image", "shape", "textbox", "opaque", "toc")
    t = docs.select("doc_id", F.posexplode(F.from_json("json", f"struct<blocks:array<{BLOCK_JSON}>>")["blocks"]).alias("pos", "b"))
    kind = F.lower(F.coalesce(F.col("b")["$type"], F.col("b.kind"), F.lit("paragraph")))
    return t.select("doc_id", "pos", kind.alias("kind"), "b.text", F.coalesce("b.outline", F.lit(0)).alias("outline"), (~kind.isin(*known)).alias("error"))


def blocks_to_json(blocks: DataFrame) -> DataFrame:
    """(doc_id, json): the inverse, $type first and defaults left out."""
    one = F.struct(F.col("kind").alias("$type"), "text", F.when(F.col("outline") != 0, F.col("outline")).alias("outline"))
    rows = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("b")))).alias("r"))
    return rows.select("doc_id", F.to_json(F.struct(F.transform("r", lambda x: x["b"]).alias("blocks"))).alias("json"))


def office_paragraphs(parts: DataFrame) -> DataFrame:
    """(pkg, pos, outline, page_break, text): paragraphs of word-processing XML parts (pkg, content)."""
    p = parts.select("pkg", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)<w:p[ >].*?</w:p>"), F.lit(0))).alias("pos", "x"))
    text = F.array_join(F.regexp_extract_all("x", F.lit(r"(?s)<w:t[^>]*>(.*?)</w:t>"), F.lit(1)), "")
    style = F.regexp_extract("x", r'<w:pStyle w:val="Heading([1-6])"', 1).try_cast("int")
    level = F.regexp_extract("x", r'<w:outlineLvl w:val="(\d)"', 1).try_cast("int") + 1
    return p.select("pkg", "pos", F.coalesce(style, level, F.lit(0)).alias("outline"), F.col("x").contains('<w:br w:type="page"/>').alias("page_break"), decode_entities(text).alias("text"))


def to_html(blocks: DataFrame, xhtml: bool = False) -> DataFrame:
    """(page_id, text): blocks as HTML or XHTML, neighbouring items in one list."""
    w = W.partitionBy("page_id").orderBy("block_no")
    item = F.col("kind") == "item"
    before, after = F.coalesce(F.lag("kind").over(w) == "item", F.lit(False)), F.coalesce(F.lead("kind").over(w) == "item", F.lit(False))
    tag = F.when(F.col("outline") > 0, F.concat(F.lit("h"), F.col("outline").cast("string"))).when(item, "li").otherwise("p")
    t = escape_html(F.col("text"))
    if xhtml:
        t = F.replace(F.replace(t, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))
    line = F.concat(F.when(item & ~before, "<ul>\n").otherwise(""), F.lit("<"), tag, F.lit(">"), t, F.lit("</"), tag, F.lit(">"), F.when(item & ~after, "\n</ul>").otherwise(""))
    rows = blocks.withColumn("line", line).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "line"))).alias("r"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><body>\n' if xhtml else "<!DOCTYPE html>\n<html><body>\n"
    return rows.select("page_id", F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n</body></html>\n")).alias("text"))
