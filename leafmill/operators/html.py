"""HTML pages as tables: tokens, blocks, runs and links, all by regular expressions and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import decode_characters, decode_entities

TOKEN = r"(?s)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|[^<]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Elements that start a block of their own.
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "nav", "article", "section", "header", "footer", "main", "aside", "blockquote", "pre", "table", "tr", "td", "th", "form", "figure", "body", "html", "hr")
#: Blocks whose content is inline.
INLINE_BLOCKS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "pre")


def html_tokens(pages: DataFrame, only: str = "") -> DataFrame:
    """(page_id, pos, tok, kind, name): comments, declarations, raw elements, tags, closing tags and text, in order; with only,
    those that match this regular expression."""
    t = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    if only:
        t = t.filter(F.col("tok").rlike(only))
    return _told(t).select("page_id", "pos", "tok", "kind", "name")


def tag_texts(pages: DataFrame, apart: str, names: tuple[str, ...]) -> DataFrame:
    """html_tokens with the text behind each tag in the tag's own row, as text, empty without; a row of its own has only text
    before the first tag and behind the end tag of the element `apart`. Tags of other names without text are left out."""
    markup = TOKEN.removeprefix("(?s)").removesuffix("|[^<]+")
    pairs = rf"(?s)(?i:</{apart}(?![A-Za-z0-9])[^>]*>)|(?:{markup})[^<]*|[^<]+"
    t = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(pairs), F.lit(0))).alias("pos", "both"))
    t = t.filter(~F.col("both").rlike(rf"(?i)^<(?!/?(?:{'|'.join(names)})(?![a-z0-9]))[^>]*>\z"))
    t = t.withColumn("tok", F.regexp_extract("both", f"(?s)^(?:{markup})", 0))
    return _told(t).select("page_id", "pos", "tok", "kind", "name", F.substr("both", F.length("tok") + 1).alias("text"))


def _told(t: DataFrame) -> DataFrame:
    """t with the name and the kind of each token tok."""
    # a step of its own, or each use of the name would cut it out again; names are ASCII, and lower() is slow
    name = F.when(F.col("tok").startswith("<"), F.translate(F.regexp_extract("tok", r"^</?([A-Za-z][A-Za-z0-9]*)", 1), UPPER, UPPER.lower())).otherwise("")
    t = t.withColumn("name", name)
    kind = (
        F.when(~F.col("tok").startswith("<"), "text").when(F.col("tok").startswith("<!--"), "comment").when(F.col("tok").startswith("<!"), "declaration").when(F.col("tok").startswith("</"), "close")
        .when(F.col("name").isin("script", "style"), "raw").otherwise("tag")
    )
    return t.withColumn("kind", kind)


def _body(tokens: DataFrame) -> DataFrame:
    """Tokens of the body, with block numbers and open counts of the elements that matter."""
    page = W.partitionBy("page_id")
    start = F.max(F.when((F.col("name") == "body") & (F.col("kind") == "tag"), F.col("pos"))).over(page)
    t = tokens.withColumn("_start", F.coalesce(start, F.lit(0))).filter((F.col("pos") >= F.col("_start")) & F.col("kind").isin("tag", "close", "text")).drop("_start")
    run = page.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)

    def is_open(*names: str):
        return F.sum(F.when(F.col("name").isin(*names) & (F.col("kind") == "tag"), 1).when(F.col("name").isin(*names) & (F.col("kind") == "close"), -1).otherwise(0)).over(run)

    edge = F.col("name").isin(*BLOCK_TAGS) & F.col("kind").isin("tag", "close")
    t = t.withColumns({"bid": F.sum(edge.cast("int")).over(run), "bold": is_open("b", "strong"), "italic": is_open("i", "em"), "quote": is_open("blockquote"), "depth": is_open("ul", "ol"), "linked": is_open("a")})
    opens = F.when(edge & (F.col("kind") == "tag"), F.col("name"))
    return t.withColumn("context", F.max(opens).over(W.partitionBy("page_id", "bid")))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, kind, outline, list_level, quote_level, text): the body's blocks in order.

    All text of a paragraph, heading or list item is one block; elsewhere each piece of text that isn't blank is.
    """
    t = _body(html_tokens(pages)).filter("kind = 'text'")
    inline = F.col("context").isin(*INLINE_BLOCKS)
    key = F.when(inline, F.col("bid")).otherwise(F.lit(-1) - F.col("pos"))
    t = t.withColumns({"inline": F.coalesce(inline, F.lit(False)), "key": F.coalesce(key, F.lit(-1) - F.col("pos"))})
    rows = t.groupBy("page_id", "key").agg(
        F.min("pos").alias("pos"), F.max(F.when(F.col("inline"), F.col("context")).otherwise("text")).alias("tag"), F.max("depth").alias("list_level"), F.max("quote").alias("quote_level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), "").alias("raw"),
    )
    rows = rows.withColumn("text", F.trim(decode_entities(F.col("raw")))).filter("text <> ''")
    outline = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int")).otherwise(0)
    kind = F.when(outline > 0, "heading").when(F.col("tag") == "li", "item").when(F.col("tag") == "text", "text").otherwise("paragraph")
    number = F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    return rows.select("page_id", number.alias("block_no"), kind.alias("kind"), outline.alias("outline"), F.col("list_level").cast("int").alias("list_level"), F.col("quote_level").cast("int").alias("quote_level"), "text")


#: Elements that set a style of the runs inside them.
STYLES = {
    "bold": ("b", "strong"), "italic": ("i", "em", "cite", "var", "dfn", "abbr"), "underline": ("u", "ins", "a"), "strike": ("s", "strike", "del"), "sub": ("sub",), "sup": ("sup",),
    "mono": ("code", "kbd", "samp", "tt"), "mark": ("mark",),
}


def attribute(name: str, tok: str | F.Column = "tok") -> F.Column:
    """An attribute of a tag token, quoted or not; null where it is absent."""
    raw = F.get(F.regexp_extract_all(tok, F.lit(rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), F.lit(1)), F.lit(0))
    # each step is named once: what is named twice is computed twice, and methods over 8,000 bytes are never compiled
    return decode_entities(F.regexp_replace(raw, r"(?s)^[\"'](.*)[\"']\z", "$1"))


def html_runs(pages: DataFrame) -> DataFrame:
    """(page_id, pos, text, a column for each style, url): the body's runs that aren't blank, with their styles.

    A line break is a run of one line feed, an image one of [alt](src).
    """
    t = _body(html_tokens(pages))
    order = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    step = lambda names: F.when(F.col("name").isin(*names), F.when(F.col("kind") == "tag", 1).when(F.col("kind") == "close", -1).otherwise(0)).otherwise(0)
    href = F.when((F.col("name") == "a") & (F.col("kind") == "tag"), F.coalesce(attribute("href"), F.lit("")))
    t = t.withColumn("href", F.last(href, ignorenulls=True).over(order)).withColumns({k: F.sum(step(names)).over(order) > 0 for k, names in STYLES.items()})
    tag = F.col("kind") == "tag"
    text = (
        F.when(F.col("kind") == "text", decode_entities(F.col("tok"))).when(tag & (F.col("name") == "br"), "\n")
        .when(tag & (F.col("name") == "img"), F.concat(F.lit("["), F.coalesce(attribute("alt"), F.lit("")), F.lit("]("), F.coalesce(attribute("src"), F.lit("")), F.lit(")")))
    )
    runs = t.select("page_id", "pos", text.alias("text"), *STYLES, F.when(F.col("linked") > 0, F.col("href")).alias("url"))
    return runs.filter((F.trim("text") != "") & F.col("text").isNotNull())


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each link's text."""
    return html_runs(pages).filter("url IS NOT NULL AND text <> '\n'").select("page_id", "pos", "url", F.trim("text").alias("text"))


def link_counts(links: DataFrame) -> DataFrame:
    """links with how many there are on their page and to their target, by partial counts and joins."""
    page = links.groupBy("page_id").agg(F.count("*").alias("on_page"))
    target = links.groupBy("url").agg(F.count("*").alias("to_target"))
    return links.join(page, "page_id").join(target, "url").select(*links.columns, "on_page", "to_target")


def outline(blocks: DataFrame, least: int = 1, most: int = 6) -> DataFrame:
    return blocks.filter(F.col("outline").between(least, most)).select("page_id", "block_no", "outline", "text")


def list_groups(blocks: DataFrame) -> DataFrame:
    """(page_id, list_no, level, first_block, items): runs of neighbouring items of one level."""
    w = W.partitionBy("page_id").orderBy("block_no")
    items = blocks.filter("kind = 'item'")
    new = ((F.col("block_no") - F.lag("block_no").over(w) != 1) | (F.col("list_level") != F.lag("list_level").over(w))).cast("int")
    items = items.withColumn("list_no", F.sum(F.coalesce(new, F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return items.groupBy("page_id", "list_no").agg(F.max("list_level").alias("level"), F.min("block_no").alias("first_block"), F.count("*").alias("items"))


def list_numbers(blocks: DataFrame) -> DataFrame:
    """(page_id, block_no, n): an item's number in its list."""
    w = W.partitionBy("page_id").orderBy("block_no")
    items = blocks.filter("kind = 'item'")
    new = (F.coalesce(F.col("block_no") - F.lag("block_no").over(w), F.lit(2)) != 1).cast("int")
    items = items.withColumn("list_no", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return items.select("page_id", "block_no", F.row_number().over(W.partitionBy("page_id", "list_no").orderBy("block_no")).alias("n"))


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(page_id, text): blocks with marks for headings, items and quotes, separated by blank lines."""
    escaped = F.regexp_replace("text", r"([\\`*_\[\]<>#~|^])", r"\\$1")
    head = F.when(F.col("outline") > 0, F.concat(F.repeat(F.lit("#"), F.col("outline")), F.lit(" "))).when(F.col("kind") == "item", F.concat(F.repeat(F.lit("  "), F.greatest(F.col("list_level") - 1, F.lit(0))), F.lit("- "))).otherwise("")
    line = F.concat(F.repeat(F.lit("> "), F.col("quote_level")), head, escaped)
    rows = blocks.withColumn("line", line).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "line"))).alias("r"))
    return rows.select("page_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n\n").alias("text"))


def ingest_diagnostics(tokens: DataFrame, k: int = 8) -> DataFrame:
    """(page_id, tags): the k commonest opening tags as name=count, by count and name."""
    n = tokens.filter("kind IN ('tag', 'raw') AND name <> ''").groupBy("page_id", "name").agg(F.count("*").alias("n"))
    r = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("n"), "name"))
    top = n.withColumn("r", r).filter(F.col("r") <= k).withColumn("s", F.concat("name", F.lit("="), F.col("n").cast("string")))
    rows = top.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("r", "s"))).alias("x"))
    return rows.select("page_id", F.array_join(F.transform("x", lambda e: e["s"]), ", ").alias("tags"))


def xml_paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, n, text): text between the edges of block-like elements, white space as one space, empty ones dropped."""
    t = html_tokens(pages).filter("kind IN ('tag', 'close', 'text')")
    edge = (F.col("name").isin("p", "para", "title", "section", "li", "row", "td", "div", "h1") & (F.col("kind") != "text")).cast("int")
    t = t.withColumn("bid", F.sum(edge).over(W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = t.filter("kind = 'text'").groupBy("page_id", "bid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), "").alias("raw"))
    rows = rows.withColumn("text", F.trim(decode_entities(F.col("raw")))).filter("text <> ''")
    return rows.select("page_id", F.row_number().over(W.partitionBy("page_id").orderBy("bid")).alias("n"), "text")


#: A line break while white space is joined.
BREAK = "\x01"
#: Elements that are named, not read.
MEDIA = ("video", "audio", "iframe", "embed", "object")
#: Elements of which nothing is read.
UNREAD = ("head", "title", "noscript", "template", "svg", "math")


def html_elements(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, kind, outline, list_kind, list_level, number, checked, quote_level, language, text, src): all blocks.

    kind is heading, item, code, rule, image, media, paragraph or text. Items have their list's kind and level, and in
    ordered lists the number that `value`, `start` or counting gives; checked is null without a box. Code keeps its white
    space and has the language of its class, empty without one. Media elements are [name src].
    """
    t = html_tokens(pages).filter("kind IN ('tag', 'close', 'text')")
    page = W.partitionBy("page_id")
    run = page.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    tag, name = F.col("kind") == "tag", F.col("name")
    step = lambda *n: F.when(name.isin(*n), F.when(tag, 1).when(F.col("kind") == "close", -1).otherwise(0)).otherwise(0)
    edge = name.isin(*BLOCK_TAGS, *MEDIA) & F.col("kind").isin("tag", "close")
    t = t.withColumns({"bid": F.sum(edge.cast("int")).over(run), "quote": F.sum(step("blockquote")).over(run), "depth": F.sum(step("ul", "ol")).over(run), "pre": F.sum(step("pre")).over(run), "hidden": F.sum(step(*UNREAD)).over(run)})
    t = t.withColumns({"bid": F.when(F.col("pre") > 0, F.max(F.when(tag & (name == "pre"), F.col("bid"))).over(run)).otherwise(F.col("bid"))}).filter("hidden = 0")
    level = W.partitionBy("page_id", "depth").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    opens = tag & name.isin("ul", "ol")
    t = t.withColumns({"list": F.last(F.when(opens, F.col("pos")), True).over(level), "list_kind": F.last(F.when(opens, name), True).over(level), "start": F.last(F.when(opens, F.coalesce(attribute("start").try_cast("int"), F.lit(1))), True).over(level)})
    own = W.partitionBy("page_id", "list").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    li = tag & (name == "li")
    t = t.withColumn("nth", F.sum(li.cast("int")).over(own))
    t = t.withColumns({"item": F.last(F.when(li, F.col("pos")), True).over(level), "number": F.last(F.when(li, F.coalesce(attribute("value").try_cast("int"), F.col("start") + F.col("nth") - 1)), True).over(level)})
    box = tag & (name == "input") & (F.lower(attribute("type")) == "checkbox")
    t = t.withColumn("box", F.max(F.when(box, F.col("tok").rlike(r"(?i)\schecked\b").cast("int"))).over(W.partitionBy("page_id", "item", "depth")))
    said = F.when(tag & name.isin("pre", "code") & (F.col("pre") > 0), F.regexp_extract(F.coalesce(attribute("class"), F.lit("")), r"(?i)(?:^|\s)lang(?:uage)?-(\S+)", 1))
    t = t.withColumns({"src": F.when(tag & name.isin("img", "hr", *MEDIA), F.coalesce(attribute("src"), attribute("data"), F.lit(""))), "alt": F.when(tag & (name == "img"), F.coalesce(attribute("alt"), F.lit("")))})
    t = t.withColumns({"context": F.max(F.when(edge & tag, name)).over(W.partitionBy("page_id", "bid")), "language": F.max(said).over(W.partitionBy("page_id", "bid"))})
    t = t.withColumn("inline", F.coalesce(F.col("context").isin(*INLINE_BLOCKS), F.lit(False)))
    inline, src, alt = F.col("inline"), F.col("src"), F.col("alt")
    text = (
        F.when(F.col("kind") == "text", F.col("tok")).when(tag & (name == "br"), BREAK)
        .when(tag & (name == "img"), F.when(inline, F.concat(F.lit("["), alt, F.lit("]("), src, F.lit(")"))).otherwise(alt))
        .when(tag & (name == "hr"), "").when(tag & name.isin(*MEDIA), F.concat(F.lit("["), name, F.lit(" "), src, F.lit("]")))
    )
    alone = tag & (name.isin("hr", *MEDIA) | ((name == "img") & ~inline))
    t = t.withColumn("alone", alone).withColumns({"piece": text, "key": F.when(inline & ~F.col("alone"), F.col("bid")).otherwise(F.lit(-1) - F.col("pos")), "src": F.when(F.col("alone"), src)}).filter("piece IS NOT NULL")
    first = lambda c: F.max(c).alias(c)
    rows = t.groupBy("page_id", "key").agg(
        F.min("pos").alias("pos"), F.max(F.when(F.col("alone"), F.col("name")).otherwise(F.when(F.col("inline"), F.col("context")).otherwise("text"))).alias("tag"), first("depth"), first("quote"), first("list_kind"), first("number"), first("box"),
        first("language"), first("src"), F.max("item").alias("item"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("raw"),
    )
    code = F.col("tag") == "pre"
    kind = (
        F.when(F.col("tag").rlike("^h[1-6]$"), "heading").when(code, "code").when(F.col("tag") == "hr", "rule").when(F.col("tag") == "img", "image").when(F.col("tag").isin(*MEDIA), "media")
        .when((F.col("tag") == "li") & (F.col("depth") > 0), "item").when(F.col("tag") == "text", "text").otherwise("paragraph")
    )
    plain = F.replace(decode_characters(F.regexp_replace("raw", r"^\n|\n$", "")), F.lit(BREAK), F.lit("\n"))
    joined = F.trim(F.regexp_replace(decode_entities(F.col("raw")), f" ?{BREAK} ?", "\n"))
    rows = rows.withColumns({"kind_": kind, "text": F.when(code, plain).when(F.col("tag").isin("hr", "img", *MEDIA), F.col("raw")).otherwise(joined)})
    rows = rows.filter("text <> '' OR kind_ IN ('rule', 'image')")
    item = F.col("kind_") == "item"
    return rows.select(
        "page_id", F.row_number().over(W.partitionBy("page_id").orderBy("pos")).alias("block_no"), F.col("kind_").alias("kind"), F.when(F.col("kind_") == "heading", F.substring("tag", 2, 1).cast("int")).otherwise(0).alias("outline"),
        F.when(item, F.when(F.col("list_kind") == "ol", "ordered").otherwise("bullet")).alias("list_kind"), F.when(item, F.col("depth").cast("int")).otherwise(0).alias("list_level"), F.when(item & (F.col("list_kind") == "ol"), F.col("number").cast("int")).alias("number"),
        F.when(item, F.col("box") == 1).alias("checked"), F.col("quote").cast("int").alias("quote_level"), F.when(F.col("kind_") == "code", F.coalesce("language", F.lit(""))).alias("language"), "text", "src",
    )


def element_lists(elements: DataFrame) -> DataFrame:
    """(page_id, list_no, list_kind, level, first_block, items, start): neighbouring items of one kind and level; start is
    the first number of an ordered list where it is not 1."""
    w = W.partitionBy("page_id").orderBy("block_no")
    items = elements.filter("kind = 'item'")
    goes_on = (F.col("block_no") - F.lag("block_no").over(w) == 1) & (F.col("list_level") == F.lag("list_level").over(w)) & (F.col("list_kind") == F.lag("list_kind").over(w))
    items = items.withColumn("list_no", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = items.groupBy("page_id", "list_no").agg(F.max("list_kind").alias("list_kind"), F.max("list_level").alias("level"), F.min("block_no").alias("first_block"), F.count("*").alias("items"), F.min_by("number", "block_no").alias("n"))
    return out.withColumn("start", F.when((F.col("list_kind") == "ordered") & (F.col("n") != 1), F.col("n"))).drop("n")


def elements_to_markdown(elements: DataFrame) -> DataFrame:
    """(page_id, text): all blocks as Markdown; items of one list follow each other, other blocks after a blank line."""
    escaped = F.replace(F.regexp_replace("text", r"([\\`*_\[\]<>#~|^])", r"\\$1"), F.lit("\n"), F.lit("  \n"))
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("text", F.lit("`+"), F.lit(0)), lambda x: F.length(x))), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    box = F.when(F.col("checked"), "[x] ").when(~F.col("checked"), "[ ] ").otherwise("")
    mark = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("list_level") - 1, F.lit(0))), F.when(F.col("list_kind") == "ordered", F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- "), box)
    body = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("outline")), F.lit(" "), escaped)).when(F.col("kind") == "item", F.concat(mark, escaped))
        .when(F.col("kind") == "code", F.concat(fence, "language", F.lit("\n"), "text", F.lit("\n"), fence)).when(F.col("kind") == "rule", "---")
        .when(F.col("kind") == "image", F.concat(F.lit("!["), "text", F.lit("]("), "src", F.lit(")"))).otherwise(escaped)
    )
    quoted = F.array_join(F.transform(F.split(body, "\n", -1), lambda x: F.concat(F.repeat(F.lit("> "), F.col("quote_level")), x)), "\n")
    w = W.partitionBy("page_id").orderBy("block_no")
    tight = (F.col("kind") == "item") & (F.lag("kind").over(w) == "item")
    lead = F.when(F.lag("kind").over(w).isNull(), "").when(F.coalesce(tight, F.lit(False)), "\n").otherwise("\n\n")
    rows = elements.withColumn("line", F.concat(lead, quoted)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "line"))).alias("r"))
    return rows.select("page_id", F.array_join(F.transform("r", lambda x: x["line"]), "").alias("text"))


def elements_to_html(elements: DataFrame, xhtml: bool = False) -> DataFrame:
    """(page_id, text): all blocks as a document, with lists by kind and start, quotes by depth, tasks, code, rules, images."""
    w = W.partitionBy("page_id").orderBy("block_no")
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    attr = lambda c: F.replace(escape(c), F.lit('"'), F.lit("&quot;"))
    end = " />" if xhtml else ">"
    t = F.replace(F.replace(escape(F.col("text")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;")) if xhtml else escape(F.col("text"))
    t = F.when(F.col("kind") == "code", t).otherwise(F.replace(t, F.lit("\n"), F.lit(f"<br{end}")))
    group = F.when(F.col("kind") == "item", F.concat_ws(":", "list_kind", "list_level", "quote_level"))
    e = elements.withColumn("group", group).withColumns({"before": F.lag("group").over(w), "after": F.lead("group").over(w), "q0": F.coalesce(F.lag("quote_level").over(w), F.lit(0)), "q1": F.coalesce(F.lead("quote_level").over(w), F.lit(0))})
    item = F.col("kind") == "item"
    first, last = item & ~F.coalesce(F.col("before") == F.col("group"), F.lit(False)), item & ~F.coalesce(F.col("after") == F.col("group"), F.lit(False))
    ordered = F.col("list_kind") == "ordered"
    start = F.when(F.col("number") != 1, F.concat(F.lit(' start="'), F.col("number").cast("string"), F.lit('"'))).otherwise("")
    opened = F.when(first, F.when(ordered, F.concat(F.lit("<ol"), start, F.lit(">\n"))).otherwise("<ul>\n")).otherwise("")
    closed = F.when(last, F.when(ordered, "\n</ol>").otherwise("\n</ul>")).otherwise("")
    disabled = ' disabled="disabled"' if xhtml else " disabled"
    box = F.when(F.col("checked").isNotNull(), F.concat(F.lit(f'<input type="checkbox"{disabled}'), F.when(F.col("checked"), ' checked="checked"' if xhtml else " checked").otherwise(""), F.lit(f"{end} "))).otherwise("")
    heading = F.concat(F.lit("h"), F.col("outline").cast("string"))
    language = F.when(F.col("language") != "", F.concat(F.lit(' class="language-'), attr(F.col("language")), F.lit('"'))).otherwise("")
    body = (
        F.when(item, F.concat(F.lit("<li>"), box, t, F.lit("</li>"))).when(F.col("kind") == "heading", F.concat(F.lit("<"), heading, F.lit(">"), t, F.lit("</"), heading, F.lit(">")))
        .when(F.col("kind") == "code", F.concat(F.lit("<pre><code"), language, F.lit(">"), t, F.lit("</code></pre>"))).when(F.col("kind") == "rule", f"<hr{end}")
        .when(F.col("kind") == "image", F.concat(F.lit('<img src="'), attr(F.col("src")), F.lit('" alt="'), attr(F.col("text")), F.lit(f'"{end}'))).otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>")))
    )
    deeper, shallower = F.greatest(F.col("quote_level") - F.col("q0"), F.lit(0)), F.greatest(F.col("quote_level") - F.col("q1"), F.lit(0))
    line = F.concat(F.repeat(F.lit("<blockquote>\n"), deeper), opened, body, closed, F.repeat(F.lit("\n</blockquote>"), shallower))
    rows = e.withColumn("line", line).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "line"))).alias("r"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><body>\n' if xhtml else "<!DOCTYPE html>\n<html><body>\n"
    return rows.select("page_id", F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n</body></html>\n")).alias("text"))
