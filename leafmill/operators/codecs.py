"""A registry of formats: each is a pair of DataFrame transformations, to blocks and from blocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dealt, stored
from . import html, markup, text

Transform = Callable[[DataFrame], DataFrame]
#: Characters of text that one task converts.
TEXT_EACH = 1_500_000


@dataclass(frozen=True)
class Codec:
    to_blocks: Transform | None
    from_blocks: Transform | None
    refuse: Callable | None = None  # a text column to an outcome code, 0 for what can be read


class CodecRegistry:
    """Formats by id. Blocks are (doc_id, pos, kind, level, text) and what DEFAULTS names, which a reader may leave out; kinds are
    those of html.html_elements. Rendered documents are (doc_id, text)."""

    def __init__(self):
        self._codecs: dict[str, Codec] = {}

    def register(self, format_id: str, to_blocks: Transform | None = None, from_blocks: Transform | None = None, refuse: Callable | None = None) -> None:
        self._codecs[format_id] = Codec(to_blocks, from_blocks, refuse)

    def __contains__(self, format_id: str) -> bool:
        return format_id in self._codecs

    def convert(self, docs: DataFrame, source: str, target: str) -> DataFrame:
        """(doc_id, text, code) of (doc_id, text): 0 converted, 3 for no such pair of formats, 4 for an empty document, 5 for one
        that is damaged or not allowed, 6 for one of too old a version."""
        code = self._code(source, target).alias("_code")
        if not self._knows(source, target):
            return docs.select("doc_id", F.lit(None).cast("string").alias("text"), code).withColumnRenamed("_code", "code")
        out = self.write(self.read(docs.filter(code == 0).select("doc_id", "text"), source), target)
        return docs.select("doc_id", code).join(out, "doc_id", "left").select("doc_id", "text", F.col("_code").alias("code"))

    def _knows(self, source: str, target: str) -> bool:
        a, b = self._codecs.get(source), self._codecs.get(target)
        return a is not None and b is not None and a.to_blocks is not None and b.from_blocks is not None

    def _code(self, source: str, target: str) -> F.Column:
        """The outcome of each text for a pair of formats."""
        refuse = self._codecs[source].refuse if self._knows(source, target) else lambda _: F.lit(3)
        return F.when(F.coalesce("text", F.lit("")) == "", 4).otherwise(refuse(F.col("text")) if refuse else F.lit(0))

    def read(self, docs: DataFrame, source: str) -> DataFrame:
        """Blocks of (doc_id, text), with all columns. doc_id may be of any type that can be grouped by."""
        b = self._codecs[source].to_blocks(docs)
        b = b.withColumns({c: F.lit(v).cast(kind) for c, (kind, v) in DEFAULTS.items() if c not in b.columns})
        return b.select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", F.col("level").cast("int").alias("level"), "text", *[F.col(c).cast(kind).alias(c) for c, (kind, _) in DEFAULTS.items()])

    def write(self, blocks: DataFrame, target: str) -> DataFrame:
        return self._codecs[target].from_blocks(blocks)

    def views(self, docs: DataFrame, source: str) -> None:
        """Temporary views `documents_in`, `blocks`, `runs`, `cells`, `notes` and `parts` for use from spark.sql, as far as the
        format has them."""
        docs.createOrReplaceTempView("documents_in")
        self.read(docs, source).createOrReplaceTempView("blocks")
        page = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))
        if source in ("html", "xhtml"):
            html.html_runs(page).createOrReplaceTempView("runs")
            markup.html_cells(page).createOrReplaceTempView("cells")
            markup.html_notes(page).createOrReplaceTempView("notes")
        elif source == "md":
            markup.md_runs(docs).createOrReplaceTempView("runs")
            markup.md_tables(docs).createOrReplaceTempView("cells")
        docs.select(F.col("doc_id").alias("pkg"), F.lit("document").alias("path"), F.col("text").cast("binary").alias("content")).createOrReplaceTempView("parts")


def convert_corpus(registry: CodecRegistry, docs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(from, to, doc_id, text, code) of documents (doc_id, from, to, text): each converted as it asks for.

    pairs are the formats that are asked for; a document that asks for another pair has code 3. Null and repeated doc_ids are
    requests of their own; a document without any block has code 0 and a null text.

    docs are read once and stored by the pair asked for. The rows of a pair are dealt by request while they are whole texts, in
    tasks of bounded size; its reader, its writer and the join with the requests go on by that key, so that no blocks and no
    rendered texts are stored or shuffled, and no row is read again for each pair.
    """
    asks = [(F.col("from") == a) & (F.col("to") == b) for a, b in pairs]
    code, pair = F.when(F.coalesce("text", F.lit("")) == "", 4), F.when(F.lit(False), -1)
    for k, ((a, b), own) in enumerate(zip(pairs, asks, strict=True)):
        code, pair = code.when(own, registry._code(a, b)), pair.when(own, k)
    text = F.col("text").cast("string")
    asked = docs.select(F.monotonically_increasing_id().alias("request"), "doc_id", "from", "to", text.alias("text"), F.length(text).alias("chars"), code.otherwise(3).alias("code"), pair.otherwise(-1).alias("pair"))
    asked = stored(asked, "requests", by="pair")
    able = F.col("code") == 0
    totals = {r["pair"]: r["chars"] for r in asked.filter(able).groupBy("pair").agg(F.sum("chars").alias("chars")).collect()}  # a row for each pair
    out = asked.filter(~able).select("from", "to", "doc_id", F.lit(None).cast("string").alias("text"), "code")
    for k, (a, b) in enumerate(pairs):
        if k in totals:
            own = asked.filter(able & (F.col("pair") == k))
            whole = dealt(own.select(F.col("request").alias("doc_id"), "text"), "doc_id", totals[k], TEXT_EACH)
            done = registry.write(registry.read(whole, a), b).select(F.col("doc_id").alias("request"), "text")
            who = dealt(own.select("request", "doc_id", "from", "to", "code"), "request", totals[k], TEXT_EACH)
            out = out.unionByName(who.join(done.hint("merge"), "request", "left").select("from", "to", "doc_id", "text", "code"))
    return out


#: What blocks may have beside their place, kind, level and text: the types, and the values where a format has none.
DEFAULTS = {"list_kind": ("string", None), "list_level": ("int", 0), "number": ("int", None), "checked": ("boolean", None), "quote_level": ("int", 0), "language": ("string", None), "src": ("string", None)}


def _from_txt(docs: DataFrame) -> DataFrame:
    return text.txt_paragraphs(docs).select("doc_id", "pos", F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), "text")


def _from_html(docs: DataFrame) -> DataFrame:
    b = html.html_elements(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html")))
    return b.withColumnsRenamed({"page_id": "doc_id", "block_no": "pos", "outline": "level"})


def _from_md(docs: DataFrame) -> DataFrame:
    """All blocks with what quotes hold; a picture alone in its paragraph is an image, escaped marks are plain, and lines that
    end in two spaces stay lines."""
    b = markup.md_containers(docs)
    item, image = F.col("kind").isin("bullet", "ordered"), r"^!\[(.*)\]\(([^()\s]*)\)$"
    picture = (F.col("kind") == "paragraph") & F.col("text").rlike(image)
    plain = F.regexp_replace(F.replace(F.col("text"), F.lit("  \n"), F.lit("\n")), r"\\([\\`*_\[\]<>#~|^])", "$1")
    return b.select(
        "doc_id", F.col("block_no").alias("pos"), F.when(item, "item").when(picture, "image").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "heading", F.col("level")).otherwise(0).alias("level"),
        F.when(F.col("kind").isin("code", "math", "html"), F.col("text")).when(picture, F.regexp_extract("text", image, 1)).otherwise(plain).alias("text"), F.when(item, F.col("kind")).alias("list_kind"),
        F.when(item, F.col("level")).otherwise(0).alias("list_level"), "number", "checked", "quote_level", F.when(F.col("kind") == "code", F.coalesce("language", F.lit(""))).alias("language"), F.when(picture, F.regexp_extract("text", image, 2)).alias("src"),
    )


def _from_xml(docs: DataFrame) -> DataFrame:
    b = html.xml_paragraphs(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html")))
    return b.select(F.col("page_id").alias("doc_id"), F.col("n").alias("pos"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), "text")


def _from_docx(docs: DataFrame) -> DataFrame:
    b = markup.office_paragraphs(docs.select(F.col("doc_id").alias("pkg"), F.col("text").alias("content")))
    return b.select(F.col("pkg").alias("doc_id"), "pos", F.when(F.col("outline") > 0, "heading").otherwise("paragraph").alias("kind"), F.col("outline").alias("level"), "text")


def has_doctype_entities(text) -> F.Column:
    """5 for XML whose document type declares anything, 0 otherwise."""
    return F.when(text.rlike(r"(?is)<!DOCTYPE[^>]*\[|<!ENTITY"), 5).otherwise(0)


def too_old(text, least: float = 15.0) -> F.Column:
    """6 for a document part with an application version below the least one, 0 otherwise and without any."""
    v = F.regexp_extract(text, r"<AppVersion>(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(v < least, 6).otherwise(0)


def _written(writer: Transform) -> Transform:
    """A writer of elements of pages as a writer of blocks of documents."""
    return lambda b: writer(b.withColumnsRenamed({"doc_id": "page_id", "pos": "block_no", "level": "outline"})).withColumnRenamed("page_id", "doc_id")


def default_registry(spark: SparkSession | None = None) -> CodecRegistry:
    """Plain text, HTML, XHTML and Markdown; JSON documents can only be written by their own job."""
    r = CodecRegistry()
    r.register("txt", _from_txt, lambda b: text.to_plain_text(b))
    r.register("html", _from_html, _written(html.elements_to_html))
    r.register("xhtml", _from_html, _written(lambda e: html.elements_to_html(e, xhtml=True)))
    r.register("xml", _from_xml, None, has_doctype_entities)
    r.register("docx", _from_docx, None, too_old)
    r.register("md", _from_md, _written(html.elements_to_markdown))
    return r
