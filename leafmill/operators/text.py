"""Plain-text documents: paragraphs, statistics, search, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import media_extension
from ..sources.tables import stored


def txt_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text): a paragraph for each line; one trailing CR goes, and an empty last line."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("parts"))
    lines = lines.withColumn("parts", F.when(F.element_at("parts", -1) == "", F.slice("parts", 1, F.size("parts") - 1)).otherwise(F.col("parts")))
    return lines.select("doc_id", F.posexplode("parts").alias("pos", "text")).withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def words(text) -> F.Column:
    return F.filter(F.split(text, "[ \\t\\r\\n]"), lambda w: w != "")


def doc_stats(docs: DataFrame) -> DataFrame:
    """Characters without and with spaces, words, lines and paragraphs of each document."""
    t = F.coalesce("text", F.lit(""))
    flat = F.regexp_replace(t, "[\\r\\n]", "")
    paragraphs = F.size(F.split(t, "\n", -1)) - F.when(t.endswith("\n") | (t == ""), 1).otherwise(0)
    return docs.select(
        *[c for c in ("doc_id", "source", "lang") if c in docs.columns],
        F.length(F.replace(flat, F.lit(" "), F.lit(""))).cast("long").alias("chars"),
        F.length(flat).cast("long").alias("chars_with_spaces"),
        F.size(words(t)).cast("long").alias("words"),
        (F.size(F.split(t, "\n", -1))).cast("long").alias("lines"),
        paragraphs.cast("long").alias("paragraphs"),
    )


def corpus_stats(docs: DataFrame) -> DataFrame:
    """doc_stats rolled up by source and language."""
    s = doc_stats(docs)
    sums = [F.sum(c).alias(c) for c in ("chars", "chars_with_spaces", "words", "lines", "paragraphs")]
    return s.rollup("source", "lang").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("docs"), *sums)


def estimate_bytes(blocks: DataFrame) -> DataFrame:
    """(doc_id, bytes, label): 96 bytes a block, 64 a run and two a UTF-16 unit; one run a block."""
    units = F.octet_length(F.encode("text", "UTF-16LE"))
    out = blocks.groupBy("doc_id").agg(F.sum(F.lit(96 + 64) + units).cast("long").alias("bytes"))
    b = F.col("bytes")
    label = (
        F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1 << 20, F.format_string("%.1f KB", b / F.lit(1024.0).cast("double")))
        .when(b < 1 << 30, F.format_string("%.1f MB", b / F.lit(float(1 << 20)))).otherwise(F.format_string("%.2f GB", b / F.lit(float(1 << 30))))
    )
    return out.withColumn("label", label)


def infer_title(blocks: DataFrame, n: int = 6) -> DataFrame:
    """(doc_id, title): the first words of the first block; null if it has none."""
    first = blocks.groupBy("doc_id").agg(F.min_by("text", "pos").alias("t"))
    title = F.array_join(F.slice(words(F.col("t")), 1, n), " ")
    return first.select("doc_id", F.when(title != "", title).alias("title"))


def enumerate_paragraphs(blocks: DataFrame) -> DataFrame:
    """Top-level paragraphs with a running number in document order."""
    top = blocks.filter((F.col("kind") == "paragraph") & (F.col("depth") == 0))
    return top.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")))


def to_plain_text(blocks: DataFrame, end: str = "") -> DataFrame:
    """(doc_id, text): blocks joined by line feeds, in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "text")))
    out = blocks.groupBy("doc_id").agg(rows.alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return out.select("doc_id", F.concat(text, F.lit(end)).alias("text"))


def preview_text(blocks: DataFrame) -> DataFrame:
    """One line for each paragraph, each ended by a line feed."""
    return to_plain_text(blocks, "\n")


def find_all(blocks: DataFrame, query: str, case_sensitive: bool = True) -> DataFrame:
    """(doc_id, pos, hit, off): every non-overlapping literal hit in a block, at a 0-based offset; none for no query."""
    if not query:
        return blocks.select("doc_id", "pos", F.lit(0).alias("hit"), F.lit(0).alias("off")).limit(0)
    t, q = F.col("text"), F.lit(query)
    if not case_sensitive:
        t, q = F.lower(t), F.lower(q)
    parts = F.split(t, "\\Q" + (query if case_sensitive else query.lower()) + "\\E", -1)
    sized = blocks.filter(t.contains(q)).select("doc_id", "pos", F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.length(p)).alias("sizes"))
    n = len(query)
    # one row for each hit with the length before it; offsets are running sums
    hits = sized.select("doc_id", "pos", F.posexplode("sizes").alias("hit", "size"))
    before = F.sum("size").over(W.partitionBy("doc_id", "pos").orderBy("hit").rowsBetween(W.unboundedPreceding, W.currentRow))
    return hits.select("doc_id", "pos", "hit", (before + F.col("hit") * n).cast("int").alias("off"))


def find_next(hits: DataFrame, start_pos, start_at) -> DataFrame:
    """The first of find_all's hits of each document at or after a place, else the first of all."""
    wrapped = ~((F.col("pos") > start_pos) | ((F.col("pos") == start_pos) & (F.col("off") >= start_at)))
    first = F.min(F.struct(wrapped.alias("wrapped"), "pos", "off")).alias("f")
    return hits.groupBy("doc_id").agg(first).select("doc_id", "f.pos", "f.off", "f.wrapped")


def replace_all(docs: DataFrame, query: str, replacement: str, case_sensitive: bool = True) -> DataFrame:
    """docs with text replaced in one pass and n_replaced; the replacement is not searched again."""
    t = F.coalesce("text", F.lit(""))
    if not query:
        return docs.withColumn("n_replaced", F.lit(0))
    pattern = ("" if case_sensitive else "(?i)") + "\\Q" + query + "\\E"
    n = F.regexp_count(t, F.lit(pattern))
    quoted = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return docs.withColumn("n_replaced", n).withColumn("text", F.regexp_replace(t, pattern, quoted))


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """rows with a running number in an order of all of them, without bringing them to one task.

    Rows are dealt by range and stored with their range, so that ranks and the counts of the ranges before, of which there is
    a row each, come from one evaluation.
    """
    spread = stored(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "ranges")
    rank = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    before = spread.groupBy("_range").agg(F.count("*").alias("_m")).withColumn("_before", F.sum("_m").over(W.orderBy("_range")) - F.col("_m")).drop("_m")
    return spread.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + rank + (start - 1)).drop("_range", "_before")


def dedupe_resources(resources: DataFrame) -> DataFrame:
    """resources (pos, content, media_type, ...) with sha256, copies, the number and path of their stored part, in order of
    appearance, and the bytes that the copies of this content save.

    The part's extension is that of its first appearance's media type, .bin for others and where there is no such column.
    """
    hashed = resources.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    media = F.col("media_type") if "media_type" in resources.columns else F.lit(None).cast("string")
    size = F.octet_length(F.col("content").cast("binary")).cast("long")
    first = hashed.groupBy("sha256").agg(F.min(F.struct(F.col("pos"), media.alias("media"), size.alias("size"))).alias("f"), F.count("*").alias("copies"))
    first = first.select("sha256", "copies", F.col("f.pos").alias("first"), F.col("f.media").alias("media"), (F.col("f.size") * (F.col("copies") - 1)).alias("saved"))
    parts = numbered(first, ["first", "sha256"], "number")
    path = F.concat(F.format_string("resources/images/img-%04d", F.col("number")), media_extension(F.col("media")))
    return hashed.join(parts.select("sha256", "copies", "saved", "number", path.alias("path")), "sha256")


def split_fragments(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, frag, text): pieces of size characters."""
    t = F.coalesce("text", F.lit(""))
    n = F.greatest(F.ceil(F.length(t) / F.lit(size)), F.lit(1))
    cut = docs.select("doc_id", t.alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("frag"))
    return cut.select("doc_id", F.col("frag").cast("int").alias("frag"), F.substr("t", (F.col("frag") * size + 1).cast("int"), F.lit(size)).alias("text"))


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """The inverse: fragments joined in order."""
    out = fragments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("frag", "text"))).alias("r"))
    return out.select("doc_id", F.array_join(F.transform("r", lambda x: x["text"]), "").alias("text"))


def split_at(paragraphs: DataFrame, cuts: DataFrame) -> DataFrame:
    """paragraphs (doc_id, pos, node_id, text, marker, before, after) cut at character offsets (doc_id, pos, at), as fragments
    with frag from 0.

    Of several fragments each has the paragraph's id and its index (id§f0, id§f1, ...); one without an id gets §g and its
    place. Only the first keeps the list marker and the space before, only the last the space after.
    """
    at = cuts.groupBy("doc_id", "pos").agg(F.sort_array(F.collect_set("at")).alias("_at"))
    p = paragraphs.join(at, ["doc_id", "pos"], "left")
    size = F.length("text")
    inner = F.filter(F.coalesce("_at", F.array().cast("array<int>")), lambda x: (x > 0) & (x < size))
    p = p.withColumn("_edges", F.concat(F.array(F.lit(0)), inner, F.array(size)))
    p = p.withColumn("_n", F.size("_edges") - 1).withColumn("frag", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start, end = F.get("_edges", F.col("frag")), F.get("_edges", F.col("frag") + 1)
    base = F.coalesce("node_id", F.concat(F.lit("§g"), F.col("pos").cast("string")))
    first, last = F.col("frag") == 0, F.col("frag") == F.col("_n") - 1
    return p.select(
        "doc_id", "pos", "frag", F.when(F.col("_n") > 1, F.concat(base, F.lit("§f"), F.col("frag").cast("string"))).otherwise(F.col("node_id")).alias("node_id"), F.substr("text", start + 1, end - start).alias("text"),
        F.when(first, F.col("marker")).alias("marker"), F.when(first, F.col("before")).otherwise(0.0).alias("before"), F.when(last, F.col("after")).otherwise(0.0).alias("after"),
    )


def merge_by_ids(fragments: DataFrame) -> DataFrame:
    """The inverse: fragments (doc_id, ord, node_id, text, marker, before, after) in the order of ord, by the ids that they share.

    An index that comes again begins another paragraph; a fragment alone stays; generated ids go.
    """
    rx = "^(.*)§f([0-9]+)$"
    f = fragments.withColumn("_base", F.when(F.col("node_id").rlike(rx), F.regexp_extract("node_id", rx, 1))).withColumn("_index", F.regexp_extract(F.coalesce("node_id", F.lit("")), rx, 2))
    again = F.row_number().over(W.partitionBy("doc_id", "_base", "_index").orderBy("ord"))
    f = f.withColumn("_copy", F.when(F.col("_base").isNotNull(), again).otherwise(0)).withColumn("_own", F.when(F.col("_base").isNull(), F.col("ord")))
    rows = f.groupBy("doc_id", "_base", "_copy", "_own").agg(
        F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_r"), F.min_by("node_id", "ord").alias("_id"), F.min_by("marker", "ord").alias("marker"), F.min_by("before", "ord").alias("before"), F.max_by("after", "ord").alias("after")
    )
    name = F.coalesce("_base", "_id")
    return rows.select("doc_id", "ord", F.when(~name.startswith("§g"), name).alias("node_id"), F.array_join(F.transform("_r", lambda x: x["text"]), "").alias("text"), "marker", "before", "after")


def diff_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, pos, status) of blocks between two versions: added, removed, modified or clean."""
    a = old.select("doc_id", "pos", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("a"))
    b = new.select("doc_id", "pos", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").otherwise("clean")
    return a.join(b, ["doc_id", "pos"], "full").select("doc_id", "pos", status.alias("status"))


def quote_groups(blocks: DataFrame) -> DataFrame:
    """(doc_id, depth, grp, first_pos, last_pos): runs of neighbouring quoted blocks (doc_id, pos, level) at each depth."""
    l = blocks.filter("level > 0").select("doc_id", "pos", F.explode(F.sequence(F.lit(1), F.col("level"))).alias("depth"))
    w = W.partitionBy("doc_id", "depth").orderBy("pos")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(w) != 1).cast("int"), F.lit(1))
    l = l.withColumn("grp", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return l.groupBy("doc_id", "depth", "grp").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
