"""Lookups between documents and their notes, resources, styles, parts and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def note_numbers(notes: DataFrame) -> DataFrame:
    """notes (doc_id, kind, note_id, ordinal) with their number from 1, by kind."""
    return notes.withColumn("number", F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("ordinal")))


def resolve_notes(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """refs (doc_id, kind, note_id, ...) with the number of their note and the mark to show, empty if there is none."""
    n = note_numbers(notes).select("doc_id", "kind", "note_id", "number")
    out = refs.join(n, ["doc_id", "kind", "note_id"], "left")
    return out.withColumn("mark", F.coalesce(F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]")), F.lit("")))


def rehydrate_resources(images: DataFrame, parts: DataFrame, external) -> DataFrame:
    """images (doc_id, path) with content, size and status: external, ok, or missing where no part (doc_id, path) has the path."""
    p = parts.select("doc_id", "path", "content", F.lit(True).alias("_there")).dropDuplicates(["doc_id", "path"])
    out = images.withColumn("_external", external)
    out = out.join(p, ["doc_id", "path"], "left")
    status = F.when(F.col("_external"), "external").when(F.col("_there"), "ok").otherwise("missing")
    content = F.when(~F.col("_external"), F.col("content"))
    return out.select("doc_id", "path", content.alias("content"), F.octet_length(content).alias("size"), status.alias("status"))


def resolve_part_path(refs: DataFrame, parts: DataFrame) -> DataFrame:
    """(pkg, ref, path): the part that a reference means; exact, then with slashes, then in any case, then by file name.

    Four equi-joins on derived keys, of which the first that matches wins, instead of one join on alternatives.
    """
    clean = lambda c: F.ltrim(F.replace(c, F.lit("\\"), F.lit("/")), F.lit("/"))
    keys = [lambda c: c, clean, lambda c: F.lower(clean(c)), lambda c: F.lower(F.regexp_extract(clean(c), r"([^/]*)$", 1))]
    explode = lambda df, col: df.withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), f(F.col(col)).alias("key")) for i, f in enumerate(keys)]))).select("*", "k.rank", "k.key").drop("k")
    found = explode(refs, "ref").join(explode(parts.select("pkg", "path"), "path"), ["pkg", "rank", "key"])
    best = found.groupBy("pkg", "ref").agg(F.min(F.struct("rank", "path")).alias("b")).select("pkg", "ref", "b.path")
    return refs.join(best, ["pkg", "ref"], "left")


def apply_metadata_updates(docs: DataFrame, updates: DataFrame) -> DataFrame:
    """docs (doc_id, author, editor, created, modified) after updates (doc_id, author, editor, at); blank is null.

    A first author sets created, another editor sets modified; dirty tells whether anything changed.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    u = updates.select("doc_id", blank(F.col("author")).alias("u_author"), blank(F.col("editor")).alias("u_editor"), "at", F.lit(True).alias("has"))
    j = docs.join(u, "doc_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    new_author, new_editor = F.when(F.col("has"), F.col("u_author")).otherwise(F.col("author")), F.when(F.col("has"), F.col("u_editor")).otherwise(F.col("editor"))
    edited = F.col("has") & ~F.col("editor").eqNullSafe(F.col("u_editor"))
    return j.select(
        "doc_id", new_author.alias("author"), new_editor.alias("editor"), F.when(F.col("has") & F.col("author").isNull() & F.col("u_author").isNotNull(), F.col("at")).otherwise(F.col("created")).alias("created"),
        F.when(edited, F.col("at")).otherwise(F.col("modified")).alias("modified"), (edited | (F.col("has") & ~F.col("author").eqNullSafe(F.col("u_author")))).alias("dirty"),
    )


def provenance_join(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, node_id, state): anchored, unanchored (a block alone) or orphan (an anchor alone)."""
    b = blocks.select("doc_id", "node_id", F.lit(True).alias("b"))
    a = anchors.select("doc_id", "node_id", F.lit(True).alias("a"))
    state = F.when(F.col("a").isNull(), "unanchored").when(F.col("b").isNull(), "orphan").otherwise("anchored")
    return b.join(a, ["doc_id", "node_id"], "full").select("doc_id", "node_id", state.alias("state"))


def provenance_coverage(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(format, state, n): how many nodes of each format are anchored, unanchored (no format) or orphans."""
    b = blocks.select("doc_id", "node_id", F.lit(True).alias("b"))
    a = anchors.select("doc_id", "node_id", "format", F.lit(True).alias("a"))
    state = F.when(F.col("a").isNull(), "unanchored").when(F.col("b").isNull(), "orphan").otherwise("anchored")
    return b.join(a, ["doc_id", "node_id"], "full").groupBy("format", state.alias("state")).agg(F.count("*").alias("n"))


def status_rollup(blocks: DataFrame) -> DataFrame:
    """(doc_id, clean, modified, opaque, degraded): blocks (doc_id, status) by status."""
    return blocks.groupBy("doc_id").agg(*[F.count(F.when(F.col("status") == k, 1)).alias(k) for k in ("clean", "modified", "opaque", "degraded")])


def export_plan(blocks: DataFrame, anchors: DataFrame, target: str) -> DataFrame:
    """(doc_id, node_id, action) for blocks (status) and anchors (format): what a writer of the target format does."""
    same = F.coalesce(F.col("format") == target, F.lit(False))
    action = (
        F.when((F.col("status") == "clean") & same, "reuse").when((F.col("status") == "opaque") & same, "re-emit").when(F.col("status") == "opaque", "placeholder")
        .when(F.col("status") == "degraded", "degraded").otherwise("reserialise")
    )
    return blocks.join(anchors.select("doc_id", "node_id", "format"), ["doc_id", "node_id"], "left").select("doc_id", "node_id", action.alias("action"))


#: Rows of a catalogue up to which it is sent to all tasks.
SMALL_CATALOGUE = 10_000


def resolve_emoji(runs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """runs (id, key) with the catalogue's (section, name, glyph) for Section_name; unknown keys stay as text."""
    r = runs.withColumns({"section": F.regexp_extract("key", "^([^_]*)_", 1), "name": F.regexp_extract("key", "^[^_]*_(.*)$", 1)})
    small = catalogue.limit(SMALL_CATALOGUE + 1).count() <= SMALL_CATALOGUE
    return r.join(F.broadcast(catalogue) if small else catalogue, ["section", "name"], "left").select("id", F.coalesce("glyph", "key").alias("text"))


def package_admission(parts: DataFrame, least_docx=(15, 0), least_hwpx=(1, 2)) -> DataFrame:
    """(pkg, code): 0 taken in, 5 damaged (no mimetype or document, or encrypted), 6 written by too old a version.

    A package with version.xml is HWPX and must hold a section; others are DOCX. A missing version is taken in.
    """
    has = lambda c: F.max(c.cast("int"))
    path = F.col("path")
    find = lambda at, rx: F.max(F.when(path == at, F.regexp_extract("content", rx, 1)))
    p = parts.groupBy("pkg").agg(
        has(path == "mimetype").alias("mime"), has(path == "version.xml").alias("hwpx"), has(path == "word/document.xml").alias("docx_core"), has(F.lower("path").rlike(r"contents/section\d*\.xml$")).alias("hwpx_core"),
        has(path.isin("encryption.xml", "EncryptedPackage")).alias("locked"), find("docProps/app.xml", "<AppVersion>([0-9.]+)</AppVersion>").alias("docx_v"), find("version.xml", r'xmlVersion="([0-9.]+)"').alias("hwpx_v"),
    )
    numbers = lambda v: F.concat(F.transform(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0))), F.array(F.lit(0)))
    old = lambda v, least: F.coalesce(F.col(v) != "", F.lit(False)) & (numbers(F.col(v)) < F.array(*map(F.lit, least)))
    hwpx = F.col("hwpx") == 1
    damaged = (F.col("mime") == 0) | (F.col("locked") == 1) | (F.when(hwpx, F.col("hwpx_core")).otherwise(F.col("docx_core")) == 0)
    return p.select("pkg", F.when(damaged, 5).when(F.when(hwpx, old("hwpx_v", least_hwpx)).otherwise(old("docx_v", least_docx)), 6).otherwise(0).alias("code"))


def spine_sections(parts: DataFrame) -> DataFrame:
    """(pkg, pos, path): a package's sections by its spine; else by manifest ids, else by part names."""
    hpf = parts.filter("path = 'content.hpf'")
    items = hpf.select("pkg", F.explode(F.regexp_extract_all("content", F.lit(r'<item [^>]*/>'), F.lit(0))).alias("x")).select("pkg", F.regexp_extract("x", r'\bid="([^"]*)"', 1).alias("id"), F.regexp_extract("x", r'href="([^"]*)"', 1).alias("path"))
    spine = hpf.select("pkg", F.posexplode(F.regexp_extract_all("content", F.lit(r'<itemref [^>]*idref="([^"]*)"'), F.lit(1))).alias("k", "id"))
    a = spine.join(items, ["pkg", "id"]).select("pkg", F.lit(0).alias("tier"), F.lpad(F.col("k").cast("string"), 9, "0").alias("order"), "path")
    b = items.filter(F.lower("id").startswith("section")).select("pkg", F.lit(1).alias("tier"), F.lower("id").alias("order"), "path")
    c = parts.filter(F.lower("path").contains("section")).select("pkg", F.lit(2).alias("tier"), F.lower("path").alias("order"), "path")
    every = a.unionByName(b).unionByName(c).withColumn("best", F.min("tier").over(W.partitionBy("pkg"))).filter("tier = best")
    return every.select("pkg", (F.row_number().over(W.partitionBy("pkg").orderBy("order")) - 1).alias("pos"), "path")


def package_metadata(parts: DataFrame) -> DataFrame:
    """(pkg, title, author, language, created, modified, application, version) of each package; defaults where a field is missing.

    From the core and application properties; an HWPX package tells its application and version in version.xml.
    """
    of = lambda at, rx: F.max(F.when(F.col("path") == at, F.nullif(F.trim(F.regexp_extract("content", rx, 1)), F.lit(""))))
    core = lambda tag: of("docProps/core.xml", rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>")
    p = parts.groupBy("pkg").agg(
        core("dc:title").alias("title"), core("dc:creator").alias("author"), F.coalesce(core("dc:language"), F.lit("ko-KR")).alias("language"), core("dcterms:created").try_cast("timestamp").alias("created"),
        core("dcterms:modified").try_cast("timestamp").alias("modified"), F.coalesce(of("docProps/app.xml", "<Application>(.*?)</Application>"), of("version.xml", r'\bapplication="([^"]*)"')).alias("application"),
        F.coalesce(of("version.xml", r'\bxmlVersion="([^"]*)"'), of("docProps/app.xml", "<AppVersion>(.*?)</AppVersion>")).alias("version"),
    )
    return p


def resolve_style_ids(rows: DataFrame, styles: DataFrame, defaults: dict, key: str = "id") -> DataFrame:
    """rows (pkg, key, ...) with the attributes of the style (pkg, key, attributes) that they name; defaults for an unknown id.

    Called once for each family of a header: character, paragraph, border and fill, font.
    """
    out = rows.join(styles.select("pkg", key, *defaults), ["pkg", key], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
