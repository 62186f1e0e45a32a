"""Queries over documents, pages and files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import text as X
from ..sources import admission as A
from ..sources.tables import dealt, extension, read_table, scan_corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def docs(spark, d):
    return read_table(spark, d, "documents")


def paragraphs(spark, d):
    return X.txt_paragraphs(docs(spark, d))


#: Characters of text that one task makes into markup and takes apart again.
TEXT_EACH = 1_500_000


def dealt_paragraphs(spark, d):
    """paragraphs dealt by document, whole texts before they are cut: what follows goes on by document without another shuffle."""
    t = docs(spark, d).select("doc_id", "text")
    return X.txt_paragraphs(dealt(t, "doc_id", t.agg(F.sum(F.length("text"))).first()[0] or 0, TEXT_EACH))


#: Paragraphs in SQL: lines without an empty last one.
LINES = """lines AS (
  SELECT doc_id, i - 1 AS pos, regexp_replace(parts[i], '\\r$', '') AS text
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
  WHERE NOT (i = len(parts) AND parts[i] = '')
)"""


@query("SELECT doc_id, 'txt' AS format, text AS content FROM documents UNION ALL SELECT page_id, 'html', html FROM pages")
def s1_scan_corpus(spark, d):
    return scan_corpus(spark, f"{d}/documents.parquet").unionByName(scan_corpus(spark, f"{d}/pages.parquet"))


EXT = "lower(regexp_extract(regexp_replace({}, '[?#].*$', ''), '[^/\\\\]\\.([A-Za-z0-9]+)$', 1))"


@query(f"""
WITH f AS (SELECT {EXT.format("url")} AS ext FROM pages
           UNION ALL SELECT {EXT.format("'doc' || doc_id || '.' || ['txt', 'MD', 'docx', 'html', 'zip'][doc_id % 5 + 1]")} FROM documents)
SELECT ext, CASE WHEN ext IN ('iwpf', 'md', 'markdown', 'txt') THEN 'native'
                 WHEN ext IN ('html', 'htm', 'xml', 'xhtml', 'docx', 'hwpx', 'hwp', 'doc') THEN 'external' ELSE 'unsupported' END AS route,
       count(*) AS n
FROM f GROUP BY ext, route""")
def s2_format_route(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("txt", "MD", "docx", "html", "zip"))), (F.col("doc_id") % 5 + 1).cast("int"))
    named = docs(spark, d).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), kinds).alias("path"))
    return A.route_counts(named.unionByName(read_table(spark, d, "pages").select(F.col("url").alias("path"))))


@query("SELECT doc_id, doc_id % 3 = 0 AND octet_length(encode(coalesce(text, ''))) < 19 * 30 AS rejected FROM documents")
def s3_binary_reject(spark, d):
    """Every third document gets 30 NUL bytes in front, which are over a twentieth of short ones."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.repeat(F.lit("00"), 30)), F.substring(body, 1, 1 << 30))).otherwise(body)
    return A.binary_reject(docs(spark, d).select("doc_id", content.alias("content"))).select("doc_id", "rejected")


@query("""
SELECT page_id, 'utf-8' AS encoding, length(html) AS n_chars FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'utf-8-bom', length(html) FROM pages WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 'utf-16le-bom', length(html) FROM pages WHERE page_id % 3 = 2""")
def s4_detect_encoding(spark, d):
    """Pages as bytes: plain with a charset in the head, with a UTF-8 mark, and as marked UTF-16."""
    k = F.col("page_id") % 3
    content = F.when(k == 0, F.encode("html", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE")))
    out = A.detect_encoding(read_table(spark, d, "pages").select("page_id", content.alias("content")))
    return out.select("page_id", "encoding", F.length("text").cast("long").alias("n_chars"))


def parts(spark, d):
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs(spark, d).select(F.col("source").alias("pkg"), path.alias("path"), F.lit("text/plain").alias("media_type"), F.coalesce("text", F.lit("")).alias("content"))


@query("""SELECT source AS pkg, 'doc/' || doc_id || '.txt' AS path, 'text/plain' AS media_type,
       octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def s9_build_manifest(spark, d):
    return A.build_manifest(parts(spark, d))


@query("""SELECT source AS pkg, 'doc/' || doc_id || '.txt' AS path,
       CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'tampered' ELSE 'ok' END AS status FROM documents""")
def s10_verify_manifest(spark, d):
    """The manifest against parts of which some are gone and some have a byte more."""
    p = parts(spark, d).withColumn("k", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    changed = p.filter(F.col("k") % 7 != 0).withColumn("content", F.when(F.col("k") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).drop("k")
    return A.verify_manifest(changed, A.build_manifest(p.drop("k")))


@query("SELECT doc_id, 'ok' AS status, sha256(coalesce(text, '')) AS sha256 FROM documents")
def s11_seal_parts(spark, d):
    key = bytes(range(32))
    p = docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return A.unseal_parts(A.seal_parts(p, key), key).select("doc_id", "status", F.sha2("content", 256).alias("sha256"))


@query("""
WITH wanted AS (SELECT doc_id AS id, source AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
existing AS (SELECT DISTINCT source AS name, 0 AS k FROM documents WHERE source <> 'src3'
             UNION SELECT DISTINCT source, (doc_id % 17)::INT FROM documents WHERE doc_id % 6 = 1 AND doc_id % 17 > 0),
numbers AS (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY k) AS r
            FROM (SELECT n.name, c.k FROM (SELECT DISTINCT name FROM wanted) n CROSS JOIN (SELECT unnest(range(0, 1 + (SELECT count(*) FROM documents))) AS k) c
                  ANTI JOIN existing e ON e.name = n.name AND e.k = c.k))
SELECT id, wanted.name || CASE WHEN k > 0 THEN '-' || k ELSE '' END || '.txt' AS target
FROM wanted JOIN numbers ON wanted.name = numbers.name AND wanted.r = numbers.r""")
def s13_safe_output_names(spark, d):
    """A name per source, of which plain ones and some numbers are taken."""
    wanted = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.lit("txt").alias("ext"))
    plain = docs(spark, d).filter("source <> 'src3'").select(F.col("source").alias("name"), F.lit("txt").alias("ext"))
    numbered = docs(spark, d).filter("doc_id % 6 = 1 AND doc_id % 17 > 0").select(F.concat("source", F.lit("-"), (F.col("doc_id") % 17).cast("string")).alias("name"), F.lit("txt").alias("ext"))
    return A.safe_output_names(wanted, plain.unionByName(numbered).distinct())


@query(f"WITH {LINES} SELECT doc_id, pos::INT AS pos, text FROM lines")
def p1_txt_paragraphs(spark, d):
    return paragraphs(spark, d)


@query("""
SELECT page_id AS doc_id, 'html' AS route FROM pages
UNION ALL SELECT doc_id, CASE WHEN lower(text[:2048]) LIKE '%<p>%' OR lower(text[:2048]) LIKE '%<div%' OR lower(text[:2048]) LIKE '%<html%' OR lower(text[:2048]) LIKE '%<a href%' THEN 'html' ELSE 'xml' END FROM documents""")
def p15_sniff_xhtml(spark, d):
    pages = read_table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))
    return A.sniff_xhtml(pages.unionByName(docs(spark, d).select("doc_id", F.col("text").alias("content")))).select("doc_id", "route")


@query("""
SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g') AS text FROM pages""")
def p9_entity_decode(spark, d):
    return read_table(spark, d, "pages").select("page_id", E.decode_entities(F.col("html")).alias("text"))


@query(f"""WITH {LINES}, capped AS (SELECT doc_id, pos, text, false AS warning FROM lines WHERE pos < 5
  UNION ALL SELECT doc_id, 5, '[' || 5 || ' of ' || count(*) || ' blocks]', true FROM lines GROUP BY doc_id HAVING count(*) > 5)
SELECT doc_id, pos::INT AS pos, text, warning FROM capped""")
def p20_cap_blocks(spark, d):
    return cap_blocks(paragraphs(spark, d), 5)


def cap_blocks(blocks, most: int = 10_000):
    """The first blocks of each document, and a warning block where more were cut; no cap for 0 or less."""
    kept = blocks.withColumn("warning", F.lit(False))
    if most <= 0:
        return kept
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    counts = blocks.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    text = F.concat(F.lit(f"[{most} of "), F.col("n").cast("string"), F.lit(" blocks]"))
    warned = counts.select("doc_id", F.lit(most).alias("pos"), text.alias("text"), F.lit(True).alias("warning"))
    return kept.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n").unionByName(warned)


@query(f"WITH {LINES} SELECT doc_id, pos::INT AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines")
def f1_enumerate_paragraphs(spark, d):
    p = paragraphs(spark, d).withColumn("kind", F.lit("paragraph")).withColumn("depth", F.lit(0))
    return X.enumerate_paragraphs(p).select("doc_id", "pos", F.col("n").cast("long").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 23 THEN 1 WHEN p_size >= 19 THEN 2 WHEN p_size >= 16 THEN 3 WHEN p_size >= 14 THEN 4
       WHEN p_size >= 12.5 THEN 5 WHEN p_size >= 11.5 THEN 6 ELSE 0 END::INT AS level FROM part""")
def f3_infer_heading(spark, d):
    return read_table(spark, d, "part").select("p_partkey", E.infer_heading(F.col("p_size")).alias("level"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN y > 297 THEN floor(y / 297)::INT ELSE 0 END AS page, round(CASE WHEN y > 297 THEN y - 297 * floor(y / 297) ELSE y END, 6) AS y
FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE * 20 AS y FROM lineitem)""")
def f5_migrate_overlay_anchor(spark, d):
    items = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).alias("page"), (F.col("l_quantity").cast("double") * 20).alias("y"))
    return migrate_overlay_anchor(items, 297.0)


def migrate_overlay_anchor(blocks, height: float):
    """page and y of objects on page 0 that lie below it, by pages of a height; idempotent."""
    moved = (F.col("page") == 0) & (F.col("y") > height)
    page = F.when(moved, F.floor(F.col("y") / height).cast("int")).otherwise(F.col("page"))
    y = F.when(moved, F.col("y") - height * F.floor(F.col("y") / height)).otherwise(F.col("y"))
    return blocks.withColumns({"page": page, "y": F.round(y, 6)})


@query("""SELECT page_id, regexp_matches(lower(url), '^data:') OR regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]+:') AS external,
       false AS link_external FROM pages""")
def f6_is_external_ref(spark, d):
    p = read_table(spark, d, "pages")
    link = F.regexp_extract("html", r'href="([^"]*)"', 1)
    return p.select("page_id", E.is_external_ref(F.col("url")).alias("external"), E.is_external_ref(link).alias("link_external"))


@query(f"""WITH {LINES}, parts AS (SELECT doc_id, pos, string_split(text, 'th') AS p FROM lines WHERE contains(text, 'th')),
sized AS (SELECT doc_id, pos, p, unnest(range(1, len(p))) AS k FROM parts)
SELECT doc_id, pos::INT AS pos, (k - 1)::INT AS hit, (list_sum(list_transform(p[1:k], lambda x: length(x))) + 2 * (k - 1))::INT AS off FROM sized""")
def q1_find_all(spark, d):
    return X.find_all(paragraphs(spark, d), "th")


@query(f"""WITH {LINES}, parts AS (SELECT doc_id, pos, string_split(lower(text), 'the ') AS p FROM lines WHERE contains(lower(text), 'the ')),
sized AS (SELECT doc_id, pos, p, unnest(range(1, len(p))) AS k FROM parts),
hits AS (SELECT doc_id, pos::INT AS pos, (list_sum(list_transform(p[1:k], lambda x: length(x))) + 4 * (k - 1))::INT AS off FROM sized),
ranked AS (SELECT *, NOT (pos > 1 OR pos = 1 AND off >= 10) AS wrapped,
           row_number() OVER (PARTITION BY doc_id ORDER BY NOT (pos > 1 OR pos = 1 AND off >= 10), pos, off) AS r FROM hits)
SELECT doc_id, pos, off, wrapped FROM ranked WHERE r = 1""")
def q2_find_next(spark, d):
    return X.find_next(X.find_all(paragraphs(spark, d), "The ", case_sensitive=False), 1, 10)


@query("""SELECT doc_id, (len(string_split(coalesce(text, ''), 'the')) - 1)::INT AS n_replaced, sha256(replace(coalesce(text, ''), 'the', 'T$E')) AS sha256 FROM documents""")
def q3_replace_all(spark, d):
    out = X.replace_all(docs(spark, d), "the", "T$E")
    return out.select("doc_id", "n_replaced", F.sha2("text", 256).alias("sha256"))


STATS = """SELECT doc_id, source, lang, length(replace(flat, ' ', '')) AS chars, length(flat) AS chars_with_spaces,
  len(list_filter(regexp_split_to_array(t, '[ \\t\\r\\n]'), lambda w: w <> '')) AS words, len(string_split(t, chr(10))) AS lines,
  len(string_split(t, chr(10))) - CASE WHEN t = '' OR t[-1:] = chr(10) THEN 1 ELSE 0 END AS paragraphs
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\r\\n]', '', 'g') AS flat FROM documents)"""


@query(STATS)
def a1_doc_stats(spark, d):
    return X.doc_stats(docs(spark, d))


@query(f"""SELECT source, lang, grouping_id(source, lang)::INT AS level, count(*) AS docs, sum(chars)::BIGINT AS chars, sum(chars_with_spaces)::BIGINT AS chars_with_spaces,
  sum(words)::BIGINT AS words, sum(lines)::BIGINT AS lines, sum(paragraphs)::BIGINT AS paragraphs FROM ({STATS}) GROUP BY ROLLUP (source, lang)""")
def a2_corpus_stats(spark, d):
    return X.corpus_stats(docs(spark, d))


@query(f"""WITH {LINES}, b AS (SELECT doc_id, sum(160 + 2 * length(text))::BIGINT AS bytes FROM lines GROUP BY doc_id)
SELECT doc_id, bytes, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KB', round(bytes / 1024.0, 1)) ELSE printf('%.1f MB', round(bytes / 1048576.0, 1)) END AS label FROM b""")
def a3_estimate_bytes(spark, d):
    return X.estimate_bytes(paragraphs(spark, d))


@query(f"""WITH {LINES} SELECT doc_id, nullif(array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]'), lambda w: w <> '')[1:6], ' '), '') AS title FROM lines WHERE pos = 0""")
def a4_infer_title(spark, d):
    return X.infer_title(paragraphs(spark, d))


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents),
f AS (SELECT sha256, min(doc_id) AS first, max(size) * (count(*) - 1) AS saved, count(*) AS copies FROM h GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY first) AS number FROM f)
SELECT doc_id, sha256, copies, saved, number, printf('resources/images/img-%04d', number) || ['.png', '.jpg', '.svg', '.bin'][first % 4 + 1] AS path FROM h JOIN n USING (sha256)""")
def a6_dedupe_resources(spark, d):
    media = F.element_at(F.array(*map(F.lit, ("image/png", "image/jpeg", "image/svg+xml", "image/x-other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    r = docs(spark, d).select(F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("content"), media.alias("media_type"))
    return X.dedupe_resources(r).select(F.col("pos").alias("doc_id"), "sha256", "copies", "saved", F.col("number").cast("long").alias("number"), "path")


@query(f"WITH {LINES} SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY pos)) AS sha256 FROM lines GROUP BY doc_id")
def r1_to_plain_text(spark, d):
    return X.to_plain_text(paragraphs(spark, d)).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(f"WITH {LINES} SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY pos) || chr(10)) AS sha256 FROM lines GROUP BY doc_id")
def r5_preview_text(spark, d):
    return X.preview_text(paragraphs(spark, d)).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT 0::BIGINT AS differing, count(*) AS docs FROM documents")
def r6_roundtrip_check(spark, d):
    """Documents parsed, rendered and parsed again; blocks that differ."""
    first = paragraphs(spark, d)
    again = X.txt_paragraphs(X.to_plain_text(first))
    left = first.exceptAll(again).unionAll(again.exceptAll(first)).agg(F.count("*").alias("differing"))
    return left.crossJoin(docs(spark, d).agg(F.count("*").alias("docs")))


@query("""SELECT doc_id, (k - 1)::INT AS frag, substr(t, (k - 1) * 500 + 1, 500) AS text
FROM (SELECT doc_id, coalesce(text, '') AS t, unnest(range(1, greatest(1, ceil(length(coalesce(text, '')) / 500.0)::BIGINT) + 1)) AS k FROM documents)""")
def w8_split_fragments(spark, d):
    return X.split_fragments(docs(spark, d), 500)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def w9_merge_fragments(spark, d):
    return X.merge_fragments(X.split_fragments(docs(spark, d), 500)).select("doc_id", F.sha2("text", 256).alias("sha256"))


def styled(spark, d):
    """Paragraphs with ids (every fourth without), markers and spaces."""
    p = paragraphs(spark, d).select("doc_id", F.col("pos").cast("int").alias("pos"), "text")
    return p.select("doc_id", "pos", F.when(F.col("pos") % 4 > 0, F.concat(F.lit("n"), F.col("pos").cast("string"))).alias("node_id"), "text", F.when(F.col("pos") % 3 == 0, "bullet").alias("marker"), F.lit(6.0).alias("before"), F.lit(4.0).alias("after"))


def cut(spark, d):
    p = styled(spark, d)
    return X.split_at(p, p.select("doc_id", "pos", F.explode(F.array(F.lit(40), F.lit(90))).alias("at")))


@query(f"""WITH {LINES}, p AS (SELECT *, 1 + (length(text) > 40)::INT + (length(text) > 90)::INT AS n, CASE WHEN pos % 4 > 0 THEN 'n' || pos END AS id FROM lines), f AS (SELECT *, unnest(range(0, n))::INT AS frag FROM p)
SELECT doc_id, pos::INT AS pos, frag, CASE WHEN n > 1 THEN coalesce(id, '§g' || pos) || '§f' || frag ELSE id END AS node_id, substr(text, [1, 41, 91][frag + 1], [40, 50, 1000000000][frag + 1]) AS text,
  CASE WHEN frag = 0 AND pos % 3 = 0 THEN 'bullet' END AS marker, CASE WHEN frag = 0 THEN 6 ELSE 0 END::DOUBLE AS before, CASE WHEN frag = n - 1 THEN 4 ELSE 0 END::DOUBLE AS after FROM f""")
def w8_split_at_offsets(spark, d):
    return cut(spark, d)


@query(f"""WITH {LINES} SELECT doc_id, pos::BIGINT * 10 AS ord, CASE WHEN pos % 4 > 0 THEN 'n' || pos END AS node_id, text, CASE WHEN pos % 3 = 0 THEN 'bullet' END AS marker, 6.0::DOUBLE AS before, 4.0::DOUBLE AS after FROM lines""")
def w9_merge_by_ids(spark, d):
    f = cut(spark, d)
    return X.merge_by_ids(f.withColumn("ord", F.col("pos").cast("long") * 10 + F.col("frag")))


@query(f"""WITH {LINES} SELECT doc_id, pos::INT AS pos, CASE WHEN doc_id % 5 = 0 THEN 'removed' WHEN contains(text, 'the') THEN 'modified' ELSE 'clean' END AS status FROM lines
UNION ALL SELECT -1, 0, 'added'""")
def j10_diff_versions(spark, d):
    old = paragraphs(spark, d)
    new = X.txt_paragraphs(X.replace_all(docs(spark, d).filter("doc_id % 5 <> 0"), "the", "T")).select("doc_id", "pos", "text")
    return X.diff_versions(old, new.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(0).alias("pos"), F.lit("new").alias("text"))))


@query(f"""WITH {LINES}, b AS (SELECT doc_id, pos, text, replace(text, 'the', 'T') AS t FROM lines)
SELECT (SELECT count(*) FROM b WHERE text <> t) AS removed, (SELECT count(*) FROM b WHERE text = t) AS kept, (SELECT count(*) FROM b WHERE text <> t) AS added""")
def o5_blocks_set_operations(spark, d):
    old = paragraphs(spark, d)
    new = old.withColumn("text", F.replace("text", F.lit("the"), F.lit("T")))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(old.exceptAll(new), "removed").crossJoin(n(old.intersectAll(new), "kept")).crossJoin(n(new.exceptAll(old), "added"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations")
def o1_document_order(spark, d):
    c = read_table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("n"))


@query("SELECT source, doc_id, n_chars, r FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 8")
def o2_top_k_per_group(spark, d):
    r = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return docs(spark, d).withColumn("r", r.cast("long")).filter("r <= 8").select("source", "doc_id", "n_chars", "r")


@query("SELECT DISTINCT lower(n_name) AS name FROM nation ORDER BY 1 LIMIT 10")
def o3_sorted_names(spark, d):
    return read_table(spark, d, "nation").select(F.lower("n_name").alias("name")).distinct().orderBy("name").limit(10)


@query(f"""WITH {LINES}, u AS (SELECT doc_id, pos, 0 AS part, text FROM lines UNION ALL SELECT doc_id, pos, 1, text FROM lines WHERE pos < 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) - 1 AS pos, text FROM u""")
def o4_union_blocks(spark, d):
    """Each document with its first two blocks pasted at its end, numbered anew."""
    p = paragraphs(spark, d)
    u = p.withColumn("part", F.lit(0)).unionByName(p.filter("pos < 2").withColumn("part", F.lit(1)))
    return u.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("part", "pos")) - 1).cast("long").alias("pos"), "text")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def o6_distinct_styles(spark, d):
    return read_table(spark, d, "part").select("p_brand", "p_type").distinct()


MM = "l_extendedprice::DOUBLE / 100"


@query(f"""SELECT l_orderkey, l_linenumber, round_even({MM} * 36000, 0)::BIGINT AS emu, round_even({MM} * (1440.0::DOUBLE / 25.4::DOUBLE), 0)::BIGINT AS twips,
  round_even({MM} * (7200.0::DOUBLE / 25.4::DOUBLE), 0)::BIGINT AS hwpunits, round(l_quantity::DOUBLE * 25.4 / 96.0, 6) AS px_mm, round(l_quantity::DOUBLE * 96.0 / 72.0, 6) AS dip FROM lineitem""")
def l1_units(spark, d):
    mm = F.col("l_extendedprice").cast("double") / 100
    q = F.col("l_quantity").cast("double")
    return read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", E.mm_to_emu(mm).alias("emu"), E.mm_to_twips(mm).alias("twips"), E.mm_to_hwpunit(mm).alias("hwpunits"), F.round(E.px_to_mm(q), 6).alias("px_mm"), F.round(E.pt_to_dip(q), 6).alias("dip")
    )


@query("""SELECT p_partkey, printf('#%02X%02X%02X', r, g, b) || CASE WHEN a = 255 THEN '' ELSE printf('%02X', a) END AS code, r, g, b, a
FROM (SELECT p_partkey, (p_partkey % 256)::INT AS r, (p_partkey * 7 % 256)::INT AS g, (p_size * 5 % 256)::INT AS b, CASE WHEN p_partkey % 3 = 0 THEN 255 ELSE (p_partkey % 255)::INT END AS a FROM part)""")
def l2_colours(spark, d):
    r, g = (F.col("p_partkey") % 256).cast("int"), (F.col("p_partkey") * 7 % 256).cast("int")
    b, a = (F.col("p_size") * 5 % 256).cast("int"), F.when(F.col("p_partkey") % 3 == 0, 255).otherwise((F.col("p_partkey") % 255).cast("int"))
    out = read_table(spark, d, "part").select("p_partkey", E.rgba_to_hex(r, g, b, a).alias("code"))
    return out.withColumn("c", E.hex_to_rgba(F.col("code"))).select("p_partkey", "code", "c.r", "c.g", "c.b", "c.a")


@query("""SELECT doc_id, '- ' || (doc_id % 50) || ' / 50 - {X} {' || lang || '} ' || coalesce(source, '') AS text FROM documents""")
def l3_tokens(spark, d):
    t = F.concat(F.lit("- {page} / {  NumPages } - {X} \\{"), F.col("lang"), F.lit("\\} {제목}"))
    return docs(spark, d).select("doc_id", E.resolve_tokens(t, page=F.col("doc_id") % 50, pages=F.lit(50), title=F.col("source")).alias("text"))


@query("""SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '([\\\\`*_\\[\\]<>#~|^])', '\\\\\\1', 'g')) AS md,
  sha256(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html,
  sha256(replace(replace(coalesce(text, ''), chr(10), '<br>'), '|', '\\|')) AS cell FROM documents""")
def l5_escapes(spark, d):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, d).select("doc_id", F.sha2(E.escape_markdown(t), 256).alias("md"), F.sha2(E.escape_html(t), 256).alias("html"), F.sha2(E.escape_cell(t), 256).alias("cell"))


@query("""WITH n AS (SELECT p_partkey, (p_partkey % 19 + 1)::INT AS n FROM part)
SELECT p_partkey, chr(96 + n) AS alpha, chr(44032 + (n - 1) * 588) AS hangul,
  ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX'][n] AS roman FROM n""")
def l6_number_styles(spark, d):
    n = (F.col("p_partkey") % 19 + 1).cast("int")
    return read_table(spark, d, "part").select("p_partkey", E.number_text(n, "alpha_lower").alias("alpha"), E.number_text(n, "hangul").alias("hangul"), E.number_text(n, "roman_upper").alias("roman"))


@query("""SELECT doc_id, CASE e WHEN 'png' THEN 'image/png' WHEN 'JPEG' THEN 'image/jpeg' WHEN 'tif' THEN 'image/tiff' ELSE 'application/octet-stream' END AS media,
  CASE e WHEN 'png' THEN '.png' WHEN 'JPEG' THEN '.jpg' WHEN 'tif' THEN '.tif' ELSE '.bin' END AS ext FROM (SELECT doc_id, ['png', 'JPEG', 'tif', 'zip'][doc_id % 4 + 1] AS e FROM documents)""")
def l7_media_types(spark, d):
    e = F.element_at(F.array(*map(F.lit, ("png", "JPEG", "tif", "zip"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).select("doc_id", E.media_type(e).alias("media")).withColumn("ext", E.media_extension(F.col("media")))


@query("""SELECT event_id, json_keys(props)[1] AS first_key, len(json_keys(props))::INT AS n_keys, 'x' AS added FROM events""")
def l8_maps_and_json(spark, d):
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("_added"), F.lit("x")))
    e = read_table(spark, d, "events").select("event_id", "props", m.alias("m"))
    return e.select("event_id", F.element_at(F.json_object_keys("props"), 1).alias("first_key"), (F.size("m") - 1).alias("n_keys"), F.element_at("m", "_added").alias("added"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n]'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, array_to_string(w[1:3], '|') AS first_three, len(list_filter(w, lambda x: contains(x, 'th'))) > 0 AS any_th, len(list_filter(w, lambda x: length(x) < 30)) = len(w) AS all_short FROM w""")
def l9_arrays(spark, d):
    w = docs(spark, d).select("doc_id", X.words(F.coalesce("text", F.lit(""))).alias("w"))
    return w.select("doc_id", F.array_join(F.slice("w", 1, 3), "|").alias("first_three"), F.exists("w", lambda x: x.contains("th")).alias("any_th"), F.forall("w", lambda x: F.length(x) < 30).alias("all_short"))
