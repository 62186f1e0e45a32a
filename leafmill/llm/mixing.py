"""Mixing sources to target weights by capped water-filling, on built-in functions only.

1. A document's size is its number of words. Sources are ranked by code point (null last) and get the weights in turn.
2. Water-filling: the words of the mix are shared by weight. A source whose share is above `most` times its size is clamped
   there, and what it can't give is shared again among the others, until none is above. The level only rises, so what is
   clamped follows from the level, and a round is one aggregate over the table of sources; all tests are in whole numbers.
3. A source's target is so many whole repetitions of all its documents and a part of one more. For that part documents come
   in a seeded order, an MD5 hash of their id and size; they are taken whole until the words are reached, and the document at
   the edge gives its first words only. So a source's words are its target, rounded down.
4. The edge is found without sorting a source: sums by slices of the range of hashes, the slice with the edge cut again,
   until it holds a bounded number of rows, which are then added up one by one. Equal rows, however many, are told
   apart by a hash of their place, so that they are cut up in the same way; their results are the same whichever are taken.

Null and empty texts have size 0 and are never taken; a null source is a source. Ids may be null or repeat: rows of equal
id, size and source are alike, and reruns give the same rows. Columns called size, source_size, target or taken are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, table

#: Slices of a range of hashes, rows that are added up one by one at most, and sources whose table is sent to all tasks at most.
SLICES, EXACT, SMALL = 4096, 4096, 50_000
_WHOLE = "decimal(38,0)"


def words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _same(a, b) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ranked(sources: DataFrame, column: str) -> DataFrame:
    """sources with their rank (long, from 0) by code point, null last; ranges are stored once and ranked apart."""
    order = (F.col(column).isNull(), F.col(column))
    dealt = materialize(sources.repartitionByRange(partitions(sources.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    start = F.sum("_n").over(W.orderBy("_range")) - F.col("_n")
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", start.alias("_start"))  # a row a range
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_start") + place).drop("_range", "_start")


def water_filling(sources: DataFrame, share: tuple[int, int], most: int) -> DataFrame:
    """sources (source_size, weight) with target: share (a fraction) of all sizes by weight, at most `most` times the size."""
    num, den = share
    size, weight = F.col("source_size").cast("decimal(19,0)"), F.col("weight").cast("decimal(10,0)")
    above = F.lit(False)
    clamped = None
    while True:  # every round clamps a source at least
        got = sources.agg(
            F.sum("source_size").cast("string").alias("size"), F.sum(F.when(above, size)).cast("string").alias("full"), F.sum(F.when(~above, weight)).cast("string").alias("weight"),
            F.sum(F.when(above, 1).otherwise(0)).alias("n"),
        ).first()
        rest = num * int(got["size"] or 0) - den * most * int(got["full"] or 0)
        shared = den * int(got["weight"] or 0)
        if got["n"] == clamped or not shared:
            break
        clamped = got["n"]
        # weight * rest / shared > most * size, in whole numbers
        above = (weight * F.lit(rest).cast("decimal(20,0)")).cast(_WHOLE) > (size * F.lit(shared * most).cast("decimal(18,0)")).cast(_WHOLE)
    level = (weight * F.lit(rest).cast("decimal(20,0)")).cast("double") / F.lit(float(shared or 1))
    return sources.withColumn("target", F.when(above, (F.col("source_size") * most).cast("double")).otherwise(level))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size, the number of words of each text."""
    return docs.withColumn("size", words(text))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 13, key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs (key, source, size, ...) with source_size, target and taken, the words that the mix takes of each."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("source_size", "target", "taken")]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    hashed = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    # a place is given once and stored, so that a task that runs again finds the same
    rows = materialize(docs.select(*names, hashed.alias("_h"), F.monotonically_increasing_id().alias("_row")).withColumn("_g", F.abs(F.xxhash64("_row") % (1 << 60))).drop("_row"), "sized")
    sources = rows.groupBy(F.col(source).alias("_source")).agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    plan = water_filling(materialize(ranked(sources, "_source").withColumn("weight", turn), "sources"), share, most)
    whole = F.when(F.col("source_size") > 0, F.floor("target") - F.pmod(F.floor("target"), F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("_times", F.when(F.col("source_size") > 0, (whole / F.col("source_size")).cast("long")).otherwise(0)).withColumn("_left", F.floor("target") - whole)
    plan = materialize(plan.select("_source", "source_size", "target", "_times", "_left"), "targets")
    small = plan.count() <= SMALL

    def joined(part: DataFrame, facts: DataFrame) -> DataFrame:
        """Each row with the facts of its source; a large table of sources is joined, where adaptive execution splits hot ones."""
        return part.join(F.broadcast(facts) if small else facts, _same(source, "_source"), "left").drop("_source")

    front = _edges(rows, plan, joined, source)
    whole_words = F.col("_times") * F.col("size")
    told = joined(rows, plan.join(front, _same("_source", "_at"), "left").drop("_at"))
    place = _side("_h", "_g")
    sure = told.filter(place.isNull() | (place != 0)).withColumn("taken", whole_words + F.when(place < 0, F.col("size")).otherwise(0))
    # a bounded number of rows of each source
    behind = F.coalesce(F.sum("size").over(W.partitionBy(source).orderBy("_h", "_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = told.filter(place == 0).withColumn("taken", whole_words + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - behind)))
    out = [*names, "source_size", "target", "taken"]
    return sure.select(*out).unionByName(edge.select(*out))


def _side(h: str, g: str) -> Column:
    """-1, 0 or 1: a row before, inside or behind the range around its source's edge; null where nothing is to be cut."""
    one = F.when(F.col(g) < F.col("_g0"), -1).when(F.col(g) > F.col("_g1"), 1).otherwise(0)
    return F.when(F.col(h) < F.col("_h0"), -1).when(F.col(h) > F.col("_h1"), 1).when(F.col("_h0") < F.col("_h1"), 0).when(F.col("_h0").isNotNull(), one)


def _edges(rows: DataFrame, plan: DataFrame, joined, source: str) -> DataFrame:
    """(_at, _h0, _h1, _g0, _g1, _rest): for each source with words the range of hashes around the edge of its part."""
    top = F.lit((1 << 60) - 1)
    front = plan.filter("source_size > 0").select(F.col("_source").alias("_at"), F.lit(0).cast("long").alias("_h0"), top.alias("_h1"), F.lit(0).cast("long").alias("_g0"), top.alias("_g1"), F.col("_left").alias("_rest"))
    before = None
    while True:
        open_rows = joined(rows.select(source, "size", "_h", "_g"), front.withColumnRenamed("_at", "_source")).filter(_side("_h", "_g") == 0)
        wide = F.col("_h0") < F.col("_h1")
        low, high, at = (F.when(wide, F.col(h)).otherwise(F.col(g)) for h, g in (("_h0", "_g0"), ("_h1", "_g1"), ("_h", "_g")))
        slice_ = F.floor((at - low) / F.ceil((high - low + 1) / F.lit(SLICES)))
        sums = open_rows.groupBy(F.col(source).alias("_at"), slice_.alias("_slice")).agg(
            F.sum("size").alias("_size"), F.count("*").alias("_n"), F.first("_rest").alias("_rest"), *(f(f"_{c}").alias(f"_{c}{k}") for c in "hg" for k, f in enumerate((F.min, F.max)))
        )
        run = W.partitionBy("_at").orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)  # SLICES rows a source at most
        cut = sums.withColumn("_sum", F.sum("_size").over(run)).filter((F.col("_sum") > F.col("_rest")) & (F.col("_sum") - F.col("_size") <= F.col("_rest")))
        found = materialize(cut.select("_at", "_h0", "_h1", "_g0", "_g1", (F.col("_rest") - F.col("_sum") + F.col("_size")).alias("_rest"), "_n"), "edges")
        if before is not None:
            discard(before)
        before, front = found, found.drop("_n")
        still = F.col("_h0").eqNullSafe(F.col("_h1")) & F.col("_g0").eqNullSafe(F.col("_g1"))
        if not found.filter((F.col("_n") > EXACT) & ~still).limit(1).count():
            return front


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The texts of the mix: a row for each whole repetition, and one with the first words where only a part is taken.

    mixed has size, taken and the text; repetition counts from 0.
    """
    times = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    out = mixed.filter("taken > 0").withColumn("repetition", F.explode(F.sequence(F.lit(0), times - 1)))
    left = F.col("taken") - F.col("repetition") * F.col("size")
    words_of = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    part = F.array_join(F.slice(words_of, 1, F.greatest(left, F.lit(1)).cast("int")), "")
    return out.withColumn(text, F.when(left >= F.col("size"), F.col(text)).otherwise(part))


def op13_water_filling(spark, sf_dir: str) -> DataFrame:
    """The words that a mix of half as many words again takes of every document."""
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM docs GROUP BY source
), prefixes AS (  -- in the order in which a rising level clamps
  SELECT *, 3 * sum(source_size) OVER () - 4 * (sum(source_size) OVER o - source_size) AS rest, 2 * (sum(w) OVER () - sum(w) OVER o + w) AS shared,
         row_number() OVER o AS k
  FROM sources WINDOW o AS (ORDER BY source_size::DOUBLE / w, source ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT rest, shared, k FROM prefixes WHERE w * rest <= 2 * source_size * shared ORDER BY k LIMIT 1
), targets AS (
  SELECT p.source, p.source_size, CASE WHEN l.k IS NULL OR p.k < l.k THEN (2 * p.source_size)::DOUBLE ELSE (p.w * l.rest)::DOUBLE / l.shared::DOUBLE END AS target
  FROM prefixes p LEFT JOIN level l ON true
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS times,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END AS part
  FROM targets
), placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.times, p.part,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.r ROWS UNBOUNDED PRECEDING) - d.size AS behind
  FROM (SELECT *, ('0x' || left(md5('13:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 15))::BIGINT AS h FROM docs) d
  JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (times * size + greatest(0, least(size, part - behind)))::BIGINT AS taken FROM placed
"""
