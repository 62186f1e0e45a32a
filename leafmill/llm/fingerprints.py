"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its five-word shingles (a shorter text is one term) with the number of times each occurs.
For each of the signature's slots a term has two gamma variates r and c and a uniform b, fixed by the term; its level is
t = floor(ln(weight) / r + b), its value ln c - r (t - b) - r, and the slot keeps the least value of all terms. Two texts
keep the same value with a probability equal to the generalised Jaccard similarity of their weights, so the part of
slots that agree estimates it.

The variates come from the whole 64-bit term and the slot by three hashes, read as exponential variates z, y and x:
c = z + y, q = ln(c / z), r = q + x and b = 1 - q / r have the distributions wanted. At weight 1 the level is 0 and the
value ln z, which grows with the first hash, so such terms need that hash alone.

Null texts are empty; an empty text has one fixed term of its own. Equal texts get equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, mix, partitions, table, word_hashes

SLOTS, SEED, WIDTH = 128, 20240229, 5


@lru_cache(maxsize=1)
def slot_keys() -> np.ndarray:
    """Three odd multipliers of 64 bits for each slot."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, (3, SLOTS), np.uint64) | np.uint64(1)


def hashes(terms: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each mixed term (rows) and slot (columns)."""
    h = terms[:, None] * keys
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def exponential(h: np.ndarray) -> np.ndarray:
    """The exponential variate that a hash stands for; it grows with the hash."""
    return -np.log1p(-((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52)


def weighted_terms(text: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    words = word_hashes(text)
    n = len(words)
    if not n:
        return np.zeros(1, np.uint64), np.ones(1, np.int64)
    width = min(width, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k])
    return np.unique(h, return_counts=True)


def signature(text: bytes) -> np.ndarray:
    """SLOTS 16-bit samples of a text: of the hash and level of each slot's least value."""
    terms, weight = weighted_terms(text)
    keys = slot_keys()
    one = weight == 1
    terms = mix(terms)
    singles, more, ln_w = terms[one], terms[~one], np.log(weight[~one].astype(np.float64))
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(singles), 256):
        np.minimum(least, hashes(singles[k : k + 256], keys[0]).min(0), out=least)
    best = np.log(exponential(least)) if len(singles) else np.full(SLOTS, np.inf)
    level = np.zeros(SLOTS, np.int64)
    for k in range(0, len(more), 256):
        h = hashes(more[k : k + 256], keys[0])
        z, y, x = exponential(h), *(exponential(hashes(more[k : k + 256], keys[i])) for i in (1, 2))
        q = np.log1p(y / z)
        r = q + x
        b = 1 - q / r
        t = np.floor(ln_w[k : k + 256, None] / r + b)
        value = np.log(z + y) - r * (t - b) - r
        at = value.argmin(0)[None]
        v, h, t = (np.take_along_axis(c, at, 0)[0] for c in (value, h, t))
        less = v < best
        best[less], least[less], level[less] = v[less], h[less], t[less].astype(np.int64)
    return (mix(least + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFF)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """run(rows) on each partition, where rows yields (doc_id, text, next document's text) by descending doc_id.

    Documents are dealt to ranges of ids; the last of a range also gets the first document of the range below, and the
    last of all the first of all. One shuffle moves each text once, but for one more document a range. Equal ids stand
    in the order of their texts; null ids come last.
    """
    spark = docs.sparkSession
    least = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("no_id"))
    parts = partitions(spark)
    cuts = sorted(set(rows.select(F.col("id").cast("double").alias("id")).stat.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []))
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col("id") >= F.lit(int(c))).cast("int")
    rows = rows.withColumn("bucket", bucket)
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("id").alias("top")).collect())  # one row a range
    if not tops:
        return spark.createDataFrame([], schema)
    # the top document of a range follows the last one of the range above; that of the highest follows the lowest
    above = {b: tops[(k + 1) % len(tops)][0] for k, (b, _) in enumerate(tops)}
    goes = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra")))
    is_top, to = F.lit(False), F.lit(-1)
    for b, top in tops:
        hit = (F.col("bucket") == b) & (F.col("id") == F.lit(top))
        is_top, to = is_top | hit, F.when(hit, above[b]).otherwise(to)
    goes = F.when(is_top, F.concat(goes, F.array(F.struct(to.alias("bucket"), F.lit(True).alias("extra"))))).otherwise(goes)
    dealt = (
        rows.withColumn("go", F.explode(goes))
        .select(F.col("go.bucket").alias("bucket"), F.col("go.extra").alias("extra"), "id", "no_id", "text")
        .repartition(max(parts, 1), "bucket")
        .sortWithinPartitions("bucket", "extra", F.desc("id"), "text")
    )

    def pairs(batches: Iterator[pa.RecordBatch]):
        last = None
        for b in in_slices(batches):
            for k, extra, i, none, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is not None and last[0] == k:
                    yield last[1], last[2], t
                last = None if extra else (k, None if none else i, t)

    return dealt.mapInArrow(lambda batches: run(pairs(batches)), schema)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of (doc_id, text)."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(rows) -> Iterator[pa.RecordBatch]:
        import hashlib

        cols: list[list] = [[] for _ in range(7)]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
            for c in cols:
                c.clear()
            return out

        last: tuple[str, np.ndarray] | None = None
        for doc, text, following in rows:
            own = last[1] if last and last[0] == text else signature(text.encode())
            last = (following, signature(following.encode()))
            new = edited(text, following)
            changed = signature(new.encode())
            row = (doc, len(text), hashlib.sha256(new.encode()).hexdigest(), own.tobytes().hex(), changed.tobytes().hex(), likeness(own, changed), likeness(own, last[1]))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
            if len(cols[0]) == 1000:
                yield batch()
        if cols[0]:
            yield batch()

    return with_next(docs, run, schema)


def op8_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
