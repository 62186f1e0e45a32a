"""Line dedup with two Bloom filters, for lines seen once and lines seen twice.

A line's key is the line without white space at its ends, with A-Z in lower case. Pass 1 marks the hash of every key of
every document, once per document, in a filter of keys seen and a filter of keys seen again; tasks send the positions
that they set, slices of the filters are merged apart. Only the second filter is gathered; its size has a fixed upper
bound, and a fuller filter lets more keys through without changing the result. Pass 2 shuffles the keys that may repeat
and counts their documents exactly. The frequent keys go to all tasks when they are small by measure; otherwise they are
joined to the documents, where adaptive execution splits keys that very many documents have.

Null and empty texts are one empty line, whose empty key is never dropped. Every row counts as a document of its own,
also where ids repeat or are null. Columns called n_lines or n_dropped are replaced; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, in_slices, materialize, table, texts_of
from .filters import filter_bits, may_repeat, repeat_filter

_SPACE = SPACE.encode()
#: Frequent keys are sent to all tasks up to so many bytes.
SMALL_BYTES = 16 << 20


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(_SPACE).lower() for x in text.split(b"\n")]


def key_hash(key: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(key)


def document_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The hashes of each document's distinct keys."""
    for t in texts_of(batch):
        own = {k for k in line_keys(t) if k}
        yield np.fromiter(map(key_hash, own), np.uint64, len(own))


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep: str = "first", bits: int | None = None, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) with frequent lines dropped from text, and n_lines and n_dropped added.

    A line is frequent if its key, of at least one character, is in min_docs documents or more. keep="none" drops all
    of its lines; keep="first" leaves the first line in each row with the smallest doc_id that has it.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(repeat_filter(docs.select("text"), document_hashes, bits or filter_bits(docs.count() * 16)))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = sent.value
        for b in in_slices(batches):
            ids, keys = [], []
            for d, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                own = [k for k in set(line_keys(t)) if k]
                for k in np.flatnonzero(may_repeat(twice, np.fromiter(map(key_hash, own), np.uint64, len(own)))):
                    ids.append(d)
                    keys.append(own[k])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    found = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(suspects, "doc_id long, key binary"), "line-suspects")
    frequent = materialize(found.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter(F.col("n") >= min_docs).select("key", "first"), "lines")
    weight = frequent.agg(F.coalesce(F.sum(F.length("key") + 64), F.lit(0)).alias("b")).first()["b"]
    if weight <= small_bytes:
        return _rebuild(docs, {bytes(r["key"]): r["first"] for r in frequent.collect()}, keep)
    own = found.join(frequent, "key").groupBy("doc_id").agg(F.collect_set(F.struct("key", "first")).alias("_frequent"))
    joined = docs.join(own.withColumnRenamed("doc_id", "_doc"), docs["doc_id"].cast("long").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    return _rebuild(joined, None, keep)


def _rebuild(docs: DataFrame, frequent: dict | None, keep: str) -> DataFrame:
    fields = [f for f in docs.schema.fields if f.name not in ("_frequent", "n_lines", "n_dropped")]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    docs = docs.select(*names, *(["_frequent"] if frequent is None else []))
    ids, at = names.index("doc_id"), names.index("text")
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_all = known.value
        for b in in_slices(batches):
            own = b.column(len(names)).to_pylist() if drop_all is None else None
            texts, n_lines, n_dropped = [], [], []
            for i, (d, t) in enumerate(zip(b.column(ids).to_pylist(), texts_of(b), strict=True)):
                drop = drop_all if own is None else {bytes(x["key"]): x["first"] for x in own[i] or []}
                lines, kept, stays = t.split(b"\n"), [], set()
                for line, k in zip(lines, line_keys(t), strict=True):
                    if k not in drop:
                        kept.append(line)
                    elif keep == "first" and drop[k] == d and k not in stays:
                        stays.add(k)
                        kept.append(line)
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return docs.mapInArrow(run, schema)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10, keep="none")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), lines AS (
  SELECT r, doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM rows))
), frequent AS (
  SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (k)
GROUP BY r, doc_id
"""
