"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Each row's whole text is encoded in a task of its own partition; nothing is shuffled. Long texts are cut at safe
boundaries first: before a single space with non-space characters on both sides. Every pre-tokenisation pattern of this
family ends a match there (no alternative spans from a non-space character over a space, and white-space runs need a
white-space character before it), so the ids of the pieces, joined, are the ids of the whole text.

Nulls count as empty texts and give no ids; rows, ties and other columns pass through unchanged.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices

#: Texts above so many characters are cut into pieces of about that length.
LONG = 100_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Pieces of about size characters, cut only at safe boundaries; longer where there is none."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df without its text column and with the array of token ids of each text."""
    kept = [f for f in df.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    names = [f.name for f in kept]

    def ids_of(enc, t: str | None) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *(np.array(enc.encode_ordinary(p), np.int32) for p in safe_pieces(t or ""))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in in_slices(batches):
            found = [ids_of(enc, t) for t in b.column(len(names)).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*names, ids])

    return df.select(*names, F.col(text)).mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the raw bytes that the ids stand for, whether or not they are valid UTF-8."""
    fields = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*fields, T.StructField(out, T.BinaryType(), False)])
    names = [f.name for f in fields]
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in in_slices(batches):
            texts = [enc.decode_bytes(x.values.tolist() if x.is_valid else []) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*names, out])

    return df.select(*names).mapInArrow(run, schema)


def op2_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: token count and digests of ids and decoded bytes."""
    import public_tokenizers

    from .common import table

    rank_file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(docs, rank_file, pattern), rank_file, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
