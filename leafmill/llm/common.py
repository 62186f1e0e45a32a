"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and \t \n \v \f \r, which is what bytes.split() cuts at.
SPACE = " \t\n\x0b\x0c\r"


#: Bytes of rows that a task sends to Python at once, and rows that a Parquet reader holds at once, where the session leaves these open.
BATCH_BYTES, READ_ROWS = 2 << 20, 256


def bound_batches(spark: SparkSession) -> None:
    """Rows may hold whole texts, so batches for Python are bounded by bytes, not by rows alone, and the reader's are short."""
    for name, usual, value in (("spark.sql.execution.arrow.maxBytesPerBatch", "1b", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", "4096", READ_ROWS)):
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine may leave it out and gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "leafmill-checkpoints")
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/leafmill-{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).option("parquet.page.size.row.check.min", 4).parquet(path)  # rows may be large
    return spark.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame) -> None:
    """Delete the files of tables made by materialize() that no later step reads."""
    for df in stored:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        if len(folders) == 1 and (at := folders.pop()).rsplit("/", 1)[1].startswith("leafmill-"):
            jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(at))
            path.getFileSystem(hadoop).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def summed(df: DataFrame, arrays, shape: tuple[int, ...], dtype, slices: int = 16) -> np.ndarray:
    """The sum of the arrays of one shape that tasks make (or None); added up in Spark by slices, so that the driver gets
    one array in all, however many tasks there are."""
    size = int(np.prod(shape))
    edges = [size * k // slices for k in range(slices + 1)]

    def rows(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], names=["slice", "data"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = arrays(batches)
        if a is not None:
            flat = a.astype(dtype).reshape(-1)
            yield rows({k: flat[edges[k] : edges[k + 1]] for k in range(slices) if edges[k + 1] > edges[k]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = np.frombuffer(x, dtype)
                parts[k] = parts[k] + found if k in parts else found
        if parts:
            yield rows(parts)

    made = df.mapInArrow(make, "slice int, data binary").repartition(slices, "slice").mapInArrow(add, "slice int, data binary")
    total = np.zeros(size, dtype)
    for k, x in zip(*(c.to_pylist() for c in made.toArrow().columns), strict=True):  # a row for each slice
        total[edges[k] : edges[k + 1]] = np.frombuffer(x, dtype)
    return total.reshape(shape)


def most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """Words (word, c) of the highest counts, `most` at most: those from a count on, told by a histogram of bounded size."""
    bucket = F.floor(F.log2("c") * 8)
    left, least = most, None
    for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("b")).collect():  # some 500 rows at most
        left -= r["n"]
        if left < 0:
            break
        least = r["c"]
    return counts.filter(F.col("c") >= least if least is not None else F.lit(False)).toArrow()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return memory that a task has freed to the machine: workers stay for the next stage, beside a growing JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        return


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that what is made of them stays small in memory."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each lower-cased word of a text, in order."""
    import xxhash

    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(64)]


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text with fewer words is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):  # word hashes are spread already: one odd factor for each place, and one mix
        h += words[k : n - width + 1 + k] * _FACTORS[k]
    h = mix(h)
    return np.unique(h)


def is_blank(col) -> F.Column:
    return F.coalesce(col, F.lit(""))
