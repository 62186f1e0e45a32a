"""Reading and writing corpora."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, total: int, each: int) -> DataFrame:
    """df dealt by a key to one task for each `each` of a total (rows or characters), so that no task grows with the input.

    A number of its own, because the planner would size tasks by the rows as they are now: what a row is taken apart into is many
    times larger.
    """
    return df.repartition(max(1, -(-total // each)), key)


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in spark.checkpoint.dir; only a session on one machine may leave that out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="leafmill-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: it is evaluated once, whatever reads it. With by, a
    folder for each value of that column, so that who filters by it reads no others."""
    at = shared_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def scan_corpus(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(doc_id, format, content) of a table of documents or pages, or of whole files (text or binary)."""
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.lit("txt").alias("format"), F.col("value").alias("content"))
    if kind == "binary":
        return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), extension(F.col("path")).alias("format"), "content")
    df = spark.read.parquet(path)
    if "html" in df.columns:
        return df.select(F.col("page_id").alias("doc_id"), F.lit("html").alias("format"), F.col("html").alias("content"))
    return df.select("doc_id", F.lit("txt").alias("format"), F.col("text").alias("content"))


def extension(path) -> F.Column:
    """Lower-case extension of a path or URL, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"[^/\\]\.([A-Za-z0-9]+)$", 1))


def write_rendered(df: DataFrame, path: str, fmt: str = "txt", per_document: bool = True, files: bool = False) -> None:
    """Write (doc_id, text) as UTF-8 with line feeds, in a folder per format; Spark's committer makes it atomic.

    A row for each document in Parquet; with files, a text file for each, in a folder named by its id (for few documents);
    without per_document, plain text files of all of them.
    """
    out = df.withColumn("format", F.lit(fmt))
    if files:
        rows = out.select("format", "doc_id", F.col("text").alias("value")).repartition("doc_id")
        rows.write.partitionBy("format", "doc_id").option("lineSep", "\n").text(path)
    elif per_document:
        out.select("doc_id", "format", "text").write.partitionBy("format").parquet(path)
    else:
        out.select("format", F.col("text").alias("value")).write.partitionBy("format").text(path)
