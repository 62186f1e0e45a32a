"""Structured Streaming twins of the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import doc_stats
from ..sources.tables import shared_path


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what is there now, into a table of its own, and read that table."""
    spark = stream.sparkSession
    at = shared_path(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def run_latest(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream over what is there now; the table holds the last state of every group."""
    spark = stream.sparkSession
    at = shared_path(spark, name)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def run_closed(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream over what is there now, with groups that the watermark has not closed yet; of each group the
    last state is kept by the number of its batch."""
    spark = stream.sparkSession
    at = shared_path(spark, name)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")  # a batch that runs again writes the same folder

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").drop("batch")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at a path, which may be one file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if not path.endswith(".parquet") else spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def stream_ingest(docs: DataFrame) -> DataFrame:
    """New documents to their statistics, without state."""
    return doc_stats(docs)


def stream_dedupe(resources: DataFrame, at: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first of each content hash. With an event time, state is kept for `delay` only, and a later copy is let in again."""
    hashed = resources.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    if at is None:
        return hashed.dropDuplicates(["sha256"]).select("sha256")
    return hashed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["sha256"]).select("sha256")


def stream_progress(lines: DataFrame) -> DataFrame:
    """Latest progress of each job from lines PROGRESS:<percent>:<message>, clamped to 0..100; others are left out."""
    pct, said = F.regexp_extract("line", r"^PROGRESS:(-?\d+):(.*)$", 1).try_cast("int"), F.regexp_extract("line", r"^PROGRESS:(-?\d+):(.*)$", 2)
    p = lines.filter(pct.isNotNull()).select("job", "at", F.greatest(F.lit(0), F.least(F.lit(100), pct)).alias("percent"), said.alias("message"))
    return p.groupBy("job").agg(F.max(F.struct("at", "percent", "message")).alias("m")).select("job", "m.percent", "m.message")


def stream_bursts(events: DataFrame, gap_seconds: float, delay: str) -> DataFrame:
    """(key, started, n): bursts of edits as a stream, with those of operators.layout.edit_bursts as its batch twin.

    events (key, ts, edit, run): edits less than a gap apart within one run, the number of the key's other actions so far,
    are one session; an action so closes a burst. An edit later than `delay` behind the newest is dropped, and a burst is
    given out once the watermark has passed its end.
    """
    e = events.filter("edit").withWatermark("ts", delay)
    within = round(gap_seconds * 1_000_000) - 1  # session windows that touch are one, edits a whole gap apart are not
    s = e.groupBy("key", "run", F.session_window("ts", f"{within} microseconds")).agg(F.count("*").alias("n"))
    return s.select("key", F.col("session_window.start").alias("started"), "n")


def undo_state(actions: DataFrame, depth: int = 100) -> DataFrame:
    """(key, undo, redo) depths after each key's actions (key, n, action) in order: push clears redo, depth is bounded."""
    ordered = actions.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "action"))).alias("a"))
    start = F.struct(F.lit(0).alias("undo"), F.lit(0).alias("redo"))

    def step(s, x):
        push, undo, redo = x["action"] == "push", (x["action"] == "undo") & (s["undo"] > 0), (x["action"] == "redo") & (s["redo"] > 0)
        return F.struct(
            F.when(push, F.least(s["undo"] + 1, F.lit(depth))).when(undo, s["undo"] - 1).when(redo, s["undo"] + 1).otherwise(s["undo"]).alias("undo"),
            F.when(push, 0).when(undo, s["redo"] + 1).when(redo, s["redo"] - 1).otherwise(s["redo"]).alias("redo"),
        )

    return ordered.select("key", F.aggregate("a", start, step).alias("s")).select("key", "s.undo", "s.redo")
