"""A cleaning pipeline over documents: toxicity, line dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Every stage takes and returns whole documents (doc_id, text, lang, source, n_chars) but the last, which returns the
places of all token pieces. Other columns are dropped by the first stage. Texts that a stage empties leave with it; texts
that were empty before stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import jaccard, line_dedup, packing, suffix_dedup, toxicity
from leafmill.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3


def _shortened(docs: DataFrame) -> DataFrame:
    """With n_chars counted again, without texts that have become empty."""
    left = F.length(F.coalesce("text", F.lit("")))
    return docs.filter((left > 0) | (F.coalesce("n_chars", F.lit(0)) == 0)).withColumn("n_chars", left.cast("long")).select(*COLUMNS)


def _documents(docs: DataFrame) -> DataFrame:
    """The documents' own columns, n_chars as it is in fact."""
    return docs.select("doc_id", "text", "lang", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC."""
    docs = _documents(docs)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_documents(docs, model, evidence=False).filter(F.col("score") < TOXIC).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more stay in the first of them only."""
    return _shortened(line_dedup.dedup_lines(_documents(docs), min_docs=10, keep="first"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near copies."""
    docs = _documents(docs)
    found = jaccard.classes(docs.select("doc_id", "text"))
    return docs.join(found.filter("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that start more than once."""
    return _shortened(suffix_dedup.without_repeats(_documents(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line-dedup", drop_lines),
    ("ngram-jaccard-join", drop_near_copies),
    ("suffix-array-dedup", drop_repeats),
    ("best-fit-packing", pack),
]

#: The stages use a trained scorer, a tokenizer and a packing heuristic, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
