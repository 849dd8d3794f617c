"""From raw documents to packed training sequences: five stages, each an operator of ``wakeframe.llm``.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again before the next
one. All but the last return the columns of ``documents``. Stages see whatever their predecessors kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeframe.llm import lines, minhash, phrase_index, quality, queries
from wakeframe.llm.stored import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept; the rules learn from the labels that are not held out."""
    labels = queries.table(spark, sf_dir, "labels").filter(~queries.held_out())
    scored = quality.score(docs, quality.train(docs, labels), name="_score")
    return scored.filter(F.col("_score") >= queries.KEEP_SCORE).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; one of which nothing is left goes."""
    cleaned = lines.drop_boilerplate(docs)
    left = F.btrim(F.col("text"), F.lit(" \t\r\n")) != ""
    kept = cleaned.filter((F.col("n_removed") == 0) | left)
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", size).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Documents without an id stay."""
    gone = minhash.near_groups(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def clear_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word phrase of the benchmark. Documents without an id share one fate."""
    found = phrase_index.contamination(docs, queries.table(spark, sf_dir, "benchmark"))
    gone = found.filter("contaminated").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the remaining documents goes in sequences of 2048 tokens."""
    return queries.packed(docs)


STAGES = [
    ("quality", good_quality),
    ("lines", without_boilerplate),
    ("near copies", one_of_each),
    ("benchmark", clear_of_benchmark),
    ("packing", packed),
]

# The tokenizer and the learnt rules are beyond SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {}
