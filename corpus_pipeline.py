"""From raw documents to token ids, in stages that hand on Parquet.

Every stage takes what its predecessor kept, decides over all of it, and returns the columns of ``documents``; the last
returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbmark.llm import bpe, decontam, nearcopies, secrets, toxicity
from ebbmark.llm.common import id_remainder, prepared, table
from ebbmark.session import stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken for toxic go. One row in five is kept out of the fit."""
    prepared(spark)
    model = toxicity.fit(docs.where(id_remainder(docs["doc_id"], 5) != 0), table(spark, sf_dir, "labels"), corpus=docs)
    return toxicity.without_toxic(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays, that with the least id."""
    prepared(spark)
    return nearcopies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    prepared(spark)
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are masked; all documents stay."""
    prepared(spark)
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids``."""
    prepared(spark)
    coded = bpe.encode(docs, bpe.default_path(), doc_id=F.col("doc_id"), lang=F.col("lang"), source=F.col("source"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("encoding", encoding_stage),
]

#: Fingerprints, the toxicity model and token ids have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
