"""Corpus pipeline: toxicity, SimHash near-dedup, benchmark decontamination, PII, SentencePiece encoding and decoding.

Every stage decides row by row, so null and repeated doc_ids neither lose a row nor keep one; extra columns stay, also where an
operator uses a column of the same name; an empty table stays empty. Null and empty texts score as clean, are near copies of one
another (one of them stays), are never contaminated, stay as they are, and have no ids. Of equal rows the first numbered one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import decontaminate, pii, sentencepiece_wfst, simhash, toxicity
from paddock.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of ten consecutive words of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers, dates and addresses become pseudonyms of the same format."""
    return pii.rewrite(docs, pii.key_of(spark))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, their number, and whether the ids decode to the text."""
    model = sentencepiece_wfst.model_bytes()
    rows = sentencepiece_wfst.encode(docs, model, check="round_trip")
    return rows.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_pseudonyms", pseudonymise),
    ("sentencepiece_wfst", tokenise),
]

#: A trained classifier and transducers are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
