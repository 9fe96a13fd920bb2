"""A corpus in five stages: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece encoding.

Each stage takes the documents that its predecessor kept and returns documents with all their columns; the last one returns what
it encoded. run() writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, host_rules, line_index, nbest_pieces, ngram_join
from sparkloom.llm.common import load, stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rules or whose host is rejected. A null or empty text fails; a null source is a host of
    its own; repeated rows are judged alike and count each; an empty table stays empty."""
    return host_rules.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that ten documents or more hold; n_chars is the length of what is left. Every row stays, in the end perhaps with
    an empty text; a null text stays null; repeated rows are documents of their own."""
    out = line_index.LineIndex.build(docs).rewrite(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the least doc_id (null is the least; of equal ones any row). Null
    and empty texts resemble nothing and stay."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark. Null and empty texts are clean; without a benchmark all are."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, the scores of the best segmentations, the best one's ids, and the CRC-32 of these and of the text that they
    decode to. Every row of docs has one: a null or empty text is one space piece, repeated rows are answered alike."""
    out = nbest_pieces.round_trip(docs, nbest_pieces.default_model())
    return out.select("doc_id", "n_pieces", "scores", "ids", "ids_crc32", "text_crc32")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: SQL can't express the third and the fifth stage; tests/llm hold the run against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
