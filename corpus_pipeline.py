"""The corpus pipeline: language ID, exact dedup, near-dedup, then packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and its result, written as
Parquet, is the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm import exact_dedup, language_id, near_copies, packing
from sorrel.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null and letterless texts (``und``) go. All others stay, however sure the network
    is of them and also where it could learn nothing, repeated rows and rows without an id too. The label stays as it was.
    Columns beyond those of ``documents`` go; an empty table gives none."""
    model = language_id.train(docs.where(~language_id.held_out()))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    judged = language_id.identify(docs.withColumn("_whole", F.col("text")), model, keep=["_whole", "lang", "source", "n_chars"])
    return judged.where(F.col("lang_pred") != language_id.UNKNOWN).withColumnRenamed("_whole", "text").select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id; one without an id only where none has one,
    and one of those that repeat it. Null text is empty. The rows are otherwise as they came; an empty table gives none."""
    return exact_dedup.keep_one(docs.select(*COLUMNS), keep="largest")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the one with the smallest doc_id,
    one without an id only where none has one. Null and empty texts are copies of each other; an empty table gives none."""
    return near_copies.near_copies(docs.select(*COLUMNS))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences, sources mixed by their shares; null, empty and repeated texts and an empty table as ``pack`` says."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", keep_identified), ("exact_dedup", drop_exact_copies), ("simhash_dedup", drop_similar), ("packing", pack_windows)]
#: A trained network and fingerprints are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
