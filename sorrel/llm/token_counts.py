"""Token counts with a digest cache.

Digest cache: each text's normalised content (null becomes the empty text; anything further could
change a count) is keyed by its SHA-256 together with a digest of the tokenizer, joined to the stored
counts; only one row of each digest without a stored count is encoded, and its count is appended.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, small_batches, table

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"


@lru_cache(maxsize=4)
def tokenizer_digest(model_path: str) -> str:
    """Digest of a tokenizer file and of the library version that runs it."""
    library = "tokenizers" if model_path.endswith(".json") else "sentencepiece"
    with open(model_path, "rb") as f:
        body = hashlib.sha256(f.read())
    body.update(f"{library} {version(library)}".encode())
    return body.hexdigest()


@lru_cache(maxsize=4)
def _counter(model_path: str):
    if model_path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(model_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return lambda text: len(processor.encode(text, add_bos=False, add_eos=False))


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``(id, n_bytes, n_tokens, over_limit)``, one row per input row.

    ``cache_path`` is a Parquet table in a folder that all executors share; it is created when missing
    and grows by one row per new (tokenizer, content). A tokenizer file must be at ``model_path`` on
    every executor. Null text counts as empty (0 bytes; the tokens that the library gives for ``""``),
    repeated rows and null ids keep a row each, other columns are ignored, an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marker = tokenizer_digest(model_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.sha2("text", 256))
    keyed = materialize(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    _ensure_cache(spark, cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == marker)

    wanted = keyed.groupBy("digest").agg(F.min("id").alias("first_id"))
    misses = materialize(wanted.join(stored, "digest", "left_anti"), "misses")
    chosen = rows.alias("r").join(misses.alias("m"), (F.col("r.digest") == F.col("m.digest")) & F.col("r.id").eqNullSafe(F.col("m.first_id")), "left_semi")

    def encode(batches):
        count, last = _counter(model_path), {}
        for batch in batches:
            # Rows that repeat an id, or have none, may bring one text again: a batch's texts, and the last batch's, are encoded once.
            got = {}
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest not in got and digest not in last:
                    got[digest] = count(text.as_py())
            last = got
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["digest", "n_tokens"])

    # One row a content is appended, wherever it was encoded.
    fresh = chosen.select("digest", "text").mapInArrow(encode, "digest string, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(marker).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == marker)
    # Two jobs that append at once may store a digest twice.
    counts = materialize(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _ensure_cache(spark: SparkSession, cache_path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache_path)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count_tokens`` over ``documents``; each call starts with an empty cache, so all work is done."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), scratch(spark, "token_cache"))
