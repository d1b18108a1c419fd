"""Exact deduplication by content sort, in DataFrame functions only.

Sampled splitters range-partition the normalised bytes by their first bytes and, among texts that begin
alike, by a hash (so that splitters stay small and a common beginning is no hot range); each
partition's external sort places equal texts side by side, and comparing neighbours in full (a window
over the sorted bytes) finds each run of equals. A text whose copies are more bytes than a partition should hold is
split: its rows get a salt behind the hash in the sort key, so the splitters cut inside the run; the few sub-runs are
then compared in full and merged. Texts are equal by their bytes; digests only carry a group's decision to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: Bytes of a text that the splitters compare before its hash.
HEAD = 32
#: Bytes that a row counts beside its text.
ROW = 64


def _norm(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit(""))).cast("binary")


def _dealt(keyed: DataFrame) -> DataFrame:
    """Rows with ``norm``'s ``h`` and ``head`` dealt to ranges of (head, h, salt); ``salt`` is -1 but for contents that are split.

    A content is split when its rows have more bytes than a quarter of a partition's share, so that fewer
    than four contents a partition are: that bounds the table that is broadcast, at 24 bytes a row. It goes by the hash, and
    a collision costs nothing but a salt. Salts go by the row's place in its input partition, so rows that repeat an id are split too.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialize(keyed.groupBy("h").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")), "sizes")
    fair = max(1, (sizes.agg(F.sum("b")).first()[0] or 0) // (4 * parts))
    hot = sizes.where((F.col("b") > fair) & (F.col("n") > 1)).select("h", F.ceil(4 * F.col("b") / fair).alias("salts"))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts"))
    salted = keyed.drop("bytes").join(F.broadcast(hot), "h", "left").withColumn("salt", F.coalesce(place, F.lit(-1).cast("long"))).drop("salts")
    return salted.repartitionByRange("head", "h", "salt")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Groups of equal texts: ``(id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. ``keep`` is
    ``smallest`` or ``largest``: which identifier of a group stays. Null ids never stay in favour of
    another; in a group of null ids only, ``keep_id`` is null and none counts as kept. Rows that repeat an id stay
    rows of their own with the same decision. Other columns are ignored; an empty table gives none.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    norm = _norm(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    dealt = _dealt(rows.select("id", "norm", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("h"), (F.octet_length("norm") + ROW).alias("bytes")))
    # The range partitioning by the first three keys keeps equal texts together, so the window needs no other exchange.
    run = Window.partitionBy("head", "h", "salt", "norm")
    # Only one row of each sub-run of a split text carries its bytes on: a bounded number a partition.
    first = (F.col("salt") >= 0) & (F.row_number().over(run.orderBy("id")) == 1)
    found = dealt.select("id", "salt", best("id").over(run).alias("run_keep"), F.count("*").over(run).alias("run_size"), F.sha2("norm", 256).alias("text_sha256"), F.when(first, F.col("norm")).alias("norm"))
    runs = materialize(found, "runs")
    plain = runs.where("salt < 0").select("id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), "text_sha256")
    heads = runs.where("salt >= 0 and norm is not null")
    whole = heads.groupBy("norm").agg(best("run_keep").alias("keep_id"), F.sum("run_size").alias("group_size"), F.first("text_sha256").alias("text_sha256")).drop("norm")
    # As few rows as there are split contents.
    split = runs.where("salt >= 0").select("id", "text_sha256").join(F.broadcast(materialize(whole, "whole")), "text_sha256")
    out = plain.unionByName(split.select(*plain.columns))
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs``, whole, without exact copies: one row stays of each group of texts that ``exact_dedup`` calls equal.

    The row with the smallest (``largest``) id stays, one without an id only where no row of its group has one; of
    rows that repeat it one stays, whichever. Texts come out as they were, null too; other columns, whatever their names,
    are carried; an empty table gives none.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, ident = (F.col(names[docs.columns.index(c)]) for c in (text_col, id_col))
    norm = _norm(text)
    # The rows travel as they are; the bytes that are sorted and compared are made again behind the exchange.
    dealt = _dealt(docs.toDF(*names).select(*names, F.substring(norm, 1, HEAD).alias("head"), F.xxhash64(norm).alias("h"), (F.octet_length(norm) + ROW).alias("bytes")))
    order = {"smallest": ident.asc_nulls_last(), "largest": ident.desc_nulls_last()}[keep]
    run = Window.partitionBy("head", "h", "salt", "norm").orderBy(order)
    firsts = materialize(dealt.withColumn("norm", norm).withColumn("at", F.row_number().over(run)).where("at = 1").select(*names, "salt"), "firsts")
    row = F.struct(*names)
    best = F.max_by(row, F.struct(ident.isNotNull(), ident)) if keep == "largest" else F.min_by(row, F.struct(ident.isNull(), ident))
    merged = firsts.where("salt >= 0").groupBy(norm.alias("norm")).agg(best.alias("row")).select("row.*")
    return firsts.where("salt < 0").select(*names).unionByName(merged).toDF(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_dedup`` over ``documents``; of equal texts the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP2_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
