"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints"


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread writes below the shared folder inside goes at the end: for work whose results are stored elsewhere by then."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        paths, _open.paths = _open.paths, outer
        for path in paths:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends or ``scratch`` does."""
    path = f"{shared_dir(spark)}/sorrel-{uuid.uuid4().hex}/{name}"
    parent = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(parent)
    return path


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, which cuts its lineage; ``codec`` in place of the session's for large tables."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], out: str, base: int = 0) -> DataFrame:
    """Adds ``out``: ``base`` + 1, + 2, ... in ``order``, numbering each range partition on its own.

    The counts of the partitions are all that meets in one place.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    bases, at = [], base
    for part, n in sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect()):
        bases.append((part, at))
        at += n
    shift = F.broadcast(df.sparkSession.createDataFrame(bases, "_part int, _base long"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(shift, "_part").withColumn(out, F.col("_base") + inside).select(*[c for c in df.columns if c != out], out)


#: Bits of a sieve at most.
SIEVE = 1 << 25


def sieve(ids: DataFrame) -> tuple[DataFrame, int]:
    """One row ``(_bits)`` with a bit for each of so many hashes, at most ``SIEVE``, that ids ``(id)`` have, 64 bits to a number. More ids let more rows through ``sifted``."""
    from pyspark.sql import functions as F

    n = min(SIEVE, 1 << max(10, (16 * ids.count()).bit_length()))
    slots = ids.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("_slot")).selectExpr("shiftright(_slot, 6) AS id", "shiftleft(1L, cast(_slot & 63 AS INT)) AS _bit")
    every = ids.sparkSession.range(n >> 6).join(slots.groupBy("id").agg(F.bit_or("_bit").alias("_bit")), "id", "left")
    words = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("_bit", F.lit(0).cast("long")).alias("_bit")))).alias("_words"))
    return written(words.select(F.col("_words._bit").alias("_bits")), "sieve"), n


def sifted(rows: DataFrame, *by: tuple[str, tuple[DataFrame, int]]) -> tuple[DataFrame, DataFrame]:
    """Rows that may have an id of one of the sieves ``by`` their columns, and rows that have none for sure: told apart where they are read, without a shuffle."""
    from pyspark.sql import functions as F

    bits, hit = None, F.lit(False)
    for i, (column, (row, n)) in enumerate(by):
        row = row.withColumnRenamed("_bits", f"_bits{i}")
        bits = row if bits is None else bits.crossJoin(row)
        slot = F.pmod(F.xxhash64(column), F.lit(n))
        hit = hit | (F.getbit(F.get(f"_bits{i}", F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return rows.join(F.broadcast(bits), hit, "left_semi"), rows.join(F.broadcast(bits), hit, "left_anti")
