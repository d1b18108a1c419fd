"""Helpers that several operators share: tables, shared scratch folders, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_LOCAL_SHARED = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a folder of its own; a cluster session is an error,
    as a machine-local folder would lose data there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{_LOCAL_SHARED}"


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed by ``clear_scratch`` or when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/sorrel-{uuid.uuid4().hex}/{name}"
    jvm = spark._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    _MADE.append(parent.toString())
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch folders of this process, once the results that read them have been written."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = 512, mb: int = 32) -> None:
    """Bound the Arrow batches that Python workers get, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


#: Edges that one task settles by itself at most.
ALONE = 1 << 18


def _settle(batches):
    """Batches of edges ``(a, b)``, all of a graph, to its ``(node, root)`` rows: labels fall to the least neighbour's, with pointer jumping."""
    edges = pa.Table.from_batches(list(batches)).combine_chunks()
    ends = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (edges.column(0), edges.column(1))]).dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[ends.indices.to_numpy()]
    a, b = code[: len(code) // 2], code[len(code) // 2 :]
    label = np.arange(len(order))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    names = ends.dictionary.take(pa.array(order))
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], ["node", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 60, alone: int = ALONE) -> DataFrame:
    """Components of an undirected graph given as ``(a, b)`` rows of one orderable type.

    Up to ``alone`` distinct edges, as counted, one task settles. More alternate large-star and small-star steps, each a
    map-side combined minimum per node and a join,
    until the edge set stays the same; each round is a written table. Returns ``(node, root)`` for
    each node on an edge, ``root`` being its component's smallest node. Self loops and repeated edges
    are allowed, null ends are dropped, an empty input gives an empty result.
    """
    named = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null")
    # A self loop must not vanish: its node is a component of its own.
    current = materialize(named.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n = current.count()
    if not n:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if n <= alone:
        kind = current.schema["a"].dataType.simpleString()
        return current.coalesce(1).mapInArrow(_settle, f"node {kind}, root {kind}")

    def step(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            own = least.select("a", F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            own = least.select("a", F.col("m").alias("b"))
        return out.unionAll(own).where("a >= b").distinct()

    def mark(pairs: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(pairs.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())

    before = mark(current)
    for _ in range(max_rounds):
        current = materialize(step(step(current, True), False), "edges")
        now = mark(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return current.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root"))
