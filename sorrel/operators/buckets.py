"""The graph's tables in place, dealt to hash buckets of their keys, so that a merge rewrites what it touches.

A table is a folder with a partition ``bucket=n`` for each bucket, written beside the table and then moved into it. Unlike snapshots these tables
have one version; a merge that dies may have replaced some of its buckets, and repeating it gives the same tables. Reconciling files, which may not be
repeated, is first written as a change beside the tables, which counts from one rename on; whoever opens the tables next puts in place what is left of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import schema
from .reconcile import FREE, HELD, met, settle
from .store import PHYSICAL_KEY, merge_keyed, merge_nodes, top_id, upsert_edges
from .tables import scratch, sieve, sifted, written


def cleared(f: Callable) -> Callable:
    """A method whose intermediate tables go when it is done, as it stores its results in place."""

    @wraps(f)
    def run(self, *args, **kwargs):
        with scratch(self.spark):
            return f(self, *args, **kwargs)

    return run


class BucketTable:
    """One table of schema ``ddl``, dealt by a hash of ``keys`` to so many buckets."""

    #: Tasks that may write one bucket.
    PARTS = 64

    def __init__(self, spark: SparkSession, path: str, ddl: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.ddl, self.keys, self.n = spark, path.rstrip("/"), ddl, keys, buckets
        self.columns = [c.split()[0] for c in ddl.split(", ")]
        self._top = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._top.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._top)
        # A run that died while it moved buckets has left the others beside the table.
        for f in self._fs.listStatus(self._top):
            if f.getPath().getName().startswith("_fresh-") and self._fs.exists(self._at(f"{f.getPath()}/_SUCCESS")):
                self._put(str(f.getPath().toString()))

    def bucket(self, *columns: str) -> Column:
        """The bucket of rows whose keys stand in ``columns``."""
        return F.pmod(F.xxhash64(*(columns or self.keys)), F.lit(self.n)).cast("int")

    def buckets_of(self, rows: DataFrame, *columns: str) -> list[int]:
        """The buckets that rows fall into: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket(*columns).alias("bucket")).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all or of some buckets; others are not read."""
        rows = self.spark.read.schema(f"{self.ddl}, bucket int").parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*self.columns)

    def replace(self, rows: DataFrame, buckets: list[int], deal: bool = True) -> None:
        """Put ``rows`` in the place of all rows of ``buckets``; files of other buckets stay as they are.

        Without ``deal`` each task writes its rows where it has them, a file for each bucket: for rows that would cross a shuffle for nothing else.
        """
        if not buckets:
            return
        # What is read from the table is written beside it before its files go. A bucket's rows are dealt to several tasks, by their keys.
        fresh, part = f"{self.path}/_fresh-{uuid.uuid4().hex}", F.pmod(F.shiftright(F.xxhash64(*self.keys), 16), F.lit(self.PARTS))
        dealt = rows.select(*self.columns, self.bucket().alias("bucket"))
        dealt = dealt.repartition("bucket", part) if deal else dealt
        dealt.sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").parquet(fresh)
        for b in set(buckets) - self._put(fresh):
            # A bucket without rows has no files to come.
            self._fs.delete(self._at(f"{self.path}/bucket={b}"), True)
        self.spark.catalog.refreshByPath(self.path)

    def _put(self, fresh: str) -> set[int]:
        """Move the buckets of a folder that is whole into their places, and say which."""
        found = {int(f.getPath().getName().removeprefix("bucket=")): f.getPath() for f in self._fs.listStatus(self._at(fresh)) if f.isDirectory()}
        for b, rows in found.items():
            self._fs.delete(self._at(f"{self.path}/bucket={b}"), True)
            if not self._fs.rename(rows, self._at(f"{self.path}/bucket={b}")):
                raise OSError(f"bucket {b} of {self.path} could not be put in place")
        self._fs.delete(self._at(fresh), True)
        return set(found)

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def merge(self, batch: DataFrame) -> None:
        """Rows of ``batch`` replace those with the same keys; they must be unique by them."""
        touched = self.buckets_of(batch)
        self.replace(merge_keyed(self.read(touched), batch, self.keys), touched)


class GraphTables:
    """The graph's tables below ``path``: nodes by name, edges by source, callee hashes and marks by anchor, settings by key."""

    LAST = ("last_node_id", "last_edge_id")
    SAID = "id bigint, dead boolean"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        table = lambda name, ddl, *keys: BucketTable(spark, f"{path}/{name}", ddl, list(keys), buckets)
        self.spark, self.path = spark, path.rstrip("/")
        self.nodes, self.edges = table("nodes", schema.NODES, "fqn"), table("edges", schema.EDGES, "src_id")
        self.cache, self.marks = table("callees_cache", schema.CALLEES_CACHE, "anchor_id"), table("materialized", schema.MATERIALIZED, "anchor_id")
        self.meta = table("index_meta", schema.META, "key")
        self._fs = self.nodes._fs
        self.recover()

    def _parts(self) -> dict[str, tuple[BucketTable, list[str]]]:
        """Each table with the columns that tell its rows apart."""
        return {"nodes": (self.nodes, ["id"]), "edges": (self.edges, ["id"]), "callees_cache": (self.cache, ["anchor_id"]), "materialized": (self.marks, ["anchor_id", "edge_type"]), "index_meta": (self.meta, ["key"])}

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def setting(self, key: str) -> str | None:
        """A setting's value, None where there is none."""
        asked = self.spark.createDataFrame([(key,)], "key string")
        row = self.meta.read(self.meta.buckets_of(asked)).where(F.col("key") == key).first()
        return row and row["value"]

    def change(self, before: dict[str, DataFrame], after: dict[str, DataFrame], said: DataFrame | None = None) -> dict[str, list[int]]:
        """Replace rows ``before`` by ``after``, by tables' names, as one change; the buckets of each table that were rewritten.

        Other edges follow what is ``said`` ``(id, dead)`` of their ends, which is all that the change holds of them. Rows that are the same in both are left alone. A run that dies before the change is whole leaves the tables as they were; after that the change is
        finished by ``recover``, as often as it takes.
        """
        self._fs.delete(self._at("_draft"), True)
        for name, (table, _) in self._parts().items():
            none = self.spark.createDataFrame([], table.ddl)
            old, new = (side.get(name, none).select(*table.columns) for side in (before, after))
            both = old.withColumn("_n", F.lit(-1)).unionByName(new.withColumn("_n", F.lit(1)))
            rows = both.groupBy(*table.columns).agg(F.sum("_n").alias("_n")).where("_n != 0").withColumn("_new", F.col("_n") > 0).drop("_n")
            rows.write.parquet(f"{self.path}/_draft/{name}")
        (self.spark.createDataFrame([], self.SAID) if said is None else said).write.parquet(f"{self.path}/_draft/said")
        if not self._fs.rename(self._at("_draft"), self._at("_change")):
            raise OSError(f"a change of {self.path} could not be put in place")
        return self.recover()

    def recover(self) -> dict[str, list[int]]:
        """Put a whole change in place, if there is one. Parts of it may be in place already: the result is the same."""
        if not self._fs.exists(self._at("_change")):
            return {}
        touched = {}
        for name, (table, key) in self._parts().items():
            rows = self.spark.read.schema(f"{table.ddl}, _new boolean").parquet(f"{self.path}/_change/{name}")
            # Old rows and new: a row may go from one bucket to another.
            touched[name] = table.buckets_of(rows)
            if name == "edges" and self._fs.exists(self._at("_change/said")):
                said = self.spark.read.schema(self.SAID).parquet(f"{self.path}/_change/said")
                if not said.isEmpty():
                    touched[name] = self._follow(rows, said, touched[name])
                    continue
            kept = table.read(touched[name]).join(rows.select(*key).distinct(), key, "left_anti").select(*table.columns)
            table.replace(kept.unionByName(rows.where("_new").select(*table.columns)), touched[name])
        self._fs.delete(self._at("_change"), True)
        return touched

    @cleared
    def _follow(self, rows: DataFrame, said: DataFrame, touched: list[int]) -> list[int]:
        """Put the edges' part of a change in place, with what is said of ends; the buckets that were rewritten. To do so again changes nothing.

        Only edges that may have such an end, or the id of a row that is replaced, meet what is said; the others are written where they are read.
        """
        table, ends = self.edges, sieve(said.select("id"))
        touched = sorted({*touched, *table.buckets_of(said, "id")})
        if len(touched) < table.n:
            # Incoming edges may be in any bucket.
            touched = sorted({*touched, *table.buckets_of(table.read().join(said.select(F.col("id").alias("dst_id")), "dst_id", "left_semi"))})
        ids = written(rows.select("id").distinct(), "ids")
        near, far = sifted(table.read(touched), ("src_id", ends), ("dst_id", ends), ("id", sieve(ids)))
        near = met(near.join(ids, "id", "left_anti").select(*table.columns), said, FREE)
        table.replace(far.unionByName(near).unionByName(rows.where("_new").select(*table.columns)), touched, deal=False)
        return touched

    @cleared
    def reconcile(self, symbols: DataFrame, uris: DataFrame, settings: dict[str, str] | None = None) -> dict[str, list[int]]:
        """``reconcile.reconcile`` of the files ``(uri)`` on the rows that they touch, as one change that also puts ``settings``; the buckets that were rewritten.

        Looked at are the files' nodes, those with the symbols' names, the children of both, and what hangs on both: edges of containment from them and to
        them. Other edges are met once, where the change is put in place, by what is said of their ends.
        """
        uris = written(uris.select("uri").distinct(), "uris")
        symbols = symbols.join(uris, "uri", "left_semi")
        of_files = self.nodes.read().join(uris, "uri", "left_semi").select(*self.nodes.columns)
        named = self.nodes.read(self.nodes.buckets_of(symbols)).join(symbols.select("fqn").distinct(), "fqn", "left_semi").select(*self.nodes.columns)
        own = written(of_files.unionByName(named).dropDuplicates(["id"]), "own")
        ids = own.select("id")
        met = lambda rows, column: rows.join(ids.withColumnRenamed("id", column), column, "left_semi").select(*rows.columns)
        nodes = written(own.unionByName(met(self.nodes.read(), "container_id")).dropDuplicates(["id"]), "nodes")
        ends = [ids.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}")) for c in ("src_id", "dst_id")]
        edges = self.edges.read().where(HELD).join(ends[0], "src_id", "left").join(ends[1], "dst_id", "left").where("_src_id or _dst_id")
        edges = written(edges.select(*self.edges.columns), "edges")
        cache, marks = (written(met(t.read(t.buckets_of(ids, "id")), "anchor_id"), "side") for t in (self.cache, self.marks))
        last = self.last(0), self.last(1)
        new_nodes, new_edges, said, new_cache, new_marks, _ = settle(nodes, edges, cache, marks, symbols, uris, last)
        new_nodes, new_edges = written(new_nodes, "nodes"), written(new_edges, "edges")
        told = dict(zip(self.LAST, (str(top_id(t, n)) for t, n in zip((new_nodes, new_edges), last, strict=True)), strict=True)) | (settings or {})
        put = self.spark.createDataFrame(list(told.items()), schema.META)
        had = self.meta.read(self.meta.buckets_of(put)).join(put.select("key"), "key", "left_semi")
        before = {"nodes": nodes, "edges": edges, "callees_cache": cache, "materialized": marks, "index_meta": had}
        return self.change(before, {"nodes": new_nodes, "edges": new_edges, "callees_cache": new_cache, "materialized": new_marks, "index_meta": put}, said)

    def last(self, which: int) -> int:
        """The greatest id of nodes (0) or edges (1) that was ever given out, as stored; the table's own before the first merge."""
        row = self.meta.read(self.meta.buckets_of(self._setting(which, 0))).where(F.col("key") == self.LAST[which]).first()
        return int(row["value"]) if row else top_id((self.nodes, self.edges)[which].read())

    def _setting(self, which: int, value: int) -> DataFrame:
        return self.spark.createDataFrame([(self.LAST[which], str(value))], schema.META)

    def _remember(self, which: int, changed: DataFrame) -> None:
        """Stored before rows with new ids are, so that a run which dies in between wastes ids and gives none twice."""
        self.meta.merge(self._setting(which, top_id(changed, self.last(which))))

    @cleared
    def upsert_edges(self, batch: DataFrame) -> list[int]:
        """``store.upsert_edges`` on the sources' buckets alone, which it returns."""
        batch = written(batch, "batch")
        touched = self.edges.buckets_of(batch)
        # Only edges that may have a source of the batch meet it, the others are written where they are read.
        near, far = sifted(self.edges.read(touched), ("src_id", sieve(batch.select(F.col("src_id").alias("id")).distinct())))
        merged = upsert_edges(near, batch, self.last(1))
        self._remember(1, merged)
        self.edges.replace(far.unionByName(merged), touched, deal=False)
        return touched

    @cleared
    def upsert_nodes(self, batch: DataFrame, order: str = "id") -> list[int]:
        """``store.upsert_nodes`` on the buckets of old and new names, which it returns; rows that go are deleted with what hangs on them.

        Only the rows of the batch's names and places are looked at whole: names by bucket, places by the files' names.
        """
        batch = written(batch, "batch")
        # A row that stands at a place may have any name.
        at_place = self.nodes.read().join(batch.select(*PHYSICAL_KEY).distinct(), PHYSICAL_KEY, "left_semi")
        named = self.nodes.read(self.nodes.buckets_of(batch)).join(batch.select("fqn").distinct(), "fqn", "left_semi")
        near = written(named.select(*self.nodes.columns).unionByName(at_place.select(*self.nodes.columns)).dropDuplicates(["id"]), "near")
        changed, gone = merge_nodes(near, batch, order, self.last(0))
        self._remember(0, changed)
        self.delete_nodes(gone)
        renamed = near.join(changed.select("id"), "id", "left_semi").select("fqn").unionByName(changed.select("fqn"))
        touched = self.nodes.buckets_of(renamed)
        kept = self.nodes.read(touched).join(changed.select("id"), "id", "left_anti").select(*self.nodes.columns)
        self.nodes.replace(kept.unionByName(changed), touched)
        return touched

    @cleared
    def delete_nodes(self, gone: DataFrame) -> None:
        """Nodes ``(id)`` go with their edges, hashes and marks; children lose their container. Each table's touched buckets are rewritten."""
        ids = written(gone.select("id").distinct(), "gone")
        if ids.isEmpty():
            return
        of = lambda name: ids.select(F.col("id").alias(name), F.lit(True).alias("_hit"))
        # Incoming edges and children may be in any bucket: two columns of each are read for the numbers of those to rewrite.
        ends = self.edges.read()
        touched = sorted({*self.edges.buckets_of(ids, "id"), *self.edges.buckets_of(ends.join(of("dst_id"), "dst_id", "left_semi"))})
        left = self.edges.read(touched)
        for end in ("src_id", "dst_id"):
            left = left.join(of(end), end, "left_anti")
        self.edges.replace(left, touched)
        for table in (self.cache, self.marks):
            touched = table.buckets_of(ids, "id")
            table.replace(table.read(touched).join(of("anchor_id"), "anchor_id", "left_anti"), touched)
        all_nodes = self.nodes.read()
        touched = sorted({*self.nodes.buckets_of(all_nodes.join(of("id"), "id", "left_semi")), *self.nodes.buckets_of(all_nodes.join(of("container_id"), "container_id", "left_semi"))})
        kept = self.nodes.read(touched).join(of("id"), "id", "left_anti").join(of("container_id"), "container_id", "left")
        self.nodes.replace(kept.withColumn("container_id", F.when(F.col("_hit").isNull(), F.col("container_id"))), touched)
