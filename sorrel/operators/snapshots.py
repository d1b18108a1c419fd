"""The graph's tables as versioned Parquet snapshots: readers keep the version they opened, a commit is one rename."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import schema
from .store import merge_keyed, top_id

#: Settings that hold the greatest ids of nodes and edges so far.
LAST = ("last_node_id", "last_edge_id")
TABLES = {"nodes": schema.NODES, "edges": schema.EDGES, "callees_cache": schema.CALLEES_CACHE, "materialized": schema.MATERIALIZED, "index_meta": schema.META}


@dataclass
class Snapshot:
    """The tables of one version."""

    version: int
    nodes: DataFrame
    edges: DataFrame
    callees_cache: DataFrame
    materialized: DataFrame
    index_meta: DataFrame

    def last_ids(self) -> tuple[int, int]:
        """The greatest ids of nodes and of edges that were ever given out, 0 where none was."""
        stored = {r["key"]: int(r["value"]) for r in self.index_meta.where(F.col("key").isin(*LAST)).collect()}
        return tuple(max(stored.get(key, 0), top_id(df)) for key, df in zip(LAST, (self.nodes, self.edges), strict=True))


class SnapshotStore:
    """A folder of versions ``v1, v2, ...`` in any store that Spark writes to. The largest whole version is current.

    A version is written below a name of its own and renamed when complete, so a job that dies leaves nothing that is
    read. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._top = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._top.getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> int:
        """The current version's number, 0 before the first commit."""
        if not self._fs.exists(self._top):
            return 0
        names = (s.getPath().getName() for s in self._fs.listStatus(self._top))
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def read(self, version: int | None = None) -> Snapshot:
        v = self.current() if version is None else version
        if not v:
            return Snapshot(0, **{t: self.spark.createDataFrame([], s) for t, s in TABLES.items()})
        return Snapshot(v, **{t: self.spark.read.schema(s).parquet(f"{self.path}/v{v}/{t}.parquet") for t, s in TABLES.items()})

    def commit(self, **tables: DataFrame) -> Snapshot:
        """Write a new version; tables that are not named are those of the current one.

        The greatest ids so far are kept among the settings, so those of deleted rows are not given out again.
        """
        old = self.read()
        v = old.version + 1
        draft = f"{self.path}/_draft{v}"
        path = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs.delete(path(draft), True)
        before = old.last_ids()
        # The settings come last, with the greatest ids of what was written.
        for name, ddl in TABLES.items():
            df = tables.get(name, getattr(old, name))
            if name == "index_meta":
                now = [top_id(self.spark.read.parquet(f"{draft}/{t}.parquet"), last) for t, last in zip(("nodes", "edges"), before, strict=True)]
                df = merge_keyed(df, self.spark.createDataFrame(list(zip(LAST, map(str, now), strict=True)), schema.META), ["key"])
            columns = [c.split()[0] for c in ddl.split(", ")]
            df.select(*columns).write.parquet(f"{draft}/{name}.parquet")
        if not self._fs.rename(path(draft), path(f"{self.path}/v{v}")):
            raise OSError(f"version {v} of {self.path} could not be put in place")
        return self.read(v)

    def prune(self, keep: int = 2) -> None:
        """Remove all but the newest versions."""
        now = self.current()
        for v in range(1, now - keep + 1):
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)


def refresh_sources(spark: SparkSession, paths: dict[str, str], language: str | None = None) -> list[str]:
    """Forget what Spark has cached of the fact tables by language, of one or of all; the languages refreshed."""
    hit = [tag for tag in paths if language is None or tag == language]
    for tag in hit:
        spark.catalog.refreshByPath(paths[tag])
    return sorted(hit)
