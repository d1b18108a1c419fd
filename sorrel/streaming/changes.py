"""File changes as a stream: coalesced by file, reconciled batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.adapters import BUILT_IN, LanguageAdapter, route_language
from ..operators.tables import written
from ..sources.files import discover

CHANGES = "uri string, kind string, ts timestamp"
#: Kinds of change that count; others, such as mere access, do not.
KINDS = ("any", "create", "modify", "remove")


def change_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Change events from JSON files that appear in a folder."""
    reader = spark.readStream.schema(CHANGES).format("json")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def relevant(changes: DataFrame, root_uri: str | None = None, rules: list[tuple[str, str]] = (), adapters: tuple[LanguageAdapter, ...] = BUILT_IN) -> DataFrame:
    """Changes of files that a language owns and nothing hides; with a root, of those below it that no rule ignores, as in discovery."""
    counted = changes.where(F.lower("kind").isin(*KINDS))
    if root_uri is not None:
        return discover(counted, root_uri, rules, adapters)
    return counted.where(route_language(F.col("uri"), adapters).isNotNull() & ~F.col("uri").rlike(r"/\.[^/]"))


def coalesced(changes: DataFrame) -> DataFrame:
    """Each file once: ``(uri, removed)`` after its last change."""
    last = F.max(F.struct("ts", F.lower("kind").alias("kind"))).alias("last")
    return changes.groupBy("uri").agg(last).select("uri", (F.col("last.kind") == "remove").alias("removed"))


class _Quiet(StatefulProcessor):
    """A file's last change so far, let through when no other has come for a while."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, kind string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        held = [tuple(self.last.get())] if self.last.exists() else []
        for pdf in rows:
            held += list(zip(pdf["ts"].dt.to_pydatetime(), pdf["kind"], strict=True))
        # As in ``coalesced``: the latest, of those at one time the greater kind.
        self.last.update(max(held, key=lambda x: (x[0], x[1].lower())))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        kind = self.last.get()[1]
        self.last.clear()
        yield pd.DataFrame({"uri": [key[0]], "removed": [kind.lower() == "remove"]})

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, quiet_ms: int = 300) -> DataFrame:
    """Each burst of a file's changes once, over however many batches it comes: ``(uri, removed)`` after its last change, when none has followed for ``quiet_ms``.

    State is a row for each file that has changed lately, in RocksDB, with a timer each. Changes must have a time and a kind.
    """
    used = changes.select("uri", "ts", "kind").where("uri is not null and ts is not null and kind is not null")
    return used.groupBy("uri").transformWithStateInPandas(_Quiet(quiet_ms), "uri string, removed boolean", "Append", "ProcessingTime")


def reconcile_bursts(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, quiet_ms: int = 300, every: str = "100 milliseconds", root_uri: str | None = None, rules: list[tuple[str, str]] = ()):
    """Like ``reconcile_stream``, but a file's burst of changes is one call's row even where it goes on over several batches.

    The session's state store must be the RocksDB one, which this sets where nothing is set."""
    spark = changes.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def batch(df: DataFrame, batch_id: int) -> None:
        # Read once: the rows of a stateful batch are not made twice.
        files = written(df, "burst")
        if not files.isEmpty():
            apply(files, batch_id)

    writer = debounced(relevant(changes, root_uri, rules), quiet_ms).writeStream.outputMode("append").foreachBatch(batch)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def reconcile_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "300 milliseconds", root_uri: str | None = None, rules: list[tuple[str, str]] = ()):
    """Runs ``apply(files, batch_id)`` on each batch's coalesced files. The trigger interval is the debounce; None drains what is there and stops."""

    def batch(df: DataFrame, batch_id: int) -> None:
        files = coalesced(df)
        if not files.isEmpty():
            apply(files, batch_id)

    writer = relevant(changes, root_uri, rules).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def reconciler(store, fetch: Callable[[DataFrame], DataFrame], root_uri: str) -> Callable[[DataFrame, int], None]:
    """For ``reconcile_stream``: each batch's files are fetched (``fetch`` returns their ``(uri, symbols)`` answers), reconciled with
    the store's current snapshot, and committed as the next version."""
    from ..operators.reconcile import reconcile_answers

    def apply(files: DataFrame, batch_id: int) -> None:
        now = store.read()
        nodes, edges, cache, marks, _ = reconcile_answers(now.nodes, now.edges, now.callees_cache, now.materialized, files, fetch(files.where("not removed")), root_uri, now.last_ids())
        store.commit(nodes=nodes, edges=edges, callees_cache=cache, materialized=marks)

    return apply


def table_reconciler(tables, fetch: Callable[[DataFrame], DataFrame], root_uri: str, name: str = "changes") -> Callable[[DataFrame, int], None]:
    """Like ``reconciler`` on ``GraphTables`` in place: what a batch costs to write depends on its files, not on the graph.

    The stream's last batch is kept under its ``name`` with the tables, in the same change: a batch that comes again after a failure, which
    would count as a second miss of its symbols, is left out.
    """
    from ..operators.reconcile import answered

    key = f"stream_batch:{name}"

    def apply(files: DataFrame, batch_id: int) -> None:
        if int(tables.setting(key) or -1) < batch_id:
            symbols, uris = answered(files, fetch(files.where("not removed")), root_uri)
            tables.reconcile(symbols, uris, {key: str(batch_id)})

    return apply


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, lateness: str) -> DataFrame:
    """Events by key in tumbling windows, late ones dropped behind the watermark; an extension for runtime call events."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("window"), key).agg(F.count("*").alias("events"))
