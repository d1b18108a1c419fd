"""The request API: seven graph queries and one maintenance call over a snapshot, with plain results.

Each call is a batch of one through the operators; what is collected is a page, a path or a file's lines.
"""

from __future__ import annotations

import functools
import threading
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.adapters import route_language
from .functions.text import content_hash
from .operators import locate, materialize, paths, relations, store, symbols
from .operators.paging import next_cursor, page
from .operators.snapshots import Snapshot, SnapshotStore, refresh_sources
from .operators.symbols import NodeFilter
from .operators.tables import written
from .plans import schema
from .sources.files import confine, read_range


#: What requests learn of nodes from hover.
LEARNED = "id bigint, construct string, signature string"


@dataclass(frozen=True)
class SymbolRef:
    """A symbol by its full name or by a place in a file: exactly one of the two."""

    fqn: str | None = None
    at: tuple[str, int, int] | None = None

    def __post_init__(self):
        if (self.fqn is None) == (self.at is None):
            raise ValueError("a symbol is named by fqn or by at, and by one of them only")


@dataclass
class Facts:
    """Captured answers of the language servers; empty tables where there are none."""

    locations: DataFrame
    calls: DataFrame
    hover: DataFrame
    files: DataFrame
    health: DataFrame
    paths: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def none(spark: SparkSession, files: DataFrame | None = None) -> Facts:
        calls = schema.CALLS.replace("item_rank bigint", "item_end_line bigint, item_end_character bigint, item_rank bigint")
        empty = lambda ddl: spark.createDataFrame([], ddl)
        return Facts(empty(schema.LOCATIONS), empty(calls), empty(schema.HOVER), empty(schema.FILES) if files is None else files, empty("language string, status string"))


class GraphService:
    """Queries over one snapshot. Anchors that were never materialised are built from the facts when they are asked for.

    What requests change in the edges, and what they learn of nodes, are small written tables over those of the snapshot, so plans do not grow with requests.
    Edges that are built already are served as they are, and their refreshing is put on a queue, which ``drain`` works off in one job for all anchors, whether called or, where
    ``refresh_every`` gives the seconds between, by a thread of the service.
    """

    def __init__(self, spark: SparkSession, snapshot: Snapshot, facts: Facts | None = None, root_uri: str = "file:///repo", refresh_every: float | None = None):
        self.spark, self.root_uri = spark, root_uri
        self.facts = facts or Facts.none(spark)
        self.stored, self.base = snapshot.nodes, snapshot.edges
        self.learned = spark.createDataFrame([], LEARNED)
        self._nothing = self.learned
        self.asked: set[tuple[int, str]] = set()
        # Requests and the refreshing thread take turns where they change tables.
        self._turn = threading.RLock()
        self._stop = threading.Event()
        if refresh_every is not None:
            threading.Thread(target=self._refresh_on, args=(refresh_every,), daemon=True).start()
        self.delta = self._empty = spark.createDataFrame([], self.base.schema)
        self.cache, self.marks = snapshot.callees_cache, snapshot.materialized
        self.last_edge = snapshot.last_ids()[1]
        self._calls: paths.CallIndex | None = None
        self._calls_of: DataFrame | None = None

    @property
    def calls(self) -> paths.CallIndex:
        """The snapshot's call index, made when first asked for; callers that requests have changed since are read from the edges."""
        if self._calls is None:
            self._calls = paths.CallIndex.build(self.base, self.nodes)
            self._calls_of = self._empty
        if self._calls_of is not self.delta:
            self._calls.change(self.delta.select(F.col("src_id").alias("id")), self.edges)
            self._calls_of = self.delta
        return self._calls

    @property
    def nodes(self) -> DataFrame:
        """The snapshot's nodes with the constructs and signatures that requests have learned."""
        if self.learned is self._nothing:
            return self.stored
        more = self.learned.select("id", F.col("construct").alias("_construct"), F.col("signature").alias("_signature"))
        out = self.stored.join(more, "id", "left").withColumn("construct", F.coalesce("construct", "_construct")).withColumn("signature", F.coalesce("signature", "_signature"))
        return out.select(*self.stored.columns)

    @property
    def edges(self) -> DataFrame:
        return self.base.join(self.delta.select("id"), "id", "left_anti").unionByName(self.delta)

    def _put(self, changed: DataFrame) -> None:
        """Edges with their ids take the place of those with the same ids."""
        with self._turn:
            self.delta = written(self.delta.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(*self.base.columns)), "delta")

    def _merge(self, new: DataFrame) -> None:
        """Upsert located edges; only the stored edges between the same ends are looked at."""
        with self._turn:
            new = written(new, "new")
            near = self.edges.join(new.select("src_id", "dst_id").distinct(), ["src_id", "dst_id"], "left_semi").select(*self.base.columns)
            changed = written(store.merged_edges(near, new.select(*self.base.columns), self.last_edge), "merged")
            self.last_edge = store.top_id(changed, self.last_edge)
            self._put(changed)

    def _anchor(self, ref: SymbolRef):
        if ref.fqn is not None:
            return symbols.by_fqn(self.nodes, ref.fqn).orderBy("id").first()
        point = self.spark.createDataFrame([ref.at], "uri string, line long, character long")
        row = locate.resolve_anchors(point, self.facts.locations, self.nodes).first()
        return row and symbols.by_id(self.nodes, row["anchor_id"]).first()

    def _hints(self, ref: SymbolRef, anchor) -> list[str]:
        return [r["fqn"] for r in symbols.hints(self.nodes, ref.fqn).collect()] if ref.fqn is not None and anchor is None else []

    def _degraded(self, language: str | None, timed_out: bool = False) -> dict:
        if language is None:
            return {}
        asked = self.spark.createDataFrame([(language, timed_out)], "language string, timed_out boolean")
        row = relations.degradation(asked, self.facts.health).first()
        return {"degraded": True, "degrade_reason": row["degrade_reason"], "lsp_status": row["lsp_status"]} if row["degrade_reason"] else {}

    def _warm(self, anchor_id: int, kind: str) -> bool:
        return not self.marks.where((F.col("anchor_id") == anchor_id) & (F.col("edge_type") == kind)).isEmpty()

    def _mark(self, anchor_id: int, kind: str) -> None:
        self.marks = written(store.mark_materialized(self.marks, self.spark.createDataFrame([(anchor_id, kind)], schema.MATERIALIZED)), "marks")

    def _one(self, anchor_id: int) -> DataFrame:
        return self.spark.createDataFrame([(anchor_id,)], "anchor_id long")

    def find_symbol(self, pattern: str, mode: str = "segment", ignore_case: bool = False, brief: bool = False, with_signature: bool = False, node_filter: NodeFilter = NodeFilter(), limit: int | None = None, cursor: str | None = None) -> dict:
        found = symbols.find_symbol(self.nodes, pattern, mode, ignore_case, node_filter, limit, cursor)
        if with_signature:
            found = self._signed(found)
        rows = found.collect()
        shown = {"fqns": [r["fqn"] for r in rows]} if brief else {"nodes": self._shown(rows)}
        return shown | {"next_cursor": next_cursor(rows)}

    def _shown(self, rows) -> list[dict]:
        if not rows:
            return []
        df = self.spark.createDataFrame([tuple(r[c] for c in NODE_COLUMNS) for r in rows], schema.NODES)
        return [r.asDict(recursive=True) for r in symbols.node_result(df).collect()]

    def _signed(self, found: DataFrame) -> DataFrame:
        """A page with the signatures that hover tells: only the page's nodes are looked up."""
        return materialize.backfill(written(found, "page"), self.facts.hover).orderBy(*symbols.sort_key())

    def find_definition(self, at: tuple[str, int, int]) -> dict:
        """The nodes that the definition's targets lie in, in the answer's order; what hover tells of them is kept."""
        point = self.spark.createDataFrame([at], "uri string, line long, character long")
        targets = written(locate.find_definition(point, self.facts.locations, self.nodes).select("rank", F.col("node_id").alias("id")), "targets")
        own = written(self.nodes.join(targets, "id", "left_semi"), "found")
        told = written(materialize.refine_constructs(materialize.backfill(own, self.facts.hover), self.facts.hover), "told")
        new = told.select("id", "construct", "signature").exceptAll(own.select("id", "construct", "signature"))
        if not new.isEmpty():
            with self._turn:
                self.learned = written(self.learned.join(new.select("id"), "id", "left_anti").select("id", "construct", "signature").unionByName(new), "learned")
        rows = told.join(targets, "id").orderBy("rank", "id").collect()
        language = self.spark.range(1).select(route_language(F.lit(at[0])).alias("l")).first()["l"]
        return {"nodes": self._shown(rows)} | self._degraded(language)

    def save(self, graphs: SnapshotStore) -> Snapshot:
        """Commit what requests have built and learned as the store's next version."""
        with self._turn:
            return graphs.commit(nodes=self.nodes, edges=self.edges, callees_cache=self.cache, materialized=self.marks)

    def _related(self, ref: SymbolRef, kind: str, incoming: bool, node_filter, limit, cursor, names: tuple[str, str], with_signature=False) -> dict:
        anchor = self._anchor(ref)
        if anchor is None:
            return {names[0]: [], "next_cursor": None, "hint_fqns": self._hints(ref, None)}
        more = self._build(anchor, kind, incoming)
        edges = self.edges
        found = page(relations.related(self._one(anchor["id"]), edges, self.nodes, kind, incoming, node_filter), limit, cursor)
        rows = (self._signed(found) if with_signature else found).collect()
        if more.pop("refresh", False):
            self.asked.add((anchor["id"], kind))
        shown = self._shown(rows)
        items = [{"node": n, names[1]: [s.asDict() for s in r["sites"]]} for n, r in zip(shown, rows, strict=True)]
        return {names[0]: items, "next_cursor": next_cursor(rows), "hint_fqns": []} | self._degraded(anchor["language"]) | more

    def _build(self, anchor, kind: str, incoming: bool) -> dict:
        """Bring an anchor's edges up before they are read, if its source is there; without it they are served as they are.

        Incoming ones are built when first asked for; later they are served as they are and put on the queue of those to refresh
        (``refreshing``). Outgoing calls are rebuilt whenever the anchor's file is not what it was.
        """
        one, up = self._one(anchor["id"]), self._degraded(anchor["language"]) == {}
        if incoming:
            warm = up and self._warm(anchor["id"], kind)
            if up and not warm:
                self.refresh(one, kind)
                self._mark(anchor["id"], kind)
            return {"refreshing": up, "refresh": warm}
        if up and not relations.callee_freshness(one, self.nodes, self.facts.files, self.cache).first()["fresh"]:
            own = self.edges.where((F.col("src_id") == anchor["id"]) & (F.col("edge_type") == "calls"))
            self._put(store.invalidate_outgoing_calls(own, one))
            self._merge(materialize.call_edges(one, self.nodes, self.facts.calls, "outgoing", self.root_uri, self.facts.locations))
            hashed = symbols.by_id(self.nodes, anchor["id"]).join(self.facts.files, "uri").select(F.col("id").alias("anchor_id"), content_hash(F.col("text")).alias("content_hash"))
            self.cache = written(store.merge_keyed(self.cache, hashed, ["anchor_id"]), "cache")
        return {}

    def refresh(self, anchors: DataFrame, kind: str) -> None:
        """Merge what the facts say about the incoming edges of anchors ``(anchor_id)``; known ones become valid again, none is removed."""
        self._merge(self._told(anchors, kind))

    def _told(self, anchors: DataFrame, kind: str) -> DataFrame:
        return materialize.reference_edges(anchors, self.nodes, self.facts.locations) if kind == "references" else materialize.call_edges(anchors, self.nodes, self.facts.calls, "incoming", self.root_uri)

    def drain(self) -> int:
        """Refresh all anchors that are on the queue, each once however often it was asked for, in one merge; how many there were."""
        with self._turn:
            asked, self.asked = self.asked, set()
            if not asked:
                return 0
            pairs = written(self.spark.createDataFrame(sorted(asked), schema.MATERIALIZED), "asked")
            try:
                told = [self._told(pairs.where(F.col("edge_type") == kind).select("anchor_id"), kind) for kind in sorted({k for _, k in asked})]
                self._merge(functools.reduce(DataFrame.unionByName, told))
            except Exception:
                # What could not be refreshed stays on the queue.
                self.asked |= asked
                raise
            return len(asked)

    def _refresh_on(self, every: float) -> None:
        while not self._stop.wait(every):
            try:
                self.drain()
            except Exception as e:
                warnings.warn(f"refreshing failed and is tried again: {e}", stacklevel=1)

    def close(self) -> None:
        """Stop the refreshing thread, if there is one."""
        self._stop.set()

    def find_references(self, ref: SymbolRef, node_filter: NodeFilter = NodeFilter(), limit: int | None = None, cursor: str | None = None) -> dict:
        return self._related(ref, "references", True, node_filter, limit, cursor, ("references", "sites"))

    def find_callers(self, ref: SymbolRef, node_filter: NodeFilter = NodeFilter(), limit: int | None = None, cursor: str | None = None, with_signature: bool = False) -> dict:
        return self._related(ref, "calls", True, node_filter, limit, cursor, ("callers", "call_sites"), with_signature)

    def find_callees(self, ref: SymbolRef, node_filter: NodeFilter = NodeFilter(), limit: int | None = None, cursor: str | None = None, with_signature: bool = False) -> dict:
        return self._related(ref, "calls", False, node_filter, limit, cursor, ("callees", "call_sites"), with_signature)

    def find_call_path(self, start: SymbolRef, target: SymbolRef, max_depth: int | None = None, budget: int | None = None) -> dict:
        a, b = self._anchor(start), self._anchor(target)
        if a is None or b is None:
            return {"reachable": False, "path": [], "limit_reached": False, "from_hint_fqns": self._hints(start, a), "to_hint_fqns": self._hints(target, b)}
        stale = lambda anchors: relations.callee_freshness(anchors, self.nodes, self.facts.files, self.cache).where("not fresh").select("anchor_id")
        got = paths.find_call_path(self.calls, a["id"], b["id"], max_depth, stale, budget)
        rows = {r["id"]: r for r in self.nodes.where(F.col("id").isin(got.path)).collect()} if got.path else {}
        return {"reachable": got.reachable, "path": self._shown([rows[i] for i in got.path]), "limit_reached": got.limit_reached, "from_hint_fqns": [], "to_hint_fqns": []} | self._degraded(a["language"])

    def read_range(self, uri: str, start_line: int | None = None, end_line: int | None = None) -> dict:
        """Whole lines; a uri must lie below the root after links and dots are resolved, and be one of the given table's."""
        confine(uri, self.root_uri.removeprefix("file://"))
        asked = self.spark.createDataFrame([(uri, start_line, end_line)], "uri string, start_line int, end_line int")
        row = read_range(self.facts.files, asked).first()
        if row is None:
            raise FileNotFoundError(uri)
        end = min(row["end_line"], row["total_lines"])
        span = {"start": {"line": row["start_line"], "character": 0}, "end": {"line": end, "character": 0}}
        return {"uri": uri, "content": row["content"], "range": span, "total_lines": row["total_lines"]}

    def restart(self, language: str | None = None) -> dict:
        """Forget what is cached of the fact sources, of one language or all."""
        return {"restarted": refresh_sources(self.spark, self.facts.paths, language)}


NODE_COLUMNS = [c.split()[0] for c in schema.NODES.split(", ")]
