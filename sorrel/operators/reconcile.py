"""Per-file reconciliation: exact match, rename match, insert, two-strike removal; and drift detection."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.adapters import BUILT_IN, LanguageAdapter, route_language

#: A renamed declaration begins at most so many lines from where the old one did.
DRIFT = 3
BOUNDS = [f"{part}_{end}" for part in ("range", "sel") for end in ("start_line", "start_col", "end_line", "end_col")]


def exact_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pass 1: ``(uri, new_pos, old_id)`` for symbols whose name a file's old rows have, the n-th with the n-th."""
    o = old.select("uri", "fqn", F.col("id").alias("old_id"), F.row_number().over(Window.partitionBy("uri", "fqn").orderBy("id")).alias("n"))
    n = new.select("uri", "fqn", F.col("pos").alias("new_pos"), F.row_number().over(Window.partitionBy("uri", "fqn").orderBy("pos")).alias("n"))
    return n.join(o, ["uri", "fqn", "n"]).select("uri", "new_pos", "old_id")


def body(df: DataFrame, detail: str = "detail"):
    """What a rename leaves alone: kind, detail and the absolute bounds."""
    return F.md5(F.concat_ws("\u0001", F.col("kind").cast("string"), F.coalesce(F.col(detail), F.lit("\u0002")), *[F.col(b).cast("string") for b in BOUNDS]).cast("binary"))


def rename_candidates(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pass 2's candidates among the unmatched: same kind and container, start lines at most DRIFT apart.

    ``(uri, new_pos, old_id, tier, drift)``; tier 1 when the bodies are the same. The band on lines becomes an equi-join on
    blocks of lines, each row meeting its own block and the two beside it.
    """
    width = DRIFT + 1
    o = old.join(pairs.select(F.col("old_id").alias("id")), "id", "left_anti")
    o = o.select("uri", F.col("id").alias("old_id"), "kind", T.container_prefix(F.col("fqn")).alias("prefix"), F.col("range_start_line").alias("old_line"), body(o).alias("old_body"))
    o = o.withColumn("block", F.explode(F.array(*[F.floor(F.col("old_line") / width) + d for d in (-1, 0, 1)])))
    n = new.join(pairs.select("uri", F.col("new_pos").alias("pos")), ["uri", "pos"], "left_anti")
    n = n.select("uri", F.col("pos").alias("new_pos"), "kind", T.container_prefix(F.col("fqn")).alias("prefix"), F.col("range_start_line").alias("new_line"), body(n).alias("new_body"))
    n = n.withColumn("block", F.floor(F.col("new_line") / width))
    drift = F.abs(F.col("new_line") - F.col("old_line"))
    met = n.join(o, ["uri", "kind", "prefix", "block"]).where(drift <= DRIFT)
    return met.select("uri", "new_pos", "old_id", (F.col("new_body") == F.col("old_body")).cast("int").alias("tier"), drift.cast("long").alias("drift"))


def assign_renames(candidates: DataFrame) -> DataFrame:
    """Greedy one-to-one choice by file, best candidates first: tier, then least drift, then the oldest row, then the first symbol.

    In rounds: a pair that is the best of its symbol and of its row is one that the greedy choice takes, as no better one can take either away; then all candidates
    of both go. Rounds go on until none is left; a run of symbols each of which waits for the one before takes a round each.
    """
    from .tables import written

    key = F.struct(-F.col("tier"), "drift", "old_id", "new_pos")
    of_new, of_old = Window.partitionBy("uri", "new_pos"), Window.partitionBy("uri", "old_id")
    left, chosen = candidates.select("uri", "new_pos", "old_id", "tier", "drift").distinct(), None
    while True:
        best = left.withColumn("by_new", F.min(key).over(of_new)).withColumn("taken", (F.min(key).over(of_old) == key) & (F.col("by_new") == key))
        # Whether either side is taken now.
        best = best.withColumn("old_gone", F.bool_or("taken").over(of_old)).withColumn("new_gone", F.bool_or("taken").over(of_new))
        now = written(best.drop("by_new"), "renames")
        picked = now.where("taken").select("uri", "new_pos", "old_id")
        chosen = picked if chosen is None else chosen.unionByName(picked)
        left = now.where("not old_gone and not new_gone").select("uri", "new_pos", "old_id", "tier", "drift")
        if left.isEmpty():
            return chosen


def plan_reconcile(old: DataFrame, new: DataFrame, renames: bool = True) -> DataFrame:
    """What becomes of each old row and each new symbol: ``(uri, action, old_id, new_pos, changed)``.

    Actions are unchanged, updated, renamed, inserted, orphaned and deleted; ``changed`` rows lose the validity
    of their edges. Orphans take part as old rows, so a symbol that returns revives its row.
    """
    from .tables import written

    pairs = written(exact_pairs(old, new), "pairs")
    if renames:
        pairs = pairs.unionByName(written(assign_renames(rename_candidates(old, new, pairs)), "renames"))
    o = old.select("uri", F.col("id").alias("old_id"), F.col("fqn").alias("old_fqn"), F.col("signature_hash").alias("old_hash"), F.col("orphan").alias("was_orphan"))
    n = new.select("uri", F.col("pos").alias("new_pos"), F.col("fqn").alias("new_fqn"), F.col("signature_hash").alias("new_hash"))
    side = n.join(pairs, ["uri", "new_pos"], "left").join(o, ["uri", "old_id"], "left")
    renamed = F.col("old_fqn") != F.col("new_fqn")
    moved = ~F.col("old_hash").eqNullSafe(F.col("new_hash"))
    action = F.when(F.col("old_id").isNull(), "inserted").when(renamed, "renamed").when(moved, "updated").otherwise("unchanged")
    kept = side.select("uri", action.alias("action"), "old_id", "new_pos", F.coalesce(renamed | moved, F.lit(False)).alias("changed"))
    lost = o.join(pairs.select("old_id"), "old_id", "left_anti")
    gone = lost.select("uri", F.when(F.col("was_orphan"), "deleted").otherwise("orphaned").alias("action"), "old_id", F.lit(None).cast("long").alias("new_pos"), F.lit(False).alias("changed"))
    return kept.unionByName(gone)


def outcome(plan: DataFrame) -> DataFrame:
    """Counts of each action by file."""
    names = ["unchanged", "updated", "renamed", "inserted", "orphaned", "deleted"]
    return plan.groupBy("uri").agg(*[F.count_if(F.col("action") == a).alias(a) for a in names])


def reconcile(nodes: DataFrame, edges: DataFrame, cache: DataFrame, marks: DataFrame, symbols: DataFrame, uris: DataFrame, last: tuple[int, int] = (0, 0)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Bring the files ``(uri)`` to what ``symbols`` say; a file without symbols is gone.

    ``symbols`` are flat rows with ``pos``, ``parent_pos``, ``language``, ``is_external`` and ``signature_hash``. Matched rows keep
    id, construct, signature, language and origin. Inserted symbols are upserted: those of one name are one node, and one
    whose name or place some node has takes its id. Old rows that a symbol takes over so are neither orphaned nor deleted; one whose place goes to
    another name's row is deleted. New ids follow ``last``, the greatest of nodes and edges so far. Returns nodes, edges, cache, marks and the plan.
    """
    from .store import top_id

    out, contained, said, cache, marks, plan = settle(nodes, edges.where(HELD), cache, marks, symbols, uris, (last[0], top_id(edges, last[1])))
    # Only those of containment meet the new ones and are written; the others go on as they are, each reader taking the columns that it needs.
    return out, met(edges.where(FREE).unionByName(contained), said, FREE), cache, marks, plan


#: Edges of containment, which follow the symbols; the others follow what is said of their ends.
HELD, FREE = "edge_type <=> 'contains'", "NOT edge_type <=> 'contains'"


def met(rows: DataFrame, said: DataFrame, which: str) -> DataFrame:
    """Edges after those that are meant met what is ``said`` ``(id, dead)`` of their ends, once at each end; they lie by their sources."""
    columns = rows.columns
    for end in ("dst_id", "src_id"):
        rows = rows.join(said.select(F.col("id").alias("_end"), F.col("dead").alias("_dead")), F.expr(which) & (F.col(end) == F.col("_end")), "left").where("not coalesce(_dead, false)")
        rows = rows.withColumn("valid", F.col("valid") & F.col("_dead").isNull()).drop("_end", "_dead")
    return rows.select(*columns)


def settle(nodes: DataFrame, contained: DataFrame, cache: DataFrame, marks: DataFrame, symbols: DataFrame, uris: DataFrame, last: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``reconcile`` but for edges other than those of containment: nodes, edges of containment, what is said ``(id, dead)`` of the ends of the others, cache, marks and the plan."""
    from .store import PHYSICAL_KEY, delete_nodes, drop_callee_hashes, upsert_edges, upsert_nodes
    from .tables import written

    touched = uris.select("uri").distinct()
    old = nodes.join(touched, "uri", "left_semi")
    new = symbols.join(touched, "uri", "left_semi")
    plan = written(plan_reconcile(old, new), "plan")
    cache = drop_callee_hashes(cache, nodes, touched)

    facts = ["fqn", "name", "kind", "node_kind", "detail", "signature_hash", *BOUNDS]
    held = plan.where("old_id is not null and new_pos is not null").select("uri", "new_pos", F.col("old_id").alias("id"))
    update = new.withColumnRenamed("pos", "new_pos").join(held, ["uri", "new_pos"]).select("id", *[F.col(c).alias(f"_{c}") for c in facts], F.lit(True).alias("_hit"))
    # An upserted symbol that takes such a row over makes it valid again.
    orphans = plan.where("action = 'orphaned'").select(F.col("old_id").alias("id"), F.lit(True).alias("_orphan"))
    out = nodes.join(update, "id", "left").join(orphans, "id", "left")
    for c in facts:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)))
    out = out.withColumn("valid", F.when(F.col("_orphan"), False).when(F.col("_hit"), True).otherwise(F.col("valid")))
    out = out.withColumn("orphan", F.when(F.col("_orphan"), True).when(F.col("_hit"), False).otherwise(F.col("orphan"))).select(*nodes.columns)

    added = new.withColumnRenamed("pos", "new_pos").join(plan.where("action = 'inserted'").select("uri", "new_pos"), ["uri", "new_pos"], "left_semi")
    null = F.lit(None).cast("string")
    made = added.select(
        F.lit(None).cast("long").alias("id"), "fqn", "uri", "name", "language", "kind", "node_kind", null.alias("construct"), F.lit(None).cast("long").alias("container_id"), *BOUNDS, null.alias("signature"),
        null.alias("documentation"), "detail", "signature_hash", F.lit(True).alias("valid"), F.lit(False).alias("orphan"), F.lit(0).cast("long").alias("generation"), "is_external", "new_pos",
    )
    made = written(made, "made")
    upserted, displaced = upsert_nodes(written(out, "kept"), made.select(*nodes.columns, "new_pos"), "new_pos", last[0])
    out = written(upserted, "upserted")
    named, placed_at = out.select("fqn", F.col("id").alias("_named")), out.groupBy(*PHYSICAL_KEY).agg(F.min("id").alias("_placed"))
    numbered = made.join(named, "fqn", "left").join(placed_at, PHYSICAL_KEY, "left").select("uri", "new_pos", F.coalesce("_named", "_placed").alias("id"))
    numbered = written(numbered, "inserted")

    ids = held.select("uri", "new_pos", "id").unionByName(numbered.select("uri", "new_pos", "id"))
    parents = new.where("parent_pos is not null").select("uri", F.col("pos").alias("new_pos"), "parent_pos")
    linked = parents.join(ids, ["uri", "new_pos"]).join(ids.select("uri", F.col("new_pos").alias("parent_pos"), F.col("id").alias("_container")), ["uri", "parent_pos"])
    # Symbols of one name are one node: the last one's container counts.
    latest = linked.groupBy("id").agg(F.max_by("_container", "new_pos").alias("_container"))
    placed = ids.select("id").distinct().join(latest, "id", "left").withColumn("_seen", F.lit(True))
    out = out.join(placed, "id", "left").withColumn("container_id", F.when(F.col("_seen"), F.col("_container")).otherwise(F.col("container_id"))).select(*nodes.columns)

    none = F.lit(None)
    contains = linked.select(
        none.cast("long").alias("id"), F.col("_container").alias("src_id"), F.col("id").alias("dst_id"), F.lit("contains").alias("edge_type"), none.cast("string").alias("site_uri"),
        *[none.cast("long").alias(c) for c in ("site_start_line", "site_start_col", "site_end_line", "site_end_col")], F.lit(True).alias("valid"),
    ).where("src_id != dst_id")
    dead = plan.where("action = 'deleted'").select(F.col("old_id").alias("id")).join(numbered.select("id"), "id", "left_anti").unionByName(displaced)
    dead = written(dead.distinct(), "dead")
    said = plan.where("changed").select(F.col("old_id").alias("id"), F.lit(False).alias("dead")).unionByName(dead.withColumn("dead", F.lit(True))).groupBy("id").agg(F.max("dead").alias("dead"))
    said = written(said, "said")

    for end in ("src_id", "dst_id"):
        contains = contains.join(dead.withColumnRenamed("id", end), end, "left_anti")
    kept = written(met(contained, said, HELD), "contained")
    kept = upsert_edges(kept, contains.select(*contained.columns), last[1])
    out, _, cache, marks = delete_nodes(out, contained.limit(0), cache, marks, dead)
    return out, kept, said, cache, marks, plan


def with_places(flat: DataFrame) -> DataFrame:
    """Indexed symbols with ``pos``, their number in a file's depth-first order, and their parent's ``parent_pos``."""
    placed = flat.withColumn("pos", F.row_number().over(Window.partitionBy("uri").orderBy("path")).cast("long") - 1)
    up = placed.select("uri", F.col("path").alias("parent_path"), F.col("pos").alias("parent_pos"))
    return placed.join(up, ["uri", "parent_path"], "left").drop("path", "parent_path")


def answered(files: DataFrame, answers: DataFrame, root_uri: str) -> tuple[DataFrame, DataFrame]:
    """The symbols, and the files ``(uri)`` to reconcile by them, of changed files ``(uri, removed)`` and their captured answers ``(uri, symbols)``.

    A removed file has no symbols; one whose answer is missing or broken is not to be reconciled.
    """
    from ..sources import facts
    from .tables import written

    good = answers.join(files.where("not removed").select("uri").distinct(), "uri", "left_semi").where("try_parse_json(symbols) is not null")
    symbols = written(with_places(facts.index_symbols(facts.flatten_symbols(good, root_uri), root_uri)), "symbols")
    return symbols, good.select("uri").unionByName(files.where("removed").select("uri")).distinct()


def reconcile_answers(nodes: DataFrame, edges: DataFrame, cache: DataFrame, marks: DataFrame, files: DataFrame, answers: DataFrame, root_uri: str, last: tuple[int, int] = (0, 0)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``reconcile`` for what is ``answered`` of changed files."""
    return reconcile(nodes, edges, cache, marks, *answered(files, answers, root_uri), last)


def catch_up(uris: DataFrame, attempt: Callable[[DataFrame], DataFrame], retries: int = 5, delay: float = 2.0) -> DataFrame:
    """Reconcile files ``(uri)`` after a start, and the run's tallies ``(checked, failures, skipped)`` in one row.

    ``attempt`` takes files and returns their ``(uri, state)``: ``committed``, ``failed``, or ``waiting`` for those that look
    suspiciously empty or whose source is down. These are tried again, ``delay`` seconds apart; what still waits is skipped and stays as it is.
    """
    from .tables import written

    pending = written(uris.select("uri").distinct(), "pending")
    checked, failures = pending.count(), 0
    for turn in range(retries + 1):
        if turn:
            time.sleep(delay)
        got = written(attempt(pending).select("uri", "state"), "attempt")
        failures += got.where("state = 'failed'").count()
        pending = got.where("state = 'waiting'").select("uri")
        if pending.isEmpty():
            break
    return uris.sparkSession.createDataFrame([(checked, failures, pending.count())], "checked long, failures long, skipped long")


def drift(found: DataFrame, stored: DataFrame, known: DataFrame) -> DataFrame:
    """What a start-up scan has to do: ``(uri, state)``.

    ``found`` is ``(uri, text)`` of files that are there, ``stored`` their ``(uri, hash)`` from the last run, and
    ``known`` the graph's ``(uri)``. A file whose hash is stored is skipped; one that is gone never is.
    """
    return _drift_states(found.select("uri", T.content_hash(F.col("text")).alias("now")), stored, known)


def _drift_states(now: DataFrame, stored: DataFrame, known: DataFrame) -> DataFrame:
    """``drift`` by the files' hashes ``(uri, now)``."""
    seen = stored.select("uri", F.col("hash").alias("before"))
    both = now.join(known.select("uri", F.lit(True).alias("known")).distinct(), "uri", "full").join(seen.hint("merge"), "uri", "left")
    state = F.when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("before"), "skipped").when(F.col("before").isNull(), "new").otherwise("changed")
    return both.select("uri", state.alias("state"))


def suspiciously_empty(symbols: DataFrame, nodes: DataFrame, uris: DataFrame, root_uri: str) -> DataFrame:
    """Files that are there and had symbols but now show none: their reconciliation must not be committed yet."""
    module = T.module_path(F.col("uri"), root_uri)
    had = nodes.where(~F.col("orphan") & (F.col("fqn") != module)).select("uri").distinct()
    has = symbols.where(F.col("fqn") != module).select("uri").distinct()
    return uris.select("uri").distinct().join(had.hint("merge"), "uri", "left_semi").join(has.hint("merge"), "uri", "left_anti")


#: Settings that hold the hash of a file as of its last commit at a start.
STORED = "startup_hash:"


def start_up(store, found: DataFrame, fetch: Callable[[DataFrame], DataFrame], root_uri: str, retries: int = 5, delay: float = 2.0, adapters: tuple[LanguageAdapter, ...] = BUILT_IN) -> tuple[DataFrame, DataFrame]:
    """Bring a snapshot store to what the files ``found (uri, text)`` are now, after a time in which nobody watched them.

    Candidates are the files there are and those that the graph knows. One whose content hash is stored is not looked at. ``fetch`` gives the answers ``(uri, symbols)`` of the others
    ``(uri)``: no row means that the source is not there, and an answer that is no JSON is a failure, which leaves the file as it is. A file that is there and had symbols, but now shows none, and one
    whose source is not there, wait: only they are asked for again, ``retries`` times and ``delay`` seconds apart, and then stay as they are. A file that is gone loses its symbols.
    What has a row for each file is joined by merging, as the size of its files would let several times that much be broadcast, at each join and in each pass.
    Each pass commits graph and hashes as one version, so a run that dies before it leaves both as they were, and the next takes these files up again.

    Returns ``(uri, state)``, state being unsupported, unchanged, committed, removed, failed or held, and one row ``(checked, failures, skipped)``.
    """
    from ..sources import facts
    from .store import merge_keyed
    from .symbols import known_uris
    from .tables import written

    uris = written(found.select("uri").unionByName(known_uris(store.read().nodes)).distinct(), "candidates")
    passes: list[DataFrame] = []

    def attempt(pending: DataFrame) -> DataFrame:
        now = store.read()
        owned = pending.where(route_language(F.col("uri"), adapters).isNotNull())
        stored = now.index_meta.where(F.col("key").startswith(STORED)).select(F.substring("key", len(STORED) + 1, 1 << 30).alias("uri"), F.col("value").alias("hash"))
        # Texts are read once for their hashes, and before the join, so that no text crosses its shuffle.
        hashed = found.select("uri", T.content_hash(F.col("text")).alias("now"))
        hashes = written(hashed.join(owned.hint("merge"), "uri", "left_semi").groupBy("uri").agg(F.min("now").alias("now")), "hashes")
        states = written(_drift_states(hashes, stored, owned), "drift")
        asked = states.where("state in ('new', 'changed')").select("uri")
        answers = written(fetch(asked).select("uri", "symbols").join(asked.hint("merge"), "uri", "left_semi").groupBy("uri").agg(F.first("symbols").alias("symbols"), F.lit(True).alias("answered")), "answers")
        good = answers.select("uri", F.coalesce("symbols", F.lit("[]")).alias("symbols")).where("try_parse_json(symbols) is not null")
        flat = written(with_places(facts.index_symbols(facts.flatten_symbols(good, root_uri), root_uri)), "symbols")
        empty = written(suspiciously_empty(flat, now.nodes, good, root_uri), "empty")
        gone = states.where("state = 'deleted'").select("uri")
        took = written(good.select("uri").join(empty.hint("merge"), "uri", "left_anti"), "took")
        if not (took.isEmpty() and gone.isEmpty()):
            symbols = flat.join(took.hint("merge"), "uri", "left_semi")
            nodes, edges, cache, marks, _ = reconcile(now.nodes, now.edges, now.callees_cache, now.materialized, symbols, took.unionByName(gone), now.last_ids())
            # A file that is gone has the empty hash, which no content has: one that comes back is looked at.
            fresh = took.join(hashes.hint("merge"), "uri").select("uri", "now").unionByName(gone.select("uri", F.lit("").alias("now")))
            meta = merge_keyed(now.index_meta, fresh.select(F.concat(F.lit(STORED), "uri").alias("key"), F.col("now").alias("value")), ["key"])
            store.commit(nodes=nodes, edges=edges, callees_cache=cache, materialized=marks, index_meta=meta)
        ok = took.withColumn("ok", F.lit(True))
        held = empty.withColumn("empty", F.lit(True))
        told = pending
        for side in (states, answers.select("uri", "answered"), ok, held):
            told = told.join(side.hint("merge"), "uri", "left")
        state = (
            F.when(F.col("state").isNull(), "unsupported").when(F.col("state") == "deleted", "removed").when(F.col("state") == "skipped", "unchanged")
            .when(F.col("ok"), "committed").when(F.col("answered").isNull() | F.col("empty"), "waiting").otherwise("failed")
        )
        passes.append(written(told.select("uri", state.alias("state"), F.lit(len(passes)).alias("turn")), "pass"))
        return passes[-1]

    tallies = catch_up(uris, attempt, retries, delay)
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    last = every.groupBy("uri").agg(F.max_by("state", "turn").alias("state"))
    return last.select("uri", F.when(F.col("state") == "waiting", "held").otherwise(F.col("state")).alias("state")), tallies
