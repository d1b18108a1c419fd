"""Operators on hand-made graphs."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sorrel.functions import text as T
from sorrel.functions.adapters import BUILT_IN, custom_adapters, is_external, route_language
from sorrel.operators import locate, materialize, paging, paths, reconcile, relations, search, store, symbols
from sorrel.plans import schema
from sorrel.sources import facts, files

END = schema.END


def node(i, fqn, start, end, uri="file:///repo/m.py", kind=12, sel=4, **more):
    row = {
        "id": i, "fqn": fqn, "uri": uri, "name": fqn.rpartition(".")[2], "language": "python", "kind": kind, "node_kind": "Function", "construct": None, "container_id": None,
        "range_start_line": start, "range_start_col": 0, "range_end_line": end, "range_end_col": 0, "sel_start_line": start, "sel_start_col": sel, "sel_end_line": start, "sel_end_col": sel + 6,
        "signature": None, "documentation": None, "detail": None, "signature_hash": f"h{i}", "valid": True, "orphan": False, "generation": 0, "is_external": False,
    }
    return row | more


def edge(i, src, dst, kind="calls", line=7, valid=True, uri="file:///repo/m.py"):
    return (i, src, dst, kind, uri, line, 4, line, 10, valid)


def frame(spark, rows):
    names = [c.split()[0] for c in schema.NODES.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema.NODES)


def edges_of(spark, rows):
    return spark.createDataFrame(rows, schema.EDGES)


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize(("mode", "pattern", "case", "hits"), [
    ("segment", "repo", False, {"app.repo.Repo", "app.repo.helper"}), ("segment", "REPO", True, {"app.repo.Repo", "app.repo.helper"}), ("contains", "repo", False, {"app.repo.Repo", "app.repos.X", "app.repo.helper"}),
    ("exact", "app.repos.X", False, {"app.repos.X"}), ("fuzzy", "helpr", False, {"app.repo.helper"}), ("fuzzy", "zzz", False, set()), ("contains", "", False, {"app.repo.Repo", "app.repos.X", "app.repo.helper"}),
])
def test_match_modes(spark, mode, pattern, case, hits):
    df = spark.createDataFrame([("app.repo.Repo",), ("app.repos.X",), ("app.repo.helper",)], "fqn string")
    assert {r.fqn for r in df.where(T.matches(F.col("fqn"), pattern, mode, case)).collect()} == hits


def test_scalars(spark):
    get = lambda v, f, kind="string": one(spark, v, kind).select(f(F.col("x")).alias("y")).first().y
    assert get("file:///repo/app/repo.py", lambda c: T.module_path(c, "file:///repo")) == "app.repo"
    assert get("file:///repo/app/repo.py", lambda c: T.module_path(c, "file:///repo/")) == "app.repo"
    assert get("file:///repo/pkg/mod.tsx", lambda c: T.module_path(c, "file:///repo")) == "pkg.mod"
    assert get("(method) def greet(self: Self@Greeter)", T.construct_from_hover) is None
    assert get("```typescript\nexport type A = string\n```\ndoc", T.construct_from_hover) == "type"
    assert get("", T.construct_from_hover) is None
    assert [get(k, T.symbol_kind, "bigint") for k in (1, 26, 0, 99, None)] == ["File", "TypeParameter", "Unknown(0)", "Unknown(99)", None]
    assert get(END, T.shown_number, "bigint") == 4294967295
    assert get("a.b.c", T.container_prefix) == "a.b" and get("a", T.container_prefix) == ""
    assert get("a　 ", T.trimmed) == "a"
    assert get("/x", T.path_to_uri) == "file:///x"


def test_line_slices(spark):
    f = spark.createDataFrame([("u", "a\nb\r\nc\nd\ne\n"), ("e", "")], "uri string, text string")
    asked = spark.createDataFrame([("u", 1, 3), ("u", 100, 110), ("u", None, None), ("u", 3, 1), ("e", None, None)], "uri string, start_line int, end_line int")
    got = {(r.uri, r.start_line, r.end_line): (r.content, r.total_lines) for r in files.read_range(f, asked).collect()}
    assert got[("u", 1, 3)] == ("b\nc", 5) and got[("u", 100, 110)] == ("", 5) and got[("u", 3, 1)] == ("", 5)
    assert got[("u", 0, 2**31 - 1)] == ("a\nb\nc\nd\ne", 5) and got[("e", 0, 2**31 - 1)] == ("", 0)


def test_adapters(spark):
    more = custom_adapters({"SORREL_CUSTOM_LANGUAGES": "Ruby, none", "SORREL_LSP_RUBY_EXTENSIONS": ".RB", "SORREL_LSP_RUBY_EXTERNAL_MARKERS": "/gems/"})
    assert [a.name for a in more] == ["ruby"]
    df = spark.createDataFrame([("file:///r/a.PY",), ("file:///r/gems/a.rb",), ("file:///r/a",), ("file:///x/a.go",), ("file:///r/node_modules/a.py",)], "uri string")
    lang = route_language(F.col("uri"), BUILT_IN + more)
    got = [(r.a, r.b) for r in df.select(lang.alias("a"), is_external(F.col("uri"), "file:///r/", lang, BUILT_IN + more).alias("b")).collect()]
    assert got == [("python", False), ("ruby", True), (None, False), ("go", True), ("python", False)]


def test_pages_and_cursors(spark):
    nodes = frame(spark, [node(1, "repo.helper", 0, 2), node(2, "repo.caller", 6, 8), node(3, "repo.gone", 9, 9, valid=False), node(4, "ext.x", 0, 1, is_external=True)])
    first = symbols.find_symbol(nodes, "", "contains", limit=1).collect()
    assert [r.fqn for r in first] == ["repo.caller"]
    cursor = paging.next_cursor(first)
    second = symbols.find_symbol(nodes, "", "contains", limit=1, cursor=cursor).collect()
    assert [r.fqn for r in second] == ["repo.helper"] and paging.next_cursor(second) is None
    assert [r.fqn for r in symbols.hints(nodes, "repo.helpr").collect()] == ["repo.helper"]
    for bad in ("!", "e30", "bnVsbA"):
        with pytest.raises(ValueError):
            paging.Cursor.decode(bad)
    assert [paging.clamp_limit(n) for n in (None, 0, 9999, 7)] == [100, 1, 500, 7]
    shown = json.loads(symbols.result_json(symbols.node_result(nodes.where("id = 1"))).first().json)
    assert "signature" not in shown and shown["range"]["end"]["line"] == 2


def test_innermost_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    spans = [(i, f"f{rng.randrange(2)}", a, rng.randrange(4), a + rng.choice([0, 0, 1, 3, 40, -2]), rng.randrange(4)) for i, a in enumerate(rng.choices(range(-5, 140), k=150))]
    spans += [(900, "f0", 0, 0, 2**40, 0), (901, "f1", -(2**40), 0, 2**40, 0), (902, "f0", None, 0, 3, 0), (903, None, 0, 0, 9, 0)]
    points = [(f"f{rng.randrange(3)}", rng.choice([*range(-8, 150), 2**39]), rng.randrange(5)) for _ in range(400)] + [(None, 1, 1), ("f0", None, 1), ("f0", 1, None)]
    want = {}
    for uri, line, char in points:
        if None not in (uri, line, char):
            around = [((e - s, ec - sc), i) for i, u, s, sc, e, ec in spans if u == uri and s is not None and (s, sc) <= (line, char) <= (e, ec)]
            want |= {(uri, line, char): min(around)[1]} if around else {}
    names = "id long, uri string, range_start_line long, range_start_col long, range_end_line long, range_end_col long"
    got = locate.innermost(spark.createDataFrame(points * 2, "uri string, line long, character long"), spark.createDataFrame(spans, names)).collect()
    assert len(want) > 100 and sorted(got) == sorted((*k, v) for k, v in want.items())


def test_the_first_target_that_resolves_is_meant(spark):
    u = "file:///repo/m.py"
    nodes = frame(spark, [node(3, "m.a", 0, 2), node(7, "m.b", 5, 7), node(9, "m.c", 20, 30)])
    say = lambda *at: [{"uri": u, "range": {"start": {"line": a, "character": 4}, "end": {"line": a, "character": 5}}} for a in at]
    asked = [(25, say(99, 5, 0, 6)), (26, say(99)), (99, say(98)), (27, say(1, 1))]
    found = facts.locations(spark.createDataFrame([("definition", u, line, 0, json.dumps(a)) for line, a in asked], "op string, uri string, line long, character long, answer string"))
    requests = spark.createDataFrame([(u, line, 0) for line, _ in asked], "uri string, line long, character long")
    assert sorted((r.line, r.rank, r.node_id) for r in locate.find_definition(requests, found, nodes).collect()) == [(25, 1, 7), (25, 2, 3), (25, 3, 7), (27, 0, 3), (27, 1, 3)]
    assert {(r.line, r.anchor_id) for r in locate.resolve_anchors(requests, found, nodes).collect()} == {(25, 7), (26, 9), (27, 3)}
    unranked = found.drop("rank")
    assert {(r.line, r.anchor_id) for r in locate.resolve_anchors(requests, unranked, nodes).collect()} == {(25, 3), (26, 9), (27, 3)}


def test_innermost(spark):
    nodes = frame(spark, [node(1, "m.C", 0, 10), node(2, "m.C.f", 2, 4), node(3, "o.g", 0, 3, uri="file:///repo/o.py")])
    points = spark.createDataFrame([("file:///repo/m.py", 3, 0), ("file:///repo/m.py", 9, 0), ("file:///repo/o.py", 50, 0), ("file:///repo/none.py", 0, 0)], "uri string, line long, character long")
    assert {(r.line, r.node_id) for r in locate.innermost(points, nodes).collect()} == {(3, 2), (9, 1)}


@pytest.fixture(scope="module")
def chain(spark):
    nodes = frame(spark, [node(i, f"repo.{n}", line, line + 5) for i, (n, line) in enumerate([("a", 0), ("b", 10), ("c", 20), ("d", 30), ("z", 40)], 1)])
    return nodes.cache(), edges_of(spark, [edge(1, 1, 2), edge(2, 2, 3), edge(3, 3, 4), edge(4, 1, 3, valid=False)]).cache()


def test_call_paths(spark, chain):
    nodes, edges = chain
    calls = paths.CallIndex.build(edges, nodes, buckets=8)
    find = lambda a, b, **k: paths.find_call_path(calls, a, b, **k)
    assert find(1, 1) == paths.CallPath(True, [1], False)
    assert find(1, 2).path == [1, 2]
    assert find(1, 4).path == [1, 2, 3, 4]
    assert find(1, 5) == paths.CallPath(False, [], False)
    assert find(1, 4, max_depth=1) == paths.CallPath(False, [], True)
    assert find(1, 3, max_depth=2).path == [1, 2, 3]
    stale = spark.createDataFrame([(1,), (2,)], "anchor_id long")
    assert find(1, 5, stale=stale, budget=1) == paths.CallPath(False, [], True)
    assert find(1, 5, stale=stale, budget=2) == paths.CallPath(False, [], False)
    assert find(1, 2, stale=stale, budget=0) == paths.CallPath(True, [1, 2], False)


def test_path_ties_follow_the_queue(spark):
    nodes = frame(spark, [node(1, "s", 0, 1), node(2, "y", 2, 3), node(3, "x", 4, 5), node(4, "t", 6, 7), node(5, "a", 8, 9)])
    edges = edges_of(spark, [edge(1, 1, 2), edge(2, 1, 3), edge(3, 2, 4), edge(4, 3, 4), edge(5, 2, 5), edge(6, 3, 5), edge(7, 5, 1)])
    many = spark.createDataFrame([(0, 1, 4), (1, 1, 5), (2, 4, 1)], "request long, start_id long, target_id long")
    got = {r.request: (r.reachable, r.path) for r in paths.find_call_paths(paths.CallIndex.build(edges, nodes, buckets=4), many).collect()}
    assert got == {0: (True, [1, 3, 4]), 1: (True, [1, 3, 5]), 2: (False, [])}


def test_a_search_reads_its_own_buckets(spark, tmp_path):
    nodes = frame(spark, [node(i, f"m.n{1000 - i}", 2 * i, 2 * i + 1) for i in range(1, 200)])
    edges = edges_of(spark, [edge(i, i, i + 1) for i in range(1, 199)] + [edge(900, 1, 50)])
    calls = paths.CallIndex.build(edges, nodes, f"file://{tmp_path}/c", 64)
    plan = calls.callees(spark.createDataFrame([(1,), (2,)], "id long"))
    read = {r[0] for r in plan.select(F.input_file_name()).distinct().collect()}
    assert len({f.split("bucket=")[1].split("/")[0] for f in read}) <= 2 and all("/c/links/" in f for f in read), "two buckets, and no other table"
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan parquet") == 1 and "bucket" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert {(r.src_id, r.dst_id) for r in plan.where("src_id < 3").collect()} == {(1, 2), (1, 50), (2, 3)}
    assert paths.find_call_path(calls, 1, 52) == paths.CallPath(True, [1, 50, 51, 52], False)
    # A caller whose calls have changed since.
    calls.change(spark.createDataFrame([(50,)], "id long"), edges.where("src_id != 50").unionByName(edges_of(spark, [edge(901, 50, 52)])))
    assert paths.find_call_path(calls, 1, 52) == paths.CallPath(True, [1, 50, 52], False)
    assert paths.find_call_path(calls, 1, 51) == paths.CallPath(False, [], True)
    assert {(r.id, r.depth) for r in paths.reachable_within(calls, spark.createDataFrame([(1,)], "start_id long"), 2).collect()} == {(1, 0), (2, 1), (50, 1), (3, 2), (52, 2)}


def test_edge_merges(spark):
    held = edges_of(spark, [edge(5, 1, 2, valid=False), (6, 1, 3, "contains", None, None, None, None, None, True)])
    batch = edges_of(spark, [edge(None, 1, 2), edge(None, 1, 2), edge(None, 1, 2, line=8), (None, 1, 3, "contains", None, None, None, None, None, True)])
    out = store.upsert_edges(held, batch).collect()
    assert {(r.id, r.dst_id, r.site_start_line, r.valid) for r in out} == {(5, 2, 7, True), (6, 3, None, True), (7, 2, 8, True)}


def test_node_merges(spark):
    held = frame(spark, [node(1, "a", 0, 1, construct="type"), node(2, "b", 5, 6)])
    batch = frame(spark, [node(10, "a", 3, 4), node(11, "c", 5, 6, name="b"), node(12, "d", 9, 9), node(13, "d", 9, 10)])
    got = {(r.id, r.fqn, r.range_start_line, r.range_end_line, r.construct) for r in store.upsert_nodes(held, batch)[0].collect()}
    assert got == {(1, "a", 3, 4, None), (2, "c", 5, 6, None), (3, "d", 9, 10, None)}


def test_node_merges_keep_both_keys(spark):
    # The name moves and another takes its old place; two rows at one place; an old row whose place is taken; a swap.
    held = frame(spark, [node(1, "m.a", 1, 2), node(2, "m.B.x", 20, 21), node(3, "m.C.x", 30, 31), node(4, "m.s", 40, 41, name="v"), node(5, "m.t", 50, 51, name="v")])
    batch = frame(spark, [
        node(10, "m.a", 5, 6), node(11, "m.A.a", 1, 2), node(12, "p.y", 60, 61), node(13, "q.y", 60, 62), node(14, "m.C.x", 20, 21), node(15, "m.s", 50, 51, name="v"), node(16, "m.t", 40, 41, name="v"),
    ])
    got = {(r.id, r.fqn, r.range_start_line) for r in store.upsert_nodes(held, batch)[0].collect()}
    assert got == {(1, "m.a", 5), (6, "m.A.a", 1), (7, "q.y", 60), (3, "m.C.x", 20), (4, "m.s", 50), (5, "m.t", 40)}


def test_settings(spark):
    meta = store.merge_keyed(spark.createDataFrame([("a", "1"), ("b", "2")], schema.META), spark.createDataFrame([("a", "3")], schema.META), ["key"])
    assert (store.get_meta(meta, "a"), store.get_meta(meta, "b"), store.get_meta(meta, "c")) == ("3", "2", None)


def symbol(pos, fqn, start, end, parent=None, kind=12, hash_="h", uri="file:///repo/m.py", detail=None):
    return (uri, pos, parent, fqn, fqn.rpartition(".")[2], kind, "Function", detail, start, 0, end, 0, start, 4, start, 10, "python", False, hash_)


SYMBOL = (
    "uri string, pos long, parent_pos long, fqn string, name string, kind long, node_kind string, detail string, range_start_line long, range_start_col long, range_end_line long, range_end_col long, "
    "sel_start_line long, sel_start_col long, sel_end_line long, sel_end_col long, language string, is_external boolean, signature_hash string"
)


def run(spark, nodes, edges, new, cache=(), marks=()):
    c = spark.createDataFrame(list(cache), schema.CALLEES_CACHE)
    m = spark.createDataFrame(list(marks), schema.MATERIALIZED)
    uris = spark.createDataFrame([("file:///repo/m.py",)], "uri string")
    n, e, c, m, plan = reconcile.reconcile(nodes, edges, c, m, spark.createDataFrame(new, SYMBOL), uris)
    count = {k: v for k, v in (reconcile.outcome(plan).drop("uri").first() or spark.createDataFrame([(0,)], "unchanged int").first()).asDict().items() if v}
    return {r.fqn: r for r in n.collect()}, {(r.src_id, r.dst_id, r.edge_type): r for r in e.collect()}, {r.anchor_id for r in c.collect()}, {r.anchor_id for r in m.collect()}, count


def test_reconcile(spark):
    nodes = frame(spark, [node(1, "m.old_name", 0, 3, signature_hash="h", construct="def"), node(2, "m.same", 10, 12, signature_hash="h"), node(3, "m.was", 20, 22, orphan=True, valid=False, signature_hash="h"), node(4, "m.twice", 50, 51, orphan=True, valid=False), node(5, "m.once", 60, 61), node(9, "o.x", 0, 1, uri="file:///repo/o.py", container_id=4)])
    edges = edges_of(spark, [edge(1, 1, 9), edge(2, 2, 9), edge(3, 4, 9)])
    new = [symbol(0, "m.new_name", 0, 3), symbol(1, "m.same", 14, 16), symbol(2, "m.was", 20, 22), symbol(3, "m.added", 70, 75, parent=1)]
    n, e, c, m, count = run(spark, nodes, edges, new, [(2, "x"), (9, "y")], [(4, "calls"), (2, "calls")])
    assert count == {"renamed": 1, "unchanged": 2, "inserted": 1, "deleted": 1, "orphaned": 1}
    assert (n["m.new_name"].id, n["m.new_name"].construct, n["m.new_name"].valid) == (1, "def", True)
    assert n["m.same"].range_start_line == 14
    assert (n["m.was"].id, n["m.was"].orphan, n["m.was"].valid) == (3, False, True)
    assert (n["m.once"].orphan, n["m.once"].valid) == (True, False) and "m.twice" not in n
    assert (n["m.added"].id, n["m.added"].container_id) == (10, 2) and n["o.x"].container_id is None
    assert not e[(1, 9, "calls")].valid and e[(2, 9, "calls")].valid and (4, 9, "calls") not in e and e[(2, 10, "contains")].valid
    assert (c, m) == ({9}, {2})


def test_reconcile_upserts_what_it_inserts(spark):
    nodes = frame(spark, [node(1, "m.a", 0, 1, uri="file:///repo/m.ts"), node(2, "m.Old.f", 30, 31), node(3, "m.n", 60, 61)])
    new = [symbol(0, "m.n.f", 10, 11), symbol(1, "m.n.f", 12, 13), symbol(2, "m.a", 20, 21), symbol(3, "m.New.f", 30, 31)]
    n, e, _, _, count = run(spark, nodes, edges_of(spark, []), new)
    assert {(f, r.id, r.uri[-4:], r.range_start_line, r.orphan) for f, r in n.items()} == {("m.n.f", 4, "m.py", 12, False), ("m.a", 1, "m.py", 20, False), ("m.New.f", 2, "m.py", 30, False), ("m.n", 3, "m.py", 60, True)}
    assert count == {"inserted": 4, "orphaned": 2}


def test_reconciled_edges_are_not_written(spark, tmp_path):
    """Edges other than containment go through as they are read, so that only the columns a reader asks for cross the shuffles by their ends."""
    nodes = frame(spark, [node(1, "m.a", 0, 3, signature_hash="h"), node(2, "m.b", 10, 12, signature_hash="h"), node(3, "m.was", 20, 22, orphan=True, valid=False), node(9, "o.x", 0, 1, uri="file:///repo/o.py")])
    edges_of(spark, [edge(1, 1, 9), edge(2, 9, 2), edge(3, 9, 3), edge(4, 3, 3), edge(5, 9, 9), edge(6, 9, 9, None), edge(7, 9, 1, "contains"), edge(8, 3, 9, "contains")]).write.parquet(path := f"{tmp_path}/edges")
    none = spark.createDataFrame([], schema.CALLEES_CACHE), spark.createDataFrame([], schema.MATERIALIZED)
    new = spark.createDataFrame([symbol(0, "m.a", 0, 3), symbol(1, "m.b", 10, 12, hash_="other")], SYMBOL)
    e = reconcile.reconcile(nodes, spark.read.parquet(path), *none, new, spark.createDataFrame([("file:///repo/m.py",)], "uri string"))[1]
    assert {(r.id, r.valid) for r in e.collect()} == {(1, True), (2, False), (5, True), (6, True), (7, True)}
    assert [f for f in e.where("edge_type = 'calls'").inputFiles() if path in f]


def test_catching_up_retries_what_waits(spark):
    asked = []

    def attempt(files):
        asked.append({r.uri for r in files.collect()})
        state = F.when(F.col("uri") == "bad", "failed").when((F.col("uri") == "slow") & F.lit(len(asked) < 3) | (F.col("uri") == "never"), "waiting").otherwise("committed")
        return files.select("uri", state.alias("state"))

    uris = spark.createDataFrame([("a",), ("bad",), ("slow",), ("never",), ("a",)], "uri string")
    assert reconcile.catch_up(uris, attempt, retries=3, delay=0).first().asDict() == {"checked": 4, "failures": 1, "skipped": 1}
    assert asked == [{"a", "bad", "slow", "never"}, {"slow", "never"}, {"slow", "never"}, {"never"}]


def test_rename_choice_is_best_first(spark):
    old = frame(spark, [node(1, "m.a", 0, 3), node(2, "m.b", 2, 5), node(3, "m.k", 1, 2, kind=5)])
    new = spark.createDataFrame([symbol(0, "m.x", 2, 6), symbol(1, "m.y", 2, 5), symbol(2, "n.z", 1, 2), symbol(3, "m.far", 9, 9)], SYMBOL)
    pairs = reconcile.exact_pairs(old, new)
    got = {(r.new_pos, r.old_id) for r in reconcile.assign_renames(reconcile.rename_candidates(old, new, pairs)).collect()}
    assert got == {(1, 2), (0, 1)}


def test_rename_rounds_equal_the_greedy_choice(spark):
    rng = random.Random(2)
    rows = {(f"f{i % 3}" if i % 10 else "one", rng.randrange(20000), rng.randrange(20000)): (rng.randrange(2), rng.randrange(4)) for i in range(30000)}
    rows |= {("one", n, o): (rng.randrange(2), rng.randrange(4)) for n in range(1000, 11000) for o in rng.sample(range(n, n + 30), 10)}
    ranked = sorted((u, -t, d, o, n) for (u, n, o), (t, d) in rows.items())
    news, olds, want = set(), set(), set()
    for u, _, _, o, n in ranked:
        if (u, n) not in news and (u, o) not in olds:
            news.add((u, n))
            olds.add((u, o))
            want.add((u, n, o))
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "uri string, new_pos long, old_id long, tier int, drift long").repartition(8)
    got = reconcile.assign_renames(df)
    assert len(rows) > 100_000 and {tuple(r) for r in got.collect()} == want
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert reconcile.assign_renames(df.limit(0)).count() == 0


def test_the_search_index_misses_nothing(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeXYZ_é0") for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + ["", "Group", "group", "Groups", "Gruop", "aaaa", "aaaaaa", "abababab"]
    rows = [node(i, f"m{i % 7}.{w}.{rng.choice(words)}", i, i, valid=i % 9 != 0, is_external=i % 8 == 0) for i, w in enumerate(words)]
    nodes = frame(spark, rows).cache()
    index = search.SearchIndex.build(nodes, f"file://{tmp_path}/s", 32)
    ids = lambda df: {r.id for r in df.collect()}
    computed = total = 0
    for want in ("Group", "gROUP", "abcde", "XYZ_é0a", "aaaaa", "a", "", "abcdeXYZ_abc", rng.choice(words), rng.choice(words)):
        for case in (False, True):
            assert ids(index.with_segment(want, case)) == ids(nodes.where(T.matches(F.col("fqn"), want, "segment", case))), (want, case)
            assert ids(index.like(want, case)) == ids(nodes.where(T.matches(F.col("fqn"), want, "fuzzy", case))), (want, case)
        if len(want) > 4:
            computed, total = computed + index.candidates(want).count(), total + index.postings.read().select("folded").distinct().count()
    assert computed < total / 100, "distances are computed for less than one segment of a hundred"
    for mode, want in (("segment", "Group"), ("fuzzy", "Groop")):
        for flt in (symbols.NodeFilter(), symbols.NodeFilter(include_external=True)):
            assert search.find_symbol(index, nodes, want, mode, node_filter=flt, limit=3).collect() == symbols.find_symbol(nodes, want, mode, node_filter=flt, limit=3).collect()
    for missing in ("x.Group", "x.Groop", "x.nothing_like_it"):
        assert search.hints(index, nodes, missing).collect() == symbols.hints(nodes, missing).collect()
    nodes.unpersist()


def test_drift_and_empty_files(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "uri string, text string")
    import hashlib

    stored = spark.createDataFrame([("a", hashlib.md5(b"1").hexdigest()), ("b", "x"), ("d", "y")], "uri string, hash string")
    known = spark.createDataFrame([("a",), ("d",)], "uri string")
    assert {(r.uri, r.state) for r in reconcile.drift(found, stored, known).collect()} == {("a", "skipped"), ("b", "changed"), ("c", "new"), ("d", "deleted")}
    nodes = frame(spark, [node(1, "m", 0, 9), node(2, "m.f", 1, 2)])
    uris = spark.createDataFrame([("file:///repo/m.py",)], "uri string")
    only_root = spark.createDataFrame([symbol(0, "m", 0, 9)], SYMBOL)
    assert reconcile.suspiciously_empty(only_root, nodes, uris, "file:///repo").count() == 1


def test_a_start_broadcasts_no_table_of_files(spark):
    files_ = spark.createDataFrame([("a", "x"), ("b", "y")], "uri string, text string")
    states = reconcile.drift(files_, spark.createDataFrame([("a", "h"), ("c", "h")], "uri string, hash string"), spark.createDataFrame([("a",), ("c",)], "uri string"))
    assert "Broadcast" not in states._jdf.queryExecution().executedPlan().toString()
    assert {(r.uri, r.state) for r in states.collect()} == {("a", "changed"), ("b", "new"), ("c", "deleted")}


def test_facts(spark):
    span = lambda a, b: {"start": {"line": a, "character": b}, "end": {"line": a, "character": b + 3}}
    tree = [{"name": "A", "kind": 5, "range": span(0, 0), "selectionRange": span(0, 6), "children": [{"name": "f", "kind": 6, "detail": "d", "range": span(1, 2), "selectionRange": span(1, 6), "children": []}, {"name": "f", "kind": 6, "range": span(2, 2), "selectionRange": span(2, 6)}]}]
    answers = spark.createDataFrame([("file:///repo/p/m.py", json.dumps(tree)), ("file:///repo/e.py", None), ("file:///repo/x.py", "{")], "uri string, symbols string")
    got = facts.flatten_symbols(answers, "file:///repo").orderBy("uri", "path").collect()
    assert [(r.fqn, r.kind) for r in got] == [("e", 2), ("p.m", 2), ("p.m.A", 5), ("p.m.A.f", 6), ("p.m.A.f", 6), ("x", 2)]
    assert got[1].range_end_line == END and got[3].detail == "d" and got[3].parent_path == got[2].path and got[2].parent_path is None
    assert facts.count_failures(answers, "symbols").first().asDict() == {"files_seen": 3, "fetch_errors": 2}
    assert facts.index_symbols(facts.flatten_symbols(answers, "file:///repo"), "file:///repo").where("node_kind = 'Method'").count() == 2

    link = [{"originSelectionRange": span(0, 0), "targetUri": "t", "targetRange": span(5, 0), "targetSelectionRange": span(5, 6)}]
    plain = [{"uri": "p", "range": span(3, 1)}]
    loc = spark.createDataFrame([("definition", "u", 0, 0, json.dumps(link)), ("references", "u", 0, 0, json.dumps(plain)), ("definition", "u", 1, 0, "null"), ("definition", "u", 2, 0, json.dumps(plain[0]))], "op string, uri string, line long, character long, answer string")
    assert {(r.op, r.line, r.target_uri, r.target_line, r.target_character) for r in facts.locations(loc).collect()} == {("definition", 0, "t", 5, 6), ("references", 0, "p", 3, 1), ("definition", 2, "p", 3, 1)}

    item = {"name": "f", "kind": 12, "uri": "i", "range": span(8, 0), "selectionRange": span(8, 4)}
    call = spark.createDataFrame([("incoming", "u", 0, 0, json.dumps([{"from": item, "fromRanges": [span(9, 1), span(10, 1)]}])), ("outgoing", "u", 0, 0, json.dumps([{"to": item, "fromRanges": []}])), ("outgoing", "u", 1, 0, None)], "direction string, uri string, line long, character long, answer string")
    assert {(r.direction, r.item_uri, r.item_line, r.item_character, len(r.from_ranges)) for r in facts.calls(call).collect()} == {("incoming", "i", 8, 4, 2), ("outgoing", "i", 8, 4, 0)}

    hover = spark.createDataFrame([("u", n, 0, json.dumps({"contents": c})) for n, c in enumerate(["plain", {"kind": "markdown", "value": "v"}, ["a", {"language": "x", "value": "b"}, ""]])] + [("u", 9, 0, "null")], "uri string, line long, character long, answer string")
    assert {(r.line, r.contents) for r in facts.hover_text(hover).collect()} == {(0, "plain"), (1, "v"), (2, "a\n\nb")}


def test_symbol_trees_of_any_depth(spark):
    at = {"start": {"line": 1, "character": 0}, "end": {"line": 2, "character": 0}}
    tree = []
    for k in reversed(range(110)):
        tree = [{"name": f"n{k}", "kind": 12, "range": at, "selectionRange": at, "children": tree}]
    answers = spark.createDataFrame([("file:///repo/m.py", json.dumps(tree)), ("file:///repo/.py", json.dumps(tree[0]["children"][:0] or tree[:1]))], "uri string, symbols string")
    got = [r.fqn for r in facts.flatten_symbols(answers, "file:///repo").collect()]
    assert len(got) == 222 and "m." + ".".join(f"n{k}" for k in range(110)) in got and ".n0" in got


def test_only_the_first_prepared_item_counts(spark):
    item = lambda line: json.dumps([{"from": {"name": "f", "kind": 12, "uri": "file:///repo/m.py", "range": {"start": {"line": line, "character": 0}, "end": {"line": line, "character": 1}}, "selectionRange": {"start": {"line": line, "character": 4}, "end": {"line": line, "character": 5}}}, "fromRanges": [{"start": {"line": line, "character": 0}, "end": {"line": line, "character": 1}}]}])
    u = "file:///repo/m.py"
    answers = spark.createDataFrame([("incoming", u, 10, 4, 1, item(0)), ("incoming", u, 10, 4, 0, item(20))], "direction string, uri string, line long, character long, item_rank long, answer string")
    nodes = frame(spark, [node(1, "m.a", 0, 3), node(2, "m.b", 10, 12), node(3, "m.c", 20, 22)])
    got = materialize.call_edges(spark.createDataFrame([(2,)], "anchor_id long"), nodes, facts.calls(answers), "incoming", "file:///repo").collect()
    assert [(r.src_id, r.dst_id) for r in got] == [(3, 2)]


@pytest.mark.parametrize(("rule", "hits"), [
    ("src/*.py", {"src/a.py"}), ("**/b.py", {"b.py", "src/x/b.py"}), ("src/**/b.py", {"src/x/b.py"}), ("/b.py", {"b.py"}), ("b.py", {"b.py", "src/x/b.py"}), ("x/", {"src/x/b.py", "src/x/c.py"}),
    ("src/**", {"src/a.py", "src/x/b.py", "src/x/c.py"}), ("[!a-b].py", {"src/x/c.py"}), ("src/?", {"src/x/b.py", "src/x/c.py"}), ("*", {"src/a.py", "b.py", "src/x/b.py", "src/x/c.py"}),
])
def test_ignore_patterns(rule, hits):
    assert {p for p in ("src/a.py", "b.py", "src/x/b.py", "src/x/c.py") if files.ignored(p, [("", rule)])} == hits


def test_all_ignore_files_have_a_say(tmp_path, monkeypatch):
    repo, root = tmp_path / "repo", tmp_path / "repo" / "pkg"
    (root / "in").mkdir(parents=True)
    (repo / ".git" / "info").mkdir(parents=True)
    (tmp_path / "home").mkdir()
    (tmp_path / "home" / ".gitconfig").write_text("[user]\n\tname = x\n[core]\n\texcludesFile = ~/all\n")
    (tmp_path / "home" / "all").write_text("*.glob.py\n")
    (tmp_path / ".gitignore").write_text("*.py\n")
    (repo / ".git" / "info" / "exclude").write_text("/pkg/excl.py\n*.both.py\n")
    (repo / ".gitignore").write_text("/pkg/up.py\n/x.py\n!back.glob.py\n")
    (root / ".gitignore").write_text("!a.both.py\nown.py\nin/seen.py\n")
    (root / "in" / ".ignore").write_text("!seen.py\nlast.py  \n")
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    rules = files.ignore_rules(str(root))
    hit = ["g.glob.py", "excl.py", "b.both.py", "up.py", "own.py", "in/last.py", "in/own.py"]
    kept = ["back.glob.py", "a.both.py", "x.py", "in/excl.py", "in/up.py", "in/seen.py", "last.py"]
    assert [p for p in hit + kept if files.ignored(p, rules)] == hit
    assert not files.ignored("b.glob.py", files.ignore_rules(str(root), tmp_path / "none"))


def test_interface_dispatch_and_fallback(spark):
    ts = {"language": "typescript"}
    nodes = frame(spark, [node(1, "m.caller", 0, 3, **ts), node(2, "m.I", 10, 20, node_kind="Interface", **ts), node(3, "m.I.go", 11, 12, container_id=2, **ts), node(4, "m.C.go", 30, 33, **ts), node(5, "m.plain", 40, 42, **ts)])
    span = {"start": {"line": 1, "character": 2}, "end": {"line": 1, "character": 4}}
    u = "file:///repo/m.py"
    shape = "direction string, anchor_uri string, anchor_line long, anchor_character long, item_uri string, item_line long, item_character long, item_end_line long, item_end_character long, from_ranges array<struct<start:struct<line:long,character:long>,`end`:struct<line:long,character:long>>>"
    calls = spark.createDataFrame([("outgoing", u, 0, 4, u, 11, 4, 11, 9, [((1, 2), (1, 4))]), ("outgoing", u, 0, 4, u, 40, 4, 40, 9, [((2, 2), (2, 4))])], shape)
    impls = spark.createDataFrame([("implementation", u, 11, 4, u, 30, 4)], schema.LOCATIONS.removesuffix(", rank bigint"))
    anchors = spark.createDataFrame([(1,)], "anchor_id long")
    got = {(r.src_id, r.dst_id, r.edge_type) for r in materialize.call_edges(anchors, nodes, calls, "outgoing", "file:///repo", impls).collect()}
    assert got == {(1, 4, "calls"), (4, 3, "implements"), (1, 5, "calls")}
    none = materialize.call_edges(anchors, nodes.withColumn("language", F.lit("python")), calls, "outgoing", "file:///repo", impls)
    assert {(r.src_id, r.dst_id, r.edge_type) for r in none.collect()} == {(1, 3, "calls"), (1, 5, "calls")}
    assert span


def test_callers_at_module_scope(spark):
    root = node(1, "m", 0, END, kind=2, range_end_col=END, sel=0, sel_end_col=0)
    nodes = frame(spark, [root | {"sel_end_line": 0}, node(2, "m.first", 0, 3), node(3, "m.callee", 10, 12)])
    u = "file:///repo/m.py"
    shape = "direction string, anchor_uri string, anchor_line long, anchor_character long, item_uri string, item_line long, item_character long, item_end_line long, item_end_character long, from_ranges array<struct<start:struct<line:long,character:long>,`end`:struct<line:long,character:long>>>"
    calls = spark.createDataFrame([("incoming", u, 10, 4, u, 0, 0, 0, 0, [((20, 0), (20, 4))]), ("incoming", u, 10, 4, u, 0, 4, 0, 9, [((1, 0), (1, 4))])], shape)
    anchors = spark.createDataFrame([(3,)], "anchor_id long")
    got = {(r.src_id, r.dst_id, r.site_start_line) for r in materialize.call_edges(anchors, nodes, calls, "incoming", "file:///repo").collect()}
    assert got == {(1, 3, 20), (2, 3, 1)}


def test_grouping_keeps_sites_in_order(spark, chain):
    nodes, _ = chain
    edges = edges_of(spark, [edge(1, 1, 2, line=9), edge(2, 1, 2, line=3), edge(3, 3, 2, line=1, valid=False), (4, 4, 2, "calls", None, None, None, None, None, True)])
    got = {r.id: [s.start_line for s in r.sites] for r in relations.related(spark.createDataFrame([(2,)], "anchor_id long"), edges, nodes, "calls", True).collect()}
    assert got == {1: [3, 9], 4: []}


def test_neighbours_join_the_grouped_sites(spark):
    """The same rows as grouping the joined sites, for neighbours that share a sort key too; nodes' names are not grouped with each site."""
    rng = random.Random(7)
    nodes = frame(spark, [node(i, f"a.f{i % 23}", i % 2, 9, language=rng.choice(["go", "python"]), valid=i % 9 != 0, is_external=i % 7 == 0) for i in range(60)])
    rows = [edge(i, rng.randrange(60), rng.randrange(8), line=rng.randrange(5), valid=rng.random() < 0.9, uri=rng.choice(["file:///b", "file:///a", None])) for i in range(900)]
    edges, anchors = edges_of(spark, rows), spark.createDataFrame([(i,) for i in range(1, 9)], "anchor_id long")
    for incoming in (True, False):
        for shown in (symbols.NodeFilter(), symbols.NodeFilter("go", include_external=True)):
            got = relations.related(anchors, edges, nodes, "calls", incoming, shown)
            want = relations.group_by_node(relations.neighbors(anchors, edges, shown.apply(nodes), "calls", incoming))
            assert got.columns == want.columns and got.count() > 5
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "fqn" in line and "site_uri" in line]


def test_discovery_and_confinement(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("out/\n*.gen.py\n!keep.gen.py\n# note\n")
    for name in ("a.py", "b.txt", "out/c.py", ".hid/d.py", "sub/e.GO", "x.gen.py", "keep.gen.py"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    found = files.discover(files.read_files(spark, f"file://{tmp_path}"), f"file://{tmp_path}", files.ignore_rules(str(tmp_path)))
    assert {r.uri.rpartition(f"{tmp_path}/")[2] for r in found.collect()} == {"a.py", "sub/e.GO", "keep.gen.py"}
    assert files.confine(f"file://{tmp_path}/sub/../a.py", str(tmp_path)).name == "a.py"
    with pytest.raises(PermissionError):
        files.confine(f"file://{tmp_path}/../x", str(tmp_path))


def test_change_stream(spark, tmp_path):
    from sorrel.streaming import changes

    src = tmp_path / "in"
    src.mkdir()
    events = [("file:///r/a.py", "create", 1), ("file:///r/a.py", "remove", 2), ("file:///r/b.go", "Modify", 1), ("file:///r/c.txt", "create", 1), ("file:///r/d.py", "access", 1), ("file:///r/.git/e.py", "create", 1)]
    (src / "1.json").write_text("\n".join(json.dumps({"uri": u, "kind": k, "ts": f"2024-01-01T00:00:0{t}Z"}) for u, k, t in events))
    seen = []
    q = changes.reconcile_stream(changes.change_stream(spark, str(src)), lambda df, _: seen.extend((r.uri, r.removed) for r in df.collect()), str(tmp_path / "cp"), None)
    q.awaitTermination(60)
    assert sorted(seen) == [("file:///r/a.py", True), ("file:///r/b.go", False)]
    # Below a root, what its ignore rules hide does not count, in a stream too.
    seen.clear()
    q = changes.reconcile_stream(changes.change_stream(spark, str(src)), lambda df, _: seen.extend(r.uri for r in df.collect()), str(tmp_path / "cp2"), None, "file:///r", [("", "*.go")])
    q.awaitTermination(60)
    assert seen == ["file:///r/a.py"]


def test_a_burst_over_batches_is_one_change(spark, tmp_path):
    from sorrel.streaming import changes

    src = tmp_path / "in"
    src.mkdir()
    seen, batches = [], []
    stream = changes.change_stream(spark, str(src), 1)
    q = changes.reconcile_bursts(stream, lambda df, b: (batches.append(b), seen.extend((r.uri, r.removed) for r in df.collect())), str(tmp_path / "cp"), quiet_ms=12000, every="200 milliseconds")
    try:
        for k, kind in enumerate(("create", "remove", "modify")):
            rows = [{"uri": "file:///r/a.py", "kind": kind, "ts": f"2024-01-01T00:00:0{k}Z"}] + ([{"uri": "file:///r/b.py", "kind": "Remove", "ts": "2024-01-01T00:00:00Z"}] if k == 0 else [])
            (src / f".{k}").write_text("\n".join(map(json.dumps, rows)))
            (src / f".{k}").rename(src / f"{k}.json")
            time.sleep(2)
        end = time.time() + 90
        while time.time() < end and len({u for u, _ in seen}) < 2:
            time.sleep(0.5)
        time.sleep(2)
        took = [p["batchId"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()
    assert sorted(seen) == [("file:///r/a.py", False), ("file:///r/b.py", True)]
    assert len(took) == 3, "the three changes came in batches of their own"


def test_descendants_of_any_depth(spark):
    from sorrel.operators import paths

    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(36)], "id long, container_id long")
    assert {tuple(r) for r in paths.descendants(chain).collect()} == {(a, b, b - a) for b in range(36) for a in range(b)}
    with pytest.raises(ValueError, match="contains itself"):
        paths.descendants(spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1)], "id long, container_id long"))


def test_edges_of_repeated_and_missing_keys_equal_the_view(spark, sf, tmp_path):
    """Lines, orders, customers and suppliers that come twice, some with another file, and keys that are null or match nothing."""
    from sorrel.plans.projection import Graph

    for name in ("region", "nation", "part", "documents", "pages"):
        os.symlink(f"{sf}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    lines = read("lineitem").where("l_orderkey < 300")
    other = lines.withColumn("l_returnflag", F.lit("A")).withColumn("l_partkey", F.when(F.col("l_orderkey") % 2 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")))
    null = lines.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(None)).otherwise(F.lit(999999)).cast(lines.schema["l_suppkey"].dataType))
    lines.unionByName(other).unionByName(null).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders, buyers, sellers, events = read("orders"), read("customer"), read("supplier"), read("events").limit(300)
    orders.unionByName(orders.where("o_orderkey % 5 = 0")).unionByName(orders.where("o_orderkey % 5 = 1").withColumn("o_custkey", F.col("o_custkey") + 1)).write.parquet(f"{tmp_path}/orders.parquet")
    for df, key, nation, name in ((buyers, "c_custkey", "c_nationkey", "customer"), (sellers, "s_suppkey", "s_nationkey", "supplier")):
        lost = df.where(f"{key} % 7 != 0").unionByName(df.where(f"{key} % 7 = 0").withColumn(nation, F.lit(99).cast(df.schema[nation].dataType)))
        lost.unionByName(df.where(f"{key} % 4 = 0")).unionByName(df.where(f"{key} % 4 = 1").withColumn(nation, (F.col(nation) + 1).cast(df.schema[nation].dataType))).write.parquet(f"{tmp_path}/{name}.parquet")
    events.unionByName(events.limit(50)).write.parquet(f"{tmp_path}/events.parquet")
    g = Graph(spark, str(tmp_path))
    raw = g.sql("SELECT r.src_id, r.dst_id, r.edge_type, n.uri AS site_uri, r.site_start_line, r.site_start_col, r.valid FROM v_edge_raw r JOIN v_node n ON n.id = r.src_id")
    for mine, view in ((g.edges, g.sql("SELECT * FROM v_edge")), (g.raw_edges, raw)):
        assert mine.columns == view.columns and view.count() > 1000
        assert mine.exceptAll(view).isEmpty() and view.exceptAll(mine).isEmpty()


def test_edges_are_not_shuffled_by_their_keys(spark, sf):
    from sorrel.plans.projection import Graph

    plan = Graph(spark, sf).edges._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "edge_type" in x and "dst_id" in x and "l_orderkey" in x]


def test_bought_lines_equal_the_view(spark, sf, tmp_path):
    """Lines, orders, customers and suppliers that come twice, and keys that are null or match nothing."""
    from sorrel.plans.projection import Graph

    for name in ("region", "nation", "part", "events"):
        os.symlink(f"{sf}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    lines = read("lineitem").where("l_orderkey < 200")
    lines.unionByName(lines.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 2 == 0, F.col("l_suppkey")))).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")):
        read(name).where(f"{key} % 7 != 0").unionByName(read(name).where(f"{key} % 4 = 0")).write.parquet(f"{tmp_path}/{name}.parquet")
    g = Graph(spark, str(tmp_path))
    for other, base, key in (("s", 2000000000000, "l_suppkey"), ("p", 7000000000000, "l_partkey")):
        mine = g.bought(other).select("l_orderkey", "l_linenumber", "c_id", "c_uri", f"{other}_id", f"{other}_uri")
        view = g.sql(f"SELECT b.l_orderkey, b.l_linenumber, c.id AS c_id, c.uri AS c_uri, s.id AS s_id, s.uri AS s_uri FROM v_bought b JOIN v_node c ON c.id = 1000000000000 + b.c_custkey JOIN v_node s ON s.id = {base} + b.{key}")
        assert view.count() > 100 and mine.exceptAll(view).isEmpty() and view.exceptAll(mine).isEmpty()


def test_facts_are_read_once(spark, tmp_path):
    """What is joined twice is written between, so that facts do not go through a shuffle for each."""
    path = f"{tmp_path}/facts"
    nodes = frame(spark, [node(1, "m", 0, END, sel=0, node_kind="Module"), node(2, "m.f", 5, 9), node(3, "m.g", 20, 30)])
    uri = "file:///repo/m.py"
    spark.createDataFrame([(op, uri, 5, 4, uri, 22, 1, None) for op in ("definition", "references")], schema.LOCATIONS).write.parquet(path)
    facts_, asked = spark.read.schema(schema.LOCATIONS).parquet(path), spark.createDataFrame([(uri, 5, 4)], "uri string, line long, character long")
    defined = locate.find_definition(asked, facts_, nodes)
    referred = materialize.reference_edges(spark.createDataFrame([(2,)], "anchor_id long"), nodes, facts_)
    assert [r.node_id for r in defined.collect()] == [3] and [(r.src_id, r.dst_id) for r in referred.collect()] == [(3, 2)]
    for got in (defined, referred):
        assert not [f for f in got.inputFiles() if path in f]
