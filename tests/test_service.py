"""Indexing, snapshots and the request API."""

import json

import pytest
from pyspark.sql import functions as F
from test_graph import edge, edges_of, frame, node

from sorrel.operators import symbols
from sorrel.operators.indexing import index_repository
from sorrel.operators.snapshots import SnapshotStore, refresh_sources
from sorrel.plans import schema
from sorrel.service import Facts, GraphService, SymbolRef
from sorrel.sources import facts as parse


def span(a, b):
    return {"start": {"line": a, "character": b}, "end": {"line": a, "character": b + 6}}


def test_index_then_reindex(spark):
    nodes, edges = frame(spark, []), edges_of(spark, [])
    member = lambda n, line: {"name": n, "kind": 6, "range": span(line, 0), "selectionRange": span(line, 4)}
    tree = [{"name": "A", "kind": 5, "range": span(0, 0), "selectionRange": span(0, 6), "children": [member("f", 1), member("f", 2), member("g", 3)]}]
    found = spark.createDataFrame([("file:///repo/m.py",), ("file:///repo/x.py",), ("file:///repo/no.txt",)], "uri string")
    answers = spark.createDataFrame([("file:///repo/m.py", json.dumps(tree)), ("file:///repo/x.py", None)], "uri string, symbols string")
    n, e, stats, _ = index_repository(nodes, edges, found, answers, "file:///repo")
    assert stats.first().asDict() == {"files_seen": 2, "files_indexed": 1, "symbols_upserted": 5, "fetch_errors": 1}
    rows = {r.fqn: r for r in n.collect()}
    assert set(rows) == {"m", "m.A", "m.A.f", "m.A.g"} and rows["m.A.f"].range_start_line == 2
    assert rows["m.A.f"].container_id == rows["m.A"].id and rows["m"].container_id is None
    assert {(r.src_id, r.dst_id) for r in e.collect()} == {(rows["m.A"].id, rows["m.A.f"].id), (rows["m.A"].id, rows["m.A.g"].id)}
    again, e2, _, _ = index_repository(n, e, found, answers, "file:///repo")
    assert {(r.fqn, r.id) for r in again.collect()} == {(r.fqn, r.id) for r in rows.values()} and e2.count() == 2


def test_snapshots(spark, tmp_path):
    st = SnapshotStore(spark, f"file://{tmp_path}/g")
    assert st.read().version == 0 and st.read().nodes.count() == 0
    first = st.commit(nodes=frame(spark, [node(1, "a", 0, 1)]))
    second = st.commit(edges=edges_of(spark, [edge(1, 1, 1)]))
    assert (first.version, second.version, second.nodes.count(), first.edges.count(), second.edges.count()) == (1, 2, 1, 0, 1)
    st.commit()
    st.prune(keep=1)
    assert st.read().version == 3 and sorted(p.name for p in (tmp_path / "g").iterdir() if p.name[0] == "v") == ["v3"]
    assert refresh_sources(spark, {"python": f"file://{tmp_path}", "go": f"file://{tmp_path}"}, "go") == ["go"]


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("snap")
    u = "file:///repo/m.py"
    text = "\n".join(f"line {i}" for i in range(20))
    nodes = frame(spark, [node(1, "repo.helper", 0, 2), node(2, "repo.caller", 6, 8), node(3, "repo.other", 10, 12)])
    snap = SnapshotStore(spark, f"file://{path}").commit(nodes=nodes, edges=edges_of(spark, []))
    f = Facts.none(spark, spark.createDataFrame([(u, text)], schema.FILES))
    item = lambda line: {"name": "x", "kind": 12, "uri": u, "range": span(line, 0), "selectionRange": span(line, 4)}
    f.calls = parse.calls(spark.createDataFrame([("incoming", u, 0, 4, json.dumps([{"from": item(6), "fromRanges": [span(7, 4)]}])), ("outgoing", u, 6, 4, json.dumps([{"to": item(0), "fromRanges": [span(7, 4)]}]))], "direction string, uri string, line long, character long, answer string"))
    f.locations = parse.locations(spark.createDataFrame([("definition", u, 7, 4, json.dumps([{"uri": u, "range": span(0, 4)}])), ("references", u, 0, 4, json.dumps([{"uri": u, "range": span(7, 4)}]))], "op string, uri string, line long, character long, answer string"))
    f.hover = spark.createDataFrame([(u, 0, 4, "function helper")], schema.HOVER)
    f.health = spark.createDataFrame([("python", "healthy")], "language string, status string")
    out = GraphService(spark, snap, f)
    out.path = f"file://{path}"
    return out


def service_path(service):
    return service.path


def test_requests(service):
    at = ("file:///repo/m.py", 7, 4)
    assert service.find_symbol("helper", brief=True) == {"fqns": ["repo.helper"], "next_cursor": None}
    assert service.find_symbol("helper", with_signature=True)["nodes"][0]["signature"] == "function helper"
    assert [n["construct"] for n in service.find_definition(at)["nodes"]] == ["function"]
    callers = service.find_callers(SymbolRef(fqn="repo.helper"))
    assert [(c["node"]["fqn"], [s["start_line"] for s in c["call_sites"]]) for c in callers["callers"]] == [("repo.caller", [7])] and callers["refreshing"]
    assert [c["node"]["fqn"] for c in service.find_callers(SymbolRef(at=at))["callers"]] == ["repo.caller"]
    assert [c["node"]["fqn"] for c in service.find_callees(SymbolRef(fqn="repo.caller"))["callees"]] == ["repo.helper"]
    assert [c["node"]["fqn"] for c in service.find_references(SymbolRef(fqn="repo.helper"))["references"]] == ["repo.caller"]
    assert service.find_callers(SymbolRef(fqn="repo.helpr"))["hint_fqns"] == ["repo.helper"]
    path = service.find_call_path(SymbolRef(fqn="repo.caller"), SymbolRef(fqn="repo.helper"))
    assert path["reachable"] and [n["fqn"] for n in path["path"]] == ["repo.caller", "repo.helper"]
    assert service.find_call_path(SymbolRef(fqn="none"), SymbolRef(fqn="repo.helper"))["limit_reached"] is False
    assert service.read_range("file:///repo/m.py", 1, 3)["content"] == "line 1\nline 2"
    assert service.restart() == {"restarted": []}


def test_a_source_that_is_down_is_not_taken_for_built(spark, service):
    snap = SnapshotStore(spark, service_path(service)).read()
    one = GraphService(spark, snap, service.facts)
    ref, up = SymbolRef(fqn="repo.helper"), one.facts.health
    one.facts.health = spark.createDataFrame([], "language string, status string")
    down = one.find_callers(ref)
    assert down["callers"] == [] and down["degraded"] and not down["refreshing"] and one.marks.count() == 0
    one.facts.health = up
    assert [c["node"]["fqn"] for c in one.find_callers(ref)["callers"]] == ["repo.caller"]
    depth = lambda: len(one.edges._jdf.queryExecution().analyzed().toString().splitlines())
    before = depth()
    # A warm anchor is served as it is, and what its source says now is there the next time.
    calls, one.facts.calls = one.facts.calls, one.facts.calls.withColumn("from_ranges", F.transform("from_ranges", lambda r: r.withField("start", r["start"].withField("line", r["start"]["line"] + 1))))
    assert [[s["start_line"] for s in c["call_sites"]] for c in one.find_callers(ref)["callers"]] == [[7]]
    assert one.drain() == 1 and one.drain() == 0
    assert [[s["start_line"] for s in c["call_sites"]] for c in one.find_callers(ref)["callers"]] == [[7, 8]]
    one.facts.calls = calls
    assert [c["node"]["fqn"] for c in one.find_callees(SymbolRef(fqn="repo.caller"))["callees"]] == ["repo.helper"]
    assert depth() == before
    assert sorted(r.id for r in one.edges.collect()) == list(range(1, one.edges.count() + 1))


def test_refreshing_is_a_queue(spark, service, monkeypatch):
    u = "file:///repo/m.py"
    nodes = frame(spark, [node(i, f"repo.n{i}", 2 * i, 2 * i + 1) for i in range(12)])
    snap = SnapshotStore(spark, f"{service_path(service)}/queue").commit(nodes=nodes, materialized=spark.createDataFrame([(i, "calls") for i in range(12)], schema.MATERIALIZED))
    one = GraphService(spark, snap, Facts.none(spark, service.facts.files))
    one.facts.health = service.facts.health
    item = lambda line: {"name": "x", "kind": 12, "uri": u, "range": span(line, 0), "selectionRange": span(line, 4)}
    said = [("incoming", u, 2 * i, 4, json.dumps([{"from": item(22), "fromRanges": [span(22, 4)]}])) for i in range(11)]
    one.facts.calls = parse.calls(spark.createDataFrame(said, "direction string, uri string, line long, character long, answer string"))
    merges = []
    merge = one._merge
    monkeypatch.setattr(one, "_merge", lambda new: (merges.append(1), merge(new)))
    anchors = {i: symbols.by_id(one.nodes, i).first() for i in range(10)}
    monkeypatch.setattr(one, "_anchor", lambda ref: anchors[int(ref.fqn)])
    for k in range(100):
        if k < 12:
            assert one.find_callers(SymbolRef(fqn=str(k % 10)))["refreshing"]
        else:
            one.asked.add((k % 10, "calls"))
    assert not merges and len(one.asked) == 10
    assert one.drain() == 10 and len(merges) == 1
    assert {(r.src_id, r.dst_id) for r in one.edges.collect()} == {(11, i) for i in range(10)}
    assert [c["node"]["fqn"] for c in one.find_callers(SymbolRef(fqn="3"))["callers"]] == ["repo.n11"]


def test_what_definitions_learn_is_kept(spark, service):
    one = GraphService(spark, SnapshotStore(spark, service_path(service)).read(), service.facts)
    at = ("file:///repo/m.py", 7, 4)
    assert [(n["construct"], n["signature"]) for n in one.find_definition(at)["nodes"]] == [("function", "function helper")]
    told, one.facts.hover = one.facts.hover, one.facts.hover.limit(0)
    assert [(n["construct"], n["signature"]) for n in one.find_definition(at)["nodes"]] == [("function", "function helper")]
    assert [n["signature"] for n in one.find_symbol("helper")["nodes"]] == ["function helper"]
    one.facts.hover = told
    saved = SnapshotStore(spark, f"{service_path(service)}/saved")
    assert {(r.id, r.construct) for r in one.save(saved).nodes.collect()} == {(1, "function"), (2, None), (3, None)}


def test_changes_end_in_a_snapshot(spark, tmp_path):
    from sorrel.streaming import changes

    st = SnapshotStore(spark, f"file://{tmp_path}/g")
    st.commit(nodes=frame(spark, [node(1, "m", 0, 9), node(2, "m.f", 1, 2), node(3, "x.g", 0, 1, uri="file:///repo/x.py"), node(4, "b.h", 0, 1, uri="file:///repo/b.py")]))
    tree = [{"name": "f", "kind": 12, "range": span(3, 0), "selectionRange": span(3, 4), "children": [{"name": "n", "kind": 12, "range": span(3, 2), "selectionRange": span(3, 2)}]}]
    answers = spark.createDataFrame([("file:///repo/m.py", json.dumps(tree)), ("file:///repo/b.py", "{"), ("file:///repo/other.py", json.dumps(tree))], "uri string, symbols string")
    apply = changes.reconciler(st, lambda files: answers.join(files, "uri", "left_semi"), "file:///repo")
    apply(spark.createDataFrame([("file:///repo/m.py", False), ("file:///repo/x.py", True), ("file:///repo/b.py", False)], "uri string, removed boolean"), 0)
    got = {r.fqn: (r.id, r.range_start_line, r.orphan) for r in st.read().nodes.collect()}
    assert got == {"m": (1, 0, False), "m.f": (2, 3, False), "m.f.n": (5, 3, False), "x.g": (3, 0, True), "b.h": (4, 0, False)}
    assert {(r.src_id, r.dst_id, r.edge_type) for r in st.read().edges.collect()} == {(2, 5, "contains")}


def test_bad_requests(service):
    for bad in ({}, {"fqn": "a", "at": ("u", 0, 0)}):
        with pytest.raises(ValueError):
            SymbolRef(**bad)
    with pytest.raises(PermissionError):
        service.read_range("file:///repo/../etc/passwd")
    with pytest.raises(PermissionError):
        service.read_range("file:///repo/a/../..")
    with pytest.raises(FileNotFoundError):
        service.read_range("file:///repo/none.py")
