"""The conversation trie, the alignment of tokenizers and nearest neighbours, against brute force on small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from sorrel.llm import hnsw_search, prefix_trie, tokenizer_alignment


def trie(rows, group=5, modulus=9):
    """Nodes of the trie by walking every prefix."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % modulus
        made[c] = own.get(c - int(np.fmod(c, group)), [])[:h] + own[c][h:]
    members = defaultdict(set)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    out = {}
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        childless = [n for n in below if not any(m[:-1] == n and m for m in members if len(m) == len(n) + 1)]
        ends = sorted(c for c in cs if len(made[c]) == len(node))
        out[min(cs), len(node)] = (
            min(members[node[:-1]]) if node else None, len(cs), sum(len(n) == len(node) + 1 for n in below), len(childless),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


SAID = "conv_id long, turn long, role string, text string, prefix string, depth int"


def test_trie_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), int(t), "ua"[t % 2], "é" * int(rng.integers(0, 3)) if t else "same") for c in range(-6, 30) for t in range(int(rng.integers(1, 7)))]
    # One conversation over many blocks and two that share its beginning; ties, repeats, nulls.
    rows += [(c, t, "u", f"t{t if t < 150 or c == 105 else -t}") for c in (105, 108, 109) for t in range(200)]
    rows += [(40, None, None, None), (40, 1, "b", "x"), (40, 1, "a", "y"), (40, 1, "a", "y"), (None, 0, "u", "lost"), (41, 0, "", ""), (43, 0, "u", "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SAID).repartition(5)
    got = {(r[0], r[1]): tuple(r)[2:] for r in prefix_trie.prefix_trie(df).collect()}
    want = trie(rows)
    assert got == want
    assert max(d for _, d in got) == 200
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_trie_by_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(prefix_trie.OP11_SQL)
    got = prefix_trie.op11_prefix_trie(spark, sf).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs):
    """Whole texts by the libraries, links by their ends."""
    pair, found, count = tokenizer_alignment.TokenizerPair(A, B), [], Counter()
    for i, text in docs:
        tokens = None
        if text:
            a, b, raw = pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text), f" {text}".encode()
            parts = [[pair.a_bytes[x] for x in a], [pair.b_bytes[x] for x in b]]
            if all(b"".join(p) == raw for p in parts):
                ends = [dict(zip(np.cumsum([len(x) for x in p]).tolist(), range(1, len(p) + 1), strict=True)) for p in parts]
                groups, links, i0, j0 = [], [], 0, 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    i1, j1 = ends[0][end], ends[1][end]
                    groups.append(",".join(map(str, a[i0:i1])) + "|" + ",".join(map(str, b[j0:j1])))
                    links.append((a[i1 - 1], b[j1 - 1]))
                    i0, j0 = i1, j1
                count.update(links)
                tokens = (len(a), len(b), groups, links)
        found.append((i, tokens))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for i, t in found:
        if t is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            best, total = sum(count[x] == top[x[1]] for x in t[3]), sum(count[x] for x in t[3])
            out.append((i, t[0], t[1], len(t[2]), len(t[3]), best, total, hashlib.sha256(";".join(t[2]).encode()).hexdigest()))
    return sorted(out, key=str), count


AWKWARD = [
    "a", " ", None, "", "x▁y foo", "foo <s> bar<|endoftext|> </s>\n\n  z\t\tq  e　 f \n", "\n", "\n\n a", "don't  'll  x's\r\n y", "ééé \x00 b\x00 c", "word " * 60000, "x" * 3000,
    "​ ​\n﻿ a 日本 語 \U0001f600 \U0001f600", "   lead", "trail   ", "\x1c a\x1f b \x85 c", "foo▁", "the end", "the end",
]


def test_alignment_by_brute_force(spark):
    docs = [*enumerate(AWKWARD), (None, "the end"), (3, "again a")]
    df = spark.createDataFrame([(*d, 7, "clash") for d in docs], "doc_id long, text string, code int, segment string").repartition(3)
    got, pairs = tokenizer_alignment.align_tokenizers(df, A, B)
    want, count = aligned(docs)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(count)
    none, no_pairs = tokenizer_alignment.align_tokenizers(df.limit(0), A, B)
    assert none.count() == no_pairs.count() == 0


def test_alignment_of_a_table(spark, sf, monkeypatch):
    monkeypatch.setattr(tokenizer_alignment, "BROADCAST", 0)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, tokenizer_alignment.op12_tokenizer_alignment(spark, sf).collect()), key=str) == aligned(docs)[0]


def test_segments_give_texts_back_and_cut_nowhere_else():
    for text in AWKWARD:
        if text:
            parts = [w for words in tokenizer_alignment.segments(text) for w in words]
            assert "".join(parts) == f" {text}" and all(parts)
            assert all(p[0] in " \n" for p in parts)


def brute(rows, queries, k=5):
    """Nearest rows by the full matrix of cosines."""
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    norm, out = np.sqrt((x * x).sum(1)), {}
    for i, v in queries:
        s = x @ np.array(v, float) / norm / np.sqrt(np.dot(v, v))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_neighbours_by_brute_force(spark, sf, monkeypatch):
    # Several shards and several blocks of queries.
    monkeypatch.setattr(hnsw_search, "SHARD_LEAST", 128)
    monkeypatch.setattr(hnsw_search, "BLOCK_CELLS", 256)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = answers(hnsw_search.op13_nearest_neighbours(spark, sf))
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    assert set(got) == set(want) and recall(got, want) >= 0.9
    vectors = dict(rows)
    for q, found in got.items():
        exact = dict(brute([(i, vectors[i]) for i, _ in found], [(q, vectors[q])])[q])
        assert all(abs(exact[i] - s) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_graph_finds_the_nearest_in_one_large_shard():
    rng = np.random.default_rng(1)
    x = hnsw_search._unit(rng.normal(size=(6000, 48)))
    graph = hnsw_search.build_graph(x)
    assert [len(t) for t in graph] == [6000, 375, 24, 2]
    found, _ = hnsw_search.search_graph(x, graph, x[:200])
    want = np.argsort(-(x[:200] @ x.T), 1)[:, :6]
    assert np.mean([len({*a[:6]} & {*b}) / 6 for a, b in zip(found, want, strict=True)]) >= 0.95


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, i / 7]) for i in range(12)] + [(100 + i, [3.0, 4.0]) for i in range(40)]
    odd = [(200, None), (201, [0.0, 0.0]), (202, [nan, 1.0]), (203, [1.0, inf]), (204, [1.0, None]), (None, [1.0, 1.0]), (205, []), (206, [1.0, 2.0, 3.0]), (3, [9.0, 9.0]), (3, [1.0, 3 / 7])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<float>, node int, ids string").repartition(4)
    got = answers(hnsw_search.nearest(hnsw_search.index_vectors(df), df))
    kept = {i: [float(np.float32(x)) for x in v] for i, v in rows} | {3: [1.0, float(np.float32(3 / 7))]}
    want = brute(list(kept.items()), list(kept.items()))
    assert set(got) == set(kept), "unusable vectors and ids are no queries; the one of three numbers has no other"
    for q, w in want.items():
        # Many hold one vector: the smallest ids are the answer.
        assert [i for i, _ in got[q]] == [i for i, _ in w] or np.allclose([s for _, s in got[q]], [s for _, s in w], atol=1e-15)
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105] and [i for i, _ in got[139]] == [100, 101, 102, 103, 104]
    assert hnsw_search.nearest(hnsw_search.index_vectors(df.limit(0)), df).count() == 0
    assert hnsw_search.nearest(hnsw_search.index_vectors(df), df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_few_vectors(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(hnsw_search.nearest(hnsw_search.index_vectors(df), df))
    assert {q: [i for i, _ in w] for q, w in brute(rows, rows).items() if w} == {q: [i for i, _ in w] for q, w in got.items()}
