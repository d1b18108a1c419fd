"""Token counts, exact and near deduplication, and packing, against brute force on small tables."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from sorrel.llm import byte_bpe, exact_dedup, packing, simhash_dedup, token_counts
from sorrel.llm.common import connected_components, scratch

DOCS = "doc_id long, text string, source string, digest string, h long, n long"
AWKWARD = [
    (1, "Same text", "a", "x", 1, 1), (2, "same TEXT", "a", "x", 1, 1), (2, "same TEXT", "a", "x", 1, 1), (3, None, None, None, None, None),
    (4, "", "b", "", 0, 0), (None, "same text", "b", "", 0, 0), (None, "alone", None, "", 0, 0), (7, "É É é", "b", "", 0, 0),
    (8, "word " * 30000, "b", "", 0, 0), (9, "  a  b\n\n c d <|endoftext|> é́x 'll don't  \t", "a", "", 0, 0), (10, "same text", "c", "", 0, 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, DOCS).repartition(3)


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("model", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_match_the_library_and_fill_the_cache(spark, docs, model):
    path, cache = public_tokenizers.path(model), scratch(spark, "cache")
    if model.endswith(".json"):
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 100) for i, t, *_ in AWKWARD]
    assert key(map(tuple, token_counts.count_tokens(docs, path, cache, 100).collect())) == key(want)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, *_ in AWKWARD}), "one row a content, without ids and with repeated ones too"
    assert key(map(tuple, token_counts.count_tokens(docs, path, cache, 100).collect())) == key(want)
    assert spark.read.parquet(cache).count() == stored, "a second run encodes nothing"
    assert token_counts.count_tokens(docs.limit(0), path, cache).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, docs, keep):
    groups = defaultdict(list)
    lower = str.maketrans(exact_dedup.ascii_lower.__globals__["UPPER"], exact_dedup.ascii_lower.__globals__["LOWER"])
    for i, t, *_ in AWKWARD:
        groups[(t or "").translate(lower)].append(i)
    pick = min if keep == "smallest" else max
    want = []
    for t, ids in groups.items():
        best = pick((i for i in ids if i is not None), default=None)
        want += [(i, best, len(ids), i is not None and i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert key(map(tuple, exact_dedup.exact_dedup(docs, keep=keep).collect())) == key(want)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_splits_a_hot_text(spark):
    rows = [(i, "Copy" if i % 3 else f"own {i}") for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), keep="largest").collect()
    assert len(got) == 3000
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(2999, 2000)}
    assert sum(r.kept for r in got) == 1001


def brute_fingerprint(text, width=3):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_roots(values, radius):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    vs = sorted(parent)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in vs}


def test_fingerprints(sf, spark):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + [t for _, t, *_ in AWKWARD]
    for t in texts:
        assert simhash_dedup.fingerprint(t) == brute_fingerprint(t)


def test_simhash_groups_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    roots = brute_roots(set(prints.values()), 3)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.simhash_groups(docs).collect()}
    assert got == {(i, f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def test_simhash_awkward(docs):
    got = simhash_dedup.simhash_groups(docs).collect()
    assert len(got) == len(AWKWARD)
    assert {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert simhash_dedup.simhash_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [16384, 20])
def test_links_keep_every_component(spark, bucket):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:30]:
        for _ in range(6):
            for _ in range(rng.randrange(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [simhash_dedup._signed(v) for v in values]
    got = {r.node: r.root for r in simhash_dedup.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, bucket).collect()}
    want = brute_roots(signed, 3)
    size = Counter(want.values())
    assert got == {v: r for v, r in want.items() if size[r] > 1}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    from itertools import combinations

    masks = simhash_dedup.covering_masks(radius, 20)
    for bits in combinations(range(20), radius):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("alone", [1 << 18, 0])
def test_components_on_a_chain(spark, alone):
    edges = [(i, i + 1) for i in range(24)] + [(100, 100), (None, 3), (200, 201), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {(r.node, r.root) for r in connected_components(df, alone=alone).collect()}
    assert got == {(i, 0) for i in range(25)} | {(100, 100), (200, 200), (201, 200)}
    named = df.selectExpr("concat('n', lpad(a, 4, 0)) a", "concat('n', lpad(b, 4, 0)) b")
    assert {(int(r.node[1:]), int(r.root[1:])) for r in connected_components(named, alone=alone).collect()} == got
    assert connected_components(df.limit(0), alone=alone).count() == 0


def test_components_settled_alone_match_union_find(spark):
    rng = random.Random(3)
    values = rng.sample(range(-(10**12), 10**12), 3000)
    edges = [(rng.choice(values), rng.choice(values)) for _ in range(1700)] + list(zip(values[:600], values[1:601]))
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {v: find(v) for v in parent}


@pytest.mark.parametrize("chunk", [1 << 18, 7])
def test_text_encoder_matches_the_library(spark, sf, monkeypatch, chunk):
    monkeypatch.setattr(byte_bpe, "CHUNK", chunk)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, lib = byte_bpe.TextEncoder(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    alphabet = "aé ß  \x1c\x85 \n\t  'sll1٣漢字🙂.,!́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [t or "" for _, t, *_ in AWKWARD] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        assert np.frombuffer(encode(t), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def check_pieces(rows, texts, window=1024):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array([*lib.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    fills = []
    for s in sorted(by_seq):
        at = 0
        for p in sorted(by_seq[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        fills.append(at)
    assert all(f == window for f in fills[:-1]) and fills[-1] <= window
    assert sorted(by_seq) == list(range(len(fills)))


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    check_pieces(rows, texts)


def test_every_window_holds_the_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    total, held = Counter(), defaultdict(Counter)
    for r in rows:
        total[source[r.doc_id]] += r.length
        held[r.sequence_id][source[r.doc_id]] += r.length
    assert len(total) > 8 and len(held) > 10
    for w in range(len(held) - 1):
        for s in total:
            share = 1024 * total[s] / total.total()
            assert abs(held[w][s] - share) <= 2 + share / 16, (w, s)
            assert held[w][s] or share < 1


def test_mixture_places_every_token_once():
    rng = np.random.default_rng(1)
    for queues, credits in (([700, 1, 40, 9000], [3.0, 0.2, 0.0, 60.0]), ([5] * 300, [64 / 300] * 300), ([1], [64.0]), ([640, 640], [32.0, 32.0])):
        mix = packing.Mixture(queues, credits, 64)
        s, at, n = [], [], []
        for i, q in enumerate(queues):
            cuts = sorted({0, q, *rng.integers(0, q, 9).tolist()})
            s += [i] * (len(cuts) - 1)
            at += cuts[:-1]
            n += [b - a for a, b in zip(cuts, cuts[1:])]
        row, start, length, place = mix.pieces(*(np.array(x, np.int64) for x in (s, at, n)))
        seen = sorted(p for a, k in zip(place.tolist(), length.tolist()) for p in range(a, a + k))
        assert seen == list(range(sum(queues)))
        assert (place // 64 == (place + length - 1) // 64).all()


@pytest.mark.parametrize(("queues", "credits"), [
    ([5 * 10**12] * 4, [256.0] * 4), ([2 * 10**13 - 3 * 10**6, 10**6, 2 * 10**6], [1024.0, 5.2e-5, 1.03e-4]), ([10**13, 7, 10**13], [511.0, 2.0, 511.0]), ([10**12, 10**12], [1023.999, 0.001]),
])
def test_mixture_of_very_many_tokens(queues, credits):
    mix, total = packing.Mixture(queues, credits, 1024), sum(queues)
    last = -(-total // 1024)
    w = np.unique(np.array([0, 1, 2, 1000, last // 3, last // 2, last - 2, last - 1, last], np.int64))
    start = time.perf_counter()
    sent = np.concatenate([mix.sent(w), mix.sent(w + 1)])
    s, at = np.array([0, len(queues) - 1, 0, 1]), np.array([0, queues[-1] - 5000, queues[0] // 2, 0])
    n = np.array([3000, 5000, 100_000, min(queues[1], 900)])
    row, begin, length, place = mix.pieces(s, at, n)
    assert time.perf_counter() - start < 1
    assert [int(x) for x in sent.sum(1)] == [min(int(x) * 1024, total) for x in (*w, *(w + 1))]
    assert (sent[len(w) :] >= sent[: len(w)]).all() and (sent <= np.array(queues)).all()
    assert np.array_equal(np.bincount(row, length), n) and (place // 1024 == (place + length - 1) // 1024).all()


def test_packing_by_a_joined_table_of_shifts(spark, docs, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = key(map(tuple, packing.pack(docs, path).collect()))
    monkeypatch.setattr(packing, "BROADCAST", 0)
    assert key(map(tuple, packing.pack(docs, path).collect())) == want


def test_packing_awkward(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path).collect()
    assert sum(r.length for r in rows) == sum(len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in AWKWARD)
    assert packing.pack(docs.limit(0), path).count() == 0
    weighted = packing.pack(docs.where("doc_id > 6"), path, weights={"a": 1.0, "b": 3.0}).collect()
    check_pieces(weighted, {i: t for i, t, *_ in AWKWARD if i and i > 6})
