"""The pipeline's stages on small tables, each against a plain version."""

import corpus_pipeline as pipeline
import numpy as np
from test_text_ops import check_pieces

from sorrel.llm import near_copies


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, "123 456 --", "en", "src0", 9), (9002, None, None, None, None), (9003, "", "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(extra)
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "packing"]

    named = pipeline.keep_identified(spark, docs, sf)
    assert named.columns == docs.columns
    kept = {r.doc_id: r for r in named.collect()}
    gone = set(rows) - set(kept)
    assert {9001, 9002, 9003} <= gone
    assert all(kept[i] == rows[i] for i in kept)
    assert all(not any(c.isalpha() for c in rows[i].text or "") or len(rows[i].text) < 40 for i in gone), "clean documents stay"

    alone = pipeline.drop_exact_copies(spark, named, sf)
    best = {}
    for i, r in kept.items():
        low = r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        best[low] = max(i, best.get(low, i))
    left = {r.doc_id: r for r in alone.collect()}
    assert set(left) == set(best.values())

    unlike = pipeline.drop_similar(spark, alone, sf)
    final = {r.doc_id: r for r in unlike.collect()}
    assert set(final) == brute_similar({i: r.text for i, r in left.items()})
    assert all(final[i] == rows[i] for i in final)

    check_pieces(pipeline.pack_windows(spark, unlike, sf).collect(), {i: r.text for i, r in final.items()})


def test_exact_stage_keeps_one_row_of_a_group(spark):
    rows = [(None, "a b c d", "en", "s", 7), (None, "A b c d", "en", "s", 7), (1, "A b c d", None, None, None), (2, "a b c d", "en", "s", 7), (2, "a b c d", "en", "t", 7), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (None, None, None, None, None), (4, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = pipeline.drop_exact_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "x"), (2, "a b c d"), (4, "")]


def test_run_and_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert pipeline.run(spark, sf).count() > 0
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
    assert pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


def brute_similar(rows):
    """Ids that stay: of each component under five-word Jaccard similarity >= 0.8 the smallest."""
    sets = {}
    for i, text in rows.items():
        words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return set(root.values())


def test_near_stage_finds_all_similar_pairs(spark, sf):
    stage = dict(pipeline.STAGES)["simhash_dedup"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = [f"w{i}" for i in range(200)]
    # Similarities of 0.80 to 0.95 to the first; those of the others to each other are lower, so they link only by it.
    more = [(9000, " ".join(words), "en", "s", 1)] + [(9001 + k, " ".join(f"x{k}" if i % 100 == 7 * k + 3 else w for i, w in enumerate(words)), "en", "s", 1) for k in range(12)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = stage(spark, docs, sf)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = [r.doc_id for r in got.collect()]
    assert len(left) == len(set(left)) and set(left) == brute_similar(texts)
    assert {i for i in left if i >= 9000} == {9000}


def families(rng, n, size, changes, length=60):
    """Texts in families without a hub: each has ``changes`` of the family's words changed, anywhere."""
    out = []
    for f in range(n):
        words = [f"f{f}w{i}" for i in range(length)]
        for m in range(size):
            at = set(rng.choice(length, changes, replace=False).tolist())
            out.append(" ".join(f"c{f}x{m}y{i}" if i in at else w for i, w in enumerate(words)))
    return out


def test_near_stage_loses_no_link_of_families_without_a_hub(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = families(rng, 6, 30, 1, 60) + families(rng, 4, 30, 1, 70) + families(rng, 2, 30, 1, 80)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    want = brute_similar(dict(enumerate(texts)))
    assert 20 < len(want) < len(texts) - 50, "some link, some do not"
    assert {r.doc_id for r in near_copies.near_copies(docs).collect()} == want
    # Crowded keys: every key's rows are in several tiles.
    monkeypatch.setattr(near_copies, "HELD", 4)
    monkeypatch.setattr(near_copies, "HOT", 8)
    assert {r.doc_id for r in near_copies.near_copies(docs).collect()} == want


def test_the_screen_lets_all_similar_pairs_through():
    rng = np.random.default_rng(8)
    for n in (1, 3, 40, 200, 255, 256, 300, 3000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            kept = a[rng.random(len(a)) < rng.uniform(0.75, 1)]
            b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 64, int(n * rng.uniform(0, 0.2)), np.uint64)]))
            if len(b) and near_copies.similar(a, b, 80):
                assert near_copies.may_be_similar(near_copies.lowest(a), near_copies.lowest(b), 80)
    far = [np.unique(rng.integers(0, 1 << 64, 100, np.uint64)) for _ in range(2)]
    assert not near_copies.may_be_similar(*map(near_copies.lowest, far), 80)


def test_near_stage_keeps_one_row_of_a_group(spark):
    rows = [(None, "a b c d", "en", "s", 7), (None, "A b c d", "en", "s", 7), (5, "a b c d", None, None, None), (5, "a b c d", "en", "s", 7), (None, "e f", "en", "s", 3), (None, "e f", "en", "s", 3), (7, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text and r.text.lower()) for r in got) == [(0, "e f"), (5, "a b c d"), (7, None)]


def test_short_mixed_and_unlabelled_texts_stay(spark, sf, monkeypatch):
    rows = [(1, "ok", None, "s", 2), (2, "123 --", None, "s", 6), (3, "a b c " * 40, None, "s", 240), (4, None, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.keep_identified(spark, docs, "").collect()) == [1, 3]
    # Of a network that is sure of nothing, with ten languages, all texts with a letter stay too.
    unsure = pipeline.language_id.ByteCNN.fresh([f"l{i}" for i in range(10)])
    unsure.out[:] = 0
    monkeypatch.setattr(pipeline.language_id, "train", lambda docs: unsure)
    assert sorted(r.doc_id for r in pipeline.keep_identified(spark, docs, "").collect()) == [1, 3]
