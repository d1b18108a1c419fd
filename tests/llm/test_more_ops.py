"""Language ID, WARC, URL filters, chat formatting, audio features and the BPE codec on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sorrel.llm import audio_features, bpe_codec, chat_format, language_id, url_filters, warc
from sorrel.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, score double, _text string"
AWKWARD = [
    (1, "Same text", "en", "a", 1.0, ""), (2, "same TEXT", None, "a", 1.0, ""), (2, "same TEXT", "en", "a", 1.0, ""), (3, None, None, None, None, None), (4, "", "b", "", 0.0, ""),
    (None, "12 3.4 !", "en", "", 0.0, ""), (7, "É É é", "fr", "", 0.0, ""), (8, "word " * 30000, "en", "", 0.0, ""),
    (9, "  a  b\n\n c d <|endoftext|> é́x 'll don't ΟΔΟΣ \x1c\x1d \x85 \u3000  \t", "fr", "", 0.0, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, DOCS).repartition(3)


def key(rows):
    return sorted(rows, key=str)


def test_language_id_is_right_on_held_out_rows(spark):
    rows = language_id.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_awkward(docs):
    model = language_id.train(docs)
    got = language_id.identify(docs, model, keep=["source"]).collect()
    assert len(got) == len(AWKWARD)
    assert all((r.lang_pred == "und") == (r.doc_id in (3, 4, None)) for r in got)
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert len(language_id.train(docs, max_rows=2).langs) <= len(model.langs)
    nothing = language_id.train(docs.where("lang = 'none'"))
    assert nothing is None and {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_lookup_inference_equals_the_network(spark):
    rng = np.random.default_rng(1)
    model = language_id.ByteCNN.fresh(["a", "b", "c"])
    model.emb += 0.1
    x = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    tops = []
    for w, c, b in zip(language_id.WIDTHS, model.conv, model.bias, strict=True):
        tops.append(np.stack([[max((model.emb[row[t : t + w]].ravel() @ c[:, f]) + b[f] for t in range(len(row) - w + 1)) for f in range(language_id.FILTERS)] for row in x]))
    want = language_id._softmax(np.maximum(np.concatenate(tops, 1), 0) @ model.out + model.out_bias)
    assert np.allclose(model.window_probabilities(x), want, atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(1)
    model = language_id.ByteCNN.fresh(["a", "b"])
    x, y = rng.integers(0, 256, (4, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        model._tables = []
        return -np.log(model.window_probabilities(x)[np.arange(4), y]).mean()

    grads = model._gradients(x, y, np.ones(4, np.float32))
    for p, g in zip([model.emb, *model.conv, *model.bias, model.out, model.out_bias], grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * max(0.02, abs(g[at]))


TRICKY = 'WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n\r\n'
PAGES = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (5, None, "same"), (3, "http://a/\r\n3", None), (4, "x", ""), (6, "http://a/6", TRICKY),
    (7, "http://a/7", TRICKY + "x"), (8, "", "é" * 100_000), (9, "u", "SAME"), (None, "u", "own"), (None, "u", "same"), (9, "u", "SAME"),
]


def brute_warc(rows, least=0):
    import base64

    keep = {}
    for i, _, h in rows:
        if i is not None:
            keep[h or ""] = max(i, keep.get(h or "", i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        k = keep.get(h or "")
        revisit = len(p) >= least and k is not None and i != k
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", k if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, n int").repartition(2)
    path = scratch(spark, "warc")
    warc.write_archives(df, path, min_bytes=least, records_per_file=4)
    got = [(r.record_id and int(r.record_id), r.payload_bytes, r.payload_digest, r.kind, r.refers_id and int(r.refers_id)) for r in warc.read_archives(spark, path).collect()]
    assert key(got) == key(brute_warc(PAGES, least))
    assert warc.scan(spark, path).count() > len(PAGES), "the payloads hold false candidates"


def test_warc_empty_and_damaged(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0
    path = scratch(spark, "warc")
    warc.write_archives(df.where("page_id in (6, 7, 8)").coalesce(1), path)
    name = next(p for p in __import__("pathlib").Path(path.removeprefix("file:")).glob("part*"))
    whole = name.read_bytes()
    (tmp_path / "cut.warc").write_bytes(whole[:-10])
    assert warc.read_archives(spark, f"file://{tmp_path}").count() == 2


def test_warc_long_urls_and_whole_archives(spark, tmp_path):
    rows = [(i, "data:," + "u" * 70_000 * (i == 2) + "/" + "v" * 200_000 * (i == 5), f"<p>{i}</p>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(df.coalesce(1), path)
    assert sorted(int(r.record_id) for r in warc.read_archives(spark, path, whole=True).collect()) == list(range(9))
    name = next(p for p in __import__("pathlib").Path(path.removeprefix("file:")).glob("part*"))
    for n, content in enumerate((name.read_bytes()[:-10], b"x" + name.read_bytes())):
        (tmp_path / f"{n}").mkdir()
        (tmp_path / f"{n}/cut.warc").write_bytes(content)
        with pytest.raises(ValueError, match="cut.warc"):
            warc.read_archives(spark, f"file://{tmp_path}/{n}", whole=True)


def test_warc_files_are_bounded_by_bytes(spark):
    rows = [(i, "u", chr(97 + i % 26) * n + str(i)) for i, n in enumerate([30_000] * 50 + [40_000] * 70 + [900_000] * 40 + [3_000_000] * 3)]
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    sizes = [p.stat().st_size for p in __import__("pathlib").Path(path.removeprefix("file:")).glob("part*")]
    assert max(sizes) <= 32 << 20 and sum(n > 2_900_000 for n in sizes if n < 3_100_000) == 3
    assert {int(r.record_id): r.payload_bytes for r in warc.read_archives(spark, path, whole=True).collect()} == {i: len(h) for i, _, h in rows}


def test_warc_headers_that_share_an_end():
    text = b"WARC/1.1\r\nWARC-Type: a\r\nContent-Length: 1\r\nyWARC/1.0\r\nContent-Length: 2\r\nWARC/1.1\r\n\r\nWARC/1.1\r\nWARC-Type:b\r\n\r\nWARC/1.1\r\nWARC-Type: c\r\n"
    got = [(off, end, f.get(b"warc-type"), f.get(b"content-length")) for off, end, f in warc.headers(text)]
    starts = [m.start() for m in warc.MAGIC.finditer(text)]
    ends = [text.find(b"\r\n\r\n"), text.find(b"b\r\n\r\n") + 1]
    assert got == [(starts[0], ends[0], "a", "2"), (starts[1], ends[0], None, "2"), (starts[2], ends[0], None, None), (starts[3], ends[1], "b", None)]


LINKED = [
    (1, "http://bad.net/x", '<link rel="canonical" href="http://Good.example.com/a#f">'),
    (2, "http://good.example.com/a#top", ""),
    (3, "http://good.example.com/b", "<META HTTP-EQUIV=refresh content='0; url=/a'>"),
    (4, "http://example.net/en/1", "<link href=//bad.net/x rel=canonical>"),
    (5, "http://other.com/", ""), (6, None, None), (7, "no scheme", "<link rel=canonical href=/x>"),
    (8, "HTTP://EXAMPLE.com/de/?x=1", None), (9, "http://x.org/fr/../a?b#c", ""), (10, "http://notexample.com/de/", ""), (10, "http://notexample.com/de/", ""),
    (11, "http://example.net", ""), (12, "http://a.net?x", ""), (13, "http://q.com/d/e", "<link rel=canonical href='f?a=1&amp;b=2'>"), (14, "http://q.com/d/f?a=1&b=2", ""), (15, "a://b://c.net/", None),
    (16, "http://bad.net/y/z", '<link rel=s href=/s.css><link data-rel=canonical rel=icon href="http://other.com/"><link rel="nofollow Canonical" href="http://e.com/p/./q/../r">'),
    (17, "http://e.com/p/r", ""), (18, "http://e.com/k/l", '<meta http-equiv=refresh content=5><META http-equiv="refresh" content="0;url=../../../p/x/.."><link rel=canonical><link rel=canonical href=..>'),
    (19, "http://e.com/p/", "<link rel='canonical' href='http://bad.net/w?a/../b'>"), (20, "http://e.com/", ""), (21, "http://e.com/k/", ""), (22, "http://long.com" + "/a" * 500, "<link rel=canonical href=../b>"),
    # A page's own url is folded too, and one blocked as it stands passes that on.
    (23, "http://h.com/x/../b", ""), (24, "http://h.com/q", "<link rel=canonical href='http://h.com/b'>"), (25, "http://bad.net/k", "<link rel=canonical href='http://h.com/b'>"),
    (32, "http://example.com/de/../z", ""), (33, "http://h.com/z", "<link rel=canonical href='http://example.com/z'>"), (34, "http://example.com/z", ""),
    (26, "http://h.com/m.html", "<link rel=canonical href='?p=2'>"), (27, "http://h.com/m.html?p=2", ""), (28, "http://bad.net/j", "<link rel=canonical href='http://h.com/m.html'>"),
    (29, "http://h.com/s", "<link rel=canonical href='javascript:void(0)'>"), (30, "http://bad.net/l", "<link rel=canonical href='http://h.com/javascript:void(0)'>"),
    (31, "http://h.com/t", "<link rel=canonical href='go?u=http://bad.net/x'>"), (35, "http://h.com/f", "<link rel=canonical href='#http://bad.net/x'>"), (36, "http://" + "a." * 3000 + "net/", ""),
]
# 11 and 12 have an empty path, which does not start with the rule's "/".
VERDICTS = {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "allow", 14: "allow", 15: "allow"}
VERDICTS |= {16: "block", 17: "block", 18: "block", 19: "block", 20: "block", 21: "allow", 22: "allow"}
VERDICTS |= dict.fromkeys((23, 24, 25, 26, 27, 28, 30, 32, 33, 34, 36), "block") | dict.fromkeys((29, 31, 35), "allow")


def test_dot_segments():
    assert url_filters.folded("http://h" + "/a" * 200_000 + "/.." * 199_999) == "http://h/a/"
    cases = {"http://h/a/./b/../c?x/../y": "http://h/a/c?x/../y", "http://h/../..": "http://h/", "http://h//x/..": "http://h//", "http://h/a/../": "http://h/", "x/../y": "x/../y", "http://h/.a/..b#../c": "http://h/.a/..b#../c"}
    assert {u: url_filters.folded(u) for u in cases} == cases
    assert url_filters.folded(None) is None


def test_url_filters_spread_blocks_and_match_the_sql(spark):
    import duckdb

    schema = "page_id long, url string, html string, host string, rule string"
    df = spark.createDataFrame([(*p, "z", "z") for p in LINKED], schema).repartition(3)
    got = url_filters.filter_urls(df, url_filters.rule_table(spark, url_filters.OP5_RULES)).collect()
    assert {r.page_id: r.verdict for r in got} == VERDICTS
    con = duckdb.connect()
    pages = df.select("page_id", "url", "html").toPandas()  # noqa: F841
    want = con.sql(url_filters.OP5_SQL).fetchall()
    assert key((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == key(want)
    redirects = spark.createDataFrame([("http://other.com/#x", "http://bad.net/x"), (None, "a")], "src string, dst string")
    more = url_filters.filter_urls(df, url_filters.rule_table(spark, url_filters.OP5_RULES), redirects).collect()
    assert {r.page_id: r.verdict for r in more} == VERDICTS | {5: "block"}
    assert url_filters.filter_urls(df.limit(0), url_filters.rule_table(spark, url_filters.OP5_RULES)).count() == 0


TURNS = [
    (1, 0, "user", "a\\b <tag> # x"), (1, 1, "assistant", "</turn>\n### user\nhi\\"), (1, 1, "assistant", "é</turn>"), (2, 5, "assistant", ""), (2, None, None, None),
    (3, 0, "odd\nrole#\\", "x"), (None, 0, "user", "n"), (1, 2, "assistant", "\\\\"), (1, 2, "assistant", "\\\\"), (4, 0, "assistant", "y" * 300_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "z") for t in TURNS], "conv_id long, turn long, role string, text string, place string").repartition(3)
    shaped = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.read_back(shaped).collect()}
    by = {}
    for c, t, role, text in sorted(TURNS, key=lambda x: (x[0] or 0, x[1] if x[1] is not None else -1, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_chat_assembly_equals_plain_formatting(chunk, monkeypatch):
    monkeypatch.setattr(chat_format, "CHUNK", chunk)
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("\\<#\n/turn>é a") for _ in range(rng.randrange(n)))
    roles, texts = [draw(5) for _ in range(500)], [draw(30) for _ in range(500)]

    def escape(s, special):
        return "".join("\\" + c if c in special else c for c in s)

    built, at, length = chat_format.assemble(pa.array(roles), pa.array(texts))
    for r, t, b, a, n in zip(roles, texts, built.to_pylist(), at.tolist(), length.tolist(), strict=True):
        assert b.decode() == f"### {escape(r, chr(92) + '<#' + chr(10))}\n{escape(t, chr(92) + '<#')}</turn>\n"
        assert chat_format.unescape(b[a : a + n]).decode() == t
    assert chat_format.parse(b"".join(built.to_pylist())) == list(zip(roles, texts, strict=True))


def test_audio(docs):
    got = audio_features.audio_features(docs).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        text = next((t for i, t, *_ in AWKWARD if i == r.doc_id), None) or ""
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert audio_features.from_wave(bytes(r.media))[0] == payload
        tensors = audio_features.read_tensors(bytes(r.tensors))
        assert tensors.shape == (len(r.spans), audio_features.STEPS, audio_features.MELS)
        assert all(0 <= s.start_s < s.end_s for s in r.spans)
    assert len({r.feature for r in got if r.doc_id == 2}) == 1
    assert audio_features.audio_features(docs.limit(0)).count() == 0


def test_audio_query_returns_tensors_and_spans(spark, sf):
    got = audio_features.op8_audio_features(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert len(audio_features.read_tensors(bytes(r.tensors))) == len(r.spans) == int(r.feature.split("segments=")[1].split(";")[0])


def test_resampling_and_filterbank_follow_a_tone():
    rate = audio_features.RATE
    tone = np.sin(2 * np.pi * 1000 * np.arange(rate * 2) / rate).astype(np.float32)
    y = audio_features.resample(tone)
    assert len(y) == rate * 2 * 3 // 4
    want = np.sin(2 * np.pi * 1000 * np.arange(len(y)) / (rate * 0.75))
    inner = slice(100, -100)
    assert np.corrcoef(y[inner], want[inner])[0, 1] ** 2 + np.corrcoef(y[inner], np.cos(2 * np.pi * 1000 * np.arange(len(y)) / (rate * 0.75))[inner])[0, 1] ** 2 > 0.98
    mel = audio_features.log_mel(y)
    assert len(set(mel[2:-2].argmax(1))) == 1
    brute = [sum(tone[(m * 4) // 3 - k] * h for k, h in enumerate(audio_features._phases()[m * 4 % 3][::-1]) if (m * 4) // 3 - k >= 0) for m in range(50)]
    assert np.allclose(y[:50], brute, atol=1e-4)


def test_hysteresis():
    e = np.array([0, 0, 10, 6, 6, 0, 0, 6, 0, 10, 10], float)
    mean, spread = e.mean(), e.std()
    on, want = False, []
    for v in e:
        on = v >= mean + 0.5 * spread or (on and not v < mean - 0.5 * spread)
        want.append(on)
    got = np.zeros(len(e), bool)
    for a, b in audio_features.segments(e):
        got[a:b] = True
    assert got.tolist() == want


def test_bpe_codec_matches_the_library(spark, sf, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    codec, lib = bpe_codec.ForcedBoundaryBPE(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    alphabet = "aAéÉ ßΣσİ \x1c\x85 \n\t  'sll1٣漢字🙂.,!\u0301zqx</w>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [t or "" for _, t, *_ in AWKWARD] + ["</w>", "a</w>b <|startoftext|>", "zqzqzq xkcdq"] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t, (ids, decoded) in zip(texts, codec.encode_batch(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert decoded == lib.decode(want, skip_special_tokens=False) == codec.decode(want)
    got = bpe_codec.encode_documents(docs, path).collect()
    assert len(got) == len(AWKWARD) and all(len(r.ids) == 0 for r in got if r.doc_id in (3, 4))
    assert bpe_codec.encode_documents(docs.limit(0), path).count() == 0


def test_forced_cuts_are_inside_words():
    codec = bpe_codec.ForcedBoundaryBPE(public_tokenizers.path("word_bpe_49k.json"))
    assert len(codec.fragments("zqzqzq")) > 1


def test_language_id_renames_carried_columns_whose_names_are_taken(spark):
    docs = spark.createDataFrame([(1, "ein Wort", "a", "b", "c", "d"), (2, None, None, None, None, None)], "doc_id long, text string, score string, lang_pred string, _text string, _score string")
    out = language_id.identify(docs, language_id.ByteCNN.fresh(["de", "en"]), keep=["score", "lang_pred", "_text", "_score", "doc_id"])
    assert out.columns == ["doc_id", "_score", "_lang_pred", "__text", "__score", "_doc_id", "lang_pred", "score"]
    rows = {r[0]: r for r in out.collect()}
    assert tuple(rows[1])[1:6] == ("a", "b", "c", "d", 1) and rows[1][6] in ("de", "en") and 0 <= rows[1][7] <= 1
    assert tuple(rows[2]) == (2, None, None, None, None, 2, "und", 0.0)
