import collections
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from tokenizers import Tokenizer

from splatarium.llm import bpe, chat_format, common, grammar_store, pretokens, tiff, warc

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PARTS = ["a", "B", "é", "文", " ", "  ", "\n", "\n\n", "\t", "\xa0", "'s", "'re", "'", "1", "22", ".", "!?", "😀", "\x1c", "́", "<|endoftext|>", "'ll ", " 's", "\x85"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    return ["".join(r.choice(PARTS) for _ in range(r.choice([0, 1, 3, 30, 800, 3000]))) for _ in range(150)] + ["a" * 5000, " " * 3000, "\n " * 2000, "x y" * 900]


def test_pretokens(texts):
    """Breaks by classes are those of the pattern, also where texts share a slice."""
    r, find = random.Random(3), regex.compile(P.PATTERN).findall
    assert pretokens.PATTERN == P.PATTERN
    some = ["".join(r.choice(kind) for _ in range(r.choice([0, 1, 2, 3, 8, 40]))) for kind in (PARTS, "ab 1.'s\nt", ["'", "s", "ll", "ve", " ", "''", "ama", "\r\n", "\u3000", "½"]) for _ in range(1500)]
    for limit in (1, 60, 1 << 20):
        for _, buf, off in common.slices(pa.array(texts + some), limit):
            want = [(int(a), t) for a, b in zip(off, off[1:]) for t in find(bytes(buf[a:b]).decode())]
            at, ends = [], {}
            for a, t in want:
                at.append(ends.get(a, a))
                ends[a] = at[-1] + len(t.encode())
            assert pretokens.starts(buf, off, pretokens.tiktoken_classes()).tolist() == at == pretokens.starts(buf, off, pretokens.tokenizers_classes()).tolist()


def test_every_code_point():
    """Ids are the libraries' for all code points: before a contraction, a letter, a digit
    and a space, and behind a letter."""
    every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    lines = ["".join(f"\n{ch}'s{ch}a{ch}1{ch} a{ch}{ch}" for ch in every[a : a + 2048]) for a in range(0, len(every), 2048)]
    texts = pa.array(lines)
    want = bpe.tiktoken_encoding(RANKS).encode_ordinary_batch(lines)
    for _, buf, off in common.slices(texts):
        ids, start, upto = bpe._ids(buf, off, RANKS, bpe.CHUNK, bpe.OVERLAP)
        for got in np.split(ids, upto[np.searchsorted(start, off[1:-1])]):
            assert got.tolist() == want.pop(0)
    assert not want
    ids, counts = grammar_store.json_encoder(JSON)(texts)
    want = Tokenizer.from_file(JSON).encode_batch(lines, add_special_tokens=False)
    for got, w in zip(np.split(ids, np.cumsum(counts)[:-1]), want, strict=True):
        assert got.tolist() == w.ids


def test_chunks_fall_in_step(texts):
    """Stitched chunks give the pre-tokens of the whole text; most chunks of ordinary text are stitched."""
    r = random.Random(4)
    some = texts + ["".join(r.choice(["'", "s", "''", " ", "'s", "é", "文", "\u3000", "。", "1"]) for _ in range(r.choice([50, 900, 3000]))) for _ in range(100)]
    for chunk, overlap in ((64, 40), (100, 48), (600, 64)):
        for _, buf, off in common.slices(pa.array(some), 1 << 16):
            assert bpe.stitched_starts(buf, off, chunk, overlap)[0].tolist() == pretokens.starts(buf, off, pretokens.tiktoken_classes()).tolist()
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"]
    stitches = sum(bpe.stitched_starts(buf, off)[1] for _, buf, off in common.slices(docs))
    full = sum(max(0, len(t.encode()) - 1) // bpe.CHUNK for t in docs.to_pylist() if t)
    assert stitches == full > 100


@pytest.mark.parametrize("segment", [1 << 20, 600])
def test_bpe_chunks(spark, texts, segment):
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, None, 1), (7, "twice " * 500, 2), (7, "twice " * 500, 2), (8, "long, é " * 9000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = bpe.decode(bpe.encode(df, RANKS, chunk=200, segment=segment, overlap=64), RANKS).collect()
    plain = bpe.tiktoken_encoding(RANKS).encode_ordinary
    key = lambda r: (str(r[0]), r[1] or "")
    want = sorted(((i, t, np.array(plain(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows), key=key)
    assert sorted(((r.doc_id, r.text, bytes(r.ids), bytes(r.decoded)) for r in out), key=key) == want
    bare = bpe.encode(df, RANKS, chunk=200, segment=segment, overlap=64, keep_text=False)
    assert bare.columns == ["doc_id", "ids"] and sorted(bytes(r.ids) for r in bare.collect()) == sorted(x[2] for x in want)
    assert bpe.encode(df.limit(0), RANKS).count() == 0


def test_op8_on_documents(spark):
    """The whole query against the library, text by text."""
    plain = bpe.tiktoken_encoding(RANKS).encode_ordinary
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = plain(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op8_chunked_bpe(spark, "/root/testdata/sf0.001").collect()} == want


def test_shards_against_the_library(spark, texts):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(None, "x"), (3, "aaaa " * 500), (3, "aaaa " * 500), (2, None)]
    shards = grammar_store.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), JSON, shard_ids=5000)
    got = grammar_store.read_documents(shards).orderBy("start").collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows]
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == ids
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    data = bytes(shards.orderBy("part", "shard").first().data)
    shard = grammar_store.Shard(data)
    assert len(shard.rules) and int((np.diff(shard.first) > 0).sum()) == len(shard.doc_ids) and shard.document(1).tolist() == ids[1] and shard.length.sum() == len(shard.flat)
    assert grammar_store.read_documents(grammar_store.write_shards(shards.selectExpr("n_ids AS doc_id", "'' AS text").limit(0), JSON)).count() == 0
    with pytest.raises(ValueError):
        grammar_store.Shard(b"nothing here, really nothing")


def test_op3_added_tokens(spark, texts, tmp_path):
    """op3 gives added tokens their ids, as the library does by default."""
    tok = Tokenizer.from_file(JSON)
    rows = list(enumerate([*texts[:40], "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "no token"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [[*tok.encode(t, add_special_tokens=False).ids, 2] for _, t in rows]
    assert ids[40] == [64, 220, 50256, 275, 2]
    got = grammar_store.op3_repair_shards(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == list(map(len, ids))
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()


def pairs(symbols, starts):
    """How often each pair of neighbours stands in what is left of a shard."""
    ends = set((starts[1:] - 1).tolist())
    return collections.Counter((a, b) for k, (a, b) in enumerate(zip(symbols.tolist(), symbols[1:].tolist())) if k not in ends)


@pytest.mark.parametrize("sorted_upto", [0, 1 << 17])
@pytest.mark.parametrize("seed", range(5))
def test_re_pair_round_trip(monkeypatch, seed, sorted_upto):
    monkeypatch.setattr(grammar_store, "SORTED", sorted_upto)
    g = np.random.default_rng(seed)
    sizes = [int(n) for n in g.integers(1, 900, 60)]
    docs = [g.integers(0, (2, 5, 300, 50257, 9)[seed], n).astype(np.uint32) for n in sizes]
    if seed == 4:  # copies, and one symbol again and again
        docs = [docs[0]] * 40 + [np.full(n, 7, np.uint32) for n in sizes[40:]]
    s = grammar_store.Shard(grammar_store.pack([*range(59), None], np.concatenate(docs), np.array([len(d) for d in docs]), 50257))
    assert all((s.document(k) == docs[k]).all() for k in range(60)) and s.null.tolist() == [0] * 59 + [1]
    # it went on until no pair is frequent, and no rule stands for a pair that never was
    assert max(pairs(s.symbols, s.starts).values(), default=0) < grammar_store.LEAST
    first = pairs(np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    assert all(first[tuple(r)] >= grammar_store.LEAST for r in s.rules.tolist() if max(r) < 50257)
    assert seed > 1 or len(s.symbols) < sum(map(len, docs)) / (7, 3)[seed]  # random ids of 1 and 2.3 bits
    assert seed != 4 or len(s.symbols) < 60 * 12


def test_re_pair_looks_at_less_each_round(monkeypatch):
    """Pairs that were too rare are not looked at again, and yet no frequent one is left."""
    rng, looked, slots = np.random.default_rng(5), [], grammar_store._slots
    monkeypatch.setattr(grammar_store, "_slots", lambda left, right, turn: looked.append(len(left)) or slots(left, right, turn))
    ids = np.where(rng.random(60_000) < 0.1, np.tile(np.arange(8), 7500), rng.integers(10, 40_000, 60_000)).astype(np.uint32)
    ids[:3000] = 7
    ends = rng.random(60_000) < 0.01
    ends[-1] = True
    seq, rules, last = grammar_store.re_pair(ids, ends, 50_000)
    assert len(rules) and len(looked) > 3 and looked[-1] < len(seq) / 10 and last.sum() == ends.sum()
    often = collections.Counter((a, b) for a, b, e in zip(seq.tolist(), seq[1:].tolist(), last.tolist()) if not e)
    # a run of one symbol counts every second place
    assert all(n < grammar_store.LEAST for n in often.values())


def test_memory_of_pretokens():
    """The same ids from new pre-tokens, remembered ones and after all were forgotten."""
    asked = []

    def encode(new):
        asked.extend(new)
        return [[len(t.encode()), *t.encode()] for t in new]

    memory = pretokens.Memory(encode, 4)
    for text in ("a bb ccc bb", "bb ccc", "x é 文字 a", "one two three four five", "a a a", "", "a"):
        raw = np.frombuffer(text.encode(), np.uint8)
        start = pretokens.starts(raw, np.array([0, len(raw)]), pretokens.tokenizers_classes())
        ids, n = memory.ids(raw, start)
        parts = [raw[a:b].tolist() for a, b in zip(start, [*start[1:], len(raw)])]
        assert ids.tolist() == [x for p in parts for x in (len(p), *p)] and n.tolist() == [len(p) + 1 for p in parts]
    assert asked.count(" bb") == 1 and asked.count("a") > 1


def test_tiff_codecs():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 100, 3000, 20000):
        for kind in range(3):
            d = bytes(r.randrange(256) if kind == 0 else r.choice(b"ab") if kind == 1 else 0 for _ in range(n))
            assert tiff.packbits_decode(tiff.packbits_encode(d), n) == d and tiff.lzw_decode(tiff.lzw_encode(d), n) == d


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_pages_of_all_kinds(order, kind):
    g = np.random.default_rng(1)
    for predictor in (1, 2):
        for tile in (None, (16, 32)):
            for spp in (1, 3):
                image = g.integers(0, 40, (37, 50, spp)).astype(np.uint8)
                got = list(tiff.read_pages(tiff.write_pages([(image, kind, predictor, tile, 7), (image[:5], kind, predictor, tile, 2)], order)))
                assert [p["samples"] for p in got] == [image.tobytes(), image[:5].tobytes()] and got[0]["tiled"] == bool(tile)


def test_tiff_operator(spark):
    texts = [None, "", "x", "é" * 96, "y" * 193, "long text " * 2000, "long text " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS page", "'e' AS error")
    files = tiff.texts_to_tiff(df)
    pages = tiff.tiff_pages(files).orderBy("doc_id").collect()
    assert sum(p.doc_id == 5 for p in pages) == 3
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        raw += b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert b"".join(bytes(p.samples) for p in pages if p.doc_id == i) == raw
    assert pages[0].error is None and "e" not in {p.error for p in pages}
    share = collections.Counter()
    for p in pages:
        if p.doc_id == 5:
            share[p.compression] += len(p.samples)
    assert max(share.values()) - min(share.values()) <= 192
    good = tiff.text_to_tiff("good " * 300)
    broken = spark.createDataFrame([(1, bytearray(b"II*\0\x08\0\0\0")), (2, None), (3, bytearray(b"xx")), (4, bytearray()), (5, bytearray(good)), (6, bytearray(good[:-30]))], "doc_id long, media binary")
    out = collections.defaultdict(list)
    for r in tiff.tiff_pages(broken).collect():
        out[r.doc_id].append((r.page, r.error is not None))
    assert sorted(out) == [1, 3, 5, 6] and out[1] == out[3] == [(None, True)] and [p for p, _ in out[5]] == [0, 1, 2]
    assert [p for p, _ in out[6]][-1] is None and out[6][-1][1]
    got = {r.doc_id: r for r in tiff.op5_tiff_pages(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        raw = (r.text or "").encode()
        pad = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        g = got[r.doc_id]
        assert g.error is None and g.n_pages == min(3, len(pad) // 192)
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_broken_files(kind):
    """Cut and flipped files give pages or an error of the kinds that are reported, in bounded time."""
    g = np.random.default_rng(kind)
    image = g.integers(0, 9, (70, 50, 1)).astype(np.uint8)
    data = tiff.write_pages([(image, kind, 2, (16, 32), 7), (image[:9], kind, 1, None, 4)])
    for k in range(400):
        bad = bytearray(data[: int(g.integers(0, len(data)))] if k % 4 == 0 else data)
        for at in g.integers(0, max(1, len(bad)), int(g.integers(1, 6))).tolist() if bad else []:
            bad[at] = int(g.integers(0, 256))
        if k % 2 and len(bad) > 400:  # in the directories, which stand at the end of each page
            bad[-int(g.integers(1, 250))] = int(g.integers(0, 256))
        try:
            assert all(len(p["samples"]) == p["width"] * p["height"] * p["samples_per_pixel"] for p in tiff.read_pages(bytes(bad)))
        except Exception as e:
            assert not isinstance(e, (MemoryError, RecursionError, AssertionError))


def test_tiff_long_text_has_more_pages(spark, monkeypatch):
    monkeypatch.setattr(tiff, "PAGE_ROWS", 10)
    text = "line of a long text " * 1000
    pages = list(tiff.read_pages(tiff.text_to_tiff(text)))
    assert len(pages) == 12 and b"".join(p["samples"] for p in pages).rstrip() == text.encode().rstrip()


def test_tiff_loop_ends():
    data = bytearray(tiff.write_pages([(np.zeros((2, 3, 1), np.uint8), tiff.NONE, 1, None, 2)]))
    data[-4:] = data[4:8]  # the last directory points to the first
    assert len(list(tiff.read_pages(bytes(data)))) == 1


def test_chat(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "user", "a\\</s>\\\\[INST"), (1, 1, "assistant", "$1 [/OUT]</s>\n\\"), (1, None, "system", "[SYS]x"), (2, 0, None, None), (2, 1, "tool[/ROLE]", "x[/TURN]\n"), (2, 1, "tool[/ROLE]", "x[/TURN]\n"),
        (3, 0, "assistant", ""), (None, 1, "user", "ü😀"), (4, 0, "user", hard), (4, 1, "assistant", hard), (5, 0, "user", " "), (5, 1, "assistant", "[OUT"), (5, 2, "user", " [/INST"), (5, 3, "assistant", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS valid", "2 AS turns")
    formatted = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in turns]
        assert list(got[conv].learnt) == [r[3] or "" for r in turns if r[2] == "assistant"]
    assert [got[k].valid for k in (1, 2, 3, 4, 5, None)] == [True, False, False, True, True, False]
    segments = {r.conv_id: r for r in formatted.collect()}
    assert "".join(s.text for s in segments[1].segments if s.loss) == segments[1].formatted[segments[1].loss_spans[0].start :][: segments[1].loss_spans[0].length]
    assert chat_format.format_chats(df.limit(0)).count() == 0
    plan = chat_format.op2_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_warc(spark, tmp_path):
    a = "x" * 1500
    rows = [(1, "http://h/a", a), (5, "http://h/b?q", a), (3, None, a), (5, "http://h/b?q", a), (None, "u\r\nv: w", a), (7, "q", None), (8, "q", ""), (9, "q", "short"), (10, "q", "short"), (11, "q", "WARC/1.1\r\n\r\né" * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS sha1", "2 AS payload")
    archives = warc.write_archives(df, archive_bytes=900)
    assert archives.count() > 1
    got = warc.assemble(warc.read_records(archives)).collect()
    seen = sorted((r.metadata[0].fields["page-id"][0], r.response.kind, r.response.length, bytes(r.response.payload or b"")) for r in got)
    revisit = lambda i, h: len(h or "") >= 1000 and i != 5
    want = sorted((str(i) if i is not None else "", "revisit" if revisit(i, h) else "response", len((h or "").encode()), b"" if revisit(i, h) else (h or "").encode()) for i, _, h in rows)
    assert seen == want and all(len(r.requests) == 1 for r in got)
    # every revisit names a response that is there, of the largest page
    pages = {r.capture: r.metadata[0].fields["page-id"][0] for r in got}
    assert len(pages) == len(rows) and {pages[r.response.refers_to] for r in got if r.response.kind == "revisit"} == {"5"}
    # the same from a plain file, with a record that names no capture
    data = b"".join(b for r in archives.orderBy("name").collect() for b in [bytes(r.data)])
    (tmp_path / "one.warc.gz").write_bytes(data)
    (tmp_path / "two.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n")
    again = warc.assemble(warc.read_records(warc.read_files(spark, str(tmp_path)))).collect()
    assert len(again) == len(rows) + 1 and sum(r.response is None for r in again) == 1
    assert warc.assemble(warc.read_records(warc.write_archives(df.limit(0)))).count() == 0


def record(kind, rid, block, *more):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{rid}>", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_of_others(spark):
    """Repeated fields, several requests, a record of two captures, odd digests, damage."""
    http = "Content-Type: application/http; msgtype=response"
    good = [
        record("warcinfo", "i", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("response", "a", b"HTTP/1.1 200 OK\r\n\r\nhello", http, "WARC-Payload-Digest: sha1:not base 32 at all, but 32 long!"),
        record("request", "q2", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:a>", http),
        record("request", "q1", b"GET /x HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:a>", http),
        record("metadata", "m", b"outlink: one\r\noutlink: two\r\n  folded\r\nvia: z", "WARC-Concurrent-To: <urn:a>", "WARC-Concurrent-To: <urn:b>", "Content-Type: application/warc-fields"),
        record("response", "b", b"HTTP/1.1 200 OK\r\n\r\n", http, "WARC-Payload-Digest: sha1:" + "0" * 40),
        record("resource", "r", b"plain"),
    ]
    cut = gzip.compress(good[1])[:-12]
    flipped = bytearray(gzip.compress(good[5]))
    flipped[len(flipped) // 2] ^= 255
    bad = [record("response", "c", b"x", http).replace(b"Content-Length: 1", b"Content-Length: one"), b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Re", record("response", "d", b"HTTP/1.1 200 OK\r\n\r\nlong", http)[:-9]]
    files = [b"".join(map(gzip.compress, good)), b"".join(good), cut, bytes(flipped) + gzip.compress(good[0]), *bad, b"", None, b"no archive"]
    df = spark.createDataFrame([(str(k), None if x is None else bytearray(x)) for k, x in enumerate(files)], "name string, data binary")
    for one in (files[0], files[1]):
        got = {r.capture: r for r in warc.assemble(warc.read_records(df.filter(df.data == one))).collect()}
        assert sorted(got) == ["urn:a", "urn:b"] and [q.record_id for q in got["urn:a"].requests] == ["urn:q1", "urn:q2"] and not got["urn:b"].requests
        assert all(r.metadata[0].fields == {"outlink": ["one", "two folded"], "via": ["z"]} for r in got.values())
        assert bytes(got["urn:a"].response.payload) == b"hello" and got["urn:a"].response.digest is None and got["urn:b"].response.digest == "0" * 40
    for k, n in ((2, 0), (3, 1), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0)):
        rows = warc.read_records(df.filter(df.name == str(k))).collect()
        assert sum(r.error is None for r in rows) == n and (k in (7, 8)) == (not any(r.error for r in rows)), k
    assert warc.assemble(warc.read_records(df.filter("name in ('2', '4', '5', '6')"))).count() == 0


def test_warc_broken_files():
    """Cut and flipped archives give rows or errors, never an exception."""
    g = np.random.default_rng(1)
    plain = b"".join(record("response", k, b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 50 * k, "Content-Type: application/http") for k in range(6))
    packed = b"".join(gzip.compress(plain[a : a + 200]) for a in range(0, len(plain), 200))
    for data in (plain, packed):
        for k in range(300):
            bad = bytearray(data[: int(g.integers(0, len(data)))] if k % 3 == 0 else data)
            for at in g.integers(0, max(1, len(bad)), int(g.integers(1, 8))).tolist() if bad else []:
                bad[at] = int(g.integers(0, 256))
            for row in warc.parse_records(bytes(bad)):
                assert len(warc._record_row(*row)) == len(warc._RECORD_KINDS)
