"""The whole pipeline against plain Python, stage by stage, and on odd tables."""

import collections
import hashlib
import math

import numpy as np
import public_tokenizers as P
import pytest
from test_quality_and_lines import SCHEMA, WORD, brute_links, brute_verdicts

import corpus_pipeline
from splatarium.llm import bpe, common, source_mix

SF = "/root/testdata/sf0.001"


def brute_lines(docs, percent=5):
    pages, seen = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, _, source, _ in docs:
        if text is not None:
            pages[source].add(text)
            for line in text.split("\n"):
                seen[source, line].add(text)
    out = []
    for i, text, lang, source, n in docs:
        if text is not None:
            gone = lambda x: WORD.search(x) and len(seen[source, x]) > 1 and 100 * len(seen[source, x]) > percent * len(pages[source])  # noqa: B023, E731
            text = "\n".join(x for x in text.split("\n") if not gone(x))
        out.append((i, text, lang, source, len(text) if text is not None else None))
    return out


def brute_mix(docs, mix=source_mix.Mix()):
    """How often each document comes: targets by sharing out again and again, blocks, and the schedule slot by slot."""
    size = [len(WORD.findall(d[1] or "")) for d in docs]
    names = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, d in zip(size, docs) if d[3] == s) for s in names}
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(names)}
    target, left, free = {}, sum(size) * mix.share_percent / 100, set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= mix.most_times * total[s]]
        if not over:
            break
        for s in over:
            target[s] = float(mix.most_times * total[s])
            left -= target[s]
            free.discard(s)
        if not free:
            break
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    length, blocks, slots = {}, {}, {}
    for s in names:
        n = max(-(-total[s] // mix.block_words), min(total[s], mix.min_blocks), 1)
        length[s] = max(-(-total[s] // n), 1)
        blocks[s] = -(-total[s] // length[s])
        slots[s] = min(math.floor(target[s] / length[s] + 0.5), mix.most_times * blocks[s])
    k, times, nth = sum(slots.values()), collections.Counter(), collections.Counter()
    edges = np.cumsum([0, *(slots[s] for s in names)])
    for slot in range(k):
        at = slot * source_mix.GOLDEN % source_mix.POINTS * k // source_mix.POINTS
        s = names[int(np.searchsorted(edges, at, side="right")) - 1]
        if nth[s] < mix.most_times * blocks[s]:
            times[s, nth[s] % blocks[s]] += 1
        nth[s] += 1
    start, copies = collections.Counter(), {}
    for n, d in sorted(zip(size, docs), key=lambda x: (hashlib.md5(f"{mix.seed}:{'' if x[1][0] is None else x[1][0]}".encode()).hexdigest(), x[1][0] or 0, x[0])):
        copies[d[0]] = max(copies.get(d[0], 0), times[d[3], start[d[3]] // length[d[3]]] if n else 0)
        start[d[3]] += n
    return [d for d in docs for _ in range(copies[d[0]])]


def fixture(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = [d for d in docs if d[2] == "en" and 200 < len(WORD.findall(d[1] or "")) < 600][:3]
    extra = [(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, good[0][1], "en", None, None), (9004, good[1][1] + " more words", "en", "new", 1), (9005, good[2][1].upper(), None, None, 3)]
    return docs + extra


def test_run_against_plain_python(spark, tmp_path, monkeypatch):
    docs = fixture(spark)
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [d for d, v in zip(docs, brute_verdicts([(d[1], d[2]) for d in docs])) if v[0]]
    cleaned = brute_lines(kept)
    links = brute_links([(d[0], d[1]) for d in cleaned], 5, 80)
    alone = [d for d in cleaned if links[d[0]][1] == d[0]]
    mixed = brute_mix(alone)
    encode = bpe.tiktoken_encoding(P.path("byte_bpe_50k.tiktoken")).encode_ordinary
    want = sorted((d[0], d[2] or "", d[3] or "", np.array(encode(d[1] or ""), "<u4").tobytes()) for d in mixed)
    tables, saved = {}, common.saved
    monkeypatch.setattr(common, "saved", lambda df, name: tables.setdefault(name, saved(df, name)) if name.startswith("stage-") else saved(df, name))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.lang or "", r.source or "", bytes(r.ids)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got) and {d[0] for d in mixed} < {d[0] for d in docs} and len(kept) > len(alone) > 20
    # what each stage left for the next
    for (name, _), rows in zip(corpus_pipeline.STAGES, (kept, cleaned, alone, mixed)):
        assert tables[f"stage-{name}"].columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(str, map(tuple, tables[f"stage-{name}"].collect()))) == sorted(map(str, rows)), name


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_odd_tables(spark, tmp_path, kind):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with the names that stages use inside."""
    text = " ".join(f"the w{k}" for k in range(300))
    rows = [(None, None, None, None, None), (1, None, None, None, None), (None, text, "xx", None, None), (4, "", "en", "s", 0)] + [(2, text.upper(), "yy", "s", 5)] * 3
    rows += [(3, "\n".join(f"the line {k} of the long text" for k in range(40_000)), "en", "s", 5)]
    df = spark.createDataFrame(rows if kind == "odd" else [], SCHEMA)
    before = df.selectExpr("*", "1 AS ids", "2 AS kept", "3 AS host", "4 AS lines", "5 AS copies", "6 AS common", "7 AS size", "8 AS rid")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.saved(stage(spark, before, str(tmp_path)), name)
        assert after.columns == before.columns, name
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == (set() if kind == "empty" else {None, 2, 3})
