import collections
import itertools
import math
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from splatarium.llm import common, jaccard_join, line_dedup, ordinal_quality, quality_rules, queries, source_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the cat of a house\nwent to the sea " * 40
TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h a b c d e f g h", "Ünï cödé #*$%&|<> 文字 😀\n\nx\nx\n y\nx", LONG, LONG, "w " * 5000, "\n".join(["same line"] * 30), "a b c\x0bd",
]


def frame(spark, texts, more=""):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    df = frame(spark, TEXTS).repartition(3)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.count_texts(df, quality_rules.common_words(df), carry=("doc_id",)).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(TEXTS)}


def test_counts_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.op1_quality_divergence(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        want, g = brute_counts(r.text), got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not g.base_failed or not g.kept)


def test_js_distance(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 0.0], [0.0, 3.0]), ([2.0, 2.0], [5.0, 5.0]), ([0.0, 0.0], [1.0, 1.0])], "p array<double>, q array<double>")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    df = df.withColumn("sp", total("p")).withColumn("sq", total("q"))
    got = [r[0] for r in df.select(quality_rules.js_distance(F.col("p"), F.col("sp"), F.col("q"), F.col("sq"))).collect()]
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0) and got[2] is None


def brute_verdicts(rows, rules=quality_rules.Rules()):
    """kept and both distances of (text, lang) rows, from counters and plain arithmetic."""
    low = lambda w: "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in w)

    def kind(ch):
        cat = unicodedata.category(ch)
        if ch in " \t\n\x0b\x0c\r" or cat[0] == "Z":
            return "space"
        if ch in quality_rules.SENTENCE_MARKS:
            return "sentence"
        return cat if cat in ("Ll", "Lu") else cat[0]

    words = [[low(w) for w in WORD.findall(t or "")] for t, _ in rows]
    total, often = collections.Counter(), collections.defaultdict(collections.Counter)
    for ws, (_, lang) in zip(words, rows):
        total[lang] += len(ws)
        often[lang].update(ws)
    common = {lang: {w for w, n in x.items() if n * quality_rules.COMMON >= total[lang]} for lang, x in often.items()}
    hists = [(collections.Counter(map(kind, t or "")), collections.Counter(w if w in common[lang] else None for w in ws)) for ws, (t, lang) in zip(words, rows)]
    counts = [brute_counts(t) for t, _ in rows]
    failed = [c[0] < rules.min_words or 100 * c[4] > rules.max_repeat_percent * c[0] for c in counts]
    refs = collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
    for h, bad, (_, lang) in zip(hists, failed, rows):
        for x, y in zip(refs[lang], h):
            x.update({} if bad else y)

    def distance(p, q):
        sp, sq = sum(p.values()), sum(q.values())
        if not sp or not sq:
            return None
        out = 0.0
        for k in set(p) | set(q):
            a, b = p[k] / sp, q[k] / sq
            out += sum(x * math.log2(2 * x / (a + b)) / 2 for x in (a, b) if x)
        return math.sqrt(max(out, 0.0))

    made = []
    for (t, lang), h, bad, c in zip(rows, hists, failed, counts):
        chars = distance(h[0], refs[lang][0]) if len(t or "") >= rules.min_chars else None
        wordy = distance(h[1], refs[lang][1]) if c[0] >= rules.min_words_for_histogram else None
        made.append((not bad and (chars or 0) <= rules.max_char_distance and (wordy or 0) <= rules.max_word_distance, chars, wordy))
    return made


@pytest.mark.parametrize("sf", ["", "0.001"])
def test_verdicts(spark, sf):
    """Common words, references, guards, distances and verdicts against plain Python."""
    if sf:
        rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()]
    else:
        r = random.Random(8)
        good = [" ".join(r.choice(["the", "of", "a", "sea", "House", "ship", "old", "Ünder", "文"]) + r.choice(["", "", ".", ","]) for _ in range(n)) for n in (19, 20, 99, 100, 150, 400, 800, 800)]
        odd = [" ".join(r.choice(["#x#", "$1", "||", "QQ"]) + str(k) for k in range(n)) for n in (40, 99, 100, 600)]
        texts = [*good, *odd, *TEXTS, good[-1], " ".join(f"t{k}" for k in range(300_000))]
        rows = [(k, t, (None, "en", "xx")[k % 3] if k < 24 else f"own{k}") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counted = common.saved(quality_rules.count_texts(df, quality_rules.common_words(df), carry=("doc_id", "lang")), "counted")
    got = {r.doc_id: r for r in quality_rules.with_verdicts(counted, quality_rules.language_references(counted)).collect()}
    for (i, _, _), (kept, chars, words) in zip(rows, brute_verdicts([r[1:] for r in rows])):
        assert got[i].kept == kept and got[i].char_distance == (None if chars is None else pytest.approx(chars, abs=1e-9)) and got[i].word_distance == (None if words is None else pytest.approx(words, abs=1e-9))
    assert sf or 2 < sum(r.kept for r in got.values()) < len(got)


def test_apply_rules_keeps_columns(spark):
    df = frame(spark, [*TEXTS, " ".join(f"word{k} of the house" for k in range(30))]).withColumnRenamed("n_chars", "n_words").withColumnRenamed("source", "common")
    out = quality_rules.apply_rules(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [11]
    twice = quality_rules.apply_rules(df.filter("doc_id = 11").unionByName(df.filter("doc_id = 11")))
    assert [(r.doc_id, r.n_words) for r in twice.collect()] == [(11, 7)] * 2
    assert quality_rules.apply_rules(df.limit(0)).count() == 0


def test_line_dedup(spark):
    rows = [(i, "menu\nbody %d\n\nx" % i if i % 2 else "body %d\n" % i, "h" if i < 30 else None, i, i) for i in range(60)] + [(99, None, "h", 0, 0), (98, "menu", "few", 0, 0)]
    long = "\n".join(f"line {k}" for k in range(100_000))
    rows += [(97, long + "\nmenu", "few", 0, 0), (96, long, "other", 0, 0), (95, "", "other", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines long, page long")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, host="source").collect()}
    assert got[1].text == "body 1\n" and got[1].n_lines == 4 and got[1].n_dropped == 2 and got[1].page == 1
    assert got[2].text == "body 2\n" and got[99].text is None and got[98].text == "" and got[97].text == long and got[96].text == long and got[95].text == ""
    assert line_dedup.drop_boilerplate(df.limit(0), host="source").count() == 0
    plan = line_dedup.op7_site_line_frequency(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_line_at_exactly_the_share(spark):
    """2 of 40 pages are 5 percent and stay; 2 of 39 are more. Copies are pages too, unless they are to count once, and repeated lines of a page count once."""
    rows = [(i, f"both\nboth\nown {i}" if i % 40 < 2 else f"only {i}", f"h{i // 40}") for i in range(79)] + [(100, "same", "twice"), (100, "same", "twice"), (101, None, "twice")]
    for once in (False, True):
        got = collections.defaultdict(list)
        for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, host string"), copies_once=once).collect():
            got[r.doc_id].append((r.text, r.n_dropped))
        assert got[0] == [("both\nboth\nown 0", 0)] and got[40] == [("own 40", 2)] and got[50] == [("only 50", 0)] and got[100] == [("same", 0) if once else ("", 1)] * 2 and got[101] == [(None, 0)]


def brute_frequent(rows, percent, once):
    """(id, text) of (id, host, text) rows after their frequent lines went, page by page."""
    out = []
    for i, host, text in rows:
        pages = [t for _, h, t in rows if h == host and t is not None]
        pages = set(pages) if once else pages
        on = lambda line: sum(line in t.split("\n") for t in pages)  # noqa: E731, B023
        gone = lambda line: WORD.search(line) and on(line) > 1 and 100 * on(line) > percent * len(pages)  # noqa: E731, B023
        out.append((i, text if text is None else "\n".join(x for x in text.split("\n") if not gone(x))))
    return sorted(out, key=str)


@pytest.mark.parametrize("once", [False, True])
def test_mirrored_pages(spark, once):
    """Hosts whose pages stand there several times, in plain Python and in SQL."""
    import duckdb

    r = random.Random(6)
    pages = ["\n".join(r.choice(["menu", "foot", "", f"own {k}", f"own {k} b", " "]) for _ in range(6)) for k in range(25)] + [None, ""]
    rows = [(i, r.choice(["a", "a", "b", "c", None]), r.choice(pages[: 8 if i % 2 else 27])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    got = line_dedup.drop_boilerplate(df, percent=10, copies_once=once).select("id", "host", "text", "n_lines", "n_dropped").toPandas()
    assert sorted(((i, None if t is None else t) for i, t in zip(got.id.tolist(), got.text.where(got.text.notna(), None))), key=str) == brute_frequent(rows, 10, once)
    table = df.toPandas()  # noqa: F841
    want = duckdb.sql(line_dedup.frequency_sql("SELECT id, host, text FROM table", 10, once).replace("FROM table", 'FROM "table"')).df()[list(got.columns)]
    a, b = (x.astype({"n_lines": "int64", "n_dropped": "int64"}).astype(str).replace("nan", "None").sort_values("id", ignore_index=True) for x in (got, want))
    assert a.equals(b) and got.n_dropped.sum() > 20


def test_host_pages(spark):
    html = "<!DOCTYPE html><HTML><head><title>T &amp;lt; t</title><STYLE type='x'>p{}</style ><script>if (a<b) \"</p>\"</script></head><body ><p>one <b>bo</b>ld<br/>two &lt;&quot;&nbsp;\t\n\n  three</p><!-- <p>no</p> --><li\nclass=x>li"
    rows = [(1, "HTTPS://user:pw@Www.Ex.com:80/a?b", html, 5), (2, "no url", "a < b", 5), (3, None, None, 5), (4, "http:///x", "", 5)]
    got = line_dedup.host_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host long")).collect()
    assert {r.page_id: (r.host, r.text) for r in got} == {1: ("www.ex.com", 'T &lt; t\none bold\ntwo <"\n  three\nli'.replace("\n  ", "\n")), 2: (None, "a < b"), 3: (None, None), 4: (None, "")}


@pytest.mark.parametrize("percent", [5, 30])
def test_lines_of_documents_against_sql(spark, percent):
    """The operator on another table, with its sources as sites."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    got = line_dedup.drop_boilerplate(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text"), host="source", percent=percent).toPandas()
    want = duckdb.sql(line_dedup.frequency_sql(f"SELECT doc_id, source AS host, text FROM '{sf}/documents.parquet'", percent)).df().rename(columns={"host": "source"})
    cols = sorted(got.columns)
    a, b = (x[cols].astype({"n_lines": "int64", "n_dropped": "int64"}).astype(str).sort_values(cols, ignore_index=True) for x in (got, want))
    assert a.equals(b) and got.n_dropped.sum() > 0 or percent == 30


def test_pipeline_lines_of_small_sources(spark):
    """The share decides in a source of few pages too; a line on one page stays."""
    import corpus_pipeline

    rows = [(i, f"menu\nbody {i}", "en", "small", 0) for i in range(10)] + [(10, "menu\nalone", "en", "single", 0)]
    rows += [(20 + i, "foot\nat %d" % i if i < 19 else "no foot", "en", "nineteen" if i < 19 else "other", 0) for i in range(20)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.site_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    want = {**{i: f"body {i}" for i in range(10)}, 10: "menu\nalone", **{20 + i: f"at {i}" for i in range(19)}, 39: "no foot"}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def brute_links(rows, words, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in t or ""))
        sets.append((i, frozenset(tuple(w[a : a + words]) for a in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    label = {i: i for i, _ in sets if i is not None}
    links = collections.Counter()
    changed = True
    pairs = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[k + 1 :] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(s), label[i], links[i]) for i, s in sets}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (3, 75)])
def test_jaccard_join(spark, words, percent):
    g = np.random.default_rng(words * percent)
    vocab = [f"w{k}" for k in range(300)]
    passage = [vocab[k] for k in g.integers(0, 300, 40)]
    texts = []
    for size in (1, 2, 3, 6, 9, 12, 20, 45, 90, 200):
        base = [vocab[k] for k in g.integers(0, 300, size)]
        for _ in range(12):
            t = list(base)
            for _ in range(int(g.integers(0, 1 + max(1, size // 15)))):
                t[int(g.integers(0, len(t)))] = vocab[int(g.integers(0, 300))]
            texts.append(" ".join(t if g.random() < 0.7 else [*t, *passage]))
    texts += [None, "", "  ", texts[0].upper(), "w1 W1 w1", texts[50], texts[50]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(df, words=words, percent=percent).collect()}
    assert got == brute_links(rows, words, percent)


def test_jaccard_small_groups(spark, monkeypatch):
    """Families cut into many groups and blocks of asking sets find the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for members, asking, percent in ((3, 2, 90), (3, 1, 60)):
        monkeypatch.setattr(jaccard_join, "GROUP_MEMBERS", members)
        monkeypatch.setattr(jaccard_join, "SOME_MEMBERS", members)
        monkeypatch.setattr(jaccard_join, "ASKING", asking)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(docs, percent=percent).collect()}
        assert got == brute_links(rows, 3, percent)


@pytest.mark.parametrize("seed", range(6))
def test_tiles(seed, monkeypatch):
    """Links within a group, between groups, and of asking sets, against all pairs."""
    g = np.random.default_rng(seed)
    monkeypatch.setattr(jaccard_join, "_EXPANDED", int(g.integers(1, 500)))
    base = [np.unique(g.integers(0, 60, int(g.integers(1, 30)))) for _ in range(4)]
    sets = [np.unique(np.append(b[g.random(len(b)) > 0.1], g.integers(0, 60, 2))).astype(np.uint64) for b in base for _ in range(9)]
    rows = [(int(k), int(g.integers(1, 5)), x) for k, x in zip(g.permutation(len(sets)), sets)]
    link = lambda x, y: 100 * len(np.intersect1d(x[2], y[2])) >= 70 * len(np.union1d(x[2], y[2]))
    for first, second, asking in ((rows, [], []), (rows[:20], rows[20:], []), (rows[:15], [], rows[15:])):
        other = second or asking or first
        pairs = [(x, y) for x in first for y in other if x[0] != y[0] and link(x, y)]
        n, reach = collections.Counter(), {r[0]: r[0] for r in rows}
        for x, y in pairs:
            n[x[0]] += 0 if asking else y[1]
            n[y[0]] += x[1] if other is not first else 0
        for _ in rows:
            for x, y in pairs:
                reach[x[0]] = reach[y[0]] = min(reach[x[0]], reach[y[0]])
        want = sorted((k, reach[k], n[k]) for k in n)
        assert sorted(jaccard_join.tile_links(first, second, asking, 70)) == want


def test_jaccard_every_order(spark):
    """A null, an equal and a near row in every order, each in one partition."""
    text = " ".join(f"t{k}" for k in range(40))
    for rows in itertools.permutations([(None, text), (5, text), (3, text + " z")]):
        df = spark.createDataFrame(list(rows), "doc_id long, text string").coalesce(1)
        speak = {r.doc_id for r in jaccard_join._signature_rows(df, 3, 90).collect()}
        assert speak == {5, 3}  # the row without doc_id silences nobody
    got = [(r.doc_id, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame([(None, text), (3, text + " z"), (5, text)], "doc_id long, text string").coalesce(1)).collect()]
    assert sorted(got, key=str) == sorted([(None, 3, 2), (5, 3, 2), (3, 3, 2)], key=str)


def test_jaccard_very_long(spark):
    """Texts of 200,000 different words, near and far."""
    words = [f"w{k}" for k in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:199_000])), (3, " ".join(words[100_000:])), (4, "w0 w1 w2 w3")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (199_998, 1, 1), 2: (198_998, 1, 1), 3: (99_998, 3, 0), 4: (2, 4, 0)}


def test_jaccard_edges(spark):
    text = " ".join(f"t{k}" for k in range(40))
    df = spark.createDataFrame([(5, text), (5, text), (3, text + " z"), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.component_id) for r in jaccard_join.jaccard_join(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (-1, 3), (-1, None)], key=str)
    assert jaccard_join.jaccard_join(df.limit(0)).count() == 0
    kept = jaccard_join.one_of_each(df.filter("doc_id is not null").withColumnRenamed("text", "t").withColumn("h1", df.doc_id), text="t")
    assert [r.doc_id for r in kept.collect()] == [3] and kept.columns == ["doc_id", "t", "h1"]
    twice = jaccard_join.one_of_each(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in twice.collect()) == [1, 2]


def test_jaccard_null_id_first(spark):
    """A row without doc_id speaks for nobody, also where it comes first in its task."""
    text = " ".join(f"t{k}" for k in range(40))
    df = spark.createDataFrame([(None, text), (5, text), (3, text + " z")], "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.component_id) for r in jaccard_join.jaccard_join(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (5, 3), (3, 3)], key=str)


def test_mix(spark):
    sizes = {"a": 4000, "b": 900, "c": 30, None: 2500}
    rows, n = [], 0
    for s, total in sizes.items():
        left = total
        while left > 0:
            k = min(left, 1 + n * 7 % 90)
            rows.append((n, s, "w " * k))
            n, left = n + 1, left - k
    rows += [(n, "b", None), (n + 1, "a", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = source_mix.mix_sources(source_mix.sizes(df)).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    want = {"a": 1.0, "b": 1800.0, "c": 60.0, None: 1.5 * 7430 - 1860}  # b and c are capped, the rest goes by 5 : 5
    rest = 1.5 * 7430 - 1860
    want["a"], want[None] = rest / 2, rest / 2
    if want[None] > 5000:
        want[None], want["a"] = 5000.0, rest - 5000
    for s, part in out.groupby("source", dropna=False):
        key = None if s != s else s
        assert part.target.iloc[0] == pytest.approx(want[key]) and abs(part.taken.sum() - want[key]) <= 0.03 * want[key] + 3
    again = source_mix.mix_sources(source_mix.sizes(df.repartition(7))).toPandas()
    key = ["doc_id", "taken"]
    assert out[key].sort_values(key, ignore_index=True).equals(again[key].sort_values(key, ignore_index=True))
    mixed = source_mix.mixed_rows(df).groupBy("doc_id").count().toPandas()
    assert mixed["count"].max() <= 2
    assert source_mix.mix_sources(source_mix.sizes(df.limit(0))).count() == 0


def test_mix_edges(spark):
    """A very long text, a source of a third of all rows, null ids, repeated rows, and no rows at all."""
    rows = [(k, "hot", "w " * (1 + k % 5)) for k in range(400)] + [(None, "n", "a b")] * 3 + [(5000, "long", "x " * 300_000)] + [(7, "twice", "a b c")] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = source_mix.mix_sources(source_mix.sizes(df)).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    for _, part in out.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 0.02 * part.target.iloc[0] + 3
    assert source_mix.mixed_rows(df.limit(0)).count() == 0


def test_ordinal_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = ordinal_quality.train(docs, labels.filter("doc_id % 3 <> 0"))
    assert model[1][0] < model[1][1]
    held = ordinal_quality.score(docs.join(labels.filter("doc_id % 3 = 0"), "doc_id"), model).toPandas()
    bad, good = held[(held.toxic > 0) | (held.quality == 0)], held[(held.toxic == 0) & (held.quality == 1)]
    assert good.selected.mean() > 0.97 and bad.selected.mean() < 0.15
    assert good.expected_grade.mean() - bad.expected_grade.mean() > 1


def brute_features(text):
    """The features of a text as a dict, from strings and regular expressions."""
    raw = (text or "").encode()
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)]

    def place(w, stem):
        h = common.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
        return int((common.mix(h + np.uint64(1)) if stem else h)[0] >> np.uint64(64 - ordinal_quality.BITS))

    places = {place(w, False) for w in words} | {place(w[: ordinal_quality.STEM], True) for w in words if len(w) > ordinal_quality.STEM}
    out = dict.fromkeys(places, 1 / max(len(places), 1) ** ordinal_quality.SCALE)
    size, letters = max(len(raw), 1), max(sum(map(len, words)), 1)
    level = lambda x: min(max(int(x * 10), 0), 9)
    kinds = [
        level(math.sqrt(sum(ch in b"#*$%&|<>{}[]=_^~!?" for ch in raw) / size) * 1.5), level(sum(65 <= ch < 91 for ch in raw) / letters), level(len(places) / max(2 * len(words), 1)),
        min(int(math.log2(size)) // 2, 9), level(math.sqrt(raw.count(b"|") / size) * 3),
    ]
    return out | {(1 << ordinal_quality.BITS) + k * 10 + x: 1.0 for k, x in enumerate(kinds)}


def test_ordinal_query_on_documents(spark):
    """op4's scores against sums over dicts, with the model of its own training."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    weights, theta = ordinal_quality.train(docs.select("doc_id", "text"), labels)
    assert len(theta) == 2 and theta[0] < theta[1]
    got = {r.doc_id: r for r in ordinal_quality.op4_ordinal_quality(spark, sf).collect()}
    for r in docs.collect():
        s = sum(v * float(np.float32(weights[f])) for f, v in brute_features(r.text).items())
        above = [1 / (1 + math.exp(-(s - t))) for t in theta]
        g = got.pop(r.doc_id)
        assert g.expected_grade == pytest.approx(sum(above), abs=1e-5) and g.top_probability == pytest.approx(above[1], abs=1e-5)
        assert g.kept == (g.top_probability >= 0.5)
    assert not got


@pytest.mark.parametrize("seed", range(3))
def test_ordinal_likelihood(seed):
    """The likelihood against one row after another, its gradient against differences, and the fit against plain descent."""
    g = np.random.default_rng(seed)
    how = ordinal_quality.Fit(least_documents=1, ridge=0.01, steps=3000, rate=0.02, least_gain=0)
    rows = [(g.choice(12, 4, replace=False).astype(np.int64), g.random(4)) for _ in range(60)]
    grades = np.array([int(np.clip(round(f.min() / 3 + g.normal() * 0.4), 0, 2)) for f, _ in rows])
    model = ordinal_quality.Likelihood(rows, grades, how)
    x = g.normal(size=len(model.start())) * 0.5
    loss, grad = model(x)
    w, (a, b) = x[:-2], (x[-2], x[-2] + math.exp(x[-1]))
    sig = lambda v: 1 / (1 + math.exp(-v))
    rate = 1 / np.sqrt(np.bincount(grades, minlength=3) / len(grades))
    total, parts = 0.0, 0.0
    for (f, v), k in zip(rows, grades):
        s = sum(v[j] * w[list(model.used).index(f[j])] for j in range(4))
        p = (sig(a - s), sig(b - s) - sig(a - s), 1 - sig(b - s))[k]
        total, parts = total - rate[k] * math.log(p), parts + rate[k]
    assert loss == pytest.approx(total / parts + 0.005 * float(w @ w), rel=1e-9)
    for j in range(len(x)):
        e = np.eye(len(x))[j] * 1e-6
        assert grad[j] == pytest.approx((model(x + e)[0] - model(x - e)[0]) / 2e-6, abs=1e-6)
    weights, theta = ordinal_quality.fit(rows, grades, how)
    plain = model.start()
    for _ in range(20_000):
        plain = plain - 0.3 * model(plain)[1]
    fitted = np.concatenate([weights[model.used], [theta[0], math.log(theta[1] - theta[0])]])
    assert model(fitted)[0] <= model(plain)[0] + 1e-4


def test_ordinal_one_row_for_a_label(spark):
    """Documents that share a labelled id come to the fit once, and a very long text is no matter."""
    docs = spark.createDataFrame([(1, "good words here")] * 50 + [(1, "others")] * 50 + [(2, "bad " * 400_000), (3, None)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    a, b = (ordinal_quality.train(d, labels) for d in (docs, docs.repartition(2)))
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])
    assert ordinal_quality.score(docs.limit(0), a).count() == 0 and ordinal_quality.train(docs.limit(0), labels)[1].tolist() == [-40.0, -40.0]


def test_ordinal_edges(spark):
    df = spark.createDataFrame([(1, None, 5.0), (1, None, 5.0), (2, "", 1.0)], "doc_id long, text string, selected double")
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for source in (labels, labels.limit(0)):
        out = ordinal_quality.score(df, ordinal_quality.train(df, source)).collect()
        assert len(out) == 3 and all(r.selected and r.expected_grade == pytest.approx(2) for r in out)


def test_words_and_hashes():
    t = pa.array(["a b", None, "", "é b"])
    (at, buf, off), = common.slices(t)
    _, start, end, counts = common.word_spans(buf, off)
    h = common.span_hashes(buf, start, end)
    assert counts.tolist() == [2, 0, 0, 2] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert [len(o) - 1 for _, _, o in common.slices(t, limit=1)] == [1, 1, 1, 1] or sum(len(o) - 1 for _, _, o in common.slices(t, limit=1)) == 4


def test_registry():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
