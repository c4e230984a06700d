import collections
import itertools
import random
import re

import pytest

from splatarium.llm import filter_audit as audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fails(rows):
    """Letters that each (doc_id, text) fails."""
    ids = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            ids[t or ""].append(i)
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= ch <= "Z" for ch in t) > 3 * len(t), "D": any(ch in "#$%&*|" for ch in t)}
        fails["E"] = i is not None and any(j < i for j in ids[t])
        out.append("".join(k for k, v in fails.items() if v))
    return out


def brute_report(rows, labels):
    """rows of (doc_id, text, part), one document and one order after another."""
    fails, out = brute_fails([r[:2] for r in rows]), collections.Counter()
    parts = {p or "" for _, _, p in rows}
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    for order in map("".join, itertools.permutations("ABCDE")):
        for (i, _, p), f in zip(rows, fails):
            p, there = p or "", True
            for step, x in enumerate(order, 1):
                key = (p, order, step)
                if x in f:
                    if there:
                        out[key, "removed"] += 1
                        out[p, x, "shapley"] += 1
                        out[key, "good_lost"] += i in good
                        out[key, "toxic_lost"] += i in toxic
                    else:
                        out[key, "redundant"] += 1
                    out[key, "unique_fails"] += f == x
                    there = False
                out[key, "kept"] += there
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s): (*(out[(p, o, s), k] for k in names), out[p, o[s - 1], "shapley"]) for p in parts for o in map("".join, itertools.permutations("ABCDE")) for s in range(1, 6)}


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join(f"w{k}" for k in range(400))
    texts = [None, "", "a", "ÄÖ B", long, long, long + "#", "Ab " * 300, "x " * 70_000, "#" * 9, long.upper(), " \x0b\n"]
    docs = [(rng.choice([None, rng.randrange(40), rng.randrange(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    docs += [(7, long, "fr")] * 5
    labels = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(50)]
    write(spark, tmp_path, docs, labels)
    got = audit.op11_filter_audit(spark, str(tmp_path)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_report(docs, labels) and len(got) == 600 * 4


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_copies_over_borders(spark, parts):
    """One text over many tasks, ids repeated and missing, and batches of a few rows."""
    rng = random.Random(parts)
    rows = [(rng.choice([None, *range(300)]), rng.choice(["hot"] * 6 + ["cold", "", "x y", f"t{rng.randrange(50)}"])) for _ in range(1500)]
    rows += [(5, "hot")] * 40 + [(-3, "hot")]
    df = spark.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, lang string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = audit.measure(df.repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = collections.Counter((i, "E" in f) for (i, _), f in zip(rows, brute_fails(rows)))
    assert collections.Counter((r.id, r.is_copy) for r in got) == want


def test_equal_fingerprints_and_empty(spark):
    import numpy as np
    import pyarrow as pa

    walk = audit._Copies()  # texts of one fingerprint stand in order of text, then id
    copy, open_ = walk.step(np.array([1, 1, 1, 1]), pa.array([b"a", b"a", b"b", b"b"]), pa.array([4, 9, 2, 3]))
    assert copy.tolist() == [False, True, False, True] and [x is not None for x in open_] == [True, False, True, False]
    assert sorted(walk.last.values()) == [2, 4]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.measure(empty).collect() == []


def test_other_filters(spark):
    df = spark.createDataFrame([(1, "a a", "x"), (2, "b", "x"), (3, "b", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = audit.report(audit.counters(audit.masks(audit.measure(df), {"S": "n_words = 1", "C": "is_copy"}), labels), "SC")
    assert sorted(map(tuple, got.collect())) == [("x", "CS", 1, 2, 1, 0, 0, 0, 0, 1), ("x", "CS", 2, 1, 1, 1, 1, 1, 0, 3), ("x", "SC", 1, 1, 2, 0, 1, 1, 0, 3), ("x", "SC", 2, 1, 0, 1, 0, 0, 0, 1)]
