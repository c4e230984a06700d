"""Operator 6: n-gram Jaccard join over a token-group matrix.

Documents are sets of word shingles; two link when their Jaccard similarity
reaches a threshold. The join is exact and goes like this.

1. Equal sets are one class; copies cost nothing from there on.
2. Every class spreads its shingles over m segments, and a hash of each filled
   segment is a signature. Two linked sets of a size class differ in at most D
   shingles, so at least m - D segments agree. With m = D + 1 + s, and e of a
   set's segments empty, 1 + s - e of its signatures at least are shared with
   each set that it links to; sets with fewer shared signatures than that link
   with nothing. Frequent shingles do little harm here, since whole segments
   have to agree.
3. Classes that share signatures with the same smallest class are a family. A
   family is parted by set size, into strata of which only neighbours can link,
   and a stratum by hash into groups of bounded size. A large family has so many
   groups that no task holds much of it.
4. A tile is a pair of groups that may link: a group and itself, or another of
   the same or the next stratum. The first group of a tile is a block of the
   token-group matrix: the union of its members' shingles, and for each shingle
   the members that hold it. The overlap of a set with the union bounds the
   overlap with every member; the group is opened for the sets alone whose bound
   reaches the threshold. Sets that share enough signatures with another family
   ask its groups in the same way. Every pair of groups meets once, so a family
   of F different sets costs F * F / GROUP_MEMBERS rows, spread over all tasks;
   no pair of documents is ever a row.
5. Each tile gives, for each of its sets that link, how many documents it links
   with and the smallest set that it reaches in the tile. Connected components
   over those give the class ids.

Shingles are 64-bit hashes. Defined cases: a text without words, or null, has
the empty set and links with nothing; fewer words than a shingle has make one
shingle of them all; rows that share a doc_id count as one document and share
its class; a row without doc_id takes the class of its set, or null where no
equal set has an id and nothing links. Input columns other than the two named
are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from .graph import components

#: A group's members and shingles stay about under these; a larger set is alone.
GROUP_MEMBERS = 2048
GROUP_SHINGLES = 1 << 21
#: A stratum has a group for so many members, until it has so many groups.
SOME_MEMBERS, MANY_GROUPS = 64, 32
#: Sets of other families that ask a group come in blocks of about so many.
ASKING = 1024
#: Holders of shingles that are added up at once.
_EXPANDED = 1 << 20
_LEVELS = 4
_SHRINK = 0.65


@functools.cache
def size_classes(percent: int, upto: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first size, last size, segments, spare segments) of every size class.

    Sets of sizes x <= y that link differ in at most (x+y)(100-p)/(100+p)
    shingles, and y is at most 100x/p. Spare segments make up for those that
    stay empty in both sets.
    """
    first, last, segments, spare = [], [], [], []
    lo = 1
    while lo < upto:
        hi = max(lo, math.ceil(lo / _SHRINK) - 1)
        most = (hi + hi * 100 // percent) * (100 - percent) // (100 + percent)
        s = 0
        for _ in range(3):
            mean = (most + 1 + s) * math.exp(-lo / (most + 1 + s))
            s = min(most, math.ceil(mean + 3 * math.sqrt(mean)) + 2)
        first.append(lo), last.append(hi), segments.append(most + 1 + s if most else 0), spare.append(s)
        lo = hi + 1
    return tuple(np.array(x, np.int64) for x in (first, last, segments, spare))


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, number in each row): distinct hashes, ascending in each row."""
    n = len(off) - 1
    buf = c.LOWER[buf]
    _, start, end, counts = c.word_spans(buf, off)
    h = c.span_hashes(buf, start, end)
    step = c.mix(np.arange(11, 11 + words, dtype=np.uint64)) | np.uint64(1)
    row = np.repeat(np.arange(n), counts)
    m = max(0, len(h) - words + 1)
    gram = sum((h[k : k + m] * step[k] for k in range(words)), np.zeros(m, np.uint64))
    whole = row[:m] == row[words - 1 :] if m else np.zeros(0, bool)
    gram, row = c.mix(gram[whole]), row[:m][whole]
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        begin = np.cumsum(counts) - counts
        short = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            have = counts[few] > k
            short[have] += h[begin[few[have]] + k] * step[k]
        gram = np.concatenate([gram, c.mix(short + counts[few].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))])
        row = np.concatenate([row, few])
    order = np.argsort(gram)
    order = order[np.argsort(row[order].astype(np.uint16) if n < 65536 else row[order], kind="stable")]
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[new], np.bincount(row[new], minlength=n)


def _sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of hashes by place; both halves stay exact in doubles."""
    low = np.bincount(place, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(place, (values >> np.uint64(32)).astype(np.float64), n)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def set_hashes(gram: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(counts)), counts)
    return tuple(_sums(row, c.mix(gram ^ np.uint64(s)), len(counts)).view(np.int64) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))


def signatures(gram: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, row of each, number that a link needs) for the sets of one slice.

    Where more segments of a set are empty than are spare, the set also speaks
    by another split of its shingles, and needs one shared signature only.
    """
    first, last, segments, spare = size_classes(percent)
    own = np.searchsorted(first, counts, side="right") - 1
    found, rows, needs = [], [], []
    for down in (0, 1, 2):
        k = own - down
        reach = last[np.maximum(k, 0)] * 100 // percent >= counts
        use = (counts > 0) & (k >= 0) & reach & (segments[np.maximum(k, 0)] > 0)
        todo = np.flatnonzero(use)
        for level in range(_LEVELS):
            if not len(todo):
                break
            mine = np.zeros(len(counts), bool)
            mine[todo] = True
            g = gram[np.repeat(mine, counts)]
            size, m = counts[todo], segments[k[todo]]
            at = np.repeat(np.cumsum(m) - m, size)
            spread = c.mix(g + np.uint64(level * 0x2545F491 + 1))
            place = at + ((spread >> np.uint64(33)) % np.repeat(m, size).astype(np.uint64)).astype(np.int64)
            total = int(m.sum())
            value, filled = _sums(place, c.mix(spread), total), np.bincount(place, minlength=total) > 0
            row = np.repeat(np.arange(len(todo)), m)
            seg = np.arange(total) - np.repeat(np.cumsum(m) - m, m)
            name = c.mix((k[todo][row] * 16 + level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seg.astype(np.uint64))
            keep = filled if level < _LEVELS - 1 else np.ones(total, bool)
            found.append(c.mix(value + name)[keep])
            rows.append(todo[row[keep]])
            empty = np.bincount(row[~filled], minlength=len(todo))
            need = np.maximum(1 + spare[k[todo]] - empty, 1) if level == 0 else np.ones(len(todo), np.int64)
            needs.append(need[row[keep]])
            todo = todo[empty > spare[k[todo]]]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return np.concatenate(found).view(np.int64), np.concatenate(rows), np.concatenate(needs)


def _sets(df: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2) of every row."""

    def run(batches):
        for batch in batches:
            for at, buf, off in c.slices(batch.column(1)):
                gram, counts = shingle_sets(buf, off, words)
                h1, h2 = set_hashes(gram, counts)
                ids = batch.column(0).slice(at, len(counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(h1), pa.array(h2)], ["doc_id", "n_shingles", "h1", "h2"])

    return df.mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint")


def _signature_rows(df: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, doc_id, need): the signatures of every different set. Of sets that are
    equal inside one task only the first with a doc_id speaks, as a map-side combine."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at, buf, off in c.slices(batch.column(1)):
                gram, counts = shingle_sets(buf, off, words)
                fresh = np.zeros(len(counts), bool)
                ids = batch.column(0).slice(at, len(counts))
                valid = ids.is_valid().to_pylist()
                for i, key in enumerate(zip(*(h.tolist() for h in set_hashes(gram, counts)))):
                    if valid[i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                gram, counts = gram[np.repeat(fresh, counts)], np.where(fresh, counts, 0)
                sig, row, need = signatures(gram, counts, percent)
                yield pa.RecordBatch.from_arrays([pa.array(sig), ids.take(pa.array(row)), pa.array(need.astype(np.int32))], ["sig", "doc_id", "need"])

    return df.mapInArrow(run, "sig bigint, doc_id bigint, need int")


def linked_sets(members: list[np.ndarray], asking: list[np.ndarray], percent: int) -> np.ndarray:
    """Which members link with which asking sets: a matrix of flags.

    The members are one group: its union bounds the overlaps, and sets whose
    bound is too small don't open it.
    """
    sizes, asked = np.array([len(x) for x in members]), np.array([len(x) for x in asking])
    flat, holder = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], holder[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    union, many = flat[start], np.diff(np.append(start, len(flat)))
    q, row = np.concatenate(asking), np.repeat(np.arange(len(asking)), asked)
    at = np.minimum(np.searchsorted(union, q), len(union) - 1)
    held = union[at] == q
    bound = np.bincount(row[held], minlength=len(asking))
    held &= (100 * bound >= percent * np.maximum(asked, sizes.min()))[row]
    at, row = at[held], row[held]
    out = np.zeros((len(members), len(asking)), bool)
    upto = np.searchsorted(row, np.arange(len(asking) + 1))  # of each asking set
    work = c.running(many[at])[upto]
    a = 0
    while a < len(asking):
        b = max(a + 1, int(np.searchsorted(work, work[a] + _EXPANDED, side="right")) - 1)
        some = slice(upto[a], upto[b])
        n = many[at[some]]
        pick = np.repeat(start[at[some]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(np.repeat(row[some] - a, n) * len(members) + holder[pick], minlength=(b - a) * len(members)).reshape(b - a, len(members)).T
        out[:, a:b] = 100 * both >= percent * (sizes[:, None] + asked[None, a:b] - both)
        a = b
    return out


def tile_links(first: list[tuple], second: list[tuple], asking: list[tuple], percent: int) -> list[tuple[int, int, int]]:
    """(id, smallest id that it reaches in the tile, documents that it links with)
    for (id, documents, set) of a group and of another group, or of sets that ask.

    Without either, the group links within itself. Where sets ask, only theirs are
    counted: the group's own members ask elsewhere.
    """
    other = second or asking or first
    links = linked_sets([x[2] for x in first], [x[2] for x in other], percent)
    if other is first:
        np.fill_diagonal(links, False)
    ids = np.array([x[0] for x in first] + ([x[0] for x in other] if other is not first else []))
    n = links @ np.array([x[1] for x in other])
    if other is not first:
        n = np.concatenate([n * (not asking), np.array([x[1] for x in first]) @ links])
    shift = len(first) if other is not first else 0
    group = np.arange(len(ids))
    for i in np.flatnonzero(links.any(axis=1)).tolist():
        found = np.unique(np.append(group[shift + np.flatnonzero(links[i])], group[i]))
        if len(found) > 1:
            group[np.isin(group, found)] = found[0]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    used = np.concatenate([links.any(axis=1), links.any(axis=0)]) if shift else links.any(axis=1)
    return [(int(ids[k]), int(least[group[k]]), int(n[k])) for k in np.flatnonzero(used).tolist()]


def _match(batches, percent: int):
    """Rows come tile by tile. Yields what `tile_links` gives."""
    key, sides, out = None, ([], [], []), []

    def close():
        if sides[0] and (sides[1] or sides[2] or len(sides[0]) > 1 and key[1:3] == key[3:5]):
            out.extend(tile_links(*sides, percent))
        for x in sides:
            x.clear()

    def flush():
        cols = zip(*out) if out else ((), (), ())
        made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["a", "b", "n"])
        out.clear()
        return made

    for batch in batches:
        raw = batch.column(8)
        for i, (*tile, side, rid, weight) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(8)))):
            if tile != key:
                close()
                key = tile
            sides[side].append((rid, weight, np.frombuffer(raw[i].as_buffer(), np.uint64)))
        if len(out) > 50_000:
            yield flush()
    close()
    yield flush()


def _with_shingles(df: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles, h1, h2, aims) for (doc_id, text, aims)."""
    kind = df.schema["aims"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at, buf, off in c.slices(batch.column(1)):
                gram, counts = shingle_sets(buf, off, words)
                h1, h2 = set_hashes(gram, counts)
                n = len(counts)
                ends = np.zeros(n + 1, np.int32)
                np.cumsum(counts * 8, out=ends[1:])
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(gram.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), raw, pa.array(h1), pa.array(h2), batch.column(2).slice(at, n)], ["doc_id", "shingles", "h1", "h2", "aims"]
                )

    return df.mapInArrow(run, f"doc_id bigint, shingles binary, h1 bigint, h2 bigint, aims {kind}")


def jaccard_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), a row for each row of df."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sets = c.saved(_sets(docs, words, percent), "sets")
    classes = sets.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rid"), F.count(F.lit(1)).alias("copies"))
    classes = c.saved(classes.filter("rid is not null"), "classes")

    # signatures that two different classes share
    names = sets.filter("n_shingles > 0").select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "rid"), ["h1", "h2"]).select("doc_id", "rid")
    by_sig = Window.partitionBy("sig").orderBy("doc_id")
    pairs = _signature_rows(docs, words, percent).select("*", F.lag("doc_id").over(by_sig).alias("before"), F.lead("doc_id").over(by_sig).alias("after"))
    shared = pairs.filter("before is not null or after is not null").select("sig", "doc_id", "need")
    shared = c.saved(shared.join(names, "doc_id").groupBy("sig", "rid").agg(F.min("need").alias("need")), "shared")
    written = shared
    for _ in range(2):  # a set that goes leaves others with less
        two = shared.groupBy("sig").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).filter("a < b").select("sig")
        shared = shared.join(two, "sig")
        enough = shared.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("least")).filter("n >= least").select("rid")
        before, shared = written, c.saved(shared.join(enough, "rid").select("sig", "rid", "need"), "shared")
        c.release(before)
        written = shared
    hubs = shared.groupBy("sig").agg(F.min("rid").alias("hub"), F.max("rid").alias("other")).filter("hub < other").select("sig", "hub")
    family = shared.join(hubs, "sig").groupBy("rid").agg(F.min("hub").alias("fam"))

    # families cut into strata and groups; sizes that link differ by one stratum at most
    members = family.join(classes.groupBy("rid").agg(F.max("n_shingles").alias("size"), F.sum("copies").alias("copies")), "rid")
    members = c.saved(members.withColumn("s", F.floor(F.ln("size") / math.log(100.01 / percent)).cast("int")), "members")
    count = F.count(F.lit(1))
    cut = F.greatest(F.ceil(count / GROUP_MEMBERS), F.ceil(F.sum("size") / GROUP_SHINGLES), F.least(F.ceil(count / SOME_MEMBERS), F.lit(MANY_GROUPS))).cast("int")
    parts = c.saved(members.groupBy("fam", "s").agg(cut.alias("parts")), "families")
    near = lambda by, name: parts.select("fam", (F.col("s") + by).alias("s"), F.col("parts").alias(name))
    strata = parts.join(near(-1, "above"), ["fam", "s"], "left").join(near(1, "below"), ["fam", "s"], "left")
    placed = members.join(strata, ["fam", "s"]).withColumn("i", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))

    # the sets that ask groups of other families
    at = shared.join(members.select("rid", "fam", "s"), "rid")  # (rid, sig, need, fam, s)
    mixed = at.groupBy("sig").agg(F.min("fam").alias("f1"), F.max("fam").alias("f2")).filter("f1 < f2").select("sig")
    mixed = c.saved(at.join(mixed, "sig"), "mixed")
    across = mixed.select("sig", "rid", "need", F.col("fam").alias("mine"), F.col("s").alias("own")).join(mixed.select("sig", "fam").distinct(), "sig").filter("mine <> fam")
    across = across.groupBy("rid", "own", "fam").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("least")).filter("n >= least").select("rid", "own", "fam")
    across = c.saved(across.join(parts, "fam").filter("abs(s - own) <= 1"), "across")
    blocks = c.saved(across.groupBy("fam", "s").agg(F.ceil(count / ASKING).cast("int").alias("blocks")), "blocks")

    # every set's place in tiles (fam, s, i, t, j): of the first group, of the second, or asking
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("j")
    tile = lambda s, i, t, j, side: ["rid", "fam", s.alias("s"), i.alias("i"), t.alias("t"), j.alias("j"), side.cast("int").alias("side")]
    s, i, j, none = F.col("s"), F.col("i"), F.col("j"), F.lit(-1)
    inside = placed.select("rid", "fam", "s", "i", upto("parts")).select(*tile(s, F.least(i, j), s, F.greatest(i, j), i > j))
    above = placed.filter("above is not null").select("rid", "fam", "s", "i", upto("above")).select(*tile(s, i, s + 1, j, F.lit(0)))
    below = placed.filter("below is not null").select("rid", "fam", "s", "i", upto("below")).select(*tile(s - 1, j, s, i, F.lit(1)))
    heard = placed.select("rid", "fam", "s", "i").join(blocks, ["fam", "s"]).select("rid", "fam", "s", "i", upto("blocks")).select(*tile(s, i, none, j, F.lit(0)))
    asks = across.join(blocks, ["fam", "s"]).withColumn("i", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).select("rid", "fam", "s", "i", upto("parts")).select(*tile(s, j, none, i, F.lit(2)))
    roles = functools.reduce(DataFrame.unionByName, (inside, above, below, heard, asks))
    aims = roles.groupBy("rid").agg(F.collect_list(F.struct("fam", "s", "i", "t", "j", "side")).alias("aims"))
    aims = aims.join(members.select("rid", "copies"), "rid").select(F.col("rid").alias("doc_id"), F.struct("copies", "aims").alias("aims"))

    # shingles of those documents alone
    asked = _with_shingles(docs.join(aims, "doc_id").select("doc_id", "text", "aims"), words)
    asked = asked.select("doc_id", "shingles", F.col("aims.copies").alias("copies"), F.explode("aims.aims").alias("aim"))
    asked = asked.select("aim.*", F.col("doc_id").alias("rid"), "copies", "shingles").filter(F.length("shingles") > 0)
    dealt = asked.repartition("fam", "s", "i", "t", "j").sortWithinPartitions("fam", "s", "i", "t", "j", "side", "rid")
    links = c.saved(dealt.mapInArrow(lambda batches: _match(batches, percent), "a bigint, b bigint, n bigint"), "links")

    c.release(shared, members, parts, mixed, across, blocks)
    labels = components(links).select(F.col("node").alias("rid"), "label")
    counted = links.groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("linked"))
    named = classes.join(labels, "rid", "left").join(counted, "rid", "left")
    # a doc_id on several rows is one node: its rows share the smallest label
    named = named.select("h1", "h2", F.coalesce("label", "rid").alias("label"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sets.join(named, ["h1", "h2"], "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df whose document is the smallest of its group, or alone.

    Rows without doc_id stay. Of rows that share a doc_id, which only a faulty
    table has, one stays; where there are none, no text is shuffled for it.
    """
    groups = c.saved(jaccard_join(df, doc_id, text, words, percent), "groups")
    gone = groups.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    left = df.join(gone, doc_id, "left_anti").select(*df.columns)
    twice = c.saved(groups.dropna(subset=["doc_id"]).groupBy(F.col("doc_id").alias(doc_id)).count().filter("count > 1").select(doc_id), "repeated-ids")
    if not twice.limit(1).count():
        return left
    return left.join(twice, doc_id, "left_anti").select(*df.columns).unionByName(left.join(twice, doc_id, "left_semi").select(*df.columns).dropDuplicates([doc_id]))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(c.table(spark, sf_dir, "documents", spread=True))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, coalesce(k, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON least_.a = w.doc_id LEFT JOIN counts ON counts.a = w.doc_id
"""
