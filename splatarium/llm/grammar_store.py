"""Operator 3: token ids in files with Re-Pair grammar compression.

Documents are dealt by ranges of doc_id and sorted, so the files hold them in
ascending order. Each task cuts its documents into shards of bounded size. In a
shard, frequent pairs of neighbouring ids are replaced by nonterminals, round
after round, until no pair is left that stands `LEAST` times or more; no pair
reaches over the end of a document, and every pair is counted by itself.

It is Re-Pair but for the order: a round replaces all frequent pairs together, not
the most frequent one alone, which makes some ten rounds of many thousands. Where their places overlap, every
second one of a run is taken. A long line of pairs is counted in a hash table,
in which the pairs of one slot take turns over the rounds; a short one by sorting.

A shard is one binary value; Spark's Parquet writer commits the shards, so an
executor that is lost leaves no half a file. Layout, little endian:

    magic "RPG2", four unsigned 32-bit counts: documents D, rules R, symbols S,
    terminals T; then arrays: doc_ids (D, int64) and a byte each for null
    (D, uint8), first symbol of each document (D+1, uint32), first id of each
    document in the shard (D+1, uint64), rules (R x 2, uint32), expansion
    lengths (R, uint32), symbols (S, uint16 if T + R fits, else uint32).

The two indexes and the expansion lengths give random access: a document is
decoded from its own symbols, a position in it by adding up lengths.

Defined cases: a null text is empty; every document ends with the end id, so
none is without ids; null doc_ids come first; rows that share a doc_id stand in
the order of a hash of their texts; an empty table gives no shards.
"""

from __future__ import annotations

import functools
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from . import pretokens

MAGIC = b"RPG2"
SHARD_IDS = 1 << 20
#: A pair gets a rule if it stands so often in what is left of a shard.
LEAST = 12
#: Slots of the counting table, and the positions that are sorted instead when there are no more.
_SLOT_BITS, SORTED = 18, 1 << 17
#: Bytes of text encoded at once; a longer text is encoded alone.
ENCODE_BYTES = 4 << 20
#: Pre-tokens that a worker remembers.
REMEMBERED = 800_000


@functools.cache
def _byte_names() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable
    ones stand for themselves, the others for those from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class JsonEncoder:
    """Texts encoded by the tokenizers library from its JSON file.

    Texts are cut into pre-tokens, and each different one goes to the library's
    BPE model once. With `added`, a text that holds one of the file's added
    tokens goes to the library whole, which gives those their ids as it does by
    default; else their strings are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        merge = self.whole.model.tokenize
        names = np.array([ord(x) for x in "".join(map(chr, range(256))).translate(_byte_names())], "<u2")

        def ids_of(new: list[str]) -> list[list[int]]:
            """Ids of pre-tokens, of which the model wants each byte as its character."""
            raw = list(map(str.encode, new))
            spelled = names[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-16-le")
            ends = [0, *accumulate(map(len, raw))]
            return [[t.id for t in merge(spelled[a:b])] for a, b in zip(ends, ends[1:])]

        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()] if added else []
        self.memory = pretokens.Memory(ids_of, REMEMBERED)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each); a null is an empty text."""
        flat, counts = [], []
        for _, buf, off in c.slices(texts, ENCODE_BYTES):
            start = pretokens.starts(buf, off, pretokens.tokenizers_classes())
            ids, n = self.memory.ids(buf, start)
            upto = c.running(n)[np.searchsorted(start, off)]
            flat.append(ids)
            counts.append(np.diff(upto))
        ids, counts = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (flat, counts))
        held = [pc.match_substring(texts, t).fill_null(False).to_numpy(zero_copy_only=False) for t in self.added]
        held = np.flatnonzero(np.any(held, axis=0)) if held else []
        if len(held):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in held.tolist():
                parts[k] = np.array(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, counts


@functools.cache
def json_encoder(path: str, added: bool = False) -> JsonEncoder:
    """One for each worker, which remembers from task to task."""
    return JsonEncoder(path, added)


def _slots(left: np.ndarray, right: np.ndarray, turn: int) -> np.ndarray:
    return ((left * np.uint32(40503 + 2 * turn) ^ right * np.uint32(2654435761 + 4 * turn)) >> np.uint32(32 - _SLOT_BITS)).astype(np.int32)


def _by_sorting(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left and right of each frequent pair, where such pairs stand, which one it is)."""
    key = left.astype(np.uint64) << np.uint64(32) | right
    line = np.sort(key)
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    pair = line[begin[np.diff(np.append(begin, len(line))) >= LEAST]]
    if not len(pair):
        return left[:0], right[:0], begin[:0], begin[:0]
    got = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
    at = np.flatnonzero(pair[got] == key)
    return (pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32), at, got[at]


def _by_table(left: np.ndarray, right: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for the pairs that stand last in their slot of a table; each is
    counted by itself. The others have their turn in another round."""
    shown = np.zeros(1 << _SLOT_BITS, np.int32)
    shown[slot] = np.arange(len(slot), dtype=np.int32)
    of = shown[slot]
    at = np.flatnonzero((left[of] == left) & (right[of] == right))
    best = np.flatnonzero(np.bincount(slot[at], minlength=len(shown)) >= LEAST)
    rule_of = np.full(len(shown), -1, np.int32)
    rule_of[best] = np.arange(len(best))
    got = rule_of[slot[at]]
    return left[shown[best]], right[shown[best]], at[got >= 0], got[got >= 0]


def re_pair(ids: np.ndarray, ends: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, flags of last symbols) for ids; ends flags last ids.

    Rounds go on until no pair stands `LEAST` times or more in what is left. A pair that
    was too rare in one round stays so, as its symbols are not made any more; only the
    others and those with a symbol of the last round are looked at in the next one.
    """
    seq, rules, first, turn = ids.astype(np.uint32), [], terminals, 0
    maybe = np.flatnonzero(~ends[:-1])  # where such pairs begin; none reaches over the end of a document
    while len(maybe):
        left, right = seq[maybe], seq[maybe + 1]
        slot = _slots(left, right, turn)
        turn += 1
        # in its slot stand as many as of any pair, at least
        often = np.flatnonzero((np.bincount(slot, minlength=1 << _SLOT_BITS) >= LEAST)[slot])
        if not len(often):
            break
        maybe, left, right, slot = maybe[often], left[often], right[often], slot[often]
        found = _by_table(left, right, slot) if len(maybe) > SORTED else None
        if found is None or not len(found[2]):
            found = _by_sorting(left, right)
        a, b, where, got = found
        if not len(where):
            break
        where = maybe[where]
        # where matches overlap, every second one of a run is taken
        run = np.concatenate([[0], np.flatnonzero(np.diff(where) != 1) + 1])
        nth = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
        where, got = where[nth % 2 == 0], got[nth % 2 == 0]
        used = np.flatnonzero(np.bincount(got, minlength=len(a)))
        number = np.zeros(len(a), np.uint32)
        number[used] = np.arange(first, first + len(used), dtype=np.uint32)
        seq, ends, look = seq.copy(), ends.copy(), np.zeros(len(seq), bool)
        look[maybe] = True
        seq[where] = number[got]
        ends[where] = ends[where + 1]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, ends, look = seq[keep], ends[keep], look[keep]
        made = seq >= first
        look |= made
        look[:-1] |= made[1:]
        look &= ~ends
        maybe = np.flatnonzero(look[:-1])
        rules.append(np.stack([a[used], b[used]], axis=1).astype(np.int64))
        first += len(used)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), ends


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    length: list[int] = []
    for a, b in rules.tolist():
        length.append((1 if a < terminals else length[a - terminals]) + (1 if b < terminals else length[b - terminals]))
    return np.array(length, np.int64)


def pack(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, terminals: int) -> bytes:
    """A shard of documents: ids of all of them end to end, and how many each has."""
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(counts) - 1] = True
    seq, rules, last = re_pair(ids, ends, terminals)
    starts = np.concatenate([[0], np.flatnonzero(last) + 1])
    arrays = [
        np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "u1"), starts.astype("<u4"), np.concatenate([[0], np.cumsum(counts)]).astype("<u8"),
        rules.astype("<u4"), expansion_lengths(rules, terminals).astype("<u4"), seq.astype("<u2" if terminals + len(rules) <= 65536 else "<u4"),
    ]
    return MAGIC + np.array([len(doc_ids), len(rules), len(seq), terminals], "<u4").tobytes() + b"".join(a.tobytes() for a in arrays)


class Shard:
    """Reads a packed shard; a document is decoded from its own symbols alone."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a shard")
        d, r, s, self.terminals = np.frombuffer(raw, "<u4", 4, 4).tolist()
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.null = take("<i8", d), take("u1", d)
        self.starts, self.first = take("<u4", d + 1), take("<u8", d + 1)
        self.rules, self.length = take("<u4", 2 * r).reshape(r, 2), take("<u4", r).astype(np.int64)
        self.symbols = take("<u2" if self.terminals + r <= 65536 else "<u4", s)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        made: list[bytes] = []  # the expansion of each rule
        one = self.rules.astype("<u4")
        for k, (x, y) in enumerate(self.rules.tolist()):
            made.append((one[k, 0].tobytes() if x < self.terminals else made[x - self.terminals]) + (one[k, 1].tobytes() if y < self.terminals else made[y - self.terminals]))
        self.flat = np.frombuffer(b"".join(made), "<u4")

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        rule = symbols - self.terminals
        is_rule = rule >= 0
        rule = np.maximum(rule, 0)
        if not len(self.length):
            return symbols.astype(np.uint32)
        n = np.where(is_rule, self.length[rule], 1)
        where = np.cumsum(n) - n
        pick = np.repeat(np.where(is_rule, self.offset[rule], 0) - where, n) + np.arange(int(n.sum()))
        out = self.flat[np.minimum(pick, len(self.flat) - 1)]
        out[where[~is_rule]] = symbols[~is_rule]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[k] : self.starts[k + 1]])


def write_shards(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, terminals: int = 50257, shard_ids: int = SHARD_IDS, added: bool = False) -> DataFrame:
    """Encodes df and writes its shards; gives (part, shard, n_docs, n_ids, data),
    read from what was written. part and shard ascend with doc_id. With `added`,
    the tokenizer's added tokens get their ids; else they are ordinary text."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # rows without doc_id, or with the same one, are dealt out by their texts
    dealt = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        encode, part, number = json_encoder(tokenizer, added), TaskContext.get().partitionId(), 0
        doc_ids, parts, counts, held = [], [], [], 0

        def flush():
            nonlocal number, held
            data = pack(doc_ids, np.concatenate(parts), np.array(counts), terminals)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([held], pa.int64()), "data": pa.array([data], pa.binary())})
            doc_ids.clear(), parts.clear(), counts.clear()
            number, held = number + 1, 0
            return row

        for batch in batches:
            for at, _, off in c.slices(batch.column(1), ENCODE_BYTES):
                some = batch.slice(at, len(off) - 1)
                ids, n = encode(some.column(1))
                # the end id behind the ids of every document
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                n, names, a, first = n + 1, some.column(0).to_pylist(), 0, 0
                upto = np.cumsum(n)
                while a < len(n):
                    # as many documents as fill the shard, one at least
                    b = min(len(n), int(np.searchsorted(upto, first + shard_ids - held)) + 1)
                    doc_ids += names[a:b]
                    parts.append(ids[first : upto[b - 1]])
                    counts += n[a:b].tolist()
                    held += int(upto[b - 1]) - first
                    a, first = b, int(upto[b - 1])
                    if held >= shard_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    return c.saved(dealt.mapInArrow(run, "part int, shard int, n_docs bigint, n_ids bigint, data binary"), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in the shards."""

    def run(batches):
        for batch in batches:
            part, shard, data = (batch.column(k) for k in range(3))
            for k in range(batch.num_rows):
                s = Shard(data[k].as_buffer().to_pybytes())
                n = len(s.doc_ids)
                all_ids = s.expand(s.symbols)
                ends = (s.first * 4).astype(np.int64)
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(all_ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part[k].as_py(), n), pa.int32()), pa.array(np.repeat(shard[k].as_py(), n), pa.int32()), pa.array(s.doc_ids, pa.int64(), mask=s.null.astype(bool)),
                     pa.array(s.first[:-1].astype(np.int64)), pa.array(np.diff(s.first).astype(np.int64)), ids], ["part", "shard", "doc_id", "at", "n_tokens", "ids"],
                )

    docs = shards.select("part", "shard", "data").mapInArrow(run, "part int, shard int, doc_id bigint, at bigint, n_tokens bigint, ids binary")
    # ids before each shard: a sum over one row per part, and one within a part
    heads = shards.select("part", "shard", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inside = heads.select("part", "shard", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("before"))
    before = c.saved(inside.join(parts, "part").select("part", "shard", (F.col("before") + F.col("before_part")).alias("before")), "shard-starts")
    return docs.join(before, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def op3_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, from the files."""
    import public_tokenizers

    shards = write_shards(c.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return read_documents(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
