"""Operator 8: byte-level BPE encoding and decoding, with overlapping chunks.

Every text is cut into chunks of a few thousand bytes that overlap, and each chunk
is pre-tokenised from its own beginning. In an overlap two chunks fall in step:
from the first place on at which both break (after a character that is no white
space), all that follows is the same for both, because the pattern only looks
ahead. There they are stitched: the former chunk gives the pre-tokens before that
place, the latter those behind it. The pre-tokens found this way are the pieces
that are encoded, each different one once by the library.

A chunk begins only where such a place is sure to follow in the overlap: behind
a letter that no letter follows, or before white space that follows something
else, every tokenisation breaks. Where there is none, as in one long run of
letters (which is one pre-token anyway), the chunk before it goes on. So no two
chunks ever fail to meet, and no text is encoded in another way.

A task works on the chunks of its texts side by side, as arrays. A text of more
than `SEGMENT` bytes is first cut into segments by the same rule; these are dealt
over all tasks, and their ids are stitched where the segments fall in step.

Decoding concatenates the bytes of the ids; bytes of a character may stand in
several tokens, so only whole documents need be valid UTF-8.

Defined cases: null is an empty text; an empty text has no ids; special tokens
are plain text; repeated rows come out repeated. Other columns are carried along;
where df has a column `ids` (or `decoded`), it is replaced.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import pretokens

#: Bytes of a chunk and of a segment without the overlap, and of the overlap.
CHUNK, SEGMENT, OVERLAP = 4096, 32768, 256
#: A break closer to the end of a chunk than this might not be one in the whole text.
MARGIN = 16
#: Bytes of texts that are worked on at once.
BATCH_BYTES = 1 << 20
#: Pre-tokens that a worker remembers; an executor may have workers that encode and others that decode.
REMEMBERED = 250_000


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def tiktoken_encoding(path: str):
    """The library's encoding for a rank file; without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@functools.cache
def _memory(path: str) -> pretokens.Memory:
    """One for each worker, which remembers from task to task."""
    encode = tiktoken_encoding(path).encode_ordinary
    return pretokens.Memory(lambda new: list(map(encode, new)), REMEMBERED)


@functools.cache
def _vocabulary(path: str) -> pa.Array:
    """The bytes of every id; none for numbers that are no id."""
    known = {k: raw for raw, k in _ranks(path).items()}
    return pa.array([known.get(k, b"") for k in range(max(known) + 1)], pa.large_binary())


# ------------------------------------------------------------------ chunks


def _breaks_surely(raw: bytes) -> bool:
    """Is there a place at which every tokenisation breaks, whatever stands before: a letter
    before something else, or white space behind something else?"""
    kind = pretokens.tiktoken_classes()[np.frombuffer(raw.decode("utf-8", "ignore").encode("utf-32-le"), np.uint32)]
    changes = kind[1:] != kind[:-1]
    return bool((changes & ((kind[:-1] == pretokens.LETTER) | (kind[1:] == pretokens.SPACE))).any())


def chunk_starts(raw: bytes, size: int, overlap: int = OVERLAP) -> list[int]:
    """Byte positions in a text at which its chunks begin."""
    starts, at = [0], size
    while at < len(raw):
        a = at
        while a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1  # not inside a character
        # the character after a sure place has to be there as well
        if _breaks_surely(raw[a : a + overlap - MARGIN]):
            starts.append(a)
        at += size
    return starts


def _reach(raw: bytes, at: int, overlap: int) -> int:
    """The end of a chunk that overlaps with the one that begins at `at`."""
    end = min(len(raw), at + overlap)
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    return end


def _after_space(buf: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Does white space of any script stand before these places?"""
    b1, b2, b3 = (buf[np.maximum(end - k, 0)] for k in (1, 2, 3))
    two = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    e2 = (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF)) | (b2 == 0x81) & (b1 == 0x9F)
    three = (b1 >= 0x80) & ((b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80) | (b3 == 0xE2) & e2 | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))
    return c.IS_SPACE[b1] | two | three


def stitched_starts(buf: np.ndarray, off: np.ndarray, size: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, int]:
    """(byte positions in buf at which pre-tokens begin, number of stitches) for
    the texts of a slice, found chunk by chunk."""
    raw = buf.tobytes()
    begin, reach, first, sound = [], [], [], []  # of each chunk, in buf; is it the first of its text? Breaks up to here count.
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        t = raw[a:b] if b - a > size else b""
        own = chunk_starts(t, size, overlap) if t else [0]
        begin += [a + x for x in own]
        reach += [a + _reach(t, x, overlap) for x in own[1:]] + [b]
        first += [True] + [False] * (len(own) - 1)
        sound += [x if x == b else x - MARGIN for x in reach[-len(own) :]]
    if len(begin) == len(off) - 1:
        return pretokens.starts(buf, off, pretokens.tiktoken_classes()), 0
    begin, reach, first, sound = map(np.array, (begin, reach, first, sound))
    # the chunks one behind another, with what stands in two of them twice
    upto = c.running(reach - begin)
    lanes = np.frombuffer(b"".join(raw[a:b] for a, b in zip(begin.tolist(), reach.tolist())), np.uint8)
    found = pretokens.starts(lanes, upto, pretokens.tiktoken_classes())
    lane = np.searchsorted(upto, found, side="right") - 1
    shift = begin[lane] - upto[lane]
    start, end = found + shift, np.append(found[1:], len(lanes)) + shift
    last = np.append(first[1:], True)
    # breaks in the overlap with the chunk behind, and with the one before
    behind = np.append(begin[1:], 0)[lane]
    fit = ~_after_space(buf, end)
    tail = end[fit & ~last[lane] & (end > behind) & (end <= sound[lane])]
    head = end[fit & ~first[lane] & (end <= begin[lane] + overlap - MARGIN)]
    both = np.intersect1d(tail, head)
    at = np.searchsorted(both, begin, side="right")
    if not len(both) or (at[~first] == len(both)).any():
        raise ValueError("chunks out of step")
    step = np.where(first, begin, both[np.minimum(at, len(both) - 1)])
    until = np.where(last, reach, np.append(step[1:], 0))
    if (step[~first] > begin[~first] + overlap).any():
        raise ValueError("chunks out of step")
    return start[(start >= step[lane]) & (start < until[lane])], int((~first).sum())


def _ids(buf: np.ndarray, off: np.ndarray, rank_file: str, chunk: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begins of pre-tokens, ids before each pre-token) of a slice."""
    start, _ = stitched_starts(buf, off, chunk, overlap)
    ids, n = _memory(rank_file).ids(buf, start)
    return ids, start, c.running(n)


def _packed(ids: np.ndarray, start: np.ndarray, upto: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    raw, ends = ids.astype("<u4").tobytes(), (4 * upto[np.searchsorted(start, off)]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _encode_column(df: DataFrame, text: str, rank_file: str, chunk: int, overlap: int, keep_text: bool) -> DataFrame:
    """df and ids."""
    at = df.columns.index(text)
    out = df if keep_text else df.drop(text)
    schema = out.select("*", F.lit(None).cast("binary").alias("ids")).schema

    def run(batches):
        for batch in batches:
            for i, buf, off in c.slices(batch.column(at), BATCH_BYTES):
                some = batch.slice(i, len(off) - 1)
                ids = pa.array(_packed(*_ids(buf, off, rank_file, chunk, overlap), off), pa.binary())
                yield pa.RecordBatch.from_arrays([*[x for k, x in enumerate(some.columns) if keep_text or k != at], ids], schema.names)

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- segments


def _segments(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """(row, k, start, own, sound, rest, segment): a row for each segment of each text.
    `own` are its bytes up to the next, `sound` those in which breaks count. The other
    columns stand beside the first."""
    rest = [x for x in df.columns if x != text]
    # the id of a row follows from the files and their order, so a task run again gives it again
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{x}`") for x in rest]).alias("rest"), F.col(f"`{text}`").alias("whole"))
    schema = rows.select("row", F.lit(0).alias("k"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("own"), F.lit(0).alias("sound"), F.when(F.col("row") >= 0, F.col("rest")).alias("rest"), F.col("whole").alias("segment")).schema

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.column(2)[i].as_buffer().to_pybytes()
                begin = chunk_starts(t, size, overlap)
                for j, (a, b) in enumerate(zip(begin, [*begin[1:], len(t)])):
                    end, rest = _reach(t, b, overlap), batch.column(1).slice(i, 1) if j == 0 else pa.nulls(1, batch.schema.types[1])
                    numbers = [pa.array([j], pa.int32()), pa.array([a], pa.int64()), pa.array([b - a], pa.int32()), pa.array([end - a - (MARGIN if end < len(t) else 0)], pa.int32())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *numbers, rest, pa.array([t[a:end]], pa.binary()).cast(pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


_MARKS = "array<struct<at:bigint,n:bigint>>"


def _coded_segments(segments: DataFrame, rank_file: str, chunk: int, overlap: int) -> DataFrame:
    """segments with all their ids, and their breaks in the overlap with the segment
    before (head) and behind (tail): place in the text, and number of ids before it."""
    col = {x: i for i, x in enumerate(segments.columns)}
    schema = segments.select("*", F.lit(None).cast("binary").alias("ids"), *[F.lit(None).cast(_MARKS).alias(x) for x in ("head", "tail")]).schema
    kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))

    def run(batches):
        for batch in batches:
            for i, buf, off in c.slices(batch.column(col["segment"]), BATCH_BYTES):
                some = batch.slice(i, len(off) - 1)
                ids, begin, upto = _ids(buf, off, rank_file, chunk, overlap)
                end = np.append(begin[1:], len(buf))
                fit = np.flatnonzero(~_after_space(buf, end))
                marks: tuple[list, list] = ([], [])
                for j, (k, start, own, sound) in enumerate(zip(*(some.column(col[x]).to_pylist() for x in ("k", "start", "own", "sound")))):
                    a = int(off[j])
                    before = upto[np.searchsorted(begin, a)]
                    for out, lo, hi in ((marks[0], a, a + overlap - MARGIN if k else a), (marks[1], a + own, a + sound)):
                        pick = fit[np.searchsorted(end[fit], lo, side="right") : np.searchsorted(end[fit], hi, side="right")]
                        out.append([{"at": start + int(end[p]) - a, "n": int(upto[p + 1] - before)} for p in pick.tolist()])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(_packed(ids, begin, upto, off), pa.binary()), *(pa.array(x, kind) for x in marks)], schema.names)

    return segments.mapInArrow(run, schema)


def _join_segments(docs: DataFrame, keep_text: bool) -> DataFrame:
    """(rest, text, ids) of (rest, parts): ids are cut where segments fall in step."""
    schema = docs.select("rest", F.lit("").alias("text"), F.lit(None).cast("binary").alias("ids")).schema

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parts = sorted(batch.column(1)[i].as_py(), key=lambda p: p["k"])
                ids, text, since = [], [], 0
                for p, q in zip(parts, [*parts[1:], None]):
                    until, then = len(p["ids"]) // 4, 0
                    if q is not None:
                        heads = {m["at"]: m["n"] for m in q["head"]}
                        until, then = next((m["n"], heads[m["at"]]) for m in p["tail"] if m["at"] in heads)
                    ids.append(p["ids"][4 * since : 4 * until])
                    text.append(p["segment"].encode()[: p["own"]] if keep_text else b"")
                    since = then
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([b"".join(text)], pa.binary()).cast(pa.string()), pa.array([b"".join(ids)], pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


def _encode_long(df: DataFrame, text: str, rank_file: str, chunk: int, segment: int, overlap: int, keep_text: bool) -> DataFrame:
    """Like `_encode_column`, for texts of more than one segment."""
    dealt = _segments(df, text, segment, overlap).repartition("row", "k")
    coded = _coded_segments(dealt, rank_file, chunk, overlap)
    part = F.struct("k", "own", "ids", "head", "tail", *(["segment"] if keep_text else []))
    # the ids of a text are one value in the end, so its segments meet in one task
    docs = coded.groupBy("row").agg(F.max_by("rest", F.col("k") == 0).alias("rest"), F.collect_list(part).alias("parts")).select("rest", "parts")
    whole = _join_segments(docs, keep_text)
    return whole.select(*[F.col("text").alias(text) if x == text else F.col(f"rest.`{x}`").alias(x) for x in df.columns if keep_text or x != text], "ids")


def encode(df: DataFrame, rank_file: str, text: str = "text", chunk: int = CHUNK, segment: int = SEGMENT, overlap: int = OVERLAP, keep_text: bool = True) -> DataFrame:
    """df with a column ids: binary, little-endian unsigned 32-bit integers; without
    the text, unless it is to be kept."""
    df = df.drop("ids")
    names = c.fresh(df, *(f"c{k}" for k in range(len(df.columns))))
    plain, t = df.toDF(*names), names[df.columns.index(text)]
    long = F.coalesce(F.octet_length(t), F.lit(0)) > segment
    coded = _encode_column(plain.filter(~long), t, rank_file, chunk, overlap, keep_text).unionByName(_encode_long(plain.filter(long), t, rank_file, chunk, segment, overlap, keep_text))
    return coded.toDF(*(x for x in df.columns if keep_text or x != text), "ids")


def decode(df: DataFrame, rank_file: str, ids: str = "ids") -> DataFrame:
    """df with a column decoded: the bytes of all ids, one after another."""
    df = df.drop("decoded")
    at = df.columns.index(ids)
    schema = df.select("*", F.lit(None).cast("binary").alias("decoded")).schema

    def run(batches):
        words = _vocabulary(rank_file)
        for batch in batches:
            for i, buf, off in c.byte_slices(batch.column(at), BATCH_BYTES):
                got = words.take(pa.array(np.frombuffer(buf.tobytes(), "<u4")))
                ends = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1, got.offset * 8)[off // 4] if len(got) else np.zeros(len(off), np.int64)
                raw = got.buffers()[2].to_pybytes() if len(got) and got.buffers()[2] is not None else b""
                some = batch.slice(i, len(off) - 1)
                done = [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(done, pa.binary())], schema.names)

    return df.mapInArrow(run, schema)


def op8_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, encoded and decoded."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(c.table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"), ranks, keep_text=False)
    return decode(coded, ranks).select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
