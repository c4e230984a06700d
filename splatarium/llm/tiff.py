"""Operator 5: TIFF in a binary column, one row per page.

The reader walks the image directories of a file in either byte order, decodes
strips and tiles that are plain, PackBits, LZW or deflate, undoes the horizontal
predictor, and gives the samples of each page row by row. It handles 8-bit
samples, one or more to a pixel, chunky. The writer makes such files.

A text is stored as a grey image 192 pixels wide. Its rows are dealt evenly to the
three codecs: the first third to pages of deflate tiles with the predictor, the next
to pages of PackBits strips, the last to pages of LZW strips. A
page has at most `PAGE_ROWS` rows, so a long text has more pages.

Defined cases: a null or empty file has no pages; a file that is no TIFF, or is
broken or uses what is not supported, has the pages before the fault and then a row
without page number, in which `error` says what is wrong; so has a page of more than
`MAX_SAMPLES`, which no value could hold. A directory that comes round again ends
the walk. A null text is empty, and its image is one row of spaces. Repeated rows
come out repeated. Columns of df that are named like new ones are replaced.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Fixed values of the format: tags, and the bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
ROW, TILE_ROWS, STRIP_ROWS, PAGE_ROWS = 192, 64, 64, 1 << 16
#: Samples of a page that fit in one binary value.
MAX_SAMPLES = (1 << 31) - 64
#: Bytes of files or pages in one batch.
BATCH_BYTES = 4 << 20


# ------------------------------------------------------------------- codecs


_SINGLE = {bytes([k]): k for k in range(256)}


def packbits_encode(data: bytes) -> bytes:
    out = bytearray()
    at = 0
    for m in re.finditer(rb"(?s)(.)\1{2,127}", data):
        for a in range(at, m.start(), 128):
            lit = data[a : min(a + 128, m.start())]
            out.append(len(lit) - 1)
            out += lit
        out.append(257 - (m.end() - m.start()))
        out += m[1]
        at = m.end()
    for a in range(at, len(data), 128):
        lit = data[a : a + 128]
        out.append(len(lit) - 1)
        out += lit
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = [], 0
    left = size
    while left > 0 and at < len(data):
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
            continue
        out.append(part)
        left -= len(part)
    return b"".join(out)


_CLEAR, _END, _FIRST, _FULL = 256, 257, 258, 4095


@functools.cache
def _widths() -> np.ndarray:
    """Bits of the first, second and further codes after a clear; they grow one code early."""
    return np.ceil(np.log2(np.arange(_FIRST, _FULL + 2) + 1)).astype(np.int64).clip(9, 12)


def _packed_bits(codes: list[int], widths: np.ndarray) -> bytes:
    """Codes of up to 12 bits one behind another, the most significant bit first."""
    end = np.cumsum(widths)
    start, size = end - widths, (int(end[-1]) + 7) // 8
    at, value = start >> 3, np.array(codes, np.int64) << (24 - widths - (start & 7))
    bits = sum(np.bincount(at + k, value >> 16 - 8 * k & 255, size + 3) for k in range(3))
    return bits[:size].astype(np.uint8).tobytes()


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW."""
    codes, widths = [_CLEAR], [np.array([9])]
    if data:
        follows: dict[int, int] = {}
        rest, following, held = iter(data), _FIRST, 0
        held = next(rest)
        for byte in rest:
            key = held << 8 | byte
            if key in follows:
                held = follows[key]
                continue
            codes.append(held)
            follows[key] = following
            following += 1
            held = byte
            if following == _FULL:
                codes.append(_CLEAR)
                widths.append(_widths()[: _FULL - _FIRST + 1])
                follows.clear()
                following = _FIRST
        codes.append(held)
        widths.append(_widths()[: following - _FIRST + 2])
    else:
        widths.append(np.array([9]))
    return _packed_bits([*codes, _END], np.concatenate(widths))


def lzw_decode(data: bytes, size: int) -> bytes:
    bits, widths = 8 * len(data), _widths()
    offsets = np.concatenate([[0], np.cumsum(widths)])
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    at, out, left = 0, [], size
    while left > 0:
        # all codes up to the next clear, whose widths are known
        m = min(int(np.searchsorted(offsets, bits - at, side="right")) - 1, len(widths))
        off = at + offsets[:m]
        codes = three[off >> 3] >> (24 - widths[:m] - (off & 7)) & ((1 << widths[:m]) - 1)
        stop = np.flatnonzero((codes == _CLEAR) | (codes == _END))
        if not len(stop) and m == len(widths):
            raise ValueError("LZW table is full")
        k = int(stop[0]) if len(stop) else m
        if k:
            first, *rest = codes[:k].tolist()
            if first > 255:
                raise ValueError("LZW code out of range")
            table, word = [*_SINGLE, b"", b""], bytes([first])
            words = [word]
            for n, code in enumerate(rest, _FIRST):
                if code > n:
                    raise ValueError("LZW code out of range")
                before, word = word, table[code] if code < n else word + word[:1]
                table.append(before + word[:1])
                words.append(word)
            out.append(b"".join(words))
            left -= len(out[-1])
        if not len(stop) or codes[k] == _END:
            break
        at += int(offsets[k + 1])
    return b"".join(out)


def _decode(data: bytes, kind: int, size: int) -> bytes:
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return packbits_decode(data, size)
    if kind == LZW:
        return lzw_decode(data, size)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {kind} is not supported")


def _encode(data: bytes, kind: int) -> bytes:
    return {NONE: lambda d: d, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6)}[kind](data)


# ------------------------------------------------------------------- reader


def _values(data: bytes, order: str, entry: int) -> tuple[int, ...]:
    _, kind, count = struct.unpack_from(order + "HHI", data, entry)
    n = TYPE_BYTES.get(kind, 0) * count
    at = entry + 8 if n <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
    letter = {1: "B", 3: "H", 4: "I"}.get(kind)
    if letter is None:
        return ()
    if at + n > len(data):
        raise ValueError("a field reaches over the end of the file")
    return struct.unpack_from(f"{order}{count}{letter}", data, at)


def read_pages(data: bytes):
    """Yields width, height, samples per pixel, compression, predictor, tiled and
    samples of one page after another. What is broken raises some exception."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    seen = set()
    at = struct.unpack_from(order + "I", data, 4)[0]
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {struct.unpack_from(order + "H", data, at + 2 + 12 * k)[0]: at + 2 + 12 * k for k in range(n)}
        yield _page(data, order, tags)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, order: str, tags: dict[int, int]) -> dict:
    def one(tag: int, default: int | None = None) -> int:
        got = _values(data, order, tags[tag]) if tag in tags else ()
        if not got and default is None:
            raise ValueError(f"tag {tag} is missing")
        return got[0] if got else default

    def some(tag: int) -> tuple[int, ...]:
        if tag not in tags:
            raise ValueError(f"tag {tag} is missing")
        return _values(data, order, tags[tag])

    w, h, spp = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    kind, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if set(_values(data, order, tags[BITS]) if BITS in tags else (1,)) != {8} or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise ValueError("only 8-bit chunky samples are supported")
    tiled = TILE_OFFSETS in tags
    if tiled:
        bw, bh, offsets, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), some(TILE_OFFSETS), some(TILE_BYTES)
    else:
        bw, bh, offsets, sizes = w, min(one(ROWS_PER_STRIP, h), h), some(STRIP_OFFSETS), some(STRIP_BYTES)
    if not (0 < w * h * spp <= MAX_SAMPLES and 0 < bw * bh * spp <= MAX_SAMPLES):
        raise ValueError(f"a page of {w} x {h} x {spp} samples in blocks of {bw} x {bh}")
    across = -(-w // bw)
    if len(offsets) != len(sizes) or len(offsets) != across * -(-h // bh):
        raise ValueError("number of strips or tiles")
    if tiled and (bw > 2 * w + 1024 or bh > 2 * h + 1024):
        raise ValueError("tiles far larger than the page")
    image = np.zeros((h, w, spp), np.uint8)
    for k, (a, n) in enumerate(zip(offsets, sizes)):
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        raw = _decode(data[a : a + n], kind, rows * bw * spp)
        block = np.frombuffer(raw, np.uint8, rows * bw * spp).reshape(rows, bw, spp)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        image[y : y + bh, x : x + bw] = block[: h - y, : w - x]
    return {"width": w, "height": h, "samples_per_pixel": spp, "compression": kind, "predictor": predictor, "tiled": tiled, "samples": image.tobytes()}


# ------------------------------------------------------------------- writer


def write_pages(pages: list[tuple[np.ndarray, int, int, tuple[int, int] | None, int]], order: str = "<") -> bytes:
    """A file of pages: (samples as height x width x n, compression, predictor,
    tile height and width or None, rows per strip)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image, kind, predictor, tile, per_strip in pages:
        h, w, spp = image.shape
        bh, bw = tile or (per_strip, w)
        offsets, sizes = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                block = image[y : y + bh, x : x + bw]
                if tile and block.shape[:2] != tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, spp), np.uint8))
                made = _encode(block.tobytes(), kind)
                offsets.append(len(out))
                sizes.append(len(made))
                out += made
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * spp), (COMPRESSION, 3, [kind]), (PHOTOMETRIC, 3, [1 if spp == 1 else 2]), (SAMPLES, 3, [spp]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tile:
            tags += [(TILE_WIDTH, 4, [bw]), (TILE_HEIGHT, 4, [bh]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)]
        else:
            tags += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [bh]), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, size, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{'H' if size == 3 else 'I'}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                where = struct.pack(order + "I", len(out))
                out += raw
            else:
                where = raw.ljust(4, b"\0")
            entries.append(struct.pack(order + "HHI", tag, size, len(values)) + where)
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def text_to_tiff(text: str | None) -> bytes:
    raw = (text or "").encode()
    raw += b" " * (-len(raw) % ROW or (0 if raw else ROW))
    image = np.frombuffer(raw, np.uint8).reshape(-1, ROW, 1)
    n, pages, a = len(image), [], 0
    for b, how in ((n // 3, (DEFLATE, 2, (TILE_ROWS, ROW), 1)), (n // 3 + (n + 1) // 3, (PACKBITS, 1, None, STRIP_ROWS)), (n, (LZW, 2, None, STRIP_ROWS))):
        pages += [(image[k : min(k + PAGE_ROWS, b)], *how) for k in range(a, b, PAGE_ROWS)]
        a = b
    return write_pages(pages)


def feature(samples: bytes) -> str:
    """Mean, variance and a 64-bit difference hash of the samples of a page."""
    x = np.frombuffer(samples, np.uint8)
    if not len(x):
        return ""
    # 65 equal cells of the sample sequence; a bit tells if the next cell is brighter
    edge = np.arange(66) * len(x) // 65
    run = c.running(x)
    mean = (run[edge[1:]] - run[edge[:-1]]) * 1_000_000 // np.maximum(np.diff(edge), 1)
    bits = sum(1 << k for k in np.flatnonzero(mean[1:] > mean[:-1]).tolist())
    total, squares = int(run[-1]), sum(int(np.dot(y, y)) for y in (x[k : k + (1 << 20)].astype(np.int64) for k in range(0, len(x), 1 << 20)))
    return f"{total / len(x):.4f}:{squares / len(x) - (total / len(x)) ** 2:.4f}:{bits:016x}"


# ---------------------------------------------------------------- operators

_PAGE = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "samples_per_pixel": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "tiled": pa.bool_(), "samples": pa.binary(), "feature": pa.string(), "error": pa.string()}
_PAGE_TYPES = dict(zip(_PAGE, ("int", "int", "int", "int", "int", "int", "boolean", "binary", "string", "string")))


def texts_to_tiff(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a TIFF of each text in place of a column of that name, or added."""
    df = df.drop(media)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for i, _, off in c.slices(batch.column(at)):
                some = batch.slice(i, len(off) - 1)
                made = [text_to_tiff(t) for t in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(made, pa.binary())], [*batch.schema.names, media])

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("binary").alias(media)).schema)


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: df's columns without the file, page (from 0), its
    description, samples, feature and error. A file without pages gives no row,
    and a broken one ends with a row without page."""
    kept = [x for x in df.columns if x not in {media, *_PAGE}]
    df = df.select(*[F.col(f"`{x}`") for x in kept], F.col(f"`{media}`"))
    schema = df.select(*[F.col(f"`{x}`") for x in kept], *[F.lit(None).cast(kind).alias(x) for x, kind in _PAGE_TYPES.items()]).schema

    def run(batches):
        for batch in batches:
            of, rows, held = [], [], 0

            def made():
                cols = [x.take(pa.array(of, pa.int64())) for x in batch.columns[:-1]]
                return pa.RecordBatch.from_arrays([*cols, *(pa.array([r.get(x) for r in rows], kind) for x, kind in _PAGE.items())], schema.names)

            for i in range(batch.num_rows):
                file = batch.column(len(kept))[i].as_buffer()
                if file is None or not file.size:
                    continue
                pages, n = read_pages(file.to_pybytes()), 0
                while True:
                    try:
                        p = next(pages, None)
                    except Exception as e:  # whatever a broken file leads to
                        p = {"error": f"{type(e).__name__}: {e}"}
                    if p is None:
                        break
                    of.append(i)
                    rows.append(p if "error" in p else {**p, "page": n, "feature": feature(p["samples"])})
                    n, held = n + 1, held + len(p.get("samples", b""))
                    if held >= BATCH_BYTES:
                        yield made()
                        of, rows, held = [], [], 0
                    if "error" in p:
                        break
            if of:
                yield made()

    return df.mapInArrow(run, schema)


def op5_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` as TIFF files; everything is taken from decoded pages."""
    docs = c.table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    stored = texts_to_tiff(docs).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media",
    )
    pages = tiff_pages(stored)
    # the pages of a document, of which there are few, put together again
    parts = F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("page", "samples", "feature"))))
    read = pages.groupBy("row", "doc_id", "n_bytes", "media_bytes", "media_sha256").agg(parts.alias("parts"), F.max("error").alias("error"))
    read = read.withColumn("payload", F.aggregate("parts.samples", F.lit(b""), lambda a, b: F.concat(a, b)))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        "media_bytes", "media_sha256", F.array_join("parts.feature", "|").alias("feature"), F.size("parts").alias("n_pages"), "error",
    )
