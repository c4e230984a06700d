"""Shared pieces: scratch tables in the cluster's shared folder, and word and
hash arithmetic over whole Arrow string columns with numpy.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a regular expression for one word, in Java and DuckDB syntax.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the folder. With `spread`, for work that costs far more than a
    shuffle, one that comes in fewer parts than there are cores is dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what `spark.checkpoint.dir` names. Only where that is unset, as in
    tests on one machine, a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not hasattr(spark, "_llm_scratch"):
        spark._llm_scratch = tempfile.mkdtemp(prefix="llm-scratch-")
        atexit.register(shutil.rmtree, spark._llm_scratch, True)
    return f"file://{spark._llm_scratch}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_recorders: list[list[str]] = []


@contextlib.contextmanager
def recorded():
    """Gives the list of the tables that `saved` writes meanwhile."""
    _recorders.append([])
    try:
        yield _recorders[-1]
    finally:
        _recorders.pop()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks that it ran, and no
    stage before the write is run again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if _recorders:
        _recorders[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes tables that `saved` wrote and that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            release_paths(df.sparkSession, [file.rpartition("/")[0]])


def release_paths(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        if f"/llm/{spark.sparkContext.applicationId}/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text) -> F.Column:
    """Number of words of a text column, 0 for null, on the JVM.

    A word begins at every character that is no space and follows a space or
    the beginning; so it is enough to count those positions.
    """
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- numpy side


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE):
    """(first row, buffer of bytes, offsets) for runs of whole texts.

    A null counts as an empty text.
    """
    yield from _slices(column, pa.large_string(), "", limit)


def byte_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE):
    """The same for a column of binary values."""
    yield from _slices(column, pa.large_binary(), b"", limit)


def _slices(column: pa.Array | pa.ChunkedArray, kind: pa.DataType, empty: str | bytes, limit: int):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(empty)
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    off = np.frombuffer(raw[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def per_row(cumulated: np.ndarray, off: np.ndarray) -> np.ndarray:
    return cumulated[off[1:]] - cumulated[off[:-1]]


def running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, which spread every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random 64-bit number for every byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of them at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        made = []
        for x in (_BASE, _BACK):
            run = np.full(size, x, np.uint64)
            run[0] = 1
            made.append(np.cumprod(run, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for every span: differences of one
    running polynomial, moved back to position zero, with the length mixed in.
    """
    up, down = _powers(len(buf) + 1)
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inside a word, starts, ends, words of each row); words never cross rows."""
    inside = ~IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    cut = np.ones(len(buf) + 1, bool)
    if len(buf):
        cut[1:-1] = ~inside[:-1] | ~inside[1:]
    cut |= edge
    start = np.flatnonzero(inside & cut[:-1])
    end = np.flatnonzero(inside & cut[1:]) + 1
    return inside, start, end, np.diff(np.searchsorted(start, off))


def add_edges(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def fixed_list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values end to end and the length of each list."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
