r"""Operator 13: runs of words that repeat with a period, found by bit-parallel lags.

The words of a text are numbered, and bit b of every word's number makes one big
integer, the plane b; bit i of a plane belongs to word i. XOR of a plane with itself
shifted by q shows where words q apart differ in that bit, and OR over the planes where
they differ at all. A run of period q and length n is a stretch of n - q zeros; AND of
the zeros with themselves shifted by 1, 2, 4, ... keeps the places at which a stretch
that is long enough begins. Planes are taken one after another, and a lag is done with
once no such place is left, which is mostly after the first plane.

Lags are gone through in doublings, low to 2 * low - 1. Two exact rules keep long texts
cheap. A run of such a period holds a whole block of `low` words, at a multiple of
`low`, and the same again q words on; so lags at which no block's hash comes again need
no planes. And two runs of periods p and q share fewer than p + q words; so the inside
of a run of a shorter period is left out.

A run is a stretch with smallest period q that no neighbouring word extends, of a
length of at least `REPEATS` * q and `LEAST` words. As a lag of a multiple of the
period finds the same stretch again, the first lag that finds a stretch is its period.

Texts are not shuffled: each is worked on where it is read, in memory that follows its
own length.

Defined cases: a null text has no words, like an empty one; words keep their bytes, so
case counts; repeated rows come out repeated. All columns of the input are carried
along; where it has columns `n_words`, `runs` or `collapsed`, they are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: A run is so many periods and words long at least.
REPEATS, LEAST = 4, 6
#: Below this lag all lags are gone through; from here on only those at which a block comes again.
FILTERED = 8

_ONES = re.compile("1+")
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of all numbers as one integer, for every b."""
    bits = [(ids >> b) & 1 for b in range(int(ids.max()).bit_length())] if len(ids) else []
    return [int.from_bytes(np.packbits(x.astype(np.uint8), bitorder="little").tobytes(), "little") for x in bits]


def stretches(bits: int, least: int) -> int:
    """The places at which `least` set bits in a row begin."""
    have = 1
    while bits and have < least:
        step = min(have, least - have)
        bits &= bits >> step
        have += step
    return bits


def at_lag(of: list[int], n: int, q: int) -> list[tuple[int, int]]:
    """(start, length) of all stretches of n words in which words q apart are the same."""
    least = max(LEAST - q, (REPEATS - 1) * q)
    if n - q < least:
        return []
    every = (1 << (n - q)) - 1
    differ, long = 0, stretches(every, least)
    for plane in of:
        differ |= plane ^ (plane >> q)
        long = stretches(every & ~differ, least)
        if not long:
            return []
    return [(m.start(), m.end() - m.start() + least - 1 + q) for m in _ONES.finditer(bin(long)[:1:-1])]


def _block_lags(grams: np.ndarray, low: int) -> np.ndarray:
    """Lags from low to 2 * low - 1 at which the hash of a block comes again."""
    rows = np.pad(grams, (0, -len(grams) % low)).reshape(-1, low)
    return low + np.flatnonzero((rows[1:] == rows[:-1, :1]).any(axis=0))


def _pieces(n: int, runs: list[tuple[int, int, int]], low: int) -> list[tuple[int, int]]:
    """What is left of n words without the insides of runs that no run of a period
    from low to 2 * low - 1 can reach into."""
    out, begin = [], 0
    for start, length, p in sorted(runs):
        a, b = start + p + 2 * low, start + length - p - 2 * low
        if a < b and begin < b:
            out.append((begin, max(begin, a)))
            begin = b
    return [(a, b) for a, b in [*out, (begin, n)] if b - a >= REPEATS * low]


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, by start and period."""
    n, period = len(ids), {}
    if n < LEAST:
        return []
    whole, grams, low = planes(ids), c.mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while REPEATS * low <= n:
        pieces = _pieces(n, [(s, size, p) for (s, size), p in period.items()], low) if period else [(0, n)]
        for a, b in pieces:
            lags = range(low, 2 * low) if low < FILTERED else _block_lags(grams[a : b - low + 1], low).tolist()
            of = None
            for q in lags:
                if REPEATS * q > b - a:
                    break
                of = of or (whole if b - a == n else planes(ids[a:b]))
                for start, length in at_lag(of, b - a, q):
                    period.setdefault((a + start, length), q)
        # hashes of twice as many words
        grams = c.mix(grams[:-low] * np.uint64(0x9E3779B97F4A7C15) + grams[low:]) if n > low else grams[:0]
        low *= 2
    return sorted((start, length, q) for (start, length), q in period.items())


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that stand in a run behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def collapse(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with n_words, all runs of its words (an array of start, length and period,
    counted in words) and the collapsed text: every run cut down to its first period,
    words joined by single spaces. Without the text, unless it is to be kept."""
    at, new = df.columns.index(text), ("n_words", "runs", "collapsed")
    carried = [i for i, x in enumerate(df.columns) if x not in new and (keep_text or i != at)]
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    runs = "array<struct<start:bigint,length:bigint,period:bigint>>"
    schema = plain.select(*(f"c{i}" for i in carried), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(runs).alias("runs"), F.lit("").alias("collapsed")).schema

    def run(batches):
        for batch in batches:
            n_words, found, left = [], [], []
            for raw in batch.column(at).cast(pa.large_binary()):
                words = (raw.as_py() or b"").split()  # bytes split at the six ASCII spaces
                own = runs_of(_numbers(words))
                n_words.append(len(words))
                found.append([{"start": s, "length": size, "period": q} for s, size, q in own])
                left.append(b" ".join(_kept(words, own)))
            new = [pa.array(n_words, pa.int64()), pa.array(found, _RUNS), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in carried), *new], schema.names)

    return plain.mapInArrow(run, schema).toDF(*(df.columns[i] for i in carried), *new)


def planted(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with periodic endings in a tenth of its texts, by the hash of their id: from
    word a on, the next p words over and over. A null id plants nothing."""
    h = F.crc32(F.col(id).cast("string"))
    words, n, left = F.col("words_"), F.col("n_"), F.col("n_") - F.col("a_")
    cut = docs.withColumn("words_", F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(c.WORD), F.lit(0)))).withColumn("n_", F.size("words_"))
    g = F.expr(f"crc32(cast(`{id}` as string)) div 10")
    cut = cut.withColumn("a_", F.when(n > 0, F.pmod(g, n)).cast("int")).withColumn("p_", F.when(n > 0, 1 + F.floor(left / (3 + F.pmod(g, F.lit(8))))).cast("int"))
    times = F.ceil(left / F.col("p_")).cast("int")
    ending = F.slice(F.flatten(F.array_repeat(F.slice(words, F.col("a_") + 1, F.col("p_")), times)), F.lit(1), left)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("a_")), ending), " ")
    return cut.withColumn(text, F.when(n > 0, made).otherwise(F.col(text))).drop("words_", "n_", "a_", "p_")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, with periodic endings planted in a tenth of them."""
    docs = planted(c.table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"))
    done = collapse(docs, keep_text=False)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    # a / p > b / q is a * q > b * p
    first = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    best = done.withColumn("best", F.when(F.size("runs") > 0, first)).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
