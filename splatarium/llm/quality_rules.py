"""Operator 1: quality rules by distribution divergence.

1. Common words. Words are counted in every language; those that make up at least
   a `COMMON`-th of a language's words are its common words, `COMMON` at most.
2. Counts. One pass over the texts counts, for every document, its words, symbols,
   repeated lines and repeated word windows, and two histograms: of character
   classes by Unicode category, and of its language's common words and all others.
3. Verdicts. The histograms of a language's documents that pass the base rules add
   up to its references. A document goes whose Jensen-Shannon distance to either
   is too large. Both are compared only from a minimum length on, since short
   texts are far from any reference by chance.

Texts are not shuffled; common words and references come back to the documents by
joins on the language, of a row for each language, which Spark broadcasts while
they are small.

Defined cases: a null text is empty (no words, so the base rules fail it); a
null language is a language of its own; a language without any document that
passes the base rules has no reference, and nothing in it is rejected by
distance. Rows are never merged: repeated rows come out repeated. Other
columns, whatever their names, are carried along by `apply_rules`; counts replace
columns of their names.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: A word is common that makes up one of so many of a language's words.
COMMON = 250
#: Parts in which the words of one language meet its total.
PARTS = 256
#: Character classes: Unicode categories, white space, and the marks of sentences apart from other punctuation.
CLASSES = ("Ll", "Lu", "other letter", "mark", "number", "space", "sentence mark", "other punctuation", "symbol", "other")
SENTENCE_MARKS = ".,;:!?'\"()-¿¡«»“”‘’…–—、。"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: Jensen-Shannon distances (base 2, so 0 to 1) from which a document goes.
    max_char_distance: float = 0.3
    max_word_distance: float = 0.3
    #: Lengths below which a histogram says nothing.
    min_chars: int = 250
    min_words_for_histogram: int = 100


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    by = {"Ll": 0, "Lu": 1, "Lt": 2, "Lm": 2, "Lo": 2, "M": 3, "N": 4, "Z": 5, "P": 7, "S": 8, "C": 9}
    names = [unicodedata.category(chr(k)) for k in range(0x110000)]
    short = {x: by[x] if x in by else by[x[0]] for x in set(names)}
    out = np.fromiter((short[x] for x in names), np.uint8, len(names))
    out[list(c.SPACE)] = 5
    out[[ord(x) for x in SENTENCE_MARKS]] = 6
    return out


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_STEP = c.mix(np.arange(101, 101 + WINDOW, dtype=np.uint64)) | np.uint64(1)
_ROW = np.uint64(0xA0761D6478BD642F)


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions that have an equal key elsewhere, those with one before)."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    first = np.concatenate([same, [False]]) if len(key) else same
    later = np.concatenate([[False], same]) if len(key) else same
    return order[first | later], order[later]


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(w) for w in raw], dtype=np.int64)
    return c.span_hashes(np.frombuffer(b"".join(raw), np.uint8), end - np.array([len(w) for w in raw], np.int64), end) if raw else np.zeros(0, np.uint64)


def count_slice(buf: np.ndarray, off: np.ndarray, common: list[list[str]], which: np.ndarray) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """The counts of every text of one slice, and its histograms of common words;
    `which` is the place in `common` of each text's list."""
    n = len(off) - 1
    inside, start, end, words = c.word_spans(buf, off)
    row = np.repeat(np.arange(n), words)
    first = (buf & 0xC0) != 0x80  # bytes that begin a character
    out = {
        "n_words": words.astype(np.int64),
        "word_chars": c.per_row(c.running(inside & first), off),
        "n_symbols": c.per_row(c.running(_SYMBOL[buf]), off),
    }
    # lines
    newline = np.flatnonzero(buf == 10)
    line_start = np.union1d(off[:-1], newline + 1)
    line_start = line_start[line_start < len(buf)]
    line_row = np.searchsorted(off, line_start, side="right") - 1
    nxt = np.searchsorted(newline, line_start)
    line_end = np.minimum(np.append(newline, len(buf))[nxt], off[line_row + 1])
    worded = np.diff(c.running(inside)[np.stack([line_start, line_end])], axis=0)[0] > 0
    line_start, line_end, line_row = line_start[worded], line_end[worded], line_row[worded]
    key = c.mix(c.span_hashes(buf, line_start, line_end) + line_row.astype(np.uint64) * _ROW)
    out["n_dup_lines"] = c.add_edges(line_row[_repeated(key)[1]], n)
    # word windows
    h = c.span_hashes(buf, start, end)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) >= WINDOW:
        m = len(h) - WINDOW + 1
        win = sum((h[k : k + m] * _STEP[k] for k in range(WINDOW)), np.zeros(m, np.uint64))
        at = np.flatnonzero(row[:m] == row[WINDOW - 1 :])
        hit = at[_repeated(c.mix(win[at] + row[at].astype(np.uint64) * _ROW))[0]]
        covered += np.bincount(hit, minlength=len(h) + 1) - np.bincount(hit + WINDOW, minlength=len(h) + 1)
    out["n_repeat_words"] = c.add_edges(row[np.cumsum(covered)[:-1] > 0], n)
    # histograms
    chars = c.running(first)[off]
    out["hist_chars"] = np.diff(chars)
    text = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    out["char_hist"] = c.add_edges(np.repeat(np.arange(n) * len(CLASSES), np.diff(chars)) + _classes()[text], n * len(CLASSES))
    low = c.span_hashes(c.LOWER[buf], start, end) if len(start) else h
    begin = np.cumsum(words) - words
    hists: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for k, some in enumerate(common):
        rows = np.flatnonzero(which == k)
        bins, keys = len(some) + 1, _hashes(some)
        order = np.argsort(keys)
        at = np.repeat(begin[rows] - (np.cumsum(words[rows]) - words[rows]), words[rows]) + np.arange(int(words[rows].sum()))
        place = np.full(len(at), bins - 1)
        if len(some):
            near = np.minimum(np.searchsorted(keys[order], low[at]), len(keys) - 1)
            place = np.where(keys[order][near] == low[at], order[near], bins - 1)
        made = c.add_edges(np.repeat(np.arange(len(rows)), words[rows]) * bins + place, len(rows) * bins).reshape(len(rows), bins)
        for r, x in zip(rows.tolist(), made):
            hists[r] = x
    return out, hists


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_COLUMNS = (*_COUNTS, "hist_chars")
_NEW = (*_COLUMNS, "char_hist", "word_hist")


def common_words(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(common_lang, common): the common words of each language, in lower case (of A
    to Z), the most frequent first. Counts combine on the map side."""
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({c.WORD})"), F.lit(1))
    counts = df.select(F.col(f"`{lang}`").alias("lang"), F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # each different word is put into lower case, not each word
    counts = counts.groupBy("lang", F.translate("word", _UPPER, _LOWER).alias("word")).agg(F.sum("n").alias("n"))
    total = df.groupBy(F.col(f"`{lang}`").alias("of")).agg(F.sum(c.n_words(F.col(f"`{text}`"))).alias("total"))
    # a language may have most of the words: they meet its total in many parts
    total = total.select("of", "total", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("of_part"))
    part = F.pmod(F.xxhash64("word"), F.lit(PARTS)).cast("int")
    often = counts.withColumn("part", part).join(total, F.col("lang").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).filter(F.col("n") * COMMON >= F.col("total"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word")))
    return c.saved(often.groupBy(F.col("lang").alias("common_lang")).agg(order["word"].alias("common")), "common-words")


def count_texts(df: DataFrame, words: DataFrame, text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """`carry` and the counts and histograms of every text; one pass, no shuffle of texts."""
    carry = tuple(k for k in carry if k not in _NEW)
    whole, kept = c.fresh(df.select(*[F.col(f"`{k}`") for k in carry]), "whole_text", "common_words")
    df = df.join(words, F.col(f"`{lang}`").eqNullSafe(F.col("common_lang")), "left")
    df = df.select(*[F.col(f"`{k}`") for k in carry], F.col(f"`{text}`").alias(whole), F.coalesce("common", F.array().cast("array<string>")).alias(kept))
    schema = df.select(*carry, *[F.lit(0).cast("long").alias(k) for k in _COLUMNS], *[F.array(F.lit(0).cast("long")).alias(k) for k in ("char_hist", "word_hist")]).schema

    def run(batches):
        for batch in batches:
            m = batch.num_columns - 2
            for at, buf, off in c.slices(batch.column(m)):
                n = len(off) - 1
                lists = list(map(tuple, batch.column(m + 1).slice(at, n).to_pylist()))
                names = {x: k for k, x in enumerate(dict.fromkeys(lists))}
                got, hists = count_slice(buf, off, list(map(list, names)), np.array([names[x] for x in lists]))
                cols = [batch.column(k).slice(at, n) for k in range(m)]
                cols += [pa.array(got[k], pa.int64()) for k in _COLUMNS]
                cols += [c.fixed_list(got["char_hist"], np.full(n, len(CLASSES)), pa.int64()), c.fixed_list(np.concatenate(hists), np.array([len(x) for x in hists]), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return df.mapInArrow(run, schema)


def js_distance(p, sp, q, sq):
    """Jensen-Shannon distance (base 2) of arrays of counts p and q with the sums
    sp and sq; null if a sum is 0 or null.

    The divergence is half the sum of f(a) + f(b) - 2 f((a + b) / 2) with
    f(x) = x ln x. The sums are columns, so no lambda adds anything up again.
    """
    f = lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)
    term = lambda x, y: f(x / sp) + f(y / sq) - 2 * f((x / sp + y / sq) / 2)
    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, v: a + v)
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(total / (2 * np.log(2.0)), F.lit(0.0))))


def with_base(counted: DataFrame, rules: Rules = Rules()) -> DataFrame:
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def language_references(counted: DataFrame, lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """One row per language: both histograms summed over all documents that
    pass the base rules, and their totals. The sums combine on the map side."""
    passed = with_base(counted, rules).filter(~F.col("base_failed"))
    cells = [passed.select(F.col(f"`{lang}`").alias("ref_lang"), F.lit(h).alias("hist"), F.posexplode(h).alias("bin", "n")) for h in ("char_hist", "word_hist")]
    sums = cells[0].unionByName(cells[1]).groupBy("ref_lang", "hist", "bin").agg(F.sum("n").alias("n"))
    one = lambda h: F.array_sort(F.collect_list(F.when(F.col("hist") == h, F.struct("bin", "n"))))["n"].alias(f"ref_{h}")
    total = lambda h: F.sum(F.when(F.col("hist") == h, F.col("n"))).alias(f"sum_{h}")
    return c.saved(sums.groupBy("ref_lang").agg(*[f(h) for f in (one, total) for h in ("char_hist", "word_hist")]), "references")


def with_verdicts(counted: DataFrame, refs: DataFrame, lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """Adds base_failed, both distances and kept to what `count_texts` gives.

    refs has a row per language; the join is left to Spark, which broadcasts
    it while its files are under the session's threshold.
    """
    joined = with_base(counted, rules).join(refs, F.col(f"`{lang}`").eqNullSafe(F.col("ref_lang")), "left")
    chars = js_distance(F.col("char_hist"), F.col("hist_chars"), F.col("ref_char_hist"), F.col("sum_char_hist"))
    words = js_distance(F.col("word_hist"), F.col("n_words"), F.col("ref_word_hist"), F.col("sum_word_hist"))
    joined = joined.withColumn("char_distance", F.when(F.col("hist_chars") >= rules.min_chars, chars))
    joined = joined.withColumn("word_distance", F.when(F.col("n_words") >= rules.min_words_for_histogram, words))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= rules.max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= rules.max_word_distance)
    return joined.withColumn("kept", ~F.col("base_failed") & near).drop("ref_lang", "hist_chars", *(f"{a}{h}" for a in ("", "ref_", "sum_") for h in ("char_hist", "word_hist")))


def apply_rules(df: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows of df that the rules keep, with all their columns.

    Texts are counted once, and written beside their counts.
    """
    names = c.fresh(df, *(f"c{k}" for k in range(len(df.columns))))
    plain = df.toDF(*names)
    text, lang = (names[df.columns.index(x)] for x in (text, lang))
    counted = c.saved(count_texts(plain, common_words(plain, text, lang), text, lang, carry=tuple(names)), "counted")
    return with_verdicts(counted, language_references(counted, lang, rules), lang, rules).filter("kept").select(*[F.col(a).alias(b) for a, b in zip(names, df.columns)])


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for all of `documents`. The counts are written once
    (numbers only) and read twice. Distances are rounded, as their last digits
    depend on the order of sums."""
    docs = c.table(spark, sf_dir, "documents", spread=True)
    counted = c.saved(count_texts(docs, common_words(docs), carry=("doc_id", "lang")), "quality-counts")
    out = with_verdicts(counted, language_references(counted))
    return out.select("doc_id", *_COUNTS, "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def _op1_sql(rules: Rules = Rules()) -> str:
    marks = "".join(f"\\{x}" if x in "()-?.'\"" else x for x in SENTENCE_MARKS).replace("'", "''")
    space = r"\x20\x09-\x0D"
    classes = [r"\p{Ll}", r"\p{Lu}", r"\p{Lt}\p{Lm}\p{Lo}", r"\p{M}", r"\p{N}"]
    n = lambda inner: f"len(regexp_extract_all(t, '[{inner}]'))"
    # all sentence marks are punctuation
    hist = [n(x) for x in classes] + [n(rf"{space}\p{{Z}}"), n(marks), n(r"\p{P}") + " - " + n(marks), n(r"\p{S}")]
    hist += ["length(t) - (" + " + ".join(hist) + ")"]
    js = "sqrt(greatest(sum(CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END - CASE WHEN a + b > 0 THEN (a + b) * ln((a + b) / 2) ELSE 0 END) / (2 * ln(2)), 0))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{space}]+') AS ws FROM d),
pos AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
win AS (SELECT r, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS x FROM pos),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
gap AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM hit),
rep AS (SELECT r, sum(least(coalesce(after - i, {WINDOW}), {WINDOW}))::BIGINT AS n FROM gap GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n FROM ln WHERE regexp_matches(line, '[^{space}]') GROUP BY r),
base AS (
  SELECT w.r, doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(t)::BIGINT AS chars,
    [{", ".join(hist)}] AS char_hist FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)
),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM base),
words AS (SELECT r, lang, translate(unnest(ws), '{_UPPER}', '{_LOWER}') AS word FROM w),
totals AS (SELECT lang, count(*) AS total FROM words GROUP BY lang),
common AS (SELECT x.lang, word FROM words x JOIN totals y ON x.lang IS NOT DISTINCT FROM y.lang GROUP BY x.lang, word, total HAVING count(*) * {COMMON} >= total),
cells AS (
  SELECT b.r, b.lang, 'c' AS h, u.k::VARCHAR AS bin, b.char_hist[u.k]::BIGINT AS n FROM b, (SELECT unnest(range(1, {len(CLASSES) + 1})) AS k) u
  UNION ALL
  SELECT b.r, b.lang, 'w', coalesce(k.word, ''), count(*) FROM b JOIN words x USING (r) LEFT JOIN common k ON k.word = x.word AND k.lang IS NOT DISTINCT FROM b.lang GROUP BY ALL
),
refs AS (SELECT cells.lang, h, bin, sum(cells.n) AS n FROM cells JOIN b USING (r) WHERE NOT base_failed GROUP BY ALL),
ref_totals AS (SELECT lang, h, sum(n) AS n FROM refs GROUP BY ALL),
own AS (SELECT r, h, sum(n) AS n FROM cells GROUP BY ALL HAVING sum(n) > 0),
pairs AS (
  SELECT o.r, o.h, coalesce(c.n, 0) / o.n AS a, coalesce(f.n, 0) / t.n AS b
  FROM own o JOIN b ON b.r = o.r JOIN ref_totals t ON t.lang IS NOT DISTINCT FROM b.lang AND t.h = o.h AND t.n > 0
  JOIN (SELECT lang, h, bin FROM cells GROUP BY ALL) s ON s.lang IS NOT DISTINCT FROM b.lang AND s.h = o.h
  LEFT JOIN refs f ON f.lang IS NOT DISTINCT FROM s.lang AND f.h = s.h AND f.bin = s.bin LEFT JOIN cells c ON c.r = o.r AND c.h = s.h AND c.bin = s.bin
),
far AS (SELECT r, h, {js} AS d FROM pairs GROUP BY r, h),
out AS (
  SELECT b.*, CASE WHEN chars >= {rules.min_chars} THEN fc.d END AS char_distance, CASE WHEN n_words >= {rules.min_words_for_histogram} THEN fw.d END AS word_distance
  FROM b LEFT JOIN far fc ON fc.r = b.r AND fc.h = 'c' LEFT JOIN far fw ON fw.r = b.r AND fw.h = 'w'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0) <= {rules.max_char_distance} AND coalesce(word_distance, 0) <= {rules.max_word_distance} AS kept,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM out
"""


OP1_SQL = _op1_sql()
