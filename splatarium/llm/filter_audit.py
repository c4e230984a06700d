r"""Operator 11: audit of how filters interact, over every order of applying them.

1. `measure` sorts documents by range: by a fingerprint of the text, the full text and
   the id. Copies then stand behind one another, the smallest id first, and each row is
   compared with the one before it. The range is laid over fingerprint and id (Spark
   takes samples of what ranges are laid over to the driver, and texts have no bound), so
   even a text that a third of all rows share is dealt over many tasks. A text that
   goes on from one task into the next is settled afterwards: every task reports the
   smallest id of the texts of its last fingerprint, and leaves open the rows of its first
   one that could be the smallest; those few rows meet by a SHA-256 of their text.
   The same pass counts words, different words and characters of whole texts.
2. `masks` makes one bit of each filter that a document fails.
3. `counters` adds up documents by part and mask; counters of tasks and parts add up.
4. `report` derives every order and step from a part's counters, 2 ^ filters at most.

Defined cases: a null text is an empty text (and a copy of any other empty one); a null
part is the empty string; a row without id is no copy and has no copies, and no label;
rows that share id and text are no copies of each other; every row counts, so repeated
rows count repeatedly; of labels that repeat an id one is enough. An empty table has no
parts and so no rows. Columns of the input are only read by the names asked for.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Characters that a clean text has not.
MARKS = b"#$%&*|"
_UPPER = bytes(range(65, 91))
_INSIDE = bytes(range(0x80, 0xC0))  # all bytes of a character but its first

#: Filters over what `measure` gives; a document fails where the condition holds.
FILTERS: dict[str, Column | str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 3 * n_chars",
    "D": "n_marks > 0",
    "E": "is_copy",
}


def _counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """Words, different words, code points, capitals and marks of a text in UTF-8."""
    words, n = raw.split(), len(raw)  # bytes split at the six ASCII spaces
    without = lambda some: n - len(raw.translate(None, some))
    return len(words), len(set(words)), n - without(_INSIDE), without(_UPPER), without(MARKS)


_COUNTED = ("n_words", "n_distinct", "n_chars", "n_upper", "n_marks")


class _Copies:
    """Walks through the sorted rows of a task, batch by batch."""

    def __init__(self):
        self.first_print = self.text = self.least = None
        self.last: dict[bytes, int] = {}  # smallest id of each text of the last fingerprint
        self.last_print = None

    def step(self, prints: np.ndarray, texts: pa.Array, ids: pa.Array) -> tuple[np.ndarray, list[bytes | None]]:
        """(is a copy, digest where that is open) of the rows of a batch."""
        n, known = len(prints), ids.is_valid().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy()
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = self.text is None or texts[0].as_py() != self.text
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        least, has = number[np.maximum(begin, 0)], known[np.maximum(begin, 0)]
        if begin[0] < 0:  # goes on from the batch before
            own = begin < 0
            least, has = np.where(own, 0 if self.least is None else self.least, least), np.where(own, self.least is not None, has)
        copy = known & has & (number > least)
        if self.first_print is None:
            self.first_print = int(prints[0])
        digests: list[bytes | None] = [None] * n
        for i in np.flatnonzero((prints == self.first_print) & known & ~copy).tolist():
            digests[i] = hashlib.sha256(texts[i].as_py()).digest()
        # of the last fingerprint, the first row of each text has the smallest id
        if self.last_print != prints[-1]:
            self.last_print, self.last = prints[-1], {}
        for i in np.flatnonzero((prints == prints[-1]) & new & known).tolist():
            self.last[hashlib.sha256(texts[i].as_py()).digest()] = int(number[i])
        self.text, self.least = texts[n - 1].as_py(), int(least[-1]) if has[-1] else None
        return copy, digests


def measure(df: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, n_words, n_distinct, n_chars, n_upper, n_marks, is_copy) of every row of
    df: is its text the same as that of a smaller id?"""
    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    keys = F.xxhash64("text").alias("print")
    # rows that share even their id are told apart by their place, so they can be dealt out
    dealt = rows.select(keys, "*", F.xxhash64(F.monotonically_increasing_id()).alias("place")).repartitionByRange("print", F.asc_nulls_last("id"), "place")
    # a row before that has no id tells nothing, so rows without come last
    ordered = dealt.drop("place").sortWithinPartitions("print", "text", F.asc_nulls_last("id"))
    schema = "id long, part string, " + "".join(f"{x} long, " for x in _COUNTED) + "is_copy boolean, open binary, edge boolean"
    names = ["id", "part", *_COUNTED, "is_copy", "open", "edge"]

    def run(batches):
        walk = _Copies()
        for batch in batches:
            if not batch.num_rows:
                continue
            prints, ids, part, texts = (batch.column(k) for k in range(4))
            copy, digests = walk.step(prints.to_numpy(), texts, ids)
            counted = np.array([_counts(t.as_py()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([ids, part, *(pa.array(x) for x in counted.T), pa.array(copy), pa.array(digests, pa.binary()), pa.array(np.zeros(len(copy), bool))], names)
        if walk.last:
            k, none = len(walk.last), [pa.nulls(len(walk.last), pa.int64())] * len(_COUNTED)
            yield pa.RecordBatch.from_arrays([pa.array(list(walk.last.values()), pa.int64()), pa.nulls(k, pa.string()), *none, pa.nulls(k, pa.bool_()), pa.array(list(walk.last), pa.binary()), pa.array([True] * k)], names)

    found = c.saved(ordered.mapInArrow(run, schema), "audit-measured")
    rows = found.filter(~F.col("edge"))
    least = found.filter("edge").groupBy("open").agg(F.min("id").alias("least"))
    settled = rows.filter("open is not null").join(least, "open", "left").withColumn("is_copy", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))
    kept = ["id", "part", *_COUNTED, "is_copy"]
    return rows.filter("open is null").select(kept).unionByName(settled.select(kept))


def masks(measured: DataFrame, filters: dict[str, Column | str] = FILTERS) -> DataFrame:
    """measured with `mask`: bit k is set where the k-th filter's condition holds."""
    bits = [F.when(F.expr(f) if isinstance(f, str) else f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(filters.values())]
    return measured.withColumn("mask", functools.reduce(Column.__add__, bits))


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled good or toxic.
    labels has doc_id, quality and toxic."""
    marked = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # rows of one id meet first, so neither a repeated id nor a missing one weighs on the join
    docs = masked.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(marked, F.col("id") == F.col("label_id"), "left")
    return docs.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(x), F.col("n")).otherwise(0)).alias(x) for x in ("good", "toxic")])


def report(counted: DataFrame, letters: str) -> DataFrame:
    """A row for every part, order of the filters (named by letters) and step, from
    counters of any number of tasks."""
    cells = counted.groupBy("part", "mask").agg(*[F.sum(x).alias(x) for x in ("n", "good", "toxic")]).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(letters)])
    of = lambda letter: F.expr(f"cast(shiftleft(1, instr('{letters}', {letter}) - 1) as int)")
    steps = cells.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).withColumn("bit", of("letter"))
    steps = steps.withColumn("before", F.expr(f"aggregate(transform(sequence(1, {len(letters)}), i -> if(i <= at, cast(shiftleft(1, instr('{letters}', substr(filter_order, i, 1)) - 1) as int), 0)), 0, (a, b) -> a | b)"))
    before, bit = F.col("before"), F.col("bit")

    def total(where, what="n") -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, x: a + x[what])

    fails = lambda x: x["mask"].bitwiseAND(bit) != 0
    here = lambda x: fails(x) & (x["mask"].bitwiseAND(before) == 0)
    # of all orders, a filter comes first among the k that a document fails in one of k
    share = F.aggregate(F.filter("cells", fails), F.lit(0).cast("long"), lambda a, x: a + x["n"] * (F.lit(math.factorial(len(letters))) / F.bit_count(x["mask"])).cast("long"))
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), total(lambda x: x["mask"].bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total(here).alias("removed"),
        total(lambda x: fails(x) & (x["mask"].bitwiseAND(before) != 0)).alias("redundant"), total(lambda x: x["mask"] == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all of `documents`, in all 120 orders."""
    docs, labels = c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels")
    counted = c.saved(counters(masks(measure(docs)), labels), "audit-counters")
    return report(counted, "".join(FILTERS))


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
counted AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
judged AS (
  SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM counted
),
marked AS (SELECT j.*, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic FROM judged j LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
-- documents that fail alike count together
alike AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM marked GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
-- the step at which each kind of document goes
gone AS (
  SELECT part, o, fails, n, good, toxic, list_position([fails[ascii(x) - 64] FOR x IN string_split(o, '')], true) AS goes FROM alike, orders
),
steps AS (SELECT g.*, s.step, fails[ascii(o[s.step]) - 64] AS here FROM gone g, (SELECT unnest(range(1, 6)) AS step) s),
summed AS (
  SELECT part, o AS filter_order, step::INTEGER AS step, coalesce(sum(n) FILTER (WHERE goes IS NULL OR goes > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE goes = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE here AND goes < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE here AND len(list_filter(fails, lambda y: y)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE goes = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE goes = step), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY part, o, step
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM summed
"""
