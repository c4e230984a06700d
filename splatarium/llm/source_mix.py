"""Operator 9: mixing sources to target weights by a low-discrepancy schedule.

1. Targets. Sources get weights, and share a percentage of all words. No target
   exceeds a multiple of its source; the excess goes to the others by weight.
2. Blocks. The documents of a source, in hash order, are one stream of words,
   cut into blocks of equal length.
3. Schedule. Slot k of the mix takes the point k * C mod 2^31, where C / 2^31 is
   nearly the golden ratio's fraction; the point falls into the interval of one
   source on the line of cumulated slots. The r-th slot of a source takes block
   r mod (its blocks). So at any length of the mix each source has its share to
   within a few slots.
4. Each document takes the words of its share of every block, times the number
   of slots that took the block.

Running sums go in two steps, over hash ranges or slot ranges and then within
one, so a source that holds much of the corpus is spread over many tasks; texts
never move. All numbers are integers but for the one division of a target, and
the order is a hash of the doc_id: reruns agree.

Defined cases: a null text has no words and takes none; sources are ordered by
code point, null last, as a source of its own; documents without words have
taken 0; an empty table gives an empty result; repeated rows are documents of
their own (equal in id and size, they stand side by side in the stream).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

#: Points are multiples of this over 2^31; it is odd, so all points differ.
GOLDEN, POINTS = 1327217885, 1 << 31


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    share_percent: int = 150
    most_times: int = 2
    #: Words of a block, and the least number of blocks of a source that has as many words.
    block_words: int = 65536
    min_blocks: int = 1024
    seed: str = "mix"


def sizes(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, size, h), no texts: a small table, written once."""
    key = F.md5(F.concat(F.lit(mix.seed + ":"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))))
    return c.saved(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), c.n_words(F.col(f"`{text}`")).alias("size"), key.alias("h")), "sizes")


def targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(sid, source, source_size, target, len, blocks, lo, hi): a row per source.

    The windows without a partition run over one row per source, not over
    documents. A source is capped if its whole cap fits in what its weight
    gives it once all sources with smaller caps per weight are capped.
    """
    n, lcm = len(mix.weights), math.lcm(*mix.weights)
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("sid") - 1) % n + 1).cast("long"))
    full = F.col("source_size") * mix.most_times
    up = Window.orderBy(F.expr(f"source_size * {lcm} div w"), "sid")
    every = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every))
    s = s.withColumn("caps", F.coalesce(F.sum(full).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    left = F.col("total") * mix.share_percent - 100 * F.col("caps")
    s = s.withColumn("capped", 100 * full * F.col("rest") <= F.col("w") * left)
    s = s.withColumn("c_all", F.sum(F.when(F.col("capped"), full).otherwise(0)).over(every)).withColumn("w_all", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every))
    share = (F.col("w") * (F.col("total") * mix.share_percent - 100 * F.col("c_all"))).cast("double") / (100 * F.col("w_all")).cast("double")
    s = s.withColumn("target", F.when(F.col("capped"), full.cast("double")).otherwise(share))
    blocks = F.greatest(F.expr(f"(source_size + {mix.block_words - 1}) div {mix.block_words}"), F.least("source_size", F.lit(mix.min_blocks)), F.lit(1))
    s = s.withColumn("len", blocks)  # how many, then how long
    s = s.withColumn("len", F.greatest(F.expr("(source_size + len - 1) div len"), F.lit(1).cast("long")))
    s = s.withColumn("blocks", F.expr("(source_size + len - 1) div len"))
    s = s.withColumn("slots", F.least(F.floor(F.col("target") / F.col("len") + 0.5).cast("long"), F.col("blocks") * mix.most_times))
    s = s.withColumn("hi", F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("slots"))
    return c.saved(s.select("sid", "source", "source_size", "target", "len", "blocks", "lo", "hi"), "targets")


def _before(sums: DataFrame, group: list[str], at: str, amount: str) -> DataFrame:
    """sums with `before`: the amount at smaller places `at` (0 to 65535) of its group.

    In two steps, over 256 places and then over 256 sums of such, so no task meets
    more than that of a group.
    """
    high = [*group, "_high"]
    s = sums.withColumn("_high", F.expr(f"{at} div 256"))
    upto = F.sum(amount).over(Window.partitionBy(*high).orderBy(at)) - F.col(amount)
    blocks = s.groupBy(*high).agg(F.sum(amount).alias("_all"))
    blocks = blocks.withColumn("_first", F.sum("_all").over(Window.partitionBy(*group).orderBy("_high")) - F.col("_all")).drop("_all")
    return s.withColumn("_inner", upto).join(blocks, high).withColumn("before", F.col("_inner") + F.col("_first")).drop("_inner", "_first", "_high", amount)


def schedule(spark: SparkSession, sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(sid, block, times): how often the mix takes each block."""
    total = sources.agg(F.coalesce(F.max("hi"), F.lit(0)).alias("k")).first()["k"]  # one number
    if total >= POINTS:
        raise ValueError(f"{total} slots are more than the {POINTS} points of the schedule; blocks have to be longer")
    slots = spark.range(total).select(F.col("id").alias("k"), F.expr(f"(id * {GOLDEN} % {POINTS}) * {max(total, 1)} div {POINTS}").alias("at"))
    # intervals are found through cells of the line, an equi-join with few rows
    width = max(1, -(-total // 4096))
    cells = sources.filter("hi > lo").select("sid", "blocks", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell"))
    slots = slots.withColumn("cell", F.expr(f"at div {width}")).join(cells, "cell").filter("at >= lo and at < hi").withColumn("range", F.expr("k div 65536"))
    before = slots.groupBy("sid", "range").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("range")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("sid", "range").orderBy("k")) - 1
    ranked = slots.withColumn("r", rank).join(before, ["sid", "range"]).withColumn("r", F.col("r") + F.col("before"))
    return ranked.filter(F.col("r") < F.col("blocks") * mix.most_times).groupBy("sid", (F.col("r") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))


def mix_sources(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for each row of
    `sizes`; copies is how often the mix takes the block with the first word."""
    sources = targets(sized, mix)
    times = schedule(sized.sparkSession, sources, mix)
    docs = sized.join(sources.drop("lo", "hi"), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    docs = docs.withColumn("range", F.conv(F.substring("h", 1, 4), 16, 10).cast("int"))
    before = _before(docs.groupBy("sid", "range").agg(F.sum("size").alias("n")), ["sid"], "range", "n")
    inner = F.sum("size").over(Window.partitionBy("sid", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = docs.withColumn("inner", inner).join(before, ["sid", "range"]).withColumn("start", F.col("inner") + F.col("before"))
    full = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr("start div len"), F.expr("(start + size - 1) div len"))))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("len")) - F.greatest("start", F.col("block") * F.col("len"))
    cut = full.join(times, ["sid", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    keys = ["sid", "start", "doc_id", "source", "size", "source_size", "target"]
    taken = cut.groupBy(*keys).agg(F.sum(overlap * F.col("times")).alias("taken"), F.max(F.when(F.expr("block = start div len"), F.col("times")).otherwise(0)).alias("copies"))
    none = placed.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"))
    return taken.unionByName(none).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", mix: Mix = Mix()) -> DataFrame:
    """The rows of the mix, all columns of df: each document once for every time
    the mix takes the block that it begins in, so never, once or twice. Rows that
    share a doc_id, which only a faulty table has, are all taken as often as the
    one of them that is taken most."""
    took = mix_sources(sizes(df, doc_id, source, text, mix), mix).groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")).filter("copies > 0")
    names = c.fresh(df, *(f"c{k}" for k in range(len(df.columns))))
    plain = df.toDF(*names)
    took = took.select(F.col("doc_id").alias("took_id"), F.explode(F.sequence(F.lit(1), "copies")).alias("nth"))
    return plain.join(took, F.col(names[df.columns.index(doc_id)]).eqNullSafe(F.col("took_id"))).select(*[F.col(a).alias(b) for a, b in zip(names, df.columns)])


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(sizes(c.table(spark, sf_dir, "documents"))).drop("copies", "source")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM s1),
s3 AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, (sum(source_size) OVER ())::BIGINT AS total FROM s2),
s4 AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY source_size * 10 // w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
    (sum(w) OVER (ORDER BY source_size * 10 // w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM s3
),
s5 AS (SELECT *, 200 * source_size * rest <= w * (total * 150 - 100 * caps) AS capped FROM s4),
s6 AS (
  SELECT *, (sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER ())::BIGINT AS c_all, (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT AS w_all FROM s5
),
s7 AS (
  SELECT *, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE (w * (total * 150 - 100 * c_all))::DOUBLE / (100 * w_all)::DOUBLE END AS target,
    greatest((source_size + greatest((source_size + 65535) // 65536, least(source_size, 1024), 1) - 1) // greatest((source_size + 65535) // 65536, least(source_size, 1024), 1), 1) AS len FROM s6
),
s8 AS (SELECT *, (source_size + len - 1) // len AS blocks FROM s7),
s9 AS (SELECT *, least(floor(target / len + 0.5)::BIGINT, 2 * blocks) AS slots FROM s8),
s AS (SELECT *, (sum(slots) OVER (ORDER BY sid))::BIGINT AS hi, (sum(slots) OVER (ORDER BY sid))::BIGINT - slots AS lo FROM s9),
k AS (SELECT coalesce(max(hi), 0)::BIGINT AS n FROM s),
slot AS (SELECT r.k, ((r.k * 1327217885) % 2147483648) * k.n // 2147483648 AS at FROM k, (SELECT unnest(range((SELECT n FROM k))) AS k) r),
ranked AS (SELECT s.sid, s.blocks, row_number() OVER (PARTITION BY s.sid ORDER BY slot.k) - 1 AS r FROM slot JOIN s ON slot.at >= s.lo AND slot.at < s.hi),
times AS (SELECT sid, r % blocks AS block, count(*) AS times FROM ranked WHERE r < 2 * blocks GROUP BY ALL),
placed AS (
  SELECT d.doc_id, d.size, s.sid, s.source_size, s.target, s.len, (sum(d.size) OVER (PARTITION BY s.sid ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
  FROM sized d JOIN s ON d.source IS NOT DISTINCT FROM s.source
),
cut AS (SELECT *, unnest(range(start // len, (start + size - 1) // len + 1)) AS block FROM placed WHERE size > 0),
took AS (
  SELECT c.sid, c.start, c.doc_id, c.size, c.source_size, c.target,
    sum((least(c.start + c.size, (c.block + 1) * c.len) - greatest(c.start, c.block * c.len)) * coalesce(t.times, 0))::BIGINT AS taken
  FROM cut c LEFT JOIN times t ON c.sid = t.sid AND c.block = t.block GROUP BY ALL
)
SELECT doc_id, size, source_size, target, taken FROM took
UNION ALL SELECT doc_id, size, source_size, target, 0::BIGINT FROM placed WHERE size = 0
"""
