"""Scenes together: concatenation, placement, and removal of near copies."""

from __future__ import annotations

import functools
import itertools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.values import TransformValues
from ..scene_format import POS, SceneFormat
from ..sources.scratch import saved
from .transform import apply_transform


def concatenate(scenes: list[tuple[DataFrame, SceneFormat]], gid: str = "gid") -> tuple[DataFrame, SceneFormat]:
    """All rows of all scenes, with scene_id, their place in the list. Columns
    that a scene lacks are null; formats have to agree. `gid` stays the order
    within a scene, so (scene_id, gid) is the order of the whole."""
    if not scenes:
        raise ValueError("no scenes")
    formats = {f for _, f in scenes}
    if len(formats) > 1:
        raise ValueError(f"formats differ: {', '.join(sorted(f.summary() for f in formats))}")
    parts = [df.withColumn("scene_id", F.lit(k)) for k, (df, _) in enumerate(scenes)]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), scenes[0][1]


def compose_with_transforms(scenes: list[tuple[DataFrame, SceneFormat]], transforms: list[TransformValues | None]) -> tuple[DataFrame, SceneFormat]:
    if len(scenes) != len(transforms):
        raise ValueError(f"{len(scenes)} scenes and {len(transforms)} transforms")
    return concatenate([(df if t is None else apply_transform(df, t, f), f) for (df, f), t in zip(scenes, transforms)])


_P = [f"p{c}" for c in POS]
_COARSE, _FINE = [f"c{c}" for c in POS], [f"f{c}" for c in POS]
#: The edge of a fine cell, as a share of the threshold: two points of one cell are always nearer than it.
_EDGE = (1 - 1e-6) / math.sqrt(3)


def _placed(df: DataFrame, order: list[str], threshold: float) -> DataFrame:
    """(key, position, coarse cell, fine cell) of each row."""
    cell = lambda c, edge: F.floor(F.col(c) / edge).cast("long")
    return df.select(F.struct(*order).alias("key"), *[F.col(c).alias(p) for c, p in zip(POS, _P)], *[cell(c, threshold).alias(x) for c, x in zip(POS, _COARSE)], *[cell(c, threshold * _EDGE).alias(x) for c, x in zip(POS, _FINE)])


def _near(some: DataFrame, points: DataFrame, threshold: float, when: Column) -> DataFrame:
    """(of, key) for the points near each of some: `some` goes to its own and the
    26 coarse cells around. Of `some` a fine cell has one, so a point meets a
    bounded number of them, however many points lie together."""
    shifts = F.array(*[F.array(*map(F.lit, d)) for d in itertools.product((-1, 0, 1), repeat=3)])
    spread = some.select(F.col("key").alias("of"), *[F.col(p).alias(f"o{p}") for p in _P], *_COARSE, F.explode(shifts).alias("d"))
    spread = spread.select("of", *[f"o{p}" for p in _P], *[(F.col(c) + F.col("d")[k]).alias(c) for k, c in enumerate(_COARSE)])
    d2 = [(F.col(p) - F.col(f"o{p}")) * (F.col(p) - F.col(f"o{p}")) for p in _P]
    return points.join(spread, _COARSE).filter(when & (d2[0] + d2[1] + d2[2] < threshold * threshold)).select("of", "key")


#: Points that a block holds at most, if its edge is longer than the least, in coarse cells.
BLOCK, LEAST_EDGE = 200_000, 8
_STAYS, _OPEN = 1, 0


def _edge_of_blocks(points: DataFrame) -> int:
    """The longest power-of-two edge, in coarse cells, at which no block has more than
    BLOCK points: counts of the smallest blocks add up to those of larger ones."""
    small = points.groupBy(*[F.expr(f"{c} div {LEAST_EDGE} - int({c} % {LEAST_EDGE} < 0)").alias(c) for c in _COARSE]).agg(F.count(F.lit(1)).alias("n"))
    levels = small.select(F.explode(F.sequence(F.lit(0), F.lit(40))).alias("level"), *_COARSE, "n")
    at = levels.groupBy("level", *[F.expr(f"shiftright({c}, level)").alias(c) for c in _COARSE]).agg(F.sum("n").alias("n"))
    fits = [r["level"] for r in at.groupBy("level").agg(F.max("n").alias("n")).collect() if r["n"] <= BLOCK]
    return LEAST_EDGE << max(fits, default=0)


def _into_blocks(points: DataFrame, edge: int, own: bool) -> DataFrame:
    """points with the block (bx, by, bz) of each, or with `mine` false those that lie so near a
    border that they count in another block; own leaves those that lie in it out or not."""
    block = lambda c, d: F.floor((F.col(c) + d) / F.lit(edge)).cast("long")
    sides = [F.array_distinct(F.array(block(c, 0), block(c, -1), block(c, 1))) for c in _COARSE]
    out = points
    for c, side in zip(_COARSE, sides):
        out = out.withColumn(f"b{c}", F.explode(side))
    mine = functools.reduce(Column.__and__, [F.col(f"b{c}") == block(c, 0) for c in _COARSE])
    return out.withColumn("mine", mine) if own else out.withColumn("mine", mine).filter("not mine")


def _settle(points: DataFrame, threshold: float) -> DataFrame:
    """(key) of the points that stay by the rule of `first`.

    Space is cut into blocks of a bounded number of points. A task goes through a block in
    the order of keys, with a hash of cells in memory: a point that an earlier staying one is
    near goes, one that an earlier undecided one is near is left open, any other stays.
    Undecided are at first only the points of other blocks within a cell of the border, so
    what is left open are chains that cross borders; these go into another round, with what
    stays around them. A chain is decided as far as it lies in one block in each round, and
    the earliest open point of all is decided in every one, so rounds end. Memory holds the
    points that stay, of which a cell has few, and a box around the open points of each fine
    cell: what an open point of such a box might be near to is left open too.
    """
    edge = _edge_of_blocks(points)
    least, kind = threshold * threshold, ("key", *_P, *_COARSE, *_FINE, "state")
    around = list(itertools.product((-1, 0, 1), repeat=3))
    names = [*kind[:-1], *(f"b{c}" for c in _COARSE), "mine", "state"]
    at = {x: i for i, x in enumerate(names)}

    def go(batches):
        block, staying, open_ = None, {}, {}
        columns = [at[x] for x in (*_P, *_COARSE, *_FINE, *(f"b{c}" for c in _COARSE), "mine", "state")]
        for batch in batches:
            taken, states = [], []
            for i, (x, y, z, cx, cy, cz, fx, fy, fz, bx, by, bz, mine, state) in enumerate(zip(*(batch.column(k).to_pylist() for k in columns))):
                if (bx, by, bz) != block:
                    block, staying, open_ = (bx, by, bz), {}, {}
                if state == _OPEN:
                    cells = [(cx + dx, cy + dy, cz + dz) for dx, dy, dz in around]
                    if any((px - x) * (px - x) + (py - y) * (py - y) + (pz - z) * (pz - z) < least for c in cells if c in staying for px, py, pz in staying[c]):
                        continue
                    boxes = (box for c in cells if c in open_ for box in open_[c].values())
                    waits = not mine or any(max(a - x, 0.0, x - d) ** 2 + max(b - y, 0.0, y - e) ** 2 + max(c - z, 0.0, z - f) ** 2 < least for a, b, c, d, e, f in boxes)
                    state = _OPEN if waits else _STAYS
                    if mine:
                        taken.append(i)
                        states.append(state)
                if state == _STAYS:
                    staying.setdefault((cx, cy, cz), []).append((x, y, z))
                else:
                    own = open_.setdefault((cx, cy, cz), {})
                    a, b, c, d, e, f = own.get((fx, fy, fz), (x, y, z, x, y, z))
                    own[fx, fy, fz] = min(a, x), min(b, y), min(c, z), max(d, x), max(e, y), max(f, z)
            if taken:
                some = batch.take(pa.array(taken))
                yield pa.RecordBatch.from_arrays([*(some.column(at[k]) for k in kind[:-1]), pa.array(states, pa.int32())], list(kind))

    left = points.select(*kind[:-1], F.lit(_OPEN).alias("state"))
    settled, border = [], None  # border: what stayed in the round before
    while True:
        dealt = _into_blocks(left, edge, own=True)
        if border is not None:
            dealt = dealt.unionByName(_into_blocks(border, edge, own=False))
        by = [f"b{c}" for c in _COARSE]
        ordered = dealt.select(*names).repartition(*by).sortWithinPartitions(*by, "key")
        done = saved(ordered.mapInArrow(go, left.schema))
        border, left = done.filter(F.col("state") == _STAYS), done.filter(F.col("state") == _OPEN)
        settled.append(border.select("key"))
        if len(settled) == 16:  # so that the plan stays small, however many rounds there are
            settled = [saved(functools.reduce(DataFrame.unionByName, settled))]
        if not left.limit(1).count():
            return functools.reduce(DataFrame.unionByName, settled)


def deduplicate(df: DataFrame, threshold: float = 1e-6, method: str = "first", order: list[str] | None = None) -> DataFrame:
    """Rows without near copies: distance below the threshold, exclusive.

    last: a row goes if a later one is near. first: from the earliest on, a row
    stays unless an earlier row that stays is near. `order` names the columns of
    the row order, which have to be unique together; gid by default.

    Exact copies come first: of the rows at one position all but one go at once,
    by aggregation. For `last`, fine cells are so small that their points are all near one
    another: only the last point of each can stay, so only these are held against the
    points around. For `first`, blocks of space are settled by one task each, see `_settle`.
    """
    if method == "average":
        raise NotImplementedError("method 'average'")
    if method not in ("first", "last"):
        raise ValueError(f"no method {method!r}")
    if threshold <= 0:
        return df  # no distance is below it
    order = order or ["gid"]
    # -0.0 and 0.0 are one position
    spot = [(F.col(c) + 0.0).alias(f"p{c}") for c in POS]
    key = F.struct(*order)
    alone = df.groupBy(*spot).agg((F.min if method == "first" else F.max)(key).alias("key")).select("key.*")
    points = saved(_placed(df.join(alone, order, "left_semi"), order, threshold))
    one_of_each = lambda rows, f: rows.join(rows.groupBy(*_FINE).agg(f("key").alias("key")).select("key"), "key", "left_semi")
    if method == "last":
        last = one_of_each(points, F.max)
        stays = last.join(_near(last, points, threshold, F.col("key") > F.col("of")).select(F.col("of").alias("key")).distinct(), "key", "left_anti").select("key")
    else:
        stays = _settle(points, threshold)
    return df.join(stays.select("key.*"), order, "left_semi")


def merge_scenes(scenes: list[tuple[DataFrame, SceneFormat]], transforms=None, deduplicate_threshold: float | None = None) -> tuple[DataFrame, SceneFormat]:
    df, fmt = compose_with_transforms(scenes, transforms) if transforms else concatenate(scenes)
    return (df if deduplicate_threshold is None else deduplicate(df, deduplicate_threshold, order=["scene_id", "gid"])), fmt
