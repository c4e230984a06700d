"""Are two scenes the same? Formats, rows and values, compared where they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scene import Scene
from ..scene_format import OPACITY, POS, QUAT, RGB, SCALE


def assert_same_format(a: Scene, b: Scene) -> None:
    if a.format != b.format:
        raise AssertionError(f"formats differ: {a.format.summary()}; {b.format.summary()}")


def assert_equivalent(a: Scene, b: Scene, rtol: float = 1e-5, atol: float = 1e-6, keys: tuple[str, ...] = ("gid",), check_format: bool = True, check_all: bool = True) -> None:
    """Raises unless both scenes have the same rows by key and values within
    atol + rtol * |value of b|; two nulls, or two NaN, are equal.

    One join and one aggregate, whose row of counts is all that comes back. A key
    that stands on several rows of a scene is a difference.
    """
    if check_format:
        assert_same_format(a, b)
    names = [*RGB, *((*POS, *QUAT, *SCALE, OPACITY) if check_all else ())]
    names = [n for n in names if n in a.df.columns or n in b.df.columns]
    side = lambda s, k: s.df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{k}"), *[F.first(n).alias(f"{n}{k}") for n in names])
    both = side(a, 0).join(side(b, 1), list(keys), "full")

    def off(n: str):
        x, y = F.col(f"{n}0").cast("double"), F.col(f"{n}1").cast("double")
        near = F.abs(x - y) <= F.abs(y) * rtol + atol
        return F.sum(F.when(x.eqNullSafe(y) | F.coalesce(near & ~F.isnan(x) & ~F.isnan(y), F.lit(False)), 0).otherwise(1)).alias(n)

    rows = F.sum(F.when((F.coalesce("n0", F.lit(0)) == 1) & (F.coalesce("n1", F.lit(0)) == 1), 0).otherwise(1)).alias("rows")
    found = {k: v for k, v in both.agg(rows, *map(off, names)).first().asDict().items() if v}
    if found:
        raise AssertionError("scenes differ: " + ", ".join(f"{k} in {v} rows" if k != "rows" else f"{v} keys are not in both, once" for k, v in found.items()))
