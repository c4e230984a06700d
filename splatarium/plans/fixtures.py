"""Scenes derived from the test tables, as DataFrames and as the same in SQL.

l: linear scales and opacities, RGB, from lineitem. e: logarithmic scales, logits
and harmonics with three higher bands, from embeddings. p: points on a grid with
near copies, from part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scene import Scene
from ..scene_format import SceneFormat

_ID = "l_orderkey AS okey, l_partkey AS pkey, l_suppkey AS skey, l_linenumber AS lnum"
_NORM = "sqrt(1.25+l_discount*l_discount+l_tax*l_tax)"
SQL_L = f"""SELECT {_ID}, l_quantity/5-5 AS x, l_extendedprice/10500-5 AS y, l_discount*100-5 AS z, 0.01+l_tax AS sx, 0.01+l_discount AS sy, l_quantity/50 AS sz,
 1/{_NORM} AS qw, l_discount/{_NORM} AS qx, l_tax/{_NORM} AS qy, 0.5/{_NORM} AS qz, l_quantity/50 AS opacity, l_discount*10 AS r, l_tax*12.5 AS g, l_extendedprice/105000 AS b FROM lineitem"""
KEYS_L = ("okey", "pkey", "skey", "lnum")


def _sql_e(first: int) -> str:
    v = lambda k: f"CAST(embedding[{k + first}] AS DOUBLE)"
    norm = "sqrt(" + "+".join(f"{v(k)}*{v(k)}" for k in range(6, 10)) + ")"
    cols = [f"{v(k)}*10 AS {n}" for k, n in enumerate("xyz")] + [f"{v(k)}*10-2 AS {n}" for k, n in zip((3, 4, 5), ("sx", "sy", "sz"))]
    cols += [f"{v(k)}/{norm} AS {n}" for k, n in zip((6, 7, 8, 9), ("qw", "qx", "qy", "qz"))]
    cols += [f"{v(10)}*10 AS opacity"] + [f"{v(k)}*4 AS {n}" for k, n in zip((11, 12, 13), "rgb")]
    bands = [f"{v(14 + 3 * k + i)} AS shn_{k}_{n}" for k in range(3) for i, n in enumerate("rgb")]
    return f"SELECT vec_id AS gid, {', '.join(cols + bands)} FROM embeddings"


SQL_E = _sql_e(1)
SQL_P = "SELECT p_partkey AS gid, CAST(p_size AS DOUBLE)/5-5 AS x, (p_retailprice-900)/10-5 AS y, CAST(0 AS DOUBLE) AS z FROM part"


def _scene(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    columns = sql[len("SELECT ") : sql.rindex(" FROM ")]
    return df.selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    """Commas outside brackets part the columns."""
    out, depth, word = [], 0, ""
    for ch in columns:
        depth += (ch in "([") - (ch in ")]")
        if ch == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += ch
    return [*out, word]


def scene_l(spark: SparkSession, sf_dir: str) -> Scene:
    return Scene(_scene(spark, sf_dir, "lineitem", SQL_L))


def scene_e(spark: SparkSession, sf_dir: str) -> Scene:
    df = _scene(spark, sf_dir, "embeddings", _sql_e(0))
    bands = ", ".join(f"named_struct('r', shn_{k}_r, 'g', shn_{k}_g, 'b', shn_{k}_b)" for k in range(3))
    plain = [x for x in df.columns if not x.startswith("shn_")]
    return Scene(df.selectExpr(*plain, f"array({bands}) AS shn"), SceneFormat(rgb=False, log_scale=True, logit_opacity=True))


def points_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene(spark, sf_dir, "part", SQL_P)
