"""PLY files of splat scenes, read and written by Spark tasks.

A PLY file is a header in text and rows of fixed length. A file of up to
`SPLIT_BYTES` comes to a task whole, through Spark's reader. A larger one is cut
into ranges of rows, and tasks read their ranges by themselves, through pyarrow's
file systems; so a file of any size is shared by many tasks. A row's place in its
file becomes gid. Writing gives files of bounded size, each a complete PLY of its
rows, in gid order over the files; or the pieces of one file.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scene import Scene
from ..scene_format import BANDS, SceneFormat
from .scratch import saved

#: The property names of the format, and ours for them.
PROPERTIES = {
    "x": "x", "y": "y", "z": "z", "scale_0": "sx", "scale_1": "sy", "scale_2": "sz", "rot_0": "qw", "rot_1": "qx", "rot_2": "qy", "rot_3": "qz",
    "opacity": "opacity", "f_dc_0": "r", "f_dc_1": "g", "f_dc_2": "b",
}
#: Files above are read in ranges of so many rows; batches and written pieces have so many.
SPLIT_BYTES, RANGE_ROWS, BATCH_ROWS, PIECE_ROWS = 128 << 20, 1 << 20, 100_000, 1 << 20
_TYPES = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4"}


def parse_header(head: bytes) -> tuple[int, int, np.dtype]:
    """(length of the header, number of rows, type of a row)."""
    end = head.find(b"end_header\n")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    lines = head[:end].decode("ascii").split("\n")
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(next((x.split()[1] for x in lines if x.startswith("format ")), ""))
    count = next((re.fullmatch(r"element vertex (\d+)", x.strip()) for x in lines if x.startswith("element vertex")), None)
    if order is None or count is None:
        raise ValueError("only binary PLY files with vertices are supported")
    fields = [x.split()[1:3] for x in lines if x.startswith("property ")]
    return end + len(b"end_header\n"), int(count[1]), np.dtype([(name, order + _TYPES[kind]) for kind, name in fields])


def _open(uri: str):
    """(file system, path) of a file that Spark names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def _frame(raw: bytes, kind: np.dtype, file: str, first: int) -> pd.DataFrame:
    part = np.frombuffer(raw, kind)
    bands = sum(f.startswith("f_rest_") for f in kind.names) // 3
    out = pd.DataFrame({ours: part[theirs].astype(np.float32) for theirs, ours in PROPERTIES.items()})
    # rest coefficients stand channel by channel
    rest = np.stack([part[f"f_rest_{k}"] for k in range(3 * bands)], 1).reshape(-1, 3, bands) if bands else None
    out["rest"] = list(rest.transpose(0, 2, 1).reshape(len(part), -1).astype(np.float32)) if bands else [None] * len(part)
    out.insert(0, "gid", np.arange(first, first + len(part)))
    out.insert(0, "file", file)
    return out


def _whole(batches):
    """Rows of files that come whole."""
    for pdf in batches:
        for file, raw in zip(pdf["path"], pdf["content"]):
            start, n, kind = parse_header(bytes(raw[: 1 << 16]))
            for a in range(0, n, BATCH_ROWS):
                size = min(BATCH_ROWS, n - a) * kind.itemsize
                yield _frame(raw[start + a * kind.itemsize :][:size], kind, file, a)


def _ranges(batches):
    """(path, first, n) of the ranges of large files."""
    for pdf in batches:
        for file in pdf["path"]:
            store, path = _open(file)
            with store.open_input_file(path) as f:
                _, n, _ = parse_header(f.read(1 << 16))
            first = np.arange(0, n, RANGE_ROWS)
            yield pd.DataFrame({"path": file, "first": first, "n": np.minimum(RANGE_ROWS, n - first)})


def _read_ranges(batches):
    for pdf in batches:
        for file, first, n in zip(pdf["path"], pdf["first"].tolist(), pdf["n"].tolist()):
            store, path = _open(file)
            with store.open_input_file(path) as f:
                start, _, kind = parse_header(f.read(1 << 16))
                f.seek(start + first * kind.itemsize)
                for a in range(first, first + n, BATCH_ROWS):
                    some = min(BATCH_ROWS, first + n - a)
                    raw = f.read(some * kind.itemsize)
                    if len(raw) < some * kind.itemsize:
                        raise ValueError(f"{file} ends before its last row")
                    yield _frame(raw, kind, file, a)


def read_ply(spark: SparkSession, path: str, fmt: SceneFormat = SceneFormat(rgb=False, log_scale=True, logit_opacity=True), split_bytes: int = SPLIT_BYTES) -> Scene:
    """A file, or all PLY files of a folder; gid is unique within a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = list(PROPERTIES.values())
    schema = "file string, gid bigint, " + ", ".join(f"{c} float" for c in names) + ", rest array<float>"
    small = files.filter(F.col("length") <= split_bytes).select("path", "content").mapInPandas(_whole, schema)
    large = files.filter(F.col("length") > split_bytes).select("path")  # contents of these are not read here
    dealt = large.mapInPandas(_ranges, "path string, first bigint, n bigint").repartition("path", "first")
    flat = small.unionByName(dealt.mapInPandas(_read_ranges, schema))
    return Scene(with_bands(flat), fmt)


def with_bands(df: DataFrame) -> DataFrame:
    """df with harmonic bands in place of their coefficients end to end."""
    bands = F.transform(F.sequence(F.lit(0), (F.size("rest") / 3 - 1).cast("int")), lambda k: F.struct(*[F.get("rest", (k * 3 + i).cast("int")).alias(n) for i, n in enumerate("rgb")]))
    return df.withColumn(BANDS, F.when(F.size("rest") > 0, bands)).drop("rest")


def _header(n: int, n_rest: int) -> bytes:
    names = [*PROPERTIES, *(f"f_rest_{k}" for k in range(n_rest))]
    return "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property float {x}" for x in names), "end_header", ""]).encode()


def _pieces(scene: Scene, gid: str, one_file: bool) -> DataFrame:
    """(part, piece, n, content): pieces of at most `PIECE_ROWS` rows in the order of
    part and piece. Each is a file, or all of them are, behind a piece of its header."""
    df = scene.df
    has_bands = BANDS in df.columns
    total = df.agg(F.count(F.lit(1)).alias("n"), *([F.max(F.size(BANDS)).alias("bands")] if has_bands else [])).first()
    n_rest = 3 * max(0, total["bands"] or 0) if has_bands else 0
    rest = [F.flatten(F.transform(BANDS, lambda b: F.array(b["r"], b["g"], b["b"]))).alias("rest")] if n_rest else []
    dealt = df.repartitionByRange(gid).sortWithinPartitions(gid).select(*PROPERTIES.values(), *rest)

    def parts(batches):
        from pyspark import TaskContext

        part, piece, held, size = TaskContext.get().partitionId(), 0, [], 0

        def made():
            body = np.concatenate(held)
            head = b"" if one_file else _header(len(body), n_rest)
            return pd.DataFrame({"part": [part], "piece": [piece], "n": [len(body)], "content": [head + body.tobytes()]})

        for pdf in batches:
            columns = [pdf[c].to_numpy(np.float32) for c in PROPERTIES.values()]
            if n_rest and len(pdf):
                coefficients = np.stack(pdf["rest"].to_list()).astype(np.float32)
                columns += list(coefficients.reshape(len(pdf), -1, 3).transpose(0, 2, 1).reshape(len(pdf), -1).T)
            rows = np.stack(columns, 1).astype("<f4")
            for a in range(0, len(rows), PIECE_ROWS):
                if held and size + len(rows[a : a + PIECE_ROWS]) > PIECE_ROWS:
                    yield made()
                    piece, held, size = piece + 1, [], 0
                held.append(rows[a : a + PIECE_ROWS])
                size += len(held[-1])
        if held:
            yield made()

    pieces = dealt.mapInPandas(parts, "part int, piece int, n bigint, content binary")
    if not one_file:
        return pieces
    head = scene.df.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("n"), F.lit(_header(total["n"], n_rest)).alias("content"))
    return head.unionByName(pieces)


def write_ply(scene: Scene, path: str, gid: str = "gid", one_file: bool = False) -> DataFrame:
    """Pieces of a scene as PLY bytes in a table at `path`: (part, piece, n, content).

    `save_parts` writes them out as local files. With one_file, they are the pieces
    of one file, the first its header.
    """
    _pieces(scene, gid, one_file).write.mode("overwrite").parquet(path)
    return scene.df.sparkSession.read.parquet(path)


def save_parts(parts: DataFrame, folder: str) -> list[str]:
    """Pieces as local files, one at a time through the driver: an export of a
    scene that fits on its disk."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    out, one_file = [], False
    for row in parts.orderBy("part", "piece").toLocalIterator():
        one_file |= row["part"] < 0
        file = Path(folder) / ("scene.ply" if one_file else f"part-{row['part']:05d}-{row['piece']:05d}.ply")
        with file.open("ab" if out and one_file else "wb") as f:
            f.write(bytes(row["content"]))
        if str(file) not in out:
            out.append(str(file))
    return out


def export_ply(scene: Scene, folder: str, gid: str = "gid") -> DataFrame:
    """Files of a scene in a folder that all executors reach, written by the tasks
    themselves; (file, n). A task that runs again writes the same names again."""

    def put(batches):
        for pdf in batches:
            for part, piece, content in zip(pdf["part"], pdf["piece"], pdf["content"]):
                file = f"{folder.rstrip('/')}/part-{part:05d}-{piece:05d}.ply"
                store, path = _open(file)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(content)
            yield pd.DataFrame({"file": [f"{folder.rstrip('/')}/part-{a:05d}-{b:05d}.ply" for a, b in zip(pdf["part"], pdf["piece"])], "n": pdf["n"]})

    return saved(_pieces(scene, gid, False).mapInPandas(put, "file string, n bigint"))
