"""PLY files as a Spark data source, and one PLY file written by many tasks.

    register(spark)
    spark.read.format("ply").schema("gid bigint, x float, y float, z float").load(folder)
    df.write.format("ply").mode("append").save(folder)

Reading: the driver reads headers only; tasks read ranges of rows of any file, through
pyarrow's file systems, and make only the columns of the schema that was asked for.
Conditions on gid leave out whole ranges; for that, `register` lets Spark offer
conditions to sources (`spark.sql.python.filterPushdown.enabled`).

Writing: each task writes complete files of its rows under names that no reader takes, and
the commit gives them their names; so a task that runs again, or a job that fails, leaves no
row twice. `write_one_file` makes one file of a whole scene: tasks put their rows at their
place in it, so nothing but the header passes through the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..scene import Scene
from . import ply
from .scratch import saved

SCHEMA = "file string, gid bigint, " + ", ".join(f"{c} float" for c in ply.PROPERTIES.values()) + ", rest array<float>"
_THEIRS = {ours: theirs for theirs, ours in ply.PROPERTIES.items()}


@dataclass
class Range(InputPartition):
    """Rows of one file: where they begin, and what a row is."""

    uri: str
    begin: int
    first: int
    n: int
    kind: list


def _files(path: str) -> list[str]:
    """A file, or the PLY files below a folder."""
    from pyarrow import fs

    store, at = ply._open(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else "file://"
    if store.get_file_info(at).type == fs.FileType.File:
        return [path]
    return sorted(head + x.path for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and x.base_name.endswith(".ply") and x.base_name[0] not in "._")


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path, self.rows = options["path"], int(options.get("rangeRows", ply.RANGE_ROWS))
        self.least, self.below = 0, None  # rows of a file from here, up to there
        unknown = set(self.names) - {"file", "gid", "rest", *_THEIRS}
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")

    def pushFilters(self, filters):
        """Conditions on gid leave ranges out; Spark applies all conditions again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("gid",) and isinstance(getattr(f, "value", None), int):
                low = {GreaterThan: f.value + 1, GreaterThanOrEqual: f.value, EqualTo: f.value}.get(type(f))
                high = {LessThan: f.value, LessThanOrEqual: f.value + 1, EqualTo: f.value + 1}.get(type(f))
                self.least = self.least if low is None else max(self.least, low)
                self.below = self.below if high is None else min(high, self.below if self.below is not None else high)
            yield f

    def partitions(self):
        out = []
        for uri in _files(self.path):
            store, at = ply._open(uri)
            with store.open_input_file(at) as f:
                begin, n, kind = ply.parse_header(f.read(1 << 16))
            n = n if self.below is None else min(n, self.below)
            out += [Range(uri, begin, a, min(self.rows, n - a), kind.descr) for a in range(self.least, n, self.rows)]
        return out

    def read(self, part: Range):
        kind = np.dtype([tuple(x) for x in part.kind])
        store, at = ply._open(part.uri)
        with store.open_input_file(at) as f:
            f.seek(part.begin + part.first * kind.itemsize)
            for a in range(part.first, part.first + part.n, ply.BATCH_ROWS):
                n = min(ply.BATCH_ROWS, part.first + part.n - a)
                raw = f.read(n * kind.itemsize)
                if len(raw) < n * kind.itemsize:
                    raise ValueError(f"{part.uri} ends before its last row")
                yield pa.RecordBatch.from_arrays([self._column(name, np.frombuffer(raw, kind), part.uri, a) for name in self.names], self.names)

    @staticmethod
    def _column(name: str, rows: np.ndarray, uri: str, first: int) -> pa.Array:
        n = len(rows)
        if name == "file":
            return pa.repeat(uri, n)
        if name == "gid":
            return pa.array(np.arange(first, first + n))
        if name in _THEIRS:
            return pa.array(rows[_THEIRS[name]].astype(np.float32)) if _THEIRS[name] in rows.dtype.names else pa.nulls(n, pa.float32())
        k = sum(x.startswith("f_rest_") for x in rows.dtype.names)
        if not k:
            return pa.nulls(n, pa.list_(pa.float32()))
        # coefficients stand channel by channel in a file, and band by band in a scene
        flat = np.stack([rows[f"f_rest_{i}"] for i in range(k)], 1).reshape(n, 3, k // 3).transpose(0, 2, 1).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(flat.ravel()))


@dataclass
class _Written(WriterCommitMessage):
    files: list  # (name for now, name when it counts)


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"].rstrip("/"), schema.names, overwrite
        missing = set(_THEIRS) - set(self.names)
        if missing:
            raise ValueError(f"a PLY file also needs {', '.join(sorted(missing))}")

    def write(self, batches) -> _Written:
        from pyspark import TaskContext

        part, tag, files, bodies, size = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], [], [], 0

        def put() -> None:
            nonlocal bodies, size
            name = f"part-{part:05d}-{len(files):05d}-{tag}.ply"
            store, at = ply._open(f"{self.path}/_{name}")
            store.create_dir(at.rpartition("/")[0], recursive=True)
            with store.open_output_stream(at) as f:
                f.write(ply._header(size, bodies[0].shape[1] - len(_THEIRS)))
                for body in bodies:
                    f.write(body.tobytes())
            files.append((f"_{name}", name))
            bodies, size = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(self.names.index(c)).to_numpy(zero_copy_only=False).astype(np.float32) for c in ply.PROPERTIES.values()]
            if "rest" in self.names and batch.column(self.names.index("rest")).null_count < batch.num_rows:
                rest = np.stack(batch.column(self.names.index("rest")).to_pylist()).astype(np.float32)
                columns += list(rest.reshape(len(rest), -1, 3).transpose(0, 2, 1).reshape(len(rest), -1).T)
            rows = np.stack(columns, 1).astype("<f4")
            if bodies and (size + len(rows) > ply.PIECE_ROWS or rows.shape[1] != bodies[0].shape[1]):
                put()
            bodies.append(rows)
            size += len(rows)
        if bodies:
            put()
        return _Written(files)

    def commit(self, messages) -> None:
        fresh = [x for m in messages if m for x in m.files]
        store, at = ply._open(self.path)
        if self.overwrite:
            for old in _files(self.path) if store.get_file_info(at).type.name == "Directory" else []:
                s, path = ply._open(old)
                s.delete_file(path)
        for now, then in fresh:
            store.move(f"{at}/{now}", f"{at}/{then}")

    def abort(self, messages) -> None:
        store, at = ply._open(self.path)
        for now, _ in [x for m in messages if m for x in m.files]:
            store.delete_file(f"{at}/{now}")


class PlySource(DataSource):
    """`spark.read.format("ply")` and `df.write.format("ply")`."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlySource)


def write_one_file(scene: Scene, uri: str, gid: str = "gid") -> int:
    """The whole scene, in the order of gid, as one file on a mount that the driver and all
    tasks share; the number of its rows. Tasks write their pieces at their places, and a task
    that runs again writes the same bytes again. A file system that can't write into the
    middle of a file has no single files of this kind: write a folder of parts there."""
    store, path = ply._open(uri)
    if store.type_name != "local":
        raise ValueError(f"{store.type_name} files can't be written by many tasks; write a folder with format('ply')")
    pieces = saved(ply._pieces(scene, gid, True))
    sizes = pieces.select("part", "piece", "n", F.octet_length("content").alias("size")).orderBy("part", "piece").toPandas()  # a row for each piece of a million rows
    places = sizes.assign(at=sizes["size"].cumsum() - sizes["size"])[["part", "piece", "at"]]
    spark = scene.df.sparkSession
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with open(f"{path}.writing", "wb") as f:
        f.truncate(int(sizes["size"].sum()))

    def put(batches):
        for pdf in batches:
            with open(f"{path}.writing", "r+b") as f:
                for at, content in zip(pdf["at"], pdf["content"]):
                    f.seek(at)
                    f.write(content)
            yield pd.DataFrame({"n": pdf["n"]})

    placed = pieces.join(F.broadcast(spark.createDataFrame(places)), ["part", "piece"])
    n = placed.select("at", "n", "content").mapInPandas(put, "n bigint").agg(F.sum("n")).first()[0]
    store.move(f"{path}.writing", path)
    return n


def read_scene(df: DataFrame, fmt) -> Scene:
    """A scene of what `format("ply")` gives, with bands if there are any."""
    return Scene(ply.with_bands(df) if "rest" in df.columns else df, fmt)
