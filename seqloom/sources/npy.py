"""Spark data sources for NumPy artefacts: arrays in .npy files or members of .npz files, and pools of several of them.

A .npy member has a short header (kind, shape) and then its rows one after another, so the driver reads headers only, plans ranges of rows, and tasks
read the bytes of their ranges. Members of an .npz that are stored uncompressed lie in the file as they are and are read by ranges too;
compressed ones and arrays in Fortran order are read whole by one task.

    spark.dataSource.register(NpySource)          # format npy: (row, value) of one array
    spark.dataSource.register(NpyPoolSource)      # format npy_pool: (frame_id, feature, symbol, gender[, phone])

A pool is a folder of arrays with a row a frame. `features` (a .npy; an .h5 is told of, for it needs another reader), `symbols` and `genders`
must be there; `phones` may be. A folder of pools is read as one, its frames numbered on from pool to pool, in the order of the folders' names.
Cluster centers by phone, `phone_clusters.npz`, are read by `clusters`.
"""

from __future__ import annotations

import ast
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a range.
RANGE_ROWS = 65_536
REQUIRED, OPTIONAL = ("features", "symbols", "genders"), ("phones",)
COLUMNS = {"features": "feature", "symbols": "symbol", "genders": "gender", "phones": "phone"}


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)


@dataclass
class Member:
    """Where an array lies: its file, the member of an .npz, the first byte of its rows, its kind and shape."""

    path: str
    name: str | None
    offset: int
    kind: str
    shape: tuple[int, ...]
    whole: bool

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    def read(self, start: int, end: int) -> np.ndarray:
        """The rows from start to end."""
        store, path = opened(self.path)
        with store.open_input_file(path) as f:
            if self.whole:
                if self.name is None:
                    return np.load(f, allow_pickle=False)[start:end]
                with zipfile.ZipFile(f) as z, z.open(self.name) as m:
                    return np.lib.format.read_array(m, allow_pickle=False)[start:end]
            size = np.dtype(self.kind).itemsize * int(np.prod(self.shape[1:], dtype=np.int64))
            f.seek(self.offset + start * size)
            return np.frombuffer(f.read((end - start) * size), self.kind).reshape(end - start, *self.shape[1:])


def _header(f) -> tuple[str, tuple[int, ...], bool, int]:
    """(kind, shape, in Fortran order, length of the header) of what begins with a .npy header."""
    start = f.read(8)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy array")
    wide = start[6] > 1
    (size,) = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))
    facts = ast.literal_eval(f.read(size).decode("utf-8" if start[6] > 2 else "latin1"))
    if np.dtype(facts["descr"]).hasobject:
        raise ValueError("arrays of objects would be unpickled; they are not read")
    return facts["descr"], tuple(facts["shape"]), facts["fortran_order"] and len(facts["shape"]) > 1, 8 + (4 if wide else 2) + size


def member(path: str, name: str | None = None) -> Member:
    """The array of a .npy file, or the named member of an .npz."""
    store, at = opened(path)
    with store.open_input_file(at) as f:
        if name is None:
            kind, shape, fortran, size = _header(f)
            return Member(path, None, size, kind, shape, fortran)
        with zipfile.ZipFile(f) as z:
            info = z.getinfo(f"{name}.npy")
            with z.open(info) as m:
                kind, shape, fortran, size = _header(m)
        f.seek(info.header_offset + 26)  # the lengths of the name and of what else stands before the member
        start = info.header_offset + 30 + sum(struct.unpack("<HH", f.read(4)))
        return Member(path, f"{name}.npy", start + size, kind, shape, fortran or info.compress_type != zipfile.ZIP_STORED)


def members(path: str) -> list[str]:
    """The names of the arrays of an .npz."""
    store, at = opened(path)
    with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        return [n[:-4] for n in z.namelist() if n.endswith(".npy")]


def _type(m: Member) -> str:
    kind = {"f": "double" if np.dtype(m.kind).itemsize > 4 else "float", "i": "bigint", "u": "bigint", "b": "boolean", "U": "string"}.get(np.dtype(m.kind).kind)
    if kind is None:
        raise ValueError(f"{m.path}: arrays of {m.kind} are not read")
    for _ in m.shape[1:]:
        kind = f"array<{kind}>"
    return kind


def _column(x: np.ndarray) -> pa.Array:
    if x.dtype.kind in "iu":
        x = x.astype(np.int64)
    elif x.dtype.kind == "f":
        x = x.astype(np.float64 if x.dtype.itemsize > 4 else np.float32)
    flat = pa.array(np.ascontiguousarray(x).ravel())
    for n, size in [(int(np.prod(x.shape[:i])), x.shape[i]) for i in range(x.ndim - 1, 0, -1)]:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size, pa.int32()), flat)
    return flat


@dataclass
class Rows(InputPartition):
    """Rows start to end of some members, numbered from `first`."""

    members: list[Member]
    start: int
    end: int
    first: int


class RangeReader(DataSourceReader):
    def __init__(self, parts: list[tuple[list[Member], int]], names: list[str], rows: int):
        self.parts, self.names, self.rows = parts, names, rows

    def partitions(self) -> list[Rows]:
        out = []
        for found, first in self.parts:
            n = found[0].rows
            step = n if any(m.whole for m in found) else self.rows
            out += [Rows(found, at, min(at + step, n), first) for at in range(0, n, max(step, 1))]
        return out or [Rows([], 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.members:
            columns = [_column(m.read(partition.start, partition.end)) for m in partition.members]
            numbers = pa.array(np.arange(partition.start, partition.end) + partition.first, pa.int64())
            yield pa.RecordBatch.from_arrays([numbers, *columns], self.names)


class NpySource(DataSource):
    """Options: path; member, for an .npz; rows, of a range."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _member(self) -> Member:
        return member(self.options["path"], self.options.get("member"))

    def schema(self) -> str:
        return f"row bigint, value {_type(self._member())}"

    def reader(self, schema) -> RangeReader:
        return RangeReader([([self._member()], 0)], ["row", "value"], int(self.options.get("rows", RANGE_ROWS)))


def layout(path: str) -> dict[str, Member]:
    """The arrays of one pool. Raises FileNotFoundError for one that must be there, ValueError where they have unequal numbers of rows."""
    store, at = opened(path)
    there = lambda name: store.get_file_info(f"{at}/{name}").is_file
    if not there("features.npy") and there("features.h5"):
        raise ValueError(f"{path}/features.h5: write it as features.npy first, there is no reader of HDF5 here")
    for name in REQUIRED:
        if not there(f"{name}.npy"):
            raise FileNotFoundError(f"{path}/{name}.npy")
    found = {n: member(f"{path.rstrip('/')}/{n}.npy") for n in (*REQUIRED, *OPTIONAL) if there(f"{n}.npy")}
    if len({m.rows for m in found.values()}) > 1:
        raise ValueError(f"{path}: unequal numbers of rows, " + ", ".join(f"{n} {m.rows}" for n, m in found.items()))
    return found


def layouts(path: str) -> list[dict[str, Member]]:
    """The pools of a path: itself, or the folders in it. All must have the same arrays, of the same kinds."""
    from pyarrow import fs

    store, at = opened(path)
    if any(store.get_file_info(f"{at}/{n}").is_file for n in ("features.npy", "features.h5", "symbols.npy", "genders.npy")):
        return [layout(path)]
    folders = sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.Directory and not x.base_name.startswith(("_", ".")))
    found = [layout(path.rstrip("/") + "/" + p.rsplit("/", 1)[1]) for p in folders]
    if not found:
        raise FileNotFoundError(f"no pool in {path}")
    if len({tuple((n, _type(m), m.shape[1:]) for n, m in x.items()) for x in found}) > 1:
        raise ValueError(f"{path}: its pools have different arrays")
    return found


class NpyPoolSource(DataSource):
    """Options: path; rows, of a range."""

    @classmethod
    def name(cls) -> str:
        return "npy_pool"

    def schema(self) -> str:
        return "frame_id bigint, " + ", ".join(f"{COLUMNS[n]} {_type(m)}" for n, m in layouts(self.options["path"])[0].items())

    def reader(self, schema) -> RangeReader:
        parts, first = [], 0
        for x in layouts(self.options["path"]):
            parts.append((list(x.values()), first))
            first += x["features"].rows
        return RangeReader(parts, schema.fieldNames(), int(self.options.get("rows", RANGE_ROWS)))


def registered(spark: SparkSession) -> SparkSession:
    for source in (NpySource, NpyPoolSource):
        spark.dataSource.register(source)
    return spark


def read_pool(spark: SparkSession, path: str, rows: int = RANGE_ROWS) -> DataFrame:
    return registered(spark).read.format("npy_pool").option("rows", rows).load(path)


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(phone, center_no, center) of an .npz with a member of centers (k x dims) for each phone, named by its number."""
    out = None
    for name in sorted(members(path), key=lambda n: int(n)):
        one = registered(spark).read.format("npy").option("member", name).load(path)
        one = one.selectExpr(f"{int(name)} AS phone", "cast(row AS int) AS center_no", "cast(value AS array<double>) AS center")
        out = one if out is None else out.unionByName(one)
    return out


def write_pool(frames: DataFrame, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Writes frames (feature, symbol, gender and, if there, phone) as a folder of pools, one a partition of the table, and returns (folder, rows). The path
    is a file system that all executors share. A task that is repeated writes another folder; only those that are returned count, and the
    others go."""
    names = columns or {n: c for n, c in COLUMNS.items() if c in frames.columns}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        store, at = opened(path)
        folder = f"pool-{task.partitionId():06d}-{task.taskAttemptId()}"
        store.create_dir(f"{at}/{folder}", recursive=True)
        for name, column in names.items():
            c = t.column(column).combine_chunks()
            x = np.stack(c.to_numpy(zero_copy_only=False)) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)
            with store.open_output_stream(f"{at}/{folder}/{name}.npy") as f:
                np.lib.format.write_array(f, np.ascontiguousarray(x), allow_pickle=False)
        yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([len(t)], pa.int64())], ["folder", "rows"])

    from seqloom.storage import stored

    done = stored(frames.select(*names.values()).mapInArrow(write, "folder string, rows bigint"), "pools")
    from pyarrow import fs

    store, at = opened(path)
    kept = {r["folder"] for r in done.select("folder").collect()}  # a name a task
    for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if x.type == fs.FileType.Directory and x.base_name not in kept:
            store.delete_dir(x.path)
    return done
