"""Arrays of .npy and .npz files as a batch source and sink.

``spark.dataSource.register(NpySource)``; then ``spark.read.format("npy").load(folder)`` gives name (the file's path
inside the folder without its ending, then ``/member`` for .npz), position (index on the first axis), shape (of the
whole array) and values (the slice, flat). Files are listed and read through the store of the folder's address (any
that pyarrow knows), an array is cut along its first axis into ranges of ``splitBytes`` (16 MB by default), and a task
reads its range only. Members of an .npz that were stored compressed cannot be cut; a task reads one whole. Arrays in
Fortran order are read whole too. Files in folders whose name begins with ``_`` or ``.`` are passed over.

``rows.write.format("npy").mode("append").save(folder)`` takes the columns position and values: each task writes an
.npz of its positions (``key``) and values (``values``, two axes) under a temporary name. When all tasks are done, the
files get their names and ``manifest.json`` lists them with their rows and sha256; if one fails, all are deleted. A
task holds its partition's values. Null or uneven values are an error.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, position long, shape array<long>, values array<double>"
SPLIT_BYTES = 16 << 20
#: Values of an Arrow batch.
BATCH_VALUES = 1 << 20
MANIFEST = "manifest.json"


def store(uri: str) -> tuple:
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class ArrayRange(InputPartition):
    """Some of an array's first axis. start: where its numbers begin in the file; -1: the array is read whole."""

    path: str
    name: str
    member: str
    first: int
    last: int
    start: int
    shape: tuple
    kind: str


def _header(f) -> tuple[tuple, bool, np.dtype]:
    """Shape, Fortran order and type of the .npy whose beginning f is at."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(f)
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    return shape, fortran, kind


class ArrayReader(DataSourceReader):
    """Reads headers where the read is planned, ranges in tasks."""

    def __init__(self, folder: str, split: int) -> None:
        self.folder, self.split = folder, split

    def _ranges(self, path: str, name: str, member: str, start: int, shape: tuple, whole: bool, kind: np.dtype) -> Iterator[ArrayRange]:
        if not shape:
            return
        size = max(1, int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize)
        step = max(shape[0], 1) if whole else max(1, self.split // size)
        for first in range(0, shape[0], step):
            yield ArrayRange(path, name, member, first, min(first + step, shape[0]), -1 if whole else start, shape, kind.str)

    def partitions(self) -> list[ArrayRange]:
        """The ranges of all arrays, in the order of their names."""
        from pyarrow import fs

        files, root = store(self.folder)
        out: list[ArrayRange] = []
        for info in sorted(files.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            inside = info.path[len(root.rstrip("/")) + 1 :]
            if info.type != fs.FileType.File or not inside.endswith((".npy", ".npz")) or any(p[0] in "_." for p in inside.split("/")):
                continue
            name = inside[:-4]
            with files.open_input_file(info.path) as f:
                if inside.endswith(".npy"):
                    shape, fortran, kind = _header(f)
                    out += self._ranges(info.path, name, "", f.tell(), shape, fortran, kind)
                    continue
                with zipfile.ZipFile(f) as z:
                    for member in z.infolist():
                        with z.open(member) as g:
                            shape, fortran, kind = _header(g)
                            inner = g.tell() if member.compress_type == zipfile.ZIP_STORED else 0
                        #: A stored member begins after its local header, whose two last fields are the lengths that follow.
                        f.seek(member.header_offset)
                        local = f.read(30)
                        start = member.header_offset + 30 + sum(struct.unpack("<HH", local[26:30])) + inner
                        whole = fortran or member.compress_type != zipfile.ZIP_STORED
                        out += self._ranges(info.path, f"{name}/{member.filename.removesuffix('.npy')}", member.filename, start, shape, whole, kind)
        return out

    def read(self, partition: ArrayRange) -> Iterator[pa.RecordBatch]:
        """Batches of one range."""
        p, kind = partition, np.dtype(partition.kind)
        width = int(np.prod(p.shape[1:], dtype=np.int64))
        files, _ = store(self.folder)
        with files.open_input_file(p.path) as f:
            if p.start < 0:
                data = f.read()
                if p.member:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        data = z.read(p.member)
                values = np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)[p.first : p.last]
            else:
                f.seek(p.start + p.first * width * kind.itemsize)
                values = np.frombuffer(f.read((p.last - p.first) * width * kind.itemsize), dtype=kind)
        values = np.ascontiguousarray(values).reshape(p.last - p.first, width)
        step = max(1, BATCH_VALUES // max(width, 1))
        for at in range(0, len(values), step):
            part = values[at : at + step].astype(np.float64)
            n = len(part)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(part.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.name] * n), pa.array(np.arange(n, dtype=np.int64) + p.first + at), pa.array([list(p.shape)] * n, pa.list_(pa.int64())), lists], ["name", "position", "shape", "values"]
            )


@dataclass
class Written(WriterCommitMessage):
    """One task's file."""

    path: str
    rows: int
    width: int
    first: int
    sha256: str


class ArrayWriter(DataSourceArrowWriter):
    """Files under temporary names, named when all are there."""

    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        """One task's file; none for no rows."""
        keys, values, width = [], [], None
        for batch in iterator:
            position, column = batch.column("position"), batch.column("values")
            if not batch.num_rows:
                continue
            sizes = set(column.value_lengths().to_pylist())
            if position.null_count or column.null_count or column.flatten().null_count or len(sizes | ({width} if width is not None else set())) > 1:
                raise ValueError("positions and values are without nulls, and values of one length")
            width = sizes.pop()
            keys.append(position.to_numpy())
            values.append(column.flatten().to_numpy().reshape(-1, width))
        if width is None:
            return None
        buffer = io.BytesIO()
        key, block = np.concatenate(keys).astype(np.int64), np.concatenate(values)
        np.savez(buffer, key=key, values=block)
        files, root = store(self.folder)
        files.create_dir(f"{root}/_writing-{self.job}", recursive=True)
        path = f"{root}/_writing-{self.job}/{uuid.uuid4().hex}.npz"
        with files.open_output_stream(path) as f:
            f.write(buffer.getvalue())
        return Written(path, len(key), int(width), int(key.min()), hashlib.sha256(buffer.getvalue()).hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        """Name the files in the order of their least positions, then list them."""
        files, root = store(self.folder)
        found = sorted((m for m in messages if m is not None), key=lambda m: (m.first, m.path))
        if len({m.width for m in found}) > 1:
            self.abort(messages)
            raise ValueError("values are of different lengths")
        files.create_dir(root, recursive=True)
        entries = []
        for k, m in enumerate(found):
            name = f"part-{k:05d}-{self.job[:8]}"
            files.move(m.path, f"{root}/{name}.npz")
            entries.append({"name": name, "rows": m.rows, "width": m.width, "first": m.first, "sha256": m.sha256})
        old = []
        if files.get_file_info(f"{root}/{MANIFEST}").size:
            with files.open_input_file(f"{root}/{MANIFEST}") as f:
                old = json.loads(f.read())["files"]
        with files.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"files": old + entries}, indent=2, sort_keys=True).encode())
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what was written."""
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, root = store(self.folder)
        if files.get_file_info(f"{root}/_writing-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_writing-{self.job}")


class NpySource(DataSource):
    """format("npy")."""

    @classmethod
    def name(cls) -> str:
        """Name of the format."""
        return "npy"

    def schema(self) -> str:
        """Columns of every file."""
        return SCHEMA

    def reader(self, schema: StructType) -> ArrayReader:
        """A reader of the loaded folder."""
        return ArrayReader(self.options["path"].rstrip("/"), int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        """A writer into the folder; it only adds."""
        if overwrite:
            raise ValueError("arrays are only appended")
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if kinds != {"position": "bigint", "values": "array<double>"}:
            raise ValueError(f"the columns are position long and values array<double>, not {kinds}")
        return ArrayWriter(self.options["path"].rstrip("/"))


def written_rows(spark: SparkSession, folder: str) -> DataFrame:
    """position and values of what was written to a folder: each file's values joined to its keys."""
    spark.dataSource.register(NpySource)
    rows = spark.read.format("npy").load(folder).withColumns({"file": F.regexp_extract("name", "^(.*)/[^/]*$", 1), "member": F.regexp_extract("name", "([^/]*)$", 1)})
    keys = rows.filter("member = 'key'").select("file", F.col("position").alias("row"), F.col("values")[0].cast("long").alias("position"))
    return rows.filter("member = 'values'").select("file", F.col("position").alias("row"), "values").join(keys, ["file", "row"]).select("position", "values")


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, bytes and sha256 of every file of a folder, read by Spark's own file source."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def against_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, rows and state (whole, changed, missing or unlisted) of a written folder's files, by the manifest's hashes."""
    listed = spark.read.option("multiLine", True).schema("files array<struct<name string, rows long, sha256 string>>").json(f"{folder}/{MANIFEST}").select(F.explode("files").alias("f")).select("f.*")
    found = file_digests(spark, folder, "*.npz").withColumn("name", F.regexp_replace("name", "[.]npz$", ""))
    both = listed.alias("a").join(found.alias("b"), "name", "full")
    state = F.when(F.col("b.sha256").isNull(), "missing").when(F.col("a.sha256").isNull(), "unlisted").when(F.col("a.sha256") == F.col("b.sha256"), "whole").otherwise("changed")
    return both.select("name", "rows", state.alias("state"))
