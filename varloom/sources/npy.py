"""Matrices in the npy format as a splittable source and sink.

A file has a short header and then rows of equal size, so a task can read any range of rows by its offset. A folder of such
files is one matrix, in the order of their names; tasks write one file each, and files get their names when all are
written. Paths are opened in the tasks, by any file system that pyarrow knows.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SPLIT_BYTES = 16 << 20
_BATCH_BYTES = 4 << 20


@dataclass
class Header:
    dtype: np.dtype
    shape: tuple[int, ...]
    begin: int  # of the rows

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))

    @property
    def row_bytes(self) -> int:
        return self.width * self.dtype.itemsize


def read_header(file) -> Header:
    version = np.lib.format.read_magic(file)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"npy version {version} is not known")
    shape, by_columns, dtype = read(file)
    if dtype.kind not in "fiub" or not shape or by_columns and len(shape) > 1:
        raise ValueError(f"not a matrix of numbers by rows: {dtype}, {shape}")
    return Header(dtype, shape, file.tell())


@dataclass
class Rows(InputPartition):
    path: str
    first: int  # row of the file
    count: int
    ordinal: int  # of that row in the whole matrix


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; Hadoop writes local ones with a single slash."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    system, own = file_system(path)
    if system.get_file_info(own).type == fs.FileType.Directory:
        listed = system.get_file_info(fs.FileSelector(own))
        return system, sorted(f.path for f in listed if f.is_file and f.base_name.endswith(".npy") and not f.base_name.startswith(("_", ".")))
    return system, [own]


class NpyReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Rows]:
        """Only headers are read here."""
        system, paths = _files(self.path)
        found, ordinal = [], 0
        for path in paths:
            with system.open_input_file(path) as file:
                header = read_header(file)
            rows, each = header.shape[0], max(1, self.split_bytes // max(1, header.row_bytes))
            found += [Rows(path, at, min(each, rows - at), ordinal + at) for at in range(0, rows, each)]
            ordinal += rows
        return found or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = _files(self.path)
        with system.open_input_file(partition.path) as file:
            header = read_header(file)
            each = max(1, _BATCH_BYTES // max(1, header.row_bytes))
            file.seek(header.begin + partition.first * header.row_bytes)
            for at in range(0, partition.count, each):
                rows = min(each, partition.count - at)
                data = file.read(rows * header.row_bytes)
                if len(data) < rows * header.row_bytes:
                    raise ValueError(f"{partition.path} ends before its rows do")
                values = np.frombuffer(data, header.dtype).astype(np.float64)
                offsets = np.arange(rows + 1, dtype=np.int32) * header.width
                ordinals = np.arange(rows) + partition.ordinal + at
                yield pa.RecordBatch.from_arrays([pa.array(ordinals), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["ordinal", "values"])


@dataclass
class Written(WriterCommitMessage):
    path: str
    partition: int
    rows: int


class NpyWriter(DataSourceArrowWriter):
    """A file per task under a hidden name, which the commit step gives its place in the order of partitions."""

    def __init__(self, path: str, dtype: str):
        self.path, self.dtype, self.run = path, dtype, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        partition = TaskContext.get().partitionId()
        system, own = file_system(self.path)
        system.create_dir(own, recursive=True)
        path = posixpath.join(own, f"_{self.run}-{partition:05d}-{uuid.uuid4().hex}")
        # The header needs the number of rows, so rows are held until all are there: one task's share.
        parts, width = [], None
        for batch in batches:
            lists = batch.column("values")
            if lists.null_count or lists.flatten().null_count:
                raise ValueError("null in a matrix")
            sizes = np.unique(lists.value_lengths().to_numpy())
            if len(sizes) > 1 or width is not None and len(sizes) and sizes[0] != width:
                raise ValueError("rows of a matrix differ in length")
            width = int(sizes[0]) if len(sizes) else width
            parts.append(lists.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).reshape(-1, width or 0))
        matrix = np.concatenate(parts) if parts else np.zeros((0, width or 0), self.dtype)
        with system.open_output_stream(path) as file:
            np.lib.format.write_array_header_1_0(file, np.lib.format.header_data_from_array_1_0(matrix))
            file.write(matrix.tobytes())
        return Written(path, partition, len(matrix))

    def commit(self, messages: list[Written]) -> None:
        system, _ = _files(self.path)
        for m in messages:
            if m is not None and m.rows:
                system.move(m.path, posixpath.join(posixpath.dirname(m.path), f"part-{m.partition:05d}.npy"))
            elif m is not None:
                system.delete_file(m.path)

    def abort(self, messages: list[Written]) -> None:
        system, _ = _files(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "ordinal long, values array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], self.options.get("dtype", "<f8"))


def read_npy(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(ordinal, values) of each row of a matrix, read by as many tasks as it has splits."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("path", path).option("splitBytes", str(split_bytes)).load()


def write_npy(df: DataFrame, path: str, order: str, values: str = "values", parts: int | None = None, dtype: str = "<f8") -> None:
    """The rows' arrays as a matrix in ascending ``order``, a file for each range of it; ``path`` must be new."""
    df.sparkSession.dataSource.register(NpySource)
    ranged = df.repartitionByRange(parts, order) if parts else df.repartitionByRange(order)
    rows = ranged.sortWithinPartitions(order).select(F.lit(None).cast("long").alias("ordinal"), F.col(values).cast("array<double>").alias("values"))
    rows.write.format("npy").option("path", path).option("dtype", dtype).mode("append").save()
