"""Lines of block-compressed gzip files, read by many tasks.

Such a file is a chain of small gzip members, and each names its own size in its header, so reading can begin at any of
them. A split begins at the first block behind its offset and reads the lines that begin in its blocks; the last of them may end
in a later block. Files of one ordinary gzip member have no such blocks, and are read by one task as ever.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from varloom.sources.npy import file_system

SPLIT_BYTES = 16 << 20
_LARGEST = 1 << 16  # bytes of a block
_MAGIC = b"\x1f\x8b\x08\x04"
_LINES = 20_000


def block_size(header: bytes) -> int | None:
    """The whole size of the block that begins here, or null if none does."""
    if len(header) < 18 or header[:4] != _MAGIC:
        return None
    extra = struct.unpack_from("<H", header, 10)[0]
    at, end = 12, min(12 + extra, len(header))
    while at + 4 <= end:
        size = struct.unpack_from("<H", header, at + 2)[0]
        if header[at:at + 2] == b"BC" and size == 2 and at + 6 <= len(header):
            return struct.unpack_from("<H", header, at + 4)[0] + 1
        at += 4 + size
    return None


def first_block(file, offset: int, length: int) -> int:
    """Where the first block at or behind ``offset`` begins: a header whose size leads to another header, or to the end."""
    if not offset:
        return 0
    file.seek(offset)
    data = file.read(min(3 * _LARGEST, length - offset))
    at = data.find(_MAGIC)
    while at >= 0:
        size = block_size(data[at:at + 64])
        if size and (offset + at + size == length or block_size(data[at + size:at + size + 64])):
            return offset + at
        at = data.find(_MAGIC, at + 1)
    return length


def inflate(file, offset: int, length: int) -> tuple[bytes, int]:
    """The content of the block at ``offset``, and where the next one begins."""
    file.seek(offset)
    data = file.read(min(_LARGEST, length - offset))
    size = block_size(data[:64])
    if not size or size > len(data):
        raise ValueError(f"no whole block at {offset}")
    return zlib.decompress(data[:size], wbits=31), offset + size


@dataclass
class Blocks(InputPartition):
    path: str
    split: int
    begin: int
    end: int


def lines_of(file, length: int, begin: int, end: int) -> Iterator[bytes]:
    """The lines that begin in blocks at offsets in [begin, end). One that begins right at the first block belongs here only at the
    file's beginning, or if the block before ended with a line; the split before reads on to see."""
    at, stop = first_block(file, begin, length), first_block(file, end, length) if end < length else length
    if at >= stop:
        return
    held, skip = b"", at > 0  # the first piece belongs to the split before, up to its first line end
    while at < stop:
        data, at = inflate(file, at, length)
        held += data
        *whole, held = held.split(b"\n")
        if skip and whole:
            whole, skip = whole[1:], False
        yield from whole
    # The line that goes on in the next split, which will skip up to its first line end: so it is read here even if empty.
    while at < length:
        data, at = inflate(file, at, length)
        head, found, _ = data.partition(b"\n")
        held += head
        if found:
            if not skip:
                yield held
            return
    if held and not skip:
        yield held


class BlockReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def _open(self, path: str | None = None):
        system, own = file_system(self.path)
        return system, path or own

    def partitions(self) -> list[Blocks]:
        system, own = self._open()
        info = system.get_file_info(own)
        listed = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(own)) if f.is_file and f.base_name.endswith((".gz", ".bgz"))]
        found = []
        for file in sorted(listed, key=lambda f: f.path):
            found += [Blocks(file.path, i, at, min(at + self.split_bytes, file.size)) for i, at in enumerate(range(0, file.size, self.split_bytes))]
        return found or [Blocks("", 0, 0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, path = self._open(partition.path)
        length = system.get_file_info(path).size
        with system.open_input_file(path) as file:
            if block_size(file.read(64)):
                lines = lines_of(file, length, partition.begin, partition.end)
            elif partition.split:  # one gzip member: the first split reads it all
                return
            else:
                file.seek(0)
                lines = (line.removesuffix(b"\n") for line in gzip.GzipFile(fileobj=file))
            held, at = [], 0
            for line in lines:
                held.append(line)
                if len(held) == _LINES:
                    yield self._batch(held, partition, at)
                    held, at = [], at + len(held)
            if held:
                yield self._batch(held, partition, at)

    @staticmethod
    def _batch(lines: list[bytes], partition: Blocks, at: int) -> pa.RecordBatch:
        n = len(lines)
        values = pa.array([line.removesuffix(b"\r") for line in lines], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [values, pa.array([partition.path] * n), pa.array([partition.split] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())],
            names=["value", "file", "split", "at"],
        )


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "value string, file string, split long, at long"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(value, file, split, at) of every line; ``at`` counts the lines of a split."""
    spark.dataSource.register(BlockSource)
    return spark.read.format("bgzf").option("path", path).option("splitBytes", str(split_bytes)).load()
