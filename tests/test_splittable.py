"""Matrices and block-compressed lines read by many tasks, against plain readers."""

import gzip
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.sources import bgzf, npy, readers, writers


def blocks_of(data, size, draw=None):
    """The data as gzip members that name their own size, with an empty one at the end."""
    out, at = b"", 0
    while at < len(data):
        step = draw.randint(1, size) if draw else size
        out += member(data[at:at + step])
        at += step
    return out + member(b"")


def member(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, 18 + len(body) + 8 - 1)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


@pytest.mark.parametrize("seed", range(8))
def test_lines_of_all_splits(tmp_path, seed):
    """However a file is cut, each line is read once and in order."""
    draw = random.Random(seed)
    lines = ["".join(draw.choice("abc\x1f\x8b\x08\x04é") for _ in range(draw.choice([0, 1, 5, 60, 700]))) for _ in range(300)]
    text = "\n".join(lines) + draw.choice(["", "\n", "\n\n"])
    data = text.encode()
    packed = blocks_of(data, draw.choice([7, 300, 60_000]), draw)
    path = tmp_path / "lines.gz"
    path.write_bytes(packed)
    assert gzip.decompress(packed) == data
    expected = data.split(b"\n")
    if expected[-1] == b"":
        expected.pop()
    for size in (1, 50, 997, len(packed), 10**9):
        if size == 1 and len(packed) > 20_000:
            continue
        got = []
        with open(path, "rb") as file:
            for at in range(0, len(packed), size):
                got += bgzf.lines_of(file, len(packed), at, min(at + size, len(packed)))
        assert got == expected, size


def test_block_files_by_many_tasks(spark, tmp_path):
    rows = [f"1\t{i}\t.\tA\tC\t.\tPASS\tAF={i / 5000}" for i in range(1, 5000)]
    text = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n" + "\n".join(rows) + "\n"
    (tmp_path / "a.vcf.gz").write_bytes(blocks_of(text.encode(), 2_000))
    (tmp_path / "b.vcf.gz").write_bytes(gzip.compress(text.encode()))
    for name, tasks in (("a.vcf.gz", 6), ("b.vcf.gz", 1)):
        lines = bgzf.read_lines(spark, str(tmp_path / name), split_bytes=4_000)
        assert [r.value for r in lines.orderBy("split", "at").collect()] == text.splitlines()
        assert lines.select(F.spark_partition_id()).distinct().count() >= tasks
    both = bgzf.read_lines(spark, str(tmp_path), split_bytes=4_000)
    assert both.groupBy("file").count().count() == 2 and both.count() == 2 * (len(rows) + 2)
    parsed = readers.parse_vcf(bgzf.read_lines(spark, str(tmp_path / "a.vcf.gz"), split_bytes=3_000).select("value"))
    assert parsed.count() == len(rows)


def test_records_over_many_blocks(spark, tmp_path):
    draw = random.Random(3)
    records = {f"NC_{i}": "".join(draw.choice("ACGT") for _ in range(n)) for i, n in enumerate((3000, 10, 777))}
    text = "".join(f">{k} made\n" + "".join(f"{s[i:i + 60]}\n" for i in range(0, len(s), 60)) for k, s in records.items())
    (tmp_path / "g.fa.gz").write_bytes(blocks_of(text.encode(), 200, draw))
    chunks = readers.read_fasta_blocks(spark, str(tmp_path / "g.fa.gz"), size=100, overlap=20, numbered=False, split_bytes=300).collect()
    for name, seq in records.items():
        own = sorted((c.chunk_start, c.seq) for c in chunks if c.chrom == name)
        assert own == [(at, seq[at:at + 120]) for at in range(0, len(seq), 100)]


@pytest.mark.parametrize("dtype, width", [("<f8", 5), ("<f4", 1), ("<i2", 7), ("|u1", 3)])
def test_matrices_by_many_tasks(spark, tmp_path, dtype, width):
    matrix = np.random.default_rng(1).integers(0, 100, (1000, width)).astype(dtype)
    np.save(tmp_path / "m.npy", matrix)
    found = npy.read_npy(spark, str(tmp_path / "m.npy"), split_bytes=max(64, matrix.nbytes // 9))
    assert found.select(F.spark_partition_id()).distinct().count() >= 9
    assert [r["values"] for r in found.orderBy("ordinal").collect()] == matrix.astype(float).tolist()
    rows = found.withColumn("order", -F.col("ordinal"))
    npy.write_npy(rows, str(tmp_path / "out"), "order", parts=4, dtype=dtype)
    assert len(list((tmp_path / "out").iterdir())) == 4
    again = npy.read_npy(spark, str(tmp_path / "out"))
    assert [r["values"] for r in again.orderBy("ordinal").collect()] == matrix[::-1].astype(float).tolist()


def test_vectors_and_what_is_no_matrix(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(4.0))
    assert [(r.ordinal, r["values"]) for r in npy.read_npy(spark, str(tmp_path / "v.npy")).collect()] == [(i, [float(i)]) for i in range(4)]
    np.save(tmp_path / "e.npy", np.zeros((0, 3)))
    assert npy.read_npy(spark, str(tmp_path / "e.npy")).count() == 0
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((2, 3))))
    with pytest.raises(Exception, match="matrix of numbers"):
        npy.read_npy(spark, str(tmp_path / "f.npy")).count()
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "order int, values array<double>").repartition(1)
    with pytest.raises(Exception, match="differ in length"):
        npy.write_npy(ragged, str(tmp_path / "r"), "order", parts=1)


def scan_metric(df, name):
    """Of the one scan of a plan that has run."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    return node.metrics().apply(name).value()


def test_a_region_opens_few_files_and_row_groups(spark, tmp_path):
    draw = random.Random(4)
    hot = [(i, 3 if draw.random() < 0.7 else draw.randint(1, 12), draw.randint(0, 10**6)) for i in range(60_000)]
    frame = spark.createDataFrame(hot, "id long, chr int, start long").withColumn("end", F.col("start") + 50).withColumn("seq", F.md5(F.col("id").cast("string")))
    writers.write_samples(frame.repartition(8), str(tmp_path / "samples"), parts=10, row_group_bytes=64 << 10)
    files = list((tmp_path / "samples").glob("chr=*/*.parquet"))
    assert len(files) <= 10 + 12 and len(list((tmp_path / "samples").glob("chr=3/*.parquet"))) >= 6
    found = readers.read_samples(spark, str(tmp_path / "samples"), region=(3, 400_000, 405_000))
    expected = {i for i, c, s in hot if c == 3 and s < 405_000 and s + 50 > 400_000}
    assert {r.id for r in found.collect()} == expected and expected
    # All rows of chromosome 3 lie in files of its folder, and only row groups that may hold the region are read.
    assert scan_metric(found, "numOutputRows") < sum(c == 3 for _, c, _ in hot) / 4
    assert readers.read_samples(spark, str(tmp_path / "samples")).count() == len(hot)
