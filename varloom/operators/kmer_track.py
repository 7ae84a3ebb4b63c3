"""Linear k-mer models scored along chunks of a genome by running sums.

A chunk's k-mers are looked up once and their weights added up along the chunk. The score of any window is then the
difference of two entries, and a changed base changes only the k k-mers over it, whatever the window's length. Weights
become whole numbers first, as fine as a chunk's sum allows, so that a difference of two sums is exact and does not
depend on where a chunk begins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from varloom.functions.scores import sigmoid
from varloom.functions.sequence import BASES

_LETTERS = 1 << 20  # letters whose sums are held together; a longer chunk is held alone
_CONTEXTS = 1 << 16  # surroundings of a letter whose effects are held in a table


@dataclass(frozen=True)
class KmerModel:
    """Weights of k-mers for each feature, by the k-mer read as a number; k-mers with other letters add nothing."""

    features: tuple[str, ...]
    alphabet: str
    k: int
    weights: np.ndarray

    @classmethod
    def of(cls, weights: DataFrame, features: Sequence[str], k: int) -> KmerModel:
        """From a column kmer and one column per feature; at most alphabet ** k rows, a null weight counts as 0."""
        rows = weights.select("kmer", *features).collect()
        alphabet = "".join(sorted({c for r in rows for c in r["kmer"]}))
        table = np.zeros((len(features), max(1, len(alphabet)) ** k))
        for r in rows:
            number = 0
            for c in r["kmer"]:
                number = number * len(alphabet) + alphabet.index(c)
            table[:, number] = [r[f] or 0.0 for f in features]
        return cls(tuple(features), alphabet, k, table)

    def fixed(self, letters: int) -> tuple[np.ndarray, float]:
        """The weights as whole numbers of which ``letters`` add up without overflow, and the unit."""
        largest = float(np.abs(self.weights).max(initial=0.0)) or 1.0
        unit = 2.0 ** (np.ceil(np.log2(largest * max(1, letters))) - 61)
        return np.rint(self.weights / unit).astype(np.int64), unit

    def digits(self, letters: np.ndarray) -> np.ndarray:
        """The place of each letter (as bytes) in the alphabet, -1 for others."""
        place = np.full(256, -1, np.int16)
        place[list(self.alphabet.encode())] = np.arange(len(self.alphabet))
        return place[letters]


class Track:
    """Running sums over letters that lie one after the other; windows must not cross from one chunk to the next."""

    def __init__(self, model: KmerModel, letters: np.ndarray):
        self.model, self.digits = model, model.digits(letters)
        self.weights, self.unit = model.fixed(len(letters))

    @cached_property
    def sums(self) -> np.ndarray:
        count = max(0, len(self.digits) - self.model.k + 1)
        numbers = self._numbers(np.arange(count), lambda at: self.digits[at])
        sums = np.zeros((len(self.model.features), count + 1), np.int64)
        np.cumsum(self._weight(numbers), axis=1, out=sums[:, 1:])
        return sums

    def _numbers(self, begins: np.ndarray, digit) -> np.ndarray:
        """The k-mers that begin there as numbers, -1 where a letter is unknown."""
        found, known = np.zeros(begins.shape, np.int64), np.ones(begins.shape, bool)
        for j in range(self.model.k):
            own = digit(begins + j)
            known &= own >= 0
            found = found * len(self.model.alphabet) + own
        return np.where(known, found, -1)

    def _weight(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers >= 0, self.weights[:, np.maximum(numbers, 0)], 0)

    def windows(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Logits (features, windows)."""
        if length < self.model.k:
            return np.zeros((len(self.model.features), len(starts)), np.int64)
        return self.sums[:, starts + (length - self.model.k + 1)] - self.sums[:, starts]

    def changes(
        self, starts: np.ndarray, length: int, centre: int, alternates: np.ndarray, digits: np.ndarray | None = None
    ) -> np.ndarray:
        """What the logits of windows change by when the letter at ``centre`` becomes another (digits, -1 if unknown)."""
        at, k = starts + centre, self.model.k
        digits = self.digits if digits is None else digits
        total = np.zeros((len(self.model.features), len(starts)), np.int64)
        for back in range(k):
            if back > centre or centre - back + k > length:
                continue
            begins = at - back
            for sign, middle in ((1, alternates), (-1, digits[at])):
                total += sign * self._weight(self._numbers(begins, lambda p: np.where(p == at, middle, digits[p])))
        return total

    def effects(self, starts: np.ndarray, length: int, centre: int, alternates: Sequence[int]) -> list[np.ndarray]:
        """For each alternate (a digit) the norm over features of ``changes``.

        The change depends on the k - 1 letters on either side only. Where these surroundings are few, each is looked at once.
        """
        k, size = self.model.k, len(self.model.alphabet) + 1
        span = 2 * k - 1
        count = size**span

        def norms(*where):
            for digit in alternates:
                change = self.real(self.changes(*where[:3], np.full(len(where[0]), digit), *where[3:]))
                yield np.sqrt((change * change).sum(axis=0))

        if count > min(_CONTEXTS, len(starts)) or centre < k - 1 or centre + k > length:
            return [*norms(starts, length, centre)]
        every = np.arange(count)[:, None] // size ** np.arange(span)[::-1] % size - 1
        places = np.zeros(len(self.digits) - span + 1, np.int32)
        for j in range(span):
            places = places * size + (self.digits[j:j + len(places)] + 1)
        own = places[starts + (centre - k + 1)]
        return [table[own] for table in norms(np.arange(count) * span, span, k - 1, every.ravel())]

    def real(self, values: np.ndarray) -> np.ndarray:
        return values * self.unit


def _lists(values: np.ndarray) -> pa.Array:
    """(features, rows) as one list per row."""
    features, rows = values.shape
    return pa.FixedSizeListArray.from_arrays(pa.array(values.T.ravel()), features).cast(pa.list_(pa.float64()))


def letters_of(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of binary values one after the other, and where each value begins."""
    chunks = chunks.cast(pa.large_binary())
    offsets = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset:chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if chunks.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _each(letters: np.ndarray) -> pa.StringArray:
    """Every byte as a string of its own."""
    if letters.max(initial=0) >= 128:
        return pa.array([*letters.tobytes().decode("latin-1")], pa.string())
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(np.arange(len(letters) + 1, dtype=np.int32)), pa.py_buffer(letters.tobytes()))


def letter_spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > _LETTERS:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def score_variants(
    variants: DataFrame, chunks: DataFrame, model: KmerModel, length: int, size: int, overlap: int, zero_based: bool = False,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """``variants`` (chrom, pos, alt, ...) with ref_logits, alt_logits (arrays by feature) and problem, null where there is none.

    The window around a variant has its base at index length // 2. A window that leaves its chromosome, an unknown
    chromosome and an alternate of more than one base are problems, and such rows have no logits. Chunks are sent once
    to where their variants are; those with more than ``hot_rows`` variants are sent to several tasks.
    """
    if length > overlap:
        raise ValueError(f"windows of {length} need chunks that overlap by as much, not {overlap}")
    centre = length // 2
    start = F.col("pos").cast("long") - (0 if zero_based else 1) - centre
    keys = ["chrom", "chunk_id"]
    placed = variants.select(
        F.struct(*[F.col(f"`{c}`") for c in variants.columns]).alias("row"), F.col("chrom"), F.floor(start / size).alias("chunk_id"),
        start.alias("start"), F.col("alt").alias("alt"),
    )
    # As many keys as there are millions of variants, at most.
    hot = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).collect()
    slots, copies = F.lit(0), F.lit(0)
    for key in hot:
        own = F.col("chrom").eqNullSafe(F.lit(key["chrom"])) & F.col("chunk_id").eqNullSafe(F.lit(key["chunk_id"]))
        parts = -(-key["n"] // hot_rows)
        slots = F.when(own, F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).otherwise(slots)
        copies = F.when(own, F.lit(parts - 1)).otherwise(copies)
    sent = chunks.select(
        F.col("chrom"), F.col("chunk_id").cast("long"), F.explode(F.sequence(F.lit(0), copies)).alias("slot"), F.lit(0).alias("kind"),
        F.lit(None).cast(placed.schema["row"].dataType).alias("row"), F.col("chunk_start").cast("long").alias("start"),
        F.lit(None).cast("string").alias("alt"), F.col("seq").cast("binary").alias("seq"), F.col("length").cast("long").alias("length"),
    )
    asked = placed.select(
        "chrom", "chunk_id", slots.alias("slot"), F.lit(1).alias("kind"), "row", "start", "alt",
        F.lit(None).cast("binary").alias("seq"), F.lit(None).cast("long").alias("length"),
    )
    schema = T.StructType([
        T.StructField("row", placed.schema["row"].dataType), T.StructField("ref", T.ArrayType(T.DoubleType())),
        T.StructField("alt", T.ArrayType(T.DoubleType())), T.StructField("known", T.BooleanType()),
    ])
    order = [*keys, "slot", "kind"]
    dealt = sent.unionByName(asked).repartition(*order[:3]).sortWithinPartitions(*order)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the chunk of the next rows
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if last is not None:
                rows = pa.concat_tables([last, rows]).combine_chunks()
            is_chunk = pc.equal(rows["kind"], 0).to_numpy(zero_copy_only=False)
            at_chunk = np.flatnonzero(is_chunk)
            owner = np.cumsum(is_chunk) - 1
            for begin, stop in letter_spans(pc.binary_length(rows["seq"]).to_numpy(zero_copy_only=False)[at_chunk]):
                yield from _scored(rows, at_chunk[begin:stop], np.flatnonzero((owner >= begin) & (owner < stop) & ~is_chunk), owner, begin)
            lost = np.flatnonzero(owner < 0)
            if len(lost):
                yield _unknown(rows, lost)
            if len(at_chunk):
                last = rows.slice(int(at_chunk[-1]), 1)

    def _unknown(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        nothing = pa.nulls(len(at), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays(
            [rows["row"].take(pa.array(at)).combine_chunks(), nothing, nothing, pa.array(np.zeros(len(at), bool))], names=schema.names
        )

    def _scored(rows: pa.Table, at_chunk: np.ndarray, asked: np.ndarray, owner: np.ndarray, begin: int) -> Iterator[pa.RecordBatch]:
        if not len(asked):
            return
        own, wanted = rows.take(pa.array(at_chunk)), rows.take(pa.array(asked))
        letters, offsets = letters_of(own["seq"].combine_chunks())
        place = owner[asked] - begin
        mine = own.select(["chrom", "chunk_id", "start", "length"]).take(pa.array(place))
        same = pc.and_(pc.equal(mine["chrom"], wanted["chrom"]), pc.equal(mine["chunk_id"], wanted["chunk_id"]))
        start = pc.fill_null(wanted["start"], -1).to_numpy()
        known = pc.fill_null(same, False).to_numpy(zero_copy_only=False) & (start >= 0) & (start + length <= mine["length"].to_numpy())
        known &= pc.fill_null(pc.equal(pc.utf8_length(wanted["alt"]), 1), False).to_numpy(zero_copy_only=False)
        good = np.flatnonzero(known)
        if len(good):
            track = Track(model, letters)
            inside = (start - mine["start"].to_numpy() + offsets[place])[good]
            alternates = pc.cast(wanted["alt"].take(pa.array(good)), pa.binary()).combine_chunks()
            first, ends = letters_of(alternates)
            base = np.where(np.diff(ends) == 1, model.digits(first[ends[:-1]]), -1)
            ref = track.windows(inside, length)
            alt = ref + track.changes(inside, length, centre, base)
            yield pa.RecordBatch.from_arrays([
                wanted["row"].take(pa.array(good)).combine_chunks(), _lists(track.real(ref)), _lists(track.real(alt)), pa.array(np.ones(len(good), bool)),
            ], names=schema.names)
        if len(good) < len(asked):
            yield _unknown(wanted, np.flatnonzero(~known))

    site = F.concat_ws(":", F.col("row.chrom").cast("string"), F.col("row.pos").cast("string"))
    problem = F.when(~F.col("known"), F.when(
        F.length("row.alt") != 1, F.concat(F.lit("alternate is not one base: "), F.col("row.alt"))
    ).otherwise(F.concat(F.lit("window leaves its chromosome: "), site)))
    return dealt.mapInArrow(scored, schema).select(
        *[F.col("row").getField(c).alias(c) for c in variants.columns], F.col("ref").alias("ref_logits"), F.col("alt").alias("alt_logits"),
        problem.alias("problem"),
    )


def long_probabilities(scored: DataFrame, features: Sequence[str], key: str = "variant_key") -> DataFrame:
    """Long (key, feature, p_ref, p_alt) of the rows of ``score_variants`` that have no problem."""
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), sigmoid(F.col("ref_logits")[i]).alias("p_ref"), sigmoid(F.col("alt_logits")[i]).alias("p_alt"))
        for i, f in enumerate(features)
    ])
    return scored.filter("problem is null").select(key, F.explode(rows).alias("_r")).select(key, "_r.*")


def saturate(chunks: DataFrame, model: KmerModel, length: int, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Every position of every chromosome with each base in its place: the mutagenesis matrix, and the positions without a window.

    Of (chrom, pos, ref, A, C, G, T) the last four are the norm over features of the change in log odds; the base itself
    has 0. Chunks are scored by themselves, without a shuffle. The second frame is (chrom, pos, ref, problem).
    """
    if length > overlap:
        raise ValueError(f"windows of {length} need chunks that overlap by as much, not {overlap}")
    centre = length // 2
    kind = dict(chunks.dtypes)["chrom"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column("seq")
            for begin, stop in letter_spans(pc.binary_length(seqs).to_numpy()):
                letters, offsets = letters_of(seqs.slice(begin, stop - begin))
                part = batch.slice(begin, stop - begin)
                chunk_start, total = part.column("chunk_start").to_numpy(), part.column("length").to_numpy()
                last = np.minimum(chunk_start + size, total - length + 1) - chunk_start  # windows that begin in the chunk
                counts = np.maximum(last, 0)
                owner = np.repeat(np.arange(stop - begin), counts)
                begins = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                starts = begins + offsets[owner]
                track = Track(model, letters)
                digits = model.digits(np.frombuffer("".join(BASES).encode(), np.uint8)).tolist()
                effects = [pa.array(e) for e in track.effects(starts, length, centre, digits)]
                yield pa.RecordBatch.from_arrays([
                    part.column("chrom").take(pa.array(owner)), pa.array(begins + chunk_start[owner] + centre + 1), _each(letters[starts + centre]), *effects,
                ], names=["chrom", "pos", "ref", *BASES])

    own = chunks.select("chrom", F.col("chunk_start").cast("long").alias("chunk_start"), F.col("seq").cast("binary").alias("seq"), F.col("length").cast("long").alias("length"))
    matrix = own.mapInArrow(scanned, f"chrom {kind}, pos long, ref string, " + ", ".join(f"{b} double" for b in BASES))
    # A chunk's own positions before the first and behind the last window.
    held = F.least(F.lit(size), F.col("length") - F.col("chunk_start"))
    outside = lambda i: (F.col("chunk_start") + i < centre) | (F.col("chunk_start") + i - centre + length > F.col("length"))
    zero = F.col("chunk_start") + F.col("i")
    rejects = own.filter((held > 0) & (outside(F.lit(0)) | outside(held - 1))).withColumn(
        "i", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), held - 1), outside))
    ).select(
        "chrom", (zero + 1).alias("pos"), F.substring("seq", (F.col("i") + 1).cast("int"), F.lit(1)).cast("string").alias("ref"),
        F.concat(F.lit("window leaves its chromosome: "), F.concat_ws(":", F.col("chrom").cast("string"), (zero + 1).cast("string"))).alias("problem"),
    )
    return matrix, rejects


def matrix_totals(matrix: DataFrame) -> DataFrame:
    """The matrix with cumulative, the sum over the bases, and max_effect."""
    total: Column = sum((F.col(b) for b in BASES[1:]), F.col(BASES[0]))
    return matrix.withColumn("cumulative", total).withColumn("max_effect", F.greatest(*BASES))
