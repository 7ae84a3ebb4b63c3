"""Token ids as Parquet list columns: dictionary or delta encoded, with set row groups, pages and page indexes.

One row per document: doc_id, shard, position, n_tokens, ids. Rows lie in ascending doc_id order over all shards (a shard is a
range of ids and one file), so a reader of some documents touches few row groups and pages, and a reader of the
metadata touches none of the ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from varloom.llm.words import give_back

MEMO_ENTRIES = 60_000
GROUP_BYTES = 16 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
_AT_ONCE = 5_000  # words whose tokens are held as objects

# Every code point that either Unicode or Python counts as white space, but for the plain space. Fixed values.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def split_at_spaces(text: str) -> list[str]:
    """Parts of ``text`` between those plain spaces that have no other white space on either side.

    A byte-level tokenizer starts a new piece at each such space, whatever stands around it: the ids of the text are
    the ids of the first part and of a space plus each further part. Other spaces stay inside a part. Only the first
    part can be empty.
    """
    parts = text.split(" ")
    if "" in parts or any(c in text and (c + " " in text or " " + c in text) for c in _SPACES):
        joined, parts = parts, [parts[0]]
        for part in joined[1:]:
            before = parts[-1]
            if part and before and not part[0].isspace() and not before[-1].isspace():
                parts.append(part)
            else:
                parts[-1] = before + " " + part
    return parts


_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_AFTER_WORDS = '.,;:!?)"'
_WORD = re.compile(rf"( ?[{_LETTERS}]+)([{re.escape(_AFTER_WORDS)}]*)")
# A space or line end beside other white space, or at either end of a text.
_ODD_SPACE = f"[ {_SPACES}][ \n]|[ \n][{_SPACES}]|^[ \n]|[ \n]$"
_LETTER_RUN = re.compile(rf" ?[{_LETTERS}]+")
_RUNS = re.compile(r" ?[^\W\d_]+|[\W\d_]+")
# Byte-level models write bytes as letters: printable ones as they are, the others counted from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {chr(b): chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_token_id = attrgetter("id")
_LATIN = "\u0250"  # letters below are letters to every Unicode version


def split_at_letters(part: str) -> list[str]:
    """A part of ``split_at_spaces`` cut where letters meet other characters, and at single line ends.

    A byte-level tokenizer cuts there too. What could be cut otherwise is left whole: apostrophes (contractions are pieces
    of their own), longer white space, and scripts beyond Latin.
    """
    word = _WORD.fullmatch(part)
    if word:
        return [word[1], word[2]] if word[2] else [part]
    if "'" in part or max(part, default="") >= _LATIN:
        return [part]
    runs = []
    for i, line in enumerate(part.split("\n")):
        inner = line if i else line.removeprefix(" ")
        if not inner or inner.split() != [inner]:
            return [part]
        if i:
            runs.append("\n")
        runs += _RUNS.findall(line)
    return runs


def _as_byte_letters(words: list[str]) -> list[str]:
    """Words without line ends in the letters of a byte-level model; all at once, as each replacement is one pass over them."""
    joined = "\n".join(words)
    if not joined.isascii():
        joined = joined.encode().decode("latin-1")
    for byte, letter in _BYTE_LETTERS.items():
        if byte != "\n":
            joined = joined.replace(byte, letter)
    return joined.split("\n")


def _strings(array: pa.StringArray) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _lists(pieces: list[bytes]) -> pa.LargeListArray:
    """Ids as bytes to lists of ids."""
    return pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *map(len, pieces)]) // 4), pa.array(np.frombuffer(b"".join(pieces), "<u4")))


class Encoder:
    """Whole texts to ids.

    Texts are cut where a byte-level tokenizer cuts them anyway. Each distinct part of a group of texts is looked at once, each
    distinct run goes to the tokenizer's model unless it is remembered, and arrays of ids are put together without a
    loop over parts. A tokenizer of another kind gets whole texts.
    """

    def __init__(self, tokenizer_file: str, end_id: int, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.end = np.array([end_id], "<u4").tobytes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        described = json.loads(self.tokenizer.to_str())
        cuts = described["pre_tokenizer"] or {}
        self.by_part = (
            cuts.get("type") == "ByteLevel" and cuts.get("use_regex") and not cuts.get("add_prefix_space")
            and described["normalizer"] is None
        )
        self.model = self.tokenizer.model
        self.memo_entries = memo_entries
        self.runs: dict[str, bytes] = {}  # in the order they were met, so that frequent ones are among the first

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _pieces(self, words: list[str]) -> list[bytes]:
        """The ids of letters, with or without a space before them: one piece each, which the model can have without the cutting."""
        runs = self.runs
        found = [runs.get(w) for w in words]
        new = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(new), _AT_ONCE):
            part = new[at:at + _AT_ONCE]
            fresh = [words[i] for i in part]
            tokens = [*map(self.model.tokenize, _as_byte_letters(fresh))]
            flat = np.fromiter(map(_token_id, chain.from_iterable(tokens)), "<u4").tobytes()
            ends = np.cumsum([0, *map(len, tokens)]) * 4
            made = [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
            runs.update(zip(fresh, made))
            for i, ids in zip(part, made):
                found[i] = ids
        return found

    def _forget(self) -> None:
        """Keep the runs that were met first, between two groups of texts."""
        if len(self.runs) > self.memo_entries:
            self.runs = dict(islice(self.runs.items(), self.memo_entries))

    def _cut(self, part: str) -> list[str]:
        return [part] if any(t in part for t in self.special) else split_at_letters(part)

    def _parts(self, parts: list[str]) -> list[bytes]:
        cuts = [self._cut(p) for p in parts]
        runs = set().union(*cuts).difference(self.runs)
        letters = [r for r in runs if _LETTER_RUN.fullmatch(r)]
        self._pieces(letters)
        for run in runs.difference(letters):
            self.runs[run] = self._whole(run)
        return [b"".join([self.runs[r] for r in runs]) for runs in cuts]

    def _text(self, text: str) -> bytes:
        """Any text, part by part."""
        if any(" " in t and t in text for t in self.special):  # such a token could lie across parts
            return self._whole(text)
        first, *more = split_at_spaces(text)
        return b"".join(self._parts([first, *[" " + p for p in more]]))

    def _distinct(self, parts: pa.StringArray) -> pa.LargeListArray:
        """The ids of each part, which stands behind a space or begins with a line end.

        A word and what follows it are two pieces; any other part is cut with care and is one, with nothing behind it.
        """
        after_line = pc.starts_with(parts, "\n")
        body = pc.if_else(after_line, pc.utf8_slice_codeunits(parts, 1), parts)
        stems = pc.utf8_rtrim(body, characters=_AFTER_WORDS)
        is_word = pc.match_substring_regex(stems, f"^[{_LETTERS}]+$")
        spaced = pc.binary_join_element_wise(pc.if_else(after_line, "", " "), stems, "")
        words = spaced.filter(is_word).dictionary_encode()
        known = self._pieces(_strings(words.dictionary))
        # A line end alone is a piece of its own.
        line, = self._parts(["\n"])
        nothing = len(known)
        pieces = [*known, b""]
        first, second = np.full(len(parts), nothing, np.int64), np.full(len(parts), nothing, np.int64)
        word_at = np.flatnonzero(is_word.to_numpy(zero_copy_only=False))
        first[word_at] = words.indices.to_numpy()
        rest_sizes = (pc.binary_length(body).to_numpy() - pc.binary_length(stems).to_numpy())[word_at]
        with_rest = word_at[rest_sizes > 0]
        rests = pc.extract_regex(body.take(pa.array(with_rest)), f"(?P<rest>[{re.escape(_AFTER_WORDS)}]+)$").field("rest").dictionary_encode()
        second[with_rest] = len(pieces) + rests.indices.to_numpy()
        pieces += self._parts(_strings(rests.dictionary))
        lines = after_line.to_numpy(zero_copy_only=False)
        # The line end goes before the word: it takes the first place, and the word with its rest the second.
        both = np.flatnonzero(lines & is_word.to_numpy(zero_copy_only=False))
        for at in both.tolist():
            first[at], second[at], joined = len(pieces), nothing, pieces[first[at]] + pieces[second[at]]
            pieces.append(line + joined)
        other_at = np.flatnonzero(~is_word.to_numpy(zero_copy_only=False))
        others = [t if t[:1] == "\n" else " " + t for t in _strings(parts.take(pa.array(other_at)))]
        first[other_at] = len(pieces) + np.arange(len(others))
        pieces += self._parts(others)
        both = _lists(pieces).take(pa.array(np.stack([first, second], axis=1).ravel()))
        return pa.LargeListArray.from_arrays(both.offsets[::2], both.values)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's ids followed by the end id; and the number of ids of each text."""
        if not self.by_part:
            found = [self._whole(t) + self.end for t in texts.to_pylist()]
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        # A line end between other characters than spaces is cut like a space; it stays at the beginning of what follows.
        split = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        flat, borders = split.flatten(), np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])
        parts = flat.dictionary_encode()
        # The first part of a text has no space before it; an odd text is one part as a whole.
        firsts = self._parts(_strings(flat.take(pa.array(borders[:-1]))))
        for i in odd_at:
            firsts[i] = self._text(texts[i].as_py())
        del split, flat
        known = self._distinct(parts.dictionary)
        self._forget()
        codes = parts.indices.to_numpy().copy()
        del parts
        codes[borders[:-1]] = len(known) + np.arange(len(firsts))
        codes = np.insert(codes, borders[1:], len(known) + len(firsts))
        found = pa.concat_arrays([known, _lists([*firsts, self.end])]).take(pa.array(codes))
        last = borders[1:] + np.arange(len(firsts))  # where the ends of the texts are among the codes
        ends = found.offsets.to_numpy()[last + 1]
        return found.flatten().to_numpy(), np.diff(np.concatenate([[0], ends]))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(tokenizer_file: str, end_id: int) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    key = (tokenizer_file, end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_file, end_id)
    return _ENCODERS[key]


def _groups(texts: pa.StringArray, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes."""
    start = held = 0
    for i, length in enumerate(pc.binary_length(texts).to_pylist()):
        held += length
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_rows(docs: DataFrame, tokenizer_file: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, shard, position, n_tokens, ids) in ascending id order, null ids first, repeats next to each other."""
    content = F.coalesce(F.col(text), F.lit(""))
    dealt = (
        docs.select(F.col(doc_id).alias("doc_id"), content.alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
        .withColumn("shard", F.spark_partition_id())
    )
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, position = encoder_of(tokenizer_file, end_id), 0
        for batch in batches:
            for start, stop in _groups(batch.column("text")):
                ids, lengths = encoder.encode(batch.column("text").slice(start, stop - start))
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                rows = stop - start
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, rows), batch.column("shard").slice(start, rows),
                    pa.array(np.arange(position, position + rows)), pa.array(lengths),
                    pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32))),
                ], names=["doc_id", "shard", "position", "n_tokens", "ids"])
                position += rows
        give_back()

    id_type = docs.schema[doc_id].dataType.simpleString()
    return dealt.mapInArrow(encoded, f"doc_id {id_type}, shard int, position long, n_tokens long, ids array<int>")


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, encoding: str = "dictionary", text: str = "text",
    doc_id: str = "doc_id", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode whole texts and write them to ``path`` in ascending id order.

    - A null or empty text is the end id alone. A null id comes first. Rows that repeat an id follow each other, ordered
      by text.
    - An empty table writes files without rows. Other columns of ``docs`` are not written.
    - ``encoding`` is ``dictionary`` or ``delta`` (binary packed differences).
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    encode_rows(docs, tokenizer_file, end_id, text, doc_id).write.options(**{
        "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows), "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "PARQUET_2_0", "parquet.columnindex.truncate.length": "64", "compression": "zstd",
    }).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, position, n_tokens, start) without reading any ids; start counts the ids of all rows before."""
    return _with_start(spark, path, spark.read.parquet(path).select("doc_id", "shard", "position", "n_tokens"))


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Rows of the files, or of an id range only: the range prunes files, row groups and pages."""
    rows = spark.read.parquet(path)
    if first_id is not None:
        rows = rows.filter(F.col("doc_id") >= first_id)
    return rows if last_id is None else rows.filter(F.col("doc_id") <= last_id)


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    inside = W.partitionBy("shard").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    # Totals come from the files' counts, so that the ids are read once.
    shards = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("_total")).select(
        "shard", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        rows.join(shards, "shard")
        .withColumn("start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("_before")
    )


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, position, n_tokens, start, ids_crc32), all from the ids in the files."""
    rows = spark.read.parquet(path).select("doc_id", "shard", "position", "ids")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.cumsum(np.array(lists.value_lengths(), np.int64))
            starts = np.concatenate([[0], ends[:-1]])
            sums = [zlib.crc32(values[a:b]) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("doc_id", "shard", "position")],
                pa.array(ends - starts), pa.array(sums, pa.int64()),
            ], names=["doc_id", "shard", "position", "n_tokens", "ids_crc32"])
        give_back()

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return _with_start(
        spark, path, rows.mapInArrow(summed, f"doc_id {id_type}, shard int, position long, n_tokens long, ids_crc32 long")
    )
