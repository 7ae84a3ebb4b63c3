"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be altered by k = rate * m edits. Split in k + 1 pieces, at least one piece is left
untouched wherever the item occurs. An automaton finds all exact piece hits in one pass over a document. The pieces are
the leaves of a tree whose parts halve both item and budget (a + b = k - 1: one half keeps within its share), so a
hit is verified upwards: Myers' bit-parallel distance of the next larger part first, of the whole item last. Most chance hits
end after a few characters, and none that lies inside an occurrence is lost.

Both sides are compared as words: lower case, everything but letters and digits counts as one space. An item too short
for an edit is found where it stands as whole words; scripts that write no spaces have no such borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from varloom.llm.common import free_name, stored
from varloom.llm.words import give_back

RATE = 0.1
BLOCK_CHARACTERS = 4 << 20

_BETWEEN_WORDS = re.compile(r"[\W_]+")
_WORDS = re.compile(r"[^\W_]+")
_NO_SPACES = "\u0e00"  # from Thai on, most scripts write no space between words
_HITS = "array<struct<item:long, start:long, end:long, distance:int>>"


def plain(text: str | None) -> str:
    return _BETWEEN_WORDS.sub(" ", text).strip().lower() if text else ""


def stands_alone(text: str, begin: int, end: int) -> bool:
    """Whether no word goes on beyond the ends of this part of a plain text, as far as its script tells words apart."""
    joined = lambda a, b: a != " " and b != " " and a < _NO_SPACES and b < _NO_SPACES
    return not (begin > 0 and joined(text[begin - 1], text[begin])) and not (end < len(text) and joined(text[end - 1], text[end]))


def rows_by_character(pattern: str) -> dict[str, int]:
    """For each character the set of its places in ``pattern``, as bits."""
    rows: dict[str, int] = {}
    for i, c in enumerate(pattern):
        rows[c] = rows.get(c, 0) | 1 << i
    return rows


def best_match(rows_of: dict[str, int], size: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of a pattern to any substring of ``text``, and where the first such substring ends.

    ``anchored``: the substring begins where the text does. One column of the distance table is two bit vectors: rows where
    the next value is larger by one, and rows where it is smaller.
    """
    last_row, all_rows = 1 << (size - 1), (1 << size) - 1
    rises, falls, distance = all_rows, 0, size
    best, end = size, 0
    first_row = 1 if anchored else 0
    for place, c in enumerate(text, 1):
        equal = rows_of.get(c, 0)
        free = (((equal & rises) + rises) ^ rises | equal) & all_rows
        right_rises = falls | all_rows & ~(free | rises)
        right_falls = rises & free
        if right_rises & last_row:
            distance += 1
        elif right_falls & last_row:
            distance -= 1
            if distance < best:
                best, end = distance, place
        right_rises = right_rises << 1 & all_rows | first_row
        right_falls = right_falls << 1 & all_rows
        held = equal | falls
        rises = right_falls | all_rows & ~(held | right_rises)
        falls = right_rises & held
    return best, end


class Part:
    """A part of an item with its share of the budget; ``whole`` is the part it is a half of."""

    def __init__(self, text: str, budget: int, start: int = 0, whole: Part | None = None):
        self.text, self.budget, self.start, self.whole = text, budget, start, whole
        self.rows_of = rows_by_character(text) if budget else {}

    def pieces(self) -> Iterator[Part]:
        if not self.budget:
            yield self
            return
        left = (self.budget - 1) // 2
        right = self.budget - 1 - left
        cut = len(self.text) * (left + 1) // (self.budget + 1)
        yield from Part(self.text[:cut], left, self.start, self).pieces()
        yield from Part(self.text[cut:], right, self.start + cut, self).pieces()

    def window(self, item_start: int) -> tuple[int, int]:
        """Where the part lies in a text in which the item would begin at ``item_start`` without edits."""
        start = item_start + self.start - self.budget
        return max(0, start), start + len(self.text) + 2 * self.budget


class Matcher:
    """Finds all items of a block in a text."""

    def __init__(self, items: Sequence[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(key, Part(text, int(rate * len(text)))) for key, text in items]
        pieces: dict[str, list[tuple[int, Part]]] = {}
        for number, (_, item) in enumerate(self.items):
            for piece in item.pieces():
                pieces.setdefault(piece.text, []).append((number, piece))
        self.automaton = ahocorasick.Automaton()
        for text, places in pieces.items():
            self.automaton.add_word(text, places)
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(key, start, end, distance) of the first best place of every item that occurs; offsets by whole words of ``text``."""
        own = plain(text)
        if not self.items or not own:
            return []
        read: dict[int, tuple[float, float]] = {}  # where an item was found, as far as looked at
        best: dict[int, tuple[int, int]] = {}
        for last, places in self.automaton.iter(own):
            for number, piece in places:
                item_start = last + 1 - len(piece.text) - piece.start
                item = self.items[number][1]
                if not item.budget and not stands_alone(own, item_start, last + 1):
                    continue
                start, stop = item.window(item_start)
                seen = read.get(number)
                if seen and seen[0] <= start and stop <= seen[1]:
                    continue
                part = piece
                while part is not None:
                    start, stop = part.window(item_start)
                    distance, end = best_match(part.rows_of, len(part.text), own[start:stop]) if part.budget else (0, 0)
                    if distance > part.budget:
                        break
                    if part is item:
                        end = start + end if part.budget else last + 1
                        if number not in best or distance < best[number][0]:
                            best[number] = (distance, end)
                        read[number] = (start, stop) if distance else (float("-inf"), float("inf"))  # none is better than 0
                    part = part.whole
        found = []
        for number, (distance, end) in best.items():
            key, item = self.items[number]
            behind = own[max(0, end - len(item.text) - item.budget):end][::-1]
            begin = end - best_match(rows_by_character(item.text[::-1]), len(item.text), behind, anchored=True)[1]
            found.append((key, *self._original(text, own, begin, end), distance))
        return found

    @staticmethod
    def _original(text: str, own: str, begin: int, end: int) -> tuple[int, int]:
        first, last = own.count(" ", 0, begin + (own[begin:begin + 1] == " ")), own.count(" ", 0, max(begin, end - 1))
        start = stop = 0
        for i, word in enumerate(_WORDS.finditer(text)):
            if i == first:
                start = word.start()
            if i >= last:
                stop = word.end()
                break
        return start, stop


def test_items(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(key, plain, item_id, n_items): each distinct plain text once, with its smallest id."""

    @F.pandas_udf("string")
    def plainly(texts: pd.Series) -> pd.Series:
        return texts.map(plain, na_action=None)

    own = benchmark.select(F.col(item_id).alias("item_id"), plainly(F.col(text)).alias("plain"))
    return own.filter("plain != ''").groupBy("plain").agg(
        F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items")
    ).withColumn("key", F.xxhash64("plain"))


def blocks(items: DataFrame, block_characters: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_characters``, each of which a broadcast may hold."""
    total = items.agg(F.sum(F.length("plain"))).first()[0] or 0
    count = max(1, -(-total // block_characters))
    for block in range(count):
        rows = items.filter(F.pmod(F.xxhash64("key"), F.lit(count)) == block).select("key", "plain").collect()
        if rows:
            yield sorted((r[0], r[1]) for r in rows)


def _hits(sent: Broadcast, rate: float, text: Column) -> Column:
    @F.pandas_udf(_HITS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, rate)
        for texts in batches:
            yield pd.Series([[dict(zip(("item", "start", "end", "distance"), h)) for h in matcher.find(t)] for t in texts])
        del matcher
        give_back()

    return found(text)


def _held(df: DataFrame) -> DataFrame:
    """``df``, computed before anything else is."""
    return stored(df, "decontaminated")


def find_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
    item_id: str = "item_id", rate: float = RATE, block_characters: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """(doc_id, item_id, n_items, start, end, distance): every test item that a document holds within its edit budget.

    - Of items with the same plain text the smallest id stands for all ``n_items``; start and end are the offsets of
      the first best place in the document's text, from word to word.
    - Every item with a letter or digit is searched; one too short for an edit, under ten characters, must stand as whole words.
    - Null or empty texts on either side match nothing; null ids are kept; repeated documents give repeated rows; empty
      tables give none. Other columns of ``docs``, whatever their names, play no part.
    - Documents of any length are searched whole. A large benchmark is searched in blocks one after the other, one pass
      over the documents each, so that one block's automaton is held at a time.
    """
    items = test_items(benchmark, item_text, item_id)
    context = docs.sparkSession.sparkContext
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    result = last = None
    for block in blocks(items, block_characters):
        if last is not None:
            last = _held(last)
            result = last if result is None else result.unionByName(last)
        last = own.select("doc_id", F.explode(_hits(context.broadcast(block), rate, F.col("text"))).alias("hit"))
    if last is not None:
        result = last if result is None else result.unionByName(last)
    if result is None:
        result = own.select("doc_id", F.explode(F.lit(None).cast(_HITS)).alias("hit"))
    return result.alias("h").join(items.alias("i"), F.col("h.hit.item") == F.col("i.key")).select(
        "h.doc_id", "i.item_id", "i.n_items", "h.hit.start", "h.hit.end", "h.hit.distance"
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
    rate: float = RATE, block_characters: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """``docs`` without the rows that hold a test item; cases as in ``find_items``."""
    items = test_items(benchmark, item_text, item_id)
    context = docs.sparkSession.sparkContext
    done = 0
    for block in blocks(items, block_characters):
        if done:  # rows that are left go on to the next block
            docs = _held(docs)
        done += 1
        held = free_name(docs.columns, "hits")
        docs = docs.withColumn(held, _hits(context.broadcast(block), rate, F.col(text))).filter(F.size(held) == 0).drop(held)
    return docs
