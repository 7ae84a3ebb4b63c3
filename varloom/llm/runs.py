"""Periodic runs of words, found by suffix trees.

A run is a stretch of consecutive words with smallest period q that no neighbour extends, q words apart being the same.
For either order of the words (and with the end of the text first in both), the longest Lyndon word that starts at each
place ends before the next smaller suffix; the Lyndon roots of all runs are among these words. A root is extended to the
right by the longest common extension of its two ends in the text and to the left by the one in the reversed text. Both
are depths of lowest common ancestors in Ukkonen's suffix tree, looked up in constant time on its Euler tour.

Trees are built only where a run can be. In a run of period q and length L, every sequence of g words (three, fewer for very
short runs) that begins after the first q words has occurred at most q words before, at L - q - g + 1 places in succession.
Stretches of a text where this holds for no q hold no run, so they are left out; a run is always inside one stretch as a whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from varloom.llm.common import free_name

MIN_LENGTH = 6
MIN_EXPONENT = 4
_GRAM = 3
_WORDS_PER_SPAN = 400_000  # words of short texts looked at together; a longer text is looked at alone
_NEVER = np.iinfo(np.int64).max

_RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])
FOUND = StructType([StructField("n_words", LongType()), StructField("runs", ArrayType(_RUN)), StructField("collapsed", StringType())])


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (positive numbers) and an end mark, 0, which is smaller than all of them."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        self.size = size = len(text)
        start, end, link, suffix = [0], [0], [0], [-1]
        child: list[dict | None] = [{}]
        node = edge = length = waiting = 0  # where the longest repeated suffix ends, and suffixes not yet in the tree
        for at, symbol in enumerate(text):
            unlinked = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = at
                kids = child[node]
                below = kids.get(text[edge])
                if below is None:
                    kids[text[edge]] = len(start)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    begin = start[below]
                    span = end[below] - begin
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if text[begin + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    inner = len(start)
                    kids[text[edge]] = inner
                    start.append(begin)
                    end.append(begin + length)
                    link.append(0)
                    suffix.append(-1)
                    start[below] = begin + length
                    child.append({symbol: inner + 1, text[begin + length]: below})
                    if unlinked:
                        link[unlinked] = inner
                    unlinked = inner
                start.append(at)
                end.append(size)
                link.append(0)
                suffix.append(at - waiting + 1)
                child.append(None)
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - waiting + 1
        self._start, self._end, self._suffix, self._child = start, end, suffix, child

    def _walk(self, falling: bool) -> tuple[list[int], list[int]]:
        """Nodes as a depth-first walk meets them, smaller symbols first (or larger, but the end mark first), and their parents' depths."""
        start, end, child = self._start, self._end, self._child
        depth, above, met, waiting = [0] * len(start), [0] * len(start), [], [0]
        while waiting:
            node = waiting.pop()
            met.append(node)
            kids = child[node]
            if kids:
                own = depth[node]
                symbols = sorted(kids, reverse=not falling)
                if falling and not symbols[0]:
                    symbols.append(symbols.pop(0))
                for symbol in symbols:  # the last is met first
                    below = kids[symbol]
                    depth[below] = own + end[below] - start[below]
                    above[below] = own
                    waiting.append(below)
        return met, above

    def order(self, falling: bool = False) -> np.ndarray:
        """The rank of each suffix."""
        met, _ = self._walk(falling)
        places = np.array(self._suffix)[met]
        ranks = np.empty(self.size, np.int64)
        ranks[places[places >= 0]] = np.arange(self.size)
        return ranks

    def prepare(self) -> np.ndarray:
        """Make ``extension`` ready; the ranks of the suffixes.

        Of the Euler tour only the entries from which the walk goes down are kept: they hold every lowest common
        ancestor, and the least depth between two leaves is that of theirs.
        """
        met, above = self._walk(False)
        places = np.array(self._suffix)[met]
        leaves = np.flatnonzero(places >= 0)
        self._first = np.empty(self.size, np.int64)
        self._first[places[leaves]] = leaves
        ranks = np.empty(self.size, np.int64)
        ranks[places[leaves]] = np.arange(self.size)
        self._least = [np.array(above, np.int32)[met]]
        step = 1
        while 2 * step <= len(met):
            last = self._least[-1]
            self._least.append(np.minimum(last[:-step], last[step:]))
            step *= 2
        return ranks

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of symbols that the suffixes at ``a`` and ``b``, which differ, have in common."""
        x, y = self._first[a], self._first[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            found[at] = np.minimum(self._least[k][low[at]], self._least[k][high[at] - (1 << k) + 1])
        return found


def _next_smaller(ranks: list[int]) -> list[int]:
    """For each place the first later one of a smaller rank; the last place has the smallest."""
    size = len(ranks)
    found = [size] * size
    for at in range(size - 2, -1, -1):
        later, own = at + 1, ranks[at]
        while ranks[later] > own:
            later = found[later]
        found[at] = later
    return found


def runs_of(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``symbols`` (positive numbers), by start, then period."""
    size = len(symbols)
    if size < max(min_length, 2):
        return np.zeros((0, 3), np.int64)
    text = symbols.tolist()
    tree = SuffixTree(text)
    ends = [_next_smaller(ranks.tolist())[:size] for ranks in (tree.prepare(), tree.order(falling=True))]
    place = np.concatenate([np.arange(size)] * 2)
    end = np.concatenate([np.array(e) for e in ends])
    period = end - place
    near = period * min_exponent <= size
    place, end, period = place[near], end[near], period[near]
    right = tree.extension(place, end)
    del tree
    back = SuffixTree(text[::-1])
    back.prepare()
    left = back.extension(size - place, size - end)
    length = period + left + right
    long = length >= np.maximum(min_length, min_exponent * period)
    rows = np.stack([(place - left)[long], length[long], period[long]], axis=1)
    return np.unique(rows[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def possible_stretches(symbols: np.ndarray, ends: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of disjoint stretches of the texts, put one after the other and ending at ``ends``, that hold all runs as a whole."""
    size = len(symbols)
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = min(_GRAM, *[max(min_length, min_exponent * q) - q for q in range(1, _GRAM + 1)])
    if size < width:
        return nothing
    # Equal sequences have equal numbers; where these get too large, ranks of shorter sequences take their place.
    base = int(symbols.max()) + 1
    if base ** width < 2**63:
        grams = sum(symbols[at:size - width + 1 + at] * base ** (width - 1 - at) for at in range(width))
    else:
        grams = symbols
        for more in range(1, width):
            _, grams = np.unique(grams[:size - more] * base + symbols[more:], return_inverse=True)
    starts = np.concatenate([[0], ends[:-1]])
    text_of = np.repeat(np.arange(len(ends)), ends - starts)
    inside = text_of[width - 1:] == text_of[:size - width + 1]  # not a sequence of two texts
    # Most sequences are alone in their text, and a table of counts by hash tells most of them.
    bits = max(10, size.bit_length() + 3)
    hashed = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + text_of[:len(grams)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)
    hashed = hashed.astype(np.int64)
    held = np.flatnonzero(inside & (np.bincount(hashed, minlength=1 << bits)[hashed] > 1))
    order = held[np.argsort(grams[held], kind="stable")]
    same = (grams[order[1:]] == grams[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
    later = order[1:][same]
    gap = np.full(size, _NEVER)
    gap[later] = later - order[:-1][same]
    again = np.flatnonzero(gap != _NEVER)
    found, longest = [], int((ends - starts).max())
    reach = 1  # for periods in (reach / 2, reach]
    while (reach // 2 + 1) * min_exponent <= longest and len(again):
        least = reach // 2 + 1
        places = again[gap[again] <= reach]
        if len(places):
            cuts = np.flatnonzero((np.diff(places) != 1) | (np.diff(text_of[places]) != 0)) + 1
            first, last = places[np.concatenate([[0], cuts])], places[np.concatenate([cuts - 1, [len(places) - 1]])]
            enough = last - first + 1 >= max(min_length, min_exponent * least) - least - width + 1
            first, last = first[enough], last[enough]
            text = text_of[first]
            found.append(np.stack([np.maximum(starts[text], first - reach), np.minimum(ends[text], last + width)], axis=1))
        reach *= 2
    spans = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if not len(spans):
        return nothing
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reached = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] >= reached[:-1]])
    return spans[new, 0], np.concatenate([reached[:-1][new[1:]], reached[-1:]])


def _spans(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, some texts at a time."""
    held, size = [], 0
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if held and size + len(words) > _WORDS_PER_SPAN:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def search(texts: list[str | None], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> Iterator[tuple[int, list[tuple[int, int, int]], str | None]]:
    """(number of words, runs, text without repeated periods) of each text."""
    at = 0
    for span in _spans(texts):
        numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        symbols = np.array([numbers[w] for words in span for w in words], np.int64)
        ends = np.cumsum([len(words) for words in span])
        begins = ends - [len(words) for words in span]
        runs: dict[int, list[np.ndarray]] = defaultdict(list)
        for start, end in zip(*(x.tolist() for x in possible_stretches(symbols, ends, min_length, min_exponent))):
            _, own = np.unique(symbols[start:end], return_inverse=True)
            got = runs_of(own + 1, min_length, min_exponent)
            if len(got):
                text = int(np.searchsorted(ends, start, side="right"))
                runs[text].append(got + [start - int(begins[text]), 0, 0])
        for text, words in enumerate(span):
            rows = np.concatenate(runs[text]) if text in runs else None
            kept = words
            if rows is not None:
                inside = np.zeros(len(words) + 1, np.int64)
                np.add.at(inside, rows[:, 0] + rows[:, 2], 1)
                np.add.at(inside, rows[:, 0] + rows[:, 1], -1)
                kept = [w for w, gone in zip(words, np.cumsum(inside).tolist()) if not gone]
            collapsed = None if texts[at] is None else b" ".join(kept).decode("utf-8", "surrogatepass")
            yield len(words), [] if rows is None else [tuple(r) for r in rows.tolist()], collapsed
            at += 1


def _runs_column(text: Column, min_length: int, min_exponent: int) -> Column:
    @F.arrow_udf(FOUND)
    def found(values: pa.Array) -> pa.Array:
        sizes, offsets, runs, texts = [], [0], [], []
        for n, own, collapsed in search(values.to_pylist(), min_length, min_exponent):
            sizes.append(n)
            runs += own
            offsets.append(len(runs))
            texts.append(collapsed)
        columns = np.array(runs, np.int64).reshape(-1, 3).T
        fields = [pa.field(f.name, pa.int64(), False) for f in _RUN]
        rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=fields)
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), listed, pa.array(texts, pa.string())], names=["n_words", "runs", "collapsed"])

    return found(text)


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """All rows and columns of ``docs`` plus n_words, runs (start, length, period; by start, then period) and collapsed.

    Runs have ``min_length`` words and ``min_exponent`` periods at least (two or more). ``collapsed`` joins by single spaces
    the words that no run contains after its first period.

    - Words stand between ASCII white space and are compared byte by byte, whatever their length.
    - A null text has no words, no runs and a null ``collapsed``; an empty or blank one has an empty ``collapsed``.
    - Texts are taken whole. Memory is linear in the longest stretch of one text that repeats itself, and spans of
      short texts are bounded. Rows are independent of each other: repeated rows give repeated rows.
    - An empty table gives no rows. Result columns whose names ``docs`` has already get leading underscores.
    """
    names = {n: free_name(docs.columns, n) for n in FOUND.names}
    whole = free_name(docs.columns, "runs_found")
    found = docs.withColumn(whole, _runs_column(F.col(f"`{text}`"), min_length, max(2, min_exponent)))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(whole).getField(n).alias(own) for n, own in names.items()])


def longest(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then smallest period; null if there is none."""
    by = F.transform(runs, lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(by)
