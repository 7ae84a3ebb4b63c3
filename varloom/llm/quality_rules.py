"""Quality rules: decision lists learned from labelled documents, emitted as conditional expressions.

Sequential covering: a rule grows from the empty conjunction, which covers all rows, by the threshold on one statistic
with the largest information gain (FOIL), until it covers no good row or nothing gains. It is then pruned: of its
conjunctions from the front, the one stays that does best on labelled rows which growing has not seen. Rows that the
rule covers are taken out, and the next rule grows on what is left, until a rule is not worth having. The rules in order,
with what happens to rows that none covers, are one ``when ... otherwise`` column.

All rows stay on the cluster. A step of growing counts good and bad rows per statistic and value; values are whole numbers
with two leading digits, so that a step returns some hundred counts per statistic, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from varloom.llm.common import WORD, crc_of_id, free_name, stored, text_or_empty

SYMBOLS = "[#*$%&|<>]"
REPEATED = 3  # words in a window that repeats
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_ROWS = 5
MIN_PRECISION = 0.8
PRUNING_SHARE = 3  # one labelled row of so many is kept for pruning
_SPACES = r"[\x20\x09-\x0D]+"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_capitals", "n_digits"]


def _occurrences(text: str, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def _repeated_words(grams: Column) -> Column:
    """Words in windows that occur twice or more; windows in order, equal ones next to each other."""
    last = F.greatest(F.size(grams) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(grams, F.lit(1), last).alias("x"), F.slice(grams, F.lit(2), last).alias("y"))
    same = lambda p: (p["x"]["hash"] == p["y"]["hash"]) & (p["x"]["words"] == p["y"]["words"])
    places = F.transform(F.filter(pairs, same), lambda p: F.array(*[p[end]["at"] + k for end in ("x", "y") for k in range(REPEATED)]))
    return F.size(F.array_distinct(F.flatten(places)))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus statistics, a struct of the counts in ``COUNTS`` (long).

    Words stand between ASCII white space. n_symbols counts characters of ``SYMBOLS``; n_lines lines that hold a word, and
    n_dup_lines those equal to an earlier one; n_repeat_words words in windows of three words that occur twice or more in
    the text, the first included; n_capitals and n_digits are of ASCII.

    - A null, empty or blank text has zeros. Texts are taken whole; memory is linear in the longest one.
    - Rows are independent of each other; an empty table gives no rows. A column of that name gives it leading underscores.
    """
    own = free_name(docs.columns, "statistics")
    row, words, body, lines, parts, hashes, grams = (f"_{own}_{n}" for n in ("row", "words", "text", "lines", "parts", "hashes", "grams"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), text_or_empty(f"`{text}`").alias(body))
    # Each step refers to the arrays of the step before more than once, so that none is computed for every element.
    split = whole.select(
        row, body, F.filter(F.split(body, _SPACES), lambda w: w != "").alias(words),
        F.filter(F.split(body, "\n", -1), lambda line: line.rlike(WORD)).alias(lines),
    )
    windows = F.greatest(F.size(words) - (REPEATED - 1), F.lit(0))
    shifted = [F.slice(words, F.lit(k + 1), windows).alias(str(k)) for k in range(REPEATED)]
    zipped = split.select(row, body, words, lines, F.arrays_zip(*shifted).alias(parts))
    hashed = zipped.select(row, body, words, lines, parts, F.transform(parts, lambda p: F.xxhash64(p)).alias(hashes))
    # Most texts repeat nothing, and need no order.
    marked = F.transform(F.arrays_zip(F.col(hashes).alias("hash"), F.col(parts).alias("words")), lambda g, at: g.withField("at", at))
    ordered = hashed.select(
        row, body, words, lines, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(marked)).alias(grams)
    )
    counts = [
        F.size(words), F.char_length(F.array_join(words, "")), _occurrences(body, SYMBOLS), F.size(lines) - F.size(F.array_distinct(lines)),
        F.when(F.col(grams).isNull(), 0).otherwise(_repeated_words(F.col(grams))), F.size(lines), F.size(F.array_distinct(words)),
        _occurrences(body, "[A-Z]"), _occurrences(body, "[0-9]"),
    ]
    found = ordered.select(row, F.struct(*[c.cast("long").alias(n) for n, c in zip(COUNTS, counts)]).alias(own))
    return found.select(*[F.col(row).getField(c).alias(c) for c in docs.columns], own)


def features(counts: str = "statistics") -> dict[str, Column]:
    """Whole numbers that rules may ask for, from a column of ``statistics``; shares are per 10,000."""
    n = lambda name: F.col(f"`{counts}`").getField(name)
    share = lambda a, b: F.when(n(b) > 0, F.floor(10_000 * n(a) / n(b))).otherwise(F.lit(0)).cast("long")
    return {
        "words": n("n_words"), "characters_per_10000_words": share("word_chars", "n_words"), "symbols_per_10000": share("n_symbols", "word_chars"),
        "repeated_lines_per_10000": share("n_dup_lines", "n_lines"), "repeated_words_per_10000": share("n_repeat_words", "n_words"),
        "lines_per_10000_words": share("n_lines", "n_words"), "distinct_words_per_10000": share("n_distinct_words", "n_words"),
        "capitals_per_10000": share("n_capitals", "word_chars"), "digits_per_10000": share("n_digits", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    """``feature`` is ``least`` or more, or less than it."""

    feature: str
    least: int
    below: bool

    def of(self, values: dict[str, Column]) -> Column:
        return values[self.feature] < self.least if self.below else values[self.feature] >= self.least

    def __str__(self) -> str:
        return f"{self.feature} {'<' if self.below else '>='} {self.least}"


@dataclass(frozen=True)
class Rule:
    """A conjunction, and the bad and good rows it was found to cover in learning."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def of(self, values: dict[str, Column]) -> Column:
        return _all(self.conditions, values)

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _all(conditions: tuple[Condition, ...], values: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.of(values) for c in conditions], F.lit(True))


def leading_digits(value: Column) -> Column:
    """A whole number with zeros behind its first two digits: at least t exactly if the number is, for every such t."""
    unit = F.pow(F.lit(10), F.greatest(F.length(value.cast("string")) - 2, F.lit(0))).cast("long")
    return value - value % unit


def gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """What a condition tells about the bad rows it leaves, in bits."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def best_condition(counts: dict[str, dict[int, tuple[int, int]]], min_rows: int) -> tuple[float, Condition, int, int] | None:
    """The condition of the largest gain with its counts, from bad and good rows per feature and value; ties go to the first by name and value."""
    best = None
    for feature, by_value in sorted(counts.items()):
        bad_all, good_all = (sum(c[k] for c in by_value.values()) for k in (0, 1))
        bad = good = 0
        for value in sorted(by_value):
            if bad + good:
                for below, b, g in ((True, bad, good), (False, bad_all - bad, good_all - good)):
                    found = gain(b, g, bad_all, good_all)
                    if b >= min_rows and found > 1e-9 and (best is None or found > best[0] + 1e-9):
                        best = found, Condition(feature, value, below), b, g
            bad, good = bad + by_value[value][0], good + by_value[value][1]
    return best


def fit(
    rows: DataFrame, values: dict[str, Column], bad: Column, key: Column, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS,
    min_rows: int = MIN_ROWS, min_precision: float = MIN_PRECISION,
) -> list[Rule]:
    """Rules for the rows where ``bad`` is true, learned from all rows where it is not null.

    ``key`` is a whole number by which rows are dealt to growing and pruning, so that reruns agree. A rule must cover ``min_rows``
    bad rows in growing, and be right for a share ``min_precision`` of the rows it covers in pruning. Without labelled
    rows, or without bad ones among them, there are no rules. Null values count as 0; repeated rows count as often as they occur.
    """
    names = list(values)
    labelled = stored(rows.filter(bad.isNotNull()).select(
        bad.alias("bad"), (F.pmod(key, F.lit(PRUNING_SHARE)) == 0).alias("pruning"),
        *[leading_digits(F.coalesce(values[n], F.lit(0))).alias(n) for n in names],
    ), "labelled-rows")
    known = {n: F.col(n) for n in names}
    is_bad, is_good = (F.sum(F.when(F.col("bad") == b, 1).otherwise(0)) for b in (True, False))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])).alias("at")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        covered = [rule.of(known) for rule in rules]
        left = labelled.filter(~reduce(lambda a, b: a | b, covered, F.lit(False)))
        conditions: tuple[Condition, ...] = ()
        while len(conditions) < max_conditions:
            counted = left.filter(~F.col("pruning") & _all(conditions, known)).select("bad", pairs).groupBy("at").agg(is_bad.alias("b"), is_good.alias("g"))
            counts: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
            for r in counted.collect():  # at most 90 values for each number of digits and feature
                counts[r["at"]["feature"]][r["at"]["value"]] = r["b"], r["g"]
            best = best_condition(counts, min_rows)
            if best is None:
                break
            conditions += (best[1],)
            if not best[3]:
                break
        if not conditions:
            break
        fronts = [conditions[:k] for k in range(1, len(conditions) + 1)]
        sums = [F.sum(F.when(_all(c, known) & (F.col("bad") == b), 1).otherwise(0)) for c in fronts for b in (True, False)]
        seen = left.filter("pruning").agg(*[s.alias(str(i)) for i, s in enumerate(sums)]).first()
        scored = [(seen[2 * k] or 0, seen[2 * k + 1] or 0) for k in range(len(fronts))]
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in scored]
        at = worth.index(max(worth))
        b, g = scored[at]
        if not b or b < min_precision * (b + g):
            break
        rules.append(Rule(fronts[at], b, g))
    return rules


def verdict(rules: list[Rule], values: dict[str, Column]) -> Column:
    """False where a rule covers the row, the first that does; else true."""
    if not rules:
        return F.lit(True)
    first = F.when(rules[0].of(values), F.lit(False))
    return reduce(lambda chain, rule: chain.when(rule.of(values), F.lit(False)), rules[1:], first).otherwise(F.lit(True))


def learn(counted: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", counts: str = "statistics", **limits) -> list[Rule]:
    """Rules for documents of ``label`` 0, from ``counted`` (with a column of ``statistics``) and ``labels`` (doc_id, label).

    A document with several labels counts by the lowest; null ids and labels are left out.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.min(label) == 0).alias("_bad"))
    rows = counted.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{counts}`").alias("statistics")).join(known, "_id")
    return fit(rows, features(), F.col("_bad"), crc_of_id("_id"), **limits)
