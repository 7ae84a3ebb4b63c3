"""Counts of texts and learned rules against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from varloom.llm import quality_rules, queries
from varloom.llm.quality_rules import Condition, Rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(lines),
        len(set(words)), sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text),
    )


def test_rule_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_quality_rules(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for doc_id, text in docs.items():
        counts, r = plain_counts(text), got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts[:5]
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)


def test_counts_of_odd_rows(odd, nothing, spark):
    found = quality_rules.statistics(odd)
    assert found.columns == [*odd.columns, "statistics"]
    rows = found.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert tuple(r.statistics) == plain_counts(r.text)
    assert quality_rules.statistics(nothing).collect() == []
    clash = spark.createDataFrame([("a b", 1), ("x y x y x y x y", 2)], "text string, Statistics int")
    found = quality_rules.statistics(clash)
    assert found.columns == ["text", "Statistics", "_statistics"]
    assert {tuple(r._statistics) for r in found.collect()} == {plain_counts("a b"), plain_counts("x y x y x y x y")}


def test_counts_of_random_texts(spark):
    draw = random.Random(9)
    texts = ["".join(draw.choice("ab \n\t\x0b#é😀Z9 ") for _ in range(draw.randint(0, 120))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in quality_rules.statistics(frame).collect():
        assert tuple(r.statistics) == plain_counts(r.text)


def plain_best(rows, names, min_rows):
    """All thresholds tried on all rows."""
    best, bad_all = None, sum(b for b, _ in rows)
    for name in sorted(names):
        for value in sorted({v[name] for _, v in rows})[1:]:
            for below in (True, False):
                left = [b for b, v in rows if (v[name] < value) == below]
                b, g = sum(left), len(left) - sum(left)
                found = quality_rules.gain(b, g, bad_all, len(rows) - bad_all)
                if b >= min_rows and found > 1e-9 and (best is None or found > best[0] + 1e-9):
                    best = found, Condition(name, value, below), b, g
    return best


def test_best_condition_against_all_thresholds():
    draw = random.Random(10)
    for _ in range(200):
        rows = [(draw.random() < 0.4, {"x": draw.randint(0, 9), "y": draw.randint(0, 4)}) for _ in range(draw.randint(1, 40))]
        counts = defaultdict(dict)
        for name in ("x", "y"):
            for value in {v[name] for _, v in rows}:
                of = [b for b, v in rows if v[name] == value]
                counts[name][value] = sum(of), len(of) - sum(of)
        assert quality_rules.best_condition(counts, 2) == plain_best(rows, ("x", "y"), 2)


def test_planted_rules_are_found(spark):
    """Bad rows lie in two boxes; a fiftieth of all labels is wrong."""
    draw = random.Random(11)
    rows = []
    for i in range(4000):
        x, y, z = draw.randint(0, 9999), draw.randint(0, 9999), draw.randint(0, 9999)
        bad = (x >= 8000 and y < 4000) or z >= 9500
        rows.append((i, x, y, z, bad != (draw.random() < 0.02)))
    frame = spark.createDataFrame(rows, "id long, x long, y long, z long, bad boolean").repartition(5)
    values = {n: F.col(n) for n in "xyz"}
    rules = quality_rules.fit(frame, values, F.col("bad"), F.col("id"))
    assert quality_rules.fit(frame.repartition(2), values, F.col("bad"), F.col("id")) == rules
    judged = frame.withColumn("kept", quality_rules.verdict(rules, values)).collect()
    truth = {r.id: (r.x >= 8000 and r.y < 4000) or r.z >= 9500 for r in judged}
    wrong = sum(r.kept == truth[r.id] for r in judged)
    assert wrong < 0.01 * len(judged), [str(r) for r in rules]


def test_rules_are_ordered_conditions(spark):
    rules = [Rule((Condition("x", 10, False), Condition("y", 5, True)), 3, 0), Rule((Condition("y", 90, False),), 2, 1)]
    assert [str(r) for r in rules] == ["x >= 10 and y < 5", "y >= 90"]
    frame = spark.createDataFrame([(10, 4), (9, 4), (10, 5), (0, 90), (None, 90)], "x long, y long")
    values = {"x": F.col("x"), "y": F.col("y")}
    assert [r[0] for r in frame.select(quality_rules.verdict(rules, values)).collect()] == [False, True, True, False, False]
    assert [r[0] for r in frame.select(quality_rules.verdict([], values)).collect()] == [True] * 5


@pytest.mark.parametrize("labels", [[], [None, None], [False] * 30, [True] * 30])
def test_labels_that_teach_nothing(spark, labels):
    frame = spark.createDataFrame([(i, 3, b) for i, b in enumerate(labels)], "id long, x long, bad boolean")
    assert quality_rules.fit(frame, {"x": F.col("x")}, F.col("bad"), F.col("id")) == []


def test_labels_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 0), (9, None), (99, 0)], "doc_id long, quality int")
    counted = quality_rules.statistics(odd)
    assert quality_rules.learn(counted, labels) == []
    assert quality_rules.learn(quality_rules.statistics(odd.limit(0)), labels) == []


def test_leading_digits(spark):
    got = spark.createDataFrame([(v,) for v in (0, 7, 42, 99, 100, 123, 999, 1234, 98765)], "v long").select(quality_rules.leading_digits(F.col("v"))).collect()
    assert [r[0] for r in got] == [0, 7, 42, 99, 100, 120, 990, 1200, 98000]
