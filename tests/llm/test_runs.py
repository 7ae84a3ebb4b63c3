"""Periodic runs against all periods at all places."""

import hashlib
import random
import re
import zlib

import numpy as np

from varloom.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, min_length, min_exponent):
    n, found = len(words), []
    for q in range(1, n // min_exponent + 1):
        at = 0
        while at < n - q:
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(min_length, min_exponent * q) and not any(
                all(words[x] == words[x + r] for x in range(at, at + length - r)) for r in range(1, q)
            ):
                found.append((at, length, q))
            at = max(end, at + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_trees_against_all_periods():
    draw = random.Random(3)
    for _ in range(1500):
        n, kinds = draw.randint(0, 60), draw.randint(1, 4)
        words = [draw.randint(1, kinds) for _ in range(n)]
        if n and draw.random() < 0.5:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randint(3, 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        for limits in ((6, 4), (2, 2), (3, 3)):
            expected = all_runs(words, *limits)
            assert [tuple(r) for r in runs.runs_of(np.array(words, np.int64), *limits).tolist()] == expected
            (_, got, _), = runs.search([" ".join(map(str, words))], *limits)
            assert got == expected


def test_extensions_of_all_suffixes():
    draw = random.Random(4)
    for _ in range(50):
        words = [draw.randint(1, 3) for _ in range(draw.randint(2, 40))]
        tree = runs.SuffixTree(words)
        ranks = tree.prepare()
        suffixes = [words[i:] + [0] for i in range(len(words) + 1)]
        assert sorted(range(len(suffixes)), key=lambda i: suffixes[i]) == np.argsort(ranks).tolist()
        falling = [[-w for w in s[:-1]] + [-9] for s in suffixes]
        assert sorted(range(len(suffixes)), key=lambda i: falling[i]) == np.argsort(tree.order(falling=True)).tolist()
        pairs = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
        got = tree.extension(*map(np.array, zip(*pairs)))
        for (i, j), n in zip(pairs, got.tolist()):
            same = 0
            while j + same < len(words) and words[i + same] == words[j + same]:
                same += 1
            assert n == same


def test_texts_share_a_span_and_keep_apart():
    texts = ["a b a b", "a b a b a b a b", None, "", "x", "a b a b a", "b a b a b a"]
    got = list(runs.search(texts))
    assert [r for _, r, _ in got] == [[], [(0, 8, 2)], [], [], [], [], []]
    assert [c for _, _, c in got] == ["a b a b", "a b", None, "", "x", "a b a b a", "b a b a b a"]


def test_large_numbers_of_words(monkeypatch):
    """Ranks of sequences take over where the numbers of words are too large to be put together."""
    words = [1, 2, 3] * 5 + list(range(10, 30)) + [7] * 9
    big = np.array([w * (1 << 40) for w in words])
    first, last = runs.possible_stretches(big, np.array([len(big)]), 6, 4)
    small = runs.possible_stretches(np.array(words), np.array([len(words)]), 6, 4)
    assert first.tolist() == small[0].tolist() and last.tolist() == small[1].tolist() and len(first) == 2


def test_run_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert got.keys() == docs.keys()
    altered = 0
    for doc_id, text in docs.items():
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            altered += 1
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        expected = all_runs([numbers[w] for w in words], 6, 4) if n < 3000 else list(next(runs.search([" ".join(words)]))[1])
        gone = {i for s, length, q in expected for i in range(s + q, s + length)}
        r = got[doc_id]
        assert r.n_runs == len(expected)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in expected).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
        top = min(expected, key=lambda x: (-x[1], x[0], x[2])) if expected else (None, None, None)
        assert (r.start, r.length, r.period) == top
        assert r.exponent_milli == (top[1] * 1000 // top[2] if expected else None)
    assert altered > 5


def test_runs_of_odd_rows(odd, nothing, spark):
    found = runs.find_runs(odd)
    # the name n_words is free in the table, runs and collapsed too
    assert found.columns == [*odd.columns, "n_words", "runs", "collapsed"]
    rows = [(r.doc_id, r.text, r.n_words, r.collapsed) for r in found.collect()]
    assert len(rows) == odd.count()
    for _, text, n, collapsed in rows:
        assert n == len(WORD.findall(text or ""))
        assert (collapsed is None) == (text is None)
    assert runs.find_runs(nothing).collect() == []
    clash = spark.createDataFrame([("a a a a a a", 1)], "text string, Runs int")
    first = runs.find_runs(clash).first()
    assert first["Runs"] == 1 and first["_runs"][0].asDict() == {"start": 0, "length": 6, "period": 1} and first["collapsed"] == "a"
