"""The pipeline's near-duplicate stage against the Jaccard similarity of all pairs."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from varloom.llm import near_dedup, simhash


def plain_set(text, words=5):
    tokens = (text or "").encode().lower().split()
    return {tuple(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def plain_first(texts):
    """The smallest id of each id's group, by all pairs."""
    root = {d: d for d in texts}
    sets = {d: plain_set(t) for d, t in texts.items()}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and len(x & y) * 5 >= len(x | y) * 4:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {top(d) for d in texts}


@pytest.mark.parametrize("common, shard_sets, broadcast_rows", [(True, 1000, 10**6), (False, 1000, 0), (True, 3, 0), (False, 7, 10**6)])
def test_near_copies_against_all_pairs(spark, monkeypatch, common, shard_sets, broadcast_rows):
    """Chains of copies with edits, some at the very limit, all with a common passage; neither the order of shingles nor the size of
    shards changes anything."""
    monkeypatch.setattr(near_dedup, "_SAMPLED", 1 if common else 10**9)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast_rows)
    draw = random.Random(5)
    passage, texts = [f"p{i}" for i in range(30)], {}
    for _ in range(25):
        at = [f"w{draw.randrange(4000)}" for _ in range(draw.randrange(4, 150))]
        for _ in range(draw.randrange(1, 7)):
            texts[len(texts)] = " ".join(at + passage * draw.randrange(2))
            at = list(at)
            for _ in range(draw.randrange(0, max(2, len(at) // 25))):
                at[draw.randrange(len(at))] = f"e{draw.randrange(10**6)}"
    nine = [f"n{i}" for i in range(9)]
    texts |= {1000: " ".join(nine[:8]), 1001: " ".join(nine), 1002: "", 1003: None, 1004: " ".join(nine[:8]).upper()}
    expected = plain_first(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.deduplicate(docs, shard_sets=shard_sets).collect()} == expected
    assert len(expected) < len(set(texts.values())) - 10


def test_stage_drops_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected = plain_first(texts)
    got = [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, sf).collect()]
    assert sorted(got) == sorted(expected)


def test_rows_of_all_kinds(odd, nothing, spark):
    got = near_dedup.deduplicate(odd)
    assert got.columns == odd.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(9) == 1 and ids.count(3) == 1 and not {5, 6, 8} & set(ids) and len(ids) == len(set(ids))
    assert near_dedup.deduplicate(nothing).count() == 0
    unnamed = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "A b c")], "doc_id long, text string")
    assert near_dedup.deduplicate(unnamed).count() == 1


def test_histograms_never_claim_too_much():
    draw = random.Random(6)
    for n in (0, 1, 5, 40, 300, 3000):
        x = " ".join(str(draw.randrange(10**6)) for _ in range(n))
        for y in (x, x[:len(x) * 9 // 10], x.replace("1 ", "7 "), x + " " + x[::-1]):
            a, b = near_dedup.shingles(x), near_dedup.shingles(y)
            found = near_dedup.least_difference(near_dedup.histogram(a).tobytes(), near_dedup.histogram(b).tobytes())
            assert abs(len(a) - len(b)) <= found <= len(set(a.tolist()) ^ set(b.tolist()))


def test_trees_and_histograms_against_all_pairs():
    """Each shard's forest joins what all alike pairs join, and no set with an alike one is left out before."""
    draw = random.Random(7)
    for percent in (50, 80, 95):
        for _ in range(40):
            base, sets = [draw.randrange(-2**62, 2**62) for _ in range(draw.randrange(1, 300))], {}
            for _ in range(draw.randrange(1, 40)):
                own = {draw.randrange(-2**62, 2**62) if draw.random() < draw.choice([0, 0.05, 0.2]) else s for s in base if draw.random() < draw.choice([0.9, 1])}
                sets[tuple(sorted(own))] = None
            found = sorted((np.array(s, np.int64) for s in sets if s), key=len)
            if not found:
                continue
            alike = lambda x, y: len(set(x) & set(y)) * 100 >= len(set(x) | set(y)) * percent
            lists = [x.tolist() for x in found]
            pairs = [(i, j) for i, j in itertools.combinations(range(len(found)), 2) if alike(lists[i], lists[j])]
            open_ = near_dedup.with_possible_partner(np.array([len(x) for x in found]), [near_dedup.histogram(x).tobytes() for x in found], percent)
            assert all(open_[i] and open_[j] for i, j in pairs)
            links = near_dedup.forest(found, range(len(found)), percent)
            assert {tuple(sorted(e)) for e in links} <= set(pairs)

            def groups(edges):
                root = list(range(len(found)))
                for _ in range(len(found)):
                    for a, b in edges:
                        root[a] = root[b] = min(root[a], root[b])
                return root

            assert groups(links) == groups(pairs) and len(links) == len(found) - len(set(groups(pairs)))
