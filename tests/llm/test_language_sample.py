"""The rows a language model learns from, where many texts are the same."""

from collections import Counter

from pyspark.sql import functions as F

from varloom.llm import language_id

from .conftest import prose


def test_copies_take_no_more_than_one_place(spark):
    rows = [(prose(i, 12) + f" {i}", "en") for i in range(60)] + [("", "en")] * 5
    for copy in range(12):  # whatever the hash of a copied text, one label must not take or lose all
        rows += [(f"nur ein einziger Satz {copy}", f"l{copy}")] * 300 + [(prose(copy, 9), f"l{copy}")]
    docs = spark.createDataFrame(rows, "text string, label string")
    got = language_id.bounded_sample(docs, "text", "label", 52, language_id.BITS)
    assert Counter(r[0] for r in got) == {"en": 4} | {f"l{c}": 2 for c in range(12)}
    few = language_id.bounded_sample(docs, "text", "label", 5, language_id.BITS)
    assert Counter(r[0] for r in few) == {"en": 1} | {f"l{c}": 1 for c in range(12)}
    assert language_id.fit(docs, label="label", max_rows=26, epochs=1).labels == sorted({r[1] for r in rows})
    again = language_id.bounded_sample(docs.orderBy(F.rand(1)), "text", "label", 52, language_id.BITS)
    assert [(r[0], r[1].tolist()) for r in got] == [(r[0], r[1].tolist()) for r in again]


def test_sampled_texts_are_counted_one_at_a_time():
    import tracemalloc

    import numpy as np

    from varloom.llm.language_id import ngram_counts, sparse_counts

    texts = [None, "", *[f"one text of number {i}" for i in range(200)]]
    tracemalloc.start()
    at, n = sparse_counts(texts, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * 8 * 2**16  # all counts of ten texts
    for text, places, counts in zip(texts, at, n):
        dense = np.zeros(2**16, np.int64)
        dense[places] = counts
        assert (dense == ngram_counts(text or "", 16)).all()
