"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with L1 and L2 penalties, then one temperature is fitted on rows
that the training left out. N-grams fall in 2**bits hash buckets, which bounds the model whatever the texts hold.
Document frequencies come from all learning rows; the regression is fitted on at most ``max_rows`` of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from varloom.llm.common import free_name, stored
from varloom.llm.words import give_back

BITS = 16
ORDERS = (1, 2, 3)
MAX_ROWS = 2_000
EPOCHS = 3
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, spreads products over the high bits
_SPAN = 1 << 20


def ngram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of the hashed character n-grams of the whole lower-cased text, read in spans that overlap."""
    counts = np.zeros(1 << bits, np.int64)
    text = text.lower()
    longest = max(ORDERS)
    for at in range(0, len(text), _SPAN):
        part = text[at:at + _SPAN + longest - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = min(_SPAN, len(text) - at)  # n-grams of this span begin before this place
        key = np.zeros(len(codes), np.uint64)
        for n in range(1, longest + 1):
            if n > len(codes):
                break
            key = (key[:len(codes) - n + 1] + codes[n - 1:]) * _MIX
            if n in ORDERS:
                counts += np.bincount((key[:starts] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray  # by bucket
    weights: np.ndarray  # bucket x label
    bias: np.ndarray
    temperature: float
    bits: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        counts = ngram_counts(text, self.bits)
        at = np.flatnonzero(counts)
        chances = softmax((vector(counts[at], self.idf[at]) @ self.weights[at] + self.bias) / self.temperature)
        best = int(chances.argmax())
        return self.labels[best], float(min(1.0, chances[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length, term frequencies on a log scale."""
    values = (1 + np.log(counts)) * idf
    return values / (np.sqrt((values**2).sum()) or 1.0)


def document_frequencies(learning: DataFrame, text: str, bits: int) -> tuple[int, np.ndarray]:
    """Rows, and rows per bucket, over all learning rows. At most 2**bits + 1 sums reach the driver."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, found = 0, np.zeros(1 << bits, np.int64)
        for batch in batches:
            for value in batch[text]:
                found += ngram_counts(value or "", bits) > 0
                rows += 1
        give_back()
        at = np.flatnonzero(found)
        yield pd.DataFrame({"bucket": np.append(at, -1), "rows": np.append(found[at], rows)})

    sums = learning.select(text).mapInPandas(counted, "bucket long, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows"))
    got = sums.toArrow().to_pandas()
    frequencies = np.zeros(1 << bits)
    inside = got["bucket"] >= 0
    frequencies[got.loc[inside, "bucket"]] = got.loc[inside, "rows"]
    return int(got.loc[~inside, "rows"].sum()), frequencies


def sparse_counts(texts: Iterable[str | None], bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets and counts of each text; all 2**bits of them are held for one text at a time."""
    at, n = [], []
    for text in texts:
        found = ngram_counts(text or "", bits)
        at.append(np.flatnonzero(found))
        n.append(found[at[-1]])
    return at, n


def bounded_sample(learning: DataFrame, text: str, label: str, max_rows: int, bits: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """max_rows / labels distinct texts of every label, one at least, or all it has: label, buckets, counts.

    They are the first by a hash of the text, so that copies count once. Empty texts hold no n-gram and are left out.
    """
    keyed = learning.filter(F.col(text) != "").withColumn("key", F.xxhash64(F.col(text), F.lit(11)))
    distinct = stored(keyed.select(label, "key").distinct(), "distinct-texts")
    texts = {r[0]: r[1] for r in distinct.groupBy(label).count().collect()}  # one row per language
    if not texts:
        return []
    quota = max(1, max_rows // len(texts))
    # Twice the quota and more reach the driver, as hashes; fewer than the quota cannot be expected from distinct texts.
    share = {k: (2 * quota + 50) / n for k, n in texts.items()}
    wanted = F.create_map(*[F.lit(x) for k, s in share.items() for x in (k, s)])[F.col(label)]
    drawn = (F.pmod("key", F.lit(1_000_003)) + 0.5) / 1_000_003
    offered: dict[str, list] = {}
    for k, key in distinct.filter(drawn < wanted).select(label, "key").collect():
        offered.setdefault(k, []).append(key)
    chosen = [(k, key) for k, keys in offered.items() for key in sorted(keys, key=lambda h: (h % 1_000_003, h))[:quota]]
    taken = learning.sparkSession.createDataFrame(chosen, f"`{label}` string, key long")
    rows = keyed.join(F.broadcast(taken), [label, "key"], "left_semi").dropDuplicates([label, "key"])  # max_rows or one a language

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, n = sparse_counts(batch[text], bits)
            yield pd.DataFrame({"label": batch[label], "at": at, "n": n})
        give_back()

    sample = rows.select(text, label).mapInPandas(counted, "label string, at array<int>, n array<int>")
    got = [(r["label"], np.array(r["at"], np.int64), np.array(r["n"], float)) for r in sample.toArrow().to_pylist()]
    return sorted(got, key=lambda r: (len(r[1]), r[0], r[1].tobytes(), r[2].tobytes()))


def ftrl(
    rows: list[tuple[int, np.ndarray, np.ndarray]], n_labels: int, size: int, epochs: int = EPOCHS, rate: float = 0.5,
    beta: float = 1.0, l1: float = 0.02, l2: float = 1.0, seed: int = 5,
) -> np.ndarray:
    """Weights (size x labels) by per-coordinate follow-the-regularised-leader with an elastic-net penalty."""
    z, n = np.zeros((size, n_labels)), np.zeros((size, n_labels))

    def leader(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / rate + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            label, at, values = rows[i]
            weights = leader(at)
            error = softmax(values @ weights)
            error[label] -= 1
            step = np.outer(values, error)
            grown = n[at] + step**2
            z[at] += step - (np.sqrt(grown) - np.sqrt(n[at])) / rate * weights
            n[at] = grown
    return leader(slice(None))


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean()
    low, high, ratio = np.log(0.2), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(
    docs: DataFrame, text: str = "text", label: str = "lang", learn: Column | None = None, max_rows: int = MAX_ROWS,
    bits: int = BITS, epochs: int = EPOCHS,
) -> Model:
    """Learn from the rows of ``docs`` where ``learn`` holds and neither text nor label is null.

    ``max_rows`` bounds the rows that reach the regression, distinct texts spread evenly over labels; a label with a text
    has one there at least. Every fifth of them fits the temperature instead. Without any learning row the model knows no language and predicts ``und``.
    """
    learning = docs if learn is None else docs.filter(learn)
    learning = learning.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).filter(
        "text is not null and label is not null"
    )
    total, frequencies = document_frequencies(learning, "text", bits)
    idf = np.log((1 + total) / (1 + frequencies)) + 1
    sample = [r for r in bounded_sample(learning, "text", "label", max_rows, bits) if len(r[1])]
    labels = sorted({r[0] for r in sample})
    # One more coordinate, always 1, is the bias.
    rows = [
        (labels.index(k), np.append(at, 1 << bits), np.append(vector(n, idf[at]), 1.0)) for k, at, n in sample
    ]
    held = rows[4::5]
    weights = ftrl([r for i, r in enumerate(rows) if i % 5 != 4] or rows, len(labels), (1 << bits) + 1, epochs)
    logits = np.array([values @ weights[at] for _, at, values in held]).reshape(len(held), len(labels))
    temperature = temperature_of(logits, np.array([r[0] for r in held], int))
    return Model(labels, idf, weights[:-1].astype(np.float32), weights[-1], temperature, bits)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score, from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0. Repeated rows get the same answer, an empty table none.
    Result columns whose names ``docs`` has already get leading underscores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits x languages

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for texts in batches:
            yield pd.DataFrame([known.predict(t) for t in texts], columns=["lang_pred", "score"])
        give_back()

    held = free_name(docs.columns, "predicted")
    names = {n: free_name(docs.columns, n) for n in ("lang_pred", "score")}
    return docs.withColumn(held, predicted(F.col(text))).select(
        *[F.col(f"`{c}`") for c in docs.columns], *[F.col(held)[n].alias(names[n]) for n in names]
    )
