"""Secrets in texts: candidates by form, false positives removed by a random forest.

A candidate is a run of 16 or more letters, digits and ``+/_-`` that holds a digit; a value that is assigned to a credential's
name, whatever its length and characters; or a form that issuers document, wherever it stands. The forest judges it by its
length, its character transitions against those of the whole corpus, how much of it dictionary words cover, its path and
its neighbouring words. It is trained on labelled findings: a caller's own, or those that ``rule_labels`` can settle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from varloom.llm.common import crc_of_id, stored
from varloom.llm.words import count_words, frequency_histogram, least_count, texts_of

MIN_LENGTH = 16
DICTIONARY_WORDS = 20_000
MAX_TRAINING_ROWS = 20_000
TREES = 30
DEPTH = 8
THRESHOLD = 0.5
_BEFORE, _AFTER, _NEIGHBOURS = 64, 32, 8

# Words beside credentials, words beside values that only look like one, parts of paths that hold samples.
CREDENTIAL_WORDS = frozenset(
    "key secret token password passwd pwd pass api apikey auth credential credentials private access bearer login".split()
)
HARMLESS_WORDS = frozenset(
    "example sample dummy test placeholder hash commit sha checksum digest uuid id version card phone order invoice page".split()
)
SAMPLE_PATHS = frozenset("test tests example examples sample samples mock fixture fixtures doc docs".split())

_TAIL = re.compile(r"[0-9][A-Za-z0-9+/_\-]*")
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_WORD = re.compile(r"[A-Za-z]+")
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")
# Forms that issuers document, and names that are assigned credentials.
_ISSUED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|AIza[0-9A-Za-z_\-]{35}|xox[abprs]-[0-9A-Za-z\-]{10,}|sk_live_[0-9a-zA-Z]{24,}")
_NAMED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?$")

_VALUE = re.compile(
    r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[^\S\n]*[=:][^\S\n]*(?:\"([^\"\n]{1,512})\"|'([^'\n]{1,512})'|([^\s\"',;]+))"
)

# Characters by class: letters by themselves, digits together, everything else together.
_CLASSES = 54
_CLASS = np.full(256, 53, np.uint8)
_CLASS[np.arange(ord("a"), ord("z") + 1)] = np.arange(26)
_CLASS[np.arange(ord("A"), ord("Z") + 1)] = np.arange(26, 52)
_CLASS[np.arange(ord("0"), ord("9") + 1)] = 52


def long_runs(text: str, min_length: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs that hold a digit."""
    done = 0
    for found in _TAIL.finditer(text):
        start, end = found.span()
        while start > done and text[start - 1] in _RUN:
            start -= 1
        done = end
        if end - start >= min_length:
            yield start, end


def candidates(text: str, min_length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """(start, end) of every candidate of the whole text; one that is found in several ways is there once."""
    found = set(long_runs(text, min_length))
    found.update(m.span() for m in _ISSUED.finditer(text))
    if "=" in text or ":" in text:
        found.update(m.span(m.lastindex) for m in _VALUE.finditer(text))
    return sorted(found)


def transition_counts(docs: DataFrame) -> np.ndarray:
    """Pairs of neighbouring character classes over all texts; one small table per task reaches the sums."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(_CLASSES * _CLASSES, np.int64)
        for _, texts in texts_of(batches):
            for value in texts:
                data = (value or "").encode("utf-8", "surrogatepass")
                for at in range(0, len(data), 1 << 20):
                    codes = _CLASS[np.frombuffer(data[at:at + (1 << 20) + 1], np.uint8)].astype(np.int64)
                    sums += np.bincount(codes[:-1] * _CLASSES + codes[1:], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["pair", "n"])

    found = docs.select("text").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(_CLASSES * _CLASSES)
    for pair, n in found:
        table[pair] = n
    return table.reshape(_CLASSES, _CLASSES)


@dataclass
class Corpus:
    """What features compare a candidate with: transition log probabilities and frequent words, both of bounded size."""

    transitions: np.ndarray
    words: frozenset[str]


def corpus_of(docs: DataFrame, dictionary_words: int = DICTIONARY_WORDS) -> Corpus:
    table = stored(count_words(docs), "word-counts")
    least = least_count(frequency_histogram(table), dictionary_words)
    frequent = table.filter(F.col("n") >= least).select("word").collect() if least < math.inf else []
    words = {w for row in frequent for w in _WORD.findall(row[0]) if len(w) >= 4}
    counts = transition_counts(docs) + 1
    return Corpus(np.log(counts / counts.sum(axis=1, keepdims=True)), frozenset(words))


def covered(value: str, words: frozenset[str], longest: int = 20) -> float:
    """The share of ``value`` under dictionary words, longest first from the left."""
    value, at, hit = value.lower(), 0, 0
    while at < len(value):
        size = next((n for n in range(min(longest, len(value) - at), 3, -1) if value[at:at + n] in words), 0)
        hit, at = hit + size, at + max(1, size)
    return hit / len(value) if value else 0.0


def features(text: str, start: int, end: int, path: str | None, corpus: Corpus) -> list[float]:
    value = text[start:end]
    n, counts = len(value), Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    codes = _CLASS[np.frombuffer(value.encode("utf-8", "surrogatepass"), np.uint8)]
    steps = corpus.transitions[codes[:-1], codes[1:]] if len(codes) > 1 else np.zeros(1)
    before, after = text[max(0, start - _BEFORE):start], text[end:end + _AFTER]
    neighbours = [w.lower() for w in _WORD.findall(before)[-3:] + _WORD.findall(after)[:1]]
    parts = _WORD.findall((path or "").lower())
    hashed = [0.0] * _NEIGHBOURS
    for word in neighbours:
        hashed[zlib.crc32(word.encode()) % _NEIGHBOURS] += 1.0
    return [
        float(n), entropy, len(counts) / n,
        sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n, sum(c.islower() for c in value) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)), float(value.count("-")), float(value.count("/")),
        float(steps.mean()), float(steps.min()), float(steps.std()), covered(value, corpus.words),
        float(len(parts)), float(any(p in SAMPLE_PATHS for p in parts)), float((path or "").count("/")),
        float(any(w in CREDENTIAL_WORDS for w in neighbours)), float(any(w in HARMLESS_WORDS for w in neighbours)),
        float(bool(_ASSIGNED.search(before))), float(before[-1:] in ("'", '"') and after[:1] == before[-1:]),
        *hashed,
    ]


def rule_labels(value: str, before: str, corpus: Corpus) -> int | None:
    """1 for an issuer's form or a long named value with a digit; 0 for plain numbers and runs of words; None where no rule decides."""
    if _ISSUED.fullmatch(value) or len(value) >= MIN_LENGTH and any(c.isdigit() for c in value) and _NAMED.search(before):
        return 1
    if not any(c.isalpha() for c in value) or covered(value, corpus.words) >= 0.5:
        return 0
    return None


_SCHEMA = "start long, `end` long, shape string, preview string, sha256 string, label int, features array<double>"


def find_candidates(docs: DataFrame, corpus: Corpus, min_length: int = MIN_LENGTH) -> DataFrame:
    """A row per candidate of ``docs`` (doc_id, text, path): place, form, features and the label that a rule gives."""
    import hashlib

    sent = docs.sparkSession.sparkContext.broadcast(corpus)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for part, texts in texts_of(batches):
            owners, rows = [], []
            paths = part.column("path").to_pylist()
            for i, text in enumerate(texts):
                for start, end in candidates(text or "", min_length):
                    value = text[start:end]
                    shape = "digits" if value.isdigit() else "hex" if all(c in "0123456789abcdef" for c in value) else "mixed"
                    owners.append(i)
                    rows.append((
                        start, end, shape, value[:4] + "...", hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest(),
                        rule_labels(value, text[max(0, start - _BEFORE):start], known), features(text, start, end, paths[i], known),
                    ))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(owners, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "start", "end", "shape", "preview", "sha256", "label", "features"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "path").mapInArrow(found, f"doc_id {id_type}, {_SCHEMA}")


def judge(
    findings: DataFrame, learn: Column, max_rows: int = MAX_TRAINING_ROWS, trees: int = TREES, depth: int = DEPTH,
    threshold: float = THRESHOLD, seed: int = 3,
) -> DataFrame:
    """``findings`` (features, label) plus probability and is_secret.

    The forest is fitted on at most about ``max_rows`` labelled rows for which ``learn`` holds, chosen by a hash.
    With labels of one kind only, or none, there is nothing to tell apart: the probability is 1 unless all labels are 0.
    """
    labelled = findings.filter(learn & F.col("label").isNotNull())
    total, positive = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if positive in (0, total):
        return findings.withColumn("probability", F.lit(0.0 if total and not positive else 1.0)).withColumn(
            "is_secret", F.col("probability") >= threshold
        )
    drawn = (F.pmod(F.xxhash64("sha256", "start"), F.lit(1_000_003)) + 0.5) / 1_000_003
    sample = labelled.filter(drawn < max_rows / total).select(
        array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label")
    )
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="chances",
        rawPredictionCol="votes", predictionCol="predicted",
    ).fit(sample)
    judged = forest.transform(findings.withColumn("vector", array_to_vector("features")))
    return judged.withColumn("probability", vector_to_array("chances")[1]).withColumn(
        "is_secret", F.col("probability") >= threshold
    ).drop("vector", "votes", "chances", "predicted")


def scan(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = "source", held_out_part: int = 5,
    min_length: int = MIN_LENGTH, max_rows: int = MAX_TRAINING_ROWS, threshold: float = THRESHOLD,
) -> DataFrame:
    """Every candidate of every document: doc_id, start, end (offsets into the text), shape, preview (four characters),
    sha256, label (of a rule, or null), held_out, probability and is_secret.

    Rows whose crc32(doc_id as text) leaves remainder 0 are held out of the training.

    - Null or empty texts hold no candidate; texts of any length are read whole; a null path has no parts.
    - A null id has crc32 0 and is held out. Repeated rows give repeated findings; an empty table gives none.
    - Other columns of ``docs`` play no part.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(path).cast("string").alias("path"))
    findings = stored(find_candidates(own, corpus_of(own), min_length), "findings").withColumn(
        "held_out", crc_of_id() % held_out_part == 0
    )
    return judge(findings, ~F.col("held_out"), max_rows, threshold=threshold).drop("features")
