"""Scores of texts under a hidden Markov language model.

Words are counted over all training rows. The model's symbols are the most frequent words (at most ``HEAD_WORDS``, so that the
emission table has a proven size), one class for each group of other words, and the end of a text. Baum-Welch passes over
all training rows sum expected counts inside each task, then over tasks; the scaled forward recursion gives the exact
likelihood of a text's symbols. A word outside the head also counts with its probability inside its class, which
comes from the complete word counts by a join and not by broadcast.

Only the starting point of the training is found on a bounded sample of training rows (``START_ROWS``).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from varloom.llm.common import crc_of_id, discard, free_name, stored, text_or_empty
from varloom.llm.words import count_words, frequency_histogram, least_count, texts_of, words_of

STATES = 8
PASSES = 2
HEAD_WORDS = 1 << 17
MIN_HEAD_COUNT = 3  # rarer words say little about states
CLASSES = 61
START_ROWS = 2_000
START_WORDS = 2_000
ADDED = 0.1  # the unigram model adds this to every count
BACKOFF = 200.0
BATCH_TOKENS = 1_000_000
TRAINING_SPAN = 1 << 16
_EDGE = b".,;:!?\"')]}"


def word_class(word: bytes) -> int:
    """A class by the ending, which tells languages and inflections apart."""
    return zlib.crc32(word.rstrip(_EDGE)[-2:]) % CLASSES


class Symbols(dict):
    """Word to symbol: head words first, then the classes, then the end of a text."""

    def __init__(self, head: Sequence[bytes]):
        super().__init__(zip(head, range(len(head))))
        self.head = len(head)
        self.end = len(head) + CLASSES
        self.size = self.end + 1

    def __missing__(self, word: bytes) -> int:
        return self.head + word_class(word)

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.array([*map(self.__getitem__, words), self.end], np.int32)


@dataclass
class Counts:
    """What the training words come to; ``head`` and its counts are ordered by frequency."""

    tokens: int
    distinct: int
    texts: int
    head: list[bytes]
    head_n: np.ndarray
    class_n: np.ndarray
    class_distinct: np.ndarray
    least: float  # words of a smaller count are in no head
    table: DataFrame = field(repr=False)

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.head_n, self.class_n, [self.texts]]).astype(float)


def gather_counts(training: DataFrame, text: str = "text", head_words: int = HEAD_WORDS) -> Counts:
    """Complete word counts, stored as ``table``; what reaches the driver is the head and sums per class."""
    table = stored(count_words(training, text), "word-counts")
    histogram = frequency_histogram(table)
    texts = training.count()
    least = max(MIN_HEAD_COUNT, least_count(histogram, head_words))
    head = table.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").collect() if least < math.inf else []

    @F.pandas_udf("int")
    def class_of(words):
        return words.map(lambda w: word_class(w.encode()))

    rest = table.filter(F.col("n") < least).groupBy(class_of("word").alias("at")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")
    ).collect()
    class_n, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in rest:
        class_n[row["at"]], class_distinct[row["at"]] = row["n"], row["words"]
    return Counts(
        sum(r["n"] for r in histogram) + texts, sum(r["words"] for r in histogram) + (texts > 0), texts,
        [r["word"].encode() for r in head], np.array([r["n"] for r in head], float), class_n, class_distinct,
        least, table,
    )


# --- the model -----------------------------------------------------------------------------------


@dataclass
class Hmm:
    start: np.ndarray  # state
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # symbol, state


def lay_out(sequences: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols ordered by place in their sequence, longest sequence first; where each place begins; the ranks' sequences."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    # active[t]: sequences longer than t
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), side="right")
    begins = np.concatenate([[0], np.cumsum(active)])
    symbols = np.empty(int(begins[-1]), np.int32)
    for rank, i in enumerate(order):
        symbols[begins[:lengths[rank]] + rank] = sequences[i]
    return symbols, begins, order


def log10_likelihoods(model: Hmm, sequences: Sequence[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of each whole sequence by the scaled forward recursion, all sequences a place at a time."""
    symbols, begins, order = lay_out(sequences)
    total, product = np.zeros(len(order)), np.ones(len(order))
    move, emit = model.move.astype(np.float32), model.emit
    state, block, upto = None, None, 0
    for t in range(len(begins) - 1):
        a, b = begins[t], begins[t + 1]
        if b > upto:
            base = a
            upto = begins[min(len(begins) - 1, max(t + 1, int(np.searchsorted(begins, a + 200_000, side="right")) - 1))]
            block = emit[symbols[base:upto]]
        chance = block[a - base:b - base]
        state = model.start.astype(np.float32) * chance if t == 0 else (state[:b - a] @ move) * chance
        scale = state.sum(axis=1)
        state /= scale[:, None]
        product[:b - a] *= scale
        if t % 8 == 7:
            total += np.log10(product)
            product.fill(1.0)
    total += np.log10(product)
    found = np.empty(len(order))
    found[order] = total
    return found


def expected_counts(model: Hmm, sequences: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, moves and emissions of the sequences."""
    symbols, begins, _ = lay_out(sequences)
    states = len(model.start)
    move = model.move.astype(np.float32)
    chance = model.emit[symbols]
    alpha, scale = np.empty_like(chance), np.empty(len(symbols), np.float32)
    places = len(begins) - 1
    for t in range(places):
        a, b = begins[t], begins[t + 1]
        now = chance[a:b] * (model.start.astype(np.float32) if t == 0 else alpha[begins[t - 1]:begins[t - 1] + b - a] @ move)
        scale[a:b] = now.sum(axis=1)
        np.divide(now, scale[a:b, None], out=alpha[a:b])
    chance /= scale[:, None]
    beta = np.ones_like(alpha)
    moves = np.zeros((states, states))
    back = move.T.copy()
    for t in range(places - 2, -1, -1):
        a, b, c = begins[t], begins[t + 1], begins[t + 2]
        ahead = chance[b:c] * beta[b:c]
        beta[a:a + c - b] = ahead @ back
        moves += alpha[a:a + c - b].T @ ahead
    alpha *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    emissions = np.stack([np.bincount(symbols, weights=alpha[:, k], minlength=len(model.emit)) for k in range(states)], axis=1)
    first = alpha[:begins[1]].sum(axis=0) if places else np.zeros(states)
    return first, moves * model.move, emissions


def estimate(start: np.ndarray, moves: np.ndarray, emissions: np.ndarray, unigram: np.ndarray) -> Hmm:
    """Probabilities from expected counts. Emissions fall back on the unigram distribution of the symbols, with a weight that
    grows with the number of different symbols a state has emitted."""
    states = len(start)
    weight = BACKOFF + (emissions > 0.5).sum(axis=0)
    return Hmm(
        (start + 1) / (start.sum() + states),
        (moves + 1) / (moves.sum(axis=1, keepdims=True) + states),
        ((emissions + weight * unigram[:, None]) / (emissions.sum(axis=0) + weight)).astype(np.float32),
    )


def starting_point(rows: Sequence[np.ndarray], unigram: np.ndarray, states: int, rounds: int = 20) -> Hmm:
    """A mixture of ``states`` unigram models of whole texts, fitted to the sampled rows, as slowly changing states."""
    width = min(START_WORDS, len(unigram))
    matrix = np.array([np.bincount(r[r < width], minlength=width) for r in rows], float).reshape(len(rows), width)
    matrix = matrix[matrix.sum(axis=1) > 0]
    share = np.tile(unigram[:width], (states, 1))
    if len(matrix):
        unit = np.sqrt(matrix)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        seeds = [0]  # each next seed is the text least like all seeds so far
        for _ in range(states - 1):
            seeds.append(int((unit @ unit[seeds].T).max(axis=1).argmin()))
        belongs = np.eye(states)[(unit @ unit[seeds].T).argmax(axis=1)]
        for _ in range(rounds):
            share = belongs.T @ matrix + BACKOFF * unigram[:width]
            share /= share.sum(axis=1, keepdims=True)
            logs = matrix @ np.log(share).T + np.log(belongs.mean(axis=0) + 1e-6)
            belongs = np.exp(logs - logs.max(axis=1, keepdims=True))
            belongs /= belongs.sum(axis=1, keepdims=True)
    emit = np.tile(unigram[:, None], (1, states))
    emit[:width] = share.T * unigram[:width].sum()
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, emit.astype(np.float32))


def _sampled(training: DataFrame, symbols, rows: int) -> list[np.ndarray]:
    """Of ``rows`` distinct texts, or all there are, the counts of the most frequent words as their symbols; copies count once."""
    key = F.xxhash64("text", F.lit(3))
    distinct = stored(training.select(key.alias("key")).distinct(), "distinct-texts")
    total = distinct.count()
    # Twice as many hashes and more reach the driver; fewer than wanted cannot be expected from distinct texts.
    place = F.pmod("key", F.lit(1_000_003))
    offered = distinct.filter((place + 0.5) / 1_000_003 < (2 * rows + 50) / max(1, total))
    chosen = sorted((r[0] for r in offered.collect()), key=lambda h: (h % 1_000_003, h))[:rows]
    discard(distinct)
    if not chosen:
        return []
    wanted = training.sparkSession.createDataFrame([(k,) for k in chosen], "key long")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Symbols(symbols.value)
        for _, texts in texts_of(batches):
            # What the starting point reads: counts of the most frequent words, as their symbols.
            kept = [np.sort(s[s < START_WORDS]) for s in (known.encode(words_of(t)) for t in texts)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.int32()))], names=["ids"])

    taken = training.select("text", key.alias("key")).join(F.broadcast(wanted), "key", "left_semi").dropDuplicates(["key"])  # at most ``rows`` keys
    got = taken.select("text").mapInArrow(encoded, "ids array<int>").toArrow()["ids"]
    return sorted((np.array(r, np.int64) for r in got.to_pylist()), key=lambda r: (len(r), r.tobytes()))


def train(
    training: DataFrame, counts: Counts, states: int = STATES, passes: int = PASSES, start_rows: int = START_ROWS,
    batch_tokens: int = BATCH_TOKENS,
) -> Hmm:
    """Baum-Welch over all training rows (column text); each pass is one job. Texts of over ``TRAINING_SPAN`` words are
    learned from as several sequences; scores always take a text as one."""
    context = training.sparkSession.sparkContext
    observed = counts.symbol_counts() + ADDED
    unigram = observed / observed.sum()
    head = context.broadcast(counts.head)  # at most HEAD_WORDS words
    model = starting_point(_sampled(training, head, start_rows), unigram, states)
    columns = [f"s{k}" for k in range(states)]
    size = len(unigram)
    for _ in range(passes):
        sent = context.broadcast(model)

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, current = Symbols(head.value), sent.value
            first, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
            held, tokens = [], 0

            def add():
                got = expected_counts(current, held)
                for sums, more in zip((first, moves, emissions), got):
                    sums += more

            for _, texts in texts_of(batches):
                for value in texts:
                    found = known.encode(words_of(value))
                    held += [found[i:i + TRAINING_SPAN] for i in range(0, len(found), TRAINING_SPAN)]
                    tokens += len(found)
                    if tokens >= batch_tokens:
                        add()
                        held, tokens = [], 0
            if held:
                add()
            # Rows: -1 the starts, -2 - k the moves from state k, others the emissions of a symbol.
            at = np.flatnonzero(emissions.any(axis=1))
            values = np.concatenate([first[None], moves, emissions[at]]).astype(np.float32)
            rows = np.concatenate([[-1], -2 - np.arange(states), at]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), *[pa.array(np.ascontiguousarray(values[:, k])) for k in range(states)]], names=["row", *columns]
            )

        sums = training.select("text").mapInArrow(expected, "row int, " + ", ".join(f"{c} float" for c in columns)).groupBy(
            "row"
        ).agg(*[F.sum(c).alias(c) for c in columns]).toArrow().to_pandas()  # at most one row per symbol and state
        table = np.zeros((size + states + 1, states))
        table[sums["row"].to_numpy() + states + 1] = sums[columns].to_numpy()
        model = estimate(table[states], table[:states][::-1], table[states + 1:], unigram)
        sent.unpersist()
    return model


def score(
    docs: DataFrame, counts: Counts, model: Hmm, text: str = "text", batch_tokens: int = BATCH_TOKENS
) -> DataFrame:
    """All columns of ``docs`` but the text, plus n_tokens, n_known, base_score and score (log10 probabilities).

    base_score is the add-0.1 unigram model over the words and the end; score is the hidden Markov model's. Result
    columns whose names ``docs`` has already get leading underscores.
    """
    context = docs.sparkSession.sparkContext
    kept = [c for c in docs.columns if c != text]
    names = {n: free_name(kept, n) for n in ("n_tokens", "n_known", "base_score", "score")}
    denominator = counts.tokens + ADDED * (counts.distinct + 1)
    # Head words and the end; classes are looked up word by word below.
    logs = np.log10((counts.symbol_counts() + ADDED) / denominator)
    sent = context.broadcast((counts.head, model, logs))
    known_end = int(counts.texts > 0)
    word_type = pa.list_(pa.struct([("word", pa.string()), ("at", pa.int32()), ("n", pa.int64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, current, head_logs = sent.value
        symbols = Symbols(head)

        def flush():
            sequences = [s for _, found, _ in held for s in found]
            chances = log10_likelihoods(current, sequences) if sequences else np.zeros(0)
            at = 0
            for part, found, rest in held:
                n = len(found)
                inside = [s[(s < symbols.head) | (s == symbols.end)] for s in found]
                yield pa.RecordBatch.from_arrays([
                    part.column("kept"), pa.array([len(s) for s in found], pa.int64()),
                    pa.array([len(s) - 1 + known_end for s in inside], pa.int64()),
                    pa.array([float(head_logs[s].sum()) for s in inside], pa.float64()),
                    pa.array(chances[at:at + n], pa.float64()), pa.array(rest, word_type),
                ], names=["kept", "n_tokens", "n_known", "base_score", "score", "rest"])
                at += n

        held, tokens = [], 0
        for part, texts in texts_of(batches):
            found, rest = [], []
            for value in texts:
                words = words_of(value)
                ids = symbols.encode(words)
                others = Counter(words[i] for i in np.flatnonzero((ids >= symbols.head) & (ids < symbols.end)))
                found.append(ids)
                rest.append([{"word": w.decode("utf-8", "replace"), "at": symbols[w] - symbols.head, "n": n} for w, n in others.items()])
                tokens += len(ids)
            held.append((part.drop_columns(["text"]), found, rest))
            if tokens >= batch_tokens:
                yield from flush()
                held, tokens = [], 0
        yield from flush()

    own = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("kept"), F.col(text).alias("text"))
    schema = T.StructType([own.schema["kept"]]).add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add(
        "score", "double"
    ).add("rest", T.ArrayType(T.StructType().add("word", "string").add("at", "integer").add("n", "long")))
    # Stored with a row number, so that the number stays when a task runs again.
    rows = stored(own.mapInArrow(scored, schema).withColumn("_row", F.monotonically_increasing_id()), "scored")
    inside = np.log10(counts.class_n + ADDED * (counts.class_distinct + 1))
    per_class = F.element_at(F.array(*[F.lit(float(x)) for x in inside]), F.col("at") + 1)
    count = F.coalesce(F.col("c"), F.lit(0))
    log_count = F.log10(count + F.lit(ADDED))
    tail = counts.table.filter(F.col("n") < counts.least)
    others = (
        rows.select("_row", F.inline("rest")).join(tail.select("word", F.col("n").alias("c")), "word", "left")
        .groupBy("_row").agg(
            F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("_known"),
            F.sum(F.col("n") * (log_count - F.lit(math.log10(denominator)))).alias("_base"),
            F.sum(F.col("n") * (log_count - per_class)).alias("_score"),
        )
    )
    added = lambda name, more: (F.col(name) + F.coalesce(F.col(more), F.lit(0))).alias(names[name])
    return rows.join(others, "_row", "left").select(
        *[F.col("kept")[c].alias(c) for c in kept], F.col("n_tokens").alias(names["n_tokens"]), added("n_known", "_known"), added("base_score", "_base"), added("score", "_score")
    )


def score_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held_out_part: int = 10, states: int = STATES,
    passes: int = PASSES, head_words: int = HEAD_WORDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Rows whose crc32(doc_id as text) leaves remainder 0 are held out of learning.

    - A null or empty text is the end token alone. A null id has crc32 0 and is held out.
    - Repeated rows are learned from and scored one by one; an empty table gives no rows.
    - Without training rows every base score is 0, and the model spreads evenly over classes and end.
    - Texts of any length are scored whole; other columns of ``docs`` play no part.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), (crc_of_id(doc_id) % held_out_part == 0).alias("held_out")
    )
    training = rows.filter("not held_out").select("text")
    counts = gather_counts(training, head_words=head_words)
    model = train(training, counts, states, passes)
    return score(rows, counts, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
