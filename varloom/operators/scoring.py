"""From sequences to probabilities, from probabilities to effect scores, and reports on scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from varloom.functions.naming import position_id
from varloom.functions.scores import EFFECTS, sigmoid
from varloom.functions.sequence import BASES
from varloom.operators.kmer_track import KmerModel, letter_spans, letters_of
from varloom.operators.scale import global_row_number, lookup_join, skew_join

# --- probabilities -----------------------------------------------------------------------------


def _predictions(model: Callable[[list[str]], np.ndarray], seqs: list[str], batch: int, logits: bool) -> np.ndarray:
    """A row per sequence; the model sees at most ``batch`` of them at a time."""
    parts = [np.asarray(model(seqs[at:at + batch]), dtype=float) for at in range(0, len(seqs), batch)]
    out = np.concatenate(parts)
    if len(out) != len(seqs):
        raise ValueError(f"the model returned {len(out)} rows for {len(seqs)} sequences")
    return 1 / (1 + np.exp(-out)) if logits else out


def _lists(values: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """One list per row of a matrix, null where ``missing``."""
    rows, features = values.shape
    ends = np.arange(0, (rows + 1) * features, features, dtype=np.int32) if features else np.zeros(rows + 1, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
    return lists if missing is None else pc.if_else(pa.array(missing), pa.scalar(None, lists.type), lists)


def score_sequences(
    df: DataFrame, model: Callable[[list[str]], np.ndarray], features: Sequence[str], seq: str = "seq",
    batch: int = 32, logits: bool = True,
) -> DataFrame:
    """Run a user model over batches of sequences inside the tasks; all input columns are kept.

    ``model`` maps a list of strings to an array (rows, features); logits are passed through a sigmoid.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(f, T.DoubleType()) for f in features]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                out = _predictions(model, rows.column(seq).to_pylist(), batch, logits)
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(out[:, i]) for i in range(len(features))]], names=schema.names)

    return df.mapInArrow(run, schema)


_Table = tuple[str, np.ndarray]


def _kmer_table(weights: DataFrame, features: Sequence[str], k: int) -> _Table:
    """The alphabet of the k-mers, and a row of weights per feature, indexed by the k-mer read as a number.

    ``weights`` has a column kmer and one per feature, at most alphabet ** k rows.
    """
    model = KmerModel.of(weights, features, k)
    return model.alphabet, model.weights


def _kmer_logits(seqs: pa.Array, known: _Table, k: int) -> pa.Array:
    """Summed weights of each sequence's k-mers as a list by feature, null for a null sequence.

    K-mers with letters that the model does not know add nothing. Weights are added from left to right.
    """
    alphabet, weights = known
    place = np.full(max(map(ord, alphabet), default=0) + 257, -1)  # the last one stands for all letters behind it
    place[[*map(ord, alphabet)]] = np.arange(len(alphabet))
    out = np.zeros((len(seqs), len(weights)))
    for begin, stop in letter_spans(pc.fill_null(pc.binary_length(seqs), 0).to_numpy()):
        own = seqs.slice(begin, stop - begin)
        if alphabet.isascii():
            letters, ends = letters_of(own)
        else:
            sizes = pc.fill_null(pc.utf8_length(own), 0).to_numpy()
            letters, ends = np.frombuffer("".join(s or "" for s in own.to_pylist()).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])
        digits = place[np.minimum(letters.astype(np.int64), len(place) - 1)]
        count = len(digits) - k + 1
        if count < 1:
            continue
        numbers, fits = np.zeros(count, np.int64), np.ones(count, bool)
        for j in range(k):
            digit = digits[j:j + count]
            numbers, fits = numbers * len(alphabet) + digit, fits & (digit >= 0)
        owner = np.repeat(np.arange(begin, stop), np.diff(ends))
        fits &= owner[:count] == owner[k - 1:]
        numbers, owner = numbers[fits], owner[:count][fits]
        for i, weight in enumerate(weights):
            out[begin:stop, i] = np.bincount(owner - begin, weight[numbers], stop - begin)
    return _lists(out, pc.is_null(seqs).to_numpy(zero_copy_only=False) if seqs.null_count else None)


def score_kmers(
    df: DataFrame, weights: DataFrame, features: Sequence[str], k: int, key: str = "variant_key", seq: str = "seq"
) -> DataFrame:
    """Linear k-mer model: sigmoid of the summed weights of a sequence's k-mers. Rows are scored by themselves."""
    known = _kmer_table(weights, features, k)
    asked = df.select(F.col(key).alias("key"), F.col(seq).cast("string").alias("seq"))
    schema = T.StructType([T.StructField("key", asked.schema["key"].dataType), T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column("key"), _kmer_logits(rows.column("seq"), known, k)], names=schema.names)

    scored = asked.mapInArrow(run, schema)
    return scored.select(F.col("key").alias(key), *[sigmoid(F.col("logits")[i]).alias(f) for i, f in enumerate(features)])


def score_kmer_pairs(
    df: DataFrame, weights: DataFrame, features: Sequence[str], k: int, key: str = "variant_key"
) -> DataFrame:
    """Long (key, feature, p_ref, p_alt) of the k-mer model for windows with ref_seq and alt_seq; nothing is shuffled."""
    known = _kmer_table(weights, features, k)
    return _scored_pairs(df, lambda seqs: _kmer_logits(seqs, known, k), features, key, sigmoid)


def _scored_pairs(
    df: DataFrame, score: Callable[[pa.Array], pa.Array], features: Sequence[str], key: str, shown: Callable[[Column], Column] = lambda c: c,
) -> DataFrame:
    """Long (key, feature, p_ref, p_alt); ``score`` gives a list by feature for each sequence of a batch."""
    asked = df.select(F.col(key).alias("key"), "ref_seq", "alt_seq")
    schema = T.StructType([T.StructField("key", asked.schema["key"].dataType), *[T.StructField(s, T.ArrayType(T.DoubleType())) for s in ("ref", "alt")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([rows.column("key"), score(rows.column("ref_seq")), score(rows.column("alt_seq"))], names=schema.names)

    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), shown(F.col("ref")[i]).alias("p_ref"), shown(F.col("alt")[i]).alias("p_alt")) for i, f in enumerate(features)
    ])
    return asked.mapInArrow(run, schema).select(F.col("key").alias(key), F.explode(rows).alias("_r")).select(f"`{key}`", "_r.*")


def score_ref_alt(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], key: str = "variant_key") -> DataFrame:
    """Long (key, feature, p_ref, p_alt) from windows with ref_seq and alt_seq."""
    both = df.select(key, F.explode(F.array(
        F.struct(F.lit("ref").alias("side"), F.col("ref_seq").alias("seq")),
        F.struct(F.lit("alt").alias("side"), F.col("alt_seq").alias("seq")),
    )).alias("_s")).select(F.struct(key, "_s.side").alias("_key"), "_s.seq")
    scored = scorer(both)
    features = [c for c in scored.columns if c not in ("_key", "seq")]
    side = lambda f, name: F.max(F.when(F.col("_key.side") == name, F.col(f))).alias(f"p_{name}")
    # Both sides meet in one wide row; the long rows are made after the shuffle.
    paired = scored.groupBy(F.col(f"_key.{key}").alias(key)).agg(*[F.struct(side(f, "ref"), side(f, "alt")).alias(f) for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.p_ref"), F.col(f"{f}.p_alt")) for f in features])
    return paired.select(key, F.explode(rows).alias("_r")).select(key, "_r.*")


def score_pairs(
    df: DataFrame, model: Callable[[list[str]], np.ndarray], features: Sequence[str], key: str = "variant_key", batch: int = 32, logits: bool = True,
) -> DataFrame:
    """Long (key, feature, p_ref, p_alt) with a user model that sees both sides of a row in one task; no shuffle."""
    return _scored_pairs(df, lambda seqs: _lists(_predictions(model, seqs.to_pylist(), batch, logits)), features, key)


def pair_probabilities(ref: DataFrame, alt: DataFrame, features: Sequence[str], key: str = "variant_key") -> DataFrame:
    """Long (key, feature, p_ref, p_alt) from two wide tables of the same variants, matched by key."""
    wide = lambda df, side: df.select(key, F.struct(*features).alias(side))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_ref.{f}").alias("p_ref"), F.col(f"_alt.{f}").alias("p_alt")) for f in features])
    return bind(wide(ref, "_ref"), wide(alt, "_alt"), key).select(key, F.explode(rows).alias("_r")).select(key, "_r.*")


# --- effect scores -----------------------------------------------------------------------------


def effect_scores(probabilities: DataFrame, method: str = "log_odds", eps: float | None = None) -> DataFrame:
    """Long scores from (key, feature, p_ref, p_alt)."""
    fn = EFFECTS[method]
    args = (F.col("p_alt"), F.col("p_ref"))
    return probabilities.withColumn("score", fn(*args, eps) if method == "log_odds" else fn(*args))


def row_scores(df: DataFrame, ref: str = "p_ref", alt: str = "p_alt", method: str = "log_odds", name: str = "Variant") -> DataFrame:
    """Effect scores of rows that hold all features as arrays, with the overall score; nothing is shuffled."""
    scores = F.zip_with(alt, ref, lambda a, r: EFFECTS[method](a, r))
    squares = F.aggregate("scores", F.lit(0.0), lambda total, s: total + s * s)
    return df.withColumn("scores", scores).withColumn(name, F.sqrt(squares))


def overall_scores(scores: DataFrame, key: str = "variant_key", name: str = "Variant") -> DataFrame:
    """Euclidean norm over the features of each variant."""
    return scores.groupBy(key).agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias(name))


def score_matrix(scores: DataFrame, features: Sequence[str], key: str = "variant_key", name: str = "Variant") -> DataFrame:
    """Wide scores, one column per feature, and the overall score, in one aggregation."""
    return scores.groupBy(key).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("score"))).alias(f) for f in features],
        F.sqrt(F.sum(F.col("score") * F.col("score"))).alias(name),
    )


def bind(left: DataFrame, right: DataFrame, key: str = "variant_key") -> DataFrame:
    """Match two files of the same variants by key, never by row order; a missing partner is an error."""
    paired = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full_outer")
    lost = F.raise_error(F.concat(F.lit("no partner for key "), F.col(key).cast("string")))
    return paired.filter(
        F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit(True)).otherwise(lost.cast("boolean"))
    ).drop("_l", "_r")


# --- ranking and thresholds ----------------------------------------------------------------------


def threshold_of(thresholds: DataFrame, level: float, feature: str | None = None) -> float:
    """The one score threshold for a significance level; none or several is an error."""
    match = F.round(F.col("significance_lvl"), 6) == round(level, 6)
    if feature is not None:
        match &= F.col("feature") == feature
    found = [r["score"] for r in thresholds.filter(match).select("score").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} threshold for level {level}")
    return found[0]


def rank_variants(
    df: DataFrame, metric: str, top: int | None = None, min_score: float | None = None,
    positions: DataFrame | None = None, key: str = "variant_key", by: Sequence[str] = ("chrom", "pos"),
) -> DataFrame:
    """Variants by falling metric. A top-n cut comes before the position list; a threshold is signed."""
    if top is not None and min_score is not None:
        raise ValueError("choose either a top count or a threshold")
    ordered = df.orderBy(F.col(metric).desc(), key)
    if top is not None:
        ordered = ordered.limit(top)
    if min_score is not None:
        ordered = ordered.filter(F.col(metric) >= min_score)
    if positions is not None:
        ordered = skew_join(ordered, positions.select(*by).distinct(), list(by)).orderBy(F.col(metric).desc(), key)
    return ordered


def numbered_ranking(df: DataFrame, metric: str, key: str = "variant_key") -> DataFrame:
    """The whole ranking with explicit ranks."""
    return global_row_number(df, metric, key, descending=True)


def significance_mask(df: DataFrame, columns: Sequence[str], threshold: float, keep: Sequence[str] = ("pos",)) -> DataFrame:
    return df.select(*keep, *[(F.abs(F.col(c)) >= threshold).alias(c) for c in columns])


def per_feature_hits(scores: DataFrame, thresholds: DataFrame, level: float, key: str = "variant_key") -> DataFrame:
    """Long rows whose |score| reaches the feature's threshold at ``level``; exactly one threshold per feature."""
    chosen = thresholds.filter(F.round(F.col("significance_lvl"), 6) == round(level, 6))
    one = F.raise_error(F.concat(F.lit("thresholds are not unique for "), F.col("feature")))
    unique = chosen.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"), F.max("score").alias("_threshold")).filter(
        F.when(F.col("_n") == 1, F.lit(True)).otherwise(one.cast("boolean"))
    ).drop("_n")
    return lookup_join(scores, unique, ["feature"]).filter(F.abs("score") >= F.col("_threshold")).select("feature", key, "score")


def feature_impact(scores: DataFrame) -> DataFrame:
    """Mean and largest |score| per feature."""
    return scores.groupBy("feature").agg(F.avg(F.abs("score")).alias("mean_abs"), F.max(F.abs("score")).alias("max_abs"))


# --- saturation mutagenesis ----------------------------------------------------------------------


def mutagenesis_matrix(df: DataFrame, metric: str = "score") -> DataFrame:
    """One row per position with the score of each alternate base, their sum and the largest effect."""
    wide = df.groupBy("chrom", "pos", "ref").agg(*[F.max(F.when(F.col("alt") == b, F.col(metric))).alias(b) for b in BASES])
    total = sum((F.coalesce(F.col(b), F.lit(0.0)) for b in BASES[1:]), F.coalesce(F.col(BASES[0]), F.lit(0.0)))
    return wide.select(
        position_id(F.col("chrom"), F.col("pos")).alias("id"), "chrom", "pos", "ref", *BASES,
        total.alias("cumulative"), F.greatest(*[F.abs(F.col(b)) for b in BASES]).alias("max_effect"),
    )


def significant_positions(matrix: DataFrame, threshold: float) -> DataFrame:
    return matrix.filter(F.col("max_effect") >= threshold)


def mutagenesis_cells(matrix: DataFrame, threshold: float) -> DataFrame:
    """Heat-map cells: position, base, score and whether |score| reaches the threshold."""
    return matrix.unpivot(["chrom", "pos", "ref"], BASES, "base", "score").withColumn("significant", F.abs("score") >= threshold)


def effect_line(matrix: DataFrame, threshold: float) -> DataFrame:
    """Largest effect per position beside the threshold line."""
    return matrix.select("chrom", "pos", "max_effect", F.lit(threshold).alias("threshold"), (F.col("max_effect") >= threshold).alias("above"))
