"""Ranks, empirical p-values, multiple-testing corrections and priors.

The number of tests ``m`` (all of them, or an effective number) is a parameter of the corrections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from varloom.functions.scores import bonferroni, sidak
from varloom.functions.sequence import BASES
from varloom.operators.scale import ROWS_PER_BLOCK, global_row_number, running_totals, skew_join
from varloom.session import cut_lineage

# --- empirical p -------------------------------------------------------------------------------


def empirical_p(
    scores: DataFrame, background: DataFrame, score: str = "score", name: str = "p_value",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """(background with strictly larger |score| + 1) / (background + 1).

    Both sides meet as counts per distinct |score|; one running sum replaces a search per row. A null score has a null p,
    and a null of the background counts for nothing.
    """
    size = F.abs(F.col(score)).alias("_size")
    counts = (
        background.select(size, F.lit(1).alias("_bg"))
        .unionByName(scores.select(size, F.lit(0).alias("_bg")))
        .filter("_size is not null").groupBy("_size").agg(F.sum("_bg").alias("_bg"), F.count_if(F.col("_bg") == 0).alias("_rows"))
    )
    larger = running_totals(counts, ["_size"], {"bg": F.col("_bg")}, descending=True, rows_per_block=rows_per_block)
    total = larger.agg(F.sum("_bg").alias("_total"))
    p = (
        larger.filter("_rows > 0").crossJoin(F.broadcast(total))  # one row
        .select("_size", ((F.col("cum_bg") - F.col("_bg") + 1) / (F.col("_total") + 1)).alias(name))
    )
    sized = scores.withColumn("_size", F.abs(F.col(score)))
    return skew_join(sized, p, ["_size"], "left", counted=larger.select("_size", "_rows")).drop("_size")


# --- multiple testing --------------------------------------------------------------------------


def _step_up(ranked: DataFrame, p: str, threshold: Column) -> DataFrame:
    """Everything up to the largest rank that meets its threshold is significant."""
    marked = ranked.withColumn("bh_threshold", F.when(F.col("rank").isNotNull(), threshold))
    cut = marked.agg(F.max(F.when(F.col(p) <= F.col("bh_threshold"), F.col("rank"))).alias("_cut"))
    return marked.crossJoin(F.broadcast(cut)).withColumn(  # one row
        "significant", F.coalesce(F.col("rank") <= F.col("_cut"), F.lit(False))
    ).drop("_cut")


def _ranked(df: DataFrame, p: str, key: str, rows_per_block: int) -> DataFrame:
    """Rank by p; rows without one have no rank and take no part in the correction."""
    ranked = global_row_number(df.filter(F.col(p).isNotNull()), p, key, rows_per_block=rows_per_block)
    return ranked.unionByName(df.filter(F.col(p).isNull()).withColumn("rank", F.lit(None).cast("long")))


def bh(df: DataFrame, q: float, m: float, p: str = "p_value", key: str = "variant_key", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Step-up procedure with threshold rank / m * q."""
    df = cut_lineage(df)  # rows with a p-value and those without are read apart
    ranked = _ranked(df, p, key, rows_per_block)
    return _step_up(ranked, p, F.col("rank") / F.lit(float(m)) * q)


def bh_meff(df: DataFrame, q: float, m_eff: float, p: str = "p_value", key: str = "variant_key", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Step-up procedure whose threshold climbs from q / m_eff at rank 1 to q at the last rank."""
    df = cut_lineage(df)
    ranked = _ranked(df, p, key, rows_per_block)
    total = df.agg(F.count(p).alias("_total"))
    first = q / m_eff
    share = F.when(F.col("_total") > 1, (F.col("rank") - 1) / F.nullif(F.col("_total") - 1, F.lit(0))).otherwise(0.0)
    return _step_up(ranked.crossJoin(F.broadcast(total)), p, F.lit(first) + share * (q - first)).drop("_total")  # one row


def bonferroni_test(df: DataFrame, q: float, m: float, p: str = "p_value") -> DataFrame:
    return df.withColumn("p_bonferroni", bonferroni(F.col(p), F.lit(float(m)))).withColumn("significant", F.coalesce(F.col(p) <= q / m, F.lit(False)))


def sidak_alpha(q: float, m: float) -> float:
    return 1 - (1 - q) ** (1 / m)


def sidak_test(df: DataFrame, q: float, m: float, p: str = "p_value") -> DataFrame:
    return df.withColumn("p_sidak", sidak(F.col(p), F.lit(float(m)))).withColumn("significant", F.coalesce(F.col(p) <= sidak_alpha(q, m), F.lit(False)))


METHODS = {"bh": bh, "bh_meff": bh_meff, "bonf": bonferroni_test, "sidak": sidak_test}


def multitest(df: DataFrame, method: str, q: float, m: float, p: str = "p_value") -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; use one of {sorted(METHODS)}")
    return METHODS[method](df, q, m, p)


def compare_methods(df: DataFrame, q: float, m: float, show: int = 3, p: str = "p_value", key: str = "variant_key") -> DataFrame:
    """The first ``show`` rows by p under the three corrections side by side."""
    df, frames = cut_lineage(df), []
    for method in ("bh_meff", "bonf", "sidak"):
        tested = multitest(df, method, q, m, p)
        bound = F.col("bh_threshold") if method == "bh_meff" else F.lit(q / m if method == "bonf" else sidak_alpha(q, m))
        frames.append(tested.orderBy(p, key).limit(show).select(F.lit(method).alias("method"), key, p, bound.alias("threshold"), "significant"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def run_metadata(m: int, m_eff: float, q: float, method: str, **extra: str) -> dict[str, str]:
    """Facts about a correction run, stored beside its result."""
    adjusted = {"bonf": q / m_eff, "sidak": sidak_alpha(q, m_eff)}.get(method)
    facts = {**extra, "M": str(m), "q": str(q), "method": method, "M_eff": str(m_eff)}
    return facts if adjusted is None else {**facts, "adjusted_q": str(adjusted)}


# --- priors ------------------------------------------------------------------------------------


def _shared_total(df: DataFrame, weight: Column) -> DataFrame:
    weighted = df.withColumn("_w", weight)
    total = weighted.agg(F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    # A zero total (all weights zero) falls back to equal shares.
    return weighted.crossJoin(F.broadcast(total)).withColumn(  # one row
        "prior", F.when(F.col("_total") == 0, 1.0 / F.col("_rows")).otherwise(F.col("_w") / F.nullif(F.col("_total"), F.lit(0.0)))
    ).drop("_w", "_total", "_rows")


def linear_prior(df: DataFrame, score: str = "Variant") -> DataFrame:
    return _shared_total(df, F.col(score))


def softmax_prior(df: DataFrame, score: str = "Variant") -> DataFrame:
    top = df.agg(F.max(score).alias("_top"))
    return _shared_total(df.crossJoin(F.broadcast(top)), F.exp(F.col(score) - F.col("_top"))).drop("_top")  # one row


def minmax_softmax_prior(df: DataFrame, score: str = "Variant", temperature: float = 0.2) -> DataFrame:
    span = df.agg(F.min(score).alias("_low"), F.max(score).alias("_top"))
    scaled = F.when(F.col("_top") == F.col("_low"), 0.0).otherwise(
        (F.col(score) - F.col("_top")) / F.nullif(F.col("_top") - F.col("_low"), F.lit(0.0))
    )
    return _shared_total(df.crossJoin(F.broadcast(span)), F.exp(scaled / temperature)).drop("_low", "_top")  # one row


PRIORS = {"norm": linear_prior, "softmax": softmax_prior, "minmax_softmax": minmax_softmax_prior}


# --- z-scores ----------------------------------------------------------------------------------


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column minus its mean over its population deviation; a constant column gives null."""
    moments = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return df.crossJoin(F.broadcast(moments)).withColumns({  # one row
        c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns
    }).select(*df.columns)


def z_significant(scored: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(mask per base, rows whose cumulative z exceeds the threshold)."""
    mask = scored.select("pos", *[(F.abs(F.col(b)) > threshold).alias(b) for b in BASES])
    return mask, scored.filter(F.abs(F.col("cumulative")) > threshold)


def threshold_line(df: DataFrame, value: str, t: float) -> DataFrame:
    """Mean + t sample deviations."""
    return df.agg((F.avg(value) + t * F.stddev_samp(value)).alias("threshold"))


# --- linkage -------------------------------------------------------------------------------------


def clean_ld(r: Column) -> Column:
    """Not-a-number and missing -> 0, infinities -> plus or minus 1."""
    return F.when(r.isNull() | F.isnan(r), 0.0).when(r == float("inf"), 1.0).when(r == float("-inf"), -1.0).otherwise(r)


def check_ld_size(ld: DataFrame, scores: DataFrame) -> DataFrame:
    """One row with the number of variants in both; an error when they differ."""
    sides = ld.agg(F.countDistinct("block", "i").alias("n_ld")).crossJoin(scores.agg(F.count(F.lit(1)).alias("n_scores")))  # one row each
    message = F.concat(F.lit("LD matrix has "), F.col("n_ld").cast("string"), F.lit(" variants, scores have "), F.col("n_scores").cast("string"))
    return sides.filter(F.when(F.col("n_ld") == F.col("n_scores"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
