"""Column functions on probabilities and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_INF = float("inf")


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def diff(alt: Column, ref: Column) -> Column:
    return alt - ref


def abs_diff(alt: Column, ref: Column) -> Column:
    return F.abs(alt - ref)


def logit(p: Column) -> Column:
    """ln(p / (1 - p)) with signed infinity at 0 and 1."""
    inner = F.when((p > 0) & (p < 1), p).otherwise(0.5)
    return F.when(p <= 0, F.lit(-_INF)).when(p >= 1, F.lit(_INF)).otherwise(F.ln(inner / (1 - inner)))


def log_odds(alt: Column, ref: Column, eps: float | None = None) -> Column:
    if eps is not None:
        alt, ref = [F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)) for p in (alt, ref)]
    return logit(alt) - logit(ref)


EFFECTS = {"diff": diff, "abs_diff": abs_diff, "log_odds": log_odds}


def l2_norm(scores: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [s * s for s in scores]))


def bce_with_logits(x: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that does not overflow."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def bonferroni(p: Column, m: float | Column) -> Column:
    return F.least(p * m, F.lit(1.0))


def sidak(p: Column, m: float | Column) -> Column:
    return 1 - F.pow(1 - p, m)
