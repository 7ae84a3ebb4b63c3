"""Classifier evaluation on long rows (label, p, y): curves, areas and thresholded metrics.

All curve work runs on counts per distinct score, and every area is a plain sum over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from varloom.functions.scores import bce_with_logits, sigmoid
from varloom.operators.scale import ROWS_PER_BLOCK, match, neighbour, running_totals


def evaluation_rows(df: DataFrame, features: Sequence[str], logits: str = "logits", labels: str = "labels") -> DataFrame:
    """(label, logit, p, y) from array columns in feature order."""
    cells = F.array(*[
        F.struct(F.lit(f).alias("label"), F.col(logits)[i].cast("double").alias("logit"), F.col(labels)[i].cast("int").alias("y"))
        for i, f in enumerate(features)
    ])
    return df.select(F.explode(cells).alias("c")).select("c.*").withColumn("p", sigmoid(F.col("logit")))


def with_labels(scored: DataFrame, labels: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """Model outputs beside the labels of the same rows, as arrays in feature order (key, logits, labels)."""
    array = lambda df, name, kind: df.select(key, F.array(*[F.col(f).cast(kind) for f in features]).alias(name))
    return array(scored, "logits", "double").join(array(labels, "labels", "int"), key)


def flattened(df: DataFrame, name: str = "micro") -> DataFrame:
    """All labels as one, for micro averages."""
    return df.withColumn("label", F.lit(name))


def cumulative_counts(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per label and distinct score: counts, running true and false positives by falling score, and class totals."""
    counts = df.groupBy("label", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    totals = counts.groupBy("label").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    running = running_totals(
        counts, ["p"], {"pos": F.col("pos"), "neg": F.col("neg"), "points": F.lit(1)}, ["label"], True, rows_per_block
    )
    return match(running, totals, ["label"]).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp", "cum_points": "point"})


def roc_curve(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(label, threshold, fpr, tpr) from (0, 0), which has no threshold, on; without points inside a straight line."""
    counted = neighbour(cumulative_counts(df, rows_per_block), "p", ["pos", "neg"], "_next", ["label"], True, True, rows_per_block)
    bends = (F.col("point") == 1) | F.col("_next").isNull() | (F.col("_next.pos") != F.col("pos")) | (F.col("_next.neg") != F.col("neg"))
    points = counted.filter(bends).select(
        "label", F.col("p").alias("threshold"),
        (F.col("fp") / F.nullif(F.col("n_neg"), F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif(F.col("n_pos"), F.lit(0))).alias("tpr"),
    )
    start = df.select("label").distinct().select("label", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_curve(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(label, threshold, precision, recall) per distinct score and the closing point (1, 0)."""
    points = cumulative_counts(df, rows_per_block).select(
        "label", F.col("p").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.col("tp") / F.nullif(F.col("n_pos"), F.lit(0)), F.lit(1.0)).alias("recall"),
    )
    end = df.select("label").distinct().select("label", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def curve_areas(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per label: area under ROC, area under PR by trapezoids, and average precision (step sum).

    The point before a score is its running counts minus its own, so no neighbour is looked up.
    """
    c = cumulative_counts(df, rows_per_block)
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(tp0 + fp0 > 0, tp0 / F.nullif(tp0 + fp0, F.lit(0))).otherwise(1.0)
    gain = F.col("pos") / F.nullif(F.col("n_pos"), F.lit(0))
    return c.groupBy("label").agg(
        F.sum(F.col("neg") / F.nullif(F.col("n_neg"), F.lit(0)) * (tp0 + F.col("tp")) / 2 / F.nullif(F.col("n_pos"), F.lit(0))).alias("auroc"),
        F.sum(gain * (precision + before) / 2).alias("auprc_trapz"),
        F.sum(gain * precision).alias("average_precision"),
    )


def trapezoid(points: DataFrame, x: str, y: str, keys: Sequence[str] = ("label",), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Area under (x, y) points in the order of x.

    Several points of one x are a vertical step that rises, like in a ROC curve: the way comes in at the least y and
    leaves at the largest.
    """
    steps = points.groupBy(*keys, x).agg(F.min(y).alias("_in"), F.max(y).alias("_out"))
    stepped = neighbour(steps, x, [x, "_out"], "_prev", keys, following=False, rows_per_block=rows_per_block)
    return stepped.groupBy(*keys).agg(F.coalesce(
        F.sum((F.col(x) - F.col(f"_prev.{x}")) * (F.col("_in") + F.col("_prev._out")) / 2), F.lit(0.0)
    ).alias("area"))


def thin_curve(points: DataFrame, x: str, max_points: int = 2000, keys: Sequence[str] = ("label",), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """At most ``max_points`` points per curve at evenly spaced indices, first and last included."""
    keys = list(keys)
    indexed = running_totals(points, [x], {"points": F.lit(1)}, keys, True, rows_per_block)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    i, steps = F.col("cum_points") - 1, max_points - 1
    # Index i is taken when some j has floor(j * (n - 1) / steps) = i.
    j = F.ceil(i * steps / F.greatest(F.col("_n") - 1, F.lit(1)))
    taken = F.floor(j * (F.col("_n") - 1) / steps) == i
    return indexed.join(sizes, keys).filter((F.col("_n") <= max_points) | taken).drop("cum_points", "_n")


def threshold_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and correlation at p >= threshold; null for a label with one class only."""
    hit = F.col("p") >= threshold
    count = lambda condition: F.count_if(condition).cast("double")
    c = df.groupBy("label").agg(
        count(hit & (F.col("y") == 1)).alias("tp"), count(hit & (F.col("y") == 0)).alias("fp"),
        count(~hit & (F.col("y") == 0)).alias("tn"), count(~hit & (F.col("y") == 1)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0.0)))
    scored = (tp + fn > 0) & (tn + fp > 0)
    metrics = {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }
    return c.select(
        F.lit(threshold).alias("threshold"), "label", *[F.when(scored, m).alias(n) for n, m in metrics.items()],
        (tp + fn).cast("long").alias("pos_cnt"), (tn + fp).cast("long").alias("neg_cnt"), (tp + fp + tn + fn).cast("long").alias("tot_cnt"),
    )


def metric_table(metrics: DataFrame, metric: str) -> DataFrame:
    """One metric in percent per label, the best first."""
    return metrics.select("label", (F.col(metric) * 100).alias(metric)).orderBy(F.col(metric).desc_nulls_last(), "label")


def summary_metrics(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Macro and micro AUROC and average precision, and the micro baseline; null macro when a label lacks a class."""
    per_label = curve_areas(df, rows_per_block)
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))
    macro = per_label.agg(whole("auroc").alias("auroc_macro"), whole("average_precision").alias("auprc_macro"))
    micro = curve_areas(flattened(df), rows_per_block).select(
        F.col("auroc").alias("auroc_micro"), F.col("average_precision").alias("auprc_micro")
    )
    baseline = df.agg(F.avg("y").alias("micro_auprc_baseline"))
    return macro.crossJoin(micro).crossJoin(baseline)  # one row each


def bce_loss(df: DataFrame, group: Sequence[str] = ("label",)) -> DataFrame:
    loss = bce_with_logits(F.col("logit"), F.col("y"))
    return df.groupBy(*group).agg(F.avg(loss).alias("loss"), F.sum(loss).alias("total_loss"), F.count(F.lit(1)).alias("elements"))


def masked_token_metrics(df: DataFrame) -> DataFrame:
    """Accuracy, mean loss and perplexity over predicted tokens (label, predicted, loss) with a label."""
    return df.filter(F.col("label") != -100).agg(
        F.count(F.lit(1)).alias("tokens"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"),
        F.avg("loss").alias("loss"), F.exp(F.avg("loss")).alias("perplexity"),
    )
