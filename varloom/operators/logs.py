"""Training and evaluation logs: one row per record with step, epoch and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# The fields a complete training record has.
TRAIN_FIELDS = ["step", "epoch", "loss", "grad_norm", "learning_rate"]


def with_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Records that have every field."""
    for f in fields:
        df = df.filter(F.col(f).isNotNull())
    return df


def eval_records(df: DataFrame) -> DataFrame:
    return with_fields(df, ["eval_loss"])


def train_records(df: DataFrame) -> DataFrame:
    return with_fields(df, ["loss"])


def one_per_step(df: DataFrame, ordinal: str, keep: str = "last", by: Sequence[str] = ("step",)) -> DataFrame:
    """The first or last record of each step in file order; a resumed run overwrites with its last one."""
    rest = [c for c in df.columns if c not in by]
    pick = F.max_by if keep == "last" else F.min_by
    return df.groupBy(*by).agg(pick(F.struct(*rest), ordinal).alias("_row")).select(*by, "_row.*").select(*df.columns)


def prefixed(df: DataFrame, prefix: str = "eval_", keep: Sequence[str] = ("step", "epoch")) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep and not c.startswith(prefix)})


def metric_labels(df: DataFrame, metric: str, labels: Sequence[str], prefix: str = "eval") -> DataFrame:
    """Columns <prefix>_<metric>_<label> as plain labels beside the model name."""
    return df.select("model", *[F.col(f"`{prefix}_{metric}_{l}`").alias(l) for l in labels])


def best_at_step(df: DataFrame, step: int) -> DataFrame:
    return df.filter(F.col("step") == step)


def transpose_models(df: DataFrame, labels: Sequence[str], models: Sequence[str]) -> DataFrame:
    """label x model from model x label, with the row mean to sort by."""
    long = df.unpivot(["model"], list(labels), "label", "value")
    wide = long.groupBy("label").pivot("model", list(models)).agg(F.first("value"))
    return wide.join(long.groupBy("label").agg(F.avg("value").alias("mean")), "label")


def global_cells(df: DataFrame, metrics: Sequence[str], labels: Sequence[str], prefix: str = "eval") -> DataFrame:
    """(model, metric, label, value) cells of a model comparison."""
    columns = {(m, l): f"{prefix}_{m}_{l}" for m in metrics for l in labels}
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(l).alias("label"), F.col(f"`{c}`").alias("value")) for (m, l), c in columns.items()])
    return df.select("model", F.explode(cells).alias("c")).select("model", "c.*")


def threshold_rows(df: DataFrame, metric: str, column: str = "eval_metrics_per_threshold", ordinal: str = "ordinal") -> DataFrame:
    """(step, epoch, threshold, value) from a map threshold -> metrics; the first record of a step counts."""
    first = one_per_step(df, ordinal, "first")
    return first.select("step", "epoch", F.explode(column).alias("threshold", "_m")).select(
        "step", "epoch", "threshold", F.col(f"_m.{metric}").alias("value")
    )
