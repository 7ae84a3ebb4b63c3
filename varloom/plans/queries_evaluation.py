"""Queries on classifier evaluation and training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import evaluate, logs
from varloom.plans.inputs import EVENT_TYPES, FEATURES, evaluations, event_evaluations, r6, table
from varloom.plans.registry import query, view
from varloom.sources.readers import parse_json_log

view("score_counts", """
  SELECT label, p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM event_evaluations GROUP BY label, p""")
view("cumulative", """
  SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, row_number() OVER w AS point,
         sum(pos) OVER (PARTITION BY label) AS n_pos, sum(neg) OVER (PARTITION BY label) AS n_neg,
         lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg FROM score_counts WINDOW w AS (PARTITION BY label ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
view("roc", """
  SELECT label, p AS threshold, fp / n_neg AS fpr, tp / n_pos AS tpr FROM cumulative WHERE point = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
  UNION ALL SELECT DISTINCT label, NULL, 0, 0 FROM event_evaluations""")


def _points(df, columns):
    return df.select("label", *[r6(F.col(c)).alias(c) for c in columns])


@query("SELECT label, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc")
def roc_curve(spark, sf):
    return _points(evaluate.roc_curve(event_evaluations(spark, sf)), ["threshold", "fpr", "tpr"])


@query("""
  SELECT label, round(p, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / n_pos, 6) AS recall FROM cumulative
  UNION ALL SELECT DISTINCT label, NULL, 1, 0 FROM event_evaluations""")
def pr_curve(spark, sf):
    return _points(evaluate.pr_curve(event_evaluations(spark, sf)), ["threshold", "precision", "recall"])


def _areas_sql(counts: str) -> str:
    return f"""
  SELECT label, sum(neg / n_neg * (tp - pos + tp) / 2 / n_pos) AS auroc,
         sum(pos / n_pos * (tp / (tp + fp) + coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0), 1)) / 2) AS auprc_trapz, sum(pos / n_pos * tp / (tp + fp)) AS average_precision
  FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY label) AS n_pos, sum(neg) OVER (PARTITION BY label) AS n_neg
        FROM (SELECT label, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {counts} GROUP BY label, p) WINDOW w AS (PARTITION BY label ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
  GROUP BY label"""


view("event_areas", _areas_sql("event_evaluations"))
view("vector_areas", _areas_sql("evaluations"))
view("micro_areas", _areas_sql("(SELECT 'micro' AS label, p, y FROM evaluations)"))
_AREAS = ["auroc", "auprc_trapz", "average_precision"]


@query("SELECT label, round(auroc, 6) AS auroc, round(auprc_trapz, 6) AS auprc_trapz, round(average_precision, 6) AS average_precision FROM event_areas")
def curve_areas(spark, sf):
    return _points(evaluate.curve_areas(event_evaluations(spark, sf)), _AREAS)


@query("SELECT label, round(auroc, 6) AS auroc, round(auprc_trapz, 6) AS auprc_trapz, round(average_precision, 6) AS average_precision FROM vector_areas")
def feature_curve_areas(spark, sf):
    return _points(evaluate.curve_areas(evaluations(spark, sf)), _AREAS)


@query("""
  SELECT (SELECT round(avg(auroc), 6) FROM vector_areas) AS auroc_macro, (SELECT round(avg(average_precision), 6) FROM vector_areas) AS auprc_macro,
         (SELECT round(auroc, 6) FROM micro_areas) AS auroc_micro, (SELECT round(average_precision, 6) FROM micro_areas) AS auprc_micro,
         (SELECT round(avg(y), 6) FROM evaluations) AS micro_auprc_baseline""")
def summary_metrics(spark, sf):
    m = evaluate.summary_metrics(evaluations(spark, sf))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


@query("SELECT label, round(auroc, 6) AS area FROM event_areas")
def trapezoid_of_roc(spark, sf):
    area = evaluate.trapezoid(evaluate.roc_curve(event_evaluations(spark, sf)), "fpr", "tpr")
    return area.withColumn("area", r6(F.col("area")))


@query("""
  SELECT label, round(sum((p - prev_p) * (n + prev_n) / 2.0), 6) AS area FROM (
    SELECT label, p, n, lag(p) OVER w AS prev_p, lag(n) OVER w AS prev_n FROM (SELECT label, p, count(*) AS n FROM event_evaluations GROUP BY label, p) WINDOW w AS (PARTITION BY label ORDER BY p))
  GROUP BY label""")
def trapezoid_area(spark, sf):
    points = event_evaluations(spark, sf).groupBy("label", "p").agg(F.count(F.lit(1)).alias("n"))
    return evaluate.trapezoid(points, "p", "n").withColumn("area", r6(F.col("area")))


@query("""
  WITH numbered AS (SELECT label, p, row_number() OVER (PARTITION BY label ORDER BY p DESC) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM score_counts)
  SELECT DISTINCT c.label, round(c.p, 6) AS p FROM numbered c, range(100) t(j) WHERE c.i = j * (c.n - 1) // 99""")
def thinned_curve(spark, sf):
    points = evaluate.cumulative_counts(event_evaluations(spark, sf)).select("label", "p")
    return evaluate.thin_curve(points, "p", 100).select("label", r6(F.col("p")).alias("p"))


@query("""
  WITH c AS (SELECT label, count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp,
             count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS tn, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn FROM evaluations GROUP BY label)
  SELECT 0.5::DOUBLE AS threshold, label, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
         round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
         round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) + 0.0 AS mcc,
         CAST(tp + fn AS BIGINT) AS pos_cnt, CAST(tn + fp AS BIGINT) AS neg_cnt, CAST(tp + fp + tn + fn AS BIGINT) AS tot_cnt FROM c""")
def threshold_metrics(spark, sf):
    m = evaluate.threshold_metrics(evaluations(spark, sf), 0.5)
    return m.withColumns({c: r6(F.col(c)) for c in ("accuracy", "precision", "recall", "f1", "mcc")})


@query("SELECT label, round(100.0 * count(*) FILTER ((p >= 0.5) = (y = 1)) / count(*), 6) AS accuracy FROM evaluations GROUP BY label")
def accuracy_percent(spark, sf):
    scored = table(spark, sf, "embeddings")
    logits = scored.select("vec_id", *[F.col("embedding")[i].alias(f) for i, f in enumerate(FEATURES)])
    marks = scored.select("vec_id", *[(F.col("embedding")[24 + i] > 0).alias(f) for i, f in enumerate(FEATURES)])
    rows = evaluate.evaluation_rows(evaluate.with_labels(logits, marks, FEATURES, "vec_id"), FEATURES)
    return evaluate.metric_table(evaluate.threshold_metrics(rows), "accuracy").withColumn("accuracy", r6(F.col("accuracy")))


@query("""
  SELECT label, round(avg(loss), 6) AS loss, round(sum(loss), 4) AS total_loss, count(*) AS elements
  FROM (SELECT label, greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit))) AS loss FROM evaluations) GROUP BY label""")
def bce_loss(spark, sf):
    return evaluate.bce_loss(evaluations(spark, sf)).select("label", r6(F.col("loss")).alias("loss"), F.round("total_loss", 4).alias("total_loss"), "elements")


# --- logs --------------------------------------------------------------------------------------

_SCHEMA = (
    "step long, epoch double, loss double, grad_norm double, learning_rate double, eval_loss double, f1 double, "
    "eval_metrics_per_threshold map<string, struct<f1: double, recall: double>>"
)
view("log", """
  SELECT event_id AS ordinal, event_id % 200 * 50 AS step, event_id % 200 * 50 / 1000::DOUBLE AS epoch,
         CASE WHEN event_type <> 'error' THEN value END AS loss, CASE WHEN event_type = 'view' THEN value / 7 END AS grad_norm, CASE WHEN event_type <> 'click' THEN 0.001::DOUBLE END AS learning_rate,
         CASE WHEN event_type IN ('view', 'click') THEN value / 3 END AS eval_loss, value / 1000 AS f1 FROM events""")


def _log(spark, sf):
    """Records as JSON text, parsed back by the reader."""
    kind, value, step = F.col("event_type"), F.col("value"), F.col("event_id") % 200 * 50
    record = F.struct(
        step.alias("step"), (step / F.lit(1000.0)).alias("epoch"), F.when(kind != "error", value).alias("loss"),
        F.when(kind == "view", value / 7).alias("grad_norm"), F.when(kind != "click", F.lit(0.001)).alias("learning_rate"),
        F.when(kind.isin("view", "click"), value / 3).alias("eval_loss"), (value / 1000).alias("f1"),
        F.create_map(
            F.lit("0.5"), F.struct((value / 500).alias("f1"), (value / 600).alias("recall")),
            F.lit("0.7"), F.struct((value / 700).alias("f1"), (value / 800).alias("recall")),
        ).alias("eval_metrics_per_threshold"),
    )
    lines = table(spark, sf, "events").select(F.col("event_id").alias("ordinal"), F.to_json(record).alias("value"))
    return parse_json_log(lines, _SCHEMA)


_METRICS = ["loss", "eval_loss", "f1"]


def _logged(df, columns):
    return df.select("step", "epoch", *[r6(F.col(c)).alias(c) for c in columns])


_ROUNDED = "step, epoch, round(loss, 6) AS loss, round(eval_loss, 6) AS eval_loss, round(f1, 6) AS f1"


@query(f"SELECT {_ROUNDED} FROM log WHERE eval_loss IS NOT NULL QUALIFY row_number() OVER (PARTITION BY step ORDER BY ordinal DESC) = 1")
def last_evaluation_per_step(spark, sf):
    return _logged(logs.one_per_step(logs.eval_records(_log(spark, sf)), "ordinal"), _METRICS)


@query(f"SELECT {_ROUNDED} FROM log WHERE loss IS NOT NULL QUALIFY row_number() OVER (PARTITION BY step ORDER BY ordinal) = 1")
def first_training_per_step(spark, sf):
    return _logged(logs.one_per_step(logs.train_records(_log(spark, sf)), "ordinal", "first"), _METRICS)


@query("SELECT ordinal, step, round(loss, 6) AS loss, round(grad_norm, 6) AS grad_norm FROM log WHERE loss IS NOT NULL AND grad_norm IS NOT NULL AND learning_rate IS NOT NULL")
def complete_training_records(spark, sf):
    return logs.with_fields(_log(spark, sf), logs.TRAIN_FIELDS).select("ordinal", "step", r6(F.col("loss")).alias("loss"), r6(F.col("grad_norm")).alias("grad_norm"))


@query("SELECT step, epoch, round(eval_loss, 6) AS eval_loss, round(f1, 6) AS eval_f1 FROM log WHERE eval_loss IS NOT NULL AND step = 500 QUALIFY row_number() OVER (PARTITION BY step ORDER BY ordinal DESC) = 1")
def best_step(spark, sf):
    records = logs.one_per_step(logs.eval_records(_log(spark, sf)), "ordinal").select("step", "epoch", "eval_loss", "f1")
    return _logged(logs.best_at_step(logs.prefixed(records), 500), ["eval_loss", "eval_f1"])


@query("""
  WITH first AS (SELECT event_id % 200 * 50 AS step, event_id % 200 * 50 / 1000::DOUBLE AS epoch, value FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 200 ORDER BY event_id) = 1)
  SELECT step, epoch, '0.5' AS threshold, round(value / 500, 6) AS value FROM first UNION ALL SELECT step, epoch, '0.7', round(value / 700, 6) FROM first""")
def threshold_rows(spark, sf):
    return logs.threshold_rows(_log(spark, sf), "f1").withColumn("value", r6(F.col("value")))


def _models(spark, sf):
    """One row per model (event type) with the areas of its features as wide metric columns."""
    e = table(spark, sf, "events")
    label = lambda l, m: F.avg(F.when(F.col("user_id") % 3 == l, F.col("value") / m))
    return e.groupBy(F.col("event_type").alias("model")).agg(
        *[label(l, m).alias(f"eval_{name}_L{l}") for l in range(3) for name, m in (("auroc", 600), ("auprc", 700))]
    )


view("model_cells", """
  SELECT event_type AS model, m.metric, 'L' || (user_id % 3) AS label, avg(value / m.d) AS value FROM events, (VALUES ('auroc', 600), ('auprc', 700)) m(metric, d) GROUP BY ALL""")


@query("SELECT label, " + ", ".join(f"round(max(value) FILTER (model = '{m}'), 6) AS {m}" for m in EVENT_TYPES) + ", round(avg(value), 6) AS mean FROM model_cells WHERE metric = 'auroc' GROUP BY label")
def label_model_table(spark, sf):
    labels = ["L0", "L1", "L2"]
    t = logs.transpose_models(logs.metric_labels(_models(spark, sf), "auroc", labels), labels, EVENT_TYPES)
    return t.select("label", *[r6(F.col(c)).alias(c) for c in [*EVENT_TYPES, "mean"]])


@query("SELECT model, metric, label, round(value, 6) AS value FROM model_cells")
def model_metric_cells(spark, sf):
    return logs.global_cells(_models(spark, sf), ["auroc", "auprc"], ["L0", "L1", "L2"]).withColumn("value", r6(F.col("value")))
