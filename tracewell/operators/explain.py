"""Attributions of linear scores: per-column contributions, ranks, residuals, reconciliation, drivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import scoring

TOLERANCE = 1e-6


def attribute(rows: DataFrame, coefficients: DataFrame, key: str = "prediction_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Tall attributions from encoded rows.

    ``rows``: key and x (array of encoded values). ``coefficients``: pos (from 0), coefficient, mean, one small table
    that Spark broadcasts. Contribution: coefficient * (x - mean). abs_rank: by size, ties by position; a prediction's
    columns are one row's array, so ranking needs no shuffle. ``keep``: more columns of ``rows`` that its parts carry.
    """
    table = coefficients.agg(F.array_sort(F.collect_list(F.struct("pos", "coefficient", "mean"))).alias("c"))
    one = rows.join(F.broadcast(table))  # a single row of as many entries as the model has columns
    parts = F.zip_with("x", "c", lambda x, c: F.struct((-F.abs(c.coefficient * (x - c["mean"]))).alias("size"), c.pos.alias("pos"), (c.coefficient * (x - c["mean"])).alias("value")))
    ranked = one.select(key, *keep, F.posexplode(F.array_sort(parts)).alias("rank", "a"))
    return ranked.select(key, *keep, F.col("a.pos").alias("pos"), F.col("a.value").alias("shap_value"), (F.col("rank") + 1).alias("abs_rank"))


def top(attributions: DataFrame, k: int = 10) -> DataFrame:
    return attributions.where(F.col("abs_rank") <= k)


def reconcile(attributions: DataFrame, predictions: DataFrame, k: int = 10, key: str = "prediction_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Per prediction: base, shown (within the top k), residual, expected, and a verdict.

    ``predictions``: key, score, link, and base_value, which without that column is taken from the attributions' own.
    'no attributions' and 'mismatch' are integrity failures.
    """
    v, base = F.col("shap_value"), [] if "base_value" in predictions.columns else [F.first("base_value").alias("base_value")]
    sums = attributions.groupBy(key).agg(F.sum(F.when(F.col("abs_rank") <= k, v).otherwise(0.0)).alias("shown"), F.sum(F.when(F.col("abs_rank") > k, v).otherwise(0.0)).alias("residual"), *base)
    both = predictions.join(sums, key, "left").withColumn("expected", scoring.expected_total(F.col("link"), F.col("score")))
    gap = F.abs(F.col("base_value") + F.col("shown") + F.col("residual") - F.col("expected"))
    verdict = F.when(F.col("shown").isNull(), "no attributions").when(gap < tolerance, "ok").otherwise("mismatch")
    return both.select(key, "score", "base_value", "shown", "residual", "expected", verdict.alias("verdict"))


def described(attributions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Attributions with source_feature, encoded_category, direction, applies and statement.

    ``dictionary``: feature_name, source_feature, category; no name is taken apart.
    """
    rows = attributions.join(dictionary.select("feature_name", "source_feature", "category"), "feature_name", "left")
    own = F.col("category").isNull() | (F.col("category") == F.col("feature_value_str"))
    return rows.select(*attributions.columns, "source_feature", F.col("category").alias("encoded_category"), scoring.direction(F.col("shap_value")).alias("direction"), F.coalesce(own, F.lit(False)).alias("applies"), scoring.statement(F.col("source_feature"), F.col("category"), F.col("feature_value_str")).alias("statement"))


def drivers(attributions: DataFrame, predictions: DataFrame, group: Column, key: str = "prediction_id", by: str = "source_feature") -> DataFrame:
    """What drives denials, by group: decisions, mean contribution, and how often the feature pushed towards denial."""
    denied = predictions.where("decision = 'deny'").select(key, scoring.group_of(group).alias("group_value"))
    per = attributions.groupBy(key, by).agg(F.sum("shap_value").alias("value"))
    return denied.join(per, key).groupBy("group_value", by).agg(F.count("*").alias("decisions"), F.avg("value").alias("mean_value"), F.sum((F.col("value") < 0).cast("int")).alias("toward_denial"))


def reports(ids: DataFrame, predictions: DataFrame, models: DataFrame, snapshots: DataFrame, attributions: DataFrame, k: int = 10) -> DataFrame:
    """One nested report per asked id: 'not_found', 'integrity_failure' with the missing link, or 'ok' with its top k."""
    best = F.slice(F.array_sort(F.collect_list(F.when(F.col("abs_rank") <= k, F.struct("abs_rank", "feature_name", "feature_value_str", "shap_value")))), 1, k)
    top_k = attributions.join(ids, "prediction_id", "left_semi").groupBy("prediction_id").agg(best.alias("attributions"), F.sum(F.when(F.col("abs_rank") > k, F.col("shap_value")).otherwise(0.0)).alias("residual"), F.sum("shap_value").alias("total"), F.first("base_value").alias("base_value"), F.first("explainer_type").alias("explainer_type"))
    chain = ids.join(predictions, "prediction_id", "left").join(models.select("model_version_id", F.col("data_snapshot_uuid"), "estimator_class", F.lit(True).alias("has_model")), "model_version_id", "left")
    chain = chain.join(snapshots.select("data_snapshot_uuid", F.col("status").alias("snapshot_status"), "content_digest"), "data_snapshot_uuid", "left").join(top_k, "prediction_id", "left")
    expected = scoring.expected_total(scoring.link_of(F.col("explainer_type"), F.col("estimator_class")), F.col("score"))
    failure = F.when(F.col("has_model").isNull(), "model version missing").when(F.col("snapshot_status").isNull(), "data version missing").when(F.col("total").isNull(), "attributions missing").when(F.abs(F.col("base_value") + F.col("total") - expected) >= TOLERANCE, "attributions don't add up to the score")
    status = F.when(F.col("score").isNull(), "not_found").when(failure.isNotNull(), "integrity_failure").otherwise("ok")
    return chain.select("prediction_id", status.alias("status"), F.when(F.col("score").isNotNull(), failure).alias("failure"), "model_version_id", "subject_id", "score", "threshold", "decision", "data_snapshot_uuid", "content_digest", "base_value", "residual", "attributions")
