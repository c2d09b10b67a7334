"""Which models saw a subject, and which versions hold them: for all subjects in one job, or a few by a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def reproducible(models: DataFrame, tombstoned: DataFrame) -> DataFrame:
    """``models`` with whether both of their data versions are still there."""
    gone = tombstoned.select(F.col("data_snapshot_uuid").alias("gone"))
    hit = models.select("model_version_id", F.explode(F.array("data_snapshot_uuid", "eval_snapshot_uuid")).alias("gone")).join(gone, "gone", "left_semi").select("model_version_id").distinct().withColumn("lost", F.lit(True))
    return models.join(hit, "model_version_id", "left").withColumn("reproducible", F.col("lost").isNull()).drop("lost")


def contaminations(membership: DataFrame, models: DataFrame, tombstoned: DataFrame) -> DataFrame:
    """(subject_id, model_version_id, role, registered, status, serving, reproducible); memberships of unknown models stay."""
    known = reproducible(models.select("model_version_id", "status", "data_snapshot_uuid", "eval_snapshot_uuid"), tombstoned).withColumn("registered", F.lit(True))
    rows = membership.select("subject_id", "model_version_id", "role").join(known, "model_version_id", "left")
    return rows.select("subject_id", "model_version_id", "role", F.coalesce("registered", F.lit(False)).alias("registered"), "status", F.coalesce(F.col("status") == "active", F.lit(False)).alias("serving"), F.coalesce("reproducible", F.lit(False)).alias("reproducible"))


def live_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(subject_id, table_identifier, n_rows) over the subject tables, counted within each before the shuffle."""
    every = None
    for name, rows in tables.items():
        one = rows.select("subject_id").withColumn("table_identifier", F.lit(name))
        every = one if every is None else every.union(one)
    return every.groupBy("subject_id", "table_identifier").agg(F.count("*").alias("n_rows"))


def rollup(contaminated: DataFrame, decisions: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Per subject: models, serving and orphaned models, decisions about them, live rows."""
    models = contaminated.groupBy("subject_id").agg(
        F.array_sort(F.collect_set("model_version_id")).alias("model_version_ids"), F.countDistinct("model_version_id").alias("n_models"),
        F.countDistinct(F.when(F.col("serving"), F.col("model_version_id"))).alias("n_serving"), F.countDistinct(F.when(~F.col("registered"), F.col("model_version_id"))).alias("n_orphaned"),
    )
    made = decisions.groupBy("subject_id").agg(F.count("*").alias("n_decisions"))
    out = models.join(made, "subject_id", "full")
    counts = ["n_models", "n_serving", "n_orphaned", "n_decisions"]
    if live is not None:
        out = out.join(live.groupBy("subject_id").agg(F.sum("n_rows").alias("n_live_rows")), "subject_id", "full")
        counts.append("n_live_rows")
    out = out.withColumn("model_version_ids", F.coalesce("model_version_ids", F.array().cast("array<string>")))
    return out.fillna(0, counts).withColumn("known", (F.col("n_models") > 0) | (F.col("n_decisions") > 0) | (F.col("n_live_rows") > 0 if live is not None else F.lit(False)))


def versions_with(subjects: DataFrame, rows: DataFrame, versions: DataFrame) -> DataFrame:
    """The versions (data_snapshot_uuid, version, split_filter) that hold rows of ``subjects``.

    A subject's rows are reduced to their first commit for each split, which is all that the comparison needs, so the
    inequality join is between versions and one row a split.
    """
    first = rows.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi").groupBy("split").agg(F.min("commit_seq").alias("first_commit"))
    holds = (F.col("first_commit") <= F.col("version")) & (F.col("split_filter").isNull() | (F.col("split_filter") == F.col("split")))
    return versions.join(F.broadcast(first), holds, "left_semi")  # a row for each split


def pins(versions: DataFrame, models: DataFrame) -> DataFrame:
    """(data_snapshot_uuid, model_version_id) of the models made from or tested on each version, as rows."""
    roles = models.select("model_version_id", F.explode(F.array_distinct(F.array("data_snapshot_uuid", "eval_snapshot_uuid"))).alias("data_snapshot_uuid"))
    return roles.join(versions.select("data_snapshot_uuid").distinct(), "data_snapshot_uuid", "left_semi").select("data_snapshot_uuid", "model_version_id").distinct()


def pinned_models(versions: DataFrame, models: DataFrame) -> DataFrame:
    """(data_snapshot_uuid, model_version_ids): the models of each version in one list, for a tombstone's record."""
    return pins(versions, models).groupBy("data_snapshot_uuid").agg(F.array_sort(F.collect_list("model_version_id")).alias("model_version_ids"))


def decisions_about(subjects: DataFrame, predictions: DataFrame) -> DataFrame:
    """(subject_id, prediction_id, prediction_ts, model_version_id, decision, score) of every decision about the subjects."""
    return predictions.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi").select("subject_id", "prediction_id", "prediction_ts", "model_version_id", "decision", "score")


def subject_reports(subjects: DataFrame, membership: DataFrame, models: DataFrame, tombstoned: DataFrame, live: DataFrame, predictions: DataFrame, most: int = 100) -> DataFrame:
    """One nested row per asked subject: live rows by table, the models that saw it, and its decisions.

    A subject may have any number of decisions, so the row counts them all and lists the first ``most`` by time and id;
    ``decisions_about`` has the whole list as rows. Models are few for each subject and listed all, by id and role.
    """
    asked = subjects.select("subject_id").distinct()
    seen = contaminations(membership.join(asked, "subject_id", "left_semi"), models, tombstoned)
    more = models.select("model_version_id", "recipe", "trained_at", "data_snapshot_uuid", "eval_snapshot_uuid")
    entry = F.struct("model_version_id", "role", "registered", "status", "recipe", "trained_at", "data_snapshot_uuid", "eval_snapshot_uuid", "reproducible", "serving")
    contaminated = seen.join(more, "model_version_id", "left").groupBy("subject_id").agg(F.array_sort(F.collect_set(entry)).alias("contaminated"))
    rows = live.join(asked, "subject_id", "left_semi").groupBy("subject_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_identifier", "n_rows")))).alias("live_rows"), F.sum("n_rows").alias("live_row_count"))
    made = decisions_about(asked, predictions)
    first = made.withColumn("at", F.row_number().over(W.partitionBy("subject_id").orderBy("prediction_ts", "prediction_id"))).where(F.col("at") <= most)
    listed = first.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("prediction_ts", "prediction_id", "model_version_id", "decision", "score"))).alias("decisions"))
    counted = made.groupBy("subject_id").agg(F.count("*").alias("decision_count"))
    out = asked.join(contaminated, "subject_id", "left").join(rows, "subject_id", "left").join(listed, "subject_id", "left").join(counted, "subject_id", "left").fillna(0, ["live_row_count", "decision_count"])
    empty = lambda c: F.coalesce(c, F.array())
    ids = lambda keep: F.array_distinct(F.transform(F.filter("contaminated", keep), lambda e: e.model_version_id))
    out = out.withColumns({"contaminated": empty("contaminated"), "decisions": empty("decisions"), "live_rows": F.coalesce("live_rows", F.create_map().cast("map<string,bigint>"))})
    out = out.withColumns({"contaminated_model_count": F.size(ids(lambda e: F.lit(True))), "serving_model_ids": ids(lambda e: e.serving), "orphaned_model_ids": ids(lambda e: ~e.registered)})
    return out.withColumn("known", (F.size("contaminated") > 0) | (F.col("decision_count") > 0) | (F.col("live_row_count") > 0))
