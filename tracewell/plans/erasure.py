"""Erasure of a set of subjects, with a record that survives them.

Every step leaves the trail in a state from which running the request again finishes the work, and in which readers see
each table as it was before the removal or after it, never in between:

1. The request is logged, with what was known of its subjects before anything went: models that saw them and versions
   that hold them. A subject whose last request isn't completed goes on under that request.
2. Versions that hold the subjects are tombstoned.
3. For each table the buckets that hold the subjects are written anew without them, as a generation that no reader sees
   yet. One row of the log puts it in the place of those before. Then the replaced files are removed.
4. A scan of all files that are stored, live or not, must find no residue; decompositions on lost versions are marked;
   the request is completed, with what this subject's removal cost.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import identity
from tracewell.operators import contamination
from tracewell.operators.versions import CONTENT_TABLES, Trail, TrailError, latest
from tracewell.schemas import BUCKET, COMMIT

TABLES = ("features.credit_applications", "features.eval_holdout")
#: Up to so many subjects are looked for by their values, which files' statistics answer; more by a join.
IN_LIST = 1000


@dataclass
class Staged:
    """A removal that is written and not yet committed: its commit, the buckets it replaces, the rows that go."""

    n: int
    buckets: list[int]
    rows: int


def stage_removal(trail: Trail, table: str, subjects: DataFrame) -> Staged | None:
    """Writes the buckets that hold the subjects, without them, as a new generation; nothing to remove, nothing written."""
    wanted = subjects.select("subject_id").distinct().withColumn("gone", F.lit(1)).persist()  # ids alone, asked for four times
    try:
        return _staged(trail, table, wanted)
    finally:
        wanted.unpersist()


def _staged(trail: Trail, table: str, wanted: DataFrame) -> Staged | None:
    n = trail.next_commit(table)
    held = trail.in_buckets(table, trail.buckets_of(wanted))
    counts = held.join(wanted, "subject_id", "left_semi").groupBy(BUCKET).agg(F.count("*").alias("n")).collect()  # a row a bucket
    if not counts:
        return None
    buckets = sorted(r[0] for r in counts)
    rows = trail.in_buckets(table, buckets)
    trail.write(table, rows.join(wanted, "subject_id", "left_anti").select(rows.columns), n)
    if table in CONTENT_TABLES:
        trail._describe(table, rows.join(wanted, "subject_id", "left_semi"), n, -1)
    return Staged(n, buckets, sum(r.n for r in counts))


def publish_removal(trail: Trail, table: str, staged: Staged) -> None:
    """From here on readers see the table without the rows."""
    trail.commit(table, "erasure", staged.n, staged.buckets)


def remove_rows(trail: Trail, table: str, subjects: DataFrame) -> int:
    """Removes the subjects' rows; returns how many. No bucket without one of them is written."""
    staged = stage_removal(trail, table, subjects)
    if staged:
        publish_removal(trail, table, staged)
    trail.vacuum(table)
    return staged.rows if staged else 0


def residue(trail: Trail, table: str, subjects: DataFrame) -> DataFrame:
    """(file, subject_id) of every stored file of a table, live or not, that still holds a subject; it must be empty.

    Only the subjects' buckets are opened. Rows are sorted by subject within a file, so for a few subjects the statistics
    in the files' footers leave out all row groups and pages that can't hold them.
    """
    wanted = subjects.select("subject_id").distinct()
    rows = trail.raw(table).where(F.col(BUCKET).isin(trail.buckets_of(wanted))).select(F.col("_metadata.file_path").alias("file"), "subject_id")
    few = [r[0] for r in wanted.limit(IN_LIST + 1).collect()]
    if len(few) <= IN_LIST:
        return rows.where(F.col("subject_id").isin(few)).distinct()
    return rows.join(wanted, "subject_id", "left_semi").distinct()


def _sets(rows: DataFrame, value: str, name: str) -> DataFrame:
    return rows.groupBy("subject_id").agg(F.array_sort(F.collect_set(value)).alias(name))


def _union(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def held_by(trail: Trail, ids: DataFrame) -> DataFrame:
    """(subject_id, data_snapshot_uuid) of every version, not yet tombstoned, that holds a row of a subject."""
    versions = trail.current("audit.data_snapshots", "data_snapshot_uuid").where("status <> 'tombstoned'")
    splits = F.when(F.col("split_filter").isNull(), F.array(*map(F.lit, identity.SPLITS))).otherwise(F.array("split_filter"))
    versions = versions.select("data_snapshot_uuid", "table_identifier", "version", F.explode(splits).alias("split"))
    buckets, out = trail.buckets_of(ids), None
    for table in TABLES:
        first = trail.in_buckets(table, buckets).join(ids, "subject_id", "left_semi").groupBy("subject_id", "split").agg(F.min(COMMIT).alias("first_commit"))
        found = first.join(versions.where(F.col("table_identifier") == table), "split").where("first_commit <= version").select("subject_id", "data_snapshot_uuid")
        out = found if out is None else out.union(found)
    return out.distinct()


_PLAN = "struct<snapshots_tombstoned: array<string>>"


def log_request(trail: Trail, subjects: DataFrame) -> DataFrame:
    """The request rows of ``subjects`` in state 'in_progress': those left open before, and new ones.

    resolution_json says which versions hold the subject; of a request that goes on, those found before and now.
    """
    wanted = subjects.select("subject_id").distinct().persist()  # ids alone, asked for eight times below
    try:
        return _logged(trail, wanted)
    finally:
        wanted.unpersist()


def _logged(trail: Trail, wanted: DataFrame) -> DataFrame:
    open_ones = trail.current("audit.erasure_requests", "request_id").where("status <> 'completed'").drop(COMMIT).join(wanted, "subject_id", "left_semi")
    fresh = wanted.join(open_ones.select("subject_id"), "subject_id", "left_anti")
    key = identity.joined_key(uuid.uuid4().hex, F.col("subject_id"))
    buckets = trail.buckets_of(wanted)
    membership = trail.in_buckets("audit.training_membership", buckets)
    seen = _sets(membership.join(fresh, "subject_id", "left_semi"), "model_version_id", "contaminated_model_ids")
    live = contamination.live_rows({t: trail.in_buckets(t, buckets).join(fresh, "subject_id", "left_semi") for t in TABLES}).groupBy("subject_id").agg(F.sum("n_rows").alias("live_rows_deleted"))
    new = fresh.join(seen, "subject_id", "left").join(live, "subject_id", "left").withColumns({
        "request_id": identity.uuid5(identity.PREDICTION_NAMESPACE, key), "requested_at": F.current_timestamp(), "contaminated_model_ids": F.coalesce("contaminated_model_ids", F.array().cast("array<string>")), "live_rows_deleted": F.coalesce("live_rows_deleted", F.lit(0)),
    }).withColumn("contaminated_model_count", F.size("contaminated_model_ids"))
    rows = open_ones.unionByName(new, allowMissingColumns=True).join(_sets(held_by(trail, wanted), "data_snapshot_uuid", "found"), "subject_id", "left")
    before = F.from_json("resolution_json", _PLAN)["snapshots_tombstoned"]
    plan = F.to_json(F.struct(_union(before, F.col("found")).alias("snapshots_tombstoned")))
    n = trail.append("audit.erasure_requests", rows.withColumn("resolution_json", plan).withColumn("status", F.lit("in_progress")))
    # a subject in question has an open request, and this commit wrote the state of each of those
    return trail.current("audit.erasure_requests", "request_id").where(F.col("status") == "in_progress").where(F.col(COMMIT) == F.lit(n)).drop(COMMIT)


def planned(requests: DataFrame) -> DataFrame:
    """(request_id, subject_id, data_snapshot_uuid): the versions that each request costs."""
    found = F.from_json("resolution_json", _PLAN)["snapshots_tombstoned"]
    return requests.select("request_id", "subject_id", F.explode(found).alias("data_snapshot_uuid"))


def tombstone(trail: Trail, requests: DataFrame, reason: str) -> None:
    """Tombstones the versions that the requests cost; each names the least request of those that it falls to."""
    whose = planned(requests).groupBy("data_snapshot_uuid").agg(F.min("request_id").alias("erasure_request_id"))
    versions = trail.current("audit.data_snapshots", "data_snapshot_uuid").where("status <> 'tombstoned'").drop(COMMIT)
    hit = versions.join(whose, "data_snapshot_uuid").persist()
    pinned = contamination.pinned_models(hit, trail.current("audit.model_versions", "model_version_id")).withColumnRenamed("model_version_ids", "pinned_model_version_ids")
    new = hit.join(trail.read("audit.snapshot_tombstones").select("data_snapshot_uuid"), "data_snapshot_uuid", "left_anti").join(pinned, "data_snapshot_uuid", "left")
    trail.append("audit.snapshot_tombstones", new.withColumns({"expired_at": F.current_timestamp(), "reason": F.lit(reason), "row_count_at_expiry": F.col("row_count")}))
    # a version whose tombstone was written but whose state wasn't is hit again
    trail.append("audit.data_snapshots", hit.withColumn("status", F.lit("tombstoned")).withColumn("expired_at", F.current_timestamp()))
    hit.unpersist()


def resolved(requests: DataFrame, invalid: DataFrame, retired: DataFrame) -> DataFrame:
    """``requests`` with the resolution of each: the versions, models and decompositions that this subject's removal cost.

    ``invalid``: eval_snapshot_uuid of decompositions that can't be compared any more, a row each; ``retired``:
    (subject_id, model_version_id).
    """
    lost = planned(requests)
    per = lost.join(invalid.groupBy(F.col("eval_snapshot_uuid").alias("data_snapshot_uuid")).agg(F.count("*").alias("k")), "data_snapshot_uuid", "left")
    cost = per.groupBy("request_id").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("decompositions_invalidated"), F.array_sort(F.collect_set("data_snapshot_uuid")).alias("snapshots_tombstoned"))
    out = requests.drop("resolution_json").join(cost, "request_id", "left").join(_sets(retired, "model_version_id", "models_retired"), "subject_id", "left")
    none = F.array().cast("array<string>")
    parts = F.struct(F.coalesce("decompositions_invalidated", F.lit(0)).alias("decompositions_invalidated"), F.coalesce("models_retired", none).alias("models_retired"), F.coalesce("snapshots_tombstoned", none).alias("snapshots_tombstoned"))
    return out.withColumn("resolution_json", F.to_json(parts))


def erase(trail: Trail, subjects: DataFrame, reason: str = "erasure request", retire: bool = False) -> dict:
    """Logs the request, tombstones the versions that hold the subjects, removes the rows, checks that none is left.

    A failure leaves the request 'failed' and everything so far recorded; running it again finishes the work under the
    same request. A subject of which nothing is stored is logged and completed too.
    """
    requests = log_request(trail, subjects).persist()
    n = requests.count()
    if not n:
        requests.unpersist()
        return {"subjects": 0}
    ids = requests.select("subject_id").distinct()
    try:
        tombstone(trail, requests, reason)
        removed = sum(remove_rows(trail, t, ids) for t in TABLES)
        left = [r.file for t in TABLES for r in residue(trail, t, ids).limit(5).collect()]
        if left:
            raise TrailError(f"rows are left in {left}")
        lost = planned(requests).select("data_snapshot_uuid").distinct()
        of_lost = trail.current("audit.fairness_decompositions", "decomposition_id").join(lost.withColumnRenamed("data_snapshot_uuid", "eval_snapshot_uuid"), "eval_snapshot_uuid", "left_semi").persist()
        invalid = of_lost.where("comparable").count()
        trail.append("audit.fairness_decompositions", of_lost.where("comparable").withColumn("comparable", F.lit(False)))
        membership = trail.in_buckets("audit.training_membership", trail.buckets_of(ids)).join(ids, "subject_id", "left_semi").select("subject_id", "model_version_id").distinct()
        models = trail.current("audit.model_versions", "model_version_id")
        if retire:
            stop = models.where("status = 'active'").join(membership, "model_version_id", "left_semi")
            trail.append("audit.model_versions", stop.withColumns({"status": F.lit("retired"), "retired_at": F.current_timestamp(), "retire_reason": F.lit(reason)}))
            models = trail.current("audit.model_versions", "model_version_id")
        retired = membership.join(models.where((F.col("status") == "retired") & (F.col("retire_reason") == reason) if retire else F.lit(False)).select("model_version_id"), "model_version_id", "left_semi").persist()
        # asked before the requests' state changes, and what is cached of it; versions and models, not subjects
        hit_ids, retired_ids = (sorted(r[0] for r in x.distinct().collect()) for x in (lost, retired.select("model_version_id")))
        done = resolved(requests, of_lost.select("eval_snapshot_uuid"), retired)
        trail.append("audit.erasure_requests", done.withColumns({"status": F.lit("completed"), "completed_at": F.current_timestamp()}))
        of_lost.unpersist()
        retired.unpersist()
    except Exception as e:
        parts = F.from_json("resolution_json", _PLAN)["snapshots_tombstoned"]
        trail.append("audit.erasure_requests", requests.withColumns({"status": F.lit("failed"), "resolution_json": F.to_json(F.struct(F.lit(str(e)[:500]).alias("error"), parts.alias("snapshots_tombstoned")))}))
        raise
    finally:
        requests.unpersist()
    return {"subjects": n, "rows_removed": removed, "decompositions_invalidated": invalid, "models_retired": retired_ids, "snapshots_tombstoned": hit_ids}


def requests_of(trail: Trail, subject_id: str) -> DataFrame:
    """A subject's requests in their current state, by time."""
    rows = trail.read("audit.erasure_requests").where(F.col("subject_id") == subject_id)
    return latest(rows, "request_id", COMMIT).orderBy("requested_at", "request_id")
