"""Ingest: new subjects only, the evaluation holdout frozen once, versions captured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.versions import Trail, new_rows

APPLICATIONS, HOLDOUT = "features.credit_applications", "features.eval_holdout"


def ingest(trail: Trail, rows: DataFrame) -> dict:
    """Appends the subjects of ``rows`` that are neither there nor erased. Returns counts and the captured versions."""
    erased = trail.current("audit.erasure_requests", "request_id").where("status = 'completed'").select("subject_id").distinct()
    fresh = new_rows(new_rows(rows, trail.read(APPLICATIONS), "subject_id"), erased, "subject_id").dropDuplicates(["subject_id"])
    before = trail.version(APPLICATIONS)
    trail.append(APPLICATIONS, fresh)
    now = trail.read(APPLICATIONS)
    if trail.version(HOLDOUT) == 0:  # later batches must not move what models are compared on
        trail.append(HOLDOUT, now.where("split = 'eval'"))
    splits = {r.split: r.n for r in now.where(F.col("commit_seq") > before).groupBy("split").agg(F.count("*").alias("n")).collect()}
    return {"rows_written": sum(splits.values()), "splits": splits, "train_snapshot": trail.capture(APPLICATIONS, "train"), "eval_snapshot": trail.capture(HOLDOUT)}
