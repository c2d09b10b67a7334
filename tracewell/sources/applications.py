"""Raw applications: delimited text lines with 15 fields, to rows with derived identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import identity, scoring
from tracewell.operators.versions import CONTENT
from tracewell.schemas import RAW_FIELDS, SCHEMAS


SALTS = 256


def with_occurrence(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with occurrence: 0, 1, ... among the rows of one ``key``.

    Equal lines can be told apart by nothing, so which of them gets which number is free. Rows are numbered within
    (key, salt), and the salts' counts before are added, so a very common line doesn't meet in one task. Only groups that
    have others of their key before them are joined: for lines that don't repeat, none.
    """
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    at = salted.withColumn("__at", F.row_number().over(W.partitionBy(key, "__salt").orderBy(F.lit(0))) - 1)
    last = at.groupBy(key, "__salt").agg((F.max("__at") + 1).alias("n"))
    before = last.withColumn("__before", F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("__before > 0").drop("n")
    return at.join(before, [key, "__salt"], "left").withColumn("occurrence", F.coalesce("__before", F.lit(0)) + F.col("__at")).drop("__salt", "__at", "__before")


def parse(lines: DataFrame, batch_id: str) -> DataFrame:
    """Subject rows of ``lines`` (value). Blank lines, lines that begin with a bar and lines of another width go.

    The occurrence of a repeated line makes its identity, so the same lines in any order give the same set of ids.
    """
    # filters on the raw line, so that each line is stripped once; one with all its commas isn't blank
    full = (F.size(F.split("value", ",")) == len(RAW_FIELDS)) & ~F.startswith(F.ltrim(F.col("value"), F.lit(scoring.WHITE)), F.lit("|"))
    kept = lines.where(full).select(scoring.strip(F.col("value")).alias("line"))
    numbered = with_occurrence(kept, "line").withColumn("f", F.split("line", ","))  # lines alone are shuffled
    types = {f.name: f.dataType for f in SCHEMAS["features.credit_applications"]}
    fields = [scoring.clean(F.col("f")[i]).cast(types[name]).alias(name) for i, name in enumerate(RAW_FIELDS[:-1])]
    rows = numbered.select(identity.subject_id(F.col("line"), F.col("occurrence")).alias("subject_id"), *fields, scoring.income_label(F.col("f")[len(RAW_FIELDS) - 1]).alias("label"))
    rows = rows.withColumns({"as_of_ts": identity.event_time(F.col("subject_id")), "split": identity.split_of(F.col("subject_id")), "ingest_batch_id": F.lit(batch_id)})
    return rows.withColumn("source_row_digest", identity.row_digest(rows, *CONTENT))


def read_text(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    rows = parse(spark.read.text(path), batch_id)
    if not rows.take(1):
        raise ValueError(f"nothing to parse in {path}")
    return rows
