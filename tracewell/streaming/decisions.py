"""Decisions spooled as JSON lines, drained into the trail by Structured Streaming.

A decision is recorded once, by its identity alone, whatever its times say. Repeats that arrive close together are dropped
by the stream's state; for the rest there is an index of identities, laid out by hash bucket and sorted, with a Bloom filter
in each file: it is asked for a batch's buckets, and names the days on which a decision may already be, and only these days
of the history are read.

Writes of a batch follow one order: what is refused, identities, attributions, predictions. An identity in the index says
where to look, not that the decision is there, so a batch that broke off anywhere is completed by its replay.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import identity, scoring
from tracewell.operators.versions import Trail
from tracewell.schemas import BUCKET, SCHEMAS

#: More days than that are taken as the range that they span; so many identities are asked for by their values; and arrivals that far apart
#: aren't kept in the stream's state.
MOST_DAYS, IN_LIST, NEAR = 366, 1000, "1 hour"
#: Predictions of a day that one task writes, with all of their attributions.
SLICE = 25_000
_STORE = "spark.sql.streaming.stateStore"
#: The stream's state lies in RocksDB: on the disks of the executors, with that many MB of each one's memory for all of its stores. Spark's
#: default keeps all keys of an hour on the heap, twice after each batch.
STATE = {f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_STORE}.rocksdb.boundedMemoryUsage": "true", f"{_STORE}.rocksdb.maxMemoryUsageMB": "256"}
#: How far attributions and base value may be from the score's link (a fixed value).
TOLERANCE = 1e-6


def _loose(table: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in SCHEMAS[table]])


def line_schema() -> T.StructType:
    return T.StructType([T.StructField("prediction", _loose("audit.predictions")), T.StructField("attributions", T.ArrayType(_loose("audit.attributions"))), T.StructField("_corrupt", T.StringType())])


def _lacks(table: str, of: Column) -> Column:
    """Whether a row of a table lacks a required field."""
    required = [f.name for f in SCHEMAS[table] if not f.nullable]
    out = F.lit(False)
    for n in required:
        out = out | of[n].isNull()
    return out


def judged(lines: DataFrame) -> DataFrame:
    """(value, prediction, attributions, reason) of spooled lines; reason is null for a line that can be recorded.

    Reasons: 'torn' (no whole JSON object), 'incomplete' (a part or a required field is missing, a part of another decision
    or of no decision), 'not additive' (attributions don't add up to the score).
    """
    e = F.from_json("value", line_schema(), {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rows = lines.select("value", e.alias("e")).select("value", "e.*")
    p, a = F.col("prediction"), F.col("attributions")
    bad_part = F.exists(a, lambda x: x.isNull() | _lacks("audit.attributions", x) | (x.prediction_id != p.prediction_id))
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.shap_value) + F.get(a, F.lit(0)).base_value
    # tree explainers that were run elsewhere add up to the score itself
    linear = F.get(a, F.lit(0)).explainer_type == "linear"
    additive = F.when(linear, F.abs(total - scoring.logit(p.score)) <= TOLERANCE).otherwise((F.abs(total - p.score) <= TOLERANCE) | (F.abs(total - scoring.logit(p.score)) <= TOLERANCE))
    reason = (
        F.when(F.col("_corrupt").isNotNull() | (p.isNull() & a.isNull()), "torn")
        .when(p.isNull() | a.isNull() | (F.size(a) == 0), "incomplete")
        .when(_lacks("audit.predictions", p) | bad_part, "incomplete")
        .when(~additive, "not additive")
    )
    return rows.select("value", "prediction", "attributions", reason.alias("reason"))


def _needed(rows: DataFrame, *more: str) -> DataFrame:
    """Judged lines with what is recorded of each: of a refused one its text, of another its parts. Half as much is shuffled."""
    refused = F.col("reason").isNotNull()
    parts = (F.when(~refused, F.col(c)).alias(c) for c in ("prediction", "attributions"))
    return rows.select(F.when(refused, F.col("value")).alias("value"), *parts, "reason", *more)


def decoded(lines: DataFrame) -> DataFrame:
    """(prediction, attributions) of the lines that can be recorded."""
    return judged(lines).where("reason IS NULL").select("prediction", "attributions")


def encoded_lines(predictions: DataFrame, attributions: DataFrame) -> DataFrame:
    """One JSON line for each prediction with its attributions, as a producer spools it; times to the microsecond."""
    parts = attributions.groupBy("prediction_id").agg(F.array_sort(F.collect_list(F.struct("abs_rank", F.struct(*SCHEMAS["audit.attributions"].fieldNames()).alias("a")))).alias("p"))
    rows = predictions.join(parts, "prediction_id").select(F.struct(*SCHEMAS["audit.predictions"].fieldNames()).alias("prediction"), F.transform("p", lambda x: x.a).alias("attributions"))
    return rows.select(F.to_json(F.struct("prediction", "attributions"), {"timestampFormat": identity.EXACT_TIME}).alias("value"))


def asked(trail: Trail, table: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of an identity table that have one of ``keys`` (a column ``key``): of their buckets only, and for few keys
    only of the files and pages whose Bloom filters and statistics allow one."""
    rows = trail.read(table).where(F.col(BUCKET).isin(trail.buckets_of(keys, key)))
    few = [r[0] for r in keys.select(key).distinct().limit(IN_LIST + 1).collect()]
    if len(few) <= IN_LIST:
        return rows.where(F.col(key).isin(few))
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def _without(rows: DataFrame, history: DataFrame, *key: str) -> DataFrame:
    """Rows whose key the history doesn't hold. It is merged, never broadcast: the bytes of its files say little of its number of keys."""
    return rows.join(history.select(*key).hint("merge"), list(key), "left_anti")


def refuse(trail: Trail, lines: DataFrame, reason: Column | str = "reason", line: Column | str = "value") -> int:
    """Puts refused lines into audit.rejects, each line and reason once; returns how many are new.

    Any refused row can be given: of a stream the raw line, of a batch of requests its JSON.
    """
    reason, line = (F.col(x) if isinstance(x, str) else x for x in (reason, line))
    rows = lines.select(reason.alias("reason"), line.alias("line")).withColumn("reject_id", identity.sha256(F.concat_ws("|", "reason", "line"))).dropDuplicates(["reject_id"]).persist()
    try:
        fresh = _without(rows, asked(trail, "audit.rejects", rows, "reject_id"), "reject_id")
        n = trail.append("audit.rejects", fresh.withColumn("rejected_at", F.current_timestamp()))
        return trail.read("audit.rejects").where(F.col("commit_seq") == n).count() if n else 0
    finally:
        rows.unpersist()


def record(trail: Trail, predictions: DataFrame, attributions: DataFrame) -> int:
    """Records the decisions whose identity isn't there yet, attributions before predictions; returns how many.

    ``predictions`` has each identity once. A decision that was begun before and not finished is finished.
    """
    named = asked(trail, "audit.decision_ids", predictions, "prediction_id").select("prediction_id", "prediction_ts").persist()
    days = days_of(named)
    there = on_days(trail, "audit.predictions", days).join(named.select("prediction_id").distinct(), "prediction_id", "left_semi")
    fresh = _without(predictions.select(*SCHEMAS["audit.predictions"].fieldNames()), there, "prediction_id").persist()
    try:
        counts = {r.day: r["n"] for r in fresh.groupBy(F.to_date("prediction_ts").alias("day")).agg(F.count("*").alias("n")).collect()}  # a row a day
        n, slices = sum(counts.values()), {day: -(-k // SLICE) for day, k in counts.items()}
        if n:
            trail.append("audit.decision_ids", fresh.select("prediction_id", "prediction_ts").join(named, ["prediction_id", "prediction_ts"], "left_anti"))
            tall = attributions.join(fresh.select("prediction_id"), "prediction_id", "left_semi")
            if days:  # those of a decision that was begun
                begun = on_days(trail, "audit.attributions", days).join(named.select("prediction_id").distinct(), "prediction_id", "left_semi")
                tall = _without(tall, begun, "prediction_id", "feature_name")
            trail.append("audit.attributions", tall, slices)
            trail.append("audit.predictions", fresh, slices)
        return n
    finally:
        fresh.unpersist()
        named.unpersist()


def drain_batch(trail: Trail, rows: DataFrame) -> int:
    """Records a batch of judged lines: the refused ones as rejects, the others as decisions. A replay adds only what is missing."""
    rows = rows.persist()
    try:
        refuse(trail, rows.where("reason IS NOT NULL"))
        good = rows.where("reason IS NULL").withColumn("prediction_id", F.col("prediction.prediction_id")).dropDuplicates(["prediction_id"])
        return record(trail, good.select("prediction.*"), good.select(F.explode("attributions").alias("a")).select("a.*"))
    finally:
        rows.unpersist()


def days_of(times: DataFrame) -> list:
    """The days of some times, as many as a batch has at most."""
    return [r[0] for r in times.select(F.to_date("prediction_ts")).distinct().collect()]


def on_days(trail: Trail, table: str, days: list) -> DataFrame:
    """The rows of some days; no other folder is read."""
    rows = trail.read(table)
    if not days:
        return rows.where(F.lit(False))
    return rows.where(F.col("day").isin(days) if len(days) <= MOST_DAYS else F.col("day").between(min(days), max(days)))


def distinct_arrivals(rows: DataFrame) -> DataFrame:
    """A stream's judged lines without repeats that arrive within NEAR of each other.

    Arrival, not the decision's time, is what the watermark follows, so no line is ever too late. Refused lines are
    compared as they are, so a mended line isn't taken for a repeat of the refused one.
    """
    key = F.when(F.col("reason").isNull(), F.concat(F.lit("p:"), "prediction.prediction_id")).otherwise(F.concat(F.lit("r:"), F.sha2("value", 256)))
    return _needed(rows.withColumn("key", key), "key").withColumn("arrived", F.current_timestamp()).withWatermark("arrived", NEAR).dropDuplicatesWithinWatermark(["key"]).drop("key", "arrived")


@contextmanager
def _kept_on_disk(spark: SparkSession):
    """A stream that starts inside keeps its state by STATE, save what the session itself has set; its settings stay as they are."""
    own = [k for k in STATE if spark.conf.get(k, None) is None]
    try:
        for k in own:
            spark.conf.set(k, STATE[k])
        yield
    finally:
        for k in own:
            spark.conf.unset(k)


def drain(trail: Trail, spool: str, checkpoint: str, continuous: str | None = None):
    """Starts the stream over the spool folder: all there is, then an end; or a tick every ``continuous`` interval.

    A checkpoint whose stream began with another kind of state store keeps that kind.
    """
    rows = distinct_arrivals(judged(trail.spark.readStream.text(spool)))
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: drain_batch(trail, batch))
    with _kept_on_disk(trail.spark):
        return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()


def drained_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path) of the spool's files in batches that a stream has committed, as its checkpoint says."""
    sc = spark.sparkContext
    path = lambda x: sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/{x}")
    fs = path("").getFileSystem(sc._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()) for f in (fs.globStatus(path("commits/[0-9]*")) or []) if f.getPath().getName().isdigit()]
    if not done or not fs.exists(path("sources/0")):
        return spark.createDataFrame([], "path string")
    logged = spark.read.text(f"{checkpoint}/sources/0").select(F.from_json("value", "path string, batchId long").alias("e")).select("e.*")
    return logged.where(F.col("path").isNotNull() & (F.col("batchId") <= max(done))).select("path").distinct()


def pending(spark: SparkSession, trail: Trail, spool: str, checkpoint: str | None = None) -> int:
    """Spooled decisions that aren't in the trail yet. With the stream's checkpoint, files that it has drained aren't opened."""
    lines = spark.read.text(spool)
    if checkpoint:
        done = {_plain(r[0]) for r in drained_files(spark, checkpoint).collect()}  # names of files that are still in the spool or were
        left = [f for f in lines.inputFiles() if _plain(f) not in done]
        if not left:
            return 0
        lines = spark.read.text(left)
    rows = decoded(lines).select("prediction.prediction_id").distinct().persist()
    try:
        named = asked(trail, "audit.decision_ids", rows, "prediction_id").select("prediction_id", "prediction_ts")
        return _without(rows, on_days(trail, "audit.predictions", days_of(named)), "prediction_id").count()
    finally:
        rows.unpersist()


def _plain(path: str) -> str:
    """A file's name without its scheme."""
    return "/" + path.partition(":")[2].lstrip("/") if ":" in path.split("/")[0] else path
