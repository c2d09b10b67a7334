"""The registered queries of the library's own operators, each with its SQL where SQL can state it.

The tables stand in for an audit trail's: documents with labels for an evaluation set, customers for subjects, orders
for dated rows, events for decisions and memberships, embeddings for encoded rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import identity, scoring
from tracewell.operators import contamination, explain, fairness, fit, versions
from tracewell.operators.versions import Trail
from tracewell.plans import erasure
from tracewell.sources import applications
from tracewell.storage import shared_folder
from tracewell.streaming import decisions


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/trail-{uuid.uuid4().hex}"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id")
    return rows.withColumn("predicted", (F.col("n_chars") >= 1500).cast("int"))


_DECIDED = "SELECT *, CAST(n_chars >= 1500 AS INT) AS p, quality AS y FROM documents JOIN labels USING (doc_id)"
_RATES = """count(*) AS n, sum(y) AS n_positive, sum(p) / count(*) AS selection_rate, sum(y) / count(*) AS positive_label_rate,
  CASE WHEN sum(y) > 0 THEN sum(y * p) / sum(y) END AS true_positive_rate, CASE WHEN sum(1 - y) > 0 THEN sum((1 - y) * p) / sum(1 - y) END AS false_positive_rate, sum(CAST(y = p AS INT)) / count(*) AS accuracy"""


def group_rates(spark, sf_dir):
    return fairness.group_rates(_decided(spark, sf_dir), "quality", "predicted", F.col("lang"))


GROUP_RATES = f"SELECT coalesce(lang, '__missing__') AS group_value, {_RATES} FROM ({_DECIDED}) GROUP BY 1"


def _by_attribute(spark, sf_dir):
    rows = _decided(spark, sf_dir)
    tall = rows.select("quality", "predicted", F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("sensitive_attribute", "value"))
    return fairness.group_rates(tall, "quality", "predicted", F.col("value"), ("sensitive_attribute",))


_TALL = f"SELECT 'lang' AS sensitive_attribute, coalesce(lang, '__missing__') AS group_value, y, p FROM ({_DECIDED}) UNION ALL SELECT 'source', coalesce(source, '__missing__'), y, p FROM ({_DECIDED})"
_SPREAD = ", ".join(f"CASE WHEN count({c}) >= 2 THEN max({c}) - min({c}) END AS {n}" for n, c in fairness.DIFFERENCES.items())


def group_differences(spark, sf_dir):
    return fairness.differences(_by_attribute(spark, sf_dir), ("sensitive_attribute",))


GROUP_DIFFERENCES = f"""
WITH r AS (SELECT sensitive_attribute, group_value, {_RATES} FROM ({_TALL}) GROUP BY ALL),
d AS (SELECT sensitive_attribute, sum(n) AS eligible_n, {_SPREAD} FROM r WHERE n >= 30 GROUP BY 1)
SELECT *, greatest(equal_opportunity_difference, false_positive_rate_difference) AS equalized_odds_difference FROM d
"""


def metric_rows(spark, sf_dir):
    rows = fairness.metric_rows(_by_attribute(spark, sf_dir), ("sensitive_attribute",), 5)
    rows = rows.withColumn("model_version_id", F.lit("rule-1500")).withColumn("eval_snapshot_uuid", F.lit("labels"))
    return fairness.evaluation_ids(rows, F.lit(repr(0.5))).drop("model_version_id", "eval_snapshot_uuid")


def _uuid5_sql(namespace: str, key: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({key}))"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT % 4) + 1, 1) || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"


METRIC_ROWS = f"""
WITH r AS (SELECT sensitive_attribute, group_value, {_RATES} FROM ({_TALL}) GROUP BY ALL),
d AS (SELECT sensitive_attribute, sum(n) AS n, {_SPREAD} FROM r WHERE n >= 5 GROUP BY 1),
g AS (SELECT sensitive_attribute, group_value, n, NULL::INT AS min_group_n, unnest([{", ".join(f"'{m}'" for m in fairness.GROUP_METRICS)}]) AS metric_name, unnest([{", ".join(fairness.GROUP_METRICS)}]) AS metric_value FROM r),
e AS (SELECT sensitive_attribute, NULL AS group_value, n, 5 AS min_group_n, unnest([{", ".join(f"'{m}'" for m in fairness.DIFFERENCES)}, 'equalized_odds_difference']) AS metric_name,
  unnest([{", ".join(fairness.DIFFERENCES)}, greatest(equal_opportunity_difference, false_positive_rate_difference)]) AS metric_value FROM d),
a AS (SELECT sensitive_attribute, group_value, metric_name, metric_value, n, min_group_n, 'rule-1500|labels|' || sensitive_attribute || '|0.5|' || metric_name || '|' || coalesce(group_value, '') || '|' || coalesce(min_group_n::VARCHAR, '') AS k FROM (FROM g UNION ALL FROM e) WHERE metric_value IS NOT NULL)
SELECT sensitive_attribute, group_value, metric_name, metric_value, n, min_group_n, {_uuid5_sql(identity.EVALUATION_NAMESPACE, "k")} AS evaluation_id FROM a
"""


def segment_rates(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("c_mktsegment", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") >= 150000).cast("int").alias("p"))
    return fairness.group_rates(rows, "y", "p", F.col("c_mktsegment"))


SEGMENT_RATES = f"SELECT c_mktsegment AS group_value, {_RATES} FROM (SELECT c_mktsegment, CAST(o_orderstatus = 'F' AS INT) AS y, CAST(o_totalprice >= 150000 AS INT) AS p FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1"

_CORNERS = {"a": 1500, "a_prime": 900, "b": 400, "b_prime": 2500}


def decomposition(spark, sf_dir):
    rows = _decided(spark, sf_dir).select("lang", "quality", "n_chars", F.explode(F.create_map(*(x for r, t in _CORNERS.items() for x in (F.lit(r), F.lit(t))))).alias("role", "t"))
    rows = rows.withColumn("predicted", (F.col("n_chars") >= F.col("t")).cast("int"))
    across = fairness.metric_rows(fairness.group_rates(rows, "quality", "predicted", F.col("lang"), ("role",)), ("role",)).where("group_value IS NULL")
    out = fairness.blame(fairness.decompose(across))
    return out.select("metric_name", "regressed", "attributed_to", *(F.round(c, 9).alias(c) for c in ("total_delta", "model_effect", "data_effect")))


DECOMPOSITION = f"""
WITH t(role, t) AS (VALUES {", ".join(str(x) for x in _CORNERS.items())}),
r AS (SELECT role, lang, {_RATES} FROM (SELECT role, lang, quality AS y, CAST(n_chars >= t AS INT) AS p FROM documents JOIN labels USING (doc_id), t) GROUP BY ALL),
d AS (SELECT role, {_SPREAD} FROM r WHERE n >= 30 GROUP BY 1),
m AS (SELECT role, unnest([{", ".join(f"'{m}'" for m in fairness.DIFFERENCES)}, 'equalized_odds_difference']) AS metric_name, unnest([{", ".join(fairness.DIFFERENCES)}, greatest(equal_opportunity_difference, false_positive_rate_difference)]) AS v FROM d),
w AS (SELECT metric_name, max(CASE role WHEN 'a' THEN v END) AS a, max(CASE role WHEN 'a_prime' THEN v END) AS ap, max(CASE role WHEN 'b' THEN v END) AS b, max(CASE role WHEN 'b_prime' THEN v END) AS bp FROM m GROUP BY 1)
SELECT metric_name, b - a > 0 AS regressed, CASE WHEN (bp - a) + (b - ap) = 0 AND (ap - a) + (b - bp) = 0 THEN 'neither' WHEN abs((bp - a) + (b - ap)) >= abs((ap - a) + (b - bp)) THEN 'model' ELSE 'data' END AS attributed_to, round(b - a, 9) AS total_delta, round(0.5 * ((bp - a) + (b - ap)), 9) AS model_effect, round(0.5 * ((ap - a) + (b - bp)), 9) AS data_effect FROM w WHERE a + ap + b + bp IS NOT NULL
"""


_CUTOFFS = range(100, 6001, 100)


def rate_curves(spark, sf_dir):
    """Rates of the score n_chars by language at 60 cutoffs, rows counted once (A4, F1)."""
    return fairness.rate_curves(_decided(spark, sf_dir), "quality", "n_chars", F.col("lang"), list(_CUTOFFS))


RATE_CURVES = f"SELECT lang AS group_value, cutoff, {_RATES} FROM (SELECT lang, cutoff::DOUBLE AS cutoff, quality AS y, CAST(n_chars >= cutoff AS INT) AS p FROM documents JOIN labels USING (doc_id), range({_CUTOFFS[0]}, {_CUTOFFS[-1] + 1}, {_CUTOFFS.step}) t(cutoff)) GROUP BY lang, cutoff"


def subject_splits(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.concat_ws(",", "c_mktsegment", "c_nationkey").alias("line"))
    rows = applications.with_occurrence(c, "line").withColumn("subject_id", identity.subject_id(F.col("line"), F.col("occurrence")))
    return rows.select("subject_id", identity.split_of(F.col("subject_id")).alias("split"), F.unix_timestamp(identity.event_time(F.col("subject_id"))).alias("as_of"))


SUBJECT_SPLITS = """
WITH s AS (SELECT substr(sha256(line || '#' || (row_number() OVER (PARTITION BY line) - 1)), 1, 16) AS subject_id FROM (SELECT c_mktsegment || ',' || c_nationkey AS line FROM customer)),
x AS (SELECT subject_id, ('0x' || substr(subject_id, 1, 8))::BIGINT % 100 AS h, ('0x' || substr(subject_id, 9, 4))::BIGINT AS d, ('0x' || substr(subject_id, 13, 4))::BIGINT AS s FROM s)
SELECT subject_id, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'eval' ELSE 'holdout' END AS split, 1704067200 + (d % 730) * 86400 + s % 86400 AS as_of FROM x
"""


def split_counts(spark, sf_dir):
    return subject_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


SPLIT_COUNTS = f"SELECT split, count(*) AS n FROM ({SUBJECT_SPLITS}) GROUP BY 1"

_ORDER = ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
_ORDER_JSON = "'{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":\"' || o_orderstatus || '\"}'"


def version_summary(spark, sf_dir):
    """Each year as a version: its rows, their time range and digest."""
    rows = _read(spark, sf_dir, "orders").withColumn("version", F.year("o_orderdate"))
    return versions.content_digest(rows, identity.row_digest(rows, *_ORDER), ("version",), F.min("o_orderdate").cast("string").alias("first"), F.max("o_orderdate").cast("string").alias("last"))


def _sums_sql(keys: str, source: str, more: str = "") -> str:
    """Lanes of row digests ``d`` of ``source`` summed by ``keys``, and the digest of these."""
    half, n = versions.LANES // 2, versions.LANE_DIGITS
    lanes = ", ".join(f"(sum(('0x' || substr({'d' if i < half else 'e'}, {1 + n * (i % half)}, {n}))::BIGINT) % {16**n})::VARCHAR" for i in range(versions.LANES))
    return f"SELECT {keys}, sha256(count(*) || ':' || concat_ws(':', {lanes})) AS content_digest, count(*) AS row_count{more} FROM (SELECT *, sha256(d) AS e FROM {source}) GROUP BY {keys}"


VERSION_SUMMARY = _sums_sql("version", f"(SELECT year(o_orderdate) AS version, o_orderdate, sha256({_ORDER_JSON}) AS d FROM orders)", ", strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last")


def row_digests(spark, sf_dir):
    """Digests of orders, whose dates get microseconds, and of their price as a decimal and as bytes."""
    o = _read(spark, sf_dir, "orders").withColumn("at", F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 3 * 250_001))
    o = o.withColumn("cents", F.round(F.col("o_totalprice"), 2).cast("decimal(18,2)")).withColumn("raw", F.col("o_orderstatus").cast("binary"))
    return o.select("o_orderkey", identity.row_digest(o, *_ORDER).alias("digest"), identity.row_digest(o, "at", "o_orderkey").alias("exact_digest"), identity.row_digest(o, "cents", "raw").alias("typed_digest"))


ROW_DIGESTS = f"""SELECT o_orderkey, sha256({_ORDER_JSON}) AS digest, sha256('{{"at":"' || strftime(tm, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '.' || strftime(tm, '%f') END || '+00:00","o_orderkey":' || o_orderkey || '}}') AS exact_digest,
  sha256('{{"cents":"' || CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) || '","raw":"' || lower(hex(o_orderstatus)) || '"}}') AS typed_digest FROM (SELECT *, o_orderdate::TIMESTAMP + to_microseconds(o_orderkey % 3 * 250001) AS tm FROM orders)"""


def flat_digest(spark, sf_dir):
    """The digest of each nation's customers, the sums of the first half's added to those of the second."""
    c = _read(spark, sf_dir, "customer")
    part = lambda k: versions.content_sums(c.where(F.col("c_custkey") % 2 == k), identity.row_digest(c, "c_custkey", "c_mktsegment"), ("c_nationkey",))
    both = versions.added(part(0).union(part(1)), ("c_nationkey",))
    return both.select("c_nationkey", versions.digest_of(F.col("n_rows"), F.col("lanes")).alias("content_digest"), F.col("n_rows").alias("row_count"))


FLAT_DIGEST = _sums_sql("c_nationkey", """(SELECT c_nationkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS d FROM customer)""")


def current_state(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", F.col("event_id"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return versions.latest(e, "user_id", "at", "event_id")


CURRENT_STATE = "SELECT user_id, event_id, event_type, epoch_us(ts) AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"

_DIM = 64


def _linear(spark, sf_dir):
    """Encoded rows, and coefficients with exact means of sixteenths, which no order of addition changes."""
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("prediction_id"), F.transform("embedding", lambda v: F.round(v.cast("double") * 16) / 16).alias("x"), "label")
    means = rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg((F.sum("v") / F.count("*")).alias("mean"))
    return rows, means.withColumn("coefficient", ((F.col("pos") * 7) % 11 - 5) / F.lit(64.0))


_LINEAR = """r AS (SELECT vec_id AS prediction_id, label, unnest(range(0, 64)) AS pos, unnest([round(v::DOUBLE * 16) / 16 FOR v IN embedding]) AS v FROM embeddings),
c AS (SELECT pos, sum(v) / count(*) AS mean, ((pos * 7) % 11 - 5) / 64.0 AS coefficient FROM r GROUP BY pos),
a AS (SELECT prediction_id, pos, coefficient * (v - mean) AS shap_value FROM r JOIN c USING (pos)),
k AS (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY abs(shap_value) DESC, pos) AS abs_rank FROM a)"""


def top_attributions(spark, sf_dir):
    rows, coefficients = _linear(spark, sf_dir)
    return explain.top(explain.attribute(rows, coefficients), 10)


TOP_ATTRIBUTIONS = f"WITH {_LINEAR} SELECT prediction_id, pos::INT AS pos, shap_value, abs_rank::INT AS abs_rank FROM k WHERE abs_rank <= 10"


def reconciliation(spark, sf_dir):
    rows, coefficients = _linear(spark, sf_dir)
    base = coefficients.agg(F.sum(F.col("coefficient") * F.col("mean")).alias("base_value"))
    w = coefficients.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "coefficient"))), lambda s: s.coefficient).alias("w"))
    margin = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    wrong = F.when(F.col("prediction_id") % 100 == 7, 0.001).otherwise(0.0)
    p = rows.join(F.broadcast(w)).join(F.broadcast(base)).select("prediction_id", fit.probability(margin + wrong).alias("score"), "base_value", F.lit("logit").alias("link"))  # one row each
    out = explain.reconcile(explain.attribute(rows, coefficients), p)
    # the sums lie on a grid; moved off it, they round alike whatever the order of addition
    return out.select("prediction_id", "verdict", *(F.round(F.col(c) + 1.234e-7, 6).alias(c) for c in ("shown", "residual", "base_value")))


RECONCILIATION = f"""WITH {_LINEAR}, b AS (SELECT sum(coefficient * mean) AS b FROM c),
s AS (SELECT prediction_id, sum(CASE WHEN abs_rank <= 10 THEN shap_value ELSE 0 END) AS shown, sum(CASE WHEN abs_rank > 10 THEN shap_value ELSE 0 END) AS residual FROM k GROUP BY 1)
SELECT prediction_id, CASE WHEN prediction_id % 100 = 7 THEN 'mismatch' ELSE 'ok' END AS verdict, round(shown + 1.234e-7, 6) AS shown, round(residual + 1.234e-7, 6) AS residual, round(b + 1.234e-7, 6) AS base_value FROM s, b"""


def denial_drivers(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").join(F.broadcast(_read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    value = F.create_map(F.lit("balance"), F.round(F.col("c_acctbal") - 5000), F.lit("segment"), F.when(F.col("c_mktsegment") == "BUILDING", 1500.0).otherwise(-500.0))
    tall = c.select(F.col("c_custkey").alias("prediction_id"), F.explode(value).alias("source_feature", "shap_value"))
    made = c.select(F.col("c_custkey").alias("prediction_id"), "n_name", scoring.decision(F.round(F.col("c_acctbal") - 5000) + F.when(F.col("c_mktsegment") == "BUILDING", 1500.0).otherwise(-500.0), 0.0).alias("decision"))
    return explain.drivers(tall, made, F.col("n_name")).withColumn("mean_value", F.round("mean_value", 6))


DENIAL_DRIVERS = """
WITH c AS (SELECT c_custkey, n_name, round(c_acctbal - 5000) AS balance, CASE WHEN c_mktsegment = 'BUILDING' THEN 1500.0 ELSE -500.0 END AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT n_name, unnest(['balance', 'segment']) AS source_feature, unnest([balance, segment::DOUBLE]) AS v FROM c WHERE balance + segment < 0)
SELECT n_name AS group_value, source_feature, count(*) AS decisions, round(avg(v), 6) AS mean_value, sum(CAST(v < 0 AS INT)) AS toward_denial FROM t GROUP BY ALL
"""


def described_attributions(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("prediction_id"), F.explode(F.array(*(F.lit(f"cat__segment_{s}") for s in ("BUILDING", "MACHINERY")), F.lit("num__balance"))).alias("feature_name"), "c_mktsegment", "c_acctbal")
    c = c.select("prediction_id", "feature_name", F.when(F.col("feature_name") == "num__balance", F.round("c_acctbal").cast("long").cast("string")).otherwise(F.col("c_mktsegment")).alias("feature_value_str"), (F.round("c_acctbal") - 5000).alias("shap_value"))
    d = spark.createDataFrame([("cat__segment_BUILDING", "segment", "BUILDING"), ("cat__segment_MACHINERY", "segment", "MACHINERY"), ("num__balance", "balance", None)], "feature_name string, source_feature string, category string")
    return explain.described(c, F.broadcast(d))  # three rows


DESCRIBED_ATTRIBUTIONS = """
WITH d(feature_name, source_feature, category) AS (VALUES ('cat__segment_BUILDING', 'segment', 'BUILDING'), ('cat__segment_MACHINERY', 'segment', 'MACHINERY'), ('num__balance', 'balance', NULL)),
a AS (SELECT c_custkey AS prediction_id, d.*, CASE WHEN category IS NULL THEN round(c_acctbal)::BIGINT::VARCHAR ELSE c_mktsegment END AS v, round(c_acctbal) - 5000 AS shap_value FROM customer, d)
SELECT prediction_id, feature_name, v AS feature_value_str, shap_value, source_feature, category AS encoded_category, CASE WHEN shap_value > 0 THEN 'toward approval' ELSE 'toward denial' END AS direction, category IS NULL OR category = v AS applies,
  source_feature || CASE WHEN category IS NULL OR category = v THEN ' = ' ELSE ' is not ' END || coalesce(category, v) AS statement FROM a
"""

_STATUS = "CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'retired' ELSE 'active' END"


def _trail_of_events(spark, sf_dir):
    """Memberships from events; a model of each type but one, which stays unregistered; two data versions, one gone."""
    e = _read(spark, sf_dir, "events")
    membership = e.select(F.col("user_id").cast("string").alias("subject_id"), F.col("event_type").alias("model_version_id"), F.when(F.col("event_id") % 5 == 0, "eval").otherwise("train").alias("role")).distinct()
    models = e.select("event_type").distinct().where("event_type <> 'purchase'").select(F.col("event_type").alias("model_version_id"), F.expr(_STATUS).alias("status"), F.concat(F.lit("v"), (F.length("event_type") % 2).cast("string")).alias("data_snapshot_uuid"), F.lit("v9").alias("eval_snapshot_uuid"))
    return e, membership, models, spark.createDataFrame([("v1",)], "data_snapshot_uuid string")


_TRAIL = f"""m AS (SELECT DISTINCT user_id::VARCHAR AS subject_id, event_type AS model_version_id, CASE WHEN event_id % 5 = 0 THEN 'eval' ELSE 'train' END AS role FROM events),
v AS (SELECT DISTINCT event_type AS model_version_id, {_STATUS} AS status, length(event_type) % 2 <> 1 AS reproducible FROM events WHERE event_type <> 'purchase'),
x AS (SELECT subject_id, model_version_id, role, v.status IS NOT NULL AS registered, status, coalesce(status = 'active', false) AS serving, coalesce(reproducible, false) AS reproducible FROM m LEFT JOIN v USING (model_version_id))"""


def contaminations(spark, sf_dir):
    _, membership, models, gone = _trail_of_events(spark, sf_dir)
    return contamination.contaminations(membership, models, gone)


CONTAMINATIONS = f"WITH {_TRAIL} SELECT * FROM x"


def contamination_rollup(spark, sf_dir):
    e, membership, models, gone = _trail_of_events(spark, sf_dir)
    made = e.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("subject_id"))
    live = contamination.live_rows({"orders": _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("subject_id")), "customer": _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("subject_id"))})
    out = contamination.rollup(contamination.contaminations(membership, models, gone), made, live)
    return out.withColumn("model_version_ids", F.array_join("model_version_ids", ","))


CONTAMINATION_ROLLUP = f"""WITH {_TRAIL},
c AS (SELECT subject_id, array_to_string(list_sort(list(DISTINCT model_version_id)), ',') AS ids, count(DISTINCT model_version_id) AS n_models, count(DISTINCT CASE WHEN serving THEN model_version_id END) AS n_serving, count(DISTINCT CASE WHEN NOT registered THEN model_version_id END) AS n_orphaned FROM x GROUP BY 1),
d AS (SELECT user_id::VARCHAR AS subject_id, count(*) AS n_decisions FROM events WHERE event_type = 'purchase' GROUP BY 1),
l AS (SELECT subject_id, count(*) AS n_live_rows FROM (SELECT o_custkey::VARCHAR AS subject_id FROM orders UNION ALL SELECT c_custkey::VARCHAR FROM customer) GROUP BY 1)
SELECT subject_id, coalesce(ids, '') AS model_version_ids, coalesce(n_models, 0) AS n_models, coalesce(n_serving, 0) AS n_serving, coalesce(n_orphaned, 0) AS n_orphaned, coalesce(n_decisions, 0) AS n_decisions, coalesce(n_live_rows, 0) AS n_live_rows,
  coalesce(n_models, 0) > 0 OR coalesce(n_decisions, 0) > 0 OR coalesce(n_live_rows, 0) > 0 AS known FROM c FULL JOIN d USING (subject_id) FULL JOIN l USING (subject_id)"""


def versions_with_subjects(spark, sf_dir):
    """Which (year, status) versions of orders hold rows of large customers."""
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderstatus").alias("split"), F.year("o_orderdate").cast("long").alias("commit_seq"))
    every = rows.select(F.col("commit_seq").alias("version"), F.col("split").alias("split_filter")).distinct()
    every = every.select(F.concat_ws("-", "version", "split_filter").alias("data_snapshot_uuid"), "version", "split_filter")
    subjects = _read(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("subject_id"))
    return contamination.versions_with(subjects, rows, every)


VERSIONS_WITH_SUBJECTS = """WITH r AS (SELECT o_custkey, o_orderstatus AS s, year(o_orderdate) AS y FROM orders), v AS (SELECT DISTINCT y, s FROM r)
SELECT y || '-' || s AS data_snapshot_uuid, y AS version, s AS split_filter FROM v WHERE EXISTS (SELECT 1 FROM r JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9900 AND r.s = v.s AND r.y <= v.y)"""


def pinned_models(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("model_version_id"), F.col("o_custkey").alias("data_snapshot_uuid"), (F.col("o_custkey") % 50).alias("eval_snapshot_uuid"))
    v = _read(spark, sf_dir, "customer").where("c_nationkey < 3").select(F.col("c_custkey").alias("data_snapshot_uuid"))
    return contamination.pins(v, o)


PINNED_MODELS = """SELECT DISTINCT data_snapshot_uuid, m AS model_version_id
FROM (SELECT o_orderkey::VARCHAR AS m, unnest([o_custkey, o_custkey % 50]) AS data_snapshot_uuid FROM orders) JOIN customer ON c_custkey = data_snapshot_uuid AND c_nationkey < 3"""


def evaluation_conflicts(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evaluation_id"), F.col("o_totalprice").alias("metric_value"))
    return fairness.conflicts(o, o.where("evaluation_id % 3 = 0").withColumn("metric_value", F.when(F.col("evaluation_id") % 9 == 0, F.col("metric_value") + 1).otherwise(F.col("metric_value"))))


EVALUATION_CONFLICTS = "SELECT o_orderkey AS evaluation_id, o_totalprice AS metric_value, o_totalprice + 1 AS recorded_value FROM orders WHERE o_orderkey % 9 = 0"


def reusable_models(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("model_version_id"), F.col("o_orderdate").alias("trained_at"), F.when(F.col("o_orderstatus") == "P", "tombstoned").otherwise("active").alias("status"), F.col("o_orderpriority").alias("config_digest"), (F.col("o_custkey") % 40).alias("data_snapshot_uuid"), (F.col("o_custkey") % 7).alias("eval_snapshot_uuid"))
    want = _read(spark, sf_dir, "customer").crossJoin(F.broadcast(spark.createDataFrame([("1-URGENT",), ("none",)], "config_digest string")))  # two configurations
    return fairness.reusable(want.select(F.concat_ws("-", "c_custkey", "config_digest").alias("want_id"), "config_digest", (F.col("c_custkey") % 40).alias("data_snapshot_uuid"), (F.col("c_custkey") % 7).alias("eval_snapshot_uuid")), o)


REUSABLE_MODELS = """WITH o AS (SELECT o_orderpriority AS c, o_custkey % 40 AS d, o_custkey % 7 AS e, o_orderkey AS model_version_id FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 40, o_custkey % 7 ORDER BY o_orderdate, o_orderkey) = 1)
SELECT c_custkey || '-' || k AS want_id, model_version_id FROM customer CROSS JOIN (VALUES ('1-URGENT'), ('none')) t(k) LEFT JOIN o ON c = k AND d = c_custkey % 40 AND e = c_custkey % 7"""


def comparison_refusals(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("model_version_id"), (F.col("c_nationkey") % 2).cast("string").alias("eval_snapshot_uuid"), F.when(F.col("c_mktsegment") == "BUILDING", "other").otherwise("known").alias("recipe"))
    pairs = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("baseline"), F.coalesce(F.nullif(F.col("o_orderkey") % 200, F.lit(0)), F.lit(-1)).cast("string").alias("candidate"), F.when(F.col("o_orderstatus") == "O", "1").alias("eval_choice"))
    return fairness.refusals(pairs, c, ["known"])


COMPARISON_REFUSALS = """WITH m AS (SELECT c_custkey::VARCHAR AS id, c_nationkey % 2 AS e, c_mktsegment = 'BUILDING' AS other FROM customer),
p AS (SELECT o_custkey::VARCHAR AS baseline, coalesce(nullif(o_orderkey % 200, 0), -1)::VARCHAR AS candidate, CASE WHEN o_orderstatus = 'O' THEN '1' END AS eval_choice FROM orders)
SELECT baseline, candidate, eval_choice, CASE WHEN baseline = candidate THEN 'same version' WHEN a.id IS NULL OR b.id IS NULL THEN 'missing model' WHEN a.e <> b.e AND eval_choice IS NULL THEN 'different eval versions' WHEN a.other OR b.other THEN 'unknown recipe' END AS refusal
FROM p LEFT JOIN m a ON a.id = baseline LEFT JOIN m b ON b.id = candidate"""


def exact_auc(spark, sf_dir):
    return fit.auc(_decided(spark, sf_dir), "n_chars", "quality", ("lang",)).withColumn("auc", F.round("auc", 9))


EXACT_AUC = """WITH r AS (SELECT lang, quality, rank() OVER w + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS mid FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY n_chars))
SELECT lang, round((sum(quality * mid) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE) / nullif(sum(quality) * (count(*) - sum(quality)), 0), 9) AS auc, sum(quality) AS n_positive, count(*) AS n FROM r GROUP BY 1"""


def unknown_inputs(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", "props", "event_type")
    payload = F.when(F.col("event_type") == "click", F.regexp_replace("props", '"k"', '"z"')).otherwise(F.col("props"))
    return e.select("event_id", F.array_join(scoring.unknown_features(payload, ["k"]), ",").alias("unknown"), identity.sha256(scoring.canonical_payload(payload)).alias("input_digest"))


UNKNOWN_INPUTS = """WITH e AS (SELECT event_id, CASE WHEN event_type = 'click' THEN replace(props, '"k"', '"z"') ELSE props END AS p FROM events)
SELECT event_id, array_to_string(list_sort(list_filter(coalesce(json_keys(p), []), lambda x: x <> 'k')), ',') AS unknown, sha256('{"' || json_keys(p)[1] || '":"' || (p ->> json_keys(p)[1]) || '"}') AS input_digest FROM e"""


def encoded_rows(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("long"))
    columns = fit.encoding(rows, ("cents",), ("c_mktsegment",))
    tall = rows.select("c_custkey", F.posexplode(fit.encoded(columns)).alias("pos", "value"))
    return tall.withColumn("value", F.round("value", 9))


ENCODED_ROWS = """WITH c AS (SELECT c_custkey, round(c_acctbal * 100)::BIGINT AS cents, c_mktsegment FROM customer), s AS (SELECT avg(cents) AS m, stddev_pop(cents) AS d FROM c),
v AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) AS pos FROM (SELECT DISTINCT c_mktsegment FROM c))
SELECT c_custkey, 0 AS pos, round((cents - m) / d, 9) AS value FROM c, s UNION ALL SELECT c_custkey, pos, CASE WHEN c_mktsegment = v THEN 1.0 ELSE 0.0 END FROM c, v"""


def fitted_scores(spark, sf_dir):
    """A fit of document quality on length and language, and the score of every labelled document."""
    rows = _decided(spark, sf_dir).select(F.col("doc_id").cast("string").alias("subject_id"), "n_chars", "lang", "source", F.col("quality").alias("label"))
    columns = fit.encoding(rows, ("n_chars",), ("lang", "source"))
    data = rows.withColumn("x", fit.encoded(columns))
    w, _ = fit.fit(data)
    return data.select("subject_id", "label", fit.probability(fit.linear_score(list(map(float, w[1:])), w[0])).alias("score"))


def model_digests(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("model_version_id"), F.posexplode("embedding").alias("pos", "v"))
    c = e.select("model_version_id", "pos", F.concat(F.lit("f"), F.col("pos").cast("string")).alias("feature_name"), (F.round(F.col("v").cast("double") * 1024) / 1024).alias("coefficient"), F.lit("f").alias("source_feature"), F.lit(None).cast("string").alias("category"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("centre"), F.lit(1.0).alias("scale"))
    d = fit.artifact_digests(c)
    models = d.select("model_version_id", F.when(F.col("model_version_id").endswith("7"), "0").otherwise(F.col("artifact_digest")).alias("artifact_digest")).where("NOT endswith(model_version_id, '3')").union(spark.createDataFrame([("gone", "1")], "a string, b string"))
    return fit.model_verdicts(models, c)


MODEL_DIGESTS = """SELECT vec_id::VARCHAR AS model_version_id, CASE vec_id % 10 WHEN 3 THEN 'row missing' WHEN 7 THEN 'mismatch' ELSE 'ok' END AS verdict FROM embeddings UNION ALL SELECT 'gone', 'artifact missing'"""


def _customer_lines(spark, sf_dir, where="true"):
    """Customers (those that meet a condition) as raw application lines, with blank, barred and short ones between."""
    c = _read(spark, sf_dir, "customer").where(where)
    f = [F.lit(" 39"), F.when(F.col("c_custkey") % 4 == 0, "?").otherwise(F.col("c_mktsegment")), F.col("c_custkey").cast("string"), F.lit("Masters"), F.lit("14"), F.lit("Divorced"), F.lit("Sales"), F.lit("Wife"), F.lit("White"), F.when(F.col("c_custkey") % 2 == 0, "Male").otherwise("Female"), F.lit("0"), F.lit("0"), F.lit("40"), F.col("c_nationkey").cast("string"), F.when(F.col("c_acctbal") > 5000, ">50K.").otherwise("<=50K")]
    line = F.when(F.col("c_custkey") % 10 == 1, "").when(F.col("c_custkey") % 10 == 2, "|header").when(F.col("c_custkey") % 10 == 3, "1,2").otherwise(F.concat_ws(", ", *f))
    return c.select(line.alias("value"))


def parsed_applications(spark, sf_dir):
    return applications.parse(_customer_lines(spark, sf_dir), "b").select("subject_id", "split", "workclass", "fnlwgt", "sex", "label")


PARSED_APPLICATIONS = """WITH l AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS workclass, CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
  '39, ' || CASE WHEN c_custkey % 4 = 0 THEN '?' ELSE c_mktsegment END || ', ' || c_custkey || ', Masters, 14, Divorced, Sales, Wife, White, ' || CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END || ', 0, 0, 40, ' || c_nationkey || ', ' || CASE WHEN c_acctbal > 5000 THEN '>50K.' ELSE '<=50K' END AS line FROM customer WHERE c_custkey % 10 NOT IN (1, 2, 3)),
s AS (SELECT *, substr(sha256(line || '#0'), 1, 16) AS subject_id FROM l)
SELECT subject_id, CASE WHEN ('0x' || substr(subject_id, 1, 8))::BIGINT % 100 < 70 THEN 'train' WHEN ('0x' || substr(subject_id, 1, 8))::BIGINT % 100 < 85 THEN 'eval' ELSE 'holdout' END AS split, workclass, c_custkey::INT AS fnlwgt, sex, CAST(c_acctbal > 5000 AS INT) AS label FROM s"""


def erased_table(spark, sf_dir):
    """A subject table after the customers of one nation are erased: what is left, by bucket rewrite."""
    trail = Trail(spark, _root(spark))
    trail.bootstrap()
    rows = _read(spark, sf_dir, "customer").select(F.lit("m").alias("model_version_id"), F.col("c_custkey").cast("string").alias("subject_id"), F.lit("train").alias("role"), F.col("c_name").alias("row_digest"))
    trail.append("audit.training_membership", rows)
    gone = _read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("subject_id"))
    erasure.remove_rows(trail, "audit.training_membership", gone)
    if erasure.residue(trail, "audit.training_membership", gone).take(1):
        raise RuntimeError("erased subjects are still stored")
    return trail.read("audit.training_membership").select("subject_id", "row_digest")


ERASED_TABLE = "SELECT c_custkey::VARCHAR AS subject_id, c_name AS row_digest FROM customer WHERE c_nationkey <> 3"


_DRAINED: dict[tuple, Trail] = {}


def _drained(spark, sf_dir) -> Trail:
    """Events spooled as JSON lines and drained; then repeats with another day, torn and wrong lines; then all of it replayed."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir, "events"))
    if key in _DRAINED:
        return _DRAINED[key]
    root = _root(spark)
    trail = Trail(spark, root)
    trail.bootstrap()
    e = _read(spark, sf_dir, "events").where("ts IS NOT NULL AND value IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    made = lambda rows: rows.select(F.col("event_id").cast("string").alias("prediction_id"), F.col("ts").alias("prediction_ts"), F.lit("m").alias("model_version_id"), F.col("user_id").cast("string").alias("subject_id"), F.lit("{}").alias("input_json"), F.lit("d").alias("input_digest"), F.col("value").alias("score"), F.lit(0.5).alias("threshold"), scoring.decision(F.col("value"), 0.5).alias("decision"), F.lit("complete").alias("explainer_status"), F.lit(1.0).alias("latency_ms"), F.lit(1.0).alias("shap_ms"))

    def spooled(p: DataFrame) -> DataFrame:
        wrong = F.when(F.col("prediction_id").cast("long") % 13 == 5, 0.5).otherwise(0.0)
        parts = F.explode(F.array(F.struct(F.lit("f1").alias("f"), (F.col("score") - 0.5 + wrong).alias("v")), F.struct(F.lit("f2").alias("f"), F.lit(0.25).alias("v"))))
        a = p.select("prediction_id", "prediction_ts", "model_version_id", "score", parts.alias("x")).select("prediction_id", "prediction_ts", "model_version_id", F.col("x.f").alias("feature_name"), F.lit("v").alias("feature_value_str"), F.col("x.v").alias("shap_value"), F.lit(0.25).alias("base_value"), F.lit(1).alias("abs_rank"), F.lit("tree").alias("explainer_type"))
        return decisions.encoded_lines(p, a)

    spooled(made(e)).write.text(f"{root}/spool/first", compression="gzip")
    decisions.drain(trail, f"{root}/spool/*", f"{root}/ck1").awaitTermination()
    late = spooled(made(e.where("event_id % 11 = 0").withColumn("ts", F.expr("ts + INTERVAL 1 DAY"))))
    torn = spooled(made(e.where("event_id % 7 = 0"))).select(F.expr("substring(value, 1, 60)").alias("value"))
    part = spooled(made(e.where("event_id % 17 = 0"))).select(F.regexp_replace("value", '"attributions":.*$', '"x":1}').alias("value"))
    late.union(torn).union(part).write.text(f"{root}/spool/second", compression="gzip")
    decisions.drain(trail, f"{root}/spool/*", f"{root}/ck1").awaitTermination()
    decisions.drain(trail, f"{root}/spool/*", f"{root}/ck2").awaitTermination()  # a replay adds nothing
    _DRAINED[key] = trail
    return trail


def _stamp(spark, sf_dir, table: str) -> int:
    """The size and time of a table's folder or file, so that what was built of it isn't taken for another."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() * 31 + fs.getFileStatus(p).getModificationTime()


def drained_decisions(spark, sf_dir):
    """Every decision once and at its first time, though some came again with another day."""
    trail = _drained(spark, sf_dir)
    n = trail.read("audit.attributions").groupBy("prediction_id").agg(F.count("*").alias("n_attributions"))
    return trail.read("audit.predictions").select("prediction_id", "subject_id", "decision", F.round("score", 6).alias("score"), F.unix_micros("prediction_ts").alias("at")).join(n, "prediction_id")


DRAINED_DECISIONS = "SELECT event_id::VARCHAR AS prediction_id, user_id::VARCHAR AS subject_id, CASE WHEN value >= 0.5 THEN 'approve' ELSE 'deny' END AS decision, round(value, 6) AS score, epoch_us(ts) AS at, 2 AS n_attributions FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND event_id % 13 <> 5"


def refused_lines(spark, sf_dir):
    """Lines that can't be recorded, each kept once with its reason, whatever was replayed."""
    rows = _drained(spark, sf_dir).read("audit.rejects")
    whose = F.regexp_extract("line", '"prediction_id":"([0-9]+)"', 1)
    return rows.select("reason", F.when(F.col("reason") != "torn", whose).alias("prediction_id")).groupBy("reason", "prediction_id").agg(F.count("*").alias("n"))


REFUSED_LINES = """WITH e AS (SELECT event_id FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
SELECT 'not additive' AS reason, event_id::VARCHAR AS prediction_id, 1 + CAST(event_id % 11 = 0 AS INT) AS n FROM e WHERE event_id % 13 = 5
UNION ALL SELECT 'incomplete', event_id::VARCHAR, 1 FROM e WHERE event_id % 17 = 0
UNION ALL SELECT 'torn', NULL, count(DISTINCT substr('{"prediction":{"prediction_id":"' || event_id || '","prediction_ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00"', 1, 60)) FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND event_id % 7 = 0 HAVING count(*) > 0"""


def explanation_reports(spark, sf_dir):
    """Reports of asked ids: some unknown, some of a model that isn't registered, some of an unrecorded version, some tampered with."""
    rows, coefficients = _linear(spark, sf_dir)
    tall = explain.attribute(rows, coefficients)
    base = coefficients.agg(F.sum(F.col("coefficient") * F.col("mean")).alias("base_value"))
    total = tall.groupBy("prediction_id").agg(F.sum("shap_value").alias("t")).join(F.broadcast(base))  # one row
    wrong = F.when(F.col("prediction_id") % 10 == 4, 0.01).otherwise(0.0)
    p = rows.select("prediction_id", "label").join(total, "prediction_id").select("prediction_id", F.concat(F.lit("m"), F.col("label").cast("string")).alias("model_version_id"), F.col("label").cast("string").alias("subject_id"), fit.probability(F.col("t") + F.col("base_value") + wrong).alias("score"), F.lit(0.5).alias("threshold"))
    p = p.withColumn("decision", scoring.decision(F.col("score"), 0.5))
    labels = rows.select("label").distinct()
    models = labels.where("label <> 3").select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("model_version_id"), F.concat(F.lit("v"), (F.col("label") % 4).cast("string")).alias("data_snapshot_uuid"), F.lit("tracewell.linear").alias("estimator_class"))
    snaps = labels.where("label < 4 AND label <> 2").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("data_snapshot_uuid"), F.lit("live").alias("status"), F.lit("d").alias("content_digest"))
    a = tall.join(F.broadcast(base)).select("prediction_id", F.col("pos").cast("string").alias("feature_name"), F.lit("x").alias("feature_value_str"), "shap_value", "abs_rank", "base_value", F.lit("linear").alias("explainer_type"))
    ids = rows.select((F.col("prediction_id") * 2).alias("prediction_id"))
    out = explain.reports(ids, p, models, snaps, a, 3)
    return out.select("prediction_id", "status", "failure", "model_version_id", F.transform("attributions", lambda x: x.feature_name).alias("top")).withColumn("top", F.array_join("top", ","))


EXPLANATION_REPORTS = f"""WITH {_LINEAR}, t AS (SELECT prediction_id, string_agg(pos::VARCHAR, ',' ORDER BY abs_rank) AS top FROM k WHERE abs_rank <= 3 GROUP BY 1),
e AS (SELECT vec_id, label FROM embeddings)
SELECT 2 * e.vec_id AS prediction_id, CASE WHEN p.vec_id IS NULL THEN 'not_found' WHEN p.label = 3 OR p.label % 4 = 2 OR p.vec_id % 10 = 4 THEN 'integrity_failure' ELSE 'ok' END AS status,
  CASE WHEN p.vec_id IS NULL THEN NULL WHEN p.label = 3 THEN 'model version missing' WHEN p.label % 4 = 2 THEN 'data version missing' WHEN p.vec_id % 10 = 4 THEN 'attributions don''t add up to the score' END AS failure, 'm' || p.label AS model_version_id, t.top
FROM e LEFT JOIN e p ON p.vec_id = 2 * e.vec_id LEFT JOIN t ON t.prediction_id = 2 * e.vec_id"""


def _ingested(spark, sf_dir):
    from tracewell.plans.ingest import ingest

    trail = Trail(spark, _root(spark))
    trail.bootstrap()
    rows = applications.parse(_customer_lines(spark, sf_dir), "b")
    return trail, ingest(trail, rows), rows


def trail_inventory(spark, sf_dir):
    """Rows and commits of every table after customers are ingested as applications, twice."""
    from tracewell.plans.ingest import ingest

    trail, _, rows = _ingested(spark, sf_dir)
    ingest(trail, rows)
    return trail.inventory()


TRAIL_INVENTORY = f"""WITH p AS ({PARSED_APPLICATIONS}), c AS (SELECT count(*) AS n, count(*) FILTER (split = 'eval') AS e, count(DISTINCT split) AS s FROM p)
SELECT 'features.credit_applications' AS table_identifier, n AS n_rows, 1 AS commits FROM c UNION ALL SELECT 'features.eval_holdout', e, 1 FROM c UNION ALL SELECT 'audit.data_snapshots', 2, 2 UNION ALL SELECT 'audit.commits', 5, 0 UNION ALL SELECT 'audit.content_sums', s + 1, 0 FROM c
UNION ALL SELECT unnest(['audit.model_versions', 'audit.model_coefficients', 'audit.training_membership', 'audit.predictions', 'audit.attributions', 'audit.fairness_evaluations', 'audit.fairness_decompositions', 'audit.erasure_requests', 'audit.snapshot_tombstones', 'audit.decision_ids', 'audit.rejects']), 0, 0"""


def erasure_outcome(spark, sf_dir):
    """Requests after all women of two nations are erased by the full procedure: state, live rows removed, versions lost."""
    trail, _, rows = _ingested(spark, sf_dir)
    gone = rows.where("sex = 'Female' AND native_country IN ('3', '7')").select("subject_id")
    erasure.erase(trail, gone)
    done = trail.current("audit.erasure_requests", "request_id")
    stones = trail.read("audit.snapshot_tombstones").agg(F.count("*").alias("tombstones"))
    left = trail.read("features.credit_applications").agg(F.count("*").alias("rows_left"))
    return done.join(F.broadcast(stones)).join(F.broadcast(left)).select("subject_id", "status", "live_rows_deleted", "tombstones", "rows_left")  # one row each


ERASURE_OUTCOME = f"""WITH p AS ({PARSED_APPLICATIONS}), g AS (SELECT p.*, c_nationkey FROM p JOIN customer ON c_custkey = fnlwgt), x AS (SELECT * FROM g WHERE sex = 'Female' AND c_nationkey IN (3, 7))
SELECT subject_id, 'completed' AS status, CASE split WHEN 'eval' THEN 2 ELSE 1 END AS live_rows_deleted, (SELECT CAST(count(*) FILTER (split = 'train') > 0 AS INT) + CAST(count(*) FILTER (split = 'eval') > 0 AS INT) FROM x) AS tombstones, (SELECT count(*) FROM p) - (SELECT count(*) FROM x) AS rows_left FROM x"""


def drifted_models(spark, sf_dir):
    m = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("model_version_id"), F.col("o_orderpriority").alias("env_digest"))
    return fit.environment_drift(m, "1-URGENT")


DRIFTED_MODELS = "SELECT o_orderkey AS model_version_id, o_orderpriority AS env_digest FROM orders WHERE o_orderpriority <> '1-URGENT'"

_QUERIES = {
    "group_rates": GROUP_RATES, "group_differences": GROUP_DIFFERENCES, "metric_rows": METRIC_ROWS, "segment_rates": SEGMENT_RATES, "decomposition": DECOMPOSITION, "subject_splits": SUBJECT_SPLITS, "split_counts": SPLIT_COUNTS,
    "version_summary": VERSION_SUMMARY, "row_digests": ROW_DIGESTS, "flat_digest": FLAT_DIGEST, "current_state": CURRENT_STATE, "top_attributions": TOP_ATTRIBUTIONS, "reconciliation": RECONCILIATION,
    "denial_drivers": DENIAL_DRIVERS, "described_attributions": DESCRIBED_ATTRIBUTIONS, "contaminations": CONTAMINATIONS, "contamination_rollup": CONTAMINATION_ROLLUP, "versions_with_subjects": VERSIONS_WITH_SUBJECTS, "pinned_models": PINNED_MODELS,
    "evaluation_conflicts": EVALUATION_CONFLICTS, "reusable_models": REUSABLE_MODELS, "comparison_refusals": COMPARISON_REFUSALS, "exact_auc": EXACT_AUC, "unknown_inputs": UNKNOWN_INPUTS, "encoded_rows": ENCODED_ROWS, "fitted_scores": None,
    "model_digests": MODEL_DIGESTS, "parsed_applications": PARSED_APPLICATIONS, "erased_table": ERASED_TABLE, "drained_decisions": DRAINED_DECISIONS, "refused_lines": REFUSED_LINES, "rate_curves": RATE_CURVES,
    "explanation_reports": EXPLANATION_REPORTS, "trail_inventory": TRAIL_INVENTORY, "erasure_outcome": ERASURE_OUTCOME, "drifted_models": DRIFTED_MODELS,
}


def _all() -> dict:
    from tracewell import trail_queries

    return {n: (globals()[n], sql) for n, sql in _QUERIES.items()} | {n: (getattr(trail_queries, n), sql) for n, sql in trail_queries.QUERIES.items()}


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
