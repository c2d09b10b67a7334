"""Registered queries that run the trail's plans over the given tables: customers as applicants, and what follows.

Each calls the library's own procedures and returns rows that SQL can state from the tables. A trained trail is built once
for a session and folder and only read by the queries that share it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import identity
from tracewell.operators import contamination, fit, versions
from tracewell.operators.versions import SnapshotTombstonedError, Trail
from tracewell.plans import erasure, models
from tracewell.plans.ingest import ingest
from tracewell.queries import PARSED_APPLICATIONS, _customer_lines, _decided, _ingested, _read, _root, _stamp
from tracewell.sources import applications
from tracewell.streaming import decisions

APPLICATIONS, HOLDOUT = "features.credit_applications", "features.eval_holdout"
_BUILT: dict[tuple, dict] = {}
_P = f"p AS MATERIALIZED ({PARSED_APPLICATIONS})"
#: Columns of an encoded application: six numbers, and the categories that the customers' lines have.
_WIDTH = "(SELECT 6 + count(DISTINCT coalesce(workclass, '?')) + 5 + count(DISTINCT sex) + count(DISTINCT c_nationkey) FROM p JOIN customer ON c_custkey = fnlwgt WHERE split = 'train')"


def _captured(spark: SparkSession, sf_dir: str) -> tuple[Trail, dict]:
    """A trail with customers ingested, and what the ingest returned."""
    key = ("captured", spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir, "customer"))
    if key not in _BUILT:
        trail, first, _ = _ingested(spark, sf_dir)
        _BUILT[key] = {"trail": trail, "first": first}
    return _BUILT[key]["trail"], _BUILT[key]["first"]


def _trained(spark: SparkSession, sf_dir: str) -> dict:
    """The captured trail with a model trained on it; decisions recorded for the evaluation subjects."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir, "customer"))
    if key not in _BUILT:
        trail, first = _captured(spark, sf_dir)
        model = models.train(trail, first["train_snapshot"], first["eval_snapshot"], env_digest="e", code_git_sha="c")
        held = trail.materialize(first["eval_snapshot"])
        asked = held.select(F.col("subject_id").alias("request_key"), "subject_id", *versions.input_columns())
        odd = asked.withColumn("shoe_size", F.when(F.col("sex") == "Male", F.lit(44)))
        p, a, rejected = models.decide(trail, model, odd)
        models.record_decisions(trail, p, a)
        models.record_refusals(trail, rejected)
        again = models.record_decisions(trail, *models.decide(trail, model, odd)[:2])  # a retried batch
        _BUILT[key] = {"trail": trail, "first": first, "model": model, "rejected": rejected, "again": again}
    return _BUILT[key]


def registered_members(spark, sf_dir):
    """Membership of a trained model by role, with its checked artifact and state (train, M5, M6)."""
    t = _trained(spark, sf_dir)
    trail = t["trail"]
    own = trail.find("audit.model_versions", "model_version_id", t["model"])
    verdict = fit.model_verdicts(own, trail.read("audit.model_coefficients").where(F.col("model_version_id") == t["model"]))
    members = trail.read("audit.training_membership").groupBy("model_version_id", "role").agg(F.countDistinct("subject_id").alias("n_subjects"))
    return members.join(F.broadcast(own.select("model_version_id", "status", "recipe")), "model_version_id").join(F.broadcast(verdict), "model_version_id").drop("model_version_id")  # one row each


REGISTERED_MEMBERS = f"WITH {_P} SELECT split AS role, count(*) AS n_subjects, 'active' AS status, 'baseline-logreg' AS recipe, 'ok' AS verdict FROM p WHERE split <> 'holdout' GROUP BY split"


def recorded_decisions(spark, sf_dir):
    """Decisions of a batch that was sent twice: what is recorded for each evaluation subject, and who was rejected (decide, P13, M10)."""
    t = _trained(spark, sf_dir)
    trail = t["trail"]
    p = trail.read("audit.predictions")
    tall = trail.read("audit.attributions").groupBy("prediction_id").agg(F.count("*").alias("n_attributions"), F.max("abs_rank").alias("last_rank"), F.sum("shap_value").alias("total"), F.first("base_value").alias("base"))
    sound = (F.abs(F.col("base") + F.col("total") - F.ln(F.col("score") / (1 - F.col("score")))) < 1e-6) & (F.when(F.col("score") >= F.col("threshold"), "approve").otherwise("deny") == F.col("decision"))
    made = p.join(tall, "prediction_id").groupBy("subject_id").agg(F.count("*").alias("n_decisions"), F.max("n_attributions").alias("n_attributions"), F.max("last_rank").cast("long").alias("last_rank"), F.bool_and(sound).alias("sound"))
    no = t["rejected"].select("subject_id", F.lit(0).cast("long").alias("n_decisions"), F.lit(0).cast("long").alias("n_attributions"), F.lit(0).cast("long").alias("last_rank"), (F.array_join("unknown_features", ",") == "shoe_size").alias("sound"))
    return made.union(no).withColumn("added_again", F.lit(t["again"]).cast("long"))


RECORDED_DECISIONS = f"""WITH {_P}, w AS (SELECT {_WIDTH} AS n)
SELECT subject_id, CASE sex WHEN 'Male' THEN 0 ELSE 1 END AS n_decisions, CASE sex WHEN 'Male' THEN 0 ELSE n END AS n_attributions, CASE sex WHEN 'Male' THEN 0 ELSE n END AS last_rank, true AS sound, 0 AS added_again FROM p, w WHERE split = 'eval'"""


def reproduced_model(spark, sf_dir):
    """The recorded model fitted again from its recorded version: artifact, data and all scores (M7)."""
    t = _trained(spark, sf_dir)
    n = t["trail"].materialize(t["first"]["eval_snapshot"]).count()
    return spark.createDataFrame([models.reproduce(t["trail"], t["model"], "e") | {"scores": n}], "digests_match boolean, data_matches boolean, scores_differing long, reproduced boolean, scores long")


REPRODUCED_MODEL = f"WITH {_P} SELECT true AS digests_match, true AS data_matches, 0 AS scores_differing, true AS reproduced, count(*) AS scores FROM p WHERE split = 'eval'"


def scored_by_models(spark, sf_dir):
    """Every applicant's score under all active models in one job equals the one-model score (M3)."""
    t = _trained(spark, sf_dir)
    rows = t["trail"].read(APPLICATIONS)
    many = models.scored_by_many(t["trail"], rows)
    one = models.scored(t["trail"], t["model"], rows).select("subject_id", F.col("score").alias("one"))
    return many.join(one, "subject_id").select("subject_id", (F.abs(F.col("score") - F.col("one")) < 1e-12).alias("equal"))


SCORED_BY_MODELS = f"WITH {_P} SELECT subject_id, true AS equal FROM p"


def captured_versions(spark, sf_dir):
    """The facts recorded of each captured version, found again by key."""
    trail, first = _captured(spark, sf_dir)
    found = None
    for name in ("train_snapshot", "eval_snapshot"):
        one = trail.find("audit.data_snapshots", "data_snapshot_uuid", first[name])
        found = one if found is None else found.union(one)
    return found.select("table_identifier", "split_filter", "status", "row_count", F.unix_timestamp("min_as_of_ts").alias("first"), F.unix_timestamp("max_as_of_ts").alias("last"))


CAPTURED_VERSIONS = f"""WITH {_P}, e AS (SELECT split, 1704067200 + (('0x' || substr(subject_id, 9, 4))::BIGINT % 730) * 86400 + ('0x' || substr(subject_id, 13, 4))::BIGINT % 86400 AS seen_at FROM p)
SELECT 'features.credit_applications' AS table_identifier, 'train' AS split_filter, 'live' AS status, count(*) AS row_count, min(seen_at) AS first, max(seen_at) AS last FROM e WHERE split = 'train'
UNION ALL SELECT 'features.eval_holdout', NULL, 'live', count(*), min(seen_at), max(seen_at) FROM e WHERE split = 'eval'"""


def _batches(spark, sf_dir) -> tuple[Trail, list[dict]]:
    """A trail whose applications came in three batches, by nation."""
    trail = Trail(spark, _root(spark))
    trail.bootstrap()
    # each batch parses its own lines: those of two nations are never equal, so occurrences are what they are among all
    return trail, [ingest(trail, applications.parse(_customer_lines(spark, sf_dir, f"c_nationkey % 3 = {k}"), "b")) for k in range(3)]


def as_of_rows(spark, sf_dir):
    """Rows by batch and split as they stood after each of three batches: by commit, and by the captured version."""
    trail, made = _batches(spark, sf_dir)
    out = None
    for k, b in enumerate(made):
        s = trail.find("audit.data_snapshots", "data_snapshot_uuid", b["train_snapshot"]).first()
        at = trail.as_of(APPLICATIONS, s.version).groupBy("split").agg(F.count("*").alias("n_rows"))
        same = trail.materialize(b["train_snapshot"], verify=True).groupBy("split").agg(F.count("*").alias("n_materialized"))
        one = at.join(same, "split", "left").withColumn("version", F.lit(k))
        out = one if out is None else out.union(one)
    return out


AS_OF_ROWS = f"""WITH {_P}, b AS (SELECT split, c_nationkey % 3 AS k FROM p JOIN customer ON c_custkey = fnlwgt)
SELECT split, count(*) AS n_rows, CASE split WHEN 'train' THEN count(*) END AS n_materialized, v::INT AS version FROM b JOIN range(0, 3) t(v) ON k <= v GROUP BY split, v"""


def new_subjects(spark, sf_dir):
    """Customers without an urgent pending order, as rows that aren't known yet."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), "c_name")
    known = _read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("subject_id"))
    return versions.new_rows(c, known, "subject_id")


NEW_SUBJECTS = "SELECT c_custkey AS subject_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"


def recorded_facts(spark, sf_dir):
    """A few facts from the driver, one for each nation, appended as records with absent keys as null (S3)."""
    trail = Trail(spark, _root(spark))
    trail.bootstrap()
    nations = _read(spark, sf_dir, "nation").collect()  # 25
    trail.records("audit.training_membership", [{"subject_id": r.n_name, "model_version_id": f"m{r.n_regionkey}", "role": "train"} for r in nations])
    return trail.read("audit.training_membership").select("subject_id", "model_version_id", "role", "row_digest")


RECORDED_FACTS = "SELECT n_name AS subject_id, 'm' || n_regionkey AS model_version_id, 'train' AS role, NULL AS row_digest FROM nation"


def model_quality(spark, sf_dir):
    """Accuracy, positive rate and exact AUC of a score on every labelled document, by language."""
    rows = _decided(spark, sf_dir).withColumn("score", F.col("n_chars") / 3000)
    rates = fit.hit_rates(rows, "score", "quality", ("lang",))
    return rates.join(fit.auc(rows, "score", "quality", ("lang",)), "lang").select("lang", *(F.round(c, 9).alias(c) for c in ("accuracy", "positive_rate", "auc")))


MODEL_QUALITY = """WITH r AS (SELECT lang, quality, n_chars >= 1500 AS p, rank() OVER w + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS mid FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY n_chars))
SELECT lang, round(avg(CAST(p = (quality = 1) AS INT)), 9) AS accuracy, round(avg(CAST(p AS INT)), 9) AS positive_rate, round((sum(quality * mid) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE) / nullif(sum(quality) * (count(*) - sum(quality)), 0), 9) AS auc FROM r GROUP BY 1"""


def config_digests(spark, sf_dir):
    """The configuration digest of a hyperparameter for each priority, seed by year (P20)."""
    o = _read(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("c"), F.year("o_orderdate").alias("seed")).distinct()
    rows = o.select("c", "seed", F.format_string('{"C":%d}', "c").alias("hyperparams_json"), F.lit("r").alias("recipe"))
    return rows.select("c", "seed", models.config_digests(F.col("hyperparams_json"), F.col("seed"), F.col("recipe")).alias("config_digest"))


CONFIG_DIGESTS = """SELECT DISTINCT o_orderpriority[1]::INT AS c, year(o_orderdate) AS seed, sha256('{"hyperparams":{"C":' || o_orderpriority[1] || '},"recipe":"r","seed":' || year(o_orderdate) || '}') AS config_digest FROM orders"""


def fitted_length(spark, sf_dir):
    """A fit of document quality on length alone, and the score of every labelled document (M2, M3)."""
    rows = _decided(spark, sf_dir).select(F.col("doc_id").cast("string").alias("subject_id"), "n_chars", F.col("quality").alias("label"))
    columns = fit.encoding(rows, ("n_chars",), ())
    w, _ = fit.fit(rows.withColumn("x", fit.encoded(columns)))
    return rows.withColumn("x", fit.encoded(columns)).select("subject_id", "label", F.round(fit.probability(fit.linear_score([float(w[1])], w[0])), 7).alias("score"))


def _newton_sql(by: str = "") -> str:
    """Newton's steps for an intercept and one penalised coefficient, from the two-by-two inverse; ``by``: for each value of a column."""
    k, join = (f"{by}, ", f"JOIN w{{i}} USING ({by})") if by else ("", ", w{i}")
    steps = [f"w0 AS (SELECT DISTINCT {k}0.0::DOUBLE AS a, 0.0::DOUBLE AS b{' FROM d' if by else ''})"]
    for i in range(12):
        steps.append(f"g{i} AS MATERIALIZED (SELECT {k}a, b, sum(q - y) AS ga, b + sum((q - y) * x) AS gb, sum(q * (1 - q)) AS haa, sum(q * (1 - q) * x) AS hab, 1 + sum(q * (1 - q) * x * x) AS hbb FROM (SELECT {k}x, y, a, b, 1 / (1 + exp(-(a + b * x))) AS q FROM d {join.format(i=i)}) GROUP BY {k}a, b)")
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT {k}a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{i})")
    return ",\n".join(steps)


FITTED_MODELS = f"""WITH r AS (SELECT doc_id, n_chars, quality AS y FROM documents JOIN labels USING (doc_id)), s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM r),
d AS MATERIALIZED (SELECT doc_id, y, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, (n_chars - m) / s AS x FROM r, s),
{_newton_sql("model")}
SELECT doc_id::VARCHAR AS subject_id, model, round(1 / (1 + exp(-(a + b * x))), 7) AS score FROM d JOIN w12 USING (model)"""

FITTED_LENGTH = f"""WITH r AS (SELECT doc_id, n_chars, quality AS y FROM documents JOIN labels USING (doc_id)), s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM r),
d AS MATERIALIZED (SELECT doc_id, y, (n_chars - m) / s AS x FROM r, s),
{_newton_sql()}
SELECT doc_id::VARCHAR AS subject_id, y AS label, round(1 / (1 + exp(-(a + b * x))), 7) AS score FROM d, w12"""


def evaluated_groups(spark, sf_dir):
    """Group metrics of the model, recorded once though evaluated twice, and the differences recorded for one cutoff."""
    t = _trained(spark, sf_dir)
    trail = t["trail"]
    for _ in range(2):
        models.evaluate(trail, t["model"], t["first"]["eval_snapshot"], "sex", min_group_n=1)
    groups = trail.read("audit.fairness_evaluations").where("sensitive_attribute = 'sex' AND group_value IS NOT NULL").groupBy("group_value", "metric_name").agg(F.count("*").alias("n_recorded"), F.max("n").alias("n"), F.max(F.when(F.col("metric_name") == "positive_label_rate", F.round("metric_value", 9))).alias("label_rate"))
    spread = models.recorded_differences(trail, "sex", min_group_n=1).groupBy("metric_name").agg(F.count("*").alias("n_recorded"))
    return groups.union(spread.select(F.lit("all"), "metric_name", "n_recorded", F.lit(None).cast("long"), F.lit(None).cast("double")))


EVALUATED_GROUPS = f"""WITH {_P}, g AS (SELECT sex, count(*) AS n, sum(label) AS y FROM p WHERE split = 'eval' GROUP BY 1)
SELECT sex AS group_value, m AS metric_name, 1 AS n_recorded, n, CASE m WHEN 'positive_label_rate' THEN round(y / n, 9) END AS label_rate FROM g, (VALUES ('selection_rate'), ('positive_label_rate'), ('true_positive_rate'), ('false_positive_rate'), ('accuracy')) t(m)
WHERE (m <> 'true_positive_rate' OR y > 0) AND (m <> 'false_positive_rate' OR y < n)
UNION ALL SELECT 'all', m, 1, NULL, NULL FROM (VALUES ('demographic_parity_difference', 0), ('equal_opportunity_difference', 1), ('false_positive_rate_difference', 2), ('equalized_odds_difference', 3), ('accuracy_difference', 0)) t(m, k)
WHERE CASE k WHEN 0 THEN (SELECT count(*) > 1 FROM g) WHEN 1 THEN (SELECT count(*) > 1 FROM g WHERE y > 0) WHEN 2 THEN (SELECT count(*) > 1 FROM g WHERE y < n) ELSE (SELECT count(*) > 1 FROM g WHERE y > 0) OR (SELECT count(*) > 1 FROM g WHERE y < n) END"""


def _erased(spark, sf_dir) -> tuple[Trail, DataFrame]:
    """A trail of two batches and two models that were compared, after the women of two nations are erased and their models retired."""
    trail = Trail(spark, _root(spark))
    trail.bootstrap()
    rows = applications.parse(_customer_lines(spark, sf_dir), "b")
    first = ingest(trail, rows.where("CAST(native_country AS INT) <> 5"))
    second = ingest(trail, rows)
    a, b = (models.train(trail, x["train_snapshot"], first["eval_snapshot"], env_digest="e") for x in (first, second))
    models.compare(trail, a, b, "sex", min_group_n=1, env_digest="e")
    gone = rows.where("sex = 'Female' AND native_country IN ('3', '7')").select("subject_id")
    erasure.erase(trail, gone, retire=True)
    return trail, gone


def erased_models(spark, sf_dir):
    """After two batches, two models, a comparison and an erasure: what became of models, versions, decompositions and the record."""
    trail, gone = _erased(spark, sf_dir)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    state = trail.current("audit.model_versions", "model_version_id")
    versions_now = trail.current("audit.data_snapshots", "data_snapshot_uuid")
    dec = trail.current("audit.fairness_decompositions", "decomposition_id")
    parts = [
        count(state.where("status = 'retired' AND retired_at IS NOT NULL"), "retired models"), count(state.where("status = 'active'"), "active models"), count(versions_now.where("status = 'tombstoned'"), "tombstoned versions"),
        count(dec.where("comparable"), "comparable decompositions"), count(dec.where("NOT comparable AND abs(model_effect) < 1e-9"), "kept decompositions"),
        count(trail.read("audit.training_membership").join(gone, "subject_id", "left_semi"), "kept memberships"), count(trail.read("audit.snapshot_tombstones").where("size(pinned_model_version_ids) > 0"), "tombstones of pinned versions"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


ERASED_MODELS = f"""WITH {_P}, g AS (SELECT p.*, c_nationkey AS k FROM p JOIN customer ON c_custkey = fnlwgt), x AS (SELECT * FROM g WHERE sex = 'Female' AND k IN (3, 7)),
e AS (SELECT count(*) FILTER (split = 'train') > 0 AS t, count(*) FILTER (split = 'eval') > 0 AS v, count(*) FILTER (split = 'train') AS nt, count(*) FILTER (split = 'eval') AS nv FROM x),
s AS (SELECT sex, count(*) AS n, sum(label) AS y FROM g WHERE split = 'eval' AND k <> 5 GROUP BY 1),
d AS (SELECT 2 * CAST(count(*) > 1 AS INT) + CAST(count(*) FILTER (y > 0) > 1 AS INT) + CAST(count(*) FILTER (y < n) > 1 AS INT) + CAST(count(*) FILTER (y > 0) > 1 OR count(*) FILTER (y < n) > 1 AS INT) AS n FROM s)
SELECT unnest(['retired models', 'active models', 'tombstoned versions', 'comparable decompositions', 'kept decompositions', 'kept memberships', 'tombstones of pinned versions']) AS what,
  unnest([CASE WHEN t OR v THEN 2 ELSE 0 END, CASE WHEN t OR v THEN 0 ELSE 2 END, 2 * t::INT + v::INT, CASE WHEN v THEN 0 ELSE d.n END, CASE WHEN v THEN d.n ELSE 0 END, 2 * nt + 2 * nv, 2 * t::INT + v::INT])::BIGINT AS n FROM e, d"""


def recovered_erasure(spark, sf_dir):
    """An erasure that broke off with its buckets staged but not swapped in, run again: every subject's request and what is left."""
    trail, _, rows = _ingested(spark, sf_dir)
    gone = rows.where("sex = 'Female' AND native_country IN ('3', '7')").select("subject_id")
    erasure.log_request(trail, gone)
    erasure.stage_removal(trail, APPLICATIONS, gone)  # and no further
    erasure.erase(trail, gone)
    done = trail.current("audit.erasure_requests", "request_id").groupBy("subject_id").agg(F.count("*").alias("requests"), F.max("status").alias("status"), F.max("live_rows_deleted").alias("live_rows_deleted"))
    left = trail.read(APPLICATIONS).agg(F.count("*").alias("rows_left"))
    refused = 0
    for s in trail.read("audit.snapshot_tombstones").select("data_snapshot_uuid").collect():  # two versions
        try:
            trail.materialize(s[0])
        except SnapshotTombstonedError:
            refused += 1
    return done.join(F.broadcast(left)).withColumn("refused_versions", F.lit(refused).cast("long"))  # one row


RECOVERED_ERASURE = f"""WITH {_P}, g AS (SELECT p.*, c_nationkey FROM p JOIN customer ON c_custkey = fnlwgt), x AS (SELECT * FROM g WHERE sex = 'Female' AND c_nationkey IN (3, 7))
SELECT subject_id, 1 AS requests, 'completed' AS status, CASE split WHEN 'eval' THEN 2 ELSE 1 END AS live_rows_deleted, (SELECT count(*) FROM p) - (SELECT count(*) FROM x) AS rows_left,
  (SELECT CAST(count(*) FILTER (split = 'train') > 0 AS BIGINT) + CAST(count(*) FILTER (split = 'eval') > 0 AS BIGINT) FROM x) AS refused_versions FROM x"""


def subject_reports(spark, sf_dir):
    """The nested report of every customer that has an order, flattened to text: models, decisions and live rows."""
    c = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("subject_id"))
    e = _read(spark, sf_dir, "events")
    membership = e.select(F.col("user_id").cast("string").alias("subject_id"), F.col("event_type").alias("model_version_id"), F.lit("train").alias("role")).distinct()
    known = e.select("event_type").distinct().where("event_type <> 'purchase'").select(F.col("event_type").alias("model_version_id"), F.when(F.col("event_type") == "view", "retired").otherwise("active").alias("status"), F.lit("v").alias("data_snapshot_uuid"), F.lit("w").alias("eval_snapshot_uuid"), F.lit("r").alias("recipe"), F.lit(None).cast("timestamp").alias("trained_at"))
    made = e.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("subject_id"), F.col("event_id").cast("string").alias("prediction_id"), F.col("ts").alias("prediction_ts"), F.lit("m").alias("model_version_id"), F.lit("deny").alias("decision"), F.col("value").alias("score"))
    live = contamination.live_rows({"orders": c})
    out = contamination.subject_reports(c, membership, known, spark.createDataFrame([("w",)], "data_snapshot_uuid string"), live, made, 3)
    text = lambda a: F.array_join(a, ",")
    return out.select(
        "subject_id", F.col("live_row_count"), F.element_at("live_rows", "orders").alias("orders"), F.col("contaminated_model_count").cast("long").alias("models"), text("serving_model_ids").alias("serving"), text("orphaned_model_ids").alias("orphaned"),
        "decision_count", text(F.transform("decisions", lambda d: d.prediction_id)).alias("first_decisions"), F.exists("contaminated", lambda x: x.reproducible).alias("any_reproducible"), "known",
    )


SUBJECT_REPORTS = """WITH s AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1),
m AS (SELECT user_id AS id, count(DISTINCT event_type) AS models, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type NOT IN ('purchase', 'view')), '') AS serving, coalesce(max(CASE event_type WHEN 'purchase' THEN 'purchase' END), '') AS orphaned FROM events GROUP BY 1),
d AS (SELECT user_id AS id, count(*) AS n, array_to_string(list(event_id::VARCHAR ORDER BY ts, event_id::VARCHAR)[1:3], ',') AS first FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT s.id::VARCHAR AS subject_id, s.n AS live_row_count, s.n AS orders, coalesce(models, 0) AS models, coalesce(serving, '') AS serving, coalesce(orphaned, '') AS orphaned, coalesce(d.n, 0) AS decision_count, coalesce(d.first, '') AS first_decisions, false AS any_reproducible, true AS known
FROM s LEFT JOIN m USING (id) LEFT JOIN d USING (id)"""


def pending_decisions(spark, sf_dir):
    """Decisions spooled in two files that share a third of them: how many wait before a drain and after it, and what came in."""
    root = _root(spark)
    trail = Trail(spark, root)
    trail.bootstrap()
    o = _read(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL").withColumn("day", F.date_trunc("month", "o_orderdate"))
    p = o.select(F.col("o_orderkey").cast("string").alias("prediction_id"), F.col("day").alias("prediction_ts"), F.lit("m").alias("model_version_id"), F.col("o_custkey").cast("string").alias("subject_id"), F.lit("{}").alias("input_json"), F.lit("d").alias("input_digest"), F.lit(0.5).alias("score"), F.lit(0.5).alias("threshold"), F.lit("approve").alias("decision"), F.lit("complete").alias("explainer_status"), F.lit(1.0).alias("latency_ms"), F.lit(1.0).alias("shap_ms"))
    a = p.select("prediction_id", "prediction_ts", "model_version_id", F.lit("f").alias("feature_name"), F.lit("v").alias("feature_value_str"), F.lit(0.1).alias("shap_value"), F.lit(-0.1).alias("base_value"), F.lit(1).alias("abs_rank"), F.lit("linear").alias("explainer_type"))
    lines = decisions.encoded_lines(p, a)
    key = F.get_json_object("value", "$.prediction.prediction_id").cast("long")
    lines.where(key % 3 < 2).write.text(f"{root}/spool/a", compression="gzip")
    lines.where(key % 3 > 0).write.text(f"{root}/spool/b", compression="gzip")
    spool = f"{root}/spool/*"
    before = decisions.pending(spark, trail, spool)
    decisions.drain(trail, spool, f"{root}/ck").awaitTermination()
    counts = [("pending before", before), ("pending after", decisions.pending(spark, trail, spool))]
    lines.where(key % 3 == 0).select(F.regexp_replace("value", '"prediction_id":"', '"prediction_id":"x').alias("value")).write.text(f"{root}/spool/c", compression="gzip")
    counts.append(("pending in new files", decisions.pending(spark, trail, spool, f"{root}/ck")))
    came = trail.read("audit.predictions").agg(F.countDistinct("prediction_id").alias("n")).select(F.lit("decisions").alias("what"), "n")
    every = trail.read("audit.predictions").agg(F.count("*").alias("n")).select(F.lit("prediction rows").alias("what"), "n")
    return spark.createDataFrame(counts, "what string, n long").union(came).union(every)


PENDING_DECISIONS = "SELECT unnest(['pending before', 'pending after', 'pending in new files', 'decisions', 'prediction rows']) AS what, unnest([count(*), 0, count(*) FILTER (o_orderkey % 3 = 0), count(*), count(*)]) AS n FROM orders WHERE o_orderdate IS NOT NULL"


def fitted_models(spark, sf_dir):
    """Fits of document quality on length for even and odd documents in one job, and every labelled document's score under its own (M2, M7)."""
    rows = _decided(spark, sf_dir).select(F.col("doc_id").cast("string").alias("subject_id"), "n_chars", F.col("quality").alias("label"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("model"))
    data = rows.withColumn("x", fit.encoded(fit.encoding(rows, ("n_chars",), ())))
    out = None
    for name, (w, _) in fit.fit_many(data, "model").items():
        one = data.where(F.col("model") == name).select("subject_id", "model", F.round(fit.probability(fit.linear_score([float(w[1])], w[0])), 7).alias("score"))
        out = one if out is None else out.union(one)
    return out


def blocked_scores(spark, sf_dir):
    """Every applicant's score under a model for each nation, as products of blocks of rows and models (M3)."""
    rows = applications.parse(_customer_lines(spark, sf_dir), "b")
    n = _read(spark, sf_dir, "nation").select(F.concat(F.lit("m"), "n_nationkey").alias("model_version_id"), F.col("n_nationkey").alias("n"))
    entry = lambda pos, source, category, c, centre=0.0, scale=1.0: F.struct(F.lit(pos).alias("pos"), F.lit(source).alias("source_feature"), F.lit(category).cast("string").alias("category"), c.cast("double").alias("coefficient"), F.lit(centre).alias("centre"), F.lit(scale).alias("scale"))
    k = F.col("n")
    made = [entry(-1, "intercept", None, (k % 7 - 3) / 8), entry(0, "fnlwgt", None, (k % 5 - 2) / 4, 1000.0, 2000.0), entry(1, "sex", "Male", (k % 3) / 2), entry(2, "sex", "Female", -(k % 3) / 4), entry(3, "workclass", "BUILDING", (k % 2) / 2), entry(4, "workclass", "__missing__", (k % 4) / 4), entry(5, "workclass", "unheard", k + 100)]
    coefficients = n.select("model_version_id", F.explode(F.array(*made)).alias("e")).select("model_version_id", "e.*")
    return models.blocked_scores(rows, coefficients, block_models=8, block_rows=2000).withColumn("score", F.round("score", 9))


BLOCKED_SCORES = f"""WITH {_P}, n AS (SELECT n_nationkey AS n FROM nation)
SELECT subject_id, 'm' || n AS model_version_id, round(1 / (1 + exp(-((n % 7 - 3) / 8.0 + (n % 5 - 2) / 4.0 * (fnlwgt - 1000) / 2000.0 + CASE sex WHEN 'Male' THEN (n % 3) / 2.0 ELSE -(n % 3) / 4.0 END + CASE WHEN workclass = 'BUILDING' THEN (n % 2) / 2.0 WHEN workclass IS NULL THEN (n % 4) / 4.0 ELSE 0 END)::DOUBLE)), 9) AS score FROM p, n"""


def model_curves(spark, sf_dir):
    """Rates of the trained model by sex and nation at 30 cutoffs agree with its rates cut at each alone (F1, A4)."""
    t = _trained(spark, sf_dir)
    trail, version, cuts = t["trail"], t["first"]["eval_snapshot"], [k / 31 for k in range(1, 31)]
    curves = models.evaluate_curves(trail, [t["model"]], version, ["sex", "native_country"], cuts)
    return curves.groupBy("sensitive_attribute", "group_value").agg(F.count("*").alias("cutoffs"), F.max("n").alias("n"), F.max("n_positive").alias("n_positive"), F.round(F.max("positive_label_rate"), 9).alias("label_rate"))


MODEL_CURVES = f"""WITH {_P}, e AS (SELECT p.*, c_nationkey::VARCHAR AS nation FROM p JOIN customer ON c_custkey = fnlwgt WHERE split = 'eval'), g AS (SELECT 'sex' AS a, sex AS v, label FROM e UNION ALL SELECT 'native_country', nation, label FROM e)
SELECT a AS sensitive_attribute, v AS group_value, 30 AS cutoffs, count(*) AS n, sum(label) AS n_positive, round(avg(label), 9) AS label_rate FROM g GROUP BY a, v"""


def background_sample(spark, sf_dir):
    """Twenty events of each type by a seeded hash, and the mean of their values, as a model's background."""
    e = _read(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    return fit.background(e, 20, ("event_type",), "event_id")


BACKGROUND_SAMPLE = "SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('background:' || event_id), event_id) <= 20"


def broken_erasure(spark, sf_dir):
    """What a reader sees of each split while customers of two nations are erased: rows staged, put in place, files removed."""
    trail, first, rows = _ingested(spark, sf_dir)
    gone = rows.where("native_country IN ('3', '7')").select("subject_id")
    out = []

    def seen(step: str) -> None:
        reader = Trail(spark, trail.root)
        stored = trail.raw(APPLICATIONS).groupBy("split").agg(F.count("*").alias("k")).collect()
        live = {r.split: r.k for r in reader.read(APPLICATIONS).groupBy("split").agg(F.count("*").alias("k")).collect()}
        out.extend((step, r.split, live.get(r.split, 0), r.k) for r in stored)

    seen("before")
    staged = erasure.stage_removal(trail, APPLICATIONS, gone)
    seen("staged")
    erasure.publish_removal(trail, APPLICATIONS, staged)
    later = trail.capture(APPLICATIONS, "train")
    whole = trail.materialize(later, verify=True).count()
    seen("in place")
    trail.vacuum(APPLICATIONS)
    seen("removed")
    out.append(("captured", "train", whole, trail.materialize(later, verify=True).count()))
    return spark.createDataFrame(out, "step string, split string, live long, stored long").withColumn("stored", F.when(F.col("step").isin("before", "removed", "captured"), F.col("stored")))


BROKEN_ERASURE = f"""WITH {_P}, g AS (SELECT split, c_nationkey IN (3, 7) AS gone FROM p JOIN customer ON c_custkey = fnlwgt), c AS (SELECT split, count(*) AS n, count(*) FILTER (NOT gone) AS k FROM g GROUP BY 1)
SELECT 'before' AS step, split, n AS live, n AS stored FROM c UNION ALL SELECT 'staged', split, n, NULL FROM c UNION ALL SELECT 'in place', split, k, NULL FROM c UNION ALL SELECT 'removed', split, k, k FROM c WHERE k > 0 UNION ALL SELECT 'captured', split, k, k FROM c WHERE split = 'train'"""

QUERIES = {
    "registered_members": REGISTERED_MEMBERS, "recorded_decisions": RECORDED_DECISIONS, "reproduced_model": REPRODUCED_MODEL, "scored_by_models": SCORED_BY_MODELS, "captured_versions": CAPTURED_VERSIONS, "as_of_rows": AS_OF_ROWS, "new_subjects": NEW_SUBJECTS,
    "recorded_facts": RECORDED_FACTS, "model_quality": MODEL_QUALITY, "config_digests": CONFIG_DIGESTS, "fitted_length": FITTED_LENGTH, "evaluated_groups": EVALUATED_GROUPS, "erased_models": ERASED_MODELS, "recovered_erasure": RECOVERED_ERASURE,
    "subject_reports": SUBJECT_REPORTS, "pending_decisions": PENDING_DECISIONS, "fitted_models": FITTED_MODELS, "blocked_scores": BLOCKED_SCORES, "model_curves": MODEL_CURVES, "background_sample": BACKGROUND_SAMPLE, "broken_erasure": BROKEN_ERASURE,
}
