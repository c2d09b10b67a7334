"""Train, register, load checked, reproduce, evaluate and compare models of the trail."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import identity, scoring
from tracewell.operators import explain, fairness, fit
from tracewell.operators.versions import Trail, TrailError
from tracewell.schemas import CATEGORICAL, NUMERIC
from tracewell.streaming import decisions

# Fixed value: the name of the one training recipe.
RECIPE = "baseline-logreg"
RECIPES = {RECIPE: fit.fit}


class ProvenanceIntegrityError(TrailError):
    """An artifact whose digest isn't the recorded one, or a half of the pair that is missing."""


class EnvironmentDriftError(TrailError):
    """A reproduction asked for in another environment."""


def config_digest(hyperparams: dict, seed: int, recipe: str = RECIPE) -> str:
    import hashlib

    return hashlib.sha256(json.dumps({"hyperparams": hyperparams, "seed": seed, "recipe": recipe}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def config_digests(hyperparams_json: Column, seed: Column, recipe: Column) -> Column:
    """``config_digest`` of recorded rows, from their canonical text."""
    return identity.sha256(F.concat(F.lit('{"hyperparams":'), hyperparams_json, F.lit(',"recipe":"'), recipe, F.lit('","seed":'), seed.cast("string"), F.lit("}")))


def _fitted(rows: DataFrame, hyperparams: dict, recipe: str) -> tuple[list[dict], object, DataFrame]:
    if recipe not in RECIPES:
        raise TrailError(f"no recipe {recipe}")
    columns = fit.encoding(rows)
    data = rows.withColumn("x", fit.encoded(columns))
    w, _ = RECIPES[recipe](data, c=float(hyperparams.get("C", fit.C)))
    return columns, w, data


def _means(data: DataFrame, columns: list[dict]) -> list[float]:
    """Exact-order means of encoded columns: numbers are centred at 0, categories are counts over rows.

    Each column is counted from its own source, so a row costs as much as it has columns, not that many arrays.
    """
    sums = [F.sum(F.round(x * 1e9).cast("decimal(38,0)")) if c["category"] is None else F.sum(x.cast("long")) for c, x in zip(columns, map(fit.encoded_one, columns), strict=True)]
    got = data.agg(F.count("*").alias("n"), *(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    billionths = [int(got[f"s{i}"]) * (1 if c["category"] is None else 10**9) for i, c in enumerate(columns)]
    return [float(b) / 1e9 / got.n for b in billionths]


def train(trail: Trail, data_uuid: str, eval_uuid: str, hyperparams: dict | None = None, seed: int = 0, env_digest: str = "", code_git_sha: str = "", status: str = "active", recipe: str = RECIPE) -> str:
    """Fits, and registers: the artifact first, membership next, the model row last, so a torn run leaves no claim."""
    hyperparams = hyperparams or {"C": fit.C}
    rows, held = trail.materialize(data_uuid), trail.materialize(eval_uuid)
    columns, w, data = _fitted(rows, hyperparams, recipe)
    model = str(uuid.uuid4())
    coefficients = fit.coefficient_rows(trail.spark, model, columns, w, _means(data, columns))
    digest = fit.artifact_digests(coefficients).first().artifact_digest
    metrics = {}
    for name, part in (("train", rows), ("eval", held)):
        scored = part.withColumn("x", fit.encoded(columns)).select(fit.probability(fit.linear_score(list(map(float, w[1:])), w[0])).alias("score"), "label").persist()
        try:
            metrics[f"{name}_auc"] = fit.auc(scored, "score", "label").first().auc
            metrics |= {f"{name}_{k}": v for k, v in fit.hit_rates(scored, "score", "label").first().asDict().items()}
        finally:
            scored.unpersist()
    trail.append("audit.model_coefficients", coefficients)
    member = lambda part, role: part.select(F.lit(model).alias("model_version_id"), "subject_id", F.lit(role).alias("role"), F.col("source_row_digest").alias("row_digest"))
    trail.append("audit.training_membership", member(rows, "train").union(member(held, "eval")))
    row = trail.spark.range(1).select(F.current_timestamp().alias("trained_at"), *(F.lit(v).alias(k) for k, v in {
        "model_version_id": model, "registered_name": "credit", "data_snapshot_uuid": data_uuid, "eval_snapshot_uuid": eval_uuid, "estimator_class": "tracewell.linear.Logistic", "hyperparams_json": json.dumps(hyperparams, sort_keys=True, separators=(",", ":")),
        "config_digest": config_digest(hyperparams, seed, recipe), "seed": seed, "artifact_digest": digest, "env_digest": env_digest, "code_git_sha": code_git_sha, "metrics_json": json.dumps(metrics, sort_keys=True), "status": status, "recipe": recipe,
    }.items()))
    trail.append("audit.model_versions", row)
    return model


def load_checked(trail: Trail, model: str) -> tuple[object, DataFrame]:
    """(model row, coefficients) of a model whose artifact has the recorded digest; anything else is refused."""
    own = trail.current("audit.model_versions", "model_version_id").where(F.col("model_version_id") == model)
    coefficients = trail.read("audit.model_coefficients").where(F.col("model_version_id") == model)
    verdict = fit.model_verdicts(own, coefficients).first()
    if verdict is None or verdict.verdict != "ok":
        raise ProvenanceIntegrityError(f"model {model}: {verdict.verdict if verdict else 'row missing'}")
    return own.first(), coefficients


def _weights(coefficients: DataFrame) -> tuple[list[dict], list[float], float, list[float]]:
    rows = coefficients.orderBy("pos").collect()  # as many as the model has columns
    columns = [{"name": r.feature_name, "source": r.source_feature, "category": r.category, "mean": r.centre, "scale": r.scale} for r in rows[1:]]
    return columns, [r.coefficient for r in rows[1:]], rows[0].coefficient, [r["mean"] for r in rows[1:]]


def scored(trail: Trail, model: str, rows: DataFrame) -> DataFrame:
    """``rows`` with x and score under a checked model: its artifact is all that is read, so a lost training version doesn't matter."""
    columns, weights, intercept, _ = _weights(load_checked(trail, model)[1])
    return rows.withColumn("x", fit.encoded(columns)).withColumn("score", fit.probability(fit.linear_score(weights, intercept)))


def reproduce(trail: Trail, model: str, env_digest: str = "") -> dict:
    """Fits the recorded version again and compares artifact, data and every score of the evaluation version."""
    own, coefficients = load_checked(trail, model)
    if own.env_digest != env_digest:
        raise EnvironmentDriftError(f"model {model} was fitted in environment {own.env_digest!r}")
    rows = trail.materialize(own.data_snapshot_uuid, verify=True)
    columns, w, data = _fitted(rows, json.loads(own.hyperparams_json), own.recipe)
    again = fit.artifact_digests(fit.coefficient_rows(trail.spark, model, columns, w, _means(data, columns))).first().artifact_digest
    held = trail.materialize(own.eval_snapshot_uuid)
    new = held.withColumn("x", fit.encoded(columns)).select("subject_id", fit.probability(fit.linear_score(list(map(float, w[1:])), w[0])).alias("again"))
    differing = scored(trail, model, held).select("subject_id", "score").join(new, "subject_id").where("score <> again").count()
    return {"digests_match": again == own.artifact_digest, "data_matches": True, "scores_differing": differing, "reproduced": again == own.artifact_digest and not differing}


def decide(trail: Trail, model: str, requests: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, attributions, rejected) of a batch of requests (request_key, subject_id and the model's inputs).

    A request names its inputs by columns. One that gives a value for a column the model doesn't know is rejected, with
    those names in unknown_features; the others are decided. Identities follow from model, input and key, so a retried
    batch adds nothing.
    """
    own, coefficients = load_checked(trail, model)
    columns, weights, intercept, means = _weights(coefficients)
    inputs = sorted({c["source"] for c in columns})
    bad = [c for c in requests.columns if c not in {*inputs, "request_key", "subject_id"}]
    named = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in bad))) if bad else F.array().cast("array<string>")
    known = requests.withColumn("unknown_features", named)
    rejected = known.where(F.size("unknown_features") > 0)
    rows = known.where(F.size("unknown_features") == 0).drop("unknown_features", *bad)
    rows = rows.withColumn("input_json", identity.canonical_json(rows, *inputs))
    rows = rows.withColumn("prediction_id", identity.uuid5(identity.PREDICTION_NAMESPACE, identity.joined_key(model, identity.sha256(F.col("input_json")), F.col("request_key").cast("string"))))
    rows = scored(trail, model, rows).withColumns({"prediction_ts": F.current_timestamp(), "model_version_id": F.lit(model), "input_digest": identity.sha256(F.col("input_json")), "threshold": F.lit(threshold), "explainer_status": F.lit("complete"), "latency_ms": F.lit(None).cast("double"), "shap_ms": F.lit(None).cast("double")})
    rows = rows.withColumn("decision", scoring.decision(F.col("score"), threshold))
    base = intercept + sum(w * m for w, m in zip(weights, means, strict=True))
    positions = coefficients.where("pos >= 0").select("pos", "coefficient", "mean")
    values = F.create_map(*(x for c in inputs for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit(scoring.MISSING)))))
    # a prediction's own columns go along with its parts, so that these meet them without a shuffle
    tall = explain.attribute(rows.withColumn("v", values), positions, keep=("prediction_ts", "model_version_id", "v")).join(F.broadcast(coefficients.select("pos", "feature_name", "source_feature")), "pos")
    attributions = tall.select(
        "prediction_id", "prediction_ts", "model_version_id", "feature_name", F.element_at("v", F.col("source_feature")).alias("feature_value_str"), "shap_value", F.lit(base).alias("base_value"), "abs_rank", F.lit("linear").alias("explainer_type")
    )
    return rows, attributions, rejected


def record_decisions(trail: Trail, predictions: DataFrame, attributions: DataFrame) -> int:
    """Records what isn't there yet, attributions first: a prediction row is the sign that its explanation is complete.

    An identity is recorded once, though a retry stamps another time; the index of identities is asked, not the history.
    """
    checks = explain.reconcile(attributions, predictions.select("prediction_id", "score", F.lit("logit").alias("link")))
    if checks.where("verdict <> 'ok'").take(1):
        raise ProvenanceIntegrityError("attributions don't add up to their scores")
    return decisions.record(trail, predictions.dropDuplicates(["prediction_id"]), attributions)


def record_refusals(trail: Trail, rejected: DataFrame) -> int:
    """Puts the requests that ``decide`` rejected into audit.rejects, each once; returns how many are new."""
    line = F.to_json(F.struct(*(c for c in rejected.columns if c != "unknown_features")))
    return decisions.refuse(trail, rejected, F.concat(F.lit("unknown features: "), F.array_join(F.array_sort("unknown_features"), ",")), line)


def evaluate(trail: Trail, model: str, eval_uuid: str, attribute: str, threshold: float = 0.5, min_group_n: int = fairness.MIN_GROUP_N) -> DataFrame:
    """Metric rows of a checked model on a frozen version, recorded once; another value for one identity is an error."""
    rows = trail.materialize(eval_uuid)
    _comparable(rows, attribute)
    decided = scored(trail, model, rows).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    tall = fairness.metric_rows(fairness.group_rates(decided, "label", "predicted", F.col(attribute)), (), min_group_n)
    tall = tall.withColumns({"model_version_id": F.lit(model), "eval_snapshot_uuid": F.lit(eval_uuid), "sensitive_attribute": F.lit(attribute), "decision_threshold": F.lit(threshold), "evaluated_at": F.current_timestamp()})
    tall = fairness.evaluation_ids(tall, F.lit(repr(float(threshold)))).persist()
    recorded = trail.read("audit.fairness_evaluations")
    if fairness.conflicts(tall, recorded).take(1):
        raise TrailError("an evaluation is recorded with another value")
    trail.append("audit.fairness_evaluations", fairness.fresh(tall, recorded))
    return tall


def recorded_differences(trail: Trail, attribute: str, threshold: float = 0.5, min_group_n: int = fairness.MIN_GROUP_N) -> DataFrame:
    """(model_version_id, eval_snapshot_uuid, metric_name, metric_value) of the differences recorded for one cutoff, for all models.

    The smallest comparable group is part of what a difference means, so it is asked for and never mixed.
    """
    rows = trail.read("audit.fairness_evaluations").where((F.col("sensitive_attribute") == attribute) & (F.col("decision_threshold") == threshold) & F.col("group_value").isNull() & (F.col("min_group_n") == min_group_n))
    return rows.select("model_version_id", "eval_snapshot_uuid", "metric_name", "metric_value")


#: Models of a block of coefficients, and rows of a block that meets it.
BLOCK_MODELS, BLOCK_ROWS = 256, 20_000


def evaluate_curves(trail: Trail, models: list[str], eval_uuid: str, attributes: list[str], cutoffs: list[float]) -> DataFrame:
    """(model_version_id, sensitive_attribute, cutoff, group_value, n, n_positive, rates) of models, attributes and cutoffs in one job."""
    rows = trail.materialize(eval_uuid)
    for a in attributes:
        _comparable(rows, a)
    scores = scored_by_many(trail, rows, models).join(rows.select("subject_id", "label", *attributes), "subject_id")
    tall = scores.unpivot(["model_version_id", "label", "score"], attributes, "sensitive_attribute", "value")
    return fairness.rate_curves(tall, "label", "score", F.col("value"), cutoffs, ("model_version_id", "sensitive_attribute"))


def train_many(trail: Trail, data_uuid: str, hyperparams: list[dict], recipe: str = RECIPE) -> dict[str, object]:
    """{canonical hyperparameters: weights} of refits of one version under many settings: one encoding, one shuffle, shared passes."""
    if recipe not in RECIPES:
        raise TrailError(f"no recipe {recipe}")
    rows = trail.materialize(data_uuid)
    columns = fit.encoding(rows)
    texts = {json.dumps(h, sort_keys=True, separators=(",", ":")): float(h.get("C", fit.C)) for h in hyperparams}
    every = rows.withColumn("x", fit.encoded(columns)).withColumn("__setting", F.explode(F.array(*map(F.lit, texts))))
    return {t: w for t, (w, _) in fit.fit_many(every, "__setting", c=texts).items()}


def _comparable(rows: DataFrame, attribute: str) -> None:
    if attribute not in rows.columns or attribute in ("subject_id", "as_of_ts", "ingest_batch_id", "source_row_digest", "split", "label", "commit_seq", "subject_bucket"):
        raise TrailError(f"{attribute} is no attribute to compare groups by")


def scored_by_many(trail: Trail, rows: DataFrame, models: list[str] | None = None) -> DataFrame:
    """(subject_id, model_version_id, score) of ``rows`` under the checked active (or the named) models, in one job.

    A model whose artifact isn't the recorded one is left out.
    """
    own = trail.current("audit.model_versions", "model_version_id")
    own = own.where("status = 'active'") if models is None else own.where(F.col("model_version_id").isin(models))
    coefficients = trail.read("audit.model_coefficients").join(own.select("model_version_id"), "model_version_id", "left_semi")
    good = fit.model_verdicts(own, coefficients).where("verdict = 'ok'").select("model_version_id")
    return blocked_scores(rows, coefficients.join(good, "model_version_id", "left_semi"))


def blocked_scores(rows: DataFrame, coefficients: DataFrame, key: str = "subject_id", block_models: int = BLOCK_MODELS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, model_version_id, score) of rows under the models that ``coefficients`` gives, any number of both.

    Models are dealt into blocks, and so are rows; each pair of a block of rows and one of models meets in one task, which
    multiplies two matrices: the rows' numbers and categories, and the models' coefficients for these. Nothing is broadcast
    or held whole. A category that a model doesn't know, or a row doesn't have, adds nothing; a missing number is 0.
    """
    import numpy as np
    import pandas as pd

    numeric, words = ([c for c in group if c in rows.columns] for group in (NUMERIC, CATEGORICAL))
    n_models, n_rows = coefficients.select("model_version_id").distinct().count(), rows.count()
    m_blocks, r_blocks = max(1, -(-n_models // block_models)), max(1, -(-n_rows // block_rows))
    of_models = F.pmod(F.xxhash64("model_version_id"), F.lit(m_blocks))
    left = rows.select(F.col(key).alias("__key"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric), *(F.coalesce(F.col(c), F.lit(scoring.MISSING)).alias(c) for c in words))
    left = left.withColumn("__r", F.pmod(F.xxhash64("__key"), F.lit(r_blocks))).withColumn("__m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m_blocks - 1).cast("long"))))
    right = coefficients.select("model_version_id", "pos", "source_feature", "category", "coefficient", "centre", "scale").withColumn("__m", of_models).withColumn("__r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r_blocks - 1).cast("long"))))

    def scores(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["__key", "model_version_id", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        model, ids = pd.factorize(b["model_version_id"])
        margin = np.zeros((len(a), len(ids)))
        flat = (b["pos"] < 0).to_numpy()
        np.add.at(margin, (slice(None), model[flat]), b["coefficient"].to_numpy()[flat])
        for c in numeric:
            own = ((b["source_feature"] == c) & b["category"].isna() & (b["pos"] >= 0)).to_numpy()
            w = np.zeros(len(ids))
            slope = b["coefficient"].to_numpy()[own] / b["scale"].to_numpy()[own]
            np.add.at(w, model[own], slope)
            np.add.at(margin, (slice(None), model[own]), -slope * b["centre"].to_numpy()[own])
            margin += np.outer(a[c].to_numpy(), w)
        for c in words:
            own = ((b["source_feature"] == c) & b["category"].notna()).to_numpy()
            value, known = pd.factorize(b["category"][own])
            w = np.zeros((len(known) + 1, len(ids)))
            np.add.at(w, (value, model[own]), b["coefficient"].to_numpy()[own])
            margin += w[pd.Index(known).get_indexer(a[c])]  # -1, for an unknown one, is the row of zeros
        with np.errstate(over="ignore"):
            score = 1 / (1 + np.exp(-margin))
        return pd.DataFrame({"__key": np.repeat(a["__key"].to_numpy(), len(ids)), "model_version_id": np.tile(np.asarray(ids), len(a)), "score": score.ravel()})

    kind = rows.schema[key].dataType.simpleString()
    out = left.groupBy("__r", "__m").cogroup(right.groupBy("__r", "__m")).applyInPandas(scores, f"__key {kind}, model_version_id string, score double")
    return out.withColumnRenamed("__key", key)


def compare(trail: Trail, baseline: str, candidate: str, attribute: str, eval_uuid: str | None = None, threshold: float = 0.5, min_group_n: int = fairness.MIN_GROUP_N, env_digest: str = "") -> DataFrame:
    """The change in group differences from one model to another, split into the model's and the data's part.

    The two counterfactual corners (each model's configuration on the other's data) are reused if a matching model is
    there, else trained.
    """
    models = trail.current("audit.model_versions", "model_version_id")
    pair = trail.spark.createDataFrame([(baseline, candidate, eval_uuid)], "baseline string, candidate string, eval_choice string")
    why = fairness.refusals(pair, models, list(RECIPES)).first().refusal
    if why:
        raise TrailError(f"can't compare: {why}")
    old, new = (models.where(F.col("model_version_id") == m).first() for m in (baseline, candidate))
    at = eval_uuid or old.eval_snapshot_uuid
    corners = {"a": baseline, "b": candidate}
    for role, config, data in (("a_prime", old, new), ("b_prime", new, old)):
        wanted = trail.spark.createDataFrame([(role, config.config_digest, data.data_snapshot_uuid, at)], "want_id string, config_digest string, data_snapshot_uuid string, eval_snapshot_uuid string")
        found = fairness.reusable(wanted, models).first().model_version_id
        corners[role] = found or train(trail, data.data_snapshot_uuid, at, json.loads(config.hyperparams_json), config.seed, env_digest, config.code_git_sha, "counterfactual", config.recipe)
    rows = None
    for role, model in corners.items():
        one = evaluate(trail, model, at, attribute, threshold, min_group_n).where("group_value IS NULL").select("metric_name", "metric_value", F.lit(role).alias("role"))
        rows = one if rows is None else rows.union(one)
    key = identity.joined_key(baseline, candidate, at, attribute, F.col("metric_name"), repr(float(threshold)), str(min_group_n), fairness.METHOD)
    out = fairness.blame(fairness.decompose(rows)).withColumns({
        "decomposition_id": identity.uuid5(identity.DECOMPOSITION_NAMESPACE, key), "baseline_model_id": F.lit(baseline), "candidate_model_id": F.lit(candidate), "counterfactual_a_prime_id": F.lit(corners["a_prime"]), "counterfactual_b_prime_id": F.lit(corners["b_prime"]),
        "eval_snapshot_uuid": F.lit(at), "sensitive_attribute": F.lit(attribute), "method": F.lit(fairness.METHOD), "comparable": F.lit(True), "computed_at": F.current_timestamp(), "decision_threshold": F.lit(threshold), "min_group_n": F.lit(min_group_n),
    }).persist()
    trail.append("audit.fairness_decompositions", fairness.fresh(out, trail.read("audit.fairness_decompositions"), "decomposition_id"))
    return out
