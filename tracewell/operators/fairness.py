"""Group fairness: rates, differences, tall metric rows, four-corner decomposition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import identity
from tracewell.functions.scoring import binary, group_of

# Metric names, the smallest comparable group, the decomposition's name and tolerance.
GROUP_METRICS = ("selection_rate", "positive_label_rate", "true_positive_rate", "false_positive_rate", "accuracy")
DIFFERENCES = {
    "demographic_parity_difference": "selection_rate",
    "equal_opportunity_difference": "true_positive_rate",
    "false_positive_rate_difference": "false_positive_rate",
    "accuracy_difference": "accuracy",
}
MIN_GROUP_N, METHOD, CLOSURE = 30, "shapley-2factor", 1e-12


def group_rates(rows: DataFrame, label: str, predicted: str, group: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key and group: n, n_positive and the five rates; a rate without a denominator is null, never 0.

    One aggregation with partial sums, whatever the number of models, attributes and thresholds in ``keys``.
    """
    y, p = binary(F.col(label), label), binary(F.col(predicted), predicted)
    rows = rows.select(*keys, group_of(group).alias("group_value"), y.alias("y"), p.alias("p"))
    sums = rows.groupBy(*keys, "group_value").agg(
        F.count("*").alias("n"), F.sum("y").alias("n_positive"), F.sum("p").alias("selected"), F.sum(F.col("y") * F.col("p")).alias("tp"), F.sum((F.col("y") == F.col("p")).cast("int")).alias("right")
    )
    return _rates_of(sums, keys)


def _rates_of(sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The five rates of counts n, n_positive, selected, tp and right."""
    rate = lambda a, b: F.try_divide(a, b).cast("double")
    return sums.select(
        *keys, "group_value", "n", "n_positive", rate(F.col("selected"), F.col("n")).alias("selection_rate"), rate(F.col("n_positive"), F.col("n")).alias("positive_label_rate"),
        rate(F.col("tp"), F.col("n_positive")).alias("true_positive_rate"), rate(F.col("selected") - F.col("tp"), F.col("n") - F.col("n_positive")).alias("false_positive_rate"), rate(F.col("right"), F.col("n")).alias("accuracy"),
    )


def rate_curves(rows: DataFrame, label: str, score: str, group: Column, cutoffs: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """``group_rates`` of scores cut at each of ``cutoffs``, with the cutoff as a column.

    Rows are counted once, by the highest cutoff that their score reaches; sums of these counts from above give the rates
    at every cutoff. One shuffle of at most groups times cutoffs counts, however many cutoffs there are. A null score
    reaches none.
    """
    cuts = sorted(set(map(float, cutoffs)))
    reached = F.coalesce(reduce(lambda a, b: a + b, [(F.col(score) >= c).cast("int") for c in cuts]), F.lit(0))
    counted = rows.select(*keys, group_of(group).alias("group_value"), binary(F.col(label), label).alias("y"), reached.alias("bin"))
    counted = counted.groupBy(*keys, "group_value", "bin").agg(F.count("*").alias("c"), F.sum("y").alias("cy"))
    held = counted.groupBy(*keys, "group_value").agg(F.sum("c").alias("n"), F.sum("cy").alias("n_positive"), F.collect_list(F.struct("bin", "c", "cy")).alias("bins"))  # at most a bin a cutoff
    at = held.select(*keys, "group_value", "n", "n_positive", "bins", F.posexplode(F.array(*map(F.lit, cuts))).alias("k", "cutoff"))
    above = lambda f: F.aggregate("bins", F.lit(0).cast("long"), lambda s, x: s + F.when(x.bin > F.col("k"), x[f]).otherwise(0))
    sums = at.select(*keys, "cutoff", "group_value", "n", "n_positive", above("c").alias("selected"), above("cy").alias("tp"))
    sums = sums.withColumn("right", F.col("n") - F.col("n_positive") - F.col("selected") + 2 * F.col("tp"))
    return _rates_of(sums, (*keys, "cutoff"))


def differences(rates: DataFrame, keys: tuple[str, ...] = (), min_group_n: int = MIN_GROUP_N) -> DataFrame:
    """Per key: largest less smallest rate over groups of at least ``min_group_n``, null below two such rates; eligible_n."""
    spread = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c))
    big = rates.where(F.col("n") >= min_group_n)
    out = big.groupBy(*keys).agg(F.sum("n").alias("eligible_n"), *(spread(c).alias(name) for name, c in DIFFERENCES.items()))
    return out.withColumn("equalized_odds_difference", F.greatest("equal_opportunity_difference", "false_positive_rate_difference"))


def metric_rows(rates: DataFrame, keys: tuple[str, ...] = (), min_group_n: int = MIN_GROUP_N) -> DataFrame:
    """Tall rows (keys, group_value, metric_name, metric_value, n, min_group_n) of all defined rates and differences."""
    groups = rates.unpivot([*keys, "group_value", "n"], list(GROUP_METRICS), "metric_name", "metric_value").withColumn("min_group_n", F.lit(None).cast("int"))
    across = differences(rates, keys, min_group_n)
    names = [*DIFFERENCES, "equalized_odds_difference"]
    spreads = across.unpivot([*keys, "eligible_n"], names, "metric_name", "metric_value").withColumnRenamed("eligible_n", "n").withColumn("group_value", F.lit(None).cast("string")).withColumn("min_group_n", F.lit(min_group_n))
    return groups.unionByName(spreads).where("metric_value IS NOT NULL").select(*keys, "group_value", "metric_name", "metric_value", "n", "min_group_n")


def evaluation_ids(rows: DataFrame, threshold_text: Column) -> DataFrame:
    """``rows`` with the identity of everything that decides their value; the cutoff counts only where it matters."""
    key = identity.joined_key(F.col("model_version_id"), F.col("eval_snapshot_uuid"), F.col("sensitive_attribute"), threshold_text, F.col("metric_name"), F.col("group_value"), F.col("min_group_n").cast("string"))
    return rows.withColumn("evaluation_id", identity.uuid5(identity.EVALUATION_NAMESPACE, key))


def conflicts(new: DataFrame, recorded: DataFrame) -> DataFrame:
    """Evaluations recorded before with another value."""
    old = recorded.select("evaluation_id", F.col("metric_value").alias("recorded_value"))
    return new.select("evaluation_id", "metric_value").join(old, "evaluation_id").where("metric_value <> recorded_value")


def fresh(new: DataFrame, recorded: DataFrame, key: str = "evaluation_id") -> DataFrame:
    return new.join(recorded.select(key), key, "left_anti")


def decompose(corners: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key and metric the change from A to B, halved symmetrically into a model and a data effect.

    ``corners``: keys, metric_name, metric_value and role: a (old model, old data), a_prime (old model, new data),
    b (new model, new data), b_prime (new model, old data). A metric that a corner lacks is skipped; effects that don't
    add up to the total fail the job.
    """
    wide = corners.groupBy(*keys, "metric_name").pivot("role", ["a", "a_prime", "b", "b_prime"]).agg(F.first("metric_value"))
    wide = wide.where("a IS NOT NULL AND a_prime IS NOT NULL AND b IS NOT NULL AND b_prime IS NOT NULL")
    out = wide.select(
        *keys, "metric_name", (F.col("b") - F.col("a")).alias("total_delta"), (0.5 * ((F.col("b_prime") - F.col("a")) + (F.col("b") - F.col("a_prime")))).alias("model_effect"),
        (0.5 * ((F.col("a_prime") - F.col("a")) + (F.col("b") - F.col("b_prime")))).alias("data_effect"),
    )
    gap = F.abs(F.col("total_delta") - F.col("model_effect") - F.col("data_effect"))
    total = F.when(gap <= CLOSURE, F.col("total_delta")).otherwise(F.raise_error(F.lit("decomposition doesn't close")))
    return out.withColumn("total_delta", total)


def blame(decompositions: DataFrame) -> DataFrame:
    """Whether a difference grew, and which effect is larger (ties: the model; no effect: neither)."""
    m, d = F.abs("model_effect"), F.abs("data_effect")
    cause = F.when((m == 0) & (d == 0), "neither").when(m >= d, "model").otherwise("data")
    return decompositions.withColumn("regressed", F.col("total_delta") > 0).withColumn("attributed_to", cause)


def refusals(pairs: DataFrame, models: DataFrame, known_recipes: list[str]) -> DataFrame:
    """``pairs`` (baseline, candidate, eval_choice) with why they can't be compared, null where they can."""
    side = lambda p: models.select(*(F.col(c).alias(f"{p}_{c}") for c in ("model_version_id", "eval_snapshot_uuid", "recipe")))
    both = pairs.join(side("old"), F.col("baseline") == F.col("old_model_version_id"), "left").join(side("new"), F.col("candidate") == F.col("new_model_version_id"), "left")
    reason = (
        F.when(F.col("baseline") == F.col("candidate"), "same version")
        .when(F.col("old_model_version_id").isNull() | F.col("new_model_version_id").isNull(), "missing model")
        .when((F.col("old_eval_snapshot_uuid") != F.col("new_eval_snapshot_uuid")) & F.col("eval_choice").isNull(), "different eval versions")
        .when(~F.col("old_recipe").isin(known_recipes) | ~F.col("new_recipe").isin(known_recipes), "unknown recipe")
    )
    return both.select("baseline", "candidate", "eval_choice", reason.alias("refusal"))


def reusable(wanted: DataFrame, models: DataFrame) -> DataFrame:
    """``wanted`` (want_id, config_digest, data_snapshot_uuid, eval_snapshot_uuid) with the earliest matching model."""
    keys = ["config_digest", "data_snapshot_uuid", "eval_snapshot_uuid"]
    found = models.where("status <> 'tombstoned'").groupBy(*keys).agg(F.min(F.struct("trained_at", "model_version_id")).alias("first"))
    return wanted.join(found, keys, "left").select("want_id", F.col("first.model_version_id").alias("model_version_id"))
