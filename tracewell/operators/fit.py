"""Encoding, a bit-exact logistic fit, scoring of populations, exact AUC, digests of coefficients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tracewell.functions import identity
from tracewell.functions.scoring import MISSING
from tracewell.schemas import CATEGORICAL, NUMERIC

#: Rows are dealt by model and subject into buckets of BUCKET_ROWS or so, as many as the rows ask for; sums run within a bucket in
#: order, then over FAN_IN buckets at a time in order, so the bits of a fit don't depend on how Spark partitions the rows.
BUCKET_ROWS, FAN_IN, C, TOLERANCE, MOST_STEPS = 20_000, 64, 1.0, 1e-6, 100


MOST_CATEGORIES = 10_000


class FitError(ValueError):
    """Rows that no fit can be made of."""


def encoding(rows: DataFrame, numeric: tuple[str, ...] = NUMERIC, categorical: tuple[str, ...] = CATEGORICAL) -> list[dict]:
    """The encoded columns: numbers with exact mean and population deviation, then a column for each category, sorted.

    Sums of whole numbers are exact decimals, so they don't depend on the order of rows; a number with a fraction is
    refused (scale it first, to cents say). Categories are what the columns hold, a schema's worth (MOST_CATEGORIES at
    most, counted first), and are collected as such.
    """
    if categorical:
        counted = rows.agg(*(F.approx_count_distinct(c).alias(c) for c in categorical)).first()
        if wide := [c for c in categorical if counted[c] > MOST_CATEGORIES]:
            raise FitError(f"too many categories in {wide}")
    sums = [F.count("*").alias("n")]
    for c in numeric:
        whole = F.when(F.col(c) == F.floor(F.col(c)), F.col(c).cast("decimal(19,0)")).otherwise(F.raise_error(F.lit(f"{c} must be whole numbers")).cast("decimal(19,0)"))
        x = F.when(F.col(c).isNull(), F.lit(0).cast("decimal(19,0)")).otherwise(whole)
        sums += [F.sum(x).cast("decimal(38,0)").alias(f"s_{c}"), F.sum((x * x).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"q_{c}")]
    sets = [F.array_sort(F.collect_set(F.coalesce(c, F.lit(MISSING)))).alias(f"v_{c}") for c in categorical]
    got = rows.agg(*sums, *sets).first()
    out = []
    for c in numeric:
        n, s, q = got.n, int(got[f"s_{c}"] or 0), int(got[f"q_{c}"] or 0)
        deviation = float(np.sqrt((n * q - s * s) / (n * n))) if n else 0.0
        out.append({"name": f"num__{c}", "source": c, "category": None, "mean": s / n if n else 0.0, "scale": deviation or 1.0})
    for c in categorical:
        out += [{"name": f"cat__{c}_{v}", "source": c, "category": v, "mean": 0.0, "scale": 1.0} for v in got[f"v_{c}"]]
    return out


def encoded_one(c: dict) -> Column:
    """A row's value of one encoded column."""
    if c["category"] is None:
        return (F.coalesce(F.col(c["source"]).cast("double"), F.lit(0.0)) - F.lit(c["mean"])) / F.lit(c["scale"])
    return F.when(F.coalesce(F.col(c["source"]), F.lit(MISSING)) == c["category"], 1.0).otherwise(0.0)


def encoded(columns: list[dict]) -> Column:
    """A row's encoded values as an array; an unknown category is zero everywhere."""
    return F.array(*map(encoded_one, columns))


_SUMS = "model int, bucket long, f double, g binary, h binary"


def _ordered_sums(parts: DataFrame, buckets: int) -> DataFrame:
    """Sums of (model, bucket, f, g, h) over FAN_IN buckets of a model at a time, in order, until one a model is left."""

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        f, total = t.column("f")[0].as_py(), [np.frombuffer(t.column(k)[0].as_py()).copy() for k in ("g", "h")]
        for i in range(1, t.num_rows):
            f += t.column("f")[i].as_py()
            for s, k in zip(total, ("g", "h"), strict=True):
                s += np.frombuffer(t.column(k)[i].as_py())
        cells = [t.column("model")[:1], pa.array([t.column("bucket")[0].as_py() // FAN_IN]), pa.array([f]), pa.array([total[0].tobytes()], pa.binary()), pa.array([total[1].tobytes()], pa.binary())]
        return pa.table(cells, names=["model", "bucket", "f", "g", "h"])

    while buckets > 1:
        parts = parts.groupBy("model", F.floor(F.col("bucket") / FAN_IN)).applyInArrow(lambda t: add(t), _SUMS)
        buckets = -(-buckets // FAN_IN)
    return parts


def _passes(data: DataFrame, at: dict[int, np.ndarray]) -> DataFrame:
    """Objective, gradient and Hessian of every bucket at its model's weights; models that aren't asked for are passed over."""

    def one(key: tuple[int, int], held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        w, y = at[key[0]], np.concatenate([y for _, y in held])
        a = np.column_stack([np.ones(len(y)), np.concatenate([x for x, _ in held])])
        with np.errstate(over="ignore"):
            z = np.einsum("ij,j->i", a, w)
            q = 1 / (1 + np.exp(-z))
            f = float(np.sum(np.logaddexp(0, z) - y * z))
        g = np.einsum("ij,i->j", a, q - y)
        h = np.einsum("ij,ik->jk", a * (q * (1 - q))[:, None], a)
        cells = [pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([f]), pa.array([g.tobytes()], pa.binary()), pa.array([h.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, names=["model", "bucket", "f", "g", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            model, bucket, y = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy()
            values, ends = b.column(2).flatten().to_numpy(), np.cumsum(b.column(2).value_lengths().to_numpy())
            cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (model[1:] != model[:-1])) + 1).tolist(), len(y)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e > s and int(model[s]) in at:
                    key = (int(model[s]), int(bucket[s]))
                    if held and key != now:
                        yield one(now, held)
                        held = []
                    now = key
                    held.append((values[ends[s - 1] if s else 0 : ends[e - 1]].reshape(e - s, -1), y[s:e]))
        if held:
            yield one(now, held)

    return data.mapInArrow(run, _SUMS)


class _Newton:
    """One model's steps: Newton's direction, halved until the penalised objective doesn't rise."""

    def __init__(self, p: int, c: float):
        self.penalty = np.full(p, 1 / c)
        self.penalty[0] = 0
        self.w, self.f, self.step, self.scale, self.steps = np.zeros(p), np.inf, np.zeros(p), 1.0, 0
        self.done = False

    @property
    def at(self) -> np.ndarray:
        return self.w + self.scale * self.step

    def take(self, f: float, g: np.ndarray, h: np.ndarray) -> None:
        """Objective, gradient and Hessian at ``at``."""
        self.steps += 1
        at = self.at
        f = f + 0.5 * float(np.sum(self.penalty * at * at))
        g, h = g + self.penalty * at, h + np.diag(self.penalty)
        if not f <= self.f + 1e-12 * abs(self.f) and np.isfinite(self.f) and self.scale > 1e-9:
            self.scale /= 2
            return
        self.w, self.f, self.scale = at, f, 1.0
        try:
            self.step = -np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            raise FitError("the fit's curvature vanishes; scale the columns or weaken the penalty's constant") from None
        if np.abs(g).max() < TOLERANCE:
            self.w, self.done = self.at, True


def fit_many(rows: DataFrame, model: str, key: str = "subject_id", x: str = "x", y: str = "label", c: float | dict = C, bucket_rows: int = BUCKET_ROWS) -> dict[str, tuple[np.ndarray, int]]:
    """(intercept and coefficients, passes) of the L2-penalised logistic regression over the rows of each ``model``.

    All models share one shuffle: rows are dealt by model and subject, sorted once, and each pass over them takes a step
    of every model that isn't settled. A bucket's gradient and Hessian (p * p numbers) are added up along a tree, so the
    driver sees one sum a model, and the bits of a fit depend neither on partitions nor on the models beside it. A step
    that would raise the objective is halved, so no start diverges. ``c`` may differ by model; models are as many as are
    trained, and x may have another width in each. No row, or a fit that doesn't settle, is an error.
    """
    counts = {r[model]: r["n"] for r in rows.groupBy(model).agg(F.count("*").alias("n")).collect()}  # a row a model
    if not counts:
        raise FitError("no rows to fit")
    names = sorted(counts, key=str)
    table = rows.sparkSession.createDataFrame([(m, i, -(-counts[m] // bucket_rows)) for i, m in enumerate(names)], T.StructType([T.StructField("__m", rows.schema[model].dataType), T.StructField("__i", T.IntegerType()), T.StructField("__buckets", T.LongType())]))
    known = rows.join(F.broadcast(table), F.col(model).eqNullSafe(F.col("__m")))  # a row a model
    dealt = known.select(F.col("__i").alias("model"), F.pmod(F.xxhash64(key), F.col("__buckets")).alias("bucket"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(key).alias("k"))
    data = dealt.repartition("model", "bucket").sortWithinPartitions("model", "bucket", "k", "y", "x").select("model", "bucket", "x", "y").persist()
    try:
        widths = {r.model: r.p for r in data.groupBy("model").agg(F.max(F.size("x")).alias("p")).collect()}
        fits = {i: _Newton(widths[i] + 1, float(c[m] if isinstance(c, dict) else c)) for i, m in enumerate(names)}
        most = max(-(-n // bucket_rows) for n in counts.values())
        for _ in range(MOST_STEPS):
            asked = {i: f.at for i, f in fits.items() if not f.done}
            if not asked:
                break
            for r in _ordered_sums(_passes(data, asked), most).collect():
                p = len(asked[r.model])
                fits[r.model].take(r.f, np.frombuffer(r.g), np.frombuffer(r.h).reshape(p, p))
    finally:
        data.unpersist()
    if open_ones := [names[i] for i, f in fits.items() if not f.done]:
        raise FitError(f"no settled fit of {open_ones} after {MOST_STEPS} steps")
    return {m: (fits[i].w, fits[i].steps) for i, m in enumerate(names)}


def fit(rows: DataFrame, key: str = "subject_id", x: str = "x", y: str = "label", c: float = C, bucket_rows: int = BUCKET_ROWS) -> tuple[np.ndarray, int]:
    """(intercept and coefficients, passes) of one model; see ``fit_many``."""
    return fit_many(rows.withColumn("__model", F.lit(0)), "__model", key, x, y, c, bucket_rows)[0]


def linear_score(weights: list[float], intercept: float, x: str = "x") -> Column:
    """The margin of encoded rows under one model, by built-in functions."""
    w = F.array(*map(F.lit, weights))
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(intercept)), lambda s, v: s + v)


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def coefficient_rows(spark, model_version_id: str, columns: list[dict], w: np.ndarray, means: list[float]) -> DataFrame:
    """Rows of audit.model_coefficients; the intercept is position -1."""
    rows = [(model_version_id, -1, "intercept", "intercept", None, float(w[0]), 0.0, 0.0, 1.0)]
    rows += [(model_version_id, i, c["name"], c["source"], c["category"], float(w[i + 1]), float(means[i]), float(c["mean"]), float(c["scale"])) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "model_version_id string, pos int, feature_name string, source_feature string, category string, coefficient double, mean double, centre double, scale double")


#: What scoring and explaining read of a model, and its digest therefore covers.
ARTIFACT = ("feature_name", "source_feature", "category", "coefficient", "mean", "centre", "scale")


def artifact_digests(coefficients: DataFrame) -> DataFrame:
    """(model_version_id, artifact_digest) of every model: equal digests mean equal bits, since a double's text is injective."""
    entry = F.struct("pos", F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in ARTIFACT)), {"ignoreNullFields": "false"}).alias("v"))
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat_ws("|", e.pos.cast("string"), e.v)))
    return coefficients.groupBy("model_version_id").agg(identity.sha256(text).alias("artifact_digest"))


def model_verdicts(models: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(model_version_id, verdict): ok, mismatch, artifact missing or row missing, for all models."""
    found = artifact_digests(coefficients).withColumnRenamed("artifact_digest", "found")
    both = models.select("model_version_id", F.col("artifact_digest").alias("recorded")).join(found, "model_version_id", "full")
    return both.select("model_version_id", F.when(F.col("recorded").isNull(), "row missing").when(F.col("found").isNull(), "artifact missing").when(F.col("recorded") == F.col("found"), "ok").otherwise("mismatch").alias("verdict"))


def hit_rates(rows: DataFrame, score: str, label: str, keys: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """(keys, accuracy, positive_rate) of scores cut at ``threshold``."""
    p = (F.col(score) >= threshold).cast("int")
    return rows.groupBy(*keys).agg(F.avg((p == F.col(label)).cast("double")).alias("accuracy"), F.avg(p.cast("double")).alias("positive_rate"))


def environment_drift(models: DataFrame, env_digest: str) -> DataFrame:
    """Models fitted in another environment: reproducing them bit for bit is refused."""
    return models.where(F.col("env_digest") != env_digest).select("model_version_id", "env_digest")


def auc(rows: DataFrame, score: str, label: str, keys: tuple[str, ...] = (), ranges: int = 256) -> DataFrame:
    """Exact area under the ROC curve per key: positives' mid-ranks over distinct scores.

    Rows are counted by score first, so ranking orders distinct scores only. Ranks run over ranges of scores, each in
    its own task, on top of the counts of the ranges before. Range bounds are quantiles of the distinct scores, so ranges
    are about equal whatever the scores' scale; where the bounds lie doesn't change the result.
    """
    by = rows.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    cuts = F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 10 * ranges)
    bounds = by.agg(F.coalesce(F.array_distinct(cuts), F.array().cast("array<double>")).alias("bounds"))
    by = by.crossJoin(F.broadcast(bounds)).withColumn("range", F.size(F.filter("bounds", lambda b: b <= F.col("s")))).drop("bounds")  # one row
    totals = by.groupBy(*keys, "range").agg(F.sum("n").alias("rn"))
    before = totals.withColumn("before", F.coalesce(F.sum("rn").over(W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("rn")
    within = F.coalesce(F.sum("n").over(W.partitionBy(*keys, "range").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("within", within).join(before, [*keys, "range"])
    mid = F.col("before") + F.col("within") + (F.col("n") + 1) / F.lit(2.0)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * mid).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("t"))
    pairs = F.col("p") * (F.col("t") - F.col("p"))
    return sums.select(*keys, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / F.lit(2.0), pairs.cast("double")).alias("auc"), F.col("p").alias("n_positive"), F.col("t").alias("n"))


def background(rows: DataFrame, k: int, keys: tuple[str, ...] = (), key: str = "subject_id", seed: str = "background") -> DataFrame:
    """The ``k`` rows of each key that a seeded hash of ``key`` puts first: the same ones over any partitioning.

    Every task keeps k rows a key before the shuffle, so samples of many models are one job. Equal ids go by their rows.
    """
    order = [F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), *rows.columns]
    own = "__at" + "_" * sum(c.startswith("__at") for c in rows.columns)
    return rows.withColumn(own, F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order))).where(F.col(own) <= k).drop(own)


def background_means(sample: DataFrame, x: str = "x", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pos, mean) of a sample's encoded rows: what attributions against it are counted from."""
    return sample.select(*keys, F.posexplode(x).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("mean"))
