"""The trail from raw lines to erasure, on synthetic applications."""

import hashlib
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tracewell.functions import identity, scoring
from tracewell.operators import contamination, explain, fairness, fit, versions
from tracewell.operators.versions import SnapshotTombstonedError, Trail, TrailError
from tracewell.plans import erasure, models
from tracewell.plans.ingest import ingest
from tracewell.sources import applications
from tracewell.streaming import decisions


#: What a raw line's fields may hold, in their order: numbers from a range, or words.
FIELDS = [
    range(18, 90), ("Private", "State-gov", "Without-pay", "?"), range(12_000, 990_000), ("Some-college", "Prof-school", "12th"), range(1, 17), ("Widowed", "Separated", "Married-AF-spouse"), ("Farming-fishing", "Armed-Forces", "?"),
    ("Unmarried", "Other-relative"), ("Other", "White", "Amer-Indian-Eskimo"), ("Female", "Male"), range(0, 99_999, 1111), range(0, 4_000, 500), range(1, 99), ("Peru", "Cuba", "Japan", "?"), ("<=50K", ">50K", "<=50K", "<=50K.", ">50K."),
]
AGE, WORKCLASS, SEX, INCOME = 0, 1, 9, 14


def lines(n=240, batch=1, by_sex=False):
    """Distinct lines by arithmetic alone: field k of line i steps through its values with a stride of its own."""
    out = []
    for i in range(n):
        x = [str(values[(batch * 31 + i * (2 * k + 3) + i * i // (k + 2)) % len(values)]) for k, values in enumerate(FIELDS)]
        if by_sex:
            x[INCOME] = ">50K" if x[SEX] == "Male" else "<=50K"
        out.append(", ".join(x))
    return out


REPEATS = 3


def with_repeats(text):
    return text + [text[17]] * (REPEATS - 1) + [text[40]]


@pytest.fixture(scope="module")
def trail(spark, tmp_path_factory):
    t = Trail(spark, str(tmp_path_factory.mktemp("trail")))
    assert {r.state for r in t.bootstrap().collect()} == {"created"}
    assert {r.state for r in t.bootstrap().collect()} == {"existing"}
    return t


def frame(spark, text):
    return spark.createDataFrame([(x,) for x in text], "value string")


@pytest.fixture(scope="module")
def first(spark, trail):
    return ingest(trail, applications.parse(frame(spark, [*with_repeats(lines()), "", "|cross", "1,2,3"]), "b1"))


@pytest.fixture(scope="module")
def model(trail, first):
    return models.train(trail, first["train_snapshot"], first["eval_snapshot"], env_digest="e")


def plain_parse(text):
    """Of raw lines: subject id to (split, age, workclass, label)."""
    seen, out = {}, {}
    for x in map(str.strip, text):
        v = [y.strip() for y in x.split(",")]
        if not x or x.startswith("|") or len(v) != 15:
            continue
        k = seen[x] = seen.get(x, -1) + 1
        i = hashlib.sha256(f"{x}#{k}".encode()).hexdigest()[:16]
        part = int(i[:8], 16) % 100
        out[i] = ("train" if part < 70 else "eval" if part < 85 else "holdout", int(v[AGE]), None if v[WORKCLASS] in ("", "?") else v[WORKCLASS], int(v[INCOME].rstrip(".") == ">50K"))
    return out


def test_parsing_against_plain_python(spark):
    rng = random.Random(5)
    pad = lambda: "".join(rng.choice(" \t\x0b\u00a0") for _ in range(rng.randrange(3)))
    odd = [",".join(pad() + y.strip() + pad() for y in x.split(",")) + rng.choice(["", ".", ".."]) for x in lines(60, 9)]
    text = [*with_repeats(lines()), *odd, "", "\t", "|bar", "1,2", ",".join("?" * 16)]
    got = {r.subject_id: (r.split, r.age, r.workclass, r.label) for r in applications.parse(frame(spark, text).repartition(3), "b").collect()}
    assert got == plain_parse(text) and len(got) == 240 + REPEATS + 60


def test_occurrences_of_a_hot_line(spark):
    rows = spark.createDataFrame([("x",)] * 700 + [("y",)] * 3, "line string").repartition(5)
    got = sorted((r.line, r.occurrence) for r in applications.with_occurrence(rows, "line").collect())
    assert got == [("x", i) for i in range(700)] + [("y", i) for i in range(3)]


def test_identities(spark):
    keys = ["", "a|b|", "é|1"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(identity.uuid5(identity.SNAPSHOT_NAMESPACE, F.col("k"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.UUID(identity.SNAPSHOT_NAMESPACE), k)) for k in keys]
    one = spark.createDataFrame([(1, None, "a\"b")], "b int, a string, c string")
    row = one.select(identity.canonical_json(one, "b", "a", "c")).first()[0]
    assert row == json.dumps({"a": None, "b": 1, "c": 'a"b'}, sort_keys=True, separators=(",", ":"))


def test_ingest_is_idempotent(spark, trail, first):
    assert first["rows_written"] == 240 + REPEATS
    again = ingest(trail, applications.parse(frame(spark, lines()), "b2"))
    assert again["rows_written"] == 0 and again["train_snapshot"] == first["train_snapshot"]


def test_digests_ignore_order(spark, trail, first):
    rows = trail.materialize(first["train_snapshot"], verify=True)
    d = lambda r: versions.content_digest(r, identity.row_digest(r, *versions.CONTENT)).first()
    assert d(rows) == d(rows.repartition(5).orderBy(F.rand(1)))
    changed = rows.withColumn("age", F.when(F.col("subject_id") == rows.first().subject_id, 1).otherwise(F.col("age")))
    assert d(rows).content_digest != d(changed).content_digest


def test_required_columns(trail):
    with pytest.raises(Exception, match="is required"):
        trail.records("audit.training_membership", [{"subject_id": "s", "role": "train"}])


def test_reproduce(trail, model, first):
    assert models.reproduce(trail, model, "e")["reproduced"]
    with pytest.raises(models.EnvironmentDriftError):
        models.reproduce(trail, model, "other")
    with pytest.raises(models.ProvenanceIntegrityError):
        models.load_checked(trail, "nobody")


def test_fit_against_reference_optimum(trail, first):
    """The gradient of the penalised likelihood vanishes at the fit."""
    import numpy as np

    rows = trail.materialize(first["train_snapshot"])
    columns = fit.encoding(rows)
    data = rows.withColumn("x", fit.encoded(columns))
    w, _ = fit.fit(data)
    got = data.select("x", "label").collect()
    a, y = np.array([[1.0, *r.x] for r in got]), np.array([r.label for r in got])
    g = a.T @ (1 / (1 + np.exp(-a @ w)) - y) + np.r_[0, w[1:]]
    assert np.abs(g).max() < 1e-6


def test_evaluate_once(trail, model, first):
    rows = models.evaluate(trail, model, first["eval_snapshot"], "sex", min_group_n=5)
    n = trail.read("audit.fairness_evaluations").count()
    assert rows.count() == n > 5
    models.evaluate(trail, model, first["eval_snapshot"], "sex", min_group_n=5)
    assert trail.read("audit.fairness_evaluations").count() == n
    with pytest.raises(TrailError):
        models.evaluate(trail, model, first["eval_snapshot"], "subject_id")


def test_decide_record_and_report(spark, trail, model, first):
    asked = trail.materialize(first["eval_snapshot"]).select(F.col("subject_id").alias("request_key"), "subject_id", *versions.input_columns())
    p, a, bad = models.decide(trail, model, asked)
    n = asked.count()
    assert models.record_decisions(trail, p, a) == n and models.record_decisions(trail, p, a) == 0 and bad.count() == 0
    some = models.decide(trail, model, asked.withColumn("shoe_size", F.when(F.col("sex") == "Male", 1)))
    men = asked.where("sex = 'Male'").count()
    assert 0 < men < n and (some[0].count(), some[2].count()) == (n - men, men) and some[2].first().unknown_features == ["shoe_size"]
    ids = trail.read("audit.predictions").select("prediction_id").union(spark.createDataFrame([("nobody",)], "p string"))
    snaps = trail.current("audit.data_snapshots", "data_snapshot_uuid")
    got = explain.reports(ids, trail.read("audit.predictions"), trail.current("audit.model_versions", "model_version_id"), snaps, trail.read("audit.attributions"), 5).collect()
    assert sum(r.status == "ok" for r in got) == n and [r.prediction_id for r in got if r.status == "not_found"] == ["nobody"]
    assert all(len(r.attributions) == 5 for r in got if r.status == "ok")
    tampered = trail.read("audit.attributions").withColumn("shap_value", F.col("shap_value") + 0.1)
    assert {r.status for r in explain.reports(ids.limit(3), trail.read("audit.predictions"), trail.current("audit.model_versions", "model_version_id"), snaps, tampered).collect()} == {"integrity_failure"}


def test_stream_replay_and_torn_lines(spark, trail, model, first, tmp_path):
    """Good, torn, incomplete and non-additive lines end up each in their place, once, whatever is replayed."""
    asked = trail.materialize(first["train_snapshot"]).limit(20).select(F.concat(F.lit("s"), "subject_id").alias("request_key"), "subject_id", *versions.input_columns())
    p, a, _ = models.decide(trail, model, asked)
    p = p.withColumn("prediction_ts", F.lit("2024-05-01 23:59:59.123456").cast("timestamp"))
    text = [r.value for r in decisions.encoded_lines(p, a.withColumn("prediction_ts", F.lit("2024-05-01 23:59:59.123456").cast("timestamp"))).collect()]
    assert all("2024-05-01T23:59:59.123456" in x for x in text)
    spool, before = tmp_path / "spool", trail.read("audit.predictions").count()
    spool.mkdir()
    whole = [json.loads(x) for x in text]
    for k in (13, 14, 15):
        whole[k]["attributions"][0]["shap_value"] += 0.5
    lost = json.loads(text[16])
    del lost["prediction"]["decision"]
    bad = [json.dumps(whole[13]), json.dumps(lost), '{"prediction":' + json.dumps(whole[12]["prediction"]) + "}"]
    (spool / "1.jsonl").write_text("\n".join([*text[:10], *bad, text[11][:200]]))
    again = [text[k].replace("05-01T23:59:59", "05-02T00:00:01") for k in (2, 3)]  # the same decisions on another day
    (spool / "2.jsonl").write_text("\n".join([*text[5:11], *again, bad[0]]) + "\n")
    assert decisions.pending(spark, trail, str(spool)) == 11
    for ck in ("a", "a", "b"):  # twice from one checkpoint, then a replay from the start
        decisions.drain(trail, str(spool), str(tmp_path / ck)).awaitTermination()
    assert trail.read("audit.predictions").count() == before + 11 and decisions.pending(spark, trail, str(spool)) == 0 == decisions.pending(spark, trail, str(spool), str(tmp_path / "a"))
    assert sorted(r.reason for r in trail.read("audit.rejects").collect()) == ["incomplete", "incomplete", "not additive", "torn"]
    got = trail.read("audit.predictions").where("day = '2024-05-01'").select(F.date_format("prediction_ts", "HH:mm:ss.SSSSSS")).distinct().collect()
    assert [r[0] for r in got] == ["23:59:59.123456"] and trail.read("audit.predictions").where("day = '2024-05-02'").count() == 0
    n = trail.read("audit.predictions").join(trail.read("audit.attributions").groupBy("prediction_id").count(), "prediction_id").select("count").distinct().collect()
    assert len(n) == 1  # each with all its attributions
    (spool / "3.jsonl").write_text("\n".join([text[12], text[13]]) + "\n")  # one that was refused, mended
    assert decisions.pending(spark, trail, str(spool), str(tmp_path / "a")) == 2
    decisions.drain(trail, str(spool), str(tmp_path / "a")).awaitTermination()
    assert trail.read("audit.predictions").count() == before + 13


@pytest.mark.parametrize("table", ["audit.decision_ids", "audit.attributions", "audit.predictions"])
def test_a_batch_that_broke_off_is_completed(spark, tmp_path, monkeypatch, table):
    t = Trail(spark, str(tmp_path / "t"), buckets=3)
    t.bootstrap()
    p, a = some_decisions(spark, 30)
    rows = decisions.judged(decisions.encoded_lines(p, a))
    with monkeypatch.context() as m:
        write = Trail.write
        m.setattr(Trail, "write", lambda self, name, *x: (_ for _ in ()).throw(Broken()) if name == table else write(self, name, *x))
        with pytest.raises(Broken):
            decisions.drain_batch(t, rows)
    moved = rows.withColumn("value", F.regexp_replace("value", "2024-03-0", "2024-04-1"))
    assert decisions.drain_batch(t, decisions.judged(moved)) == 30  # a producer that stamped the time again
    assert decisions.drain_batch(t, rows) == 0
    assert t.read("audit.predictions").count() == 30 and t.read("audit.attributions").count() == 60 == t.read("audit.attributions").select("prediction_id", "feature_name").distinct().count()


def some_decisions(spark, n):
    p = spark.range(n).select(F.concat(F.lit("p"), "id").alias("prediction_id"), F.expr("timestamp'2024-03-01' + make_dt_interval(CAST(id % 5 AS INT))").alias("prediction_ts"), F.lit("m").alias("model_version_id"), F.lit("s").alias("subject_id"), F.lit("{}").alias("input_json"), F.lit("d").alias("input_digest"), F.lit(0.5).alias("score"), F.lit(0.5).alias("threshold"), F.lit("approve").alias("decision"), F.lit("complete").alias("explainer_status"))
    a = p.select("prediction_id", "prediction_ts", "model_version_id", F.explode(F.array(F.lit("f"), F.lit("g"))).alias("feature_name"), F.lit("v").alias("feature_value_str"), F.lit(0.25).alias("shap_value"), F.lit(-0.5).alias("base_value"), F.lit(1).alias("abs_rank"), F.lit("linear").alias("explainer_type"))
    return p.withColumns({"latency_ms": F.lit(1.0), "shap_ms": F.lit(1.0)}), a


def test_history_is_asked_by_bucket(spark, tmp_path):
    t = Trail(spark, str(tmp_path / "t"), buckets=32)
    t.bootstrap()
    p, a = some_decisions(spark, 400)
    assert decisions.record(t, p, a) == 400
    two = p.where("prediction_id IN ('p3', 'p77')").select("prediction_id")
    found = decisions.asked(t, "audit.decision_ids", two, "prediction_id")
    assert {r.prediction_id for r in found.collect()} == {"p3", "p77"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "subject_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(prediction_id" in plan
    assert found.select("_metadata.file_path").distinct().count() <= 2


def test_compare(spark, trail, model, first):
    second = ingest(trail, applications.parse(frame(spark, lines(330, 4, True)), "b3"))
    assert second["eval_snapshot"] == first["eval_snapshot"] and second["train_snapshot"] != first["train_snapshot"]
    other = models.train(trail, second["train_snapshot"], second["eval_snapshot"], env_digest="e")
    rows = models.compare(trail, model, other, "sex", min_group_n=5, env_digest="e").collect()
    assert rows and all(abs(r.total_delta - r.model_effect - r.data_effect) < 1e-12 for r in rows)
    assert all(abs(r.model_effect) < 1e-9 for r in rows)  # one configuration: all of the change is the data's
    back = {r.metric_name: r.total_delta for r in models.compare(trail, other, model, "sex", min_group_n=5, env_digest="e").collect()}
    assert all(back[r.metric_name] == pytest.approx(-r.total_delta, abs=1e-12) for r in rows)
    with pytest.raises(TrailError):
        models.compare(trail, model, model, "sex")


def test_erase(spark, trail, model, first):
    """Runs last: an evaluation subject and a training subject are erased."""
    rows = trail.read("features.credit_applications")
    picked = [rows.where("split = 'train' AND ingest_batch_id = 'b1'").first().subject_id, trail.read("features.eval_holdout").first().subject_id]
    gone = spark.createDataFrame([(s,) for s in picked], "subject_id string")
    assert erasure.residue(trail, "features.credit_applications", gone).count() == 2
    before = rows.count()
    out = erasure.erase(trail, gone, retire=True)
    assert out["subjects"] == 2 and out["rows_removed"] == 3 and model in out["models_retired"] and len(out["snapshots_tombstoned"]) >= 2
    assert trail.read("features.credit_applications").count() == before - 2
    for t in erasure.TABLES:
        assert erasure.residue(trail, t, gone).count() == 0
    with pytest.raises(SnapshotTombstonedError):
        trail.materialize(first["train_snapshot"])
    assert models.scored(trail, model, trail.read("features.credit_applications")).where("score > 0 AND score < 1").count() == before - 2  # the artifact is enough
    seen = trail.read("audit.training_membership").where(F.col("subject_id").isin(picked)).count()
    assert seen >= 2  # that they were there stays on record
    assert [r.status for r in erasure.requests_of(trail, picked[0]).collect()] == ["completed"]
    again = ingest(trail, applications.parse(frame(spark, lines()), "b4"))
    assert again["rows_written"] == 0 and erasure.residue(trail, "features.credit_applications", gone).count() == 0
    report = contamination.contaminations(trail.read("audit.training_membership").where(F.col("subject_id").isin(picked)), trail.current("audit.model_versions", "model_version_id"), trail.current("audit.snapshot_tombstones", "data_snapshot_uuid"))
    assert all(r.registered and not r.serving and not r.reproducible for r in report.where(F.col("model_version_id") == model).collect())
    assert trail.inventory().where("n_rows > 0").count() >= 9


def plain_differences(rows, cutoff):
    """The spreads of the rates of groups of at least ``cutoff``, from (y, p, group)."""
    rates = {}
    for g in {g for _, _, g in rows}:
        own = [(y, p) for y, p, h in rows if h == g]
        share = lambda xs: sum(xs) / len(xs) if xs else None
        if len(own) >= cutoff:
            rates[g] = (share([p for _, p in own]), share([p for y, p in own if y]), share([p for y, p in own if not y]), share([int(y == p) for y, p in own]))
    names = ("demographic_parity_difference", "equal_opportunity_difference", "false_positive_rate_difference", "accuracy_difference")
    out = {}
    for k, name in enumerate(names):
        known = [r[k] for r in rates.values() if r[k] is not None]
        if len(known) > 1:
            out[name] = max(known) - min(known)
    odds = [out[n] for n in names[1:3] if n in out]
    return out | ({"equalized_odds_difference": max(odds)} if odds else {})


def test_fairness_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for case in range(40):
        groups = "UVWX"[: rng.randint(1, 4)]
        rows += [(case, int(rng.random() < 0.1 * (case % 11)), rng.randrange(2), rng.choice(groups)) for _ in range(rng.randint(1, 45))]
    df = spark.createDataFrame(rows, "case int, y int, p int, g string")
    for cutoff in (1, 7):
        got = {c: {} for c in range(40)}
        for r in fairness.metric_rows(fairness.group_rates(df, "y", "p", F.col("g"), ("case",)), ("case",), cutoff).where("group_value IS NULL").collect():
            got[r.case][r.metric_name] = r.metric_value
        for case in range(40):
            assert got[case] == pytest.approx(plain_differences([r[1:] for r in rows if r[0] == case], cutoff))


def test_probabilities_are_refused(spark):
    rows = spark.createDataFrame([(1, 0.4, "A")], "y int, p double, g string")
    with pytest.raises(Exception, match="must be 0 or 1"):
        fairness.group_rates(rows, "y", "p", F.col("g")).collect()


def test_statements(spark):
    rows = spark.createDataFrame([("sex", "Female", "Male", -1.0), ("sex", "Male", "Male", 1.0), ("age", None, "39", 0.0)], "s string, c string, v string, x double")
    got = [tuple(r) for r in rows.select(scoring.statement(F.col("s"), F.col("c"), F.col("v")), scoring.direction(F.col("x"))).collect()]
    assert got == [("sex is not Female", "toward denial"), ("sex = Male", "toward approval"), ("age = 39", "toward denial")]


def test_nan_has_no_canonical_form(spark):
    rows = spark.createDataFrame([(1.5, "NaN", 2)], "x double, s string, n int")
    assert rows.select(identity.canonical_json(rows, "x", "s", "n")).first()[0] == '{"n":2,"s":"NaN","x":1.5}'
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="no canonical form"):
            rows.withColumn("x", F.lit(bad)).select(identity.canonical_json(rows, "x", "s")).collect()


def test_fits_that_are_refused(spark, monkeypatch):
    rows = spark.createDataFrame([(str(i), i, 0.25 * i, i % 2) for i in range(20)], "subject_id string, n int, f double, label int")
    with pytest.raises(Exception, match="whole numbers"):
        fit.encoding(rows, ("f",), ())
    data = rows.withColumn("x", fit.encoded(fit.encoding(rows, ("n",), ())))
    with pytest.raises(fit.FitError):
        fit.fit(data.limit(0))
    monkeypatch.setattr(fit, "MOST_STEPS", 1)
    with pytest.raises(fit.FitError):
        fit.fit(data)


def test_fit_over_a_tree_of_buckets(spark):
    """Many buckets, added up over several levels, give the same fit as one; its bits don't depend on partitions."""
    import numpy as np

    rows = spark.createDataFrame([(str(i), (i * 37) % 101, int((i * i) % 7 < 3)) for i in range(600)], "subject_id string, n int, label int")
    data = rows.withColumn("x", fit.encoded(fit.encoding(rows, ("n",), ())))
    one = fit.fit(data)[0]
    many = [fit.fit(data.repartition(k), bucket_rows=3)[0] for k in (1, 5)]
    assert many[0].tobytes() == many[1].tobytes() and np.allclose(one, many[0], atol=1e-9)


def test_every_part_of_an_artifact_is_digested(spark):
    columns = [{"name": "n", "source": "n", "category": None, "mean": 2.0, "scale": 3.0}]
    digest = lambda rows: fit.artifact_digests(rows).first().artifact_digest
    rows = fit.coefficient_rows(spark, "m", columns, [0.5, 1.5], [0.0])
    changed = [rows.withColumn(c, F.when(F.col("pos") == 0, F.lit("z" if c in ("feature_name", "source_feature", "category") else 9.0)).otherwise(F.col(c))) for c in fit.ARTIFACT]
    assert len({digest(r) for r in [rows, *changed]}) == 1 + len(fit.ARTIFACT)


STEPS = ["tombstone", "stage_removal", "publish_removal", "residue"]


class Broken(Exception):
    pass


def break_off(m, step):
    """Makes a step of an erasure fail: before it begins, or half-way."""
    def fail(*_):
        raise Broken

    if step in ("between stones and states", "while sums are written", "after the log's row"):
        if step == "after the log's row":
            m.setattr(Trail, "vacuum", fail)
        else:
            name = "append" if step == "between stones and states" else "write"
            table = "audit.data_snapshots" if name == "append" else "audit.content_sums"
            real = getattr(Trail, name)
            m.setattr(Trail, name, lambda self, t, *a: fail() if t == table else real(self, t, *a))
    else:
        m.setattr(erasure, step, fail)


@pytest.mark.parametrize("step", [*STEPS, "between stones and states", "while sums are written", "after the log's row"])
def test_erasure_survives_a_failure_at_any_step(spark, tmp_path, monkeypatch, step):
    """Whatever broke off, readers see all rows of a table or all but the erased ones, and a second run under the same request leaves what one whole run leaves."""
    t = Trail(spark, str(tmp_path / "t"), buckets=5)
    t.bootstrap()
    made = ingest(t, applications.parse(frame(spark, lines(60, 7)), "b"))
    picked = [r.subject_id for r in t.read("features.credit_applications").where("split = 'train'").limit(2).collect()] + [t.read("features.eval_holdout").first().subject_id]
    gone, before = spark.createDataFrame([(x,) for x in picked], "subject_id string"), t.read("features.credit_applications").count()
    held = t.read("features.eval_holdout").count()
    with monkeypatch.context() as m:
        break_off(m, step)
        with pytest.raises(Broken):
            erasure.erase(t, gone)
    assert {r.status for x in picked for r in erasure.requests_of(t, x).collect()} == {"failed"}
    other = Trail(spark, t.root)  # a reader of its own
    assert other.read("features.credit_applications").count() in (before, before - 3) and other.read("features.eval_holdout").count() in (held, held - 1)
    for name, n in (("train_snapshot", made["splits"]["train"]), ("eval_snapshot", held)):  # whole, or refused
        try:
            assert other.materialize(made[name], verify=True).count() == n
        except SnapshotTombstonedError:
            assert step != "tombstone"
    try:
        other.materialize(t.capture("features.credit_applications", "train"), verify=True)
    except SnapshotTombstonedError:
        assert step != "after the log's row"
    out = erasure.erase(t, gone)
    assert out["subjects"] == 3 and set(out["snapshots_tombstoned"]) >= {made["train_snapshot"], made["eval_snapshot"]}
    assert t.read("features.credit_applications").count() == before - 3 and all(erasure.residue(t, x, gone).count() == 0 for x in erasure.TABLES)
    assert [[(r.status, r.live_rows_deleted) for r in erasure.requests_of(t, x).collect()] for x in picked] == [[("completed", n)] for n in (1, 1, 2)]
    assert t.read("audit.snapshot_tombstones").count() == t.current("audit.data_snapshots", "data_snapshot_uuid").where("status = 'tombstoned'").count() >= 2
    cost = {r.subject_id: json.loads(r.resolution_json)["snapshots_tombstoned"] for x in picked for r in erasure.requests_of(t, x).collect()}
    assert all(made["train_snapshot"] in cost[x] and made["eval_snapshot"] not in cost[x] for x in picked[:2])
    assert cost[picked[2]] == [made["eval_snapshot"]]  # and what the others cost isn't its own
    later = ingest(t, applications.parse(frame(spark, lines(60, 7)), "c"))
    assert later["rows_written"] == 0 and later["train_snapshot"] != made["train_snapshot"]
    t.materialize(later["train_snapshot"], verify=True)


def test_commits_that_broke_off_are_not_seen(spark, tmp_path, monkeypatch):
    """Rows and sums of an append without its row of the log: invisible, and gone when their number is taken again."""
    t = Trail(spark, str(tmp_path / "t"), buckets=3)
    t.bootstrap()
    rows = applications.parse(frame(spark, lines(50, 3)), "b")
    half = rows.where("age % 2 = 0")
    with monkeypatch.context() as m:
        m.setattr(Trail, "commit", lambda *a: (_ for _ in ()).throw(Broken()))
        with pytest.raises(Broken):
            t.append("features.credit_applications", rows)
    assert t.read("features.credit_applications").count() == 0 and t.raw("features.credit_applications").count() == 50
    t.append("features.credit_applications", half)
    assert t.read("features.credit_applications").count() == half.count() == t.raw("features.credit_applications").count()
    t.materialize(t.capture("features.credit_applications"), verify=True)


def test_version_digests_add_up(spark, tmp_path):
    """After appends and an erasure a captured digest is that of a full recomputation, though no row was read."""
    t = Trail(spark, str(tmp_path / "t"))
    t.bootstrap()
    rows = applications.parse(frame(spark, lines(120, 5)), "b").withColumn("part", F.pmod(F.xxhash64("subject_id"), F.lit(3)))
    for k in range(3):
        t.append("features.credit_applications", rows.where(F.col("part") == k).drop("part"))
    gone = t.read("features.credit_applications").limit(7).select("subject_id")
    gone = spark.createDataFrame(gone.collect(), gone.schema)
    for after in range(2):
        for split in (None, "train", "eval"):
            uuid_of = t.capture("features.credit_applications", split)
            assert t.materialize(uuid_of, verify=True).count() == t.find("audit.data_snapshots", "data_snapshot_uuid", uuid_of).first().row_count
        if not after:
            assert erasure.remove_rows(t, "features.credit_applications", gone) == 7
    plan = t.recorded_content("features.credit_applications", 3)._jdf.queryExecution().executedPlan().toString()
    assert "credit_applications" not in plan.replace("table_identifier", "").replace("features.credit_applications", "")


def test_digest_of_a_multiset(spark):
    rows = spark.range(40).select((F.col("id") % 8).alias("k"))
    d = lambda r: versions.content_digest(r, identity.row_digest(r, "k")).first()
    assert d(rows) == d(rows.repartition(7)) and d(rows).row_count == 40
    assert d(rows).content_digest != d(rows.where("k < 7").union(rows.where("k = 0").limit(5))).content_digest
    assert d(rows.limit(0)).row_count == 0


def test_canonical_text_is_exact(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00.25' AS a, timestamp'2024-01-01 00:00:00.750001' AS b, timestamp'2024-01-01' AS c, CAST(1.50 AS decimal(10,2)) AS d, X'00FF' AS e, '2024-01-01T00:00:00.000000+00:00' AS f, timestamp_ntz'2024-01-01 00:00:00.5' AS g")
    got = json.loads(df.select(identity.canonical_json(df, *df.columns)).first()[0])
    assert got == {"a": "2024-01-01T00:00:00.250000+00:00", "b": "2024-01-01T00:00:00.750001+00:00", "c": "2024-01-01T00:00:00+00:00", "d": "1.50", "e": "00ff", "f": "2024-01-01T00:00:00.000000+00:00", "g": "2024-01-01T00:00:00.500000"}


def test_residue_reads_what_can_hold_a_subject(spark, tmp_path):
    """One subject of 200,000: one bucket's folder is opened, and of its rows the pages that can hold it."""
    t = Trail(spark, str(tmp_path / "t"), buckets=4)
    t.bootstrap()
    rows = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("subject_id"), F.lit("m").alias("model_version_id"), F.lit("train").alias("role"))
    t.append("audit.training_membership", rows)
    one = t.read("audit.training_membership").limit(1).select("subject_id")
    one = spark.createDataFrame(one.collect(), one.schema)
    found = erasure.residue(t, "audit.training_membership", one)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "subject_bucket" in plan.split("PartitionFilters")[1] and "In(subject_id" in plan or "EqualTo(subject_id" in plan
    scanned = spark.read.parquet(t.path("audit.training_membership")).where(F.col("subject_id") == one.first()[0])
    scanned.collect()
    leaves = scanned._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.apply(0).metrics().apply("numOutputRows").value() < 60_000


def test_streamed_history_is_read_by_day(spark, trail):
    import datetime

    plan = decisions.on_days(trail, "audit.predictions", [datetime.date(2024, 1, 2)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [day" in plan.replace("isnotnull", "")


def one_day(spark, n):
    p, a = some_decisions(spark, n)
    return (x.withColumn("prediction_ts", F.lit("2024-03-01 12:00:00").cast("timestamp")) for x in (p, a))


def test_a_day_of_any_size_is_dealt_into_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decisions, "SLICE", 100)
    t = Trail(spark, str(tmp_path / "t"), buckets=3)
    t.bootstrap()
    p, a = one_day(spark, 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join slices as small as these
    try:
        assert decisions.record(t, p, a) == 1000 and decisions.record(t, p, a) == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for table, n in (("audit.predictions", 1000), ("audit.attributions", 2000)):
        files = t.read(table).groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect()
        assert sum(r.n for r in files) == n and len(files) > 2 and max(r.n for r in files) < n
    pairs = t.read("audit.attributions").select("prediction_id", "feature_name")
    assert pairs.distinct().count() == 2000


def test_parts_carry_their_decision_without_a_shuffle(spark, trail, model, first):
    asked = trail.materialize(first["eval_snapshot"]).select(F.col("subject_id").alias("request_key"), "subject_id", *versions.input_columns())
    _, a, _ = models.decide(trail, model, asked)
    assert "SortMergeJoin" not in (plan := a._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(prediction_id" not in plan


def test_means_are_counted_from_their_sources(trail, first):
    rows = trail.materialize(first["train_snapshot"])
    columns = fit.encoding(rows)
    assert models._means(rows, columns) == pytest.approx([r.m for r in rows.select(F.posexplode(fit.encoded(columns)).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()], abs=1e-9)


def test_ends_are_trimmed_of_all_white_space(spark):
    odd = [chr(i) for i in range(0x3100)]
    rows = spark.createDataFrame([(f"{c}{d}a{c} b{d}{c}",) for c in odd for d in ("", " ", "\t")], "v string")
    assert [r[0] for r in rows.where(scoring.strip(F.col("v")) != F.regexp_replace("v", "(?U)^[\\s\\x1C-\\x1F]+|[\\s\\x1C-\\x1F]+$", "")).collect()] == []
    assert "regexp_replace" not in str(scoring.strip(F.col("v")))


def test_an_erasure_works_out_its_subjects_once(spark, tmp_path):
    t = Trail(spark, str(tmp_path / "t"), buckets=2)
    t.bootstrap()
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    subjects = spark.range(10, numPartitions=1).select(F.concat(F.lit("s"), "id").alias("subject_id")).mapInArrow(count, "subject_id string")
    assert erasure.log_request(t, subjects).count() == 10 and seen.value == 10


def test_a_raw_line_is_stripped_once(spark):
    plan = applications.parse(frame(spark, lines(3)).repartition(2), "b")._jdf.queryExecution().optimizedPlan().toString()
    flat = plan.replace("\n", " ").split("Filter ")
    assert len(flat) > 1 and not any("(trim(" in x.split("+- ")[0] for x in flat[1:])


def test_batches_parse_their_own_lines_only(spark, monkeypatch):
    """A line is parsed in one of three batches, and has the identity that it has among all lines."""
    from tests.helpers import DATA
    from tracewell import queries, trail_queries

    every, parse, read = {r[0] for r in queries.parsed_applications(spark, DATA).select("subject_id").collect()}, applications.parse, []
    monkeypatch.setattr(trail_queries.applications, "parse", lambda rows, batch: (read.append(rows.count()), parse(rows, batch))[1])
    monkeypatch.setattr(trail_queries, "ingest", lambda trail, rows: [r.subject_id for r in rows.select("subject_id").collect()])
    _, made = trail_queries._batches(spark, DATA)
    assert len(read) == 3 and sum(read) == spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert sum(map(len, made)) == len(every) and {i for one in made for i in one} == every


def spooled(spark, folder, first, n):
    p, a = some_decisions(spark, n)
    decisions.encoded_lines(p, a).where(F.regexp_extract("value", '"prediction_id":"p([0-9]+)"', 1).cast("int") >= first).write.text(str(folder))


@pytest.mark.parametrize("chosen", [False, True])
def test_the_stream_keeps_its_keys_on_disk(spark, tmp_path, chosen):
    """In RocksDB with bounded memory, unless the session or the checkpoint has a store of its own; the session's settings stay."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    settings = lambda: {k: spark.conf.get(k, None) for k in decisions.STATE}
    assert set(settings().values()) == {None} and "true" in decisions.STATE.values()
    t = Trail(spark, str(tmp_path / "t"), buckets=2)
    t.bootstrap()
    spooled(spark, tmp_path / "spool" / "1", 0, 30)
    if chosen:
        spark.conf.set(provider, spark.conf.get(provider))
    seen = []
    try:
        for folder in ("2", None):
            before = settings()
            q = decisions.drain(t, str(tmp_path / "spool" / "*"), str(tmp_path / "ck"))
            q.awaitTermination()
            assert settings() == before
            seen += [s for p in q.recentProgress for s in p["stateOperators"]]
            spark.conf.unset(provider)  # a checkpoint that began with another store keeps it
            if folder:
                spooled(spark, tmp_path / "spool" / folder, 20, 40)
    finally:
        spark.conf.unset(provider)
    assert all(any(m.startswith("rocksdb") for m in s["customMetrics"]) != chosen for s in seen)
    assert max(s["numRowsTotal"] for s in seen) == 40 == sum(s["numRowsUpdated"] for s in seen)  # ten of the second folder are repeats
    assert t.read("audit.predictions").count() == 40 == t.read("audit.predictions").select("prediction_id").distinct().count()


def test_the_history_is_never_broadcast(spark, tmp_path, monkeypatch):
    """Its files can be small and hold millions of keys."""
    t = Trail(spark, str(tmp_path / "t"), buckets=2)
    t.bootstrap()
    p, a = some_decisions(spark, 50)
    bad = spark.range(9).select(F.lit("r").alias("reason"), F.col("id").cast("string").alias("value"))
    assert decisions.record(t, p, a) == 50 and decisions.refuse(t, bad) == 9
    plans, persist, append = [], type(p).persist, Trail.append
    keep = lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(type(p), "persist", lambda rows, *x: (keep(rows), persist(rows, *x))[1])
    monkeypatch.setattr(Trail, "append", lambda self, table, rows, *x: (keep(rows), append(self, table, rows, *x))[1])
    assert decisions.record(t, p, a) == 0 and decisions.refuse(t, bad) == 0
    joins = [x for plan in plans for x in plan.splitlines() if "LeftAnti" in x]
    assert len(joins) == 2 and all("SortMergeJoin" in x for x in joins)
