import pytest
from pyspark.sql import functions as F

from tests.helpers import same
from tracewell.llm import mixing, queries
from tracewell.llm.shared import Scratch


def test_sql(spark):
    same(queries.op7_mixing(spark, "/root/testdata/sf0.001"), queries.OP7_SQL)


def test_sql_over_more_rows(spark):
    same(queries.op7_mixing(spark, "/root/testdata/sf0.01"), queries.OP7_SQL, "/root/testdata/sf0.01")


def test_margins_are_met(spark):
    """Without a budget by the target shares, with one by the goals that no value's tokens are short of."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for keep in (None, 0.5):
        fit = mixing.raked(mixing.features(docs), Scratch(spark, "t"), keep=keep)
        cells = fit.cells.cache()
        assert fit.residual <= 1e-9 and cells.agg(F.max("probability")).first()[0] <= 1.0
        for d, power in mixing.TEMPER.items():
            rows = cells.groupBy(d).agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("probability")).alias("w")).collect()
            target, total, held = {r[d]: r.t**power for r in rows}, sum(r.t**power for r in rows), sum(r.w for r in rows)
            for r in rows:
                assert r.w / held == pytest.approx(target[r[d]] / total, rel=1e-6)
        if keep:
            assert held == pytest.approx(keep * sum(r.t for r in rows))


def test_slow_sweeps_are_not_their_end(spark):
    """Nearly separate blocks of cells, which sweeps approach by small steps only."""
    cells = [("a", "x", 1000), ("b", "y", 1000), ("a", "y", 1), ("b", "x", 1)]
    rows = spark.createDataFrame([(s, k, "t", n) for s, k, n in cells], "source string, lang string, topic string, n_tokens long")
    targets = {"source": spark.createDataFrame([("a", 0.7), ("b", 0.3)], "source string, weight double"), "lang": spark.createDataFrame([("x", 0.4), ("y", 0.6)], "lang string, weight double")}
    fit = mixing.raked(rows, Scratch(spark, "t"), keep=None, targets=targets)
    assert fit.residual <= 1e-8
    got = fit.cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("w")).collect()
    assert {r.source: r.w / sum(x.w for x in got) for r in got} == pytest.approx({"a": 0.7, "b": 0.3}, abs=1e-7)


def test_goals_that_contradict_are_warned_of(spark):
    rows = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, n_tokens long")
    targets = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, weight double"), "lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "lang string, weight double")}
    with pytest.warns(UserWarning, match="of the tokens"):
        fit = mixing.raked(rows, Scratch(spark, "t"), keep=None, targets=targets)
    assert fit.residual > 0.3


def test_sampled_shares(spark):
    """Tokens taken follow the probabilities, and no probability exceeds 1."""
    rows = mixing.calibrated(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).cache()
    got = rows.agg(F.sum(F.col("probability")).alias("e"), F.sum(F.col("kept").cast("int")).alias("k"), F.max("probability").alias("m"), F.count("*").alias("n")).first()
    assert got.m <= 1.0 and got.n == 10_000 and abs(got.k - got.e) < 4 * got.n**0.5


@pytest.mark.filterwarnings("ignore:.*of the tokens")
def test_one_rare_document_does_not_set_the_rate(spark):
    """A document of a new source and a new language leaves the share of tokens that is kept at ``KEEP`` and the margins met."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stray = docs.limit(1).withColumn("doc_id", F.lit(-1).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit("w " * 60)).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit("xx"))
    fit = mixing.raked(mixing.features(docs.union(stray)), Scratch(spark, "t"))
    cells = fit.cells.cache()
    total, kept, most = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability")), F.max("probability")).first()
    assert most <= 1.0 and kept == pytest.approx(mixing.KEEP * total, rel=0.01) and fit.residual < 0.02
    assert cells.where("lang = 'xx'").first().probability == pytest.approx(1.0)
    out = mixing.calibrated(docs.union(stray)).agg(F.sum("probability").alias("e"), F.count("*").alias("n")).first()
    assert out.n == docs.count() + 1 and out.e > 0.4 * out.n


def test_given_targets(spark):
    """Shares of tokens follow tables of weights, in expectation and in the sample; topics and tokens are columns."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.when(F.col("id") % 7 < 2, "a").otherwise("b").alias("lang"), F.concat(F.lit("t"), F.col("id") % 5).alias("subject"), (F.col("id") % 11 + 1).alias("size"))
    targets = {"source": spark.createDataFrame([("s0", 5.0), ("s1", 5.0), ("gone", 3.0)], "source string, weight double"), "lang": spark.createDataFrame([("a", 1.0), ("b", 1.0)], "lang string, weight double")}
    rows = mixing.calibrated(docs, targets=targets, topic_col="subject", tokens_col="size").cache()
    assert rows.where("source = 's2' AND kept").count() == 0 and rows.agg(F.max("probability")).first()[0] == 1.0
    for d, want in (("source", {"s0": 0.5, "s1": 0.5, "s2": 0.0}), ("lang", {"a": 0.5, "b": 0.5})):
        got = rows.groupBy(d).agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("kept"), F.col("n_tokens")).otherwise(0)).alias("k")).collect()
        e, k = sum(r.e for r in got), sum(r.k for r in got)
        assert {r[d]: r.e / e for r in got} == pytest.approx(want, abs=1e-5) and {r[d]: r.k / k for r in got} == pytest.approx(want, abs=0.03)
    assert mixing.mix(docs, targets=targets, topic_col="subject", tokens_col="size").count() == rows.where("kept").count()


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, lang string, weight string"
    docs = spark.createDataFrame([(1, None, None, None, "x"), (2, "", "s", None, "x"), (3, "a b", "s", "en", "x"), (3, "a b", "s", "en", "x"), (None, "licence", "t", "en", "x"), (5, "a@b " * 9000, "t", "de", "x")], schema)
    got = mixing.calibrated(docs).collect()
    assert len(got) == 6 and all(0 <= r.probability <= 1 for r in got)
    assert {r.topic for r in got if r.doc_id == 5} == {"contact"} and {r.topic for r in got if r.doc_id is None} == {"legal"}
    assert len({(r.probability, r.kept) for r in got if r.doc_id == 3}) == 1
    assert mixing.mix(docs).columns == docs.columns
    kept = sorted(r.doc_id or 0 for r in got if r.kept)
    assert sorted(r.doc_id or 0 for r in mixing.mix(docs).collect()) == kept
    empty = docs.limit(0)
    assert mixing.calibrated(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_no_tokens_at_all(spark):
    docs = spark.createDataFrame([(1, None, "s", "en")], "doc_id long, text string, source string, lang string")
    assert mixing.calibrated(docs).count() == 1


def test_built_in_functions_only(spark):
    plan = queries.op7_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
