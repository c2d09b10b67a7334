import pytest
from pyspark.sql import functions as F

from tests.helpers import same
from tracewell.llm import quality, queries


def test_sql(spark):
    same(queries.op4_line_quality(spark, "/root/testdata/sf0.001"), queries.OP4_SQL)


def test_sql_over_more_rows(spark):
    same(queries.op4_line_quality(spark, "/root/testdata/sf0.01"), queries.OP4_SQL, "/root/testdata/sf0.01")


def brute(text):
    words = (text or "").encode().split()
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    texts = [None, "", " \n\x0b\f\r\t", "a", "a b", "a b c", "a b c a b c", "x x x x x x", "a\n\na\n a\n", "é#ß|< É\u00a0É", "w " * 3000 + "# * $", "a b c d a b c\n" * 50, "\x1c\x85 q\u2003r"]
    docs = spark.createDataFrame([(i, t, "s", "y") for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words string")
    for r in quality.verdicts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


@pytest.fixture(scope="module")
def hosts(spark):
    own = lambda d: " ".join(f"w{d}x{i}" for i in range(60))
    rows = [(d, f"Common  LINE\n{own(d)}", "a") for d in range(30)] + [(d, f"common line\n{own(d)}", "b") for d in range(30, 40)]
    rows += [(40, "common line\n" * 80 + own(40), "a"), (41, own(41), None), (42, None, None)]
    rows += [(d, "copy\n" + own(50), "c") for d in range(50, 90)]  # exact copies
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, at int")


def test_frequent_lines_by_host(hosts):
    got = {r.doc_id: r for r in quality.verdicts(hosts).collect()}
    assert all(got[d].n_removed_words == 2 and got[d].kept for d in range(30))
    assert all(got[d].n_removed_words == 0 and got[d].kept for d in range(30, 40))
    assert got[40].n_removed_words == 160 and got[40].base_failed and not got[40].kept  # it repeats itself as well
    assert got[41].kept and not got[42].kept
    assert all(not got[d].kept and got[d].n_removed_words == 61 for d in range(50, 90))  # every line is in 40 documents
    texts = {r.doc_id: r for r in quality.verdicts(hosts, per="texts").collect()}  # but in one text
    assert all(texts[d].kept and texts[d].n_removed_words == 0 for d in range(50, 90)) and texts[3].n_removed_words == 2


def test_clean(hosts):
    out = quality.clean(hosts, per="texts")
    assert out.columns == hosts.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[3].startswith("w3x0") and got[33].startswith("common line") and 42 not in got and got[60].startswith("copy")


def test_depleted(spark):
    """Of 90 words 50 lie in shared lines for the first 25 documents, 40 for the others: less than half is left, or more."""
    shared = [" ".join(f"s{k}x{i}" for i in range(10)) for k in range(5)]
    rows = [(d, "\n".join([*shared[: 5 if d < 25 else 4], " ".join(f"own{d}x{i}" for i in range(40 if d < 25 else 50))]), "h") for d in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.verdicts(docs, least_docs=24).collect()
    assert all(not r.base_failed and r.n_words == 90 and (r.n_removed_words, r.kept) == ((50, False) if r.doc_id < 25 else (40, True)) for r in got)
    assert sorted(r.doc_id for r in quality.clean(docs, least_docs=24).collect()) == list(range(25, 50))


def test_large_host(spark):
    """Lines in 4 and 2 % of 20,000 texts are boilerplate, one in 0.5 % isn't; a document mostly made of them is depleted."""
    own = F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), F.col("doc_id")) for i in range(60)))
    long = " ".join(f"menu{i}" for i in range(80))
    line = lambda n, x: F.when(F.col("doc_id") % n == 0, F.lit(x + "\n")).otherwise(F.lit(""))
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id").select("doc_id", F.concat(line(25, "share this"), line(50, long), line(200, "rare line"), own).alias("text"), F.lit("big").alias("source"))
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in quality.verdicts(docs).where("doc_id % 25 = 0 OR doc_id < 9").collect()}
    assert got == {d: (82, False) if d % 50 == 0 else (2, True) if d % 25 == 0 else (0, True) for d in got} and len(got) == 808
    assert {r.text[:3] for r in quality.clean(docs).where("doc_id IN (25, 75)").collect()} == {"w0x"}


def test_large_hosts_have_the_rule_of_the_sql(spark, tmp_path):
    """Hosts of 1,200 and 40 documents with lines on both sides of both limits, copies and null texts among them."""
    own = F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), F.col("doc_id")) for i in range(55)))
    line = lambda n, x: F.when(F.col("doc_id") % n == 0, F.lit(x + "\n")).otherwise(F.lit(""))
    text = F.concat(line(21, "In  57"), line(22, "in 54"), line(100, "in 12"), F.when(F.col("doc_id") % 7 == 0, F.lit("copied text " * 3)).otherwise(own))
    docs = spark.range(1240).withColumnRenamed("id", "doc_id").select("doc_id", F.when(F.col("doc_id") % 300 != 1, text).alias("text"), F.when(F.col("doc_id") < 1200, "big").otherwise("small").alias("source"))
    (tmp_path / "sf").mkdir()
    docs.coalesce(1).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    same(queries.op4_line_quality(spark, str(tmp_path / "sf")), queries.OP4_SQL, str(tmp_path / "sf"))
    got = quality.verdicts(docs).agg(F.sum("n_removed_words").alias("n")).first()
    assert got.n > 2 * 57


def test_null_text_is_no_text_of_its_host(spark):
    docs = spark.createDataFrame([(1, "x", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_removed_words for r in quality.verdicts(docs, least_docs=0, spread=0.5).collect()} == {1: 1, 2: 0}


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.verdicts(docs).count() == 0 and quality.clean(docs).count() == 0
    twice = spark.createDataFrame([(1, "x\nq", "s")] * 2 + [(None, "x", "s")], "doc_id long, text string, source string")
    got = quality.verdicts(twice, least_docs=0, spread=0.0).collect()
    assert sorted((r.doc_id or 0, r.n_removed_words) for r in got) == [(0, 1), (1, 2), (1, 2)]


def test_built_in_functions_only(spark):
    plan = queries.op4_line_quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
