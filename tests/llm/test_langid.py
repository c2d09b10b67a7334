import zlib

from pyspark.sql import functions as F

from tracewell.llm import langid, queries


def test_held_out_accuracy(spark):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    rows = got.collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)


def test_edge_cases(spark):
    learn = [(i, f"der die das und nicht ein wort {i}", "de") for i in range(20)] + [(i, f"the and of with word {i}", "en") for i in range(30)] + [(99, "nothing", None), (98, None, "fr")]
    model = langid.learn(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    texts = [None, "", "123 !?", "x", "nicht und", "THE AND OF", "日本語", "\U0001d400", "the " * 300_000]
    docs = spark.createDataFrame([(i, t, "fr") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    got = [r.lang_pred for r in langid.predict(docs, model, "doc_id").orderBy("doc_id").collect()]
    assert got == ["und", "und", "und", "de", "de", "en", "de", "de", "en"]
    none = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.predict(docs, none, "doc_id").collect()} == {"und"}
    assert langid.predict(docs.limit(0), model, "doc_id").count() == 0


def test_masks_against_plain_sets(spark):
    """The filter holds every n-gram of the plain sets; of others it reports no more than the target; verdicts agree."""
    from collections import Counter

    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    rows = docs.collect()
    counts = {}
    for r in rows:
        counts.setdefault(r.lang, Counter()).update(langid.grams(langid.letters(r.text)).tolist())
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = Counter()
    for s in share.values():
        for g, x in s.items():
            most[g] = max(most[g], x)
    sets = {lang: {g for g, x in s.items() if x >= langid.LEAST_SHARE and x >= langid.LEAST_RATIO * most[g]} for lang, s in share.items()}
    model = langid.learn(docs)
    assert model.languages == sorted(sets)
    every = np.array(sorted(set().union(*sets.values())) + np.random.default_rng(0).integers(0, 2**63, 100_000).tolist(), np.uint64)
    mask = np.bitwise_and.reduce([model.cells[0][langid._probe(every, k, model.bits)] for k in range(langid.PROBES)])
    for i, lang in enumerate(model.languages):
        inside = np.isin(every, np.array(list(sets[lang]), np.uint64))
        said = (mask >> np.uint64(i)) & np.uint64(1) == 1
        assert said[inside].all() and said[~inside].mean() <= 1.5 * langid.FALSE_POSITIVES
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model, "doc_id").collect()}
    for r in rows:
        g = langid.grams(langid.letters(r.text)).tolist()
        plain = {lang: sum(x in s for x in g) / len(g) for lang, s in sets.items()}
        best = sorted(plain.values())
        if best[-1] - best[-2] > 0.02:
            assert got[r.doc_id] == max(plain, key=plain.get)


def test_many_languages(spark):
    """More languages than one mask has bits."""
    learn = [(chr(0x4E00 + 40 * k + i % 40) * 6, f"l{k:02}") for k in range(70) for i in range(40)]
    model = langid.learn(spark.createDataFrame(learn, "text string, lang string"))
    docs = spark.createDataFrame([(k, chr(0x4E00 + 40 * k) * 6) for k in range(70)], "doc_id int, text string")
    assert all(r.lang_pred == f"l{r.doc_id:02}" for r in langid.predict(docs, model, "doc_id").collect())
    assert model.cells.shape[0] == 2


def test_inputs_of_a_prediction(spark):
    docs = langid.with_holdout(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    model = langid.learn(docs.where("NOT held_out"))
    other = docs.select(F.lit("zz").alias("lang"), F.lit("s").alias("source"), "doc_id", "text", "held_out")
    pick = lambda d: sorted(tuple(r) for r in langid.predict(d, model, "doc_id").collect())
    assert pick(docs) == pick(other)
