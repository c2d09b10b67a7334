import random

import pytest

from tests.helpers import same
from tracewell.llm import near_dup, queries
from tracewell.llm.shared import Scratch, released


def brute(texts):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in ids)


def test_sql(spark):
    same(queries.op1_near_dup(spark, "/root/testdata/sf0.001"), queries.OP1_SQL)


def test_brute_force_with_chains_and_edge_cases(spark):
    rng = random.Random(5)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"), (9000, "É é É é É"), (9001, "é é é é é")]
    n = 10
    for _ in range(12):  # chains: each text is a copy of the one before with a few words changed
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 120, 400]))]
        for _ in range(rng.randrange(1, 25)):
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append((n, " ".join(words)))
            n += 1
    rng.shuffle(texts)
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in texts], "doc_id long, text string, component_id string, bucket int")
    got = sorted(tuple(r) for r in near_dup.near_duplicates(docs).collect())
    assert got == brute(texts)


@pytest.mark.parametrize("all_pairs", [0, 1500])
def test_blocks_of_unresolved_buckets(spark, monkeypatch, all_pairs):
    """Whatever the block size, by all pairs or the index, the links found join what all pairs would join."""
    monkeypatch.setattr(near_dup, "ALL_PAIRS", all_pairs)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for d in range(40):
        some = list(words)
        for _ in range(rng.randrange(12)):
            some[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append((d, " ".join(some)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sketch = near_dup.sketches(docs)
    members = spark.createDataFrame([(band, band, d, d) for d in range(40) for band in range(near_dup.BANDS)], "bucket long, band int, doc_id long, label long")
    want = {d: c for d, _, c, _ in brute(texts)}
    for block, most in ((500, 100), (3000, 100), (10**6, 100), (10**6, 9)):
        links = near_dup.unresolved_links(members, sketch, docs, near_dup.least_matches(0.75, 1e-6), 75, block, most).collect()
        up = {d: d for d in range(40)}
        for _ in range(40):
            for a, b in links:
                up[a] = up[b] = min(up[a], up[b])
        assert up == want


def test_bucket_of_many_short_texts(spark):
    """40,000 texts of eight common words and one of their own share a bucket; only the pairs of equal sets are linked."""
    n = 40_000
    texts = [(d, f"one two three four five six seven eight {d % (n - 5)}") for d in range(n)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    sketch = near_dup.sketches(docs).persist()
    members = docs.selectExpr("42L AS bucket", "0 AS band", "doc_id", "doc_id AS label")
    sketch = sketch.selectExpr("doc_id", "n_shingles", "unhex(repeat('01', 16)) || substring(sig, 17, 496) AS sig")
    links = near_dup.unresolved_links(members, sketch, docs, near_dup.least_matches(0.75, 1e-6), 75).collect()
    assert sorted((min(r), max(r)) for r in links) == [(d, d + n - 5) for d in range(5)]


@pytest.mark.parametrize(("label", "alike"), [("id", "id div 4"), ("IF(id % 500 = 0, id, -1L)", "id % 5")])
def test_rows_by_shingle_grow_with_the_members(spark, label, alike):
    """Four times the members of one bucket make four times the rows: four alike, or a fifth of all alike of one label but for a few."""
    counts = []
    for n in (5_000, 20_000):
        docs = spark.range(n).repartition(8).selectExpr("id AS doc_id", f"{label} AS label", f"concat(id % 7, ' one two three four five six seven eight nine ten a ', {alike}, ' b c d e f g') AS text")
        with released():
            rows = near_dup.rare_shingles(docs.select("doc_id", "label"), docs.select("doc_id", "text"), 75, Scratch(spark, "rows"))
            counts.append((rows.count(), near_dup.dealt_by_shingle(rows, most=500).count()))
    (few, sent), (many, most) = counts
    assert 0 < sent and abs(many / few - 4) < 0.1 and most <= 4.4 * sent


def test_members_of_a_large_bucket_meet_by_shingle(spark, monkeypatch):
    """Chains, repeated ids and long texts in buckets beyond the limit: the components of brute force."""
    monkeypatch.setattr(near_dup.unresolved_links, "__defaults__", (3000, 8))
    test_brute_force_with_chains_and_edge_cases(spark)


def test_posterior_limits():
    least = near_dup.least_matches(0.75, 1e-6)
    assert list(least) == list(range(16, 129, 16))
    assert all(least[n] < 0.75 * n for n in least) and least[128] > 64


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near_dup.near_duplicates(docs).count() == 0


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(docs).collect()), key=str) == [(1, 1, 1, True), (2, 1, 1, False), (None, 1, None, True)]


@pytest.mark.parametrize("percent", [50, 90])
def test_other_limits(spark, percent):
    words = [f"w{i}" for i in range(104)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:80]))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, similarity=percent / 100).collect()}
    assert got == {1: 1, 2: 1 if percent == 50 else 2}


def test_one_of_each_tells_rows_apart(spark):
    """A repeated id takes no unrelated text with it, and equal rows are one."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (7, text("c")), (5, text("b")), (None, text("c")), (None, text("d")), (None, None), (9, text("b")), (9, text("e")), (9, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __number string")
    out = near_dup.one_of_each(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(t[:1] for _, t in got if t) == ["a", "b", "c", "d", "e"] and [t for i, t in got if i == 1] == [text("a")] and (7, text("c")) in got
    assert sorted(i or 0 for i, t in got if t is None) == [0, 9]
    unique = docs.where("doc_id IN (1, 7)")
    assert near_dup.one_of_each(unique).count() == 2 and near_dup.one_of_each(docs.limit(0)).count() == 0
