import random

import numpy as np
import pytest

from tests.helpers import same
from tracewell.llm import queries, substring_dup


def brute(texts):
    words = {d: (t or "").encode().split() for d, t in texts}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    out = []
    for d, w in sorted(words.items()):
        lost = {i + k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for k in range(50)}
        out.append((d, len(w), len(lost), b" ".join(x for i, x in enumerate(w) if i not in lost).decode()))
    return out


def test_sql(spark):
    same(queries.op9_substring_dup(spark, "/root/testdata/sf0.001"), queries.OP9_SQL)


def case(seed, n=120):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(3)}" for _ in range(rng.choice([50, 60, 130]))] for _ in range(4)] + [["same"] * 90]
    texts = [(0, None), (1, ""), (2, "short text")]
    for d in range(3, n):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80))]
            p = rng.choice(passages)
            words += p[rng.randrange(3) :] if rng.random() < 0.8 else p[:49]
        texts.append((d, rng.choice([" ", "\n", "\t "]).join(words)))
    return texts


def run(spark, texts):
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, spans string").repartition(5)
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dup.remove_repeats(docs).collect())


def test_brute_force(spark):
    for seed in (1, 2):
        assert run(spark, case(seed)) == brute(case(seed))


def test_hot_windows(spark, monkeypatch):
    """With the limit at 3 nearly all repeated windows take the salted rounds."""
    monkeypatch.setattr(substring_dup, "HOT", 3)
    assert run(spark, case(3)) == brute(case(3))


def test_no_window_is_lost_by_the_sketch():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 40, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h[100:900] = h[1500:2300]
    h[950:1100] = h[950]
    grams, keys, valid = substring_dup.sketched(h, [3000])
    assert valid.all()
    counted = substring_dup.positions_counted(grams, keys, valid)
    windows, n = np.unique(np.lib.stride_tricks.sliding_window_view(h, 50), axis=0, return_inverse=True)[1], {}
    for w in windows:
        n[w] = n.get(w, 0) + 1
    assert len(keys) == len(windows)
    assert all((counted == k).sum() >= n[w] for k, w in zip(keys, windows, strict=True))


def test_run_hashes():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 3, 4000).astype(np.uint64)
    for width in (1, 8, 50):
        got = substring_dup.run_hashes(h, width)
        runs = [h[i : i + width].tobytes() for i in range(len(h) - width + 1)]
        assert len(got) == len(runs) and len(set(zip(got.tolist(), runs))) == len(set(runs)) == len(set(got.tolist()))
    assert not len(substring_dup.run_hashes(h[:49], 50))


def test_joined_sketch(spark):
    """With nothing broadcast the repeated keys come back by joins; rows are the same."""
    scratch, texts = substring_dup.Scratch(spark, "test"), case(4)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    sent, joined = (sorted(map(tuple, substring_dup.repeated_spans(docs, scratch, sent_bytes=n)[0].collect())) for n in (1 << 30, 0))
    assert joined == sent and len(sent) > 50


def test_joined_hot_windows(spark, monkeypatch):
    monkeypatch.setattr(substring_dup, "HOT", 3)
    monkeypatch.setattr(substring_dup, "SENT_BYTES", 0)
    assert run(spark, case(5)) == brute(case(5))


@pytest.mark.parametrize("hot", [2, 1000])
def test_repeated_and_missing_ids(spark, monkeypatch, hot):
    """Each row loses what its own text repeats; rows without id take no part."""
    monkeypatch.setattr(substring_dup, "HOT", hot)
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b), (2, a), (3, b + " " + c), (None, c), (None, c), (4, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in substring_dup.remove_repeats(docs).collect())
    assert got == sorted([(1, a, 0), (2, a, 60), (2, a, 60), (2, b, 0), (2, b, 0), (3, b + " " + c, 60), (0, c, 0), (0, c, 0), (4, c, 60)])


def test_bytes_that_are_no_utf8(spark):
    docs = spark.createDataFrame([(1, b"x\xff " * 60), (2, b"x\xff " * 60)], "doc_id long, b binary").selectExpr("doc_id", "CAST(b AS STRING) AS text")
    got = substring_dup.remove_repeats(docs).selectExpr("doc_id", "n_removed", "hex(kept_text) AS h").orderBy("doc_id").collect()
    assert [(r.n_removed, r.h) for r in got] == [(0, (b"x\xff " * 60).strip().hex().upper()), (60, "")]


def test_empty_table_and_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_words int, row int, spans int, cut int, t int")
    out = substring_dup.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "row", "spans", "cut", "t", "n_words", "n_removed", "kept_text"] and out.count() == 0
