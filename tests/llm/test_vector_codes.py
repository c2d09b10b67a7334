import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.helpers import same
from tracewell.llm import queries, vector_codes
from tracewell.llm.vector_codes import Tree, nearest


def test_query_is_its_sql(spark):
    same(queries.op12_vector_codes(spark, "/root/testdata/sf0.01"), queries.OP12_SQL, "/root/testdata/sf0.01")


def brute_entries(x, books):
    """Index of the nearest entry of each (position, point), the lower one on ties."""
    return ((x[:, :, None, :] - books[:, None, :, :]) ** 2).sum(-1).argmin(2)


def all_of(x, books, leaf):
    tree = Tree(x, leaf)
    got, seen = np.full(x.shape[:2], -1), np.zeros(x.shape[:2], int)
    whole = 0
    for pos, first, end, entry in nearest(tree, books):
        for p, s, e, k in zip(pos, first, end, entry):
            got[p, tree.order[p, s:e]] = k
            seen[p, s:e] += 1
            whole += e - s > 1
    assert (seen == 1).all()
    return got, whole


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 90), st.integers(1, 20), st.integers(1, 4), st.integers(1, 3), st.integers(2, 9), st.sampled_from([1, 3, 40, 2**29]), st.integers(0, 10**6))
def test_every_part_goes_to_its_nearest_entry(n, entries, width, positions, leaf, spread, seed):
    rng = np.random.default_rng(seed)
    x, books = rng.integers(-spread, spread + 1, (positions, n, width)), rng.integers(-spread, spread + 1, (positions, entries, width))
    assert (all_of(x, books, leaf)[0] == brute_entries(x, books)).all()


def test_nodes_are_assigned_whole():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-20, 20, (2, 500, 4)) + c for c in (0, 1000, -1000)], axis=1)
    books = np.array([[[0] * 4, [1000] * 4, [-1000] * 4]] * 2)
    got, whole = all_of(x, books, 16)
    assert (got == brute_entries(x, books)).all() and whole < 40  # a few large nodes, no leaf compared


def brute(rows, parts, entries, rounds, scale=256):
    """{(id, place): (code, error)} and digest by comparing everything with everything."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(1, -(-max((len(v) for _, v in kept), default=0) // parts))
    x = np.array([[int(np.floor(scale * float(c))) for c in v] + [0] * (parts * width - len(v)) for _, v in kept], np.int64).reshape(len(kept), parts, width).transpose(1, 0, 2)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, x[:, k].ravel().tolist()))[:entries]
    books = x[:, first].copy()
    for _ in range(rounds):
        at = brute_entries(x, books)
        books = np.array([[x[p, at[p] == e].sum(0) // max((at[p] == e).sum(), 1) if (at[p] == e).any() else books[p, e] for e in range(len(first))] for p in range(parts)])
    at = brute_entries(x, books)
    error = ((x - books[np.arange(parts)[:, None], at]) ** 2).sum((0, 2))
    return sorted(((i, "".join(f"{c:02x}" for c in at[:, k]), int(error[k])) for k, (i, _) in enumerate(kept)), key=repr), hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


CASES = {
    "ties and copies": [(i, [float(i % 3), 0.5, -1.25, 2.0]) for i in range(40)] + [(7, [9.0, 9.0, 9.0, 9.0])] * 30,
    "bad rows": [(1, None), (2, [1.0, None, 1.0, 1.0]), (3, [1.0, float("nan"), 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0, 0.0]), (5, [float("-inf")] * 4), (6, [0.001, -0.001, 0.0, 1.0]), (None, [3.0, 3.0, 3.0, 3.0])],
    "other lengths": [(1, [1.0, 2.0, 3.0]), (2, []), (3, [5.0, -5.0, 1.0, 1.0, 7.0])],
    "one row": [(1, [0.5] * 4)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, name):
    rows = [(i, v, None if i == 5 else 3) for i, v in CASES[name]]
    df = spark.createDataFrame([(i, v, k, "x") for i, v, k in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    codes, books = vector_codes.compressed(df, parts=2, entries=5)
    want, digest = brute(CASES[name], 2, 5, 2)
    assert sorted(((r.id, r.code, r.error) for r in codes.collect()), key=repr) == want
    assert vector_codes.codebooks_digest(books) == digest


def test_labels_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    codes, _ = vector_codes.compressed(spark.createDataFrame([(1, [0.0] * 4, None), (2, [9.0] * 4, None), (3, [4.0] * 4, 1)], schema), parts=2, entries=1)
    got = {r.id: (r.error, r.label_error) for r in vector_codes.with_label_error(codes).collect()}
    assert got[1][1] == got[2][1] == got[1][0] + got[2][0] and got[3][0] == got[3][1]
    codes, books = vector_codes.compressed(spark.createDataFrame([], schema))
    assert codes.count() == 0 and books.size == 0


def test_blocks_do_not_matter(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=32).tolist(), i % 4) for i in range(300)], "vec_id long, embedding array<float>, label int")
    rows = vector_codes.quantised(df)
    first = vector_codes.first_codebooks(rows)
    out = set()
    for n, size in ((1, 300), (4, 64), (7, 17)):
        blocks = vector_codes.planted(rows.repartition(n), block_rows=size)
        books = vector_codes.learn(blocks, first)
        out.add((vector_codes.codebooks_digest(books), tuple(sorted(map(tuple, vector_codes.encode(blocks, books).collect())))))
    assert len(out) == 1
