import pytest

from tracewell.llm import queries, token_counts


def brute(lengths):
    out = []
    for limit in sorted(set(lengths)):
        under = [n for n in lengths if n <= limit]
        over = [n for n in lengths if n > limit]
        out.append((limit, lengths.count(limit), len(under), sum(under), len(over), sum(over), sum(min(n, limit) for n in lengths), len(under) / len(lengths), sum(lengths)))
    return out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_sums(spark, block):
    lengths = [0, 0, 1, 5, 5, 5, 7, 100, 4095, 4096, 9000]
    hist = token_counts.length_histogram(spark.createDataFrame([(n,) for n in lengths], "length long"))
    assert [tuple(r) for r in token_counts.limits(hist, block).orderBy("length").collect()] == brute(lengths)


def test_any_limit_and_quantile(spark):
    lengths = [0, 0, 1, 5, 5, 5, 7, 100, 4095, 4096, 9000]
    hist = token_counts.length_histogram(spark.createDataFrame([(n,) for n in lengths], "length long"))
    asked = [0, 3, 5, 6, 4096, 10**6]
    want = [(x, sum(n <= x for n in lengths), sum(n for n in lengths if n <= x), sum(n > x for n in lengths), sum(n for n in lengths if n > x), sum(min(n, x) for n in lengths), sum(n <= x for n in lengths) / 11) for x in asked]
    assert [tuple(r) for r in token_counts.at_limits(hist, asked).orderBy("context_limit").collect()] == want
    got = {r.quantile: r.length for r in token_counts.lengths_at(hist, [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    assert got == {0.0: 0, 0.1: 0, 0.5: 5, 0.9: 4096, 1.0: 9000}
    assert [r.docs_over for r in token_counts.at_limits(hist.limit(0), [4]).collect()] == [0]


def test_query(spark):
    encode = token_counts._encoding(token_counts.vocabulary()).encode_ordinary
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = [tuple(r) for r in queries.op8_token_counts(spark, "/root/testdata/sf0.001").orderBy("length").collect()]
    assert got == brute([len(encode(d.text or "")) for d in docs])


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, 1), ("", 1), ("<|endoftext|>", 1), ("x" * 300_000, 1)], "text string, length int")
    assert sum(r.length == 0 for r in token_counts.encoded_lengths(docs).collect()) == 2
    assert token_counts.limits(token_counts.length_histogram(token_counts.encoded_lengths(docs.limit(0)))).count() == 0
