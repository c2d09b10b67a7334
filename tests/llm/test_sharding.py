import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.helpers import same
from tracewell.llm import queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_query_is_its_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        same(queries.op11_sharding(spark, f"/root/testdata/{sf}"), queries.OP11_SQL, f"/root/testdata/{sf}")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute(docs, shards):
    """(doc_id, size, crc, shard, slot) by sorting everything at once."""
    by, rows = defaultdict(list), []
    for i, text, _, source, _ in docs:
        by[source].append((md5(f"{sharding.SEED}:{'' if i is None else i}:{md5(text or '')}"), (i is not None, i), len((text or "").encode()) + 1, zlib.crc32((text or "").encode()), i))
    for source, own in by.items():
        u = int(md5(f"{sharding.SEED}:" + ("" if source is None else f"={source}"))[:13], 16) / 2**52
        rows += [((r + u) / len(own), (source is not None, source or ""), r, *x) for r, x in enumerate(sorted(own))]
    out, seen = [], Counter()
    for place, x in enumerate(sorted(rows)):
        shard = place * shards // len(rows)
        out.append((x[-1], x[5], x[6], shard, seen[shard]))
        seen[shard] += 1
    return out


@pytest.mark.parametrize(("shards", "range_rows"), [(1, 7), (4, 7), (16, 4096)])
def test_against_brute_force(spark, shards, range_rows):
    docs = [(i, f"text {i}", "en", f"s{i % 3 if i % 2 else 0}", 1) for i in range(200)]
    docs += [(7, "again", "en", "s0", 1)] * 300  # a group of copies
    docs += [(None, None, None, None, None), (None, "", "en", "", 0), (900, "é" * 30_000, "fr", "one", 1), (901, "é", "fr", "two", 1)]
    rows = sharding.digests(spark.createDataFrame(docs, SCHEMA).repartition(5))
    got = sharding.interleaved(rows, shards, range_rows=range_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got.collect()) == Counter(brute(docs, shards))


def test_shares_and_lone_sources(spark):
    docs = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("s"), F.col("id") % 8)).otherwise(F.concat(F.lit("lone"), "id")).alias("source"), F.md5(F.col("id").cast("string")).alias("key"))
    got = sharding.interleaved(docs, range_rows=100).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.count_if(F.col("source") == "hot").alias("hot"), F.count_if(F.col("source").startswith("lone")).alias("lone")).collect()
    assert len(got) == 16 and {r.n for r in got} == {250} == {r.slots for r in got} == {r["last"] + 1 for r in got}
    assert max(r.hot for r in got) - min(r.hot for r in got) <= 20  # the lone sources' offsets are random
    assert all(60 < r.lone < 110 for r in got)  # they don't meet in one shard
    few = sharding.interleaved(docs.where("source NOT LIKE 'lone%'"), range_rows=100).groupBy("source", "shard").count().groupBy("source").agg(F.count("*").alias("shards"), F.max("count") - F.min("count")).collect()
    assert all(r.shards == 16 and r[2] <= 3 for r in few)


def test_other_columns_and_empty(spark):
    rows = spark.createDataFrame([(1, "a", 5, "x"), (2, None, 6, None)], "doc_id long, source string, shard int, __rank string").withColumn("key", F.md5(F.col("doc_id").cast("string")))
    got = sharding.interleaved(rows)
    assert got.columns == ["doc_id", "source", "__rank", "key", "shard", "slot"] and sorted(r.shard for r in got.collect()) == [0, 8]
    assert sharding.interleaved(sharding.digests(spark.createDataFrame([], SCHEMA))).count() == 0


def test_written_shards(spark, tmp_path):
    docs = [(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(50)] + [(1, "copy", None, None, 1)] * 20
    df = spark.createDataFrame(docs, SCHEMA).withColumn("__row", F.lit("extra"))
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select(*df.columns).collect())) == Counter((*d, "extra") for d in docs)
    by = defaultdict(list)
    for r in back.collect():
        by[r.shard].append(r.slot)
    assert {k: sorted(v) for k, v in by.items()} == {0: list(range(18)), 1: list(range(17)), 2: list(range(18)), 3: list(range(17))}
