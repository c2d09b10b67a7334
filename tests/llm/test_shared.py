"""Scratch tables: small Arrow batches while they are written, settings restored, tables released."""

import pytest
from pyspark.sql import functions as F

from tracewell.llm.shared import Scratch, released
from tracewell.storage import shared_folder

RECORDS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(df):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return df.mapInArrow(run, "n long")


def test_batches_of_a_scratch_table(spark):
    before = {k: spark.conf.get(k) for k in (RECORDS, BYTES)}
    rows = spark.range(30_000).coalesce(1).withColumn("x", F.repeat(F.lit("x"), 10))
    assert max(r.n for r in Scratch(spark, "t").table(sizes(rows)).collect()) == 2000
    wide = spark.range(300).coalesce(1).withColumn("x", F.repeat(F.lit("x"), 1 << 20))
    assert max(r.n for r in Scratch(spark, "t").table(sizes(wide)).collect()) < 10
    assert {k: spark.conf.get(k) for k in before} == before
    spark.conf.set(RECORDS, "7")
    spark.conf.set(BYTES, "1m")
    try:
        assert max(r.n for r in Scratch(spark, "t").table(sizes(rows.limit(50))).collect()) == 7
        with pytest.raises(Exception, match="boom"):
            Scratch(spark, "t").table(rows.select(F.raise_error(F.lit("boom")).alias("x")))
        assert (spark.conf.get(RECORDS), spark.conf.get(BYTES)) == ("7", "1m")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_released(spark):
    with released():
        t = Scratch(spark, "t").table(spark.range(3))
        assert t.count() == 3
    fs = spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


def test_shared_folder(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) and spark.conf.get("spark.checkpoint.dir", None) == before
