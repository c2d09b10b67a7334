"""Every registered query with SQL gives the same rows as its SQL, at two sizes."""

import pytest

from tests.helpers import same
from tracewell import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_small(spark, name):
    same(queries.queries()[name](spark, "/root/testdata/sf0.001"), SQL[name])


def test_all_are_callable():
    assert set(SQL) <= set(queries.queries())


def test_fit_does_not_depend_on_partitions(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tracewell.operators import fit

    rows = queries._decided(spark, "/root/testdata/sf0.01").select(F.col("doc_id").cast("string").alias("subject_id"), "n_chars", "lang", F.col("quality").alias("label"))
    bits = set()
    for n in (1, 3, 7):
        part = rows.repartition(n)
        columns = fit.encoding(part, ("n_chars",), ("lang",))
        w, steps = fit.fit(part.withColumn("x", fit.encoded(columns)))
        bits.add(w.tobytes())
        assert steps < 20 and np.isfinite(w).all()
    assert len(bits) == 1
