from pyspark.sql import functions as F

from fieldmark.operators.prefix import sums_before


def test_sums_before(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 13).alias("n"), F.lit(1).alias("one"))
    got = {r["k"]: (r["n_before"], r["one_before"]) for r in sums_before(df, "k", "n", "one").collect()}
    run = 0
    for i, r in enumerate(sorted(df.collect(), key=lambda r: r["k"])):
        assert got[r["k"]] == (run, i)
        run += r["n"]


def test_sums_before_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 5), (1, 2), (1, 2), (3, 1)], "k long, n long")
    assert sorted((r["k"] or 0, r["n_before"]) for r in sums_before(df, "k", "n").collect()) == [(0, 0), (1, 5), (1, 7), (3, 9)]
    assert sums_before(df.limit(0), "k", "n").count() == 0
