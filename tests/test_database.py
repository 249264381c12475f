"""Database tables, with the database that comes with Spark."""

import pytest
from pyspark.sql import functions as F

from factorloom.sources import jdbc


@pytest.fixture
def url(spark, tmp_path):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    return f"jdbc:derby:{tmp_path}/db;create=true"


def test_reads_by_ranges(spark, url):
    rows = spark.range(1000).select(F.col("id").alias("iteration"), (F.col("id") % 7).alias("thread"), F.concat(F.lit("a"), "id").alias("alpha_id"))
    jdbc.append(rows, url, "alphas")
    one, many = jdbc.read_table(spark, url, "alphas"), jdbc.read_table(spark, url, "alphas", partition_by="iteration", partitions=5, order="none")
    assert many.rdd.getNumPartitions() == 5 and sorted(map(tuple, many.collect())) == [tuple(r) for r in one.collect()]
    some = jdbc.read_table(spark, url, "alphas", {"thread": 3}, partition_by="iteration")
    assert [r.iteration for r in some.collect()] == list(range(3, 1000, 7))
    assert "EqualTo(thread,3)" in some._jdf.queryExecution().executedPlan().toString()
    jdbc.append(rows.where("iteration = 4"), url, "hypotheses")
    assert jdbc.read_table(spark, url, "hypotheses", partition_by="iteration").count() == 1
    jdbc.append(rows.limit(0), url, "backtest_results")
    assert jdbc.read_table(spark, url, "backtest_results", partition_by="iteration").count() == 0
    for bad in ({"table": "users"}, {"table": "alphas", "partition_by": 'x"; drop'}):
        with pytest.raises(ValueError):
            jdbc.read_table(spark, url, **bad)


def test_upserts(spark, url):
    schema = "id long, ir double, name string"
    jdbc.append(spark.createDataFrame([(1, 0.5, "a"), (2, 0.6, "b")], schema), url, "backtest_results")
    new = spark.createDataFrame([(2, 9.0, None), (3, None, "c"), (3, None, "c")], schema)
    for _ in range(2):  # again: the same
        jdbc.upsert(new, url, "backtest_results")
        got = sorted(map(tuple, jdbc.read_table(spark, url, "backtest_results").collect()))
        assert got == [(1, 0.5, "a"), (2, 9.0, None), (3, None, "c")]
    with pytest.raises(Exception, match="(?i)column|type"):
        jdbc.upsert(new.withColumn("other", F.lit(1)), url, "backtest_results")
    tables = spark.read.format("jdbc").options(url=url, dbtable="(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T') x").load()
    assert [r[0] for r in tables.collect()] == ["BACKTEST_RESULTS"]  # the tables that tasks wrote to are gone
