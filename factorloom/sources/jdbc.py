"""Domain tables (hypotheses, alphas, backtest results) in a database, through Spark's JDBC source.

A driver for the database must be on Spark's class path.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("hypotheses", "alphas", "backtest_results")


def _known(table: str) -> str:
    if table not in TABLES:
        raise ValueError(f"unknown table: {table}")
    return table


def _column(name: str) -> str:
    """A quoted column name."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a column name: {name}")
    return f'"{name}"'


def read_table(spark: SparkSession, url: str, table: str, filters: dict | None = None, order: str = "iteration", partition_by: str | None = None, partitions: int = 16, **options) -> DataFrame:
    """Rows that equal ``filters`` (pushed down), in order.

    ``partition_by``: a number, date or timestamp by whose ranges the table is read in ``partitions``
    queries side by side; the database gives its bounds.  Rows without it are in the first one, and a
    table without any value is read at once.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if partition_by:
        c = _column(partition_by)
        low, high = reader.option("dbtable", f'(SELECT MIN({c}) AS "low", MAX({c}) AS "high" FROM {_known(table)}) bounds').load().first()
        if low is not None and low != high:
            reader = reader.options(partitionColumn=partition_by, lowerBound=str(low), upperBound=str(high), numPartitions=partitions)
    df = reader.option("dbtable", _known(table)).load()
    for k, v in (filters or {}).items():
        df = df.where(F.col(k) == v)
    return df.orderBy(order) if order in df.columns else df


def append(df: DataFrame, url: str, table: str, **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=_known(table), **options).mode("append").save()


def upsert(df: DataFrame, url: str, table: str, key: str = "id", **options) -> None:
    """Rows of new keys are added, those of known keys replaced, all or none of them; of rows of one key one is taken.

    Tasks write to a table of their own, which the database merges in one transaction.
    """
    target, stage = _known(table), f"{table}_{uuid.uuid4().hex[:12]}"
    rest = [_column(c) for c in df.columns if c != key]
    k, columns = _column(key), [_column(c) for c in df.columns]
    update = "WHEN MATCHED THEN UPDATE SET " + ", ".join(f"{c} = s.{c}" for c in rest) if rest else ""
    merge = f"MERGE INTO {target} AS t USING {stage} AS s ON t.{k} = s.{k} {update} WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join('s.' + c for c in columns)})"
    try:
        df.dropDuplicates([key]).write.format("jdbc").options(url=url, dbtable=stage, **options).mode("errorifexists").save()
        _execute(df.sparkSession, url, merge, **options)
    finally:
        _execute(df.sparkSession, url, f"DROP TABLE {stage}", missing_is_fine=True, **options)


def _execute(spark: SparkSession, url: str, statement: str, missing_is_fine: bool = False, **options) -> None:
    """One statement in a transaction of its own."""
    from py4j.protocol import Py4JJavaError

    jvm = spark.sparkContext._jvm
    if options.get("driver"):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    settings = jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in options:
            settings.setProperty(name, options[name])
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        connection.createStatement().execute(statement)
        connection.commit()
    except Py4JJavaError:
        connection.rollback()
        if not missing_is_fine:
            raise
    finally:
        connection.close()


def thread_history(hypotheses: DataFrame, alphas: DataFrame, results: DataFrame) -> DataFrame:
    """Each hypothesis with its alphas, and each alpha with its results: two joins of grouped rows."""
    r = results.groupBy("alpha_id").agg(F.collect_list(F.struct(*results.columns)).alias("results"))
    a = alphas.join(r, "alpha_id", "left").groupBy("hypothesis_id").agg(F.collect_list(F.struct(*alphas.columns, "results")).alias("alphas"))
    return hypotheses.join(a, "hypothesis_id", "left")
