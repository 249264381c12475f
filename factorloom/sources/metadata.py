"""Sectors, shortability and borrow rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Flag columns of shortability, values that count as yes, names of date and rate columns.
FLAGS = ("shortable", "borrowable", "is_shortable", "is_borrowable")
YES = ("1", "true", "t", "yes", "y")
DATES = ("datetime", "date", "dt")
RATES = ("borrow_bps", "borrow_rate_bps", "rate_bps")


def _read(source, spark: SparkSession | None = None) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    return spark.read.parquet(source) if str(source).endswith(".parquet") else spark.read.csv(source, header=True)


def sector_map(source, spark: SparkSession | None = None, order: str | None = None) -> DataFrame:
    """(instrument, sector), trimmed; the last of an instrument's rows (by ``order``) wins; blank names go."""
    df = _read(source, spark).select(F.trim(F.col("instrument").cast("string")).alias("instrument"), F.trim(F.col("sector").cast("string")).alias("sector"), F.col(order).alias("_o") if order else F.monotonically_increasing_id().alias("_o"))
    return df.where("instrument <> ''").groupBy("instrument").agg(F.max_by("sector", "_o").alias("sector"))


def hard_to_borrow(source, spark: SparkSession | None = None) -> DataFrame:
    """(instrument) that can't be sold short: a flag that isn't yes, or, without a flag column, all that are listed."""
    df = _read(source, spark)
    flag = next((c for c in FLAGS if c in df.columns), None)
    if flag:
        df = df.where(~F.coalesce(F.lower(F.trim(F.col(flag).cast("string"))).isin(*YES), F.lit(False)))
    return df.select(F.trim(F.col("instrument").cast("string")).alias("instrument")).where("instrument <> ''").distinct()


def borrow_rates(source, spark: SparkSession | None = None) -> DataFrame:
    """(datetime, instrument, borrow_bps), annual; rows with a missing part go."""
    df = _read(source, spark)
    date, rate = (next((c for c in names if c in df.columns), None) for names in (DATES, RATES))
    if date is None or rate is None or "instrument" not in df.columns:
        raise ValueError("borrow rates need a date, an instrument and a rate column")
    at = F.col(date) if dict(df.dtypes)[date] in ("timestamp", "date") else F.try_to_timestamp(date)
    out = df.select(at.cast("timestamp").alias("datetime"), F.col("instrument").cast("string").alias("instrument"), F.expr(f"try_cast(`{rate}` as double)").alias("borrow_bps"))
    return out.dropna()


def fill_borrow_rates(rates: DataFrame) -> DataFrame:
    """Rates on the file's own dates, each instrument's last known one carried forward; other dates have none."""
    days, names = rates.select("datetime").distinct(), rates.select("instrument").distinct()
    last = F.last("borrow_bps", ignorenulls=True).over(Window.partitionBy("instrument").orderBy("datetime"))
    grid = days.crossJoin(names)  # a calendar by the universe: the dense form of the file itself
    return grid.join(rates, ["datetime", "instrument"], "left").select("datetime", "instrument", last.alias("borrow_bps")).dropna()
