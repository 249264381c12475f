"""Price/volume panels in long form: (datetime, instrument, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scrub

FIELDS = ("open", "high", "low", "close", "volume")
def _by_instrument():
    return Window.partitionBy("instrument").orderBy("datetime")



def read_panel(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """A panel file or folder: CSV with a header, Parquet, or (where pandas can read it) HDF5."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "parquet", "h5", "hdf"):
        raise ValueError(f"unsupported panel format: {path}")
    if kind == "csv":
        df = spark.read.csv(path, header=True)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        import pandas as pd

        df = spark.createDataFrame(pd.read_hdf(path).reset_index())
    # rows are numbered in the order of the files, so that the last of repeated keys is the one kept
    return validate_panel(df.withColumn("_row", F.monotonically_increasing_id()), order="_row", require_rows=True) if validate else df


def get_panel(spark: SparkSession, path: str | None = None, **synthetic) -> DataFrame:
    """The panel at ``path``, or a synthetic one."""
    return read_panel(spark, path) if path else synthetic_panel(spark, **synthetic)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed lines are left out."""
    return spark.read.json(path, mode="DROPMALFORMED")


def validate_panel(df: DataFrame, order: str | None = None, require_rows: bool = False) -> DataFrame:
    """A clean panel: keys parsed, the last of repeated keys kept, prices made consistent.

    Last by the column ``order``; without one, the row of the largest values, so the result is the
    same for any order of rows.

    Rows without a key or a close go; a missing open is the last close; a missing or negative volume
    is zero or made positive; high and low enclose open and close.
    """
    missing = [c for c in ("datetime", "instrument", *FIELDS) if c not in df.columns]
    if missing:
        raise ValueError(f"panel lacks columns: {', '.join(missing)}")
    if require_rows and df.isEmpty():
        raise ValueError("panel is empty")
    number = {c: scrub(F.expr(f"try_cast(`{c}` as double)")) for c in FIELDS}
    at = F.col("datetime") if dict(df.dtypes)["datetime"] in ("timestamp", "date", "timestamp_ntz") else F.try_to_timestamp("datetime")
    last = [F.col(order).desc_nulls_last()] if order else [F.col(c).desc_nulls_last() for c in ("close", "volume", "open", "high", "low")]
    key = Window.partitionBy("datetime", "instrument").orderBy(*last)
    clean = df.withColumns({"datetime": at.cast("timestamp"), "instrument": F.col("instrument").cast("string"), **number})
    clean = clean.where("datetime is not null and instrument is not null")
    clean = clean.withColumn("_n", F.row_number().over(key)).where("_n = 1 and close is not null")
    clean = clean.withColumn("open", F.coalesce("open", F.lag("close").over(_by_instrument()), "close"))
    high, low = F.greatest("high", "open", "close"), F.least("low", "open", "close")
    return clean.select("datetime", "instrument", "open", high.alias("high"), low.alias("low"), "close", F.abs(F.coalesce("volume", F.lit(0.0))).alias("volume"))


def synthetic_panel(spark: SparkSession, n_days: int = 252, n_instruments: int = 50, seed: int = 7, start: str = "2020-01-01") -> DataFrame:
    """Business days by instruments S0000.. with geometric random walks; the same seed gives the same panel."""
    days = spark.sql(f"select explode(sequence(timestamp'{start}', timestamp'{start}' + make_interval(0, 0, 0, {n_days * 2 + 7}), interval 1 day)) as datetime")
    days = days.where(F.weekday("datetime") < 5).orderBy("datetime").limit(n_days)
    names = spark.range(n_instruments).select(F.format_string("S%04d", "id").alias("instrument"), "id")
    # normal deviates from hashes of the key: no state, any partitioning

    def uniform(salt: int):
        return (F.pmod(F.xxhash64("instrument", "datetime", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    def normal(salt: int):
        return F.sqrt(-2 * F.ln(uniform(salt))) * F.cos(2 * 3.141592653589793 * uniform(salt + 1))

    panel = days.crossJoin(F.broadcast(names))
    panel = panel.withColumn("close", F.lit(100.0) * F.exp(F.sum(0.0003 + 0.02 * normal(0)).over(_by_instrument())))
    panel = panel.withColumn("open", F.coalesce(F.lag("close").over(_by_instrument()), "close"))
    spread = [F.abs(0.01 * normal(s)) for s in (2, 4)]
    high = F.greatest("open", "close") * (1 + spread[0])
    low = F.least("open", "close") * (1 - F.least(spread[1], F.lit(0.5)))
    return panel.select("datetime", "instrument", "open", high.alias("high"), low.alias("low"), "close", F.exp(13 + 0.5 * normal(6)).alias("volume"))


def supplier_panel(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Unit prices of the suppliers' line items per week or month."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fields = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    key, price = F.struct(*fields), lambda row: F.col(f"{row}l_extendedprice") / F.col(f"{row}l_quantity")
    # a group's first and last item as partial results are wider than its items where a task has few of each group; dealt by instrument, items move once and later windows need no more
    dealt = items.select(F.col("l_suppkey").cast("string").alias("instrument"), *fields).repartition("instrument")
    rows = dealt.groupBy(F.date_trunc(unit, "l_shipdate").alias("datetime"), "instrument").agg(F.min(key).alias("_first"), F.max(price("")).alias("high"), F.min(price("")).alias("low"), F.max(key).alias("_last"), F.sum("l_quantity").alias("volume"))
    return rows.select("datetime", "instrument", price("_first.").alias("open"), "high", "low", price("_last.").alias("close"), "volume")


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values of the users per day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.date_trunc("day", "ts").alias("datetime"), F.col("user_id").cast("string").alias("instrument")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"))
