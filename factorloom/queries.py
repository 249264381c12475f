"""The registered queries and, where SQL can express them, their oracle SQL.

Results are rounded on both sides (value hashes are compared bit for bit); missing values are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans, sources
from .functions import rounded
from .operators import evaluation as ev

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def panel_sql(unit: str = "week", name: str = "panel") -> str:
    return f"""{name} AS (SELECT date_trunc('{unit}', l_shipdate)::TIMESTAMP AS datetime, l_suppkey::VARCHAR AS instrument,
 arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(l_quantity) AS volume
 FROM (SELECT *, l_extendedprice / l_quantity AS p, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem) GROUP BY 1, 2)"""


SECTOR_SQL = "sectors AS (SELECT s_suppkey::VARCHAR AS instrument, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def r(sql: str, digits: int = 6) -> str:
    """Rounded like ``functions.rounded``."""
    return f"floor(({sql}) * 1e{digits} + 0.4987) / 1e{digits}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").cast("string").alias("instrument"), F.col("r_name").alias("sector"))


def sector_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel with each supplier's region as its sector."""
    return sources.supplier_panel(spark, sf_dir).join(sectors(spark, sf_dir), "instrument", "left").withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")))


def _factor(text: str):
    def run(spark, sf_dir):
        panel = sector_panel(spark, sf_dir) if "sector" in text else sources.supplier_panel(spark, sf_dir)
        out = plans.eval_factor(panel, text)
        return out.select("datetime", "instrument", rounded(F.col("value").cast("double")).alias("value"))

    return run


_T = "PARTITION BY instrument ORDER BY datetime"


def _w(k: int) -> str:
    return f"({_T} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _full(expr: str, k: int, x: str = "close") -> str:
    return f"CASE WHEN count({x}) OVER {_w(k)} = {k} THEN {expr} END"


_MEAN, _SD = f"avg(close) OVER {_w(5)}", f"stddev_pop(close) OVER {_w(5)}"
_D = "(PARTITION BY datetime)"
_L = f"list(close) OVER {_w(5)}"
_RET = f"close / lag(close, 1) OVER ({_T}) - 1"
_EWM = """, n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime) AS i FROM panel),
 e AS (SELECT instrument, datetime, i, close AS m, 0.0::DOUBLE AS v FROM n WHERE i = 1
 UNION ALL SELECT n.instrument, n.datetime, n.i, (1 - 2.0/6) * e.m + 2.0/6 * n.close, (1 - 2.0/6) * (e.v + 2.0/6 * (n.close - e.m) * (n.close - e.m)) FROM e JOIN n ON n.instrument = e.instrument AND n.i = e.i + 1)"""

#: name: (factor, SQL of its value over panel p). ``close`` and the others are never missing in these panels.
FACTORS = {
    "delay": ("delay(close, 2)", f"lag(close, 2) OVER ({_T})"),
    "returns": ("returns(close, 1)", _RET),
    "ts_delta": ("ts_delta(close, 3)", f"close - lag(close, 3) OVER ({_T})"),
    "ts_mean": ("ts_mean(close, 5)", _full(_MEAN, 5)),
    "sma": ("sma(close, 5)", _full(_MEAN, 5)),
    "ts_sum": ("ts_sum(volume, 5)", _full(f"sum(volume) OVER {_w(5)}", 5)),
    "ts_std": ("ts_std(close, 5)", _full(_SD, 5)),
    "ts_zscore": ("ts_zscore(close, 5)", _full(f"(close - {_MEAN}) / nullif({_SD}, 0)", 5)),
    "rel_volume": ("rel_volume(volume, 5)", _full(f"volume / (abs(avg(volume) OVER {_w(5)}) + 1e-12)", 5)),
    "ts_min": ("ts_min(close, 5)", _full(f"min(close) OVER {_w(5)}", 5)),
    "ts_max": ("ts_max(close, 5)", _full(f"max(close) OVER {_w(5)}", 5)),
    "ts_rank": ("ts_rank(close, 5)", _full(f"(len(list_filter({_L}, lambda v: v < close)) + (len(list_filter({_L}, lambda v: v = close)) + 1) / 2.0) / 5", 5)),
    "ts_corr": ("ts_corr(close, volume, 5)", _full(f"covar_pop(close, volume) OVER {_w(5)} / nullif({_SD} * stddev_pop(volume) OVER {_w(5)}, 0)", 5)),
    "ts_argmax": ("ts_argmax(close, 5)", _full(f"list_position({_L}, max(close) OVER {_w(5)}) - 1.0", 5)),
    "ts_argmin": ("ts_argmin(close, 5)", _full(f"list_position({_L}, min(close) OVER {_w(5)}) - 1.0", 5)),
    "ts_decay_linear": ("ts_decay_linear(close, 3)", _full(f"(3 * close + 2 * lag(close, 1) OVER ({_T}) + lag(close, 2) OVER ({_T})) / 6", 3)),
    "ewm_mean": ("ewm_mean(close, 5)", "m"),
    "ewm_std": ("ewm_std(close, 5)", "sqrt(v)"),
    "cs_rank": ("cs_rank(close)", "(rank() OVER (PARTITION BY datetime ORDER BY close) + (count(*) OVER (PARTITION BY datetime, close) - 1) / 2.0) / count(*) OVER (PARTITION BY datetime)"),
    "rank": ("rank(volume)", "(rank() OVER (PARTITION BY datetime ORDER BY volume) + (count(*) OVER (PARTITION BY datetime, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY datetime)"),
    "cs_demean": ("cs_demean(close)", f"close - avg(close) OVER {_D}"),
    "cs_demean_group": ("cs_demean_group(close, sector)", "close - avg(close) OVER (PARTITION BY datetime, sector)"),
    "zscore": ("zscore(close)", f"(close - avg(close) OVER {_D}) / nullif(stddev_pop(close) OVER {_D}, 0)"),
    "cs_neutralize": ("cs_neutralize(close, volume)", f"CASE WHEN count(*) OVER {_D} > 2 THEN close - avg(close) OVER {_D} - coalesce(covar_pop(close, volume) OVER {_D} / nullif(var_pop(volume) OVER {_D}, 0), 0) * (volume - avg(volume) OVER {_D}) END"),
    "cs_neutralize_group": ("cs_neutralize_group(close, sector, volume)", f"CASE WHEN count(*) OVER {_D[:-1]}, sector) > 2 THEN close - avg(close) OVER {_D[:-1]}, sector) - coalesce(covar_pop(close, volume) OVER {_D[:-1]}, sector) / nullif(var_pop(volume) OVER {_D[:-1]}, sector), 0), 0) * (volume - avg(volume) OVER {_D[:-1]}, sector)) END"),
    "winsorize": ("winsorize(close, 0.1)", f"least(greatest(close, quantile_cont(close, 0.1) OVER {_D}), quantile_cont(close, 0.9) OVER {_D})"),
    "scale": ("scale(close)", f"close / nullif(sum(abs(close)) OVER {_D}, 0)"),
    "clip": ("clip(close, 1000, 1500)", "least(greatest(close, 1000), 1500)"),
    "log": ("log(close - 1200)", "CASE WHEN close - 1200 > 0 THEN ln(close - 1200) END"),
    "log1p": ("log1p(volume)", "ln(1 + volume)"),
    "sqrt": ("sqrt(close - 1200)", "CASE WHEN close - 1200 >= 0 THEN sqrt(close - 1200) END"),
    "abs": ("abs(close - 1200)", "abs(close - 1200)"),
    "sign": ("sign(close - open)", "sign(close - open)::DOUBLE"),
    "where": ("where(close > open, high, low)", "CASE WHEN close > open THEN high ELSE low END"),
    "maximum": ("maximum(close, open)", "greatest(close, open)"),
    "minimum": ("minimum(close, open)", "least(close, open)"),
    "safe_div": ("safe_div(close, open - 5000)", "close / (abs(open - 5000) + 1e-12)"),
    "arithmetic": ("(close - open) * 2 + volume / close - 5 % 3", "(close - open) * 2 + volume / close - 2"),
    "modulo": ("(close - 1200) % 7", "(close - 1200) - 7 * floor((close - 1200) / 7)"),
    "power": ("(close / 1000) ** 2", "(close / 1000) * (close / 1000)"),
    "comparison": ("(close > delay(close, 1)) * 1", f"CASE WHEN close > lag(close, 1) OVER ({_T}) THEN 1.0 ELSE 0.0 END"),
    "boolean": ("where((close > open) and not (volume > 30) or close < 1000, 1, 0)", "CASE WHEN (close > open AND NOT volume > 30) OR close < 1000 THEN 1.0 ELSE 0.0 END"),
}
for _name, (_text, _sql) in FACTORS.items():
    _from = "panel JOIN sectors USING (instrument)" if "sector" in _text else "e" if _name.startswith("ewm") else "panel"
    _with = panel_sql() + (", " + SECTOR_SQL if "sector" in _text else "") + (_EWM if _name.startswith("ewm") else "")
    query(f"dsl_{_name}", f"WITH {'RECURSIVE ' if _name.startswith('ewm') else ''}{_with} SELECT datetime, instrument, {r('(' + _sql + ')::DOUBLE')} AS value FROM {_from}")(_factor(_text))


_M2 = "(PARTITION BY datetime)"
_RESIDUAL = "CASE WHEN n > 3 THEN y - CASE WHEN det > 1e-9 * aa * bb AND aa > 0 AND bb > 0 THEN (ay * bb - yb * ab) / det * a + (yb * aa - ay * ab) / det * b WHEN aa > 0 AND bb = 0 THEN ay / aa * a WHEN bb > 0 AND aa = 0 THEN yb / bb * b ELSE 0 END END"


@query("dsl_cs_neutralize_multi", f"""WITH {panel_sql()}, d AS (SELECT *, high - low AS spread FROM panel), s AS (SELECT *, count(*) OVER {_M2} AS n, close - avg(close) OVER {_M2} AS y, volume - avg(volume) OVER {_M2} AS a, spread - avg(spread) OVER {_M2} AS b,
 var_pop(volume) OVER {_M2} AS aa, var_pop(spread) OVER {_M2} AS bb, covar_pop(volume, spread) OVER {_M2} AS ab, covar_pop(volume, close) OVER {_M2} AS ay, covar_pop(spread, close) OVER {_M2} AS yb FROM d),
 k AS (SELECT *, aa * bb - ab * ab AS det FROM s) SELECT datetime, instrument, {r(_RESIDUAL, 4)} AS value FROM k""")
def dsl_cs_neutralize_multi(spark, sf_dir):
    """Two controls: least squares in a grouped map."""
    out = plans.eval_factor(sources.supplier_panel(spark, sf_dir), "cs_neutralize(close, volume, high - low)")
    return out.select("datetime", "instrument", rounded(F.col("value").cast("double"), 4).alias("value"))


@query("dsl_nested", f"""WITH {panel_sql()}, a AS (SELECT *, {_RET} AS x FROM panel),
 b AS (SELECT *, CASE WHEN count(x) OVER {_w(20)} = 20 THEN avg(x) OVER {_w(20)} END AS y FROM a)
 SELECT datetime, instrument, {r('(y - avg(y) OVER (PARTITION BY datetime)) / nullif(stddev_pop(y) OVER (PARTITION BY datetime), 0)')} AS value FROM b""")
def dsl_nested(spark, sf_dir):
    return _factor("zscore(ts_mean(returns(close, 1), 20))")(spark, sf_dir)


#: Sample factors that the evaluation queries use.
ALPHAS = {"momentum": "ts_mean(returns(close, 1), 8)", "reversal": "-returns(close, 1)", "volume_z": "ts_zscore(log1p(volume), 10)"}
_V = f"""v AS (SELECT *, {_RET} AS x, ln(1 + volume) AS lv FROM panel), wide AS (SELECT datetime, instrument,
 CASE WHEN count(x) OVER {_w(8)} = 8 THEN avg(x) OVER {_w(8)} END AS momentum, -x AS reversal,
 CASE WHEN count(lv) OVER {_w(10)} = 10 THEN (lv - avg(lv) OVER {_w(10)}) / nullif(stddev_pop(lv) OVER {_w(10)}, 0) END AS volume_z FROM v)"""
FACTOR_SQL = panel_sql() + ", " + _V + ", factors AS (" + " UNION ALL ".join(f"SELECT '{a}' AS alpha_id, datetime, instrument, {a} AS value FROM wide" for a in ALPHAS) + ")"


_kept: list = []


def kept(df: DataFrame) -> DataFrame:
    """The table, kept until the next query asks for its factors."""
    _kept.append(df.persist())
    return df


def factors(spark: SparkSession, sf_dir: str):
    """The weekly panel and its sample factors; the panel is kept, as the queries read it several times, that of the call before is released.

    Kept are the columns that are read: factors are windows over them, three times as large as what they are made of.
    """
    panel = weekly(spark, sf_dir)
    return panel, plans.run_factors(panel, _ALPHAS, max_missing=1.0).values


_ALPHAS = [{"alpha_id": a, "dsl": t} for a, t in ALPHAS.items()]


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes and volumes of the weekly panel, kept; what was kept before is released."""
    while _kept:
        _kept.pop().unpersist()
    return kept(sources.supplier_panel(spark, sf_dir).select("datetime", "instrument", "close", "volume"))


def evaluated_factors(spark: SparkSession, sf_dir: str):
    """The panel, and the sample factors with their forward returns, dealt by date."""
    panel = weekly(spark, sf_dir)
    return panel, plans.run_factors(ev.with_forward_returns(panel), _ALPHAS, max_missing=1.0, also=("fwd",), deal="datetime").values


@query("factor_batch", f"WITH {FACTOR_SQL} SELECT alpha_id, datetime, instrument, {r('value')} AS value FROM factors")
def factor_batch(spark, sf_dir):
    """Several factors in one plan."""
    return factors(spark, sf_dir)[1].withColumn("value", rounded(F.col("value")))


for _unit in ("week", "month"):
    def _panel(spark, sf_dir, unit=_unit):
        p = sources.supplier_panel(spark, sf_dir, unit)
        return p.select("datetime", "instrument", *[rounded(F.col(c)).alias(c) for c in sources.FIELDS])

    query(f"panel_supplier_{_unit}", f"WITH {panel_sql(_unit)} SELECT datetime, instrument, " + ", ".join(f"{r(c)} AS {c}" for c in sources.FIELDS) + " FROM panel")(_panel)


@query("panel_user_day", f"""SELECT date_trunc('day', ts)::TIMESTAMP AS datetime, user_id::VARCHAR AS instrument, {r('arg_min(value, ts)')} AS open, {r('max(value)')} AS high,
 {r('min(value)')} AS low, {r('arg_max(value, ts)')} AS close, {r('count(*)::DOUBLE')} AS volume FROM events GROUP BY 1, 2""")
def panel_user_day(spark, sf_dir):
    return sources.user_panel(spark, sf_dir).select("datetime", "instrument", *[rounded(F.col(c)).alias(c) for c in sources.FIELDS])


@query("panel_validate", f"""WITH {panel_sql()}, d AS (SELECT datetime, instrument, CASE WHEN volume > 60 THEN NULL ELSE open END AS open, CASE WHEN volume < 20 THEN NULL ELSE high END AS high, low * 1.1 AS low,
 CASE WHEN volume BETWEEN 40 AND 45 THEN NULL ELSE close END AS close, CASE WHEN volume < 10 THEN NULL ELSE -volume END AS volume FROM panel), k AS (SELECT * FROM d WHERE close IS NOT NULL),
 o AS (SELECT *, coalesce(open, lag(close) OVER ({_T}), close) AS o2 FROM k)
 SELECT datetime, instrument, {r('o2')} AS open, {r('greatest(coalesce(high, o2), o2, close)')} AS high, {r('least(coalesce(low, o2), o2, close)')} AS low, {r('close')} AS close, {r('abs(coalesce(volume, 0))')} AS volume FROM o""")
def panel_validate(spark, sf_dir):
    """Validation of a panel with planted gaps."""
    p = sources.supplier_panel(spark, sf_dir)
    v = F.col("volume")
    damaged = p.select("datetime", "instrument", F.when(v > 60, None).otherwise(F.col("open")).alias("open"), F.when(v < 20, None).otherwise(F.col("high")).alias("high"), (F.col("low") * 1.1).alias("low"), F.when(v.between(40, 45), None).otherwise(F.col("close")).alias("close"), F.when(v < 10, None).otherwise(-v).alias("volume"))
    return sources.validate_panel(damaged).select("datetime", "instrument", *[rounded(F.col(c)).alias(c) for c in sources.FIELDS])


@query("panel_synthetic")
def panel_synthetic(spark, sf_dir):
    return sources.synthetic_panel(spark)


@query("sector_map", f"WITH {SECTOR_SQL} SELECT instrument, sector FROM sectors")
def sector_map(spark, sf_dir):
    return sources.sector_map(sectors(spark, sf_dir).withColumn("instrument", F.concat(F.lit(" "), "instrument", F.lit(" "))))


@query("hard_to_borrow", "SELECT s_suppkey::VARCHAR AS instrument FROM supplier WHERE s_acctbal < 0")
def hard_to_borrow(spark, sf_dir):
    return sources.hard_to_borrow(_htb_source(spark, sf_dir))


def _htb_source(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("instrument"), F.when(F.col("s_acctbal") < 0, "no").otherwise(" Yes ").alias("shortable"))


_RATES_SQL = "rates AS (SELECT DISTINCT p.datetime, p.instrument, 20 + (abs(s_acctbal) % 300) AS borrow_bps FROM panel p JOIN supplier ON s_suppkey::VARCHAR = p.instrument WHERE (s_suppkey + extract(month FROM p.datetime)) % 3 = 0)"


def _rates(spark, sf_dir, panel):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey"), F.col("s_acctbal"))
    return panel.join(s, F.col("s_suppkey").cast("string") == F.col("instrument")).where((F.col("s_suppkey") + F.month("datetime")) % 3 == 0).select("datetime", "instrument", (20 + F.abs("s_acctbal") % 300).alias("rate_bps"))


@query("borrow_rates", f"""WITH {panel_sql('month')}, {_RATES_SQL}, g AS (SELECT d.datetime, i.instrument FROM (SELECT DISTINCT datetime FROM rates) d CROSS JOIN (SELECT DISTINCT instrument FROM rates) i),
 f AS (SELECT g.datetime, g.instrument, last_value(borrow_bps IGNORE NULLS) OVER (PARTITION BY g.instrument ORDER BY g.datetime ROWS UNBOUNDED PRECEDING) AS b FROM g LEFT JOIN rates USING (datetime, instrument))
 SELECT datetime, instrument, {r('b')} AS borrow_bps FROM f WHERE b IS NOT NULL""")
def borrow_rates(spark, sf_dir):
    rates = sources.borrow_rates(_rates(spark, sf_dir, sources.supplier_panel(spark, sf_dir, "month")))
    return sources.fill_borrow_rates(rates).withColumn("borrow_bps", rounded(F.col("borrow_bps")))
