"""Queries of evaluation, risk and portfolio operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sources
from .functions import rounded
from .operators import evaluation as ev
from .operators import portfolio as pf
from .operators import risk
from .queries import _RATES_SQL, FACTOR_SQL, SECTOR_SQL, _rates, evaluated_factors, factors, hard_to_borrow, kept, panel_sql, query, r, sectors

Q, MIN_OBS = 5, 5
_T = "PARTITION BY instrument ORDER BY datetime"
_G = "PARTITION BY alpha_id, datetime"


def tidy(df, digits: int = 6):
    """Doubles rounded, everything else as it is."""
    return df.select(*[rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def rank_sql(x: str, by: str = _G) -> str:
    return f"rank() OVER ({by} ORDER BY {x}) + (count(*) OVER ({by}, {x}) - 1) / 2.0"


def corr_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def bucket_sql(q: int = Q) -> str:
    out = []
    for k in range(1, q):
        p = (k * (1.0 / q) * 100.0) / 100.0
        at = f"(n - 1) * {p!r}::DOUBLE"
        out.append(f"CASE WHEN rn > CASE WHEN {at} - floor({at}) < 0.5 THEN floor({at}) + 1 + ({at} - floor({at})) ELSE floor({at}) + 2 - (1 - ({at} - floor({at}))) END THEN 1 ELSE 0 END")
    return " + ".join(out)


FWD = f"fwd AS (SELECT datetime, instrument, lead(close, 1) OVER ({_T}) / close - 1 AS fwd FROM panel), j AS (SELECT f.*, w.fwd FROM factors f JOIN fwd w USING (datetime, instrument) WHERE value IS NOT NULL AND w.fwd IS NOT NULL)"
IC = f"""rk AS (SELECT *, {rank_sql('value')} AS rv, {rank_sql('fwd')} AS rf FROM j),
 ic AS (SELECT alpha_id, datetime, count(*) AS n_obs, {corr_sql('value', 'fwd')} AS ic, {corr_sql('rv', 'rf')} AS rank_ic FROM rk GROUP BY 1, 2 HAVING count(*) >= {MIN_OBS})"""
BUCKETS = f"""nn AS (SELECT *, row_number() OVER ({_G} ORDER BY value, instrument) AS rn, count(*) OVER ({_G}) AS n FROM j),
 bk AS (SELECT *, {bucket_sql()} AS bucket FROM nn WHERE n >= {max(MIN_OBS, Q)})"""
SPREAD = "sp AS (SELECT alpha_id, datetime, avg(fwd) FILTER (bucket = 4) AS top, avg(fwd) FILTER (bucket = 0) AS bottom, avg(fwd) FILTER (bucket = 4) - avg(fwd) FILTER (bucket = 0) AS spread FROM bk GROUP BY 1, 2)"
TURN = """dy AS (SELECT alpha_id, datetime, row_number() OVER (PARTITION BY alpha_id ORDER BY datetime) AS i FROM (SELECT DISTINCT alpha_id, datetime FROM bk)),
 lg AS (SELECT b.alpha_id, b.bucket, b.instrument, d.i FROM bk b JOIN dy d USING (alpha_id, datetime) WHERE bucket IN (0, 4)),
 mv AS (SELECT a.alpha_id, a.i + 1 AS i, a.bucket, 1 - count(b.instrument) / count(*)::DOUBLE AS gone FROM lg a LEFT JOIN lg b ON a.alpha_id = b.alpha_id AND a.bucket = b.bucket AND a.instrument = b.instrument AND b.i = a.i + 1 GROUP BY 1, 2, 3),
 tn AS (SELECT d.alpha_id, d.datetime, coalesce(t.t, 0) AS turnover FROM dy d LEFT JOIN (SELECT alpha_id, i, avg(gone) AS t FROM mv GROUP BY 1, 2) t USING (alpha_id, i))"""
BASE = f"WITH {FACTOR_SQL}, {FWD}, {IC}, {BUCKETS}, {SPREAD}, {TURN}"
EVAL = f"""{BASE}, un AS (SELECT datetime, count(DISTINCT instrument) AS u FROM panel GROUP BY 1),
 day AS (SELECT ic.alpha_id, ic.datetime, n_obs, ic, rank_ic, spread, turnover, spread - turnover * 10 / 1e4 AS ls_return, n_obs / u::DOUBLE AS coverage FROM ic LEFT JOIN sp USING (alpha_id, datetime) LEFT JOIN tn USING (alpha_id, datetime) JOIN un USING (datetime))"""


def _summary(x: str, keys: str = "alpha_id") -> str:
    return f"""SELECT {keys}, count({x}) AS n_obs, {r(f'avg({x})')} AS mean, {r(f'coalesce(stddev_samp({x}), 0)')} AS std, {r(f'coalesce(avg({x}) / nullif(stddev_samp({x}), 0), 0) * sqrt(count({x}))')} AS t_stat,
 {r(f'coalesce(avg({x}) / nullif(stddev_samp({x}), 0), 0) * sqrt(252)')} AS information_ratio, {r(signed_log_sql(f'(pow(1 + avg({x}), 252) - 1)'))} AS log_annualized_return, {r('min(drawdown)')} AS max_drawdown"""


def _drawdown(x: str, source: str = "day", keys: str = "alpha_id") -> str:
    w = f"(PARTITION BY {keys} ORDER BY datetime ROWS UNBOUNDED PRECEDING)"
    return f"eq AS (SELECT *, product(1 + coalesce({x}, 0)) OVER {w} AS equity FROM {source}), dd AS (SELECT *, equity / nullif(max(equity) OVER {w}, 0) - 1 AS drawdown FROM eq)"


def signed_log_sql(x: str) -> str:
    """Large values on a scale on which rounding is relative."""
    return f"sign({x}) * ln(1 + abs({x}))"


def signed_log(x: str):
    return F.signum(x) * F.log1p(F.abs(x))


def _mild(x: str) -> str:
    """The factors' daily table with the series at a hundredth: unit prices jump by multiples from week to week, and compounding overflows."""
    return f"md AS (SELECT * REPLACE ({x} * 0.01 AS {x}) FROM day)"


def _mild_evaluated(spark, sf_dir):
    return _evaluated(spark, sf_dir).withColumn("ls_return", F.col("ls_return") * 0.01)


def _tidy_summary(df):
    return tidy(df.withColumn("log_annualized_return", signed_log("annualized_return")).drop("annualized_return"))


def _fwd(spark, sf_dir):
    return evaluated_factors(spark, sf_dir)[1]


@query("forward_returns", f"WITH {panel_sql()} SELECT datetime, instrument, {r(f'lead(close, 3) OVER ({_T}) / close - 1')} AS fwd FROM panel")
def forward_returns(spark, sf_dir):
    return tidy(ev.forward_returns(sources.supplier_panel(spark, sf_dir), 3))


@query("daily_ic", f"{BASE} SELECT alpha_id, datetime, n_obs, {r('ic')} AS ic, {r('rank_ic')} AS rank_ic FROM ic")
def daily_ic(spark, sf_dir):
    return tidy(ev.daily_ic(_fwd(spark, sf_dir), min_obs=MIN_OBS))


@query("quantile_buckets", f"{BASE} SELECT alpha_id, datetime, instrument, bucket::BIGINT AS bucket FROM bk")
def quantile_buckets(spark, sf_dir):
    return tidy(ev.buckets(_fwd(spark, sf_dir), min_obs=MIN_OBS).select("alpha_id", "datetime", "instrument", "bucket"))


@query("quantile_spread", f"{BASE} SELECT alpha_id, datetime, {r('top')} AS top, {r('bottom')} AS bottom, {r('spread')} AS spread FROM sp")
def quantile_spread(spark, sf_dir):
    return tidy(ev.quantile_spread(ev.buckets(_fwd(spark, sf_dir), min_obs=MIN_OBS)).drop("n_obs"))


@query("membership_turnover", f"{BASE} SELECT alpha_id, datetime, {r('turnover')} AS turnover FROM tn")
def membership_turnover(spark, sf_dir):
    return tidy(ev.membership_turnover(ev.buckets(_fwd(spark, sf_dir), min_obs=MIN_OBS)))


def _evaluated(spark, sf_dir):
    panel, values = evaluated_factors(spark, sf_dir)
    return ev.evaluate(values, panel, min_obs=MIN_OBS, cost_bps=10)


_DAY = ("ic", "rank_ic", "spread", "turnover", "ls_return", "coverage")


@query("factor_evaluation", f"{EVAL} SELECT alpha_id, datetime, n_obs, " + ", ".join(f"{r(c)} AS {c}" for c in _DAY) + " FROM day")
def factor_evaluation(spark, sf_dir):
    return tidy(_evaluated(spark, sf_dir))


@query("evaluation_summary", f"{EVAL}, {_mild('ls_return')}, {_drawdown('ls_return', 'md')} {_summary('ls_return')} FROM dd GROUP BY alpha_id")
def evaluation_summary(spark, sf_dir):
    return _tidy_summary(ev.summarize(_mild_evaluated(spark, sf_dir), ["alpha_id"], "ls_return"))


@query("yearly_breakdown", f"{EVAL}, {_mild('ls_return')}, yr AS (SELECT *, year(datetime) AS year FROM md), {_drawdown('ls_return', 'yr', 'alpha_id, year')} {_summary('ls_return', 'alpha_id, year')} FROM dd GROUP BY alpha_id, year")
def yearly_breakdown(spark, sf_dir):
    return _tidy_summary(ev.yearly(_mild_evaluated(spark, sf_dir), ["alpha_id"], "ls_return"))


@query("drawdown_path", f"{EVAL}, {_mild('ls_return')}, {_drawdown('ls_return', 'md')} SELECT alpha_id, datetime, {r(signed_log_sql('equity'))} AS log_equity, {r('drawdown')} AS drawdown FROM dd")
def drawdown_path(spark, sf_dir):
    return tidy(ev.drawdowns(_mild_evaluated(spark, sf_dir), ["alpha_id"], "ls_return").select("alpha_id", "datetime", signed_log("equity").alias("log_equity"), "drawdown"))


@query("factor_coverage", f"WITH {FACTOR_SQL}, d AS (SELECT alpha_id, datetime, count(value) AS n FROM factors GROUP BY 1, 2), u AS (SELECT alpha_id, count(DISTINCT instrument) AS m FROM factors GROUP BY 1) SELECT alpha_id, {r('avg(n / m::DOUBLE)')} AS coverage FROM d JOIN u USING (alpha_id) GROUP BY 1")
def factor_coverage(spark, sf_dir):
    return tidy(ev.coverage(factors(spark, sf_dir)[1]))


_HORIZONS = (1, 2, 5)
_DECAY = f"""WITH {FACTOR_SQL}, fwd AS ({' UNION ALL '.join(f"SELECT datetime, instrument, {h} AS horizon, lead(close, {h}) OVER ({_T}) / close - 1 AS fwd FROM panel" for h in _HORIZONS)}),
 j AS (SELECT f.*, horizon, fwd FROM factors f JOIN fwd USING (datetime, instrument) WHERE value IS NOT NULL AND fwd IS NOT NULL),
 rk AS (SELECT *, {rank_sql('value', 'PARTITION BY alpha_id, horizon, datetime')} AS rv, {rank_sql('fwd', 'PARTITION BY alpha_id, horizon, datetime')} AS rf FROM j),
 ic AS (SELECT alpha_id, horizon, datetime, {corr_sql('value', 'fwd')} AS ic, {corr_sql('rv', 'rf')} AS rank_ic FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_OBS}),
 nn AS (SELECT *, row_number() OVER (PARTITION BY alpha_id, horizon, datetime ORDER BY value, instrument) AS rn, count(*) OVER (PARTITION BY alpha_id, horizon, datetime) AS n FROM j),
 bk AS (SELECT *, {bucket_sql()} AS bucket FROM nn WHERE n >= {max(MIN_OBS, Q)}),
 sp AS (SELECT alpha_id, horizon, datetime, avg(fwd) FILTER (bucket = 4) - avg(fwd) FILTER (bucket = 0) AS s FROM bk GROUP BY 1, 2, 3),
 a AS (SELECT alpha_id, horizon, count(*) AS n_dates, avg(ic) AS ic_mean, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) * sqrt(count(ic)) AS ic_t, avg(rank_ic) AS rank_ic_mean, coalesce(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 0) * sqrt(count(rank_ic)) AS rank_ic_t FROM ic GROUP BY 1, 2),
 b AS (SELECT alpha_id, horizon, avg(s) AS spread_mean, coalesce(avg(s) / nullif(stddev_samp(s), 0), 0) * sqrt(252.0 / horizon) AS spread_ir FROM sp GROUP BY 1, 2), dc AS (SELECT * FROM a LEFT JOIN b USING (alpha_id, horizon))"""
_DC = ("ic_mean", "ic_t", "rank_ic_mean", "rank_ic_t", "spread_mean", "spread_ir")


def _decay(spark, sf_dir):
    panel, values = factors(spark, sf_dir)
    return ev.decay(values, panel, _HORIZONS, min_obs=MIN_OBS)


@query("horizon_decay", f"{_DECAY} SELECT alpha_id, horizon::BIGINT AS horizon, n_dates, " + ", ".join(f"{r(c)} AS {c}" for c in _DC) + " FROM dc")
def horizon_decay(spark, sf_dir):
    return tidy(_decay(spark, sf_dir))


@query("best_horizon", f"{_DECAY} SELECT alpha_id, arg_max(horizon, row(10 * abs(rank_ic_t) + abs(spread_ir), -horizon))::BIGINT AS best_horizon FROM dc GROUP BY 1")
def best_horizon(spark, sf_dir):
    return tidy(ev.best_horizon(_decay(spark, sf_dir)))


@query("quantile_overlap", f"""WITH {FACTOR_SQL}, q AS (SELECT *, quantile_cont(value, 0.2) OVER ({_G}) AS lo, quantile_cont(value, 0.8) OVER ({_G}) AS hi FROM factors WHERE value IS NOT NULL),
 s AS (SELECT alpha_id, datetime, instrument, 'top' AS leg FROM q WHERE value >= hi UNION ALL SELECT alpha_id, datetime, instrument, 'bottom' FROM q WHERE value <= lo),
 d AS (SELECT alpha_id, datetime, row_number() OVER (PARTITION BY alpha_id ORDER BY datetime) AS i FROM (SELECT DISTINCT alpha_id, datetime FROM s)), x AS (SELECT s.*, i FROM s JOIN d USING (alpha_id, datetime)),
 n AS (SELECT alpha_id, leg, i, count(*) AS n FROM x GROUP BY 1, 2, 3), b AS (SELECT a.alpha_id, a.leg, a.i, count(*) AS b FROM x a JOIN x p ON a.alpha_id = p.alpha_id AND a.leg = p.leg AND a.instrument = p.instrument AND a.i = p.i + 1 GROUP BY 1, 2, 3)
 SELECT n.alpha_id, n.leg, {r('avg(coalesce(b, 0) / (n.n + m.n - coalesce(b, 0))::DOUBLE)')} AS overlap, count(*) AS n_dates FROM n JOIN n m ON n.alpha_id = m.alpha_id AND n.leg = m.leg AND n.i = m.i + 1 LEFT JOIN b ON b.alpha_id = n.alpha_id AND b.leg = n.leg AND b.i = n.i GROUP BY 1, 2""")
def quantile_overlap(spark, sf_dir):
    return tidy(ev.overlap(ev.quantile_sets(factors(spark, sf_dir)[1])))


W, M = 8, 4
GRID = f"""g AS (SELECT d.datetime, n.instrument, close, volume FROM (SELECT DISTINCT datetime FROM panel) d CROSS JOIN (SELECT DISTINCT instrument FROM panel) n LEFT JOIN panel p ON p.datetime = d.datetime AND p.instrument = n.instrument),
 fl AS (SELECT *, last_value(close IGNORE NULLS) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS c FROM g), rt AS (SELECT datetime, instrument, close, volume, c / lag(c) OVER ({_T}) - 1 AS ret FROM fl)"""
_F = f"({_T} ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"
EXPO = f"""{GRID}, mk AS (SELECT *, coalesce(avg(ret) OVER (PARTITION BY datetime), 0) AS mkt, close * volume AS money FROM rt), mm AS (SELECT *, CASE WHEN ret IS NOT NULL THEN mkt END AS m FROM mk),
 nw AS (SELECT *, CASE WHEN count(ret) OVER {_F} >= {M} THEN stddev_samp(ret) OVER {_F} END AS v, CASE WHEN count(money) OVER {_F} >= {M} THEN avg(money) OVER {_F} END AS a,
 CASE WHEN count(ret) OVER {_F} >= {M} THEN (avg(ret * m) OVER {_F} - avg(ret) OVER {_F} * avg(m) OVER {_F}) / nullif(avg(m * m) OVER {_F} - avg(m) OVER {_F} * avg(m) OVER {_F}, 0) END AS b FROM mm),
 ex AS (SELECT datetime, instrument, ret, lag(v) OVER ({_T}) AS volatility, lag(a) OVER ({_T}) AS adv, lag(b) OVER ({_T}) AS beta FROM nw)"""


@query("risk_exposures", f"WITH {panel_sql()}, {EXPO} SELECT datetime, instrument, {r('ret')} AS ret, {r('volatility')} AS volatility, {r('ln(1 + adv)')} AS log_adv, {r('adv', 2)} AS adv, {r('beta')} AS beta FROM ex")
def risk_exposures(spark, sf_dir):
    """Each name on each date; a date without a row of the name is one without a close."""
    panel = kept(sources.supplier_panel(spark, sf_dir))
    cells = panel.select("instrument").distinct().crossJoin(F.broadcast(panel.select("datetime").distinct()))
    e = risk.exposures(cells.join(panel.select("datetime", "instrument", "close", "volume"), ["datetime", "instrument"], "left"), W, M)
    return e.select("datetime", "instrument", *[rounded(F.col(c), 2 if c == "adv" else 6).alias(c) for c in ("ret", "volatility", "log_adv", "adv", "beta")])


_FD = f"(ORDER BY datetime ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"
FEAT = f"""{GRID}, mo AS (SELECT *, CASE WHEN count(close * volume) OVER {_F} >= {W} THEN avg(close * volume) OVER {_F} END AS adv FROM rt),
 dm AS (SELECT datetime, coalesce(avg(ret), 0) AS mkt_ret, stddev_samp(ret) AS disp, avg(adv) AS adv FROM mo GROUP BY 1),
 fm AS (SELECT datetime, mkt_ret, CASE WHEN count(mkt_ret) OVER {_FD} = {W} THEN stddev_samp(mkt_ret) OVER {_FD} END AS v, CASE WHEN count(mkt_ret) OVER {_FD} = {W} THEN avg(mkt_ret) OVER {_FD} END AS t, CASE WHEN count(disp) OVER {_FD} = {W} THEN avg(disp) OVER {_FD} END AS d, ln(1 + adv) AS l FROM dm),
 ft AS (SELECT datetime, mkt_ret, lag(v) OVER (ORDER BY datetime) AS mkt_vol, lag(t) OVER (ORDER BY datetime) AS mkt_trend, lag(d) OVER (ORDER BY datetime) AS xs_disp, lag(l) OVER (ORDER BY datetime) AS mkt_liq FROM fm)"""


def _features(spark, sf_dir):
    return risk.market_features(sources.supplier_panel(spark, sf_dir), W)


@query("market_features", f"WITH {panel_sql()}, {FEAT} SELECT datetime, " + ", ".join(f"{r(c)} AS {c}" for c in ("mkt_ret", "mkt_vol", "mkt_trend", "xs_disp", "mkt_liq")) + " FROM ft")
def market_features(spark, sf_dir):
    return tidy(_features(spark, sf_dir))


_CUT = "DATE '1996-01-01'"
_EDGE = lambda x, k: f"(SELECT quantile_cont({x}, {k}/3.0) FROM ft WHERE datetime < {_CUT})"
_IN = lambda x: f"(CASE WHEN {x} > {_EDGE(x, 1)} THEN 1 ELSE 0 END + CASE WHEN {x} > {_EDGE(x, 2)} THEN 1 ELSE 0 END)"
LABELS = f"{FEAT}, lb AS (SELECT datetime, CASE WHEN mkt_vol IS NOT NULL AND mkt_liq IS NOT NULL THEN 'vol_' || {_IN('mkt_vol')} || '_liq_' || {_IN('mkt_liq')} END AS label FROM ft)"


def _labels(spark, sf_dir):
    return _labels_of(_features(spark, sf_dir))


def _labels_of(f):
    return risk.regime_labels(f, f.where("datetime < date'1996-01-01'"), "vol_liq", 3)


@query("regime_labels", f"WITH {panel_sql()}, {LABELS} SELECT datetime, label FROM lb")
def regime_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


@query("regime_stats", f"WITH {panel_sql()}, {LABELS}, kn AS (SELECT *, lag(label) OVER (ORDER BY datetime) AS p FROM lb WHERE label IS NOT NULL) SELECT count(*) AS n_dates, count(DISTINCT label) AS n_labels, {r('coalesce(sum(CASE WHEN p <> label THEN 1 ELSE 0 END) / nullif(count(*) - 1, 0)::DOUBLE, 0)')} AS switch_rate FROM kn")
def regime_stats(spark, sf_dir):
    return tidy(risk.regime_stats(_labels(spark, sf_dir)))


@query("regime_buckets", f"WITH {panel_sql()}, {FEAT}, fi AS (SELECT datetime, coalesce(mkt_vol, (SELECT quantile_cont(mkt_vol, 0.5) FROM ft)) AS x FROM ft) SELECT datetime, (CASE WHEN x > (SELECT quantile_cont(x, 1/3.0) FROM fi) THEN 1 ELSE 0 END + CASE WHEN x > (SELECT quantile_cont(x, 2/3.0) FROM fi) THEN 1 ELSE 0 END)::VARCHAR AS label FROM fi")
def regime_buckets(spark, sf_dir):
    return risk.regime_buckets(_features(spark, sf_dir), "mkt_vol")


@query("regime_performance", f"{EVAL}, {_mild('ls_return')}, {LABELS}, jl AS (SELECT md.*, label FROM md JOIN lb USING (datetime) WHERE label IS NOT NULL), {_drawdown('ls_return', 'jl', 'alpha_id, label')} {_summary('ls_return', 'alpha_id, label')} FROM dd GROUP BY alpha_id, label")
def regime_performance(spark, sf_dir):
    return _tidy_summary(risk.regime_performance(_mild_evaluated(spark, sf_dir), _labels(spark, sf_dir), ["alpha_id"], "ls_return"))


@query("sector_dummies", f"WITH {SECTOR_SQL} SELECT instrument, " + ", ".join(f"(sector = '{s}')::INT::DOUBLE AS \"sector_{s}\"" for s in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM sectors")
def sector_dummies(spark, sf_dir):
    s = sectors(spark, sf_dir)
    return risk.sector_dummies(s.select("instrument"), s)[0]


# -- portfolios ---------------------------------------------------------------------------------

CFG = pf.Backtest(min_obs=MIN_OBS, rebalance_days=4, holding_days=8, half_spread_bps=1.0, impact_bps=10.0, window=W, min_window_obs=M)
CAL = "cal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS i, lead(datetime) OVER (ORDER BY datetime) AS next FROM (SELECT DISTINCT datetime FROM panel))"
TARGETS = f"""{CAL}, htb AS (SELECT s_suppkey::VARCHAR AS instrument FROM supplier WHERE s_acctbal < 0), rb AS (SELECT f.*, i FROM factors f JOIN cal USING (datetime) WHERE next IS NOT NULL AND i % 4 = 0 AND value IS NOT NULL),
 rn AS (SELECT *, row_number() OVER ({_G} ORDER BY value, instrument) AS rn, count(*) OVER ({_G}) AS n FROM rb), bb AS (SELECT *, {bucket_sql()} AS bucket FROM rn WHERE n >= {MIN_OBS}),
 sd AS (SELECT *, CASE WHEN bucket = 4 THEN 1 WHEN bucket = 0 AND instrument NOT IN (SELECT instrument FROM htb) THEN -1 ELSE 0 END AS side FROM bb), cn AS (SELECT *, count(*) FILTER (side = 1) OVER ({_G}) AS nl, count(*) FILTER (side = -1) OVER ({_G}) AS ns FROM sd),
 tg AS (SELECT alpha_id, datetime, i, instrument, CASE WHEN side = 1 THEN 0.5 / nl ELSE -0.5 / ns END AS weight FROM cn WHERE side <> 0 AND nl > 0 AND ns > 0)"""
HELD = f"{TARGETS}, hw AS (SELECT t.alpha_id, c.i, c.datetime, c.next, t.instrument, sum(t.weight / 2) AS w FROM tg t JOIN cal c ON c.i >= t.i AND c.i < least(t.i + 8, (SELECT max(i) FROM cal)) GROUP BY 1, 2, 3, 4, 5 HAVING abs(sum(t.weight / 2)) > 1e-12)"
ON_ALL_DATES = "dp AS (SELECT a.alpha_id, c.next AS datetime, " + ", ".join(f"coalesce(d.{c}, 0) AS {c}" for c in ("gross_return", "turnover", "traded", "impact_unit", "gross_short", "gross_long", "borrow_unit")) + " FROM (SELECT DISTINCT alpha_id FROM factors) a CROSS JOIN (SELECT next FROM cal WHERE next IS NOT NULL) c LEFT JOIN dq d ON d.alpha_id = a.alpha_id AND d.datetime = c.next)"
PATH = f"""{HELD}, mvs AS (SELECT alpha_id, i, instrument, w, 0.0 AS b FROM hw UNION ALL SELECT alpha_id, i + 1, instrument, 0.0, w FROM hw), tr AS (SELECT alpha_id, i, instrument, sum(w) AS w, abs(sum(w) - sum(b)) AS d FROM mvs GROUP BY 1, 2, 3),
 {EXPO}, us AS (SELECT datetime, quantile_cont(adv, 0.5) AS mid FROM ex GROUP BY 1),
 tt AS (SELECT tr.*, c.next, coalesce(x.ret, 0) AS ret, d * pow(least(d * 1e6 / nullif(coalesce(e.adv, us.mid, 1), 0), 0.2), 0.5) AS unit FROM tr JOIN cal c USING (i) LEFT JOIN ex x ON x.datetime = c.next AND x.instrument = tr.instrument LEFT JOIN ex e ON e.datetime = c.datetime AND e.instrument = tr.instrument LEFT JOIN us ON us.datetime = c.datetime WHERE c.next IS NOT NULL),
 dq AS (SELECT alpha_id, next AS datetime, sum(w * ret) AS gross_return, sum(d) / 2 AS turnover, sum(d) AS traded, sum(unit) AS impact_unit, sum(greatest(-w, 0)) AS gross_short, sum(greatest(w, 0)) AS gross_long, sum(greatest(-w, 0) * 50) / 1e4 / 252 AS borrow_unit FROM tt GROUP BY 1, 2),
 {ON_ALL_DATES},
 dc AS (SELECT *, turnover * 3 / 1e4 AS linear_cost, traded / 1e4 AS spread_cost, impact_unit * 10 / 1e4 AS impact_cost, borrow_unit AS borrow_cost FROM dp), day AS (SELECT *, linear_cost + spread_cost + impact_cost + borrow_cost AS total_cost, gross_return - (linear_cost + spread_cost + impact_cost + borrow_cost) AS net_return FROM dc)"""
_PCOLS = ("gross_return", "turnover", "traded", "impact_unit", "gross_short", "gross_long", "borrow_unit", "linear_cost", "spread_cost", "impact_cost", "borrow_cost", "total_cost", "net_return")


@query("target_weights", f"WITH {FACTOR_SQL}, {TARGETS} SELECT alpha_id, datetime, instrument, {r('weight')} AS weight FROM tg")
def target_weights(spark, sf_dir):
    panel, values = factors(spark, sf_dir)
    return tidy(pf.target_weights(values, panel, CFG, hard_to_borrow=hard_to_borrow(spark, sf_dir)))


@query("held_weights", f"WITH {FACTOR_SQL}, {HELD} SELECT alpha_id, datetime, instrument, {r('w')} AS weight FROM hw")
def held_weights(spark, sf_dir):
    panel, values = factors(spark, sf_dir)
    return tidy(pf.held_weights(pf.target_weights(values, panel, CFG, hard_to_borrow=hard_to_borrow(spark, sf_dir)), panel, CFG))


def _daily(spark, sf_dir, cfg=CFG):
    return _traded(spark, sf_dir, cfg)[1]


def _traded(spark, sf_dir, cfg=CFG):
    """The panel and the daily paths of its factors."""
    panel, values = factors(spark, sf_dir)
    return panel, pf.backtest(values, panel, cfg, hard_to_borrow=hard_to_borrow(spark, sf_dir))


@query("backtest_daily", f"WITH {FACTOR_SQL}, {PATH} SELECT alpha_id, datetime, " + ", ".join(f"{r(c)} AS {c}" for c in _PCOLS) + " FROM day")
def backtest_daily(spark, sf_dir):
    return tidy(_daily(spark, sf_dir))


@query("backtest_summary", f"WITH {FACTOR_SQL}, {PATH}, {_drawdown('net_return')} {_summary('net_return')}, {r('avg(turnover)')} AS turnover_mean, {r('avg(total_cost)')} AS total_cost_mean FROM dd GROUP BY alpha_id")
def backtest_summary(spark, sf_dir):
    s = pf.portfolio_summary(_daily(spark, sf_dir))
    return _tidy_summary(s.select("alpha_id", "n_obs", "mean", "std", "t_stat", "information_ratio", "annualized_return", "max_drawdown", "turnover_mean", "total_cost_mean"))


@query("cost_ablation", f"""WITH {FACTOR_SQL}, {PATH}, sc AS (SELECT alpha_id, datetime, gross_return, unnest(['full', 'no_borrow', 'no_impact', 'linear_only', 'no_costs']) AS scenario,
 unnest([linear_cost + spread_cost + impact_cost + borrow_cost, linear_cost + spread_cost + impact_cost, linear_cost + spread_cost, linear_cost, 0]) AS drag FROM day)
 SELECT alpha_id, scenario, {r('avg(drag)')} AS drag_mean, {r('avg(gross_return - drag)')} AS net_mean FROM sc GROUP BY 1, 2""")
def cost_ablation(spark, sf_dir):
    return tidy(pf.ablation(_daily(spark, sf_dir)).groupBy("alpha_id", "scenario").agg(F.avg("drag").alias("drag_mean"), F.avg("net_return").alias("net_mean")))


_GRIDS = {"linear_cost_bps": [0, 2000, 900000], "borrow_bps": [0, 100000, 900000000]}
CURVE = f"""WITH {FACTOR_SQL}, {PATH}, gr AS ({' UNION ALL '.join(f"SELECT '{p}' AS parameter, unnest([{', '.join(map(str, v))}])::DOUBLE AS setting" for p, v in _GRIDS.items())}),
 ne AS (SELECT alpha_id, parameter, setting, gross_return - CASE parameter WHEN 'borrow_bps' THEN gross_short * (setting / 1e4 / 252) ELSE turnover * (setting / 1e4) END AS net FROM day CROSS JOIN gr),
 cu AS (SELECT alpha_id, parameter, setting, avg(net) AS mean_return, coalesce(avg(net) / nullif(stddev_samp(net), 0), 0) * sqrt(252) AS information_ratio FROM ne GROUP BY 1, 2, 3)"""


@query("cost_sensitivity", f"{CURVE} SELECT alpha_id, parameter, setting, {r('mean_return')} AS mean_return, {r('information_ratio')} AS information_ratio FROM cu")
def cost_sensitivity(spark, sf_dir):
    return tidy(pf.cost_sensitivity(_daily(spark, sf_dir), _GRIDS)).withColumn("setting", F.round("setting"))


_WP = "(PARTITION BY alpha_id, parameter ORDER BY setting)"


@query("break_even", f"""{CURVE}, st AS (SELECT *, CASE WHEN mean_return > 0 AND lead(mean_return) OVER {_WP} <= 0 THEN setting + (lead(setting) OVER {_WP} - setting) * mean_return / nullif(mean_return - lead(mean_return) OVER {_WP}, 0) END AS x FROM cu),
 en AS (SELECT alpha_id, parameter, min(x) AS bx, arg_min(mean_return, setting) AS f, arg_max(mean_return, setting) AS l, max(mean_return) - min(mean_return) AS s FROM st GROUP BY 1, 2),
 ss AS (SELECT *, CASE WHEN s < 1e-15 THEN 'flat' WHEN f <= 0 THEN 'below_grid' WHEN bx IS NOT NULL THEN 'ok' WHEN l > 0 THEN 'above_grid' ELSE 'no_cross' END AS status FROM en)
 SELECT alpha_id, parameter, {r("CASE WHEN status = 'ok' THEN bx END")} AS break_even, status FROM ss""")
def break_even(spark, sf_dir):
    return tidy(pf.break_even(pf.cost_sensitivity(_daily(spark, sf_dir), _GRIDS)))


@query("reprice", f"WITH {FACTOR_SQL}, {PATH} SELECT alpha_id, datetime, {r('gross_return')} AS gross_return, {r('turnover')} AS turnover FROM day")
def reprice(spark, sf_dir):
    """Weights re-dated by the return that they earn give the same path."""
    panel, values = factors(spark, sf_dir)
    held = pf.held_weights(pf.target_weights(values, panel, CFG, hard_to_borrow=hard_to_borrow(spark, sf_dir)), panel, CFG)
    dated = held.join(pf.calendar(panel).select("datetime", "next"), "datetime").select("alpha_id", F.col("next").alias("datetime"), "instrument", "weight")
    return tidy(pf.reprice(dated, panel, CFG).select("alpha_id", "datetime", "gross_return", "turnover"))


_SHORT = PATH.replace("i % 4 = 0", "i % 10 = 0").replace("t.weight / 2", "t.weight").replace("t.i + 8", "t.i + 3")


@query("backtest_short_hold", f"WITH {FACTOR_SQL}, {_SHORT} SELECT alpha_id, datetime, " + ", ".join(f"{r(c)} AS {c}" for c in _PCOLS) + " FROM day")
def backtest_short_hold(spark, sf_dir):
    """A holding period that ends before the next rebalance: the book is flat in between; every date has a row."""
    return tidy(_daily(spark, sf_dir, pf.with_config(CFG, rebalance_days=10, holding_days=3)).select("alpha_id", "datetime", *_PCOLS))


_PARTS = ("gross_return", "turnover", "traded", "impact_unit", "gross_short", "gross_long", "borrow_unit", "scale", "net_return")


def capped_sql(impact: float, target_vol: float, cap: float) -> str:
    """The state machine as a recursion over the calendar, with the book as a list over the instruments in order."""
    on = lambda x, d: f"LEFT JOIN ex {x} ON {x}.datetime = c.{d} AND {x}.instrument = n.instrument"
    unit = "list_sum(list_transform(list_zip(delta, adv), lambda z: abs(z[1]) * pow(least(abs(z[1]) * 1e6 / nullif(z[2], 0), 0.2), 0.5)))" if impact else "0.0::DOUBLE"
    return f"""WITH RECURSIVE {FACTOR_SQL}, {PATH}, nm AS (SELECT DISTINCT instrument FROM panel),
 gl AS (SELECT a.alpha_id, c.i, c.next, list(coalesce(h.w, 0)::DOUBLE ORDER BY n.instrument) AS goal, list(coalesce(x.ret, 0)::DOUBLE ORDER BY n.instrument) AS ret, list(coalesce(e.adv, us.mid, 1)::DOUBLE ORDER BY n.instrument) AS adv
 FROM (SELECT DISTINCT alpha_id FROM factors) a CROSS JOIN cal c CROSS JOIN nm n LEFT JOIN hw h ON h.alpha_id = a.alpha_id AND h.i = c.i AND h.instrument = n.instrument {on('x', 'next')} {on('e', 'datetime')} LEFT JOIN us ON us.datetime = c.datetime WHERE c.next IS NOT NULL GROUP BY 1, 2, 3),
 st AS (SELECT DISTINCT alpha_id, -1::BIGINT AS i, NULL::TIMESTAMP AS datetime, list_transform(goal, lambda v: 0.0::DOUBLE) AS held, []::DOUBLE[] AS nets, 0.0::DOUBLE AS gross_return, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS traded, 0.0::DOUBLE AS impact_unit, 0.0::DOUBLE AS gross_short, 0.0::DOUBLE AS gross_long, 0.0::DOUBLE AS borrow_unit, 1.0::DOUBLE AS scale, 0.0::DOUBLE AS net_return FROM gl WHERE i = 0
 UNION ALL SELECT alpha_id, i, next, held, list_append(nets, net), gross, turnover, traded, unit, short, long, borrow, scale, net FROM (
 SELECT *, gross - turnover * 3 / 1e4 - traded / 1e4 - unit * {impact} / 1e4 - borrow AS net FROM (
 SELECT alpha_id, i, next, held, nets, scale, turnover, list_sum(list_transform(delta, lambda v: abs(v))) AS traded, list_sum(list_transform(list_zip(held, ret), lambda z: z[1] * z[2])) AS gross, {unit} AS unit,
 list_sum(list_transform(held, lambda v: greatest(-v, 0))) AS short, list_sum(list_transform(held, lambda v: greatest(v, 0))) AS long, list_sum(list_transform(held, lambda v: greatest(-v, 0))) * 50 / 1e4 / 252 AS borrow FROM (
 SELECT alpha_id, i, next, nets, ret, adv, scale, least(raw, {cap}) AS turnover, list_transform(move, lambda v: v * k) AS delta, list_transform(list_zip(before, move), lambda z: z[1] + z[2] * k) AS held FROM (
 SELECT *, CASE WHEN raw > {cap} THEN {cap} / raw ELSE 1.0 END AS k FROM (
 SELECT *, list_sum(list_transform(move, lambda v: abs(v))) / 2 AS raw FROM (
 SELECT *, list_transform(list_zip(goal, before), lambda z: z[1] * scale - z[2]) AS move FROM (
 SELECT g.alpha_id, g.i, g.next, g.goal, g.ret, g.adv, s.nets, s.held AS before,
 CASE WHEN len(s.nets) < 20 THEN 1.0 ELSE coalesce(least(greatest({target_vol} / sqrt(252) / nullif(list_aggregate(s.nets[-20:], 'stddev_samp'), 0), 0), 3.0), 1.0) END AS scale
 FROM st s JOIN gl g ON g.alpha_id = s.alpha_id AND g.i = s.i + 1)))))))
 ) SELECT alpha_id, datetime, {", ".join(f"{r(c)} AS {c}" for c in _PARTS)} FROM st WHERE i >= 0"""


@query("backtest_sequential", capped_sql(0.0, 0.1, 0.2))
def backtest_sequential(spark, sf_dir):
    """Volatility target and turnover cap."""
    return tidy(_daily(spark, sf_dir, pf.with_config(CFG, impact_bps=0.0, target_vol=0.1, turnover_cap=0.2)).select("alpha_id", "datetime", *_PARTS))


@query("backtest_capped", capped_sql(10.0, 0.1, 0.1))
def backtest_capped(spark, sf_dir):
    """The same with impact costs and a row for every date."""
    return tidy(_daily(spark, sf_dir, pf.with_config(CFG, target_vol=0.1, turnover_cap=0.1)).select("alpha_id", "datetime", *_PARTS))


@query("backtest_optimized")
def backtest_optimized(spark, sf_dir):
    """The ridge optimizer with beta control, a pull to the held book and a variance penalty, date by date."""
    opt = pf.Optimizer(backend="ridge", turnover=0.5, exposure=1.0, risk=0.1)
    return tidy(_daily(spark, sf_dir, pf.with_config(CFG, optimizer=opt, neutralize=("beta",), max_weight=0.2)).select("alpha_id", "datetime", *_PARTS))


_FILTERED = TARGETS.replace("rb AS (SELECT f.*, i FROM factors f JOIN cal USING (datetime)", "rb AS (SELECT f.*, i FROM factors f JOIN cal USING (datetime) JOIN ex USING (datetime, instrument)").replace("AND value IS NOT NULL)", "AND value IS NOT NULL AND adv >= 30000)").replace("instrument NOT IN (SELECT instrument FROM htb)", "coalesce((SELECT any_value(borrow_bps) FROM rates q WHERE q.datetime = bb.datetime AND q.instrument = bb.instrument), 50) <= 150")


@query("target_weights_filtered", f"WITH {FACTOR_SQL}, {_RATES_SQL}, {EXPO}, {_FILTERED} SELECT alpha_id, datetime, instrument, {r('weight')} AS weight FROM tg")
def target_weights_filtered(spark, sf_dir):
    """Names of enough traded value; shorts only where borrowing is cheap."""
    panel, values = factors(spark, sf_dir)
    rates = sources.borrow_rates(_rates(spark, sf_dir, panel))
    return tidy(pf.target_weights(values, panel, pf.with_config(CFG, min_adv=30000.0, max_borrow_bps=150.0), rates=rates))


_NAMES = f"""{CAL}, htb AS (SELECT s_suppkey::VARCHAR AS instrument FROM supplier WHERE s_acctbal < 0), rb AS (SELECT f.*, instrument NOT IN (SELECT instrument FROM htb) AS can FROM factors f JOIN cal USING (datetime) WHERE next IS NOT NULL AND i % 4 = 0 AND value IS NOT NULL),
 rn AS (SELECT *, row_number() OVER ({_G} ORDER BY value, instrument) AS rn, row_number() OVER ({_G}, can ORDER BY value, instrument) AS rc, count(*) OVER ({_G}) AS n, count(*) FILTER (can) OVER ({_G}) AS nc FROM rb),
 sd AS (SELECT *, CASE WHEN rn > n - 5 THEN 1 WHEN can AND rc <= 5 THEN -1 ELSE 0 END AS side FROM rn WHERE n >= 10 AND nc >= 5), cn AS (SELECT *, count(*) FILTER (side = 1) OVER ({_G}) AS nl, count(*) FILTER (side = -1) OVER ({_G}) AS ns FROM sd)"""


@query("target_weights_names", f"WITH {FACTOR_SQL}, {_NAMES} SELECT alpha_id, datetime, instrument, {r('CASE WHEN side = 1 THEN 0.5 / nl ELSE -0.5 / ns END')} AS weight FROM cn WHERE side <> 0 AND nl > 0 AND ns > 0")
def target_weights_names(spark, sf_dir):
    """Five names on each side, the short ones among those that can be borrowed."""
    panel, values = factors(spark, sf_dir)
    return tidy(pf.target_weights(values, panel, pf.with_config(CFG, names_per_side=5), hard_to_borrow=hard_to_borrow(spark, sf_dir)))


@query("backtest_neutralized")
def backtest_neutralized(spark, sf_dir):
    """Beta- and volatility-neutral weights, rescaled and capped."""
    return tidy(_daily(spark, sf_dir, pf.with_config(CFG, neutralize=("beta", "volatility"), max_weight=0.1)))
