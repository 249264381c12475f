"""Queries of walk-forward, selection, constraint, sweep, allocation and ensemble operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .evaluation_queries import CAL, CFG, HELD, MIN_OBS, PATH, _daily, _labels, _labels_of, _traded, bucket_sql, tidy
from .functions import rounded
from .operators import ensembles as ens
from .operators import portfolio as pf
from .operators import factor_model, presets, reporting, risk, tuning
from .operators import selection as sel
from .queries import FACTOR_SQL, factors, hard_to_borrow, kept, query, r

DAY = f"WITH {FACTOR_SQL}, {PATH}"
PAIRS = "pr AS (SELECT x.alpha_id AS a, y.alpha_id AS b, count(*) AS n, covar_pop(x.net_return, y.net_return) / nullif(stddev_pop(x.net_return) * stddev_pop(y.net_return), 0) AS corr FROM day x JOIN day y USING (datetime) GROUP BY 1, 2)"
WF = sel.WalkForward(train=120, valid=40, test=40, step=80)
FAST = pf.with_config(CFG, impact_bps=0.0)


@query("return_correlations", f"{DAY}, {PAIRS} SELECT a, b, n, {r('corr')} AS corr FROM pr")
def return_correlations(spark, sf_dir):
    return tidy(sel.return_correlations(kept(_daily(spark, sf_dir))))


@query("correlation_summary", f"{DAY}, {PAIRS} SELECT {r('avg(abs(corr)) FILTER (a <> b)')} AS avg_abs_corr, {r('max(abs(corr)) FILTER (a <> b)')} AS max_abs_corr FROM pr")
def correlation_summary(spark, sf_dir):
    return tidy(sel.correlation_summary(sel.return_correlations(kept(_daily(spark, sf_dir)))))


@query("equal_weight_ensemble", f"{DAY} SELECT datetime, {r('avg(net_return)')} AS net_return, count(*) AS n_alphas FROM day GROUP BY 1")
def equal_weight_ensemble(spark, sf_dir):
    return tidy(sel.equal_weight_ensemble(_daily(spark, sf_dir)))


@query("quality_gates", f"""{DAY}, m AS (SELECT alpha_id, avg(turnover) AS turnover_mean, coalesce(avg(net_return) / nullif(stddev_samp(net_return), 0), 0) * sqrt(252) AS ir FROM day GROUP BY 1)
 SELECT alpha_id, (turnover_mean <= 0.2 AND ir >= 0) AS passed, concat_ws('; ', CASE WHEN ir < 0 THEN 'information_ratio < 0' END, CASE WHEN turnover_mean > 0.2 THEN 'turnover_mean > 0.2' END) AS reasons FROM m""")
def quality_gates(spark, sf_dir):
    gated = sel.quality_gates(pf.portfolio_summary(_daily(spark, sf_dir)), least={"information_ratio": 0.0}, most={"turnover_mean": 0.2})
    return gated.select("alpha_id", "passed", F.concat_ws("; ", "reasons").alias("reasons"))


@query("top_alphas", f"{DAY} SELECT alpha_id, {r('avg(turnover)')} AS turnover_mean FROM day GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
def top_alphas(spark, sf_dir):
    m = _daily(spark, sf_dir).groupBy("alpha_id").agg(rounded(F.avg("turnover")).alias("turnover_mean"))
    return sel.top_k(m, "turnover_mean", 2)


_SCORED = "sc AS (SELECT alpha_id, coalesce(avg(net_return) / nullif(stddev_samp(net_return), 0), 0) * sqrt(252) AS s FROM day GROUP BY 1), c1 AS (SELECT alpha_id FROM sc ORDER BY s DESC, alpha_id LIMIT 1)"


@query("greedy_selection", f"""{DAY}, {PAIRS}, {_SCORED}, c2 AS (SELECT sc.alpha_id FROM sc JOIN pr ON pr.a = sc.alpha_id AND pr.b = (SELECT alpha_id FROM c1) WHERE sc.alpha_id <> (SELECT alpha_id FROM c1) ORDER BY s - 0.5 * abs(corr) DESC, s DESC, sc.alpha_id LIMIT 1)
 SELECT 0::INT AS place, alpha_id FROM c1 UNION ALL SELECT 1::INT, alpha_id FROM c2""")
def greedy_selection(spark, sf_dir):
    names = sel.select_diverse(_daily(spark, sf_dir), 2)
    return spark.createDataFrame(list(enumerate(names)), "place int, alpha_id string")


_CONFIGS = "cf AS (SELECT o_orderkey AS config_id, o_totalprice AS gain, (o_custkey % 97)::DOUBLE AS cost FROM orders)"


def _configs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("config_id"), F.col("o_totalprice").alias("gain"), (F.col("o_custkey") % 97).cast("double").alias("cost"))


@query("pareto_front", f"""WITH {_CONFIGS}, gn AS (SELECT gain, min(cost) AS m FROM cf GROUP BY 1), ab AS (SELECT gain, m, min(m) OVER (ORDER BY gain DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM gn)
 SELECT config_id, cost = m AND (above IS NULL OR cost < above) AS is_pareto FROM cf JOIN ab USING (gain)""")
def pareto_front(spark, sf_dir):
    return sel.pareto(_configs(spark, sf_dir), ["gain"], ["cost"]).select("config_id", "is_pareto")


@query("constraints", f"WITH {_CONFIGS} SELECT config_id, {r('greatest(cost - 40, 0) + greatest(100000 - gain, 0)')} AS violation, cost <= 40 AND gain >= 100000 AS feasible FROM cf")
def constraints(spark, sf_dir):
    return tidy(sel.constrain(_configs(spark, sf_dir), most={"cost": 40.0}, least={"gain": 100000.0}).select("config_id", "violation", "feasible"))


_GOOD = "gd AS (SELECT *, (gain - min(gain) OVER ()) / nullif(max(gain) OVER () - min(gain) OVER (), 0) AS g1, 1 - (cost - min(cost) OVER ()) / nullif(max(cost) OVER () - min(cost) OVER (), 0) AS g2 FROM cf)"


@query("goodness", f"WITH {_CONFIGS}, {_GOOD} SELECT config_id, {r('coalesce(g1, 1)')} AS gain_good, {r('coalesce(g2, 1)')} AS cost_good FROM gd")
def goodness(spark, sf_dir):
    return tidy(sel.goodness(_configs(spark, sf_dir), {"gain": "gain_good", "cost": "cost_good"}, {"cost": False}).select("config_id", "gain_good", "cost_good"))


@query("knee_point", f"WITH {_CONFIGS}, {_GOOD} SELECT config_id, {r('sqrt((1 - g1) * (1 - g1) + (1 - g2) * (1 - g2))')} AS distance FROM gd ORDER BY sqrt((1 - g1) * (1 - g1) + (1 - g2) * (1 - g2)), config_id LIMIT 1")
def knee_point(spark, sf_dir):
    return tidy(sel.knee(_configs(spark, sf_dir), ["gain"], ["cost"]).select("config_id", "distance"))


@query("utility", f"WITH {_CONFIGS}, {_GOOD} SELECT config_id, {r('0.7 * g1 + 0.3 * g2')} AS utility FROM gd")
def utility(spark, sf_dir):
    return tidy(sel.utility(_configs(spark, sf_dir), {"gain": 0.7, "cost": -0.3}).select("config_id", "utility"))


def path_sql(pre: str, held: str, cal: str, ret: str, keys: list[str], by: list[str], every: str = "", rates: tuple = (3, 1, 50)) -> str:
    """CTEs from held weights (keys, i, instrument, w) to the table ``{pre}day``: costs without impact.  ``every``: the keys that have a row on all dates."""
    k = lambda a="": ", ".join(f"{a}{c}" for c in keys)
    same = lambda a, b, cols: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols) or "true"
    cols = ("gross_return", "turnover", "traded", "gross_short", "gross_long", "borrow_unit")
    linear, spread, borrow = rates
    day = f"""{pre}mv AS (SELECT {k()}, i, instrument, w, 0.0 AS b FROM {held} UNION ALL SELECT {k()}, i + 1, instrument, 0.0, w FROM {held}),
 {pre}tr AS (SELECT {k()}, i, instrument, sum(w) AS w, abs(sum(w) - sum(b)) AS d FROM {pre}mv GROUP BY {k()}, i, instrument),
 {pre}tt AS (SELECT {k('t.')}, c.next, w, d, coalesce(x.ret, 0) AS ret FROM {pre}tr t JOIN {cal} c ON c.i = t.i AND {same('c', 't', by)} LEFT JOIN {ret} x ON x.datetime = c.next AND x.instrument = t.instrument AND {same('x', 't', by)} WHERE c.next IS NOT NULL),
 {pre}dp AS (SELECT {k()}, next AS datetime, sum(w * ret) AS gross_return, sum(d) / 2 AS turnover, sum(d) AS traded, sum(greatest(-w, 0)) AS gross_short, sum(greatest(w, 0)) AS gross_long, sum(greatest(-w, 0) * {borrow}) / 1e4 / 252 AS borrow_unit FROM {pre}tt GROUP BY {k()}, next)"""
    source = f"{pre}dp"
    if every:
        day += f""",
 {pre}ev AS (SELECT {k('a.')}, c.next AS datetime, {", ".join(f"coalesce(d.{c}, 0) AS {c}" for c in cols)} FROM {every} a JOIN {cal} c ON {same('a', 'c', by)} AND c.next IS NOT NULL LEFT JOIN {pre}dp d ON {same('d', 'a', keys)} AND d.datetime = c.next)"""
        source = f"{pre}ev"
    return day + f""",
 {pre}day AS (SELECT *, linear_cost + spread_cost + borrow_cost AS total_cost, gross_return - (linear_cost + spread_cost + borrow_cost) AS net_return FROM (SELECT *, turnover * {linear} / 1e4 AS linear_cost, traded * {spread} / 1e4 AS spread_cost, 0.0 AS impact_cost, borrow_unit AS borrow_cost FROM {source}))"""


WFK = ["alpha_id", "split_id", "segment", "sign"]
_WG = "PARTITION BY alpha_id, split_id, segment, sign, datetime"
WALK = f"""WITH {FACTOR_SQL}, dts AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS d FROM (SELECT DISTINCT datetime FROM panel)), nd AS (SELECT count(*) AS n FROM dts),
 sp AS (SELECT k FROM (SELECT unnest(range(0, 200)) AS k), nd WHERE 80 * k + 200 <= n AND (k = 0 OR 80 * k + 200 < n)),
 seg AS (SELECT k AS split_id, 'train' AS segment, 0 AS lo, 80 * k + 119 AS hi FROM sp UNION ALL SELECT k, 'valid', 80 * k + 120, 80 * k + 159 FROM sp UNION ALL SELECT k, 'test', 80 * k + 160, 80 * k + 199 FROM sp),
 sd AS (SELECT split_id, segment, datetime, d - lo AS i, lead(datetime) OVER (PARTITION BY split_id, segment ORDER BY datetime) AS next FROM dts JOIN seg ON d BETWEEN lo AND hi),
 rt AS (SELECT split_id, segment, datetime, instrument, close / lag(close) OVER (PARTITION BY split_id, segment, instrument ORDER BY datetime) - 1 AS ret FROM panel JOIN sd USING (datetime)),
 sf AS (SELECT f.alpha_id, s.split_id, s.segment, g.sign, f.datetime, f.instrument, f.value * g.sign AS value, s.i, s.next FROM factors f JOIN sd s USING (datetime) CROSS JOIN (SELECT unnest([1, -1]) AS sign) g),
 ak AS (SELECT DISTINCT alpha_id, split_id, segment, sign FROM sf),
 rn AS (SELECT *, row_number() OVER ({_WG} ORDER BY value, instrument) AS rn, count(*) OVER ({_WG}) AS n FROM sf WHERE value IS NOT NULL AND next IS NOT NULL AND i % 4 = 0),
 bb AS (SELECT *, {bucket_sql()} AS bucket FROM rn WHERE n >= {MIN_OBS}), cn AS (SELECT *, count(*) FILTER (bucket = 4) OVER ({_WG}) AS nl, count(*) FILTER (bucket = 0) OVER ({_WG}) AS ns FROM bb),
 tg AS (SELECT alpha_id, split_id, segment, sign, i, instrument, CASE WHEN bucket = 4 THEN 0.5 / nl ELSE -0.5 / ns END AS weight FROM cn WHERE bucket IN (0, 4) AND nl > 0 AND ns > 0),
 la AS (SELECT split_id, segment, max(i) AS last FROM sd GROUP BY 1, 2),
 hw AS (SELECT t.alpha_id, t.split_id, t.segment, t.sign, c.i, t.instrument, sum(t.weight / 2) AS w FROM tg t JOIN la ON la.split_id = t.split_id AND la.segment = t.segment JOIN sd c ON c.split_id = t.split_id AND c.segment = t.segment AND c.i >= t.i AND c.i < least(t.i + 8, la.last) GROUP BY 1, 2, 3, 4, 5, 6 HAVING abs(sum(t.weight / 2)) > 1e-12),
 {path_sql('w', 'hw', 'sd', 'rt', WFK, ['split_id', 'segment'], 'ak')}"""


def best_sql(day: str = "wday", keys: str = "") -> str:
    ir = "coalesce(avg(net_return) / nullif(stddev_samp(net_return), 0), 0)"
    return f"(SELECT {keys}alpha_id, split_id, arg_max(sign, row(ir, sign)) AS sign FROM (SELECT {keys}alpha_id, split_id, sign, {ir} AS ir FROM {day} WHERE segment = 'train' GROUP BY ALL) GROUP BY ALL)"


_BEST = f"{WALK}, bs AS {best_sql()}, wk AS (SELECT w.* FROM wday w JOIN bs USING (alpha_id, split_id, sign))"


def _walk(spark, sf_dir):
    panel, values = factors(spark, sf_dir)
    return sel.walk_forward(values, panel, FAST, WF)


@query("walk_forward_oos", f"{_BEST} SELECT alpha_id, split_id::BIGINT AS split_id, sign::BIGINT AS sign, datetime, {r('gross_return')} AS gross_return, {r('net_return')} AS net_return FROM wk WHERE segment = 'test'")
def walk_forward_oos(spark, sf_dir):
    return tidy(sel.out_of_sample(_walk(spark, sf_dir)).select("alpha_id", "split_id", "sign", "datetime", "gross_return", "net_return"))


_R = "coalesce(avg(net_return) FILTER (segment = '{0}') / nullif(stddev_samp(net_return) FILTER (segment = '{0}'), 0), 0) * sqrt(252)"


@query("walk_forward_stability", f"""{_BEST}, ea AS (SELECT alpha_id, split_id, {_R.format('train')} AS tr, {_R.format('test')} AS te FROM wk GROUP BY 1, 2)
 SELECT alpha_id, count(*) AS n_splits, {r('avg(te)')} AS ir_mean, {r('stddev_samp(te)')} AS ir_std, {r('min(te)')} AS ir_min, {r('median(te)')} AS ir_median, {r('max(te)')} AS ir_max, {r('avg((te > 0)::INT)')} AS positive_frac, {r('avg(tr - te)')} AS train_test_gap FROM ea GROUP BY 1""")
def walk_forward_stability(spark, sf_dir):
    return tidy(sel.stability(_walk(spark, sf_dir)))


_SCHEDULE = "UNION ALL".join(f" SELECT {i}::BIGINT AS config_id, '{c}' AS config, {a} AS reb, {h} AS hold " for i, (c, a, h) in enumerate([("", 4, 8), ("rebalance_days=4, holding_days=8", 4, 8), ("rebalance_days=8, holding_days=8", 8, 8)]))
_SWEPT = f"""WITH {FACTOR_SQL}, {CAL}, gr AS ({_SCHEDULE}), rt AS (SELECT datetime, instrument, close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS ret FROM panel),
 rn AS (SELECT config_id, config, hold, ceil(hold / reb) AS sl, f.*, i, row_number() OVER (PARTITION BY config_id, alpha_id, datetime ORDER BY value, instrument) AS rn, count(*) OVER (PARTITION BY config_id, alpha_id, datetime) AS n FROM factors f JOIN cal USING (datetime) JOIN gr ON i % reb = 0 WHERE next IS NOT NULL AND value IS NOT NULL),
 bb AS (SELECT *, {bucket_sql()} AS bucket FROM rn WHERE n >= {MIN_OBS}), cn AS (SELECT *, count(*) FILTER (bucket = 4) OVER (PARTITION BY config_id, alpha_id, datetime) AS nl, count(*) FILTER (bucket = 0) OVER (PARTITION BY config_id, alpha_id, datetime) AS ns FROM bb),
 hw AS (SELECT t.config_id, t.config, t.alpha_id, c.i, t.instrument, sum(CASE WHEN bucket = 4 THEN 0.5 / nl ELSE -0.5 / ns END / sl) AS w FROM cn t JOIN cal c ON c.i >= t.i AND c.i < least(t.i + hold, (SELECT max(i) FROM cal)) WHERE bucket IN (0, 4) AND nl > 0 AND ns > 0 GROUP BY 1, 2, 3, 4, 5 HAVING abs(sum(CASE WHEN bucket = 4 THEN 0.5 / nl ELSE -0.5 / ns END / sl)) > 1e-12),
 {path_sql('s', 'hw', 'cal', 'rt', ['config_id', 'config', 'alpha_id'], [], '(SELECT DISTINCT config_id, config, alpha_id FROM hw)')}"""


@query("schedule_sweep", f"{_SWEPT} SELECT config_id, config, alpha_id, {r('avg(turnover)')} AS turnover_mean FROM sday GROUP BY 1, 2, 3")
def schedule_sweep(spark, sf_dir):
    panel, values = factors(spark, sf_dir)
    return tidy(sel.schedule_sweep(values, panel, FAST, (4, 8), (8,)).select("config_id", "config", "alpha_id", "turnover_mean"))


_PICK = "coalesce(avg(net_return) / nullif(stddev_samp(net_return), 0), 0) * sqrt(252)"


@query("best_schedule", f"{_SWEPT}, ci AS (SELECT config_id, config, alpha_id, {_PICK} AS ir FROM sday WHERE config_id > 0 GROUP BY 1, 2, 3) SELECT alpha_id, arg_max(config, row(ir, -config_id)) AS config, {r('max(ir)')} AS information_ratio FROM ci GROUP BY 1")
def best_schedule(spark, sf_dir):
    """Each alpha's best pair of the sweep."""
    panel, values = factors(spark, sf_dir)
    return tidy(sel.best_schedule(values, panel, FAST, (4, 8), (8,)))


_FLAGS = {"no_costs": (0, 0, 0, 0), "linear_only": (1, 0, 0, 0), "linear_spread": (1, 1, 0, 0), "linear_spread_impact": (1, 1, 1, 0), "full": (1, 1, 1, 1)}
_SCENARIO = "UNION ALL".join(f" SELECT '{n}' AS scenario, {a} AS fl, {b} AS fs, {i} AS fi, {c} AS fb " for n, (a, b, i, c) in _FLAGS.items())
#: The impact of a walk-forward's trades; mean traded values know nothing before their segment.
_IMPACT = f"""sg AS (SELECT s.split_id, s.segment, s.i, n.instrument, close * volume AS money FROM sd s JOIN (SELECT DISTINCT split_id, segment, instrument FROM rt) n ON n.split_id = s.split_id AND n.segment = s.segment LEFT JOIN panel p ON p.datetime = s.datetime AND p.instrument = n.instrument),
 sa AS (SELECT split_id, segment, i, instrument, CASE WHEN count(money) OVER f >= {CFG.min_window_obs} THEN avg(money) OVER f END AS adv FROM sg WINDOW f AS (PARTITION BY split_id, segment, instrument ORDER BY i ROWS BETWEEN {CFG.window} PRECEDING AND 1 PRECEDING)),
 um AS (SELECT split_id, segment, i, quantile_cont(adv, 0.5) AS mid FROM sa GROUP BY 1, 2, 3),
 iu AS (SELECT alpha_id, split_id, segment, sign, next AS datetime, sum(d * pow(least(d * 1e6 / nullif(coalesce(adv, mid, 1), 0), 0.2), 0.5)) AS impact_unit FROM wtr JOIN sd USING (split_id, segment, i) LEFT JOIN sa USING (split_id, segment, i, instrument) LEFT JOIN um USING (split_id, segment, i) WHERE next IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


@query("end_to_end_ablation", f"""{WALK}, {_IMPACT}, sc AS ({_SCENARIO}), ab AS (SELECT scenario, alpha_id, split_id, segment, sign, datetime, turnover, gross_return - fl * linear_cost - fs * spread_cost - fi * coalesce(impact_unit, 0) * 10 / 1e4 - fb * borrow_cost AS net_return FROM wday LEFT JOIN iu USING (alpha_id, split_id, segment, sign, datetime) CROSS JOIN sc),
 bs AS {best_sql('ab', 'scenario, ')} SELECT scenario, alpha_id, {r('avg(net_return)', 8)} AS net_mean, {r('avg(turnover)')} AS turnover_mean FROM ab JOIN bs USING (scenario, alpha_id, split_id, sign) WHERE segment = 'test' GROUP BY 1, 2""")
def end_to_end_ablation(spark, sf_dir):
    """The walk-forward done again under each cost scenario, signs included; impact is one of the costs."""
    panel, values = factors(spark, sf_dir)
    rows = sel.end_to_end_ablation(values, panel, CFG, WF)
    return rows.select("scenario", "alpha_id", rounded(F.col("mean"), 8).alias("net_mean"), rounded(F.col("turnover_mean")).alias("turnover_mean"))


_EQUAL = f"""{_BEST}, eh AS (SELECT split_id, segment, i, instrument, sum(w) / 3 AS w FROM hw JOIN bs USING (alpha_id, split_id, sign) WHERE segment = 'test' GROUP BY 1, 2, 3, 4), ek AS (SELECT DISTINCT split_id, segment FROM eh),
 {path_sql('e', 'eh', 'sd', 'rt', ['split_id', 'segment'], ['split_id', 'segment'], 'ek')}"""


@query("ensemble_equal", f"{_EQUAL} SELECT split_id::BIGINT AS split_id, datetime, {r('gross_return')} AS gross_return, {r('turnover')} AS turnover, {r('net_return')} AS net_return FROM eday")
def ensemble_equal(spark, sf_dir):
    """The equally weighted holdings of all alphas, out of sample."""
    panel, values = factors(spark, sf_dir)
    paths = sel.walk_forward(values, panel, FAST, WF)
    out = ens.equal(values, panel, sel.chosen_signs(paths), sel.segments(panel, WF), FAST)
    return tidy(ens.out_of_sample(out).select("split_id", "datetime", "gross_return", "turnover", "net_return"))


@query("ensemble_allocated")
def ensemble_allocated(spark, sf_dir):
    """Holdings blended with weights that each split's training and validation dates teach, tuned settings."""
    panel, values = factors(spark, sf_dir)
    paths = kept(sel.walk_forward(values, panel, FAST, WF))
    out, _ = ens.allocated(values, panel, paths, sel.segments(panel, WF), FAST, tune=True)
    return tidy(ens.out_of_sample(out).select("split_id", "datetime", "gross_return", "turnover", "net_return"))


@query("ensemble_regime")
def ensemble_regime(spark, sf_dir):
    """Holdings blended by the regime of the date."""
    panel, values = factors(spark, sf_dir)
    paths = kept(sel.walk_forward(values, panel, FAST, WF))
    out = ens.regime_blend(values, panel, paths, sel.segments(panel, WF), FAST, window=8, n_buckets=2, smoothing=0.3)
    return tidy(ens.out_of_sample(out).select("split_id", "datetime", "gross_return", "turnover", "net_return"))


@query("ensemble_revalidated")
def ensemble_revalidated(spark, sf_dir):
    """The best regime settings by returns, judged again on holdings."""
    panel, values = factors(spark, sf_dir)
    paths = kept(sel.walk_forward(values, panel, FAST, WF))
    features = {8: ens.market_frame(panel, 8)}
    tuned = tuning.tune_regimes(spark, tuning.split_returns(paths), features, tuning.regime_grid(window=(8,), n_buckets=(2, 3), smoothing=(0.0,)), turnover_cost_bps=5.0)
    rows = ens.revalidate(values, panel, paths, sel.segments(panel, WF), FAST, tuned["results"], top=2)["results"]
    return tidy(spark.createDataFrame([(x["mode"], x["n_buckets"], float(x["objective"]), float(x["holdings_objective"]), x["is_feasible"]) for x in rows], "mode string, n_buckets int, objective double, holdings_objective double, is_feasible boolean"))


@query("allocation_tuning")
def allocation_tuning(spark, sf_dir):
    panel, values = factors(spark, sf_dir)
    rows = tuning.tune_allocation(spark, tuning.split_returns(sel.walk_forward(values, panel, FAST, WF)))["results"]
    return tidy(spark.createDataFrame([(float(x["penalty"]), float(x["cap"]), float(x["turnover"]), float(x["valid_metric"]), x["n_splits_used"], float(x["allocation_turnover_mean"])) for x in rows], "penalty double, cap double, turnover double, valid_metric double, n_splits_used int, allocation_turnover_mean double"))


@query("selection_tuning")
def selection_tuning(spark, sf_dir):
    """The greedy choice tuned on the validation segments."""
    valid = kept(_walk(spark, sf_dir).where("segment = 'valid'").select("alpha_id", "datetime", "net_return"))
    rows = sel.tune_selection(valid, pools=(2, 3), penalties=(0.0, 0.5), ks=(1, 2))["results"]
    return tidy(spark.createDataFrame([(x["pool"], float(x["penalty"]), x["k"], ",".join(x["alphas"]), float(x["valid_ir"])) for x in rows], "pool int, penalty double, k int, alphas string, valid_ir double"))


@query("allocation")
def allocation(spark, sf_dir):
    return tidy(sel.allocate(_daily(spark, sf_dir), cap=0.6))


@query("regime_allocation")
def regime_allocation(spark, sf_dir):
    return tidy(sel.allocate(_daily(spark, sf_dir), _labels(spark, sf_dir), cap=0.6))


@query("daily_allocation")
def daily_allocation(spark, sf_dir):
    """One panel for the paths and the labels; the rows of both (one a date) are kept, as the allocation reads them several times."""
    panel, daily = _traded(spark, sf_dir)
    labels = kept(_labels_of(kept(risk.market_features(panel, CFG.window))))
    return tidy(sel.daily_allocation(sel.allocate(kept(daily), labels), labels, 0.5))


@query("regime_tuning")
def regime_tuning(spark, sf_dir):
    panel, values = factors(spark, sf_dir)
    splits = tuning.split_returns(sel.walk_forward(values, panel, FAST, WF))
    out = tuning.tune_regimes(spark, splits, {8: ens.market_frame(panel, 8)}, tuning.regime_grid(window=(8,), n_buckets=(2, 3), smoothing=(0.0, 0.5)), turnover_cost_bps=5.0, method="knee")
    rows = [(x["config_id"], x["mode"], x["n_buckets"], float(x["smoothing"]), float(x["objective"]), float(x["alpha_weight_turnover_mean"]), float(x["regime_switch_rate_mean"]), x["is_pareto"]) for x in out["results"]]
    return tidy(spark.createDataFrame(rows, "config_id int, mode string, n_buckets int, smoothing double, objective double, alpha_weight_turnover_mean double, regime_switch_rate_mean double, is_pareto boolean"))


def _held(spark, sf_dir):
    panel, values = factors(spark, sf_dir)
    return panel, pf.held_weights(pf.target_weights(values, panel, CFG, hard_to_borrow=hard_to_borrow(spark, sf_dir)), panel, CFG)


@query("holdings_ensemble", f"{DAY} SELECT datetime, instrument, {r('sum(w) / 3')} AS weight FROM hw GROUP BY 1, 2")
def holdings_ensemble(spark, sf_dir):
    return tidy(sel.holdings_ensemble(_held(spark, sf_dir)[1]))


@query("optimized_weights")
def optimized_weights(spark, sf_dir):
    """Ridge-optimised legs with beta control."""
    panel, values = factors(spark, sf_dir)
    exposure = risk.exposures(panel, 8, 4)
    targets = pf.target_weights(values, panel, CFG)
    return tidy(sel.optimized_targets(targets, values, exposure, ["beta"], ["alpha_id"], most=0.1))


@query("factor_risk_model")
def factor_risk_model(spark, sf_dir):
    """Variances of the names of the last date: loadings are each name's beta and log ADV, returns those of the last 400 days."""
    panel, _ = factors(spark, sf_dir)
    e = kept(risk.exposures(panel, 8, 4))
    last = e.agg(F.max("datetime").alias("last"))
    recent = e.crossJoin(F.broadcast(last)).where(F.col("datetime") > F.col("last") - F.expr("interval 400 days"))
    loadings = recent.where(F.col("datetime") == F.col("last")).select("instrument", "beta", "log_adv")
    returns = recent.select("datetime", "instrument", F.least(F.greatest("ret", F.lit(-1.0)), F.lit(1.0)).alias("ret"))
    model = factor_model.factor_risk_model(returns, loadings, ["beta", "log_adv"])
    return tidy(model.names.select("instrument", "variance", "specific"))


@query("oos_attribution", f"""{_BEST}, ea AS (SELECT alpha_id, split_id, count(*) AS n, {", ".join(f"avg({c}) AS {c}" for c in ("turnover", "linear_cost", "spread_cost", "impact_cost", "borrow_cost", "total_cost"))} FROM wk WHERE segment = 'test' GROUP BY 1, 2)
 SELECT alpha_id, sum(n)::BIGINT AS n_obs, {", ".join(f"{r(f'sum({c} * n) / sum(n)')} AS {c}_mean" for c in ("turnover", "linear_cost", "spread_cost", "impact_cost", "borrow_cost", "total_cost"))} FROM ea GROUP BY 1""")
def oos_attribution(spark, sf_dir):
    return tidy(reporting.attribution(_walk(spark, sf_dir)))


@query("holdings_against_average", f"""WITH {FACTOR_SQL}, {HELD}, rt AS (SELECT datetime, instrument, close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS ret FROM panel), eh AS (SELECT i, instrument, sum(w) / 3 AS w FROM hw GROUP BY 1, 2), ew AS (SELECT 'ensemble' AS alpha_id, * FROM eh WHERE w <> 0),
 {path_sql('a', 'hw', 'cal', 'rt', ['alpha_id'], [], '(SELECT DISTINCT alpha_id FROM hw)')}, {path_sql('e', 'ew', 'cal', 'rt', ['alpha_id'], [], '(SELECT DISTINCT alpha_id FROM ew)')}, av AS (SELECT datetime, avg(total_cost) AS c, avg(net_return) AS n FROM aday GROUP BY 1)
 SELECT count(*) AS n_obs, {r('avg(c - total_cost) * 1e4')} AS cost_saving_bps, {r('avg(net_return - n) * 1e4')} AS net_delta_bps FROM eday JOIN av USING (datetime)""")
def holdings_against_average(spark, sf_dir):
    """The holdings ensemble, priced again, against the average of the alphas."""
    panel, held = _held(spark, sf_dir)
    path = pf.daily_path(sel.holdings_ensemble(held).withColumn("alpha_id", F.lit("ensemble")), panel, FAST)
    return tidy(reporting.holdings_against_average(path, _daily(spark, sf_dir, FAST)))


@query("constraint_slack", f"WITH {_CONFIGS} SELECT config_id, 'max_cost' AS \"constraint\", cost AS actual, 40.0::DOUBLE AS bound, 40 - cost AS slack FROM cf")
def constraint_slack(spark, sf_dir):
    return reporting.slack(_configs(spark, sf_dir), {"max_cost": 40.0})


@query("utility_presets", "SELECT 'alpha_weight_turnover_mean' AS metric, 0.5::DOUBLE AS weight UNION ALL SELECT 'regime_switch_rate_mean', 0.3::DOUBLE UNION ALL SELECT 'fallback_frac_mean', 0.15::DOUBLE")
def utility_presets(spark, sf_dir):
    p = presets.REGIME_TUNING["low_turnover"]
    w = presets.utility_weights(p["turnover_cost_bps"], p["constraints"])
    return spark.createDataFrame([(m, w[m]) for m in ("alpha_weight_turnover_mean", "regime_switch_rate_mean", "fallback_frac_mean")], "metric string, weight double")


__all__ = ["MIN_OBS"]
