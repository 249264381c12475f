"""Range windows, recursions, sliding order and regressions against pandas and NumPy."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom import plans
from factorloom.operators import factor_model, optimizer
from factorloom.operators import portfolio as pf
from factorloom.operators import risk
from factorloom.operators import selection as sel
from factorloom.plans import scans

START = datetime(2020, 1, 1)


def plain_exposures(rows, window, min_obs):
    """Dense tables of date x name, as pandas has them: missing rows are zero returns after the first close."""
    wide = pd.DataFrame(rows, columns=["datetime", "instrument", "close", "volume"]).astype({"close": float, "volume": float})
    close, volume = (wide.pivot(index="datetime", columns="instrument", values=c).sort_index() for c in ("close", "volume"))
    known = close.ffill()
    ret = (known / known.shift(1).where(known.shift(1) != 0) - 1)
    mkt = ret.mean(axis=1).fillna(0.0)
    roll = lambda x: x.rolling(window, min_periods=min_obs)
    vol = roll(ret).std().shift(1)
    adv = roll(close * volume).mean().shift(1)
    m = ret.notna().mul(mkt, axis=0).where(ret.notna())
    spread = roll(m * m).mean() - roll(m).mean() ** 2
    beta = ((roll(ret * m).mean() - roll(ret).mean() * roll(m).mean()) / spread.where(spread > 1e-10 * roll(m * m).mean())).shift(1)
    return {"ret": ret, "volatility": vol, "adv": adv, "log_adv": np.log1p(adv), "beta": beta}, mkt


def gappy(share, seed, names=12, dates=70):
    rng = random.Random(seed)
    days = [START + timedelta(days=i) for i in range(dates)]
    return [(d, f"n{n}", rng.choice([None, 0.0] + [10 + rng.random() for _ in range(12)]), rng.choice([None] + [100 * rng.random() for _ in range(9)])) for n in range(names) for d in days if rng.random() < share]


@pytest.mark.parametrize("share,window,min_obs", [(0.1, 5, 2), (0.1, 20, 3), (0.6, 8, 8), (1.0, 20, 5)])
def test_exposures_of_panels_with_gaps(spark, share, window, min_obs):
    rows = gappy(share, window)
    panel = spark.createDataFrame(rows, "datetime timestamp, instrument string, close double, volume double").persist()
    want, _ = plain_exposures(rows, window, min_obs)
    got = risk.exposures(panel, window, min_obs).toPandas()
    assert len(got) == len(rows)  # a row for each row of the panel, none for missing dates
    every = panel.select("datetime").distinct().crossJoin(panel.select("instrument").distinct()).withColumns({"q": F.lit(3), "ret": F.lit("own")})
    asked = risk.exposures(panel, window, min_obs, every).toPandas()
    assert len(asked) == every.count() and set(asked.ret) == {"own"} and set(asked.q) == {3}
    for c, table in want.items():
        own = [table.loc[d, n] for d, n in zip(got.datetime, got.instrument)]
        np.testing.assert_allclose(got[c].to_numpy(float), own, atol=1e-9, rtol=1e-7, err_msg=c)
        if c != "ret":
            np.testing.assert_allclose(asked[c].to_numpy(float), [table.loc[d, n] for d, n in zip(asked.datetime, asked.instrument)], atol=1e-9, rtol=1e-7, err_msg=c)
    mid = risk.usual_volume(panel, window, min_obs).toPandas().set_index("datetime").mid.sort_index()
    pd.testing.assert_series_equal(mid, want["adv"].median(axis=1).dropna(), check_names=False)
    assert "explode" not in risk.exposures(panel, window, min_obs)._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("share", [0.1, 0.9])
def test_market_features_of_panels_with_gaps(spark, share):
    rows = gappy(share, 3)
    panel = spark.createDataFrame(rows, "datetime timestamp, instrument string, close double, volume double")
    got = risk.market_features(panel, 6).toPandas().set_index("datetime").sort_index()
    want, mkt = plain_exposures(rows, 6, 6)
    full = mkt.rolling(6)
    np.testing.assert_allclose(got.mkt_ret, mkt, atol=1e-12)
    np.testing.assert_allclose(got.mkt_vol, full.std().shift(1), atol=1e-9)
    np.testing.assert_allclose(got.mkt_trend, full.mean().shift(1), atol=1e-9)
    np.testing.assert_allclose(got.xs_disp, want["ret"].std(axis=1).rolling(6).mean().shift(1), atol=1e-9)
    np.testing.assert_allclose(got.mkt_liq, np.log1p(want["adv"].mean(axis=1)), atol=1e-9)


def test_parts_of_a_panel_are_panels_of_their_own(spark):
    rows = gappy(0.6, 4)
    panel = spark.createDataFrame(rows, "datetime timestamp, instrument string, close double, volume double").persist()
    parts = panel.withColumn("split_id", F.explode(F.array(F.lit(0), F.lit(1)))).where("split_id = 0 or dayofyear(datetime) > 25")
    late = risk.exposures(parts, 6, 3).where("split_id = 1").drop("split_id").toPandas().sort_values(["instrument", "datetime"]).reset_index(drop=True)
    alone = risk.exposures(panel.where("dayofyear(datetime) > 25"), 6, 3).toPandas().sort_values(["instrument", "datetime"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(late, alone[late.columns])


@pytest.mark.parametrize("change", [{}, {"holding_days": 3, "rebalance_days": 7}, {"half_spread_bps": 2.0}])
def test_engines_agree_on_a_panel_with_gaps(spark, change):
    """A book of names without rows on many dates: the stepwise engine and the relational one give one path."""
    rng = random.Random(6)
    days = [START + timedelta(days=i) for i in range(60)]
    rows = [(d, f"n{n}", 10 * (1 + 0.1 * rng.random()), 100 * rng.random()) for n in range(15) for d in days if rng.random() < 0.4]
    panel = spark.createDataFrame(rows, "datetime timestamp, instrument string, close double, volume double").persist()
    values = panel.select(F.lit("a").alias("alpha_id"), "datetime", "instrument", (F.col("close") % 1).alias("value"))
    cfg = pf.Backtest(min_obs=3, n_quantiles=3, window=6, min_window_obs=2, impact_bps=10.0, notional=1e4, **{"holding_days": 6, "rebalance_days": 3, **change})
    rates = panel.where("instrument < 'n5'").select("datetime", "instrument", (F.col("volume") * 5).alias("borrow_bps"))
    a, b = (pf.backtest(values, panel, pf.with_config(cfg, turnover_cap=cap), rates=rates).toPandas().set_index("datetime").sort_index() for cap in (0.0, 99.0))
    assert len(a) == len(b) == len(days) - 1 and a.impact_unit.abs().sum() > 0
    for c in ("gross_return", "turnover", "impact_unit", "borrow_unit", "net_return"):
        np.testing.assert_allclose(a[c], b[c], atol=1e-12, err_msg=c)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(1)
    days = [START + timedelta(days=i) for i in range(300)]
    fields = ["open", "high", "low", "close", "volume"]
    rows = [(d, f"n{n}", *[rng.choice([None] + [float(rng.randrange(1, 12)) for _ in range(6 + n * 4)]) for _ in fields]) for n in range(8) for d in days]
    panel = spark.createDataFrame(rows, "datetime timestamp, instrument string, " + ", ".join(f"{c} double" for c in fields)).persist()
    return panel, pd.DataFrame(rows, columns=["datetime", "instrument", *fields]).astype({c: float for c in fields})


PLAIN = {
    "ts_rank": lambda w: ((w < w[-1]).sum() + ((w == w[-1]).sum() + 1) / 2) / len(w),
    "ts_argmax": lambda w: float(np.argmax(w)),
    "ts_argmin": lambda w: float(np.argmin(w)),
    "ts_decay_linear": lambda w: (w * np.arange(1, len(w) + 1)).sum() / (len(w) * (len(w) + 1) / 2),
}


def test_windows_and_recursions_of_every_size(spark, series):
    """Windows below and above ``SMALL``, spans short and long, missing values, several items in one plan."""
    panel, rows = series
    texts = {f"{f}-{k}": f"{f}(close, {k})" for f in PLAIN for k in (1, 2, scans.SMALL, scans.SMALL + 1, 40, 120)}
    texts |= {f"{f}-{k}": f"{f}(close, {k})" for f in ("ewm_mean", "ewm_std") for k in (1, 2, 5, 50, 900)}
    got = plans.compile_factors(panel, texts | {"nested": "ewm_mean(ts_rank(close * 2, 20), 5)"}).toPandas().set_index(["instrument", "datetime"]).sort_index()
    for name, g in rows.groupby("instrument"):
        c = g.sort_values("datetime").close
        for e in texts:
            f, k = e.split("-")
            k = int(k)
            e_w = c.ewm(span=k, adjust=False)
            want = e_w.mean() if f == "ewm_mean" else e_w.std(bias=True) if f == "ewm_std" else c.rolling(k, min_periods=k).apply(PLAIN[f], raw=True)
            np.testing.assert_allclose(got.loc[name][e].to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=f"{name} {e}")
        nested = c.rolling(20, min_periods=20).apply(PLAIN["ts_rank"], raw=True).ewm(span=5, adjust=False).mean()
        np.testing.assert_allclose(got.loc[name].nested.to_numpy(float), nested.to_numpy(float), rtol=1e-9)


def test_recursions_stay_in_the_jvm_and_take_long_instruments(spark, series):
    """No Python in the plan; 60,000 rows of one instrument, weights that fall far below the range of doubles."""
    panel = spark.range(60_000).select(F.timestamp_seconds("id").alias("datetime"), F.lit("a").alias("instrument"), F.when(F.col("id") % 50 < 3, None).otherwise(F.sin("id") * 1000).alias("close"))
    texts = {"a": "ewm_mean(close, 3)", "b": "ewm_std(close, 400)", "c": "ts_decay_linear(close, 30)", "d": "ts_rank(close, 30)"}
    made = plans.compile_factors(panel, texts)
    for e in ("a", "b", "c"):
        assert "Arrow" not in plans.compile_factors(panel, {e: texts[e]})._jdf.queryExecution().executedPlan().toString()
    got = made.toPandas().sort_values("datetime")
    c = pd.Series([np.nan if i % 50 < 3 else np.sin(i) * 1000 for i in range(60_000)])
    np.testing.assert_allclose(got.a, c.ewm(span=3, adjust=False).mean(), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got.b, c.ewm(span=400, adjust=False).std(bias=True), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got.c.to_numpy(float), c.rolling(30).apply(PLAIN["ts_decay_linear"], raw=True), atol=1e-8)
    np.testing.assert_allclose(got.d.to_numpy(float), c.rolling(30).apply(PLAIN["ts_rank"], raw=True), atol=1e-12)


def residual(m):
    out, ok = np.full(len(m), np.nan), np.isfinite(m).all(axis=1)
    if ok.sum() > m.shape[1]:
        x = np.column_stack([np.ones(ok.sum()), m[ok, 1:]])
        out[ok] = m[ok, 0] - x @ np.linalg.lstsq(x, m[ok, 0], rcond=None)[0]
    return out


def test_regressions_against_least_squares(spark, series):
    """Several controls, also ones that depend on each other or are constant, and by group; too few rows have no residual."""
    panel, rows = series
    panel = panel.withColumn("sector", F.when(F.col("instrument") < "n4", "A").when(F.col("instrument") < "n6", "B"))
    texts = {"two": "cs_neutralize(close, volume, open)", "three": "cs_neutralize(close, volume, open, high)", "dependent": "cs_neutralize(close, volume, volume * 2, open, high - high)", "group": "cs_neutralize_group(close, sector, volume, open)"}
    got = plans.compile_factors(panel, texts).toPandas().set_index(["datetime", "instrument"]).sort_index()
    assert "Pandas" not in plans.compile_factors(panel, texts)._jdf.queryExecution().executedPlan().toString()
    some = 0
    for d, g in rows.set_index(["datetime", "instrument"]).sort_index().groupby(level=0):
        terms = {"two": [g.volume, g.open], "three": [g.volume, g.open, g.high], "dependent": [g.volume, g.volume * 2, g.open, g.high - g.high]}
        for e, xs in terms.items():
            want = residual(np.column_stack([g.close, *xs]))
            some += np.isfinite(want).sum()
            np.testing.assert_allclose(got.loc[d][e].to_numpy(float), want, atol=1e-9, err_msg=e)
        sector = np.array(["A" if n < "n4" else "B" if n < "n6" else "-" for n in g.index.get_level_values(1)])
        want = np.full(len(g), np.nan)
        for s in "AB-":
            want[sector == s] = residual(np.column_stack([g.close, g.volume, g.open])[sector == s])
        np.testing.assert_allclose(got.loc[d].group.to_numpy(float), want, atol=1e-9)
    assert some > 1000


def test_weight_neutralization_against_a_plain_one(spark):
    rng = np.random.default_rng(0)
    rows, known = [], []
    for t in range(30):
        d = START + timedelta(days=t)
        for i in range(int(rng.integers(2, 20))):
            b = float(rng.normal())
            known.append((d, f"i{i}", None if rng.random() < 0.2 or t == 7 else b, float(15 + rng.normal()), float(2 * b) if t % 3 else 1.0, float(i % 2)))
            rows += [(a, d, f"i{i}", float(rng.normal())) for a in "xy"]
    w = spark.createDataFrame(rows, "alpha_id string, datetime timestamp, instrument string, weight double")
    e = spark.createDataFrame(known, "datetime timestamp, instrument string, beta double, adv double, two double, dummy double")
    columns = ["beta", "adv", "two", "dummy"]
    got = risk.neutralize(w, e, columns, ["alpha_id"]).toPandas().set_index(["alpha_id", "datetime", "instrument"]).sort_index()
    assert len(got) == len(rows)
    joined = w.join(e, ["datetime", "instrument"])
    again = risk.neutralize(joined, None, columns, ["alpha_id"]).toPandas().set_index(["alpha_id", "datetime", "instrument"]).sort_index()
    pd.testing.assert_frame_equal(got, again)
    for k, g in joined.toPandas().groupby(["alpha_id", "datetime"]):
        want = pd.Series(risk.residual_weights(g.weight.to_numpy(float), g[columns].to_numpy(float)), index=g.instrument).sort_index()
        np.testing.assert_allclose(got.loc[k].weight, want, atol=1e-8)


@pytest.mark.parametrize("n,shape,eps", [(1, "free", 1e-12), (2, "free", 1e-12), (2, "front", 1e-12), (2, "ties", 0.6), (2, "large", 1e-12), (3, "large", 1e-12), (3, "free", 1e-12), (3, "front", 1e-12), (3, "ties", 0.6), (4, "ties", 1e-12)])
def test_pareto_fronts_against_all_pairs(spark, n, shape, eps):
    """Fronts of one to four objectives, with ties, missing values, tolerances, and tables all of whose rows are on the front."""
    rng = np.random.default_rng(n)
    m = rng.normal(size=(1500, n)) if shape in ("free", "large") else rng.integers(0, 7, (1500, n)).astype(float)
    if shape == "large":
        m = np.round(m * 1e5, 2)  # eps is less than the last digit
    if shape == "front":
        m = rng.dirichlet(np.ones(n), 1500)  # the sum is the same, so none is above another
    names = [f"v{i}" for i in range(n)]
    rows = [(k, *map(float, r)) for k, r in enumerate(m)] + [(9_000, *[None] * n), (9_001, float("nan"), *[1.0] * (n - 1))]
    df = spark.createDataFrame(rows, "config_id long, " + ", ".join(f"{c} double" for c in names))
    got = {r.config_id: r.is_pareto for r in sel.pareto(df.repartition(5), names[:1], names[1:], eps=eps).collect()}
    up = m * np.array([1.0] + [-1.0] * (n - 1))
    want = {k: not ((up >= r - eps).all(axis=1) & (up > r + eps).any(axis=1)).any() for k, r in enumerate(up)}
    assert got == want


def test_pareto_plans_have_no_nested_loops(spark):
    df = spark.range(2000).select(F.col("id").alias("config_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    for xs in (["a"], ["a", "c"]):
        plan = sel.pareto(df, xs, ["b"])._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_correlations_of_more_alphas_than_a_block(spark, monkeypatch):
    """Blocks smaller than the number of alphas, missing dates, a constant series and too few common dates."""
    monkeypatch.setattr(sel, "BLOCK", 4)
    rng = np.random.default_rng(5)
    days = [START + timedelta(days=20 * i) for i in range(60)]
    wide = pd.DataFrame(rng.normal(size=(60, 11)) * 0.01 + 3.0, index=days, columns=[f"a{i:02d}" for i in range(11)])
    wide = wide.where(rng.random(wide.shape) < 0.8)
    wide["a03"], wide["a07"] = 2.5, wide["a06"].where(np.arange(60) < 10)
    rows = [(c, d.to_pydatetime(), None if np.isnan(v) else float(v)) for c in wide for d, v in wide[c].items()]
    got = sel.return_correlations(spark.createDataFrame(rows, "alpha_id string, datetime timestamp, net_return double"), min_periods=12).collect()
    counts = wide.notna().astype(int).T @ wide.notna().astype(int)
    assert {(r.a, r.b): r.n for r in got} == {(a, b): counts.loc[a, b] for a in wide for b in wide if counts.loc[a, b]}
    want = wide.corr(min_periods=12)
    for r in got:
        w = want.loc[r.a, r.b]
        assert (r["corr"] is None) == bool(np.isnan(w) or "a03" in (r.a, r.b)) and (r["corr"] is None or abs(r["corr"] - w) < 1e-9), (r, w)


@pytest.mark.parametrize("change", [{}, {"method": "oas"}, {"estimator": "ewm", "halflife": 10.0, "clip_sigma": 1.5}, {"specific_clip": 0.0, "specific_shrink": 0.0, "shrink": 0.0}])
def test_factor_risk_model_against_matrices(spark, change):
    """Names with gaps, missing loadings, names without returns and returns of names without loadings."""
    rng = np.random.default_rng(8)
    days = [START + timedelta(days=i) for i in range(70)]
    names = [f"n{i:02d}" for i in range(25)]
    x = np.where(rng.random((25, 2)) < 0.1, np.nan, rng.normal(size=(25, 2)))
    x = np.column_stack([x, np.ones(25)])
    r = np.where(rng.random((70, 25)) < 0.4, np.nan, 0.01 * rng.normal(size=(70, 25)) + 0.01 * rng.normal(size=(70, 1)) * np.nan_to_num(x[:, 0]))
    r[:, 3] = np.nan
    rows = [(d, n, float(r[i, j])) for i, d in enumerate(days) for j, n in enumerate(names) if not np.isnan(r[i, j])] + [(days[0], "other", 0.5), (days[40], "other", None)]
    rows += [(d, "other", 0.1) for d in days if not any(q[0] == d for q in rows)]
    returns = spark.createDataFrame(rows, "datetime timestamp, instrument string, ret double")
    loadings = spark.createDataFrame([(n, *(None if np.isnan(v) else float(v) for v in row)) for n, row in zip(names, x)], "instrument string, a double, b double, c double")
    got = factor_model.factor_risk_model(returns, loadings, ["a", "b", "c"], **change)
    want = optimizer.factor_risk_model(r, x, **change)
    table = got.names.toPandas().set_index("instrument").loc[names]
    np.testing.assert_allclose(got.factor_cov, want["factor_cov"], rtol=1e-7, atol=1e-12)
    np.testing.assert_allclose(table.specific, want["specific"], rtol=1e-8)
    np.testing.assert_allclose(table.variance, np.diag(want["covariance"]), rtol=1e-7)
    np.testing.assert_allclose(table[["a", "b", "c"]], want["loadings"], atol=1e-12)
    assert abs(got.shrinkage - want["shrinkage"]) < 1e-9 and abs(got.n_eff - want["n_eff"]) < 1e-9
    assert factor_model.factor_risk_model(returns, loadings.limit(3), ["a"]) is None and factor_model.factor_risk_model(returns.limit(0), loadings, ["a"]) is None


def _deals(df) -> int:
    """How often the plan deals rows out; of a table whose plan has not run yet."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_evaluation_ranks_once_and_its_summary_reads_it_once(spark):
    import datetime as dt

    from factorloom.operators import evaluation as ev

    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(i)
    rows = [(day(i), f"n{k}", float(10 + (i * 7 + k * 5) % 13), float((i * 3 + k * 11) % 17)) for i in range(12) for k in range(14) if (i * 5 + k) % 6]
    panel = spark.createDataFrame([(d, n, c) for d, n, c, _ in rows], "datetime timestamp, instrument string, close double")
    values = spark.createDataFrame([("a", d, n, v) for d, n, _, v in rows], "alpha_id string, datetime timestamp, instrument string, value double")
    whole = ev.evaluate(values, panel, min_obs=3, cost_bps=10)
    fwd = ev.forward_returns(panel)
    placed = ev.buckets(values, fwd, min_obs=3)
    got = {r.datetime: r for r in whole.collect()}
    legs, want, before = {}, {}, None
    for r in placed.collect():
        legs.setdefault(r.datetime, {}).setdefault(r.bucket, set()).add(r.instrument)
    for d in sorted(legs):
        want[d] = 0.0 if before is None else sum(1 - len(legs[before][b] & legs[d].get(b, set())) / len(legs[before][b]) for b in (0, 4) if b in legs[before]) / sum(b in legs[before] for b in (0, 4))
        before = d
    assert {d: pytest.approx(t) for d, t in want.items()} == {d: r.turnover for d, r in got.items() if r.turnover is not None}
    assert {r.datetime: pytest.approx(r.turnover) for r in ev.membership_turnover(placed).collect()} == want
    for r in ev.daily_ic(values, fwd, min_obs=3).collect():
        assert (got[r.datetime].n_obs, got[r.datetime].ic, got[r.datetime].rank_ic) == (r.n_obs, pytest.approx(r.ic), pytest.approx(r.rank_ic))
    for r in ev.quantile_spread(placed).collect():
        assert got[r.datetime].spread == pytest.approx(r.spread)
    # the summary adds at most one deal of the daily rows, it doesn't evaluate them again
    anew = lambda: ev.evaluate(values, panel, min_obs=3, cost_bps=10)
    assert _deals(ev.summarize(anew(), ["alpha_id"], "ls_return")) <= _deals(anew()) + 1


def test_summaries_of_paths_read_them_once(spark):
    rows = [("a", datetime(2020, 1, 1 + i), 0.1 * i, 0.01 * i - 0.02, *[0.001] * 5) for i in range(9)]
    columns = ["alpha_id", "datetime", "turnover", "net_return", "linear_cost", "spread_cost", "impact_cost", "borrow_cost", "total_cost"]
    daily = lambda: spark.createDataFrame(rows, columns).groupBy("alpha_id", "datetime").agg(*[F.sum(c).alias(c) for c in columns[2:]])
    assert _deals(pf.portfolio_summary(daily())) <= _deals(daily()) + 1
    assert pf.portfolio_summary(daily()).first().turnover_mean == pytest.approx(0.4)


def test_risk_exposures_have_each_name_on_each_date(spark):
    from factorloom import registry

    got = registry.QUERIES["risk_exposures"](spark, "/root/testdata/sf0.001").select("datetime", "instrument")
    assert got.count() == got.distinct().count() == got.select("datetime").distinct().count() * got.select("instrument").distinct().count()


def test_factors_that_carry_forward_returns_are_dealt_once_and_not_joined(spark):
    from factorloom import queries
    from factorloom.operators import evaluation as ev

    rows = [(START + timedelta(i), f"n{k}", float(10 + (i * 7 + k * 5) % 13), 5.0) for i in range(12) for k in range(14) if (i * 5 + k) % 6]
    panel = spark.createDataFrame(rows, "datetime timestamp, instrument string, close double, volume double")
    alphas = [{"alpha_id": "r", "dsl": "returns(close, 1)"}, {"alpha_id": "c", "dsl": "-close"}]
    carried = plans.run_factors(ev.with_forward_returns(panel), alphas, max_missing=1.0, also=("fwd",), deal="datetime").values
    apart = plans.run_factors(panel, alphas, max_missing=1.0).values
    days = lambda values: {(r.alpha_id, r.datetime): tuple(r)[2:] for r in ev.evaluate(values, panel, min_obs=3, cost_bps=10).collect()}
    got, want = days(carried), days(apart)
    assert got.keys() == want.keys() and len(got) > 15
    for k, row in want.items():
        assert got[k] == pytest.approx(row)
    plan = ev.buckets(carried, min_obs=3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(datetime") == 1
    # what the queries keep is the columns that are read, not the factors made of them
    values = queries.evaluated_factors(spark, "/root/testdata/sf0.001")[1]
    assert values.columns == ["alpha_id", "datetime", "instrument", "value", "fwd"]
    assert [len(x.columns) for x in queries._kept] == [4]


def test_allocation_reads_the_items_once(spark, monkeypatch):
    from factorloom import registry, sources

    calls, whole = [], sources.supplier_panel
    monkeypatch.setattr(sources, "supplier_panel", lambda *a: calls.append(a) or whole(*a))
    got = registry.QUERIES["daily_allocation"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and got.columns == ["datetime", "alpha_id", "weight"]


def test_walk_forward_keeps_the_training_path(spark):
    rows = [(START + timedelta(i), f"n{k}", float(10 + (i * 7 + k * 5) % 13), 5.0) for i in range(24) for k in range(10)]
    panel = spark.createDataFrame(rows, "datetime timestamp, instrument string, close double, volume double")
    values = plans.run_factors(panel, [{"alpha_id": "c", "dsl": "-close"}], max_missing=1.0).values
    paths = sel.walk_forward(values, panel, pf.Backtest(min_obs=3, rebalance_days=2, holding_days=2), sel.WalkForward(train=8, valid=4, test=4, step=4))
    plan = paths.where("segment = 'train'")._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan  # the signs were chosen from it, nothing is traded again


def test_events_of_a_date_are_packed_and_put_together():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"k": ["a", "b", "a", "a", "a"], "i": [1, 1, 1, 0, 1], "instrument": ["x", "x", "x", "", ""], "ret": [0.5, 0.25, None, None, None], "paid": [None, None, 7.0, None, None], "own": [None, None, None, 1.0, 1.0]})
    rows = rows.set_column(rows.schema.get_field_index("paid"), "paid", rows["paid"].cast(pa.float64()))
    got = {}
    for part in (rows.slice(0, 2), rows.slice(2)):  # as two tasks have them
        for r in pa.Table.from_batches(pf._pack([part], ["k", "i"], ["ret", "paid", "own"])).to_pylist():
            got.setdefault((r["k"], r["i"]), []).append(r["data"])
    assert sorted(got) == [("a", 0), ("a", 1), ("b", 1)]
    day = pf._unpack(got["a", 1], ["ret", "paid", "own"])
    assert day["instrument"].isna().tolist() == [True, False] and day["ret"].iloc[1] == 0.5 and day["paid"].iloc[1] == 7.0


def test_stepwise_deals_its_events_once(spark):
    rows = [(START + timedelta(i), f"n{k}", float(10 + (i * 7 + k * 5) % 13), 5.0) for i in range(12) for k in range(10)]
    panel = spark.createDataFrame(rows, "datetime timestamp, instrument string, close double, volume double")
    values = plans.run_factors(panel, [{"alpha_id": "c", "dsl": "-close"}], max_missing=1.0).values
    path = pf.backtest(values, panel, pf.Backtest(min_obs=3, rebalance_days=2, holding_days=2, turnover_cap=0.1), check=False)
    plan = path._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(alpha_id" in plan and ", i#" not in "".join(x for x in plan.splitlines() if "hashpartitioning(alpha_id" in x)
    assert path.count() == 11


def test_each_cost_of_the_end_to_end_ablation_has_an_effect(spark):
    from factorloom import registry

    got = registry.QUERIES["end_to_end_ablation"](spark, "/root/testdata/sf0.001").toPandas()
    net = got.pivot(index="alpha_id", columns="scenario", values="net_mean")[["no_costs", "linear_only", "linear_spread", "linear_spread_impact", "full"]]
    assert len(net) == 3 and (net.diff(axis=1).iloc[:, 1:] < 0).all(axis=None)  # each one adds a cost, impact too
