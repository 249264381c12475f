"""The factor engine: language checks, values against pandas, portfolio identities, and the oracles on a small table."""

import math
import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom import artifacts, plans, registry, sources
from factorloom.artifacts import compare_runs, list_runs, save_run
from factorloom.operators import evaluation as ev
from factorloom.operators import portfolio as pf
from factorloom.operators import risk
from factorloom.operators import selection as sel

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def panel(spark):
    return sources.synthetic_panel(spark, 60, 24, 3).cache()


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(0)
    rows = [(datetime(2021, 1, 1) + timedelta(days=d), f"i{i}", None if rng.random() < 0.15 else float(rng.integers(1, 9)), float(rng.integers(1, 5)), "A" if i % 2 else None) for d in range(25) for i in range(6)]
    return spark.createDataFrame([(t, i, c, c, c, c, v, s) for t, i, c, v, s in rows], "datetime timestamp, instrument string, open double, high double, low double, close double, volume double, sector string").cache()


@pytest.mark.parametrize("text", ["__import__('os')", "close.x", "close[0]", "foo(close)", "ts_mean(close)", "ts_mean(close, 0)", "ts_mean(close, 2000)", "winsorize(close, limit=0.1)", "1 + 2", "'a'", "close if volume else open", "lambda: 1", "1 < close < 2", "ts_mean", "winsorize(close, 0.7)", "close +"])
def test_refused(text):
    with pytest.raises(plans.FactorError):
        plans.parse(text)


def test_language():
    assert plans.parse("ts_mean(close, 5 * 4)") == plans.parse("sma(close, 20)")
    assert len(plans.allowed_functions()) == 38
    assert plans.autofix("returns(close, 1) * ts_mean(volume, 5)")[0] == "returns(close, 1) * ts_zscore(log1p(volume), 5)"
    assert plans.critique("returns(close, 1) * ts_mean(volume, 5)") and not plans.critique("zscore(close)")
    assert plans.scan_code("import os\nwhile True: pass") and not plans.scan_code("import numpy as np\nx = np.log(1)")


def values(df):
    return df.toPandas().set_index(["datetime", "instrument"]).sort_index()["value"].astype(float)


def by(p, column):
    return p.groupby("instrument")[column]


PANDAS = {
    "ts_mean(close, 4)": lambda p: by(p, "close").transform(lambda x: x.rolling(4).mean()),
    "ts_std(close, 4)": lambda p: by(p, "close").transform(lambda x: x.rolling(4).std(ddof=0)),
    "ts_rank(close, 4)": lambda p: by(p, "close").transform(lambda x: x.rolling(4).rank(pct=True)),
    "ts_argmax(close, 4)": lambda p: by(p, "close").transform(lambda x: x.rolling(4).apply(np.argmax, raw=True)),
    "ts_decay_linear(close, 3)": lambda p: by(p, "close").transform(lambda x: x.rolling(3).apply(lambda v: v @ [1, 2, 3] / 6, raw=True)),
    "ewm_mean(close, 5)": lambda p: by(p, "close").transform(lambda x: x.ewm(span=5, adjust=False).mean()),
    "ewm_std(close, 5)": lambda p: by(p, "close").transform(lambda x: x.ewm(span=5, adjust=False).std(bias=True)),
    "cs_rank(close)": lambda p: p.groupby("datetime")["close"].rank(pct=True),
    "cs_demean_group(close, sector)": lambda p: p["close"] - p.groupby(["datetime", p["sector"].fillna("UNKNOWN")])["close"].transform("mean"),
    "delay(close, 2)": lambda p: by(p, "close").shift(2),
    "maximum(close, delay(close, 1))": lambda p: np.maximum(p["close"], by(p, "close").shift(1)),
    "(close != delay(close, 1)) * 1": lambda p: (p["close"] != by(p, "close").shift(1)) * 1.0,
    "not (close > 4) and volume > 1": lambda p: (~(p["close"] > 4) & (p["volume"] > 1)) * 1.0,
    "(volume - 3) % 2 - (volume - 3) % -2": lambda p: (p["volume"] - 3) % 2 - (p["volume"] - 3) % -2,
    "log(close - 4)": lambda p: np.log((p["close"] - 4).where(p["close"] > 4)),
    "close / (volume - 2)": lambda p: (p["close"] / (p["volume"] - 2)).replace([np.inf, -np.inf], np.nan),
}


@pytest.mark.parametrize("text", PANDAS)
def test_values(gaps, text):
    p = gaps.toPandas().sort_values(["datetime", "instrument"]).set_index(["datetime", "instrument"])
    got = values(plans.eval_factor(gaps, text))
    np.testing.assert_allclose(got, PANDAS[text](p).astype(float), atol=1e-10)


@pytest.mark.parametrize("text", ["cs_neutralize(close, volume)", "cs_neutralize(close, volume, volume * volume)", "cs_neutralize_group(close, sector, volume)"])
def test_neutralize_is_orthogonal(panel, text):
    p = panel.withColumn("sector", panel.instrument.substr(5, 1))
    d = plans.eval_factor(p, text).join(panel, ["datetime", "instrument"]).toPandas().dropna()
    centre = d.groupby(["datetime", d.instrument.str[4:5]] if "group" in text else ["datetime"]).volume.transform("mean")
    d["against"] = d.value * (d.volume - centre)
    each = d.groupby("datetime").against.sum().abs() / d.groupby("datetime").volume.std()
    assert len(each) and each.max() < 1e-4 and d.groupby("datetime").value.sum().abs().max() < 1e-6


def test_run_factors(panel):
    run = plans.run_factors(panel, [{"alpha_id": "a", "dsl": "zscore(close)"}, {"id": "b", "dsl": "nope(close)"}, {"alphaID": "c", "dsl": "ts_mean(close, 900)"}, {"alpha_id": "d", "code": "x"}])
    assert {r.alpha_id for r in run.values.select("alpha_id").distinct().collect()} == {"a"}
    assert run.errors["b"].startswith("DSLValidationError") and "missing" in run.errors["c"] and "d" in run.errors


def test_shared_stages(panel):
    plan = plans.compile_factors(panel, {"a": "ts_mean(close, 5)", "b": "ts_mean(close, 5) - ts_std(close, 5)", "c": "zscore(ts_mean(close, 5))"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("avg(close") <= 4 and "Python" not in plan


def test_buckets_match_qcut(spark):
    for n in (5, 7, 23, 60):
        for q in (2, 3, 5, 6, 10):
            df = spark.createDataFrame([(1, f"{i:03d}", float(i * 7 % n)) for i in range(n)], "datetime int, instrument string, value double")
            b, _ = ev.bucket(["datetime"], "value", q)
            got = df.withColumn("b", b).orderBy("value").toPandas()
            assert got.b.tolist() == pd.qcut(got.value.rank(method="first"), q, labels=False).tolist(), (n, q)


def test_validation(spark):
    t = datetime(2020, 1, 1)
    rows = [("2020-01-01", "a", None, None, None, 10.0, -5.0, 1), ("2020-01-01", "a", 1.0, 2.0, 9.0, 8.0, None, 2), ("bad", "a", 1.0, 1.0, 1.0, 1.0, 1.0, 3), ("2020-01-02", "a", None, 3.0, math.inf, 7.0, 2.0, 4), ("2020-01-03", "a", 1.0, 1.0, 1.0, None, 1.0, 5)]
    df = spark.createDataFrame(rows, "datetime string, instrument string, open double, high double, low double, close double, volume double, seq int")
    out = sources.validate_panel(df, order="seq").orderBy("datetime").collect()
    assert [tuple(r)[2:] for r in out] == [(1.0, 8.0, 1.0, 8.0, 0.0), (8.0, 8.0, 7.0, 7.0, 2.0)] and out[0].datetime == t
    with pytest.raises(ValueError):
        sources.validate_panel(df.drop("low"))


def test_sources(spark, panel, tmp_path):
    panel.write.csv(f"{tmp_path}/p.csv", header=True)
    assert sources.get_panel(spark, f"{tmp_path}/p.csv").count() == panel.count()
    with pytest.raises(ValueError):
        sources.read_panel(spark, "x.txt")
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sources.read_jsonl(spark, f"{tmp_path}/r.jsonl").count() == 2
    listed = spark.createDataFrame([("x", "No"), ("y", " TRUE "), ("z", None)], "instrument string, borrowable string")
    assert {r.instrument for r in sources.hard_to_borrow(listed).collect()} == {"x", "z"}


def test_backtest_engines_agree(panel):
    factors = plans.run_factors(panel, [{"alpha_id": "m", "dsl": "-returns(close, 3)"}]).values
    cfg = pf.Backtest(min_obs=5, rebalance_days=3, holding_days=6, half_spread_bps=1.0)
    held = pf.held_weights(pf.target_weights(factors, panel, cfg), panel, cfg)
    a = pf.daily_path(held, panel, cfg).toPandas().set_index("datetime").sort_index()
    b = pf.sequential(held, panel, cfg).toPandas().set_index("datetime").sort_index().loc[a.index]
    for c in ("gross_return", "net_return", "turnover", "borrow_cost"):
        np.testing.assert_allclose(a[c], b[c], atol=1e-9)
    capped = pf.sequential(held, panel, pf.with_config(cfg, turnover_cap=0.05)).toPandas()
    assert capped.turnover.max() <= 0.05 + 1e-12
    net = pf.ablation(pf.daily_path(held, panel, cfg)).groupBy("scenario").avg("drag").toPandas().set_index("scenario")["avg(drag)"]
    assert net["full"] >= net["no_borrow"] >= net["no_impact"] >= net["linear_only"] >= net["no_costs"] == 0


def test_break_even(spark):
    daily = spark.createDataFrame([("a", datetime(2020, 1, 1) + timedelta(days=i), 0.001, 0.1, 0.2, 0.0, 0.0) for i in range(30)], "alpha_id string, datetime timestamp, gross_return double, turnover double, traded double, impact_unit double, gross_short double")
    r = pf.break_even(pf.cost_sensitivity(daily, {"linear_cost_bps": [0, 50, 150]})).first()
    assert r.status == "ok" and abs(r.break_even - 100) < 1e-6


def test_neutral_weights(spark):
    rng = np.random.default_rng(0)
    t = datetime(2020, 1, 1)
    w = spark.createDataFrame([("a", t, f"i{i}", float(x)) for i, x in enumerate(rng.normal(size=30))], "alpha_id string, datetime timestamp, instrument string, weight double")
    e = spark.createDataFrame([(t, f"i{i}", float(x)) for i, x in enumerate(rng.normal(size=30))], "datetime timestamp, instrument string, beta double")
    d = risk.neutralize(w, e, ["beta"], ["alpha_id"]).join(e, ["datetime", "instrument"]).toPandas()
    assert abs(d.weight.sum()) < 1e-6 and abs((d.weight * d.beta).sum()) < 1e-6
    with pytest.raises(ValueError):
        risk.exposures(w, 5, 6)


def test_splits():
    table = sel.splits(list(range(100)), sel.WalkForward(40, 10, 10, 10))
    assert table[0] == {"split_id": 0, "segment": "train", "start": 0, "end": 39} and max(r["end"] for r in table) < 99
    assert sel.splits(list(range(100)), sel.WalkForward(40, 10, 10, 10, expanding=False))[3]["start"] == 10
    with pytest.raises(ValueError):
        sel.splits(list(range(20)), sel.WalkForward(40, 10, 10, 10))


def test_selection_numbers():
    assert sel.greedy_diverse({"A": 1.0, "B": 0.95, "C": 0.5}, {("B", "A"): 0.99, ("C", "A"): 0.0}, 2, 1.0) == ["A", "C"]
    w = sel.project_simplex(np.array([5.0, 0.1, 0.0]), 0.6)
    assert abs(w.sum() - 1) < 1e-9 and w.max() <= 0.6 + 1e-6 and w.min() >= 0
    side = np.array([1, 1, -1, -1])
    w = sel.ridge_weights(np.array([2.0, 1, -1, -2]), np.zeros((4, 0)), np.ones(4), side)
    assert abs(w[side > 0].sum() - 0.5) < 1e-9 and abs(w[side < 0].sum() + 0.5) < 1e-9
    assert sel.feasible(2, 1, 0.3) == {"feasible": False, "suggested_max_weight": 0.5}
    rng = np.random.default_rng(7)
    m = sel.factor_risk_model(rng.normal(size=(80, 6)), rng.normal(size=(6, 2)), halflife=20)
    assert np.allclose(m["covariance"], m["covariance"].T) and np.linalg.eigvalsh(m["covariance"]).min() > 0
    assert sel.thin(list(range(100)), 3) == [0, 50, 99] or len(sel.thin(list(range(100)), 3)) == 3


def test_regime_allocation(spark):
    t = [datetime(2020, 1, 1) + timedelta(days=i) for i in range(60)]
    rows = [(d, a, (0.01 if (a == "A") == (i < 30) else -0.01) + 0.001 * (i % 3)) for i, d in enumerate(t) for a in "AB"]
    daily = spark.createDataFrame(rows, "datetime timestamp, alpha_id string, net_return double")
    labels = spark.createDataFrame([(d, "vol_0" if i < 30 else "vol_1") for i, d in enumerate(t)], "datetime timestamp, label string")
    w = {(r.label, r.alpha_id): r.weight for r in sel.allocate(daily, labels).collect()}
    assert w["vol_0", "A"] > 0.9 and w["vol_1", "B"] > 0.9
    days = sel.daily_allocation(sel.allocate(daily, labels), labels, 0.3).groupBy("datetime").sum("weight").toPandas()
    assert np.allclose(days["sum(weight)"], 1)


def test_streaming(spark, panel, tmp_path):
    from factorloom.streaming import rolling_mean_stream

    some = panel.where("instrument in ('S0000', 'S0001')").select("datetime", "instrument", "close").cache()
    ends = some.selectExpr("percentile(unix_timestamp(datetime), array(0.34, 0.67)) as e").first().e
    for i, part in enumerate((f"unix_timestamp(datetime) <= {ends[0]}", f"unix_timestamp(datetime) > {ends[0]} and unix_timestamp(datetime) <= {ends[1]}", f"unix_timestamp(datetime) > {ends[1]}")):
        some.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in (tmp_path / "in").glob("*.parquet"):
            if f.stat().st_mtime > 1e9:
                os.utime(f, (i + 1, i + 1))
    stream = spark.readStream.schema(some.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = rolling_mean_stream(stream, 3).writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3  # the state is carried over the batches
    got = values(spark.table("means"))
    np.testing.assert_allclose(got, values(plans.eval_factor(some, "ts_mean(close, 3)")).reindex(got.index), rtol=1e-9)


def test_artifacts(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.0)], "alpha_id string, ir double")
    a = os.path.basename(save_run(str(tmp_path), {"x": 1}, {"alpha_metrics": table}, factors={"a": "zscore(close)"}))
    b = os.path.basename(save_run(str(tmp_path), {"x": 2}, {"alpha_metrics": table}))
    assert [r["run_id"] for r in list_runs(str(tmp_path))] == [a, b] and compare_runs(str(tmp_path), a, b) == {"x": (1, 2)}
    assert {"config.json", "result.json", "alpha_metrics.csv", "SUMMARY.md"} <= set(os.listdir(tmp_path / a))


def test_runs_in_a_store_that_only_spark_reaches(spark, tmp_path):
    """Another file system: runs at the same time are all indexed, one that fails leaves nothing, a run of the same name gets another."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./runs", f"file://{tmp_path}")
    root = "viewfs://store/runs/of-a-team"
    table = spark.createDataFrame([("a", 1.0), ("b", None)], "alpha_id string, information_ratio double")
    with ThreadPoolExecutor(4) as pool:
        folders = list(pool.map(lambda i: save_run(root, {"x": i}, {"alpha_metrics": table}, factors={f"f{i}": "close"}, daily=table.fillna(0.0) if i == 0 else None), range(4)))
    done = [f.rsplit("/", 1)[1] for f in folders]
    assert {r["run_id"] for r in list_runs(root)} == set(done) and {r["alpha_id"] for r in artifacts.list_factors(root)} == {f"f{i}" for i in range(4)}
    assert artifacts.Store(root).read("LATEST") in done and compare_runs(root, done[0], done[3]) == {"x": (0, 3)}
    assert spark.read.csv(f"{folders[0]}/daily", header=True).count() == 2
    assert artifacts.compare_metrics(root, *done[:2]).information_ratio_delta.tolist()[0] == 0
    broken = table.withColumn("y", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        save_run(root, {"x": 9}, {"alpha_metrics": table, "broken": broken})
    assert len(list_runs(root)) == 4 and artifacts.Store(root).names("_pending") == []
    assert sorted(n for n in artifacts.Store(root).names("") if not n.startswith(".")) == sorted([*done, "LATEST", "_factor_registry", "_index", "_pending"])
    with pytest.raises(FileNotFoundError):
        artifacts.load_config(root, "none")


def frame(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].astype("datetime64[us]").astype(str) if str(df[c].dtype).startswith("datetime") else df[c].map(str) if df[c].dtype == object or str(df[c].dtype) in ("str", "string", "bool") else df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["dsl_nested", "daily_ic", "backtest_daily", "membership_turnover", "risk_exposures", "borrow_rates", "pareto_front"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = frame(registry.QUERIES[name](spark, SMALL).toPandas()), frame(con.execute(registry.ORACLE[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-9)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_pareto_of_a_whole_table(spark):
    """The two-objective front is that of brute force, without pairing all rows."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 60, 1500).astype(float), rng.integers(0, 60, 1500).astype(float)
    x[:700] = np.minimum(x[:700], 59 - y[:700])
    keep = x + rng.permutation(60)[y.astype(int)] < 70
    x, y = x[keep], y[keep]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "config_id long, gain double, cost double").repartition(5)
    out = sel.pareto(df, ["gain"], ["cost"])
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    want = {i: not (((x >= x[i]) & (y <= y[i]) & ((x > x[i]) | (y < y[i]))).any()) for i in range(len(x))}
    assert {r.config_id: r.is_pareto for r in out.collect()} == want and sum(want.values()) > 1


def test_walk_forward_and_sweep_take_all_factors(monkeypatch):
    """The walk-forward queries and the schedule sweep pass on every row of the factors."""
    from factorloom import selection_queries as sq

    seen = []
    monkeypatch.setattr(sq, "factors", lambda spark, sf_dir: ("panel", "values"))
    monkeypatch.setattr(sq.sel, "walk_forward", lambda values, *a: seen.append(values))
    monkeypatch.setattr(sq.sel, "schedule_sweep", lambda values, *a: seen.append(values) or (_ for _ in ()).throw(StopIteration))
    sq._walk(None, "")
    with pytest.raises(StopIteration):
        sq.schedule_sweep(None, "")
    assert seen == ["values", "values"]
