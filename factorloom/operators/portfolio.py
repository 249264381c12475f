"""Long/short portfolios: weights, schedules, costs, daily paths, re-pricing.

Two engines share one contract.  The relational one (``backtest``) is windows and joins and serves
every configuration without path dependence; ``stepwise`` streams the dates of each key through a
state machine where volatility targeting, a turnover cap or the optimizer makes a day depend on the
days before it.  A panel may hold several parts (see ``risk.keys_of``), so all segments of a
walk-forward are one plan.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div
from .evaluation import YEAR, bucket
from .optimizer import Optimizer, optimize
from .risk import clip_weights, exposures, keys_of, known_returns, neutralize, rescale_legs, residual_weights, sector_dummies, usual_volume, volume_steps


@dataclass(frozen=True)
class Backtest:
    """What to trade, when, and at which cost (basis points)."""

    n_quantiles: int = 5
    names_per_side: int = 0
    min_obs: int = 20
    rebalance_days: int = 5
    holding_days: int = 5
    commission_bps: float = 1.0
    slippage_bps: float = 2.0
    half_spread_bps: float = 0.0
    impact_bps: float = 0.0
    impact_exponent: float = 0.5
    max_participation: float = 0.2
    notional: float = 1e6
    borrow_bps: float = 50.0
    borrow_multiplier: float = 1.0
    max_borrow_bps: float = 0.0
    min_adv: float = 0.0
    window: int = 20
    min_window_obs: int = 10
    neutralize: tuple[str, ...] = ()
    max_weight: float = 0.0
    target_vol: float = 0.0
    vol_window: int = 20
    max_leverage: float = 3.0
    turnover_cap: float = 0.0
    #: How sides become weights: None for equal weights, else the optimizer's settings.
    optimizer: Optimizer | None = None
    #: Whether dates on which nothing is held or traded have a row (of zeros) in a daily path.
    every_date: bool = True

    @property
    def sleeves(self) -> int:
        """Portfolios that are held side by side."""
        return -(-self.holding_days // self.rebalance_days) if self.holding_days > self.rebalance_days else 1


KEYS = ["alpha_id"]


def calendar(panel: DataFrame) -> DataFrame:
    """(datetime, i, next, prev): the dates in order, of each part of the panel.  One row per date."""
    by = keys_of(panel)
    w = Window.partitionBy(*by).orderBy("datetime")
    return panel.select(*by, "datetime").distinct().select(*by, "datetime", (F.row_number().over(w) - 1).alias("i"), F.lead("datetime").over(w).alias("next"), F.lag("datetime").over(w).alias("prev"))


def side_weights(rows: DataFrame, cfg: Backtest, keys: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """Half the capital on each side, equally over its names, of each date's values; both sides or none.  ``also``: columns to keep.

    ``rows`` has (value, shortable).  By quantiles the shortable names of the bottom bucket are sold;
    by number of names the candidates are the shortable names, of which there must be enough.
    """
    by = Window.partitionBy(*keys, "datetime")
    if cfg.names_per_side:
        n = F.count("value").over(by)
        up = F.row_number().over(by.orderBy(F.col("value").asc_nulls_last(), "instrument"))
        short_rank = F.row_number().over(by.orderBy(F.when(F.col("shortable"), 0).otherwise(1), F.col("value").asc_nulls_last(), "instrument"))
        can = F.count(F.when(F.col("shortable") & F.col("value").isNotNull(), 1)).over(by)
        placed = rows.where("value is not null").withColumns({"n": n, "_u": up, "_s": short_rank, "_c": can}).where(F.col("n") >= max(2 * cfg.names_per_side, cfg.min_obs)).where(F.col("_c") >= cfg.names_per_side)
        long, short = F.col("_u") > F.col("n") - cfg.names_per_side, F.col("shortable") & (F.col("_s") <= cfg.names_per_side)
    else:
        b, n = bucket([*keys, "datetime"], "value", cfg.n_quantiles)
        placed = rows.where("value is not null").withColumns({"bucket": b, "n": n}).where(F.col("n") >= max(cfg.min_obs, cfg.n_quantiles))
        long, short = F.col("bucket") == cfg.n_quantiles - 1, (F.col("bucket") == 0) & F.col("shortable")
    placed = placed.withColumn("side", F.when(long, 1).when(short, -1).otherwise(0))
    n_long, n_short = F.sum(F.when(F.col("side") == 1, 1)).over(by), F.sum(F.when(F.col("side") == -1, 1)).over(by)
    placed = placed.withColumns({"_l": n_long, "_n": n_short}).where("side <> 0 and _l > 0 and _n > 0")
    return placed.select(*keys, "datetime", "instrument", F.when(F.col("side") == 1, 0.5 / F.col("_l")).otherwise(-0.5 / F.col("_n")).alias("weight"), *also)


def target_weights(factors: DataFrame, panel: DataFrame, cfg: Backtest, keys: list[str] = KEYS, hard_to_borrow: DataFrame | None = None, rates: DataFrame | None = None, sectors: DataFrame | None = None) -> DataFrame:
    """Weights decided on each rebalance date, after filters, neutralization (on sectors, too, if given), scaling and the weight cap."""
    by = keys_of(panel)
    days = calendar(panel)
    rows = factors.join(F.broadcast(days.where(F.col("next").isNotNull() & (F.col("i") % cfg.rebalance_days == 0)).select(*by, "datetime")), [*by, "datetime"]).withColumn("shortable", F.lit(True))
    if cfg.min_adv or (cfg.neutralize and cfg.optimizer is None):
        rows = exposures(panel, cfg.window, cfg.min_window_obs, rows)
    if cfg.min_adv:
        rows = rows.where(F.col("adv") >= cfg.min_adv)
    if hard_to_borrow is not None:
        rows = rows.join(hard_to_borrow.withColumn("_h", F.lit(True)), "instrument", "left").withColumn("shortable", F.col("_h").isNull()).drop("_h")
    if cfg.max_borrow_bps:
        if rates is not None:
            rows = rows.join(rates, ["datetime", "instrument"], "left")
        bps = F.coalesce("borrow_bps", F.lit(cfg.borrow_bps)) if rates is not None else F.lit(cfg.borrow_bps)
        rows = rows.withColumn("shortable", F.col("shortable") & (bps <= cfg.max_borrow_bps)).drop("borrow_bps")
    if cfg.optimizer is not None:
        return side_weights(rows, cfg, keys, ("value",))
    w = side_weights(rows, cfg, keys, cfg.neutralize)
    columns = list(cfg.neutralize)
    if sectors is not None:
        dummies, names = sector_dummies(panel.select("instrument").distinct(), sectors)
        w = w.join(dummies, "instrument", "left")
        columns += names
    if columns:
        w = rescale_legs(neutralize(w, None, columns, keys), keys)
    w = w.select(*keys, "datetime", "instrument", "weight")
    return clip_weights(w, cfg.max_weight) if cfg.max_weight else w


def held_weights(targets: DataFrame, panel: DataFrame, cfg: Backtest, keys: list[str] = KEYS) -> DataFrame:
    """Weights at each close: the sleeves that are alive, each with its share of the capital.

    A sleeve lives for the holding period, also where that ends before the next rebalance.
    """
    by = keys_of(panel)
    days = calendar(panel)
    last = days.groupBy(*by).agg(F.max("i").alias("last"))
    days = F.broadcast(days.select(*by, "datetime", "i"))
    # dealt by instrument once: the sleeves' sums and the trades after them need no more
    span = targets.repartition("instrument").join(days, [*by, "datetime"])
    span = span.join(F.broadcast(last), by) if by else span.crossJoin(F.broadcast(last))
    steps = span.withColumn("i", F.explode(F.sequence("i", F.least(F.col("i") + cfg.holding_days, F.col("last")) - 1)))
    out = steps.groupBy(*keys, "i", "instrument").agg(F.sum(F.col("weight") / cfg.sleeves).alias("weight"))
    return out.join(days, [*by, "i"]).select(*keys, "datetime", "instrument", "weight").where(F.abs("weight") > 1e-12)


def daily_path(weights: DataFrame, panel: DataFrame, cfg: Backtest, keys: list[str] = KEYS, rates: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """Per date of the return: gross and net return, turnover, and each cost.

    Weights of a close earn the return to the next date; trades are the change since the close before.
    ``of``: the keys that have a path with ``every_date`` (else those of the weights).
    """
    by = keys_of(panel)
    days = calendar(panel)
    # a weight is one of its own close and the one before for the next close
    zero = F.lit(0.0)
    closes = F.array(F.struct("i", F.col("weight").alias("w"), zero.alias("b")), F.struct((F.col("i") + 1).alias("i"), zero.alias("w"), F.col("weight").alias("b")))
    near = F.broadcast(days)
    moves = weights.join(near, [*by, "datetime"]).select(*keys, "instrument", F.inline(closes))
    trades = moves.groupBy(*keys, "i", "instrument").agg(F.sum("w").alias("w"), F.sum("b").alias("b")).withColumn("d", F.abs(F.col("w") - F.col("b")))
    trades = trades.join(F.broadcast(days.where("next is not null")), [*by, "i"])
    r = known_returns(panel).withColumnRenamed("datetime", "next")
    # parts are keys of the join, for which it deals both sides itself
    dealt = (lambda x: x) if by else (lambda x: x.repartition("instrument"))
    t = dealt(trades).join(dealt(r), [*by, "next", "instrument"], "left")
    if rates is not None:
        t = t.join(rates, ["datetime", "instrument"], "left")
    bps = F.coalesce("borrow_bps", F.lit(cfg.borrow_bps)) if rates is not None else F.lit(cfg.borrow_bps)
    short = F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0)
    day = t.groupBy(*keys, "next").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("gross_return"), (F.sum("d") / 2).alias("turnover"), F.sum("d").alias("traded"), F.sum(short).alias("gross_short"), F.sum(F.greatest("w", F.lit(0.0))).alias("gross_long"), (F.sum(short * bps) / 1e4 / YEAR).alias("borrow_unit"))
    if cfg.impact_bps:
        # impact is that of trades, which most names have on few dates
        window = (cfg.window, cfg.min_window_obs)
        traded = exposures(panel, *window, trades.where("d > 0").select(*keys, "datetime", "next", "instrument", "d")).join(F.broadcast(usual_volume(panel, *window)), [*by, "datetime"], "left")
        part = F.least(div(F.col("d") * cfg.notional, F.coalesce("adv", "mid", F.lit(1.0))), F.lit(cfg.max_participation))
        unit = traded.groupBy(*keys, "next").agg(F.sum(F.col("d") * F.pow(F.coalesce(part, F.lit(cfg.max_participation)), cfg.impact_exponent)).alias("impact_unit"))
        day = day.join(unit, [*keys, "next"], "left").withColumn("impact_unit", F.coalesce("impact_unit", F.lit(0.0)))
    else:
        day = day.withColumn("impact_unit", F.lit(0.0))
    day = day.select(*keys, "next", "gross_return", "turnover", "traded", "impact_unit", "gross_short", "gross_long", "borrow_unit")
    if cfg.every_date:
        some = (of if of is not None else weights).select(*keys).distinct()
        dates = days.where("next is not null").select(*by, "next")
        full = some.join(F.broadcast(dates), by) if by else some.crossJoin(F.broadcast(dates))
        units = [c for c in day.columns if c not in (*keys, "next")]
        day = full.join(day, [*keys, "next"], "left").select(*keys, "next", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in units])
    return costed(day.withColumnRenamed("next", "datetime"), cfg)


def costed(day: DataFrame, cfg: Backtest) -> DataFrame:
    """Costs and net return of a daily path from its units."""
    linear = F.col("turnover") * (cfg.commission_bps + cfg.slippage_bps) / 1e4
    costs = {"linear_cost": linear, "spread_cost": F.col("traded") * cfg.half_spread_bps / 1e4, "impact_cost": F.col("impact_unit") * cfg.impact_bps / 1e4, "borrow_cost": F.col("borrow_unit") * cfg.borrow_multiplier}
    out = day.withColumns(costs).withColumn("total_cost", F.col("linear_cost") + F.col("spread_cost") + F.col("impact_cost") + F.col("borrow_cost"))
    return out.withColumn("net_return", F.col("gross_return") - F.col("total_cost"))


def backtest(factors: DataFrame, panel: DataFrame, cfg: Backtest, keys: list[str] = KEYS, hard_to_borrow: DataFrame | None = None, rates: DataFrame | None = None, sectors: DataFrame | None = None, check: bool = True) -> DataFrame:
    """The daily path of each key's factor.  ``check``: refuse panels of less than three dates (a job of its own)."""
    if check and panel.select("datetime").distinct().limit(3).count() < 3:
        raise ValueError("a backtest needs three dates")
    targets = target_weights(factors, panel, cfg, keys, hard_to_borrow, rates, sectors)
    if cfg.target_vol or cfg.turnover_cap or cfg.optimizer is not None:
        return stepwise(targets, panel, cfg, keys, rates)
    return daily_path(held_weights(targets, panel, cfg, keys), panel, cfg, keys, rates, factors)


def _groups(batches, names: list[str]):
    """Consecutive rows that are equal in ``names``, one table each; the rows come sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        for c in names:
            x = table[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), table.num_rows]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-2])
    if rest is not None and rest.num_rows:
        yield rest


class _Book:
    """The state of one path: names, sleeves with their ends, weights of the last close and net returns."""

    def __init__(self, cfg: Backtest):
        self.cfg, self.names = cfg, {}
        self.sleeves: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.held, self.net = np.zeros(0), []
        #: the names' mean traded values as of the date
        self.paid = np.zeros(0)

    def places(self, names) -> np.ndarray:
        at = np.array([self.names.setdefault(n, len(self.names)) for n in names], np.int64)
        if len(self.names) > len(self.held):
            self.paid = np.concatenate([self.paid, np.full(len(self.names) - len(self.held), np.nan)])
            self.held = np.concatenate([self.held, np.zeros(len(self.names) - len(self.held))])
        return at

    def scale(self) -> float:
        cfg = self.cfg
        if not cfg.target_vol or len(self.net) < cfg.vol_window:
            return 1.0
        sd = float(np.std(self.net[-cfg.vol_window :], ddof=1)) if cfg.vol_window > 1 else 0.0
        return min(max(cfg.target_vol / YEAR**0.5 / sd, 0.0), cfg.max_leverage) if sd > 0 else 1.0

    def goal(self) -> np.ndarray:
        out = np.zeros(len(self.held))
        for _, at, w in self.sleeves:
            out[at] += w / self.cfg.sleeves
        return out

    def optimized(self, at: np.ndarray, rows, scale: float) -> np.ndarray:
        """Weights of a new sleeve by the optimizer, then (unless its solver has kept to them) neutral and capped ones."""
        cfg = self.cfg
        wanted = ((self.held / scale if scale > 0 else 0.0) - self.goal())[at] * cfg.sleeves
        x = np.column_stack([np.zeros((len(at), 0)), *(rows[c].to_numpy(float) for c in cfg.neutralize)])
        w, meta = optimize(rows["value"].to_numpy(float), np.sign(rows["weight"].to_numpy(float)), wanted, x, cfg.optimizer, cfg.max_weight, costs_of(rows, cfg))
        if w is None:
            return np.zeros(len(at))
        if meta["backend_used"] != "qp":
            some = w != 0
            if x.shape[1] and some.any():
                w[some] = residual_weights(w[some], x[some])
                w = legs(w, 0.5, 0.5, True)
            if cfg.max_weight:
                w = legs(np.clip(w, -cfg.max_weight, cfg.max_weight), 0.5, 0.5, False)
        return w

    def day(self, i: int, rows) -> tuple:
        """One date: expiry, new sleeve, leverage, turnover cap, costs; the row of the daily path.  The row without a name is the date's own."""
        cfg = self.cfg
        own = rows["instrument"].isna().to_numpy()
        mid, rows = float(rows["mid"][own].iloc[0]), rows[~own]
        self.sleeves = [s for s in self.sleeves if s[0] > i]
        scale, at = self.scale(), self.places(rows["instrument"])
        new = rows["weight"].notna().to_numpy()
        if new.any():
            some = rows[new]
            w = some["weight"].to_numpy(float) if cfg.optimizer is None else self.optimized(at[new], some, scale)
            if np.any(w):
                self.sleeves.append((i + cfg.holding_days, at[new], w))
        delta = self.goal() * scale - self.held
        turnover = np.abs(delta).sum() / 2
        if cfg.turnover_cap and turnover > cfg.turnover_cap:
            delta *= cfg.turnover_cap / turnover
            turnover = cfg.turnover_cap
        self.held = self.held + delta
        ret, bps = np.zeros(len(self.held)), np.full(len(self.held), float(cfg.borrow_bps))
        ret[at] = rows["ret"].astype(float).fillna(0.0)
        rate = rows["bps"].astype(float).to_numpy()
        bps[at[~np.isnan(rate)]] = rate[~np.isnan(rate)]
        unit = 0.0
        if cfg.impact_bps:
            step = rows["step"].notna().to_numpy()
            self.paid[at[step]] = rows["paid"].astype(float).to_numpy()[step]
            adv = np.where(np.isnan(self.paid), 1.0 if np.isnan(mid) else mid, self.paid)
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.abs(delta) * cfg.notional / adv
            part = np.where(np.isnan(part), cfg.max_participation, np.minimum(part, cfg.max_participation))
            unit = float((np.abs(delta) * part**cfg.impact_exponent).sum())
        short, traded = np.maximum(-self.held, 0.0), float(np.abs(delta).sum())
        gross, borrow = float(self.held @ ret), float(short @ bps) / 1e4 / YEAR
        self.net.append(gross - turnover * (cfg.commission_bps + cfg.slippage_bps) / 1e4 - traded * cfg.half_spread_bps / 1e4 - unit * cfg.impact_bps / 1e4 - borrow * cfg.borrow_multiplier)
        return gross, float(turnover), traded, unit, float(short.sum()), float(np.maximum(self.held, 0.0).sum()), borrow, scale


def legs(w: np.ndarray, long: float, short: float, scale_up: bool) -> np.ndarray:
    """``risk.rescale_legs`` of one cross-section."""
    out = np.zeros(len(w))
    for sign, size in ((1, long), (-1, short)):
        side = sign * w > 0
        total = np.abs(w[side]).sum()
        if total > 0:
            out[side] = w[side] * (size / total if scale_up or total > size else 1.0)
    return out


def costs_of(rows, cfg: Backtest) -> dict[str, np.ndarray]:
    """What the optimizer knows of each name's costs: of a unit of trade, of a unit of short over the holding period, the most it may trade, variance."""
    adv = rows["adv"].astype(float)
    adv = adv.where(adv > 0).to_numpy()
    adv = np.where(np.isnan(adv), np.nanmedian(adv) if np.isfinite(adv).any() else 1.0, adv)
    n = len(rows)
    return {"trade": np.full(n, (cfg.commission_bps + cfg.slippage_bps) / 2e4 + cfg.half_spread_bps / 1e4), "borrow": rows["bps"].astype(float).fillna(cfg.borrow_bps).to_numpy() / 1e4 / YEAR * cfg.borrow_multiplier * cfg.holding_days,
            "most_trade": np.clip(cfg.max_participation * adv / cfg.notional, 0.0, 1.0), "variance": rows["volatility"].to_numpy(float) ** 2 * YEAR}


def sequential(held: DataFrame, panel: DataFrame, cfg: Backtest, keys: list[str] = KEYS, rates: DataFrame | None = None) -> DataFrame:
    """Daily paths of books that move towards given weights at each close, with volatility targeting and a turnover cap."""
    return stepwise(held, panel, replace(cfg, rebalance_days=1, holding_days=1, optimizer=None), keys, rates)


def stepwise(targets: DataFrame, panel: DataFrame, cfg: Backtest, keys: list[str] = KEYS, rates: DataFrame | None = None) -> DataFrame:
    """Daily paths from rebalance targets with volatility targeting, a turnover cap or the optimizer: one state machine per key.

    The dates of a key come in order, a batch at a time; what a task holds is one date's rows, the
    live sleeves and the net returns, for the names that the key has ever targeted.  A date has a row
    of its own and those of names with something new: a target, a return, a borrow rate, another
    mean traded value.  These are packed by date where they are made (see ``_pack``), so they are dealt
    and sorted once, without columns that a date does not have; a date's rows of one name are put
    together in the state machine.
    """
    by = keys_of(panel)
    window = (cfg.window, cfg.min_window_obs)
    days = F.broadcast(calendar(panel).where("next is not null").select(*by, "datetime", "i", "next"))
    ticks = targets.select(*keys).distinct()
    ticks = ticks.join(days, by) if by else ticks.crossJoin(days)
    some = targets.select(*keys, "instrument").distinct()
    of_names = lambda news: news.join(days, [*by, "datetime"]).join(some, [*by, "instrument"])
    returned = known_returns(panel).withColumnRenamed("datetime", "next").join(days, [*by, "next"]).join(some, [*by, "instrument"]).select(*keys, "i", "instrument", "ret")
    aims = targets.join(days, [*by, "datetime"])
    if cfg.optimizer is not None:
        aims = exposures(panel, *window, aims).select(*aims.columns, *dict.fromkeys(["adv", "volatility", *cfg.neutralize]))
    aims = aims.drop("datetime", "next")
    news = [aims, returned]
    if cfg.impact_bps:
        news.append(of_names(volume_steps(panel, *window)).select(*keys, "i", "instrument", F.lit(True).alias("step"), F.col("adv").alias("paid")))
        ticks = ticks.join(F.broadcast(usual_volume(panel, *window)), [*by, "datetime"], "left")
    else:
        ticks = ticks.withColumn("mid", F.lit(None).cast("double"))
    if rates is not None:
        news.append(of_names(rates).select(*keys, "i", "instrument", F.col("borrow_bps").cast("double").alias("bps")))
    rows = ticks.select(*keys, "i", "next", "mid", F.lit(None).cast("string").alias("instrument"))
    for x in news:
        rows = rows.unionByName(x, allowMissingColumns=True)
    for c, t in (("ret", "double"), ("step", "boolean"), ("paid", "double"), ("bps", "double"), ("adv", "double")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(t))
    rest = [c for c in rows.columns if c not in (*keys, "i", "instrument")]
    number = {"next": F.unix_micros("next").cast("double"), "own": F.when(F.col("instrument").isNull(), 1.0)}
    rows = rows.select(*keys, F.col("i").cast("long").alias("i"), F.coalesce("instrument", F.lit("")).alias("instrument"), *[number.get(c, F.col(c).cast("double")).alias(c) for c in (*rest, "own")])
    rest.append("own")
    fields = ["gross_return", "turnover", "traded", "impact_unit", "gross_short", "gross_long", "borrow_unit", "scale"]
    schema = targets.select(*keys).schema.add("datetime", "timestamp")
    for c in fields:
        schema = schema.add(c, "double")

    def run(batches):
        before, book, out = None, None, []
        for table in _groups(batches, [*keys, "i"]):
            day = _unpack(table["data"].to_pylist(), rest)
            key = tuple(table[k][0].as_py() for k in keys)
            if key != before:
                before, book = key, _Book(cfg)
            got = book.day(table["i"][0].as_py(), day)
            if cfg.every_date or got[1] or got[4] or got[5]:
                out.append((*key, int(day["next"].iloc[0]), *got))  # the date's own row comes first
            if len(out) >= 4096:
                yield _rows(out, schema)
                out = []
        if out:
            yield _rows(out, schema)

    packed = rows.select(*keys, "i").schema.add("data", "binary")
    dealt = rows.mapInArrow(lambda batches: _pack(batches, [*keys, "i"], rest), packed).repartition(*keys).sortWithinPartitions(*keys, "i")
    return costed(dealt.mapInArrow(run, schema), cfg)


#: Rows that a task packs at once.
PACK = 500_000


def _pack(batches, names: list[str], columns: list[str]):
    """Rows of (names, instrument, numbers) as one for each value of ``names``, up to ``PACK`` rows at a time: their instruments and those of the columns that they have."""

    def packed(part):
        table = pa.Table.from_batches(part).combine_chunks().sort_by([(c, "ascending") for c in names])
        new = np.zeros(table.num_rows, bool)
        for c in names:
            x = table[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), table.num_rows]
        text, numbers = table["instrument"].to_pylist(), [table[c].to_numpy().astype(float) for c in columns]
        data = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            some = [k for k, x in enumerate(numbers) if not np.isnan(x[a:b]).all()]
            own = "\0".join(text[a:b]).encode()
            head = np.array([b - a, sum(1 << k for k in some), len(own)], np.int64)
            data.append(zlib.compress(b"".join([head.tobytes(), own, *(numbers[k][a:b].tobytes() for k in some)]), 1))
        first = table.select(names).take(pa.array(cuts[:-1], pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([*(first[c].chunk(0) for c in names), pa.array(data, pa.binary())], [*names, "data"])

    part, n = [], 0
    for batch in batches:
        if batch.num_rows:
            part.append(batch)
            n += batch.num_rows
        if n >= PACK:
            yield packed(part)
            part, n = [], 0
    if part:
        yield packed(part)


def _unpack(data: list[bytes], columns: list[str]) -> pd.DataFrame:
    """The rows of one date, one for each instrument (the largest of its numbers); the date's own comes first and has no instrument."""
    parts = []
    for x in map(zlib.decompress, data):
        n, has, size = np.frombuffer(x, np.int64, 3).tolist()
        at = 24 + size
        part = {"instrument": x[24:at].decode().split("\0")}
        for k, c in enumerate(columns):
            if has >> k & 1:
                part[c] = np.frombuffer(x[at : at + 8 * n], np.float64)
                at += 8 * n
        parts.append(pd.DataFrame(part))
    day = pd.concat(parts, ignore_index=True).reindex(columns=["instrument", *columns])
    day["own"] = day["own"].fillna(0.0)
    day = day.groupby(["own", "instrument"], as_index=False)[[c for c in columns if c != "own"]].max()
    day = day.sort_values(["own", "instrument"], ascending=[False, True], ignore_index=True)
    day["instrument"] = day["instrument"].where(day["own"] == 0)
    return day


def _rows(rows: list[tuple], schema) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), target)], schema=target)


def reprice(weights: DataFrame, panel: DataFrame, cfg: Backtest, keys: list[str] = KEYS, rates: DataFrame | None = None, hard_to_borrow: DataFrame | None = None) -> DataFrame:
    """The path of given weights that are dated by the return they earn (the position of the date before).

    Shorts of names that can't be borrowed are left out; with a turnover cap the book moves towards
    the weights, no faster than the cap.
    """
    by = keys_of(panel)
    if hard_to_borrow is not None:
        weights = weights.join(hard_to_borrow.withColumn("_h", F.lit(True)), "instrument", "left").where("_h is null or weight >= 0").drop("_h")
    back = F.broadcast(calendar(panel).where("prev is not null").select(*by, "datetime", "prev"))
    shifted = weights.join(back, [*by, "datetime"]).select(*keys, F.col("prev").alias("datetime"), "instrument", "weight")
    if cfg.turnover_cap:
        return sequential(shifted, panel, replace(cfg, target_vol=0.0), keys, rates)
    return daily_path(shifted, panel, cfg, keys, rates)


#: The cost scenarios of an ablation and the costs that each leaves out.
SCENARIOS = {"full": (), "no_borrow": ("borrow_cost",), "no_impact": ("borrow_cost", "impact_cost"), "linear_only": ("borrow_cost", "impact_cost", "spread_cost"), "no_costs": ("borrow_cost", "impact_cost", "spread_cost", "linear_cost")}


def ablation(daily: DataFrame) -> DataFrame:
    """The daily path once for each cost scenario, with its net return and cost drag."""
    kept = [F.struct(F.lit(s).alias("scenario"), sum((F.col(c) for c in ("linear_cost", "spread_cost", "impact_cost", "borrow_cost") if c not in out), F.lit(0.0)).alias("drag")) for s, out in SCENARIOS.items()]
    return daily.withColumn("_s", F.explode(F.array(*kept))).withColumns({"scenario": F.col("_s.scenario"), "drag": F.col("_s.drag"), "net_return": F.col("gross_return") - F.col("_s.drag")}).drop("_s")


#: Parameters of the sensitivity curves and the daily unit that each multiplies.
SENSITIVITY = {"linear_cost_bps": "turnover", "half_spread_bps": "traded", "impact_bps": "impact_unit", "borrow_bps": "gross_short"}


def cost_sensitivity(daily: DataFrame, grid: dict[str, list[float]], keys: list[str] = KEYS, x: str = "gross_return") -> DataFrame:
    """Mean net return and information ratio where one cost at a time takes each value of its grid."""
    points = [F.struct(F.lit(p).alias("parameter"), F.lit(float(v)).alias("setting"), (F.col(SENSITIVITY[p]) * (v / 1e4 / (YEAR if p == "borrow_bps" else 1))).alias("cost")) for p, values in grid.items() for v in values]
    net = daily.withColumn("_p", F.explode(F.array(*points))).select(*keys, "datetime", "_p.parameter", "_p.setting", (F.col(x) - F.col("_p.cost")).alias("net"))
    mean, sd = F.avg("net"), F.stddev_samp("net")
    return net.groupBy(*keys, "parameter", "setting").agg(mean.alias("mean_return"), (F.coalesce(div(mean, sd), F.lit(0.0)) * YEAR**0.5).alias("information_ratio"))


def break_even(curve: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Where each curve's mean return reaches zero, by linear interpolation, and a status.

    flat: the mean does not change; below_grid: not positive at the first setting; above_grid: positive
    at the last; ok: crossed between two settings; no_cross: none of these.
    """
    by = [*keys, "parameter"]
    w = Window.partitionBy(*by).orderBy("setting")
    y0, y1, x0, x1 = F.col("mean_return"), F.lead("mean_return").over(w), F.col("setting"), F.lead("setting").over(w)
    crossing = F.when((y0 > 0) & (y1 <= 0), x0 + (x1 - x0) * div(y0, y0 - y1))
    steps = curve.withColumn("_x", crossing)
    ends = steps.groupBy(*by).agg(F.min("_x").alias("at"), F.min_by("mean_return", "setting").alias("first"), F.max_by("mean_return", "setting").alias("last"), (F.max("mean_return") - F.min("mean_return")).alias("spread"))
    status = F.when(F.col("spread") < 1e-15, "flat").when(F.col("first") <= 0, "below_grid").when(F.col("at").isNotNull(), "ok").when(F.col("last") > 0, "above_grid").otherwise("no_cross")
    return ends.select(*by, F.when(status == "ok", F.col("at")).alias("break_even"), status.alias("status"))


def portfolio_summary(daily: DataFrame, keys: list[str] = KEYS, x: str = "net_return") -> DataFrame:
    from .evaluation import summarize

    costs = [F.avg(c).alias(f"{c}_mean") for c in ("turnover", "linear_cost", "spread_cost", "impact_cost", "borrow_cost", "total_cost")]
    return summarize(daily, keys, x, tuple(costs))


def with_config(cfg: Backtest, **changes) -> Backtest:
    return replace(cfg, **changes)


__all__ = ["Backtest", "Column", "Optimizer", "SCENARIOS", "SENSITIVITY", "ablation", "backtest", "break_even", "calendar", "cost_sensitivity", "costed", "daily_path", "held_weights", "portfolio_summary", "reprice", "sequential", "side_weights", "stepwise", "target_weights", "with_config"]
