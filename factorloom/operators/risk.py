"""Rolling risk exposures, market features and regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div, linear, scrub
from .evaluation import YEAR, summarize

#: Share of the market's mean square up to which its variance counts as none (rounding of the running sums).
NO_SPREAD = 1e-10


def _in_time(by=()):
    return Window.partitionBy(*by, "instrument").orderBy("datetime")


def keys_of(panel: DataFrame) -> list[str]:
    """The columns of a panel that tell its parts (segments of a walk-forward) apart: each part is a panel of its own."""
    return [c for c in ("split_id", "segment") if c in panel.columns]


def known_returns(panel: DataFrame) -> DataFrame:
    """(datetime, instrument, ret) of the rows with a close, over the instrument's last one: on all other dates the return is zero."""
    by = keys_of(panel)
    return panel.where("close is not null").select(*by, "datetime", "instrument", scrub(div(F.col("close"), F.lag("close").over(_in_time(by))) - 1).alias("ret"))


def _with_returns(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows with ``ret`` where a close is known, and whether it and the one before are prices that later returns can be taken from."""
    last = F.last("close", ignorenulls=True).over(_in_time(by).rowsBetween(Window.unboundedPreceding, -1))
    known = F.col("close").isNotNull()
    rows = rows.withColumn("_before", last)
    return rows.withColumns({"ret": F.when(known, scrub(div(F.col("close"), F.col("_before")) - 1)), "live": known & (F.col("close") != 0), "was_live": F.coalesce(known & (F.col("_before") != 0), F.lit(False))}).drop("_before")


def _calendar_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each date: its number i, the market's return, and of all names with a return their number n, spread and mean of squares.

    A name without a row has a return of zero as long as its last close is a price: such names are
    counted by what is live after a date less what has a row on the next, not made as rows.
    """
    known = F.col("close").isNotNull()
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    day = rows.groupBy(*by, "datetime").agg(F.sum("ret").alias("total"), F.count("ret").alias("own"), F.var_pop("ret").alias("var"), one(known & F.col("live")).alias("live"), one(known & F.col("was_live")).alias("was_live"))
    w = Window.partitionBy(*by).orderBy("datetime")  # one row per date
    ever = w.rowsBetween(Window.unboundedPreceding, 0)
    still = F.coalesce(F.sum("live").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("was_live").over(ever)
    day = day.withColumns({"i": F.row_number().over(w) - 1, "n": F.col("own") + still})
    mean = div(F.col("total"), F.col("own"))
    m2 = F.coalesce(F.col("var") * F.col("own") + div(mean * mean * F.col("own") * (F.col("n") - F.col("own")), F.col("n")), F.lit(0.0))
    return day.select(*by, "datetime", "i", F.coalesce(div(F.col("total"), F.col("n")), F.lit(0.0)).alias("mkt"), F.when(F.col("n") > 1, F.sqrt(m2 / (F.col("n") - 1))).alias("disp"))


def exposures(panel: DataFrame, window: int = 20, min_obs: int = 10, at: DataFrame | None = None) -> DataFrame:
    """(datetime, instrument, ret, volatility, log_adv, adv, beta), each but the return known at the close of the date before, of the panel's rows.

    With ``at``, a table of dates and instruments: its rows with their own columns, without a return.

    Windows are of ``window`` dates of the panel, whether the name has rows on them or not: a window
    is a range over the dates' numbers.  A gap between two rows is a run of zero returns; what it
    adds is its length and the difference of running sums of the market's return and its square, cut
    where the window starts.  No row is made for a missing date.  ``at`` may hold dates of the panel
    on which a name has no row, and a name and date more than once.
    """
    if min_obs > window:
        raise ValueError("min_obs must not exceed the window")
    by = keys_of(panel)
    own = panel.select(*by, "datetime", "instrument", "close", (F.col("close") * F.col("volume")).alias("money"))
    days = _calendar_of(_with_returns(own, by), by)
    rows = own
    if at is not None:
        # the asked rows take their other columns along
        asked = at.select(*by, "datetime", "instrument", F.struct(*at.columns).alias("_at"))
        rows = own.unionByName(asked, allowMissingColumns=True)
    rows = _with_returns(rows, by)
    w = Window.partitionBy(*by).orderBy("datetime")  # one row per date
    ever = w.rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumns({"sum0": F.col("i").cast("double") + 1, "sum1": F.sum("mkt").over(ever), "sum2": F.sum(F.col("mkt") * F.col("mkt")).over(ever)})
    # sums to the date before the row's, and to the date before the window
    sums = range(3)
    days = days.withColumns({**{f"to{k}": F.coalesce(F.lag(f"sum{k}").over(w), F.lit(0.0)) for k in sums}, **{f"from{k}": F.coalesce(F.lag(f"sum{k}", window + 1).over(w), F.lit(0.0)) for k in sums}})
    # the calendar has a few numbers for each date of each part
    rows = rows.join(F.broadcast(days.drop("disp")), [*by, "datetime"])
    time = Window.partitionBy(*by, "instrument").orderBy("i")
    known = F.col("close").isNotNull()
    place = F.struct("i", F.col("live").cast("double").alias("live"), *[f"sum{k}" for k in sums])
    rows = rows.withColumn("q", F.last(F.when(known, place), ignorenulls=True).over(time.rangeBetween(Window.unboundedPreceding, -1)))
    here = F.when(F.col("ret").isNotNull(), 1.0).otherwise(0.0)
    gap = F.col("was_live").cast("double")
    square = [F.lit(1.0), F.col("mkt"), F.col("mkt") * F.col("mkt")]
    # what a row and the gap before it add to the number of returns, to the market's sum and to its squares
    rows = rows.withColumns({f"add{k}": F.when(known, here * square[k] + F.coalesce(gap * (F.col(f"to{k}") - F.col(f"q.sum{k}")), F.lit(0.0))) for k in sums})
    frame = time.rangeBetween(-window, -1)
    first = F.first(F.when(known, F.struct(gap.alias("gap"), *[F.col(f"q.sum{k}").alias(f"sum{k}") for k in sums])), ignorenulls=True).over(frame)
    rows = rows.withColumns({"f": first, **{f"w{k}": F.coalesce(F.sum(f"add{k}").over(frame), F.lit(0.0)) for k in sums}, "n": F.count("ret").over(frame), "mean": F.avg("ret").over(frame), "var": F.var_pop("ret").over(frame), "cross": F.sum(F.col("ret") * F.col("mkt")).over(frame), "paid": F.when(F.count("money").over(frame) >= min_obs, F.avg("money").over(frame))})
    held = F.col("q.i") >= F.col("i") - window

    def total(k):
        head = F.coalesce(F.col("f.gap") * (F.col(f"from{k}") - F.col(f"f.sum{k}")), F.lit(0.0))
        tail = F.coalesce(F.col("q.live") * (F.col(f"to{k}") - F.when(held, F.col(f"q.sum{k}")).otherwise(F.col(f"from{k}"))), F.lit(0.0))
        return F.col(f"w{k}") - head + tail

    rows = rows.withColumns({"all": total(0), "m": div(total(1), total(0)), "mm": div(total(2), total(0)), "x": F.coalesce(div(F.col("n") * F.col("mean"), total(0)), F.lit(0.0)), "xm": F.coalesce(div(F.col("cross"), total(0)), F.lit(0.0))})
    n, mean = F.col("n"), F.coalesce("mean", F.lit(0.0))
    m2 = F.coalesce(F.col("var") * n, F.lit(0.0)) + div(mean * mean * n * (F.col("all") - n), F.col("all"))
    enough = F.col("all") >= min_obs
    ret = F.coalesce("ret", F.when(~known & (F.col("q.live") > 0), 0.0))
    volatility = F.when(enough & (F.col("all") > 1), F.sqrt(m2 / (F.col("all") - 1)))
    spread = F.col("mm") - F.col("m") * F.col("m")
    beta = F.when(enough & (spread > NO_SPREAD * F.col("mm")), div(F.col("xm") - F.col("x") * F.col("m"), spread))
    made = [volatility.alias("volatility"), F.log1p("paid").alias("log_adv"), F.col("paid").alias("adv"), beta.alias("beta")]
    if at is None:
        return rows.select(*by, "datetime", "instrument", ret.alias("ret"), *made)
    return rows.where("_at is not null").select("_at.*", *made)


def volume_steps(panel: DataFrame, window: int = 20, min_obs: int = 10) -> DataFrame:
    """(datetime, instrument, adv) on the dates on which a name's mean traded value may change: after one of its rows, and when that leaves the window."""
    by = keys_of(panel)
    days = panel.select(*by, "datetime").distinct()
    w = Window.partitionBy(*by).orderBy("datetime")  # one row per date
    days = days.select(*by, "datetime", F.array_compact(F.array(F.lead("datetime").over(w), F.lead("datetime", window + 1).over(w))).alias("changes"))
    paid = panel.where("close is not null and volume is not null").join(F.broadcast(days), [*by, "datetime"])
    return exposures(panel, window, min_obs, paid.select(*by, "instrument", F.explode("changes").alias("datetime")).distinct()).select(*by, "datetime", "instrument", "adv")


def usual_volume(panel: DataFrame, window: int = 20, min_obs: int = 10) -> DataFrame:
    """(datetime, mid): the median of the names' mean traded values of each date, which stands in for a missing one."""
    by = keys_of(panel)
    days = panel.select(*by, "datetime").distinct()
    days = days.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("datetime")))
    whole = days.groupBy(*by).agg(F.sort_array(F.collect_list("datetime")).alias("days"))
    steps = volume_steps(panel, window, min_obs).join(F.broadcast(days), [*by, "datetime"])
    steps = steps.withColumn("until", F.lead("i").over(Window.partitionBy(*by, "instrument").orderBy("i"))).where("adv is not null")
    steps = steps.join(F.broadcast(whole), by) if by else steps.crossJoin(F.broadcast(whole))
    # a value counts on each date on which it stands
    each = steps.select(*by, "adv", F.explode(F.slice("days", F.col("i"), F.coalesce("until", F.size("days") + 1) - F.col("i"))).alias("datetime"))
    return each.groupBy(*by, "datetime").agg(F.percentile("adv", F.lit(0.5)).alias("mid"))


def market_features(panel: DataFrame, window: int = 20) -> DataFrame:
    """Per date: market return, and lagged by one date its volatility and trend, the cross-sectional dispersion and liquidity.

    Liquidity is the mean over names with a traded value on each date of the window, so only a
    name's own rows matter: their first date must be the window's.
    """
    rows = _with_returns(panel.select("datetime", "instrument", "close", (F.col("close") * F.col("volume")).alias("money")), [])
    frame = _in_time().rowsBetween(-(window - 1), 0)
    rows = rows.withColumns({"since": F.when(F.count("money").over(frame) == window, F.first("datetime").over(frame)), "paid": F.avg("money").over(frame)})
    days = _calendar_of(rows, [])
    w = Window.orderBy("datetime")  # one row per date
    days = days.withColumn("since", F.lag("datetime", window - 1).over(w) if window > 1 else F.col("datetime"))
    paid = rows.where("since is not null").groupBy("datetime", "since").agg(F.avg("paid").alias("adv"))
    day = days.join(paid, ["datetime", "since"], "left")
    frame = w.rowsBetween(-(window - 1), 0)
    full = lambda c, x: F.when(F.count(c).over(frame) == window, x.over(frame))
    f = day.select("datetime", F.col("mkt").alias("mkt_ret"), full("mkt", F.stddev_samp("mkt")).alias("v"), full("mkt", F.avg("mkt")).alias("t"), full("disp", F.avg("disp")).alias("d"), F.log1p("adv").alias("l"))
    return f.select("datetime", "mkt_ret", *[F.lag(a).over(w).alias(b) for a, b in (("v", "mkt_vol"), ("t", "mkt_trend"), ("d", "xs_disp"), ("l", "mkt_liq"))])


def edges(fit: DataFrame, x: str, n_buckets: int) -> list[float]:
    """Inner bucket edges: the distinct linear quantiles of the fitting dates."""
    qs = [k / n_buckets for k in range(1, n_buckets)]
    got = fit.agg(F.percentile(x, F.array(*map(F.lit, qs))).alias("q")).first()["q"] if qs else []
    return sorted(set(got or []))


def place(x: Column, inner: list[float]) -> Column:
    """How many inner edges lie below the value."""
    below = F.lit(0)
    for e in inner:
        below = below + F.when(x > e, 1).otherwise(0)
    return F.when(x.isNotNull(), below)


def regime_labels(features: DataFrame, fit: DataFrame, mode: str = "vol", n_buckets: int = 3) -> DataFrame:
    """(datetime, label): ``vol_i``, or ``vol_i_liq_j`` in mode ``vol_liq``; edges come from ``fit``."""
    vol = place(F.col("mkt_vol"), edges(fit, "mkt_vol", n_buckets)).cast("string")
    label = F.concat(F.lit("vol_"), vol)
    if mode == "vol_liq":
        label = F.concat(label, F.lit("_liq_"), place(F.col("mkt_liq"), edges(fit, "mkt_liq", n_buckets)).cast("string"))
    elif mode != "vol":
        raise ValueError(f"unknown regime mode: {mode}")
    return features.select("datetime", label.alias("label"))


def regime_stats(labels: DataFrame) -> DataFrame:
    """Dates with a label, distinct labels, and the share of steps on which the label changes."""
    known = labels.where("label is not null").withColumn("_p", F.lag("label").over(Window.orderBy("datetime")))
    changed = F.sum(F.when(F.col("_p") != F.col("label"), 1).otherwise(0))
    return known.agg(F.count("*").alias("n_dates"), F.countDistinct("label").alias("n_labels"), F.coalesce(div(changed.cast("double"), (F.count("*") - 1).cast("double")), F.lit(0.0)).alias("switch_rate"))


def regime_buckets(features: DataFrame, x: str, n_buckets: int = 3) -> DataFrame:
    """(datetime, label): full-sample quantile buckets of a feature, a missing feature taken as the median."""
    mid = features.agg(F.percentile(x, F.lit(0.5)).alias("m"))
    filled = features.crossJoin(F.broadcast(mid)).withColumn(x, F.coalesce(x, "m"))
    return filled.select("datetime", place(F.col(x), edges(filled, x, n_buckets)).cast("string").alias("label"))


def regime_performance(daily: DataFrame, labels: DataFrame, keys: list[str], x: str) -> DataFrame:
    """The summary of a daily series within each label."""
    return summarize(daily.join(labels.where("label is not null"), "datetime"), [*keys, "label"], x)


def residual_weights(w, x, ridge: float = 1e-8):
    """Weights of one cross-section less their regression on exposures ``x`` (a missing one is the median) and a constant; too few names: unchanged."""
    import numpy as np

    x = np.where(np.isfinite(x), x, np.nan)
    known = np.isfinite(x).any(axis=0) if len(x) else np.zeros(x.shape[1], bool)
    mid = np.zeros(x.shape[1])
    mid[known] = np.nanmedian(x[:, known], axis=0)
    x = np.where(np.isnan(x), mid, x)
    if len(w) < 3 or len(w) <= x.shape[1] + 1:
        return w
    a = np.column_stack([np.ones(len(w)), x])
    return w - a @ np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ w)


def neutralize(weights: DataFrame, exposure: DataFrame | None, columns: list[str], keys: list[str], ridge: float = 1e-8) -> DataFrame:
    """Residuals of each date's weights on the exposures and a constant; too few names: unchanged.

    Without a table of exposures they are columns of the weights.
    A missing exposure is the date's median (zero where no name has one).
    """
    names = [f"_x{i}" for i in range(len(columns))]
    joined = weights
    if exposure is not None:
        on = [c for c in (*keys, "datetime", "instrument") if c in exposure.columns]
        joined = weights.join(exposure.select(*on, *columns), on, "left")
    joined = joined.withColumns({x: scrub(F.col(c).cast("double")) for c, x in zip(columns, names)})
    group = [*keys, "datetime"]
    date = Window.partitionBy(*group)
    filled = joined.withColumns({x: F.coalesce(x, F.percentile(x, F.lit(0.5)).over(date), F.lit(0.0)) for x in names})
    xs = [F.lit(1.0), *map(F.col, names)]
    fitted = linear.coefficients(filled, xs, F.col("weight"), date, lambda a, b: F.sum(a * b), ridge, 1e-13)
    n, fit = F.count("*").over(date), sum((F.col("_coef")[j] * x for j, x in enumerate(xs)), F.lit(0.0))
    return fitted.select(*group, "instrument", (F.col("weight") - F.when((n >= 3) & (n > len(xs)), fit).otherwise(0.0)).alias("weight"))


def sector_dummies(instruments: DataFrame, sectors: DataFrame) -> tuple[DataFrame, list[str]]:
    """0/1 columns for each sector but the first in order; a missing sector is UNKNOWN."""
    known = instruments.join(sectors, "instrument", "left").withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")))
    names = sorted(r.sector for r in known.select("sector").distinct().collect())[1:]
    return known.select("instrument", *[(F.col("sector") == s).cast("double").alias(f"sector_{s}") for s in names]), [f"sector_{s}" for s in names]


def rescale_legs(weights: DataFrame, keys: list[str], long: float = 0.5, short: float = 0.5, scale_up: bool = True) -> DataFrame:
    """Each date's positive weights to sum ``long`` and negative ones to ``-short``; without ``scale_up`` legs only shrink."""
    by = Window.partitionBy(*keys, "datetime")
    w = F.col("weight")
    up, down = F.sum(F.when(w > 0, w)).over(by), -F.sum(F.when(w < 0, w)).over(by)
    a, b = F.coalesce(div(F.lit(long), up), F.lit(0.0)), F.coalesce(div(F.lit(short), down), F.lit(0.0))
    if not scale_up:
        a, b = F.least(a, F.lit(1.0)), F.least(b, F.lit(1.0))
    return weights.withColumn("weight", F.when(w > 0, w * a).when(w < 0, w * b).otherwise(0.0))


def clip_weights(weights: DataFrame, most: float, drop_below: float = 1e-12) -> DataFrame:
    w = F.least(F.greatest("weight", F.lit(-most)), F.lit(most))
    return weights.withColumn("weight", w).where(F.abs("weight") > drop_below)


__all__ = ["YEAR", "clip_weights", "edges", "exposures", "keys_of", "known_returns", "market_features", "neutralize", "place", "regime_buckets", "regime_labels", "regime_performance", "regime_stats", "rescale_legs", "residual_weights", "sector_dummies", "usual_volume", "volume_steps"]
