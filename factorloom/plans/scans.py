"""Operators in time whose cost for a row does not depend on the window: recursions, running sums, sliding order.

All take a table and a list of work items that name an input column, and add a column for each item.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import scrub

#: Windows up to which the values of a window are read one by one.
SMALL = 16
#: How far (as a logarithm) weights may fall before a recursion starts anew.
REACH = 300.0


def _time(*also: str):
    return Window.partitionBy("instrument", *also).orderBy("datetime")


def _ever(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def exponential(df: DataFrame, todo: list[tuple[str, str, str, int]]) -> DataFrame:
    """Exponentially weighted means and deviations; items are (input, output, ``ewm_mean`` or ``ewm_std``, span).

    Both are recursions y = a * y + b with a and b known for each row, that is, affine maps, which can
    be composed.  An instrument's rows are cut where the product of the a has fallen by another
    e**REACH; within such a chunk y is the product of its a times the running sum of b over products,
    and what comes into a chunk is the chunk before: anything earlier weighs less than e**-REACH.

    A missing value has no weight, but the weights of those before it fall by one more step.
    """
    kept, time = df.columns, _time()
    df = df.withColumn("_i", F.row_number().over(time))
    ids = {key: f"_e{n}" for n, key in enumerate(dict.fromkeys((x, span) for x, _, _, span in todo))}
    for x in dict.fromkeys(x for x, _ in ids):
        df = df.withColumn(x, scrub(F.col(x)))
    before = {x: F.last(F.when(F.col(x).isNotNull(), F.col("_i")), ignorenulls=True).over(time.rowsBetween(Window.unboundedPreceding, -1)) for x, _ in ids}
    df = df.withColumns({f"_p{n}": before[x] for (x, _), n in ids.items()})
    steps = {}
    for (x, span), n in ids.items():
        alpha = 2.0 / (span + 1)
        old = F.pow(F.lit(1 - alpha), F.col("_i") - F.col(f"_p{n}"))
        # a value keeps this share of what was before it
        share = F.when(F.col(x).isNull() | F.col(f"_p{n}").isNull(), 1.0).otherwise(F.greatest(old / (old + alpha), F.exp(F.lit(-REACH))))
        steps[f"_a{n}"] = share
    df = df.withColumns(steps)
    df = df.withColumns({f"_c{n}": F.floor(F.sum(-F.ln(f"_a{n}")).over(_ever(time)) / REACH) for n in ids.values()})
    chunk = {n: _ever(_time(f"_c{n}")) for n in ids.values()}
    df = df.withColumns({f"_w{n}": F.product(F.col(f"_a{n}")).over(chunk[n]) for n in ids.values()})

    def scanned(df: DataFrame, name: str, added: dict[str, Column]) -> DataFrame:
        """With the recursion ``name`` + n for each n of ``added``, the b of its rows."""
        df = df.withColumns({f"{name}{n}": F.col(f"_w{n}") * F.sum(b / F.col(f"_w{n}")).over(chunk[n]) for n, b in added.items()})
        df = df.withColumns({f"_l{n}": F.lag(f"{name}{n}").over(time) for n in added})
        return df.withColumns({f"{name}{n}": F.col(f"{name}{n}") + F.coalesce(F.col(f"_w{n}") * F.first(f"_l{n}").over(chunk[n]), F.lit(0.0)) for n in added})

    first = {n: F.col(x).isNotNull() & F.col(f"_p{n}").isNull() for (x, _), n in ids.items()}
    value = {n: F.coalesce(F.when(first[n], F.col(x)).otherwise((1 - F.col(f"_a{n}")) * F.col(x)), F.lit(0.0)) for (x, _), n in ids.items()}
    df = scanned(df, "_m", value)
    wide = {(x, span): ids[x, span] for x, _, kind, span in todo if kind == "ewm_std"}
    if wide:
        df = df.withColumns({f"_b{n}": F.lag(f"_m{n}").over(time) for n in wide.values()})
        off = {n: F.coalesce(F.when(first[n], 0.0).otherwise(F.col(f"_a{n}") * (1 - F.col(f"_a{n}")) * F.pow(F.col(x) - F.col(f"_b{n}"), F.lit(2.0))), F.lit(0.0)) for (x, _), n in wide.items()}
        df = scanned(df, "_v", off)
    any_value = {n: F.col(x).isNotNull() | F.col(f"_p{n}").isNotNull() for (x, _), n in ids.items()}
    out = {o: F.when(any_value[n], F.col(f"_m{n}") if kind == "ewm_mean" else F.sqrt(f"_v{n}")) for x, o, kind, span in todo for n in [ids[x, span]]}
    return df.select(*kept, *[c.alias(o) for o, c in out.items()])


def lagged(name: str, x: Column, k: int) -> Column:
    """``ts_rank``, ``ts_argmax``, ``ts_argmin`` or ``ts_decay_linear`` of a small window, by its values one by one."""
    values = [x if j == 0 else F.lag(x, j).over(_time()) for j in range(k)][::-1]
    full = values[0].isNotNull()
    for v in values[1:]:
        full = full & v.isNotNull()
    if name == "ts_decay_linear":
        return F.when(full, sum((v * w for w, v in enumerate(values, 1)), F.lit(0.0)) / (k * (k + 1) / 2))
    if name == "ts_rank":
        less = sum((F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0) for v in values[:-1]), F.lit(1.0))
        return F.when(full, less / k)
    extreme = (F.greatest if name == "ts_argmax" else F.least)(*values) if k > 1 else x
    place = F.when(values[0] == extreme, 0.0)
    for j, v in enumerate(values[1:], 1):
        place = place.when(v == extreme, float(j))
    return F.when(full, place)


def decays(df: DataFrame, todo: list[tuple[str, str, int]]) -> DataFrame:
    """Linearly weighted means (input, output, k) from two running sums, of the values and of their places, that start anew every k rows.

    A window is the end of one run of k rows and the start of the next, so sums stay as small as a
    window's and lose nothing to rounding, however many rows there are.
    """
    kept, time = df.columns, _time()
    df = df.withColumn("_i", F.row_number().over(time) - 1)
    ids = {o: n for n, (_, o, _) in enumerate(todo)}
    x0 = {o: F.coalesce(x, F.lit(0.0)) for x, o, _ in todo}
    df = df.withColumns({**{f"_c{ids[o]}": F.floor(F.col("_i") / k) for _, o, k in todo}, **{f"_p{ids[o]}": (F.col("_i") % k).cast("double") for _, o, k in todo}, **{f"_n{ids[o]}": F.count(x).over(_ever(time)) for x, o, _ in todo}})
    made = {}
    for x, o, k in todo:
        n = ids[o]
        for i, v in enumerate((x0[o], x0[o] * F.col(f"_p{n}"))):
            made[f"_s{n}_{i}"] = F.sum(v).over(_ever(_time(f"_c{n}")))
            made[f"_t{n}_{i}"] = F.sum(v).over(Window.partitionBy("instrument", f"_c{n}"))
    df = df.withColumns(made)
    lag = {}
    for _, o, k in todo:
        n = ids[o]
        lag |= {f"_r{n}_{i}": F.coalesce(F.lag(F.col(f"_t{n}_{i}") - F.col(f"_s{n}_{i}"), k).over(time), F.lit(0.0)) for i in (0, 1)}
        lag[f"_full{n}"] = F.col(f"_n{n}") - F.coalesce(F.lag(f"_n{n}", k).over(time), F.lit(0)) == k
    df = df.withColumns(lag)
    out = []
    for _, o, k in todo:
        n = ids[o]
        p = F.col(f"_p{n}")
        total = (k - p) * F.col(f"_s{n}_0") + F.col(f"_s{n}_1") + F.col(f"_r{n}_1") - p * F.col(f"_r{n}_0")
        out.append(F.when(F.col(f"_full{n}"), total / (k * (k + 1) / 2)).alias(o))
    return df.select(*kept, *out)


class _Rank:
    """The share of the last k values that are less than the newest one (equal ones, itself included, count half, and a half more), kept in order."""

    def __init__(self, k: int, _name: str):
        self.k, self.window, self.ordered = k, deque(), []

    def __call__(self, x):
        self.window.append(x)
        if x is not None:
            insort(self.ordered, x)
        if len(self.window) > self.k:
            gone = self.window.popleft()
            if gone is not None:
                del self.ordered[bisect_left(self.ordered, gone)]
        if x is None or len(self.ordered) < self.k:
            return None
        less, upto = bisect_left(self.ordered, x), bisect_right(self.ordered, x)
        return (less + (upto - less + 1) / 2) / self.k


class _Extreme:
    """The place in the window of the first of its largest (smallest) values, by a queue of the values that can still become it."""

    def __init__(self, k: int, name: str):
        self.k, self.sign = k, 1 if name == "ts_argmax" else -1
        self.queue, self.i, self.missing = deque(), -1, -1

    def __call__(self, x):
        self.i += 1
        if x is None:
            self.missing = self.i
            self.queue.clear()
            return None
        while self.queue and self.queue[-1][1] * self.sign < x * self.sign:
            self.queue.pop()
        self.queue.append((self.i, x))
        start = self.i - self.k + 1
        while self.queue[0][0] < start:
            self.queue.popleft()
        return float(self.queue[0][0] - start) if self.missing < start and start >= 0 else None


def sliding(df: DataFrame, todo: list[tuple[str, str, str, int]]) -> DataFrame:
    """``ts_rank``, ``ts_argmax`` and ``ts_argmin`` of any window; items are (input, output, function, k).

    Rows stream in order of instrument and time; a task holds one window of values for each item, in
    an order structure that each row changes by one value in and one out.
    """
    schema = StructType([*df.schema.fields, *(StructField(o, DoubleType()) for _, o, _, _ in todo)])
    make = {"ts_rank": _Rank, "ts_argmax": _Extreme, "ts_argmin": _Extreme}

    def run(batches):
        now, states = object(), []
        for batch in batches:
            names, columns = batch["instrument"].to_pylist(), []
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            values = [batch[x].to_pylist() for x, *_ in todo]
            results = [[] for _ in todo]
            for lo, hi in zip(cuts, cuts[1:]):
                if names[lo] != now:
                    now, states = names[lo], [make[name](k, name) for _, _, name, k in todo]
                for v, state, out in zip(values, states, results):
                    out.extend(map(state, v[lo:hi]))
            columns = [pa.array(r, pa.float64()) for r in results]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    dealt = df.withColumns({x: scrub(F.col(x)) for x, *_ in todo}).repartition("instrument").sortWithinPartitions("instrument", "datetime")
    return dealt.mapInArrow(run, schema)
