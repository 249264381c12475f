"""Run folders: what a research run leaves behind, and listing, comparing and replaying runs."""

from __future__ import annotations

import hashlib
import io
import json
import re
import time
import uuid
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def stable_json(value) -> str:
    return json.dumps(value, sort_keys=True, default=str)


def run_id(config: dict, thread: str = "main", now: datetime | None = None) -> str:
    """UTC time, thread and the start of the configuration's hash."""
    now = now or datetime.now(timezone.utc)
    thread = re.sub(r"[^A-Za-z0-9._-]+", "-", thread).strip("-.")[:40] or "main"
    return f"{now:%Y%m%dT%H%M%SZ}_{thread}_{hashlib.sha256(stable_json(config).encode()).hexdigest()[:10]}"


class Store:
    """Files below a folder of any file system that Spark knows; a path without a scheme is one of the default file system.

    A file appears under its name only when it is whole.
    """

    def __init__(self, root: str):
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.root, self._jvm = root.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def write(self, name: str, data: str | bytes) -> None:
        folder, _, last = name.rpartition("/")
        half = f"{folder}/.{last}.{uuid.uuid4().hex}".lstrip("/")
        out = self._fs.create(self._path(half), True)
        out.write(data if isinstance(data, bytes) else data.encode())
        out.close()
        self._fs.delete(self._path(name), False)
        self.rename(half, name)

    def rename(self, name: str, other: str) -> None:
        if not self._fs.rename(self._path(name), self._path(other)):
            raise OSError(f"cannot rename {self.root}/{name} to {other}")

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


#: Folders of entries, one file for each run, so that runs can be added side by side; and of unfinished runs.
INDEX, REGISTRY, PENDING = "_index", "_factor_registry", "_pending"


def save_run(root: str, config: dict, tables: dict[str, DataFrame], result: dict | None = None, daily: DataFrame | None = None, factors: dict[str, str] | None = None, thread: str = "main", selected: list[dict] | None = None, reports: dict[str, dict] | None = None) -> str:
    """Writes a run's folder and adds it to the index; returns the folder.

    A run is written aside; its folder is renamed when it is whole, and only then it is indexed.  A
    run that fails leaves neither.  Small tables become CSV files by way of the driver, so they must
    be summaries (metrics, sweeps, correlations, curves); the daily paths are written by Spark, a
    folder for each alpha.  ``selected``: the chosen alphas; ``reports``: of each name a report, whose
    rows (``results``) become a CSV file of their own, with the Pareto rows once more beside it.
    """
    store, name = Store(root), run_id(config, thread)
    if store.exists(name):
        name += "-" + uuid.uuid4().hex[:6]
    folder = f"{PENDING}/{name}"
    store.make(folder)
    try:
        _write_run(store, folder, name, config, tables, result, daily, selected, reports)
        store.rename(folder, name)
    except BaseException:
        store.delete(folder)
        raise
    entry = f"{time.time_ns():020d}-{name}"
    if factors:
        lines = [stable_json({"run_id": name, "alpha_id": alpha, "dsl": text, "dsl_hash": hashlib.sha256(text.encode()).hexdigest()}) for alpha, text in factors.items()]
        store.write(f"{REGISTRY}/{entry}.jsonl", "\n".join(lines) + "\n")
    store.write(f"{INDEX}/{entry}.jsonl", stable_json({"run_id": name, "thread": thread, "tables": sorted(tables)}) + "\n")
    store.write("LATEST", name)
    return f"{store.root}/{name}"


def _write_run(store: Store, folder: str, name: str, config: dict, tables: dict[str, DataFrame], result: dict | None, daily: DataFrame | None, selected: list[dict] | None, reports: dict[str, dict] | None) -> None:
    store.write(f"{folder}/config.json", stable_json(config))
    store.write(f"{folder}/result.json", stable_json(result or {}))
    parts = [f"# Run {name}", ""]
    for key, df in tables.items():
        frame = df.toPandas()
        store.write(f"{folder}/{key}.csv", frame.to_csv(index=False))
        parts += [f"## {key}", "", f"{len(frame)} rows", "", "```", frame.head(10).to_string(index=False), "```", ""]
    if selected is not None:
        store.write(f"{folder}/sota_alphas.json", json.dumps(selected, indent=1, default=str))
    for key, report in (reports or {}).items():
        store.write(f"{folder}/{key}.json", json.dumps(report, indent=1, default=str))
        rows = [r for r in report.get("results", []) if isinstance(r, dict)]
        for name_, some in ((key, rows), (f"{key}_pareto", [r for r in rows if r.get("is_pareto")])):
            if some:
                store.write(f"{folder}/{name_}.csv", pd.DataFrame(some).to_csv(index=False))
        picture = _plot(rows) if any("is_pareto" in r for r in rows) else None
        if picture:
            store.write(f"{folder}/{key}_pareto.png", picture)
    if daily is not None:
        daily.write.mode("overwrite").partitionBy("alpha_id").csv(f"{store.root}/{folder}/daily", header=True)
    store.write(f"{folder}/SUMMARY.md", "\n".join(parts))


def _plot(rows: list[dict], x: str = "alpha_weight_turnover_mean", y: str = "objective") -> bytes | None:
    """The rows with the front marked, as a picture, where a plotting library is installed."""
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return None
    axes = (figure := Figure()).add_subplot()
    for front in (False, True):
        some = [r for r in rows if bool(r.get("is_pareto")) == front and x in r and y in r]
        axes.scatter([r[x] for r in some], [r[y] for r in some], label="front" if front else "others")
    axes.set(xlabel=x, ylabel=y)
    axes.legend()
    out = io.BytesIO()
    figure.savefig(out, format="png")
    return out.getvalue()


def metrics_table(summary: DataFrame, evaluation: DataFrame | None = None, stability: DataFrame | None = None, gates: DataFrame | None = None) -> DataFrame:
    """One row for each alpha: its summary, means of its evaluation, walk-forward stability and quality gates; best information ratio first."""
    from pyspark.sql import functions as F

    out = summary
    if evaluation is not None:
        out = out.join(evaluation.groupBy("alpha_id").agg(*[F.avg(c).alias(f"{c}_mean") for c in ("ic", "rank_ic", "spread", "coverage") if c in evaluation.columns]), "alpha_id", "left")
    if stability is not None:
        out = out.join(stability.select("alpha_id", *[F.col(c).alias(f"wf_{c}") for c in stability.columns if c != "alpha_id"]), "alpha_id", "left")
    if gates is not None:
        out = out.join(gates.select("alpha_id", F.col("passed").alias("quality_gate_passed"), F.concat_ws(",", "reasons").alias("quality_gate_reasons")), "alpha_id", "left")
    return out.orderBy(F.col("information_ratio").desc_nulls_last(), "alpha_id")


def _lines(text: str) -> list[dict]:
    """JSON lines; lines that don't parse are left out."""
    out = []
    for line in text.splitlines():
        try:
            out.append(json.loads(line))
        except ValueError:
            continue
    return out


def _entries(root: str, folder: str) -> list[dict]:
    store = Store(root)
    return [x for name in store.names(folder) if not name.startswith(".") for x in _lines(store.read(f"{folder}/{name}") or "")]


def list_runs(root: str) -> list[dict]:
    """The runs of the index, in the order in which they ended."""
    return _entries(root, INDEX)


def list_factors(root: str) -> list[dict]:
    """The registered factors of all runs."""
    return _entries(root, REGISTRY)


def load_config(root: str, name: str) -> dict:
    text = Store(root).read(f"{name}/config.json")
    if text is None:
        raise FileNotFoundError(f"{root}/{name}/config.json")
    return json.loads(text)


def compare_runs(root: str, a: str, b: str) -> dict:
    """Settings in which two runs differ: name to (value in a, value in b)."""
    x, y = load_config(root, a), load_config(root, b)
    return {k: (x.get(k), y.get(k)) for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k)}


def compare_metrics(root: str, a: str, b: str, columns: tuple[str, ...] = ("information_ratio", "annualized_return", "max_drawdown", "turnover_mean")) -> pd.DataFrame:
    """Of each alpha of either run the metrics in a and b and their difference."""
    tables, store = [], Store(root)
    for name in (a, b):
        text = store.read(f"{name}/alpha_metrics.csv")
        table = pd.DataFrame({"alpha_id": []}) if text is None else pd.read_csv(io.StringIO(text))
        tables.append(table[[c for c in ("alpha_id", *columns) if c in table]])
    both = tables[0].merge(tables[1], on="alpha_id", how="outer", suffixes=("_a", "_b"))
    for c in columns:
        if f"{c}_a" in both and f"{c}_b" in both:
            both[f"{c}_delta"] = both[f"{c}_b"] - both[f"{c}_a"]
    return both.sort_values("alpha_id").reset_index(drop=True)
