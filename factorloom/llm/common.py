"""Shared parts of the text operators: the shared folder, digests, vectorised word hashing.

Everything that must be seen by more than one process is written below the folder that the
session names in ``spark.checkpoint.dir``.  Only where that setting is missing and all runs in one
process (tests) a fresh folder is made.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contracts name it: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-casing of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()
#: Text bytes handled at once by the vectorised code (one longer text is handled alone).
CHUNK_BYTES = 1 << 18
#: Rows of an Arrow batch.
BATCH_ROWS, _BATCH = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share; a path without a scheme is one of the default file system."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factorloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    if "://" not in root:
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = re.sub(r"^file:/+", "file:///", root)
    return root.rstrip("/")


#: Where scratch folders are made, if not in the shared folder itself.
_within: ContextVar[str | None] = ContextVar("_within", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder URI below the shared folder, or below that of the ``stage_folder`` around the call."""
    return f"{_within.get() or shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def stage_folder(spark: SparkSession, name: str):
    """What the block writes to scratch folders lies in one folder of its own, which is deleted at the end, also after a failure.

    The block must write what is to be kept to a folder that was made outside.  Other threads, and
    tables made before or after, are not concerned.
    """
    folder = scratch(spark, name)
    token = _within.set(folder)
    try:
        yield folder
    finally:
        _within.reset(token)
        _delete(spark, folder)


def materialise(df: DataFrame, name: str, rows: int | None = None, per_file: int = 200_000, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (or ``path``) and read it back: cuts lineage, survives lost executors.

    With a known (or greatest) number of ``rows`` it becomes one file for each ``per_file`` of them.
    The driver gives back memory before.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    give_back()
    (df if rows is None else df.coalesce(-(-max(rows, 1) // per_file))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables of which nothing will be read again."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What empties the things that a worker keeps from one task to the next, and the module whose tasks it ran last.
FORGET: list[Callable[[], None]] = []
_last: dict[str, str] = {}


def kept_by_worker(maxsize: int):
    """``lru_cache`` for what a worker keeps from one task to the next; it is emptied when the worker turns to another module's tasks."""

    def cached(f):
        out = lru_cache(maxsize=maxsize)(f)
        FORGET.append(out.cache_clear)
        return out

    return cached


def turn_to(module: str) -> None:
    """Spark's workers live on from stage to stage: what the tasks of another module kept goes before those of this one begin."""
    if _last.get("module") != module:
        _last["module"] = module
        for forget in FORGET:
            forget()


def give_back() -> None:
    """Memory that Arrow and the C library hold without need goes back to the system; without this a worker stays as large as it ever was."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, in batches of ``BATCH_ROWS`` rows where the session has not chosen a size: ten thousand whole texts are too much for a worker.

    A worker keeps things of one module's tasks at a time, and gives back memory at the end of each task.
    """
    conf, module = df.sparkSession.conf, run.__module__
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))

    def task(batches):
        turn_to(module)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def gathered(batches, column: str, most: int):
    """Consecutive batches joined, up to about ``most`` bytes of a column each."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch[column].nbytes > most:
            yield _joined(held)
            held, size = [], 0
        held.append(batch)
        size += batch[column].nbytes
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if sum(b.num_rows for b in batches) else batches[0]


def dealt_anew(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, an aggregate, without its partitioning: a join deals it again, and so can split the other side's hot keys."""
    return df.withColumns({c: F.col(c).bitwiseXOR(F.lit(0).cast("long")) for c in columns})


def text_of(text_col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5 = 0 (a null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
_powers: dict[str, np.ndarray] = {}
FORGET.append(_powers.clear)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**i and mult**-i (mod 2**64) for i < n."""
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK_BYTES + 1)
        up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
        up[0] = down[0] = 1
        done, a, b = 1, _MULT, _INVERSE
        while done < n:
            k = min(done, n - done)
            up[done : done + k] = up[:k] * np.uint64(a)
            down[done : done + k] = down[:k] * np.uint64(b)
            done, a, b = done + k, a * a % (1 << 64), b * b % (1 << 64)
        _powers["up"], _powers["down"] = up, down
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string or binary column, end to end, and the n + 1 offsets (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide) if column.type != wide else column
    if column.null_count:
        column = column.fill_null("" if wide == pa.large_string() else b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows of at most ``limit`` bytes each (or of one longer row)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """The words of a run of texts: for word i its row, byte span and 64-bit hash, in order.

    ``first[r]:first[r + 1]`` are the words of row r.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE, lower: bool = False, hashes: bool = True):
        self.data = data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = np.zeros(n + 2, bool)
        np.logical_not(outside[data], out=inside[1:-1])
        edge = inside[1:] != inside[:-1]
        cuts = offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])  # rows without text share their place
        # a row's end splits a word that touches the next row's first word
        joined = cuts[inside[cuts] & inside[cuts + 1]]
        where = np.flatnonzero(edge)
        if len(joined):
            where = np.sort(np.concatenate([where, joined, joined]), kind="stable")
        self.start, self.end = where[0::2], where[1::2]
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)
        self.n = len(self.start)
        if hashes:
            up, down = _power(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * down[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for each i (len(h) - k + 1 values; row borders are the caller's matter)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])


def span_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of h[lo:hi] for each pair of bounds; the length counts too."""
    up, down = _power(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def dense_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts numbered from 1 by their bytes, and the n + 1 places of the texts' first words."""
    w = Words(data, offsets, hashes=False)
    size = w.end - w.start
    ends = np.cumsum(size)
    at = np.repeat(w.start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    bounds = np.concatenate([[0], ends]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), w.n, [None, pa.py_buffer(bounds), pa.py_buffer(data[at])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1, w.first


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of values[i : i + w], for each i (by doubling)."""
    n = len(values)
    if n < w:
        return np.zeros(0, np.int64)
    best, span = np.arange(n), 1
    while span < w:
        step = min(span, w - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        span += step
    return best


def run_groups(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
