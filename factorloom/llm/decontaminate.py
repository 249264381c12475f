"""Benchmark decontamination: an FM-index per training shard, searched for all windows of the test items.

A shard is a run of about ``SHARD_BYTES`` of texts.  Words outside the items' vocabulary can't be in a window,
so a shard's index holds only its runs of vocabulary words that are as long as the shortest window.
Windows are searched backwards, all at once; rows are located by sampled suffix positions; the
occurrences of a document are merged into its spans.

The items are written to the shared folder in blocks of about ``BLOCK_BYTES``; a worker takes one
block after the other, of which it keeps two, so the benchmark's size bounds neither the driver's
nor a worker's memory.  Words are known by 64-bit hashes; a window's occurrence is one of its whole
sequence of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, arrow_map, chunks, gathered, kept_by_worker, scratch, text_bytes
from .fmindex import FMIndex
from .toxicity import OUTSIDE

WINDOW = 13
BLOCK_BYTES = 8 << 20
#: Bytes of the texts of a shard, and of those whose words are taken at once.
SHARD_BYTES, CHUNK = 16 << 20, 1 << 20


class Block:
    """Windows of a block of items: a vocabulary of word hashes, distinct windows, and the items of each."""

    def __init__(self, items: pa.Table):
        self.ids = ["" if x is None else str(x) for x in items["item_id"].to_pylist()]
        w = Words(*text_bytes(items["text"]), OUTSIDE, lower=True)
        self.vocabulary = np.unique(w.hash)
        symbol = np.searchsorted(self.vocabulary, w.hash) + 1
        rows, owner, lengths = [], [], []
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            if b > a:
                for s in range(a, max(b - WINDOW, a) + 1):
                    part = symbol[s : min(b, s + WINDOW)]
                    rows.append(np.concatenate([np.zeros(WINDOW - len(part), np.int64), part]))
                    owner.append(i)
                    lengths.append(len(part))
        table = np.array(rows, np.int64).reshape(-1, WINDOW)
        self.patterns, back = np.unique(table, axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        order = np.argsort(back.reshape(-1), kind="stable")
        self.owner = np.array(owner, np.int64)[order]
        self.owner_first = np.searchsorted(back.reshape(-1)[order], np.arange(len(self.patterns) + 1))
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0


@kept_by_worker(maxsize=2)
def _block(path: str) -> Block:
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        return Block(pa.parquet.read_table(f))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    begin = np.cumsum(size) - size
    return np.repeat(first - begin, size) + np.arange(size.sum())


class Occurrences:
    """Of a shard: words of each text, [row, first word, end word] spans, and (row, item id) pairs."""

    def __init__(self, texts: pa.Array, blocks: Iterable[Block]):
        data, offsets = text_bytes(texts)
        self.n_words = np.zeros(len(offsets) - 1, np.int64)
        parts = []  # of each chunk of texts: word hashes, row of each word, place of each word in its text
        for lo, hi in chunks(offsets, CHUNK):
            w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], OUTSIDE, lower=True)
            self.n_words[lo:hi] = np.diff(w.first)
            row = w.rows()
            parts.append((w.hash, (lo + row).astype(np.int32), (np.arange(w.n) - w.first[row]).astype(np.int32)))
        spans, pairs = [np.zeros((0, 3), np.int64)], set()
        for block in blocks:
            if block.shortest:
                self._search(block, [self._runs(block, *p) for p in parts if len(p[0])], spans, pairs)
        self.spans = np.concatenate(spans)
        self.pairs = sorted(pairs)

    @staticmethod
    def _runs(block: Block, hashes: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple:
        """The runs of the block's vocabulary, as long as its shortest window: symbols, rows, places, and the runs' ends."""
        at = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
        known = block.vocabulary[at] == hashes
        edge = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (row[1:] != row[:-1])]))
        size = np.diff(edge, append=len(hashes))
        good = known[edge] & (size >= block.shortest)
        edge, size = edge[good], size[good]
        word = _ranges(edge, size)
        return at[word] + 1, row[word].astype(np.int64), place[word].astype(np.int64), np.cumsum(size)

    @staticmethod
    def _search(block: Block, kept: list, spans: list, pairs: set) -> None:
        symbols, rows, words = [], [], []
        for s, r, w, ends in kept:
            cut = ends - 1
            size = len(s) + len(ends)
            at = np.arange(len(s)) + np.searchsorted(cut, np.arange(len(s)), "left")
            for out, values in ((symbols, s), (rows, r), (words, w)):
                full = np.zeros(size, np.int64)
                full[at] = values
                out.append(full)
        if not symbols or not sum(map(len, symbols)):
            return
        symbols, rows, words = (np.concatenate(x) for x in (symbols, rows, words))
        index = FMIndex(symbols, len(block.vocabulary) + 1)
        lo, hi = index.search(block.patterns, block.lengths)
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        pattern = np.repeat(found, count)
        position = index.locate(_ranges(lo[found], count))
        first = words[position]
        spans.append(np.stack([rows[position], first, first + block.lengths[pattern]], axis=1))
        n_owner = np.diff(block.owner_first)[pattern]
        owner = block.owner[_ranges(block.owner_first[pattern], n_owner)]
        key = np.unique(np.repeat(rows[position], n_owner) * len(block.ids) + owner)
        pairs.update((int(k // len(block.ids)), block.ids[int(k % len(block.ids))]) for k in key)

    def merged(self) -> np.ndarray:
        """The spans, those of a row that overlap or touch made one."""
        s = self.spans[np.lexsort((self.spans[:, 1], self.spans[:, 0]))]
        if not len(s):
            return s
        wide = int(s[:, 2].max()) + 1
        start, end = s[:, 0] * wide + s[:, 1], np.maximum.accumulate(s[:, 0] * wide + s[:, 2])
        new = np.concatenate([[True], (start[1:] > end[:-1]) | (s[1:, 0] != s[:-1, 0])])
        last = np.concatenate([np.flatnonzero(new)[1:], [len(s)]]) - 1
        return np.stack([s[new, 0], s[new, 1], end[last] - s[new, 0] * wide], axis=1)


def write_blocks(benchmark: DataFrame) -> list[str]:
    """Files of item blocks in the shared folder."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    folder = scratch(benchmark.sparkSession, "benchmark")
    items.repartition(total // BLOCK_BYTES + 1, F.xxhash64("item_id", "text")).write.parquet(folder)
    fs, name = pyarrow.fs.FileSystem.from_uri(folder)
    prefix = folder[: len(folder) - len(name)]
    return sorted(prefix + f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(name)) if f.path.endswith(".parquet"))


COLUMNS = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "spans": pa.list_(pa.list_(pa.int64()))}


def contamination(docs: DataFrame, benchmark: DataFrame, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and, under ``prefix``: n_words, n_hit (words inside an occurrence of a window),
    n_items (ids with occurring windows), items_sha256 (of those ids), contaminated
    (n_hit > 0 and 20 * n_hit >= n_words) and spans ([first word, end word] to remove, merged).

    Null texts have no words; items with null or empty texts have no windows; a null item id counts
    as an empty one, items of one id count once.  Equal texts have equal values.
    """
    paths = write_blocks(benchmark)

    def run(batches):
        for batch in gathered(batches, "text", SHARD_BYTES):
            found = Occurrences(batch["text"].cast(pa.string()), map(_block, paths))
            n = batch.num_rows
            spans = found.merged()
            hit = np.bincount(spans[:, 0], spans[:, 2] - spans[:, 1], n).astype(np.int64)
            items: list[list[str]] = [[] for _ in range(n)]
            for row, item in found.pairs:
                items[row].append(item)
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            lists: list[list] = [[] for _ in range(n)]
            for row, a, b in spans.tolist():
                lists[row].append([a, b])
            values = [found.n_words, hit, [len(x) for x in items], sha, (hit > 0) & (20 * hit >= found.n_words), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(values, COLUMNS.values()))], [*batch.schema.names, *(prefix + c for c in COLUMNS)])

    kinds = dict(zip(COLUMNS, ("long", "long", "long", "string", "boolean", "array<array<long>>")))
    added = StructType.fromDDL(", ".join(f"{prefix}{c} {kind}" for c, kind in kinds.items()))
    return arrow_map(docs, run, StructType([*docs.schema.fields, *added.fields]))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return contamination(docs, benchmark, prefix).where(~F.col(f"{prefix}contaminated")).select(docs.columns)
