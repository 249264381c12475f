"""Suffix-array dedup: repeated passages of ``WINDOW`` words or more, all but their first occurrence removed.

Suffixes are retained at minimiser positions only (see ``repeats``; the minimisers select them by
content).  In a shard the retained suffixes are sorted by their words, and neighbours are compared:
the suffixes that share k words with each other are a run of the order without a smaller common
prefix.  A match is extended to the left in the same way, over the words before the minimiser, read
backwards.  A window with b words left of its minimiser occurs wherever b words agree to the left
and the others to the right; all comparisons are of whole words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACE, arrow_map, dealt_anew
from .repeats import GRAM, NO_ID, Contents, keyed, merged, repeated
from .substring import digest

WINDOW = 50


class Sorted:
    """Sequences of word numbers (zeros after the end) in order within their groups, with what neighbours have in common."""

    def __init__(self, matrix: np.ndarray, group: np.ndarray):
        n, width = matrix.shape
        rows = np.concatenate([group.astype(">u4")[:, None], matrix.astype(">u4")], axis=1)
        self.order = np.argsort(np.ascontiguousarray(rows).view(f"S{4 * (width + 1)}").reshape(-1), kind="stable")
        a, b = matrix[self.order[:-1]], matrix[self.order[1:]]
        same = (a == b) & (a > 0)
        common = np.where(same.all(axis=1), width, same.argmin(axis=1)) if width else np.zeros(max(n - 1, 0), np.int64)
        common[group[self.order[:-1]] != group[self.order[1:]]] = -1
        self.common = np.concatenate([np.full(min(n, 1), -1), common])

    def runs(self, k: int) -> np.ndarray:
        """For each sequence the number of its run: those of its group that share its first k words."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < k)
        return out


def suffix_groups(c: Contents) -> np.ndarray:
    """For each window a group of equal windows."""
    group = np.unique(c.rows["h"], return_inverse=True)[1]
    m, n = c.rows["m"].astype(np.int64), c.rows["n"].astype(np.int64)
    at, end = c.first + m, c.first + c.size
    step = np.arange(c.window)
    right = np.where(step < (end - at)[:, None], c.text[np.minimum(at[:, None] + step, len(c.text) - 1)], 0)
    step = step[: c.window - GRAM]
    left = np.where(step < m[:, None], c.text[np.maximum(at[:, None] - 1 - step, 0)], 0)
    suffixes, before = Sorted(right, group), Sorted(left, group)
    out, number = np.empty(len(c.at), np.int64), 0
    for b in range(c.window - GRAM + 1):  # windows with b words left of the minimiser
        some = np.flatnonzero((m >= b) & (m - b < n))
        if len(some):
            kinds, which = np.unique(suffixes.runs(c.window - b)[some] * (len(m) + 1) + before.runs(b)[some], return_inverse=True)
            out[c.window_of[some] + m[some] - b] = number + which
            number += len(kinds)
    return out


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each row.

    ``spans`` are [first word, end word] of what is removed: words of windows whose sequence occurs
    earlier (by doc_id, null ids first, then text, then place).  Rows with equal id and text are one
    text: all keep its first occurrences.  Null, empty and short texts lose nothing.
    """
    texts = keyed(docs)
    return digest(texts, repeated(texts, window, suffix_groups, keep_first=True))


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; a removed run goes with the white space after it."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start = [*edge[0::2].tolist(), len(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : start[a]])
        at = start[b]
    return b"".join([*out, raw[at:]]).decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated passages cut out of its texts, ``n_chars`` renewed; all rows and columns stay."""
    texts = keyed(docs)
    spans = repeated(texts, window, suffix_groups, keep_first=True)
    names, own = docs.columns, "_spans"
    while own in names:
        own += "_"
    spans = dealt_anew(spans, "rid", "rkey")
    joined = docs.join(spans.select("rid", "rkey", F.col("spans").alias(own)), (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == spans["rid"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == spans["rkey"]), "left").select(*[docs[f"`{c}`"] for c in names], own)

    def run(batches):
        for batch in batches:
            texts, lists = batch["text"].to_pylist(), batch[own].to_pylist()
            cut = [t if not s else cut_text(t, merged(s)) for t, s in zip(texts, lists)]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(cut, batch.schema.field("text").type)
            if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                chars = [old if not s else len(t) for old, s, t in zip(columns["n_chars"].to_pylist(), lists, cut)]
                columns["n_chars"] = pa.array(chars, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return arrow_map(joined, run, StructType(docs.schema.fields))
