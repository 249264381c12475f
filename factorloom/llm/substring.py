"""Substring dedup by compressed FM-indexes: windows of words that occur more than once are removed.

Shards are routed by content (see ``repeats``): an index of each input shard would have to be
searched with every document of the corpus.  A shard's index is a wavelet-tree BWT of its segments'
contents; the contents are streamed through it from their ends by backward search, all at once, and
where less than two rows are left the match is shortened from the right until it can go on.  So
each place gets its matching statistic: the longest run of words from there that is in the index
twice.  Windows that it covers are repeated, and so are those of contents with several occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, dealt_anew
from .fmindex import FMIndex
from .repeats import Contents, keyed, merged, repeated

WINDOW = 35


def fm_groups(c: Contents) -> np.ndarray:
    """For each window its first row in the index, or -1 where fewer than two rows match all of it."""
    length, row = FMIndex(c.text, c.sigma).matching_statistics(c.text, c.first, c.size, c.window)
    return np.where(length[c.at] >= c.window, row[c.at], -1)


def removed_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, rkey, spans) of the texts with repeated windows."""
    return repeated(docs, window, fm_groups, keep_first=False)


def digest(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each keyed text, by the merged spans to remove."""
    joined = docs.join(dealt_anew(spans, "rid", "rkey"), ["rid", "rkey"], "left").select("rid", "text", "spans")

    def run(batches):
        for batch in batches:
            n, gone, sha, lists = [], [], [], []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                words = text.encode().split()
                n.append(len(words))
                spans = merged(spans)
                lists.append([list(s) for s in spans])
                gone.append(sum(b - a for a, b in spans))
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                sha.append(hashlib.sha256(b" ".join(kept + words[at:])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["rid"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(lists, pa.list_(pa.list_(pa.int64())))], ["rid", "n_words", "n_removed", "kept_sha256", "spans"])

    out = arrow_map(joined, run, "rid long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>")
    return out.select(F.expr("nullif(rid, -9223372036854775807L - 1)").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "spans")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each row; null and short texts lose nothing.

    Repeated rows are occurrences of each other: both lose the windows that they share.
    """
    texts = keyed(docs)
    return digest(texts, removed_spans(texts, window))
