"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (A-Z lower-cased), pairs of adjacent words, and pairs with one word
between, hashed to 2**22 numbers; each counts once.  The model is fitted on a bounded sample of
labelled rows (``linear.TRAIN_ROWS``); L1 leaves few weights, which travel with the task.  Null and
empty texts have no features and score as the bias alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, chunks, held_out, mix, text_bytes, text_of
from .linear import FTRL, SPACE_BITS, TRAIN_ROWS, Scorer, sampled

#: Bytes outside words: ASCII but letters and digits.
OUTSIDE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Toxic examples weigh as much together as the others, but each no more than this.
MOST_WEIGHT = 3.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the row of each."""
    w = Words(data, offsets, OUTSIDE, lower=True)
    h, row = w.hash, w.rows()
    out, rows = [h], [row]
    for gap in (1, 2):
        if w.n > gap:
            same = row[gap:] == row[:-gap]
            out.append(mix(h[:-gap] * np.uint64(3 + 2 * gap) + h[gap:] + np.uint64(gap))[same])
            rows.append(row[gap:][same])
    return (np.concatenate(out) >> np.uint64(64 - SPACE_BITS)).astype(np.int32), np.concatenate(rows)


def rows_of_features(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = text_bytes(texts)
    out = []
    for lo, hi in chunks(offsets):
        f, r = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        key = np.unique(r.astype(np.int64) << SPACE_BITS | f)
        bounds = np.searchsorted(key >> SPACE_BITS, np.arange(hi - lo + 1))
        numbers = (key & ((1 << SPACE_BITS) - 1)).astype(np.int32)
        out += [numbers[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic"):
    """Compact weights, from labelled rows that are not held out.  No such rows: zero weights, all below one half.

    An id with several labels has the largest; an id with several texts gives each of them.  Equal
    texts of equal label are one example, in the order of their hashes, so neither the order of rows
    nor repeats matter.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    n = known.count()
    if n > TRAIN_ROWS:  # about a tenth more ids than rows are wanted: a bounded broadcast
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * 1.1 * TRAIN_ROWS / n))
    rows = sampled(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id").select("text", "label"))
    y = rows["label"].to_numpy().astype(float)
    if not len(y):
        return np.zeros(0, np.int32), np.zeros(0, np.float32), -1.0
    balance = min(max((y < 0.5).sum() / max((y > 0.5).sum(), 1), 1.0), MOST_WEIGHT)
    return FTRL(l1=16.0).fit(rows_of_features(rows["text"]), y, positive_weight=balance).compact()


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text; equal texts have equal scores, a score of one half is predicted 1."""
    at, weights, bias = model
    source = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        scorer = Scorer(at, weights, bias)
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            p = [np.zeros(0)]
            for lo, hi in chunks(offsets):
                f, r = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                p.append(scorer(f, r, hi - lo))
            p = np.concatenate(p)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return arrow_map(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
