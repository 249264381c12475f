"""FTRL-proximal logistic regression over hashed binary features, and its two users' bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash space of the features; weights are sparse in it.
SPACE_BITS = 22
#: Rows that a classifier is fitted on at most, and bytes of their texts (the bounds of the sample).
TRAIN_ROWS, SAMPLE_BYTES = 20_000, 96 << 20


class FTRL:
    """Per-coordinate rates and L1: a coordinate stays zero until its summed gradient exceeds ``l1``."""

    def __init__(self, bits: int = SPACE_BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias_z = self.bias_n = 0.0

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        out = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        out[np.abs(z) <= self.l1] = 0
        return out

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 3, positive_weight: float = 1.0) -> "FTRL":
        """``rows``: the distinct feature numbers of each example; ``labels`` in 0..1, those above one half weighted."""
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                at = rows[i]
                w, bias = self._weights(at), self.bias
                g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[i]
                g *= positive_weight if labels[i] > 0.5 else 1.0
                root = np.sqrt(self.n[at])
                self.z[at] += g - (np.sqrt(self.n[at] + g * g) - root) / self.alpha * w
                self.n[at] += g * g
                self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * bias
                self.bias_n += g * g
        return self

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """The numbers and weights of the coordinates that are not zero, and the bias."""
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return at.astype(np.int32), self._weights(at).astype(np.float32), float(self.bias)


class Scorer:
    """Scores rows of features with compact weights."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float, bits: int = SPACE_BITS):
        self.table = np.zeros(1 << bits, np.float32)
        self.table[at] = weights
        self.bias = bias

    def __call__(self, features: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """Probabilities; a feature counts once in a row however often it occurs."""
        some = self.table[features] != 0
        f, r = features[some].astype(np.int64), rows[some].astype(np.int64)
        key = np.unique(r << SPACE_BITS | f)
        total = np.bincount(key >> SPACE_BITS, self.table[key & ((1 << SPACE_BITS) - 1)], n_rows) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def sampled(df: DataFrame, limit: int = TRAIN_ROWS, most_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """The distinct rows of ``df`` (column ``text`` and others) of the least hashes, at most ``limit`` of them and at most
    ``most_bytes`` of text, ordered by hash; all rows, where there are no more.

    Texts of over a sixteenth of these bytes are not taken.  So the sample does not depend on the
    order of rows, nor on how often a row is repeated, and its size on neither.
    """
    names = df.columns
    keyed = df.where(F.col("text").isNotNull()).withColumns({"_k": F.xxhash64(*names), "_b": F.octet_length("text")}).where(F.col("_b") <= most_bytes // 16)
    n = keyed.agg(F.approx_count_distinct("_k", 0.02)).first()[0]
    # hashes are spread evenly, so about one and a half times the limit lie below this one
    top = (1 << 63) - 1 if n <= limit else int(1.5 * limit / n * (1 << 64)) - (1 << 63)
    sizes = keyed.where(F.col("_k") <= min(top, (1 << 63) - 1)).groupBy("_k").agg(F.max("_b").alias("b")).toArrow()
    k, b = sizes["_k"].to_numpy(), sizes["b"].to_numpy()
    order = np.argsort(k)
    take = min(limit, int(np.searchsorted(np.cumsum(b[order], dtype=np.int64), most_bytes, "right")))
    if not take:
        return keyed.limit(0).select(names).toArrow()
    rows = keyed.where(F.col("_k") <= int(k[order][take - 1])).groupBy("_k").agg(*[F.first(c).alias(c) for c in names]).toArrow()
    return rows.sort_by("_k").select(names)
