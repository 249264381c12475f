"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Each labeller looks at one statistic of a text and votes low (-1), high (1) or not at all (0).
Expectation-maximisation over the corpus's vote patterns (all rows, as counts of the few distinct
patterns) estimates how often each labeller votes how in either class; an abstention is no evidence.
That labellers hardly ever vote low on a good text is known beforehand (``MOST_FALSE_LOW``), and a
constraint of the estimate.  The posteriors then label a bounded sample of distinct texts, on which
a linear scorer over hashed features is fitted; it scores every text, and those below one half are
rejected.  No given labels are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, arrow_map, chunks, give_back, gram_hashes, mix, text_bytes
from .linear import FTRL, SPACE_BITS, Scorer, sampled

#: For each statistic: (below: votes low, from: votes high, to: votes high, above: votes low).
LABELLERS = {
    "upper": (-1.0, 0.0, 0.15, 0.40),
    "symbols": (-1.0, 0.0, 0.004, 0.03),
    "shouts": (-1.0, 0.0, 0.02, 0.20),
    "repeats": (-1.0, 0.0, 0.15, 0.50),
    "distinct": (0.15, 0.30, 1.0, 2.0),
    "top_word": (-1.0, 0.0, 0.15, 0.35),
    "word_bytes": (2.0, 3.0, 12.0, 20.0),
    "stops": (0.01, 0.03, 0.4, 0.9),
    "words": (1.0, 20.0, 1e12, 1e13),
    "digits": (-1.0, 0.0, 0.05, 0.2),
    "symbol_words": (-1.0, 0.0, 0.05, 0.25),
    "bare_words": (-1.0, 0.0, 0.05, 0.20),
    "runs": (-1.0, 0.0, 0.01, 0.05),
    "upper_words": (-1.0, 0.0, 0.10, 0.40),
}
NAMES = list(LABELLERS)
WORDS = NAMES.index("words")
SHARES = [j for j in range(len(NAMES)) if j != WORDS]
#: Texts of fewer words have no shares to speak of.
FEW_WORDS = 8
#: Texts that the scorer is fitted on at most, and their bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 8000, 48 << 20
EM_ROUNDS = 100
#: A labeller is taken to vote low on at most this share of high-quality texts.
MOST_FALSE_LOW = 0.005
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 symbol, 4 shout, 5 digit, 6 sentence end
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = 3
_CLASS[[ord("!"), ord("?")]] = 4
_CLASS[ord(".")] = 6


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return count / np.maximum(total, 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One column for each labeller, and hashed shapes of words with the row of each."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    kind = _CLASS[data]
    sums = {k: np.concatenate([np.zeros(1, np.int32), np.cumsum(kind == k, dtype=np.int32)]) for k in range(1, 7)}
    per_row = {k: np.diff(s[offsets]) for k, s in sums.items()}
    size, n_words, row = np.diff(offsets), np.diff(w.first), w.rows()
    letters = per_row[1] + per_row[2]
    out = np.zeros((n, len(NAMES)))
    key = row.astype(np.uint64) << np.uint64(44) ^ (w.hash >> np.uint64(20))
    kinds, counts = np.unique(key, return_counts=True)
    of = (kinds >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, counts)
    # words that a five-word run covers which came before in the same text
    g = gram_hashes(w.hash, 5)
    grams_row = row[: len(g)]
    inside = grams_row == row[4:] if len(g) else np.zeros(0, bool)
    again = np.zeros(w.n + 1, np.int64)
    place = np.flatnonzero(inside)
    if len(place):
        own = mix(g[place] + grams_row[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own, kind="stable")
        same = np.concatenate([[False], own[order][1:] == own[order][:-1]])
        at = place[order[same]]
        np.add.at(again, at, 1)
        np.add.at(again, np.minimum(at + 5, w.n), -1)
    covered = np.bincount(row, np.cumsum(again)[: w.n] > 0, n) if w.n else np.zeros(n)
    def words_with(kinds):
        inside = np.concatenate([[0], np.cumsum(np.isin(kind, kinds))])
        return inside[w.end] > inside[w.start]

    triple = np.zeros(len(data), bool)
    if len(data) > 2:
        triple[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    lettered = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2) | (kind == 5) | (data > 127))])
    lettered = lettered[w.end] > lettered[w.start]
    lower = words_with([2])
    columns = {
        "symbol_words": _share(np.bincount(row, words_with([3]), n), n_words), "bare_words": _share(np.bincount(row, ~lettered, n), n_words),
        "runs": _share(np.diff(np.concatenate([[0], np.cumsum(triple)])[offsets]), size), "upper_words": _share(np.bincount(row, words_with([1]) & ~lower, n), n_words),
        "upper": _share(per_row[1], letters), "symbols": _share(per_row[3], size), "shouts": _share(per_row[4], n_words),
        "repeats": _share(covered, n_words), "distinct": _share(np.bincount(of, minlength=n), n_words), "top_word": _share(top, n_words),
        "word_bytes": _share(np.bincount(row, w.end - w.start, n), n_words), "stops": _share(per_row[6], n_words), "words": n_words, "digits": _share(per_row[5], size),
    }
    for j, name in enumerate(NAMES):
        out[:, j] = columns[name]
    shape = np.zeros(w.n, np.uint64)
    for k, s in sums.items():
        shape = shape * np.uint64(4) + np.minimum(s[w.end] - s[w.start], 3).astype(np.uint64)
    shape = shape * np.uint64(8) + np.minimum((w.end - w.start) // 4, 7).astype(np.uint64)
    return out, mix(shape + np.uint64(77)), row


def votes(stats: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 of each labeller; on texts of few words only the number of words votes."""
    out = np.zeros(stats.shape, np.int8)
    for j, name in enumerate(NAMES):
        low, a, b, high = LABELLERS[name]
        x = stats[:, j]
        out[:, j] = np.where((x < low) | (x > high), -1, np.where((x >= a) & (x <= b), 1, 0))
    out[np.ix_(stats[:, WORDS] < FEW_WORDS, SHARES)] = 0
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features (binned statistics, pairs of them, shapes of words and pairs of adjacent shapes), the row of each, and the votes."""
    stats, shape, row = statistics(data, offsets)
    n = len(stats)
    bins = np.round(np.sqrt(np.abs(stats)) * np.array([8 if x not in ("word_bytes", "words") else 2 for x in NAMES])).astype(np.uint64)
    bins[np.ix_(stats[:, WORDS] < FEW_WORDS, SHARES)] = 60
    bins = mix(bins * np.uint64(64) + np.arange(len(NAMES), dtype=np.uint64) + np.uint64(1))
    out, rows = [bins.reshape(-1)], [np.repeat(np.arange(n), len(NAMES))]
    for i in range(len(NAMES)):
        for j in range(i):
            out.append(mix(bins[:, i] * np.uint64(3) + bins[:, j]))
            rows.append(np.arange(n))
    pair = mix(shape[:-1] * np.uint64(5) + shape[1:])
    long = stats[:, WORDS] >= FEW_WORDS
    both = (row[1:] == row[:-1]) & long[row[1:]]
    out += [shape[long[row]], pair[both]]
    rows += [row[long[row]], row[1:][both]]
    return (np.concatenate(out) >> np.uint64(64 - SPACE_BITS)).astype(np.int32), np.concatenate(rows), votes(stats)


def _codes(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def vote_codes(docs: DataFrame) -> DataFrame:
    """(code) for each row: its vote pattern as a number in base three."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            for lo, hi in chunks(offsets):
                stats, _, _ = statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([pa.array(_codes(votes(stats)))], ["code"])

    return arrow_map(docs.select(F.col("text").cast("string").alias("text")), run, "code long")


def fit_labellers(codes: np.ndarray, counts: np.ndarray):
    """Expectation-maximisation: the share of high-quality texts, and each labeller's vote shares in either class [class, labeller, vote + 1]."""
    m = len(NAMES)
    v = codes[:, None] // 3 ** np.arange(m) % 3
    p = np.clip(0.5 + 0.5 * (v - 1).sum(axis=1) / np.maximum((v != 1).sum(axis=1), 1) - 0.4 * (v == 0).any(axis=1), 0.01, 0.99)
    prior, shares = 0.5, np.zeros((2, m, 3))
    for _ in range(EM_ROUNDS):
        for c, q in enumerate((1 - p, p)):
            for k in range(3):
                shares[c, :, k] = ((v == k) * (q * counts)[:, None]).sum(axis=0) + 0.1
        shares /= shares.sum(axis=2, keepdims=True)
        shares[1, :, 0] = np.minimum(shares[1, :, 0], MOST_FALSE_LOW)
        shares /= shares.sum(axis=2, keepdims=True)
        prior = float(np.clip((p * counts).sum() / counts.sum(), 0.01, 0.99))
        p = posterior(v, prior, shares)
    return prior, shares


def posterior(v: np.ndarray, prior: float, shares: np.ndarray) -> np.ndarray:
    log = np.log(shares)
    at = np.arange(v.shape[1])
    x = np.log(prior / (1 - prior)) + ((log[1, at, v] - log[0, at, v]) * (v != 1)).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(docs: DataFrame):
    """(compact weights, labellers' model).  An empty table gives a model that keeps everything.

    Null texts count as empty; repeated rows count in the estimate of the labellers, but a text is
    in the scorer's sample once.  The sample is that of the least text hashes, so neither the order
    of rows nor ties matter.
    """
    table = vote_codes(docs).groupBy("code").agg(F.count("*").alias("n")).toArrow()
    if not table.num_rows:
        return (np.zeros(0, np.int32), np.zeros(0, np.float32), 1.0), None
    prior, shares = fit_labellers(table["code"].to_numpy(), table["n"].to_numpy())
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    data, offsets = text_bytes(sampled(text, SAMPLE_ROWS, SAMPLE_BYTES)["text"])
    rows, labels = [], [np.zeros(0)]
    for lo, hi in chunks(offsets):
        f, r, v = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        key = np.unique(r.astype(np.int64) << SPACE_BITS | f)
        bounds = np.searchsorted(key >> SPACE_BITS, np.arange(hi - lo + 1))
        numbers = (key & ((1 << SPACE_BITS) - 1)).astype(np.int32)
        rows += [numbers[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        labels.append(posterior(v.astype(np.int64) + 1, prior, shares))
    model = FTRL(alpha=0.5, l1=2.0).fit(rows, np.concatenate(labels), 2)
    return model.compact(), (prior, shares)


def score(docs: DataFrame, model, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and, under ``prefix``: score (0 to 1, of high quality) and kept (score >= 0.5).

    One row per input row; equal texts have equal scores, null ones that of the empty text.
    """
    (at, weights, bias), _ = model

    def run(batches):
        scorer = Scorer(at, weights, bias)
        for batch in batches:
            data, offsets = text_bytes(batch["text"].cast(pa.string()))
            p = [np.zeros(0)]
            for lo, hi in chunks(offsets):
                f, r, _ = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                p.append(scorer(f, r, hi - lo))
            p = np.concatenate(p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(p >= 0.5)], [*batch.schema.names, prefix + "score", prefix + "kept"])

    added = StructType.fromDDL(f"{prefix}score double, {prefix}kept boolean")
    return arrow_map(docs, run, StructType([*docs.schema.fields, *added.fields]))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns.  Null texts are scored as empty ones."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    model = train(docs)
    give_back()  # the sample and the coordinates are freed by now
    return score(docs, model, prefix).where(f"`{prefix}kept`").select(docs.columns)
