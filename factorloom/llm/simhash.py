"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonring filtering.

A fingerprint's 64 bits are a ring of four 16-bit segments.  Of two fingerprints that differ in at
most two bits, some chain of consecutive segments stays within its proportional budget at each
length (0, 1, 1, 2 differences for 1 to 4 segments).  So the chain's first segment is equal, and of
the next two at least one is: these two equal segments are the index's keys.  Fingerprints that
share a key are compared by the chain's budgets, then by the full distance.

Fingerprints are made distinct first.  A key with more than ``BUCKET`` of them is not paired but
refined: two fingerprints under it differ only in the 32 bits outside the key, and these are again a
ring of four segments, of 8 bits, to which the same argument gives two equal ones.  So it goes on
with segments of 4 and of 2 bits; then a key leaves four bits free, so no more than 16 fingerprints
can share it.  No link is lost, and each fingerprint has a bounded number of keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, arrow_map, dealt_anew, discard, materialise
from .graph import components

SEED, SHINGLE, DISTANCE = 42, 3, 2
SEGMENTS, BITS = 4, 16
#: Fingerprints under one key up to which they are compared pairwise.
BUCKET = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``size`` words, lower-cased A-Z, joined by a space; fewer words: of all of them."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: -size] + 1).tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]


def fingerprints_of(hashes: list[list[int]]) -> np.ndarray:
    """For each list of hashes, the bits that are set in over half of them (no hashes: zero)."""
    return majorities(np.array([x for h in hashes for x in h], np.uint64), np.array([len(h) for h in hashes]))


def majorities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same for hashes that lie end to end, ``sizes`` of them for each fingerprint."""
    counts = np.zeros((len(sizes), 64), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for lo in range(0, len(flat), BLOCK):
        part, own = flat[lo : lo + BLOCK], owner[lo : lo + BLOCK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of each whole text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                fp = fingerprints_of([shingle_hashes(t) for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def _segment(x, i: int, bits: int = BITS):
    return F.shiftrightunsigned(x, bits * (i % SEGMENTS)).bitwiseAND((1 << bits) - 1)


#: The pairs of segments of which a chain within its budgets has one equal.
KEYS = [(i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]


def _within_budgets(x, d: list | None = None, distance: int = DISTANCE):
    """Whether, for some first segment, each chain's differences ``d`` stay within the proportional budget."""
    d = d or [F.bit_count(_segment(x, i)) for i in range(SEGMENTS)]
    found = F.lit(False)
    for i in range(len(d)):
        total, ok = F.lit(0), F.lit(True)
        for n in range(1, len(d) + 1):
            total = total + d[(i + n - 1) % len(d)]
            ok = ok & (total <= distance * n // len(d))
        found = found | ok
    return found


def links(fps: DataFrame) -> DataFrame:
    """(a, b) edges between the distinct fingerprints ``fp`` of ``fps``: all pairs within the distance."""
    x, out, folders = F.col("a").bitwiseXOR(F.col("b")), None, []
    # free: the bits outside the key; fixed: those of the key; path: which segments the key took
    level = fps.select("fp", F.col("fp").alias("free"), F.lit(0).cast("long").alias("fixed"), F.lit(0).alias("path"))
    bits = BITS
    while bits:
        keys = []
        for t, (i, j) in enumerate(KEYS):
            k, m = [s for s in range(SEGMENTS) if s not in (i, j)]
            own = F.shiftleft(F.col("fixed"), 2 * bits).bitwiseOR(F.shiftleft(_segment(F.col("free"), i, bits), bits)).bitwiseOR(_segment(F.col("free"), j, bits))
            left = F.shiftleft(_segment(F.col("free"), k, bits), bits).bitwiseOR(_segment(F.col("free"), m, bits))
            keys.append(F.struct(left.alias("free"), own.alias("fixed"), (F.col("path") * len(KEYS) + t).alias("path")))
        keyed = level.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
        sizes = keyed.groupBy("fixed", "path").agg(F.count("*").alias("n")).where("n > 1")
        shared = materialise(keyed.join(dealt_anew(sizes, "fixed"), ["fixed", "path"]), "buckets")
        folders.append(shared)
        few = shared.where(F.col("n") <= BUCKET) if bits > 2 else shared
        pairs = few.select("fixed", "path", F.col("fp").alias("a")).join(few.select("fixed", "path", F.col("fp").alias("b")), ["fixed", "path"])
        pairs = pairs.where("a < b").where(_within_budgets(x)).where(F.bit_count(x) <= DISTANCE).select("a", "b")
        out = pairs if out is None else out.unionAll(pairs)
        level = shared.where(F.col("n") > BUCKET).select("fp", "free", "fixed", "path")
        bits //= 2
        if bits < 2 or level.isEmpty():
            break
    found = materialise(out.distinct(), "links")
    discard(*folders)
    return found


def near(fps: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b) pairs of the distinct fingerprints ``fp`` of ``fps`` that differ in at most ``distance`` bits (1 at least).

    The ring has two segments more than bits may differ, so that here, too, two are equal.  Keys are not
    refined: under one of more than ``bucket`` fingerprints each is compared with the least of them only.
    """
    ends = [64 * i // (distance + 2) for i in range(distance + 3)]
    cut = lambda x, i: F.shiftrightunsigned(x, ends[i]).bitwiseAND((1 << ends[i + 1] - ends[i]) - 1)
    ring = range(distance + 2)
    keys = [F.lit(n << 48).bitwiseOR(F.shiftleft(cut(F.col("fp"), i), 24)).bitwiseOR(cut(F.col("fp"), j)) for n, (i, j) in enumerate((i, j) for i in ring for j in ring if i < j)]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    buckets = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1"), "buckets")
    members = materialise(keyed.join(dealt_anew(buckets.where("n > 2"), "key").select("key", "n", "low"), "key"), "members")
    few = members.where(F.col("n") <= bucket)
    x = F.col("a").bitwiseXOR(F.col("b"))
    close = (F.bit_count(x) <= distance) & _within_budgets(x, [F.bit_count(cut(x, i)) for i in ring], distance)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").where(close).select("a", "b")
    for some in (buckets.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")), members.where(F.col("n") > F.greatest(F.lit(bucket), F.lit(2))).where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))):
        pairs = pairs.unionAll(some.where(close))
    found = materialise(pairs.distinct(), "near")
    discard(buckets, members)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest id that is reachable over links, for each row.

    Null and empty texts have fingerprint zero, linked like any other.  Null ids are never a
    component's id unless it has no other.  Repeated rows stay and share their component.
    """
    own = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(links(fps)).withColumnRenamed("node", "fp").join(fps, "fp")
    joint = labels.groupBy("root").agg(F.min("least").alias("component"))
    linked = labels.join(dealt_anew(joint, "root"), "root").select("fp", "component")
    # one row for each fingerprint, dealt anew: the rows of a fingerprint that very many texts have can be split
    classes = materialise(fps.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")), "classes")
    known = own.join(classes, "fp")
    return known.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def identity(id_col: str = "doc_id", text_col: str = "text"):
    """A row's place in the order of documents: rows with an id first, by id, then by the text's hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tkey"))


def rows_of(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose identity is in ``stays`` (column ``k``), one of each; with the columns of ``docs``."""
    names, key = docs.columns, "_identity"
    while key in names:
        key += "_"
    once = docs.withColumn(key, identity()).dropDuplicates([key])
    return once.join(stays.select(F.col("k").alias("_stays")), F.col(key) == F.col("_stays"), "left_semi").select(names)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first row, by ``identity``, of each component; of rows that are equal in id and text, one."""
    found = near_duplicates(docs.select(identity().alias("doc_id"), "text"))
    return rows_of(docs, found.where("doc_id = component_id").select(F.col("doc_id").alias("k")).distinct())
