"""Near duplicates by the Jaccard similarity of word shingles: SimHash with pigeonring filtering, exact checks, and prefix filtering for the rest.

A text is the set of the 64-bit hashes of its five-word shingles.  Sets whose SimHash fingerprints
differ in at most ``DISTANCE`` bits are found by the pigeonring index and compared exactly.  At a
similarity of 0.8 fingerprints differ in about ten of their 64 bits, and some in eighteen, so these
are a part of all links.

Sets that fingerprints leave apart are joined by prefix filtering.  All hashes are put into one order,
rare ones first (by a sketch of their counts, then by value).  Of two sets of similarity 0.8 at least,
the first n - ceil(0.8 n) + 1 hashes of each have one in common, whatever the order is; so texts that
share such a key are compared exactly, and no pair is lost.  The order only keeps common lines out
of the keys.  From its first common hash on a set has no more in common with the other than it has
hashes left, which bounds the size of partners under a key (``room``); sets without a partner of a
size that fits are not listed under it.

Each set has a signature of 512 bits: the parity of the number of its hashes in each of 512 classes.
Signatures differ in at most as many bits as the sets do in hashes, which drops most candidates
before any text is moved; here, too, no pair is lost.  Sets are never stored: they are made again
from the texts where they are needed.

Rows are known by their id and their text; a task handles each text once, however many copies of it
the task has.

Under a prefix key of more than ``BUCKET`` sets, each is first compared with ``PIVOTS`` of them.  Only
where a key's sets are not all linked by then, those of different components are paired too: pairs
within one component, of fingerprints' links to begin with, cannot change the result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, arrow_map, chunks, dealt_anew, discard, gram_hashes, materialise, span_hashes, text_bytes
from .graph import components
from .simhash import majorities, near, rows_of

SHINGLE = 5
#: The least similarity, as a fraction.
UP, DOWN = 4, 5
BUCKET, PIVOTS = 4, 2
#: The most bits in which fingerprints of candidates differ.
DISTANCE = 4
#: Buckets of the sketch (as bits), and the partial sums of the tasks' sketches.
SKETCH_BITS, SUMS = 22, 16
#: Texts of a file, and pairs that a task compares.
TEXTS, PAIRS = 2_000, 1_000
#: 64-bit words of a signature, and bits of the filter through which candidates' texts are read.
PARTS, FILTER_BITS = 8, 24
SIGNATURE = [f"s{i}" for i in range(PARTS)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of texts that lie end to end, in order for each text, and how many each has.

    Words are lower-cased (A-Z); a text of fewer words than a shingle has one of all its words.
    """
    w = Words(data, offsets, lower=True)
    n, n_rows, row = np.diff(w.first), len(offsets) - 1, w.rows()
    g = gram_hashes(w.hash, words)
    inside = np.flatnonzero(row[: len(g)] == row[words - 1 :]) if len(g) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < words))
    values = np.concatenate([g[inside], span_hashes(w.hash, w.first[short], w.first[short + 1])])
    owner = np.concatenate([row[inside], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])]) if len(values) else np.zeros(0, bool)
    return values[new], np.bincount(owner[new], minlength=n_rows)


def nodes_of(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each set: its own hash."""
    ends = np.cumsum(size)
    return np.array([xxhash.xxh64_intdigest(values[e - s : e].tobytes()) for e, s in zip(ends.tolist(), size.tolist())], np.uint64).view(np.int64)


def _new_texts(batches):
    """Of each batch (tkey, text) the rows of texts that the task has not had before, in chunks: tkeys, sets' values and sizes."""
    known: set[int] = set()
    for batch in batches:
        keys = batch["tkey"].to_pylist()
        first = [i for i, k in enumerate(keys) if not (k in known or known.add(k))]
        some = batch.take(pa.array(first, pa.int64()))
        data, offsets = text_bytes(some["text"])
        tkey = some["tkey"].to_numpy()
        for lo, hi in chunks(offsets):
            yield tkey[lo:hi], *shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _source(docs: DataFrame, *also: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*also, F.xxhash64(text).alias("tkey"), text.alias("text"))


def described(docs: DataFrame) -> DataFrame:
    """(tkey, node, size, fp, s0, s1, ...) of each text, once for each task that has it; fp is the set's SimHash fingerprint."""

    def run(batches):
        for tkey, values, size in _new_texts(batches):
            at = np.repeat(np.arange(len(size)), size) * 64 * PARTS + (values % np.uint64(64 * PARTS)).astype(np.int64)
            odd = np.bincount(at, minlength=len(size) * 64 * PARTS) & 1
            sig = np.packbits(odd.astype(bool)).view(np.int64).reshape(-1, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(tkey), pa.array(nodes_of(values, size)), pa.array(size.astype(np.int32)), pa.array(majorities(values, size).view(np.int64)), *[pa.array(x) for x in sig.T.copy()]], ["tkey", "node", "size", "fp", *SIGNATURE])

    return arrow_map(_source(docs), run, "tkey long, node long, size int, fp long, " + ", ".join(f"{c} long" for c in SIGNATURE))


def bucket_of(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _packed(total: np.ndarray, group: int) -> pa.RecordBatch:
    data = zlib.compress(total.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([data], pa.binary())], ["part", "counts"])


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums, none above what the counters hold."""
    total = a + b
    total[total < a] = np.iinfo(np.uint32).max
    return total


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.uint32).reshape(-1)


def sketch(docs: DataFrame, sets=None) -> np.ndarray:
    """How many hashes of sets (of each distinct text of a task, or those that ``sets`` makes of the rows) fall into each bucket of the hash space: a table of fixed size, one packed row for each task, summed in two steps."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for _, values, *_ in (sets or _new_texts)(batches):
            np.add.at(total, bucket_of(values), 1)
        yield _packed(total, TaskContext.get().partitionId() % SUMS)

    def added(batches):
        part, total = None, None
        for batch in batches:
            for p, data in zip(batch["part"].to_pylist(), batch["counts"]):
                if p != part:
                    if part is not None:
                        yield _packed(total, part)
                    part, total = p, np.zeros(1 << SKETCH_BITS, np.uint32)
                total = _sum(total, _unpacked(data.as_py()))
        if part is not None:
            yield _packed(total, part)

    parts = arrow_map(docs if sets else _source(docs), run, "part int, counts binary").repartition(SUMS, "part").sortWithinPartitions("part")
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in arrow_map(parts, added, "part int, counts binary").toLocalIterator():
        out = _sum(out, _unpacked(bytes(row.counts)))
    return out


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, node, size, room): the first hashes of each set, and the largest size of a partner whose first common hash it is."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for _, h, n in _new_texts(batches):
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, sent.value[bucket_of(h)], row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            first = place < np.repeat(n + (-UP * n) // DOWN + 1, n)
            own = row[first]
            # similar: UP * (sizes' sum) <= (UP + DOWN) * common, and common <= n - place
            room = (UP + DOWN) * (n[own] - place[first]) // UP - n[own]
            yield pa.RecordBatch.from_arrays([pa.array(h[order][first].view(np.int64)), pa.array(nodes_of(h, n)[own]), pa.array(n[own].astype(np.int32)), pa.array(room.astype(np.int32))], ["key", "node", "size", "room"])

    return arrow_map(_source(docs), run, "key long, node long, size int, room int")


def _pairs(x: DataFrame, y: DataFrame, *also: str) -> DataFrame:
    """The distinct pairs (a < b) under common keys whose sizes allow the similarity."""
    a = x.select("key", *[F.col(c).alias(f"{c}_a") for c in ("node", "size", "room", *also)])
    b = y.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "room", *also)])
    both = a.join(b, "key").where("node_a <> node_b and size_a <= room_b and size_b <= room_a").where(F.least("size_a", "size_b") * DOWN >= F.greatest("size_a", "size_b") * UP)
    for c in also:
        both = both.where(F.col(f"{c}_a") != F.col(f"{c}_b"))
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _maybe(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of different roots but for those whose signatures differ in more bits than the sets may in hashes."""
    sigs = rows.select("node", "size", "root", *SIGNATURE).dropDuplicates(["node"])
    side = lambda c: sigs.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("size", "root", *SIGNATURE)])
    differ = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in SIGNATURE), F.lit(0))
    # similarity UP / DOWN: of both sizes' sum, (DOWN - UP) / (DOWN + UP) may differ
    return pairs.join(side("a"), "a").join(side("b"), "b").where("root_a <> root_b").where(differ * (DOWN + UP) <= (F.col("size_a") + F.col("size_b")) * (DOWN - UP)).select("a", "b")


def texts_of(nodes: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text): of each node one text; other texts are left out before the join, but for chance."""
    wanted = materialise(rows.groupBy("node").agg(F.min("tkey").alias("tkey")).join(nodes, "node", "left_semi"), "wanted")
    at = F.shiftrightunsigned("tkey", 64 - FILTER_BITS)
    bits = wanted.groupBy(F.shiftright(at, 3).alias("byte")).agg(F.bit_or(F.pow(F.lit(2), at.bitwiseAND(7)).cast("int")).alias("bits")).toArrow()
    table = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    table[bits["byte"].to_numpy()] = bits["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            tkey = batch["tkey"].to_numpy()
            at = (tkey.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            some = np.flatnonzero(sent.value[at >> 3] >> (at & 7) & 1)
            first = [i for i, k in zip(some.tolist(), tkey[some].tolist()) if not (k in known or known.add(k))]
            yield batch.take(pa.array(first, pa.int64()))

    return arrow_map(_source(docs), run, "tkey long, text string").join(wanted, "tkey").dropDuplicates(["tkey"]).select("node", "text")


def similar(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets' similarity is large enough; ``rows`` have a ``root``, and pairs of one root are left out."""
    pairs = materialise(_maybe(pairs, rows), "candidates")
    n = pairs.count()
    if not n:
        return pairs
    texts = materialise(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), rows, docs), "texts", 2 * n, TEXTS)
    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def sets(column):
        data, offsets = text_bytes(column)
        for lo, hi in chunks(offsets):
            values, size = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield from np.split(values, np.cumsum(size)[:-1])

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(sets(batch["ta"]), sets(batch["tb"])):
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(DOWN * common >= UP * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = materialise(arrow_map(full, run, "a long, b long"), "links", n, PAIRS)
    discard(pairs, texts)
    return found


def fingerprint_links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) edges between similar sets by their fingerprints: one set of each fingerprint stands for it, and the others are compared with that one."""
    sets = rows.select("fp", "node").distinct()
    ones = sets.groupBy("fp").agg(F.min("node").alias("one"))
    side = lambda c: ones.select(F.col("fp").alias(c), F.col("one").alias(f"one_{c}"))
    apart = near(ones.select("fp"), DISTANCE).join(side("a"), "a").join(side("b"), "b").select(F.least("one_a", "one_b").alias("a"), F.greatest("one_a", "one_b").alias("b"))
    alike = sets.join(dealt_anew(ones, "fp"), "fp").where("node <> one").select(F.col("one").alias("a"), F.col("node").alias("b"))
    return similar(apart.unionAll(alike), rows.withColumn("root", F.col("node")), docs)


def links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) edges between the sets, enough that their components are those of all similar pairs."""
    close = fingerprint_links(rows, docs)
    rows = materialise(rows.join(dealt_anew(components(close), "node"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    w = Window.partitionBy("key")
    # dealt by key at once, so that neither copies of a set nor the windows deal the rows again
    once = prefixes(docs, sketch(docs)).repartition("key").dropDuplicates(["key", "node"])
    fitting = once.withColumn("least", F.min("size").over(w)).where("room >= least")
    # first the sets with the fewest rare hashes for their size: what others are copies of
    keyed = fitting.withColumns({"n": F.count("*").over(w), "place": F.row_number().over(w.orderBy((F.col("room") / F.col("size")).desc(), "node"))})
    shared = materialise(keyed.where("n > 1").drop("least"), "keys")
    few, crowded = shared.where(F.col("n") <= BUCKET), shared.where(F.col("n") > BUCKET)
    found = close.unionAll(similar(_pairs(few, few).unionAll(_pairs(crowded.where(F.col("place") <= PIVOTS), crowded)).distinct(), rows, docs))
    roots = components(found).select("node", "root")
    labelled = crowded.join(dealt_anew(roots, "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = materialise(labelled.join(dealt_anew(apart, "key"), "key", "left_semi"), "crowded")
    discard(shared)
    if not rest.isEmpty():
        found = found.unionAll(similar(_pairs(rest, rest, "root").join(found, ["a", "b"], "left_anti"), rows, docs))
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that of the least id, then of the least text hash.

    Null texts count as empty; all texts without words are one group.  Rows without an id give way
    to those that have one.  Of rows equal in id and text one stays.  Texts of fewer words than a
    shingle are one shingle.  An empty table stays empty.
    """
    rows = materialise(described(docs), "described")
    labels = components(links(rows, docs))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(text).alias("tkey")).alias("k"), F.xxhash64(text).alias("tkey"))
    roots = rows.groupBy("tkey").agg(F.min("node").alias("node")).join(dealt_anew(labels, "node"), "node", "left").select("tkey", F.coalesce("root", "node").alias("root"))
    stays = ids.join(dealt_anew(roots, "tkey"), "tkey").groupBy("root").agg(F.min("k").alias("k"))
    return rows_of(docs, stays.select("k"))
