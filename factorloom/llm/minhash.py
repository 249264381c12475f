"""Near duplicates by the Jaccard similarity of word shingles: fast similarity sketches, banding, exact verification.

A document is the set of the 64-bit hashes of its distinct three-word shingles; documents with equal
sets are one class.  A set's sketch has ``COORDINATES`` values and is filled in rounds: in each of
the first rounds every element is hashed anew to a place and a value, and a place keeps the least
(round, value); round ``COORDINATES`` + j puts every element into place j.  So each coordinate is
filled after twice as many rounds at most, however small the set is, and after one or two rounds
where it is large; a set's rounds end when nothing is empty.  Coordinates of two sets agree with a
probability equal to their similarity, and the number that agree is concentrated as for independent
ones.

``BANDS`` bands of ``WIDTH`` coordinates are the keys under which candidates meet: at a similarity of
0.85 a pair has no band in common with a probability of 6e-11.  Four bits of each coordinate are
kept, and candidates of which more than ``MOST_APART`` differ are dropped: at 0.85 that loses one of
1e10 (Chernoff).  All others are confirmed on their whole sets, made again from the texts.

Under a key of more than ``BUCKET`` classes each is compared with one pivot only, the class that
meets the most others under such keys: what the others are copies of, and the same one for most keys
of a group of copies.  Where a key's classes are not in one
component by then, all of them go to an exact join: of two similar sets, the first hashes in any
common order (rare ones first) have one in common, and from the place of the first common hash on
there must be enough left.  Pairs within one component are left out, as they change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, dealt_anew, discard, materialise, mix, text_bytes, text_of
from .graph import components
from .similar import bucket_of, shingle_sets, sketch, texts_of

SHINGLE = 3
#: The least similarity, as a fraction.
UP, DOWN = 17, 20
#: Coordinates of a sketch (a power of two), its bands, and the most of the kept coordinates that may differ.
COORDINATES, BANDS, WIDTH, MOST_APART = 128, 32, 4, 51
#: Classes under a key up to which all are compared; pairs that one copy of a pivot serves.
BUCKET, PAIRS = 8, 500
#: Text bytes handled at once, and texts of which a task knows that it has had them.
BLOCK_BYTES, KNOWN = 1 << 20, 200_000
MARKS = [f"m{i}" for i in range(COORDINATES // 16)]

_EMPTY = np.uint64((1 << 63) - 1)
_ROUND = np.uint64(0xD1342543DE82EF95)
_VALUE_BITS = 55


def sketches(values: np.ndarray, size: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The sketches (rows of t values) of sets that lie end to end; a set without elements keeps empty coordinates."""
    out = np.full(len(size) * t, _EMPTY, np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    open_rows = np.flatnonzero(size)
    for i in range(2 * t):
        h = mix(values ^ mix(np.full(1, i + 1, np.uint64) * _ROUND))
        place = (h >> np.uint64(64 - t.bit_length() + 1)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, row * t + place, (np.uint64(i) << np.uint64(_VALUE_BITS)) | (h & np.uint64((1 << _VALUE_BITS) - 1)))
        full = np.zeros(len(size), bool)
        full[open_rows] = (out.reshape(-1, t)[open_rows] != _EMPTY).all(axis=1)
        if full.any():
            open_rows = open_rows[~full[open_rows]]
            if not len(open_rows):
                break
            left = ~full[row]
            values, row = values[left], row[left]
    return out.reshape(-1, t)


def band_keys(made: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    parts = made.reshape(-1, BANDS, WIDTH)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _ROUND), parts.shape[:2])
    for i in range(WIDTH):
        key = mix(key + parts[:, :, i])
    return key.view(np.int64)


def marks(made: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen of them in each of a row's numbers."""
    bits = mix(made).reshape(-1, COORDINATES // 16, 16) >> np.uint64(60)
    return (bits << (4 * np.arange(16, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, lo, hi, size, marks, bands) of each row: the text's hash, the set's 128-bit hash and its size.

    Marks and bands are given for the first row of each text in a task (a task forgets the texts it
    has had now and then), and for no text without words.
    """
    text = text_of(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    names = ["doc_id", "tkey", "lo", "hi", "size", *MARKS, "bands"]

    def run(batches):
        known: dict[int, tuple] = {}
        for batch in batches:
            tkey = batch["tkey"].to_pylist()
            fresh = [i for i, k in enumerate(tkey) if k not in known and known.setdefault(k, ()) is not None]
            data, offsets = text_bytes(batch["text"].take(pa.array(fresh, pa.int64())))
            mark, band, at = [], [], {}
            for lo, hi in chunks(offsets, BLOCK_BYTES):
                values, size = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SHINGLE)
                ends = np.cumsum(size)
                for i, e, s in zip(fresh[lo:hi], ends.tolist(), size.tolist()):
                    h = xxhash.xxh3_128_intdigest(values[e - s : e].tobytes())
                    known[tkey[i]] = (h % (1 << 64) - (1 << 63), (h >> 64) - (1 << 63), s)
                some = np.flatnonzero(size)
                made = sketches(values, size)[some]
                for i in some.tolist():
                    at[fresh[lo + i]] = len(at)
                mark.append(marks(made))
                band.append(band_keys(made))
            place = pa.array([at.get(i) for i in range(len(tkey))], pa.int64())
            mark = np.concatenate([*mark, np.zeros((0, len(MARKS)), np.int64)])
            band = np.concatenate([*band, np.zeros((0, BANDS), np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS), pa.int32()), pa.array(band.reshape(-1)))
            of = list(zip(*[known[k] for k in tkey])) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tkey"], *[pa.array(c, pa.int64()) for c in of], *[pa.array(c).take(place) for c in mark.T.copy()], lists.take(place)], names)
            if len(known) > KNOWN:
                known.clear()

    kind = source.schema["doc_id"].dataType.simpleString()
    return arrow_map(source, run, f"doc_id {kind}, tkey long, lo long, hi long, size long, " + ", ".join(f"{m} long" for m in MARKS) + ", bands array<long>")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose sketches are not too far apart."""
    side = lambda c: classes.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("size", *MARKS)])
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def apart(m):
        x = F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    sizes = F.least("size_a", "size_b") * DOWN >= F.greatest("size_a", "size_b") * UP
    return both.where(sizes).where(sum((apart(m) for m in MARKS), F.lit(0)) <= MOST_APART).select("a", "b")


def _pair(a: str, b: str):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough.

    The partners of a class are dealt in blocks of about ``PAIRS``; a block's task makes the class's
    set once and has the partners stream past it.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("b"), F.floor(F.col("n") / PAIRS).cast("long") + 1)
    dealt = pairs.join(dealt_anew(sizes, "a"), "a").select("a", "b", salt.alias("salt"))
    heads = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    tails = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    lined = heads.unionByName(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        head = None
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            a, b, ok = batch["a"].to_pylist(), batch["b"].to_pylist(), []
            for lo, hi in chunks(offsets, BLOCK_BYTES):
                values, size = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SHINGLE)
                for i, own in zip(range(lo, hi), np.split(values, np.cumsum(size)[:-1])):
                    if b[i] is None:
                        head = own
                        ok.append(False)
                    else:
                        common = len(np.intersect1d(head, own, assume_unique=True))
                        ok.append(DOWN * common >= UP * (len(head) + len(own) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return arrow_map(lined, run, "a long, b long")


def _links_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    likely = materialise(_likely(pairs, classes), "candidates")
    if likely.isEmpty():
        return likely
    texts = materialise(texts_of(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs), "texts")
    found = materialise(verified(likely, texts), "links")
    discard(likely, texts)
    return found


def _sets(batches):
    """Of each batch (node, root, text), in blocks: nodes, sets' values, their sizes, roots."""
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        node, root = (batch[c].to_numpy() for c in ("node", "root"))
        for lo, hi in chunks(offsets, BLOCK_BYTES):
            yield node[lo:hi], *shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SHINGLE), root[lo:hi]


def _prefix_pairs(texts: DataFrame) -> DataFrame:
    """The pairs of different roots of which the first hashes, rare ones first, have one in common with enough left; ``texts`` is (node, root, text)."""
    sent = texts.sparkSession.sparkContext.broadcast(sketch(texts, sets=_sets))

    def run(batches):
        for node, h, n, root in _sets(batches):
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, sent.value[bucket_of(h)], row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            first = place < np.repeat(n + (-UP * n) // DOWN + 1, n)
            own = row[first]
            # similar: UP * (sizes' sum) <= (UP + DOWN) * common, and common <= n - place
            room = (UP + DOWN) * (n[own] - place[first]) // UP - n[own]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h[order][first].view(np.int64), node[own], root[own], n[own].astype(np.int64), room)], ["key", "node", "root", "size", "room"])

    keyed = materialise(arrow_map(texts, run, "key long, node long, root long, size long, room long"), "prefixes")
    keys = keyed.groupBy("key").agg(F.min("size").alias("least"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "least")
    kept = keyed.join(dealt_anew(keys, "key"), "key").where("room >= least")
    side = lambda c: kept.select("key", *[F.col(x).alias(f"{x}_{c}") for x in ("node", "root", "size", "room")])
    fits = "root_a < root_b and size_a <= room_b and size_b <= room_a"
    return side("a").join(side("b"), "key").where(fits).select(*_pair("node_a", "node_b")).distinct()


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) edges between the ``classes`` (node, tkey, size, marks, bands), enough that their components are those of all similar pairs."""
    banded = classes.select("node", F.explode("bands").alias("key"))
    buckets = materialise(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1"), "buckets")
    members = materialise(banded.join(dealt_anew(buckets.where("n > 2"), "key").select("key", "n"), "key"), "members")
    few, crowded = members.where(F.col("n") <= BUCKET).select("key", "node"), members.where(F.col("n") > BUCKET)
    met = crowded.groupBy("node").agg(F.sum("n").alias("met"))
    pivots = crowded.join(dealt_anew(met, "node"), "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("pivot"))
    spokes = crowded.join(dealt_anew(pivots, "key"), "key").where("node <> pivot").select(*_pair("node", "pivot"))
    small = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    pairs = buckets.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionAll(small).unionAll(spokes)
    found = _links_of(pairs.distinct(), classes, docs)
    roots = components(found).select("node", "root")
    labelled = crowded.select("key", "node").join(dealt_anew(roots, "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rest = materialise(labelled.join(dealt_anew(apart, "key"), "key", "left_semi").select("node", "root").distinct(), "rest")
    discard(buckets, members)
    if rest.isEmpty():
        return found
    texts = materialise(texts_of(rest.select("node"), classes, docs).join(rest, "node").select("node", "root", "text"), "texts")
    more = _links_of(_prefix_pairs(texts).join(found, ["a", "b"], "left_anti"), classes, docs)
    discard(rest, texts)
    return found.unionAll(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: the size of its set, the smallest id that is reachable over links, and whether it is the row's own.

    Null, empty and blank texts have no shingles and are linked with nothing.  A text of one or two
    words is one shingle.  Rows without an id take part; a component's id is null, and its rows kept,
    only if no row of it has one.  Repeated rows stay and share their component.
    """
    own = materialise(described(docs, id_col, text_col), "described")
    one = F.min(F.when(F.col("bands").isNotNull(), F.struct("tkey", "size", *MARKS, "bands"))).alias("one")
    grouped = own.where("size > 0").groupBy("lo", "hi").agg(F.min("doc_id").alias("least"), one)
    classes = materialise(grouped.select("lo", "hi", "least", "one.*", F.monotonically_increasing_id().alias("node")), "classes")
    roots = components(links(classes, docs.select(F.col(text_col).alias("text"))))
    rooted = classes.select("lo", "hi", "least", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joint = rooted.groupBy("root").agg(F.min("least").alias("component"))
    # one row for each class, dealt anew: the rows of a class that very many texts have can be split
    known = materialise(rooted.join(dealt_anew(joint, "root"), "root").select("lo", "hi", "component"), "components")
    out = own.select("doc_id", "lo", "hi", "size").join(known, ["lo", "hi"], "left")
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
