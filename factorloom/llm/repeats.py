"""Repeated word windows across a corpus, by content-routed segments.

The windows of W consecutive words of a text are grouped by their minimiser: the leftmost least
hash among the K-word runs inside a window.  Consecutive windows of one minimiser form a segment
(the windows a .. a + n - 1, so the words a .. a + n + W - 2).  Equal windows have equal minimisers,
so windows can only repeat within the segments of one minimiser hash h; those of an h that occurs
once need no further look.

Of the others, each distinct content is taken once, with the number of its occurrences, and sent
by h to a shard, whose resolver (an FM-index or a sparse suffix array over the words themselves)
tells which windows occur in which contents.  Copies of a segment are known by h and a hash of the
whole content, 128 bits together; they are counted, never expanded into pairs.

An h with more than ``HOT`` contents (a line that very many texts share) would make one task too
large; there the windows themselves are aggregated by two 64-bit hashes, spread over all tasks.

A text is known by its id and its hash; occurrences are ordered by id, then text, then place.  Rows
equal in id and text are one text in that order, but each counts as an occurrence.  Ids are
integers; null ids come first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, chunks, dealt_anew, dense_words, discard, gram_hashes, materialise, mix, run_groups, span_hashes, text_bytes, window_min

GRAM = 8
#: Distinct contents under one minimiser up to which a shard's task resolves them.
HOT = 1000
#: Words of one index, and contents that are looked at together.
SHARD_WORDS, PART = 200_000, 4096
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, rkey, text): the identity of each text and the text itself, null as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"), F.xxhash64(text).alias("rkey"), text.alias("text"))


def segments(w: Words, window: int):
    """Arrays of the segments: first word in the flat words, row, windows, minimiser's place, its hash, content's hash."""
    g = gram_hashes(w.hash, GRAM)
    n = w.n - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    at = window_min(g, window - GRAM + 1)[:n]
    row = w.rows()
    valid = row[:n] == row[window - 1 :]
    place = np.flatnonzero(valid)
    bounds = run_groups(at[place])
    a = place[bounds[:-1]]
    size = np.diff(bounds)
    return a, row[a] if len(a) else a, size, at[a], g[at[a]], span_hashes(w.hash, a, a + size - 1 + window)


def emit(docs: DataFrame, window: int) -> DataFrame:
    """One row per segment: h, s, rid, rkey, a (first word), n (windows), m (minimiser's offset)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            rid, rkey = batch["rid"].to_numpy(), batch["rkey"].to_numpy()
            for lo, hi in chunks(offsets):
                w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                a, row, n, m, h, s = segments(w, window)
                cols = [h.view(np.int64), s.view(np.int64), rid[lo:hi][row], rkey[lo:hi][row], (a - w.first[row]).astype(np.int32), n.astype(np.int16), (m - a).astype(np.int16)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "s", "rid", "rkey", "a", "n", "m"])

    return arrow_map(docs, run, "h long, s long, rid long, rkey long, a int, n smallint, m smallint")


_SEGMENT = {"h": pa.int64(), "s": pa.int64(), "c": pa.int64(), "a": pa.int32(), "n": pa.int16(), "m": pa.int16(), "hot": pa.bool_()}
_CONTENT = "h long, s long, c long, a int, n smallint, m smallint, hot boolean, rid long, rkey long, content binary, w1 long, w2 long, off int"


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), then of first[1], and so on."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _contents(texts: DataFrame, window: int) -> DataFrame:
    """Rows (rid, rkey, text, segs) to the bytes of each segment; of a hot one, to a row for each window."""

    def part(batch, data, offsets):
        w = Words(data, offsets)
        again = mix(w.hash ^ np.uint64(0x5851F42D4C957F2D))
        segs = batch["segs"]
        row = np.repeat(np.arange(len(segs)), np.diff(segs.offsets.to_numpy()))
        segs = segs.flatten()
        cols = {k: segs.field(k).to_numpy(zero_copy_only=False) for k in _SEGMENT}
        cols |= {k: batch[k].to_numpy()[row] for k in ("rid", "rkey")}
        first, n = w.first[row] + cols["a"], cols["n"].astype(np.int64)
        for hot in (False, True):
            of = np.flatnonzero(cols["hot"] == hot)
            if not len(of):
                continue
            if hot:
                at = _spread(first[of], n[of])
                more = [pa.nulls(len(at), pa.binary()), *(pa.array(span_hashes(h, at, at + window).view(np.int64)) for h in (w.hash, again))]
                of = np.repeat(of, n[of])
                more.append(pa.array((at - first[of]).astype(np.int32)))
            else:
                begin, end = w.start[first[of]], w.end[first[of] + n[of] + window - 2]
                ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
                content = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends), pa.py_buffer(w.data[_spread(begin, end - begin)])])
                more = [content, *(pa.nulls(len(of), k) for k in (pa.int64(), pa.int64(), pa.int32()))]
            kinds = _SEGMENT | {"rid": pa.int64(), "rkey": pa.int64()}
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[k][of], t) for k, t in kinds.items()), *more], [c.split()[0] for c in _CONTENT.split(", ")])

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            for lo, hi in chunks(offsets):
                yield from part(batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

    return arrow_map(texts, run, _CONTENT)


class Contents:
    """The distinct segment contents of a shard: word numbers end to end, with a 0 after each.  Words are numbered by their bytes."""

    def __init__(self, rows: dict[str, np.ndarray], contents: pa.Array, window: int):
        self.rows, self.window = rows, window
        numbers, first = dense_words(*text_bytes(contents))
        self.sigma = int(numbers.max()) + 1 if len(numbers) else 1
        self.size = np.diff(first)
        self.first = first[:-1] + np.arange(len(contents))
        self.text = np.zeros(len(numbers) + len(contents), np.int64)
        self.text[np.arange(len(numbers)) + np.repeat(np.arange(len(contents)), self.size)] = numbers
        n = rows["n"].astype(np.int64)
        self.segment = np.repeat(np.arange(len(n)), n)
        self.window_of = np.cumsum(n) - n  # each segment's first window
        self.off = np.arange(len(self.segment)) - np.repeat(self.window_of, n)
        self.at = self.first[self.segment] + self.off  # each window's place in the text


#: A resolver gives each window a group (equal windows, equal group), or -1 for windows that it knows to be in one content only.
Resolver = Callable[[Contents], np.ndarray]
_FOUND = "h long, s long, runs array<struct<off:int,len:int,rid:long,rkey:long,pos:long>>"


def _runs(c: Contents, group: np.ndarray):
    """For each segment with repeated windows: runs of them with the first occurrence of each run's first window."""
    rid, rkey, pos = c.rows["rid"][c.segment], c.rows["rkey"][c.segment], c.rows["a"][c.segment].astype(np.int64) + c.off
    count = c.rows["c"][c.segment]
    alone = group < 0
    group = np.where(alone, np.arange(len(group)) + (int(group.max()) + 1 if len(group) else 0), group)
    order = np.lexsort((pos, rkey, rid, group))
    heads = run_groups(group[order])
    first = order[np.repeat(heads[:-1], np.diff(heads))]
    total = np.repeat(np.add.reduceat(count[order], heads[:-1]), np.diff(heads)) if len(order) else count
    first_of, total_of = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    first_of[order], total_of[order] = first, total
    some = np.flatnonzero(total_of > 1)
    if not len(some):
        return
    seg, off, frid, frkey, fpos = c.segment[some], c.off[some], rid[first_of[some]], rkey[first_of[some]], pos[first_of[some]]
    new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (off[1:] != off[:-1] + 1) | (frid[1:] != frid[:-1]) | (frkey[1:] != frkey[:-1]) | (fpos[1:] != fpos[:-1] + 1)])
    start = np.flatnonzero(new)
    size = np.diff(start, append=len(some))
    seg, off, frid, frkey, fpos = seg[start], off[start], frid[start], frkey[start], fpos[start]
    heads = run_groups(seg)
    values = pa.StructArray.from_arrays([pa.array(off, pa.int32()), pa.array(size, pa.int32()), pa.array(frid), pa.array(frkey), pa.array(fpos)], ["off", "len", "rid", "rkey", "pos"])
    who = seg[heads[:-1]]
    yield pa.RecordBatch.from_arrays([pa.array(c.rows["h"][who]), pa.array(c.rows["s"][who]), pa.ListArray.from_arrays(pa.array(heads, pa.int32()), values)], ["h", "s", "runs"])


def _resolve(contents: DataFrame, window: int, resolver: Resolver) -> DataFrame:
    def run(batches):
        names = ["h", "s", "c", "rid", "rkey", "a", "n", "m"]
        held, words, before = [], 0, None

        def flush(table):
            c = Contents({k: table[k].to_numpy() for k in names}, table["content"].combine_chunks(), window)
            yield from _runs(c, resolver(c))

        for batch in batches:
            for lo in range(0, batch.num_rows, PART):
                part = batch.slice(lo, PART)
                h, s = part["h"].to_numpy(), part["s"].to_numpy()
                # repeated rows of a text give its contents again, next to each other
                new = np.concatenate([[before != (h[0], s[0])], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
                before = h[-1], s[-1]
                if not new.all():
                    part = part.filter(pa.array(new))
                held.append(part)
                words += int(part["n"].to_numpy().sum()) + part.num_rows * window
                if words >= SHARD_WORDS:
                    table = pa.Table.from_batches(held)
                    h = table["h"].to_numpy()
                    cut = int(np.searchsorted(h, h[-1]))  # the last minimiser may go on
                    if cut:
                        yield from flush(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    words = (table.num_rows - cut) * window
        if sum(b.num_rows for b in held):
            yield from flush(pa.Table.from_batches(held))

    rows = contents.where("not hot").select("h", "s", "c", "rid", "rkey", "a", "n", "m", "content")
    return arrow_map(rows.repartition("h").sortWithinPartitions("h", "s"), run, _FOUND)


def repeated(docs: DataFrame, window: int, resolver: Resolver, keep_first: bool) -> DataFrame:
    """(rid, rkey, spans array<struct<lo,hi>>) of the keyed texts that have words to remove; spans in no order, some touching.

    Removed are the words of each window whose word sequence also starts elsewhere; with
    ``keep_first`` not those of its first occurrence (by id, then text, then place).
    """
    found = materialise(emit(docs, window), "segments")
    often = found.groupBy("h").agg(F.count("*").alias("occ")).where("occ > 1").select("h")
    # dealt anew, the join can split the segments of a hot minimiser
    joint = materialise(found.join(dealt_anew(often, "h"), "h", "left_semi").select("h", "s", "rid", "rkey", "a", "n", "m"), "shared")
    discard(found)
    kinds = joint.groupBy("h", "s").agg(F.count("*").alias("c"), F.min(F.struct("rid", "rkey", "a", "n", "m")).alias("at"))
    many = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("h", F.lit(True).alias("hot"))
    seg = F.struct("h", "s", "c", F.col("at.a").alias("a"), F.col("at.n").alias("n"), F.col("at.m").alias("m"), F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = kinds.join(dealt_anew(many, "h"), "h", "left").select(F.col("at.rid").alias("rid"), F.col("at.rkey").alias("rkey"), seg.alias("seg"))
    wanted = wanted.groupBy("rid", "rkey").agg(F.collect_list("seg").alias("segs"))
    texts = docs.join(dealt_anew(wanted, "rid", "rkey"), ["rid", "rkey"]).select("rid", "rkey", "text", "segs")
    contents = materialise(_contents(texts, window), "contents")

    windows = contents.where("hot").select("w1", "w2", "h", "s", "c", "off", "rid", "rkey", (F.col("a") + F.col("off")).cast("long").alias("pos"))
    windows = windows.dropDuplicates(["h", "s", "off"])
    often = windows.groupBy("w1", "w2").agg(F.sum("c").alias("occ"), F.min(F.struct("rid", "rkey", "pos")).alias("at")).where("occ > 1")
    hot = windows.select("w1", "w2", "h", "s", "off").join(dealt_anew(often, "w1", "w2"), ["w1", "w2"]).groupBy("h", "s").agg(F.collect_list(F.struct("off", F.lit(1).alias("len"), F.col("at.rid").alias("rid"), F.col("at.rkey").alias("rkey"), F.col("at.pos").alias("pos"))).alias("runs"))
    runs = materialise(_resolve(contents, window, resolver).unionAll(hot), "runs")
    discard(contents)

    own = joint.select("h", "s", "rid", "rkey", "a").join(runs, ["h", "s"])
    kept = F.col("runs")
    if keep_first:  # a run whose first window is this very place holds first occurrences only
        kept = F.filter(kept, lambda r: ~((r["rid"] == F.col("rid")) & (r["rkey"] == F.col("rkey")) & (r["pos"] == F.col("a") + r["off"])))
    spans = F.transform(kept, lambda r: F.struct((F.col("a") + r["off"]).alias("lo"), (F.col("a") + r["off"] + r["len"] + (window - 1)).alias("hi")))
    spans = own.select("rid", "rkey", spans.alias("spans")).where(F.size("spans") > 0)
    # a set, so that rows of one text add nothing
    return spans.groupBy("rid", "rkey").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]
