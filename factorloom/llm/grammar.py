"""Token ids as grammar-compressed shard files (Re-Pair), with random-access decoding.

Per shard, rounds replace frequent adjacent id pairs by new nonterminals: a round counts all
pairs, takes those that recur most, and replaces their occurrences from left to right without
overlap; rounds go on until no pair recurs often enough to pay for its rule.  Pairs never cross the
end of a document.  A file holds the document index, the rules, the length of each rule's expansion
and the remaining sequence; so any document, or any part of one, is decoded without its neighbours.

Texts are cut, a chunk of them at once, where the vocabulary's pattern always ends a match; each
distinct piece of a chunk is looked up once, and the library encodes those that are new.

Shards are cut at ``SHARD_TOKENS`` ids, so a task's memory does not depend on its partition; one
longer document is a shard of its own.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ASCII_WHITE, CUT_BYTES, PieceCoder, wide_white
from .common import arrow_map, gathered, kept_by_worker, materialise, scratch, text_bytes

SHARD_TOKENS = 2_000_000
#: Nonterminals that one round may add (the most frequent pairs first; the others wait for the next round).
ROUND_RULES = 16384
#: A rule takes three numbers in the file and each occurrence saves one, so a pair pays from the fourth on.
LEAST_COUNT = 4
#: Pieces that the library gets as one text.
JOINT = 500
#: Bits of the hash table in which a round finds its pairs.
TABLE_BITS = 18
MAGIC = b"RPG1"


def find(chosen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key a place in ``chosen`` where it must be if it is there: a hash table, and search for what collides in it."""
    slot = lambda x: ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
    table, own = np.zeros(1 << TABLE_BITS, np.int32), slot(chosen)
    table[own] = np.arange(len(chosen))
    shared = table[own] != np.arange(len(chosen))
    where = slot(keys)
    at = table[where]
    if shared.any():
        doubtful = np.zeros(1 << TABLE_BITS, bool)
        doubtful[own[shared]] = True
        some = np.flatnonzero(doubtful[where])
        at[some] = np.minimum(np.searchsorted(chosen, keys[some]), len(chosen) - 1)
    return at


def repair(tokens: np.ndarray, doc_ends: np.ndarray, base: int):
    """Grammar of a shard: rules (left, right), the sequence, and each document's end in it.

    ``doc_ends``: ascending ends of the documents in ``tokens`` (each holds at least one id).
    """
    seq = tokens.astype(np.int64)
    ends = doc_ends.astype(np.int64)
    left, right = [], []
    n_rules = 0
    while len(seq) > 1:
        keys = seq[:-1] << 32 | seq[1:]
        keys[ends[:-1] - 1] = -1
        ordered = np.sort(keys)
        starts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
        counts = np.diff(starts, append=len(ordered))
        pairs = ordered[starts]
        often = np.flatnonzero((counts >= LEAST_COUNT) & (pairs >= 0))
        if len(often) > ROUND_RULES:
            often = np.sort(often[np.argsort(-counts[often], kind="stable")[:ROUND_RULES]])
        if not len(often):
            break
        chosen = pairs[often]
        at = find(chosen, keys)
        hit = chosen[at] == keys
        place = np.flatnonzero(hit)
        run_start = np.concatenate([[True], place[1:] != place[:-1] + 1])
        first = place[run_start][np.cumsum(run_start) - 1]
        place = place[(place - first) % 2 == 0]
        seq[place] = base + n_rules + at[place]
        keep = np.ones(len(seq), bool)
        keep[place + 1] = False
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        seq = seq[keep]
        left.append(chosen >> 32)
        right.append(chosen & 0xFFFFFFFF)
        n_rules += len(chosen)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left + none).astype(np.int32), np.concatenate(right + none).astype(np.int32), seq.astype(np.int32), ends


def expansion_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    out = [0] * len(left)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        out[i] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return np.array(out, np.int32)


def pack(ids: pa.Array, tokens: np.ndarray, doc_ends: np.ndarray, base: int) -> bytes:
    """The bytes of a shard file."""
    left, right, seq, ends = repair(tokens, doc_ends, base)
    index = pa.table({"id": ids, "n_tokens": pa.array(np.diff(doc_ends, prepend=0), pa.int64()), "seq_end": pa.array(ends, pa.int64())})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, index.schema) as w:
        w.write_table(index)
    raw = sink.getvalue()
    return b"".join([MAGIC, struct.pack("<QQQQ", base, len(raw), len(left), len(seq)), raw, left.tobytes(), right.tobytes(), expansion_lengths(left, right, base).tobytes(), seq.tobytes()])


class Shard:
    """A shard file's contents; ``tokens(i, lo, hi)`` decodes a part of document i."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.base, n_index, n_rules, n_seq = struct.unpack_from("<QQQQ", data, 4)
        at = 36
        self.index = pa.ipc.open_stream(data[at : at + n_index]).read_all().combine_chunks()
        at += n_index
        self.left, self.right, self.length = (np.frombuffer(data, np.int32, n_rules, at + 4 * n_rules * i) for i in range(3))
        self.seq = np.frombuffer(data, np.int32, n_seq, at + 12 * n_rules)
        self.n_tokens = self.index["n_tokens"].to_numpy()
        self.seq_end = self.index["seq_end"].to_numpy()
        offsets = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)])
        flat = np.zeros(offsets[-1], np.int32)
        bounds, base = offsets.tolist(), self.base
        for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            lo, hi = bounds[i], bounds[i + 1]
            if a < base:
                flat[lo] = a
                mid = lo + 1
            else:
                mid = lo + bounds[a - base + 1] - bounds[a - base]
                flat[lo:mid] = flat[bounds[a - base] : bounds[a - base + 1]]
            if b < base:
                flat[mid] = b
            else:
                flat[mid:hi] = flat[bounds[b - base] : bounds[b - base + 1]]
        self.flat, self.offsets = flat, offsets

    def expand(self, seq: np.ndarray) -> np.ndarray:
        rule = np.maximum(seq.astype(np.int64) - self.base, -1)
        long = rule >= 0
        if not len(self.length):
            return seq
        size = np.where(long, self.length[rule], 1)
        begin = np.cumsum(size) - size
        at = np.repeat(np.where(long, self.offsets[rule], 0) - begin, size)
        at += np.arange(len(at))
        out = self.flat[np.minimum(at, len(self.flat) - 1)]
        out[begin[~long]] = seq[~long]
        return out

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.seq[self.seq_end[i - 1] if i else 0 : self.seq_end[i]])

    def tokens(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of document i: only the symbols that reach into the range are expanded."""
        seq = self.seq[self.seq_end[i - 1] if i else 0 : self.seq_end[i]]
        size = np.ones(len(seq), np.int64)
        long = seq >= self.base
        size[long] = self.length[seq[long] - self.base]
        end = np.cumsum(size)
        a, b = np.searchsorted(end, lo, "right"), np.searchsorted(end, hi, "left") + 1
        skip = lo - (end[a - 1] if a else 0)
        return self.expand(seq[a:b])[skip : skip + hi - lo]


class LibraryBPE(PieceCoder):
    """Ids of whole texts by the tokenizers library.

    New pieces are encoded many in one text; the byte lengths of the tokens tell where each piece
    ends.  A text with a special token's string is encoded as it stands.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.odd_strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.base = max(vocab.values()) + 1
        self.size = np.zeros(self.base, np.int64)
        for t, i in vocab.items():
            self.size[i] = len(t)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_odd(self, text: str) -> np.ndarray:
        return np.array(self._ids([text])[0], np.int32)

    def _alone(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces encoded one by one, and where each one's begin and end."""
        ids = self._ids([p.decode("utf-8", "replace") for p in pieces.to_pylist()])
        end = np.cumsum([len(x) for x in ids], dtype=np.int64)
        return np.array([i for x in ids for i in x], np.int32), np.concatenate([[0], end])[:-1], end

    def _joint(self, pieces: pa.Array, bare: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_alone``, of pieces that begin with a space, or (``bare``) get a line end before them, which is a match and a token of its own."""
        if bare:
            pieces = pc.binary_join_element_wise(pa.scalar(b"\n", pa.binary()), pieces, pa.scalar(b"", pa.binary()))
        data, offsets = text_bytes(pieces)
        cuts = [*range(0, len(pieces), JOINT), len(pieces)]
        texts = [data[offsets[a] : offsets[b]].tobytes().decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in self._ids(texts))])
        bytes_ = np.concatenate([[0], np.cumsum(self.size[ids])])
        at = np.searchsorted(bytes_, offsets)
        begin, end = at[:-1] + bare, at[1:]
        whole = bytes_[np.minimum(at, len(ids))] == offsets
        good = whole[:-1] & whole[1:] & (bytes_[np.minimum(begin, len(ids))] == offsets[:-1] + bare)
        if not good.all():  # no token may reach over a piece's edge; encode what did by itself
            more, b, e = self._alone(pc.binary_slice(pieces, int(bare)).filter(pa.array(~good)))
            begin[~good], end[~good] = b + len(ids), e + len(ids)
            ids = np.concatenate([ids, more])
        return ids, begin, end

    def encode_new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = text_bytes(pieces)
        size = np.diff(offsets)
        space = ASCII_WHITE[data]
        edge = space[offsets[:-1] + (size > 1)] | space[offsets[1:] - 1]  # white at the second place (the first of one byte) or the last
        wide = np.zeros(len(pieces), bool)
        wide[np.searchsorted(offsets, wide_white(data), "right") - 1] = True
        spaced = data[offsets[:-1]] == 0x20
        flat, begin, end, n = [], np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), 0
        for which, encode in ((edge | wide, self._alone), (~edge & ~wide & spaced, lambda x: self._joint(x, False)), (~edge & ~wide & ~spaced, lambda x: self._joint(x, True))):
            if which.any():
                ids, b, e = encode(pieces.filter(pa.array(which)))
                begin[which], end[which] = b + n, e + n
                flat.append(ids)
                n += len(ids)
        return np.concatenate(flat), begin, end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


@kept_by_worker(maxsize=1)
def library_bpe(path: str) -> LibraryBPE:
    return LibraryBPE(path)


def write_shards(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, append ``end_id``, write shard files in ascending id order.

    Returns the manifest (part, seq, path, n_docs, n_tokens, n_bytes), which is itself written
    first: files of failed attempts are in no manifest.  Null text: only the end id.  Null ids come
    first; equal ids are ordered by text.  An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "shards")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        bpe, part, state = library_bpe(vocabulary), TaskContext.get().partitionId(), {"seq": 0, "n": 0}
        ids, tokens = [], []
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)

        def flush():
            ends = np.cumsum([len(x) for x in tokens])[1::2]
            data = pack(pa.concat_arrays(ids), np.concatenate(tokens), ends, bpe.base)
            name = f"{root}/part-{part:06d}-{state['seq']:05d}-{uuid.uuid4().hex}.rpg"
            with fs.open_output_stream(name) as f:
                f.write(data)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [state["seq"]], "path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "n_docs": [len(ends)], "n_tokens": [int(ends[-1])], "n_bytes": [len(data)]}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))
            state.update(seq=state["seq"] + 1, n=0)
            ids.clear()
            tokens.clear()
            return row

        end = np.array([end_id], np.int32)
        for batch in gathered(batches, "text", CUT_BYTES):
            flat, ends = bpe.encode_column(batch["text"])
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                if state["n"] and state["n"] + b - a + 1 > SHARD_TOKENS:
                    yield flush()
                ids.append(batch["id"].slice(i, 1))
                tokens += [flat[a:b], end]
                state["n"] += b - a + 1
        if tokens:
            yield flush()

    ranged = source.repartitionByRange(F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return materialise(arrow_map(ranged, run, "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long"), "manifest")


def read_shards(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the shard files; ``id_type``: that of the ids."""
    spark = manifest.sparkSession
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    placed = manifest.withColumn("within", within).join(before, "part").select("path", (F.col("before") + F.col("within")).alias("start"))
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(name) as f:
                    shard = Shard(f.read())
                ids = shard.expand(shard.seq).astype("<u4")
                ends = np.cumsum(shard.n_tokens)
                starts = ends - shard.n_tokens
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([shard.index["id"].combine_chunks(), pa.array(starts + start, pa.int64()), pa.array(shard.n_tokens, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(placed, run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
