"""Byte-level BPE by rank files: exact encoding in linear time, and decoding.

The bytes of a text are mapped to Latin-1, so that an Aho-Corasick automaton over the vocabulary
gives the longest token that starts at each byte.  Encoding goes left to right with the longest
match; a token stays only if it is compatible with the one before it (the merges of the two
tokens' joint bytes give just these two), else the next shorter token is tried, and where none is
left the last token is taken back.  Compatibility of two adjacent tokens is memoised, and an end
from which the search came back is never tried again; so the work is linear in the text.

Texts are cut by the vocabulary's pattern first; each match is encoded separately, and a match
that is itself a token is that token.  A chunk of texts is cut at once where the pattern always ends
a match; each distinct piece is looked up once in a worker's bounded memo, and the new ones are
encoded.  A null text counts as empty and has no tokens.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, gathered, give_back, kept_by_worker, text_bytes

#: Pieces in a worker's memo, and bytes of texts that are cut at once.
MEMO_PIECES, CUT_BYTES = 600_000, 6 << 20
#: Bytes of texts that are encoded, decoded and digested at once.
DIGEST_BYTES = 2 << 20
#: White space as the pattern's \s has it (Unicode White_Space).
WHITE = "\t-\r \x85\xa0  -     　"
#: Fixed value: the pattern whose matches ``piece_starts`` knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of tokens that are memoised.
MOST_PAIRS = 250_000
#: Above every rank.
NONE = 1 << 60


#: Kinds of bytes: 1 ASCII white space, 2 ASCII letters and digits, 3 marks that never go on a match of those.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 2
_KIND[[ord(c) for c in ".,!?;:"]] = 3


ASCII_WHITE = _KIND == 1


def wide_white(data: np.ndarray) -> np.ndarray:
    """Places where white space beyond ASCII begins (U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000)."""
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    b = np.concatenate([data, np.zeros(2, np.uint8)])
    x, y, z = b[at], b[at + 1], b[at + 2]
    general = (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F)
    return at[(x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE2) & general | (x == 0xE3) & (y == 0x80) & (z == 0x80)]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that lie end to end, and the end; only ends of matches of the pattern are cut.

    The pattern gives a run of white space but for its last character to itself, that last one to
    the word after it if it is a space, and a run at the end of a text to itself; letters and
    digits end before a mark.
    """
    n = len(data)
    kind = _KIND[data]
    white, cut = kind == 1, np.zeros(n + 1, bool)
    if n > 1:
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        cut[1:n] = white[1:] & ~white[:-1] | (kind[1:] == 3) & (kind[:-1] == 2) | ~white[1:] & white[:-1] & (data[:-1] != 0x20)
        # the last of a run that a word of the same text follows
        cut[: n - 1] |= white[:-1] & ~white[1:] & ~first[1:n]
    cut[offsets] = True
    return np.flatnonzero(cut)


class Splitter:
    """Cuts a text into pieces whose encodings just follow each other.

    Where no two white-space characters touch, a cut before each single space never cuts a match
    of the pattern.  Other texts are cut at the edges of white-space runs, as the pattern does.
    """

    def __init__(self):
        import re

        self.touching = re.compile(f"[{WHITE}][{WHITE}]").search
        self.coarse = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall

    def __call__(self, text: str) -> list[str]:
        if not text:
            return []
        if self.touching(text):
            return self.coarse(text)
        first, *rest = text.split(" ")
        out = [" " + x for x in rest]
        return [first, *out] if first else out


class PieceCoder:
    """Ids of whole texts, piece by piece, with a bounded memo of pieces.

    Subclasses encode the pieces that the memo lacks (``encode_new``) and say which texts must be
    encoded in another way (``odd_strings``, ``encode_odd``).
    """

    odd_strings: list[str] = []

    def __init__(self, pattern: str = PATTERN):
        self.cut = Splitter() if pattern == PATTERN else None
        # the memo: pieces, and where the ids of each begin and end in one array
        self.keys, self.flat, self.begin, self.end = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces in one array, and where each one's begin and end."""
        raise NotImplementedError

    def encode_odd(self, text: str) -> np.ndarray | None:
        """The ids of a text with one of ``odd_strings``; None: as any other."""

    def lookup(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct pieces begin and end in ``flat``; those that the memo lacks are encoded."""
        at = pc.index_in(pieces, value_set=self.keys)
        lacking = np.asarray(at.is_null())
        at = at.fill_null(0).to_numpy().astype(np.int64)
        if not lacking.any():
            return self.begin[at], self.end[at]
        new = pieces.filter(pa.array(lacking))
        if len(self.keys) + len(new) > MEMO_PIECES:  # what is not used now is forgotten
            used = at[~lacking]
            size = self.end[used] - self.begin[used]
            begin = np.cumsum(size) - size
            self.flat = self.flat[np.repeat(self.begin[used] - begin, size) + np.arange(size.sum())]
            self.keys, self.begin, self.end = self.keys.take(pa.array(used)), begin, begin + size
            at[~lacking] = np.arange(len(used))
        ids, begin, end = self.encode_new(new)
        at[lacking] = len(self.keys) + np.arange(len(new))
        self.begin, self.end = np.concatenate([self.begin, begin + len(self.flat)]), np.concatenate([self.end, end + len(self.flat)])
        self.flat, self.keys = np.concatenate([self.flat, ids]), pa.concat_arrays([self.keys, new])
        return self.begin[at], self.end[at]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column end to end, and the n + 1 offsets (null: no ids)."""
        data, offsets = text_bytes(column)
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo, hi in chunks(offsets, CUT_BYTES):
            ids, size = self.encode_texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            parts.append(ids)
            sizes.append(size)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie end to end, and the number of each text's."""
        starts = piece_starts(data, offsets) if self.cut else np.unique(offsets)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        begin, end = self.lookup(pieces.dictionary)
        which = pieces.indices.to_numpy()
        size = (end - begin)[which]
        last = np.cumsum(size)
        at = np.repeat(begin[which] - (last - size), size)
        at += np.arange(len(at))
        ids = self.flat[at]
        ends = np.concatenate([[0], last])[np.searchsorted(starts, offsets)]
        raw = data.tobytes()
        odd = set((np.searchsorted(offsets, wide_white(data), "right") - 1).tolist()) if self.cut else set()
        for s in self.odd_strings:
            s, found = s.encode(), -1
            while (found := raw.find(s, found + 1)) >= 0:
                odd.add(int(np.searchsorted(offsets, found, "right")) - 1)
        if not odd:
            return ids, np.diff(ends)
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for r in odd:
            out[r] = self._odd(raw[offsets[r] : offsets[r + 1]].decode("utf-8", "replace"))
        return np.concatenate(out), np.array(list(map(len, out)), np.int64)

    def _odd(self, text: str) -> np.ndarray:
        """The ids of a text with an odd string or with white space beyond ASCII."""
        if any(s in text for s in self.odd_strings):
            return self.encode_odd(text)
        words = pa.array([w.encode() for w in self.cut(text)], pa.binary()).dictionary_encode()
        begin, end = self.lookup(words.dictionary)
        return np.concatenate([np.zeros(0, np.int32), *(self.flat[begin[i] : end[i]] for i in words.indices.to_pylist())])


class RankBPE(PieceCoder):
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.size = {i: len(b) for b, i in self.ranks.items()}
        super().__init__(pattern)
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.shorter_of: dict[int, int] = {}
        tokens = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.token_bytes, self.token_decimals = pa.array(tokens, pa.binary()), pa.array([f"{i},".encode() for i in range(len(tokens))], pa.binary())

    def merges(self, piece: bytes) -> list[int]:
        """The merges themselves: join the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [rank(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], NONE)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], NONE)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of the joint bytes give these two tokens (left -1: of the right token's bytes, it alone)."""
        joint = (self.bytes[left] if left >= 0 else b"") + self.bytes[right]
        if len(self.compatible) > MOST_PAIRS:
            self.compatible.clear()
        known = self.compatible[left << 32 | right] = self.merges(joint) == ([left, right] if left >= 0 else [right])
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        known = self.shorter_of.get(token)
        if known is None:
            b = self.bytes[token]
            known = next((r for n in range(len(b) - 1, 0, -1) if (r := self.ranks.get(b[:n])) is not None), -1)
            self.shorter_of[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        reach = [0] * n
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            at = end - size + 1
            if size > reach[at]:
                reach[at], longest[at] = size, token
        known, size_of = self.compatible.get, self.size.__getitem__
        dead, out, pos, left, token = set(), [], 0, -1, longest[0]
        while True:
            size = size_of(token)
            fit = known(left << 32 | token)
            if fit is None:
                fit = self.fits(left, token)
            if fit and pos + size not in dead:
                out.append(token)
                pos += size
                if pos >= n:
                    return out
                left, token = token, longest[pos]
                continue
            token = self.shorter(token)
            while token < 0:  # nothing fits here: this position is never reached again
                dead.add(pos)
                last = out.pop()
                pos -= size_of(last)
                left, token = out[-1] if out else -1, self.shorter(last)

    def encode_new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ranks, split, encode = self.ranks, self.split, self.encode_piece
        out, sizes = array("i"), []
        for p in pieces.to_pylist():
            whole, before = ranks.get(p), len(out)
            if whole is not None and len(split(p.decode("utf-8", "replace"))) == 1:
                out.append(whole)
            else:
                for part in split(p.decode("utf-8", "replace")):
                    out.extend(encode(part.encode()))
            sizes.append(len(out) - before)
        end = np.cumsum(sizes, dtype=np.int64)
        return np.frombuffer(out, np.int32), end - np.array(sizes, np.int64), end

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, as 32-bit integers."""
        return self.encode_column(pa.array([text], pa.string()))[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@kept_by_worker(maxsize=2)
def rank_bpe(path: str, pattern: str) -> RankBPE:
    return RankBPE(path, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each whole text.  One row per input row; repeated ids stay; null text: no ids."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        bpe = rank_bpe(vocabulary, pattern)
        for batch in gathered(batches, "text", DIGEST_BYTES):
            ids, offsets = bpe.encode_column(batch["text"])
            arr = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], arr], ["doc_id", "ids"])

    return arrow_map(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def digests(strings: pa.Array, ends: np.ndarray, cut: int) -> pa.Array:
    """The sha256 of each document's strings end to end, without the last ``cut`` bytes."""
    data, offsets = text_bytes(strings)
    raw, at = memoryview(data), offsets[ends].tolist()
    return pa.array([hashlib.sha256(raw[a : max(b - cut, a)]).hexdigest() for a, b in zip(at, at[1:])], pa.string())


def token_digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each whole text, decodes the ids, digests both.

    The ids never leave the worker, so nothing but digests is moved.  Empty or null text: no
    tokens, digests of the empty string.  Very long texts are encoded whole.
    """
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        bpe = rank_bpe(vocabulary, pattern)
        for batch in gathered(batches, "text", DIGEST_BYTES):
            ids, ends = bpe.encode_column(batch["text"])
            decimals, decoded = (digests(tokens.take(pa.array(ids)), ends, cut) for tokens, cut in ((bpe.token_decimals, 1), (bpe.token_bytes, 0)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(ends)), decimals, decoded], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            give_back()

    return arrow_map(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
