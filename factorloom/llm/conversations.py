"""Repair of conversations: the cheapest edits that give the order (system) (user assistant)*.

Each row of a conversation is known by a letter, from its role and its first fault: s, u, a, o
(system, user, assistant, other), capital where the text is cut off, x where the row must go (blank,
or a repetition).  The letters of a conversation, in order, are its signature.  The distinct
signatures are sorted and walked as a prefix trie: the dynamic program's layer of a shared prefix is
computed once, on the path from the root; where a signature ends, its answers are read off.

A layer has, for each state before and after it (nothing yet, system, user, assistant), the least
cost and the edits of that cost that come first in ASCII order.  Edits of equal cost for equal rows
are never prefixes of each other (there is one letter for each row, and each insertion costs), so
the least ones stay the least when more follows.

Layers are matrices that can be multiplied, so a long conversation is no long task: rows are dealt
by ranges of (conversation, turn, ...), a conversation of very many rows lies in many tasks, and each
piece of at most ``SEGMENT`` letters is a signature of its own.  The answers of a conversation's
pieces are then folded in order.  Texts are not moved for this but as digests; they are read again
in the end, and stream past their conversation's edits one row at a time.

Rows are ordered by turn (nulls first), then by role and the text's digest.
"""

from __future__ import annotations

import hashlib
import os.path
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialise

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Most letters of a signature.
SEGMENT = 512
#: ASCII white space.
SPACES = " \t\n\x0b\x0c\r"
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEEP = {"s": {_NOTHING: _SYSTEM}, "u": {_NOTHING: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}, "o": {}}
#: The role that comes next, of the two that edits can give.
_NEXT = {_NOTHING: _USER, _SYSTEM: _USER, _ASSISTANT: _USER, _USER: _ASSISTANT}
_LONGEST = (1 << 63) - 1


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows dropped (0 copies), repeated (2), emptied, without stops or with another role, by a checksum of their key.

    A null is one space in the checksum, as a role and as a text.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(k == 4, "user").otherwise(spaced("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def _digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def units(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, digest) with their number ``n``, whether blank, truncated, and the first of this role and text (``fresh``).

    A conversation has one more row of nulls with n = 0 if a row of it was dropped.  No key here is
    shared by more rows than a task's partial aggregates leave of it.
    """
    here = F.col("copies") > 0
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    known = rows.select("conv_id", *[F.when(here, c).alias(a) for a, c in (("turn", F.col("turn").try_cast("long")), ("role", F.col("role")), ("digest", _digest()), ("blank", last == ""), ("truncated", ~last.isin(".", "!", "?")))], "copies")
    key = ["conv_id", "turn", "role", "digest"]
    once = known.groupBy(*key).agg(F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    once = materialise(once, "rows")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = once.where("digest is not null").groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"))
    marks = first.select("conv_id", "first.turn", "role", "digest", F.lit(0).cast("long").alias("n"), F.lit(False).alias("blank"), F.lit(False).alias("truncated"), F.lit(True).alias("fresh"))
    both = once.withColumn("fresh", F.lit(False)).unionByName(marks)
    out = materialise(both.groupBy(*key).agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("blank", "truncated", "fresh")]), "rows")
    discard(once)
    return out


class _Segment:
    """What is known of a run of a conversation's rows."""

    def __init__(self, conv, first: bool):
        self.conv, self.first, self.letters = conv, first, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.opening = self.closing = self.low = self.high = None

    def add(self, role: str, turn, letter: str, fault: str | None):
        initial = role[:1]
        if self.opening is None:
            self.opening = initial
        elif not _legal(self.closing, initial):
            self.illegal += 1
        self.closing = initial
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.letters.append(letter)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_PIECE = "part int, place long, signature string, blank long, duplicate long, truncated long, illegal long, turns long, opening string, closing string, low long, high long"


def segments(rows: DataFrame) -> DataFrame:
    """The conversations' pieces in order (part, place), each with its signature, counts and what its neighbours need of it.

    A signature starts with ^ where the conversation does, else with a dot.
    """
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_PIECE}"
    order = ["conv_id", "turn", "role", "digest"]

    def run(batches):
        part, place, now, out, arrow = TaskContext.get().partitionId(), 0, None, [], None

        def record(s: _Segment):
            nonlocal place
            place += 1
            return (s.conv, part, place, ("^" if s.first else ".") + "".join(s.letters), *[getattr(s, c) for c in _COUNTS], s.opening, s.closing, s.low, s.high)

        def flush():
            columns = list(zip(*out)) or [[]] * 13
            types = [arrow, pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64()]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *[f.split()[0] for f in _PIECE.split(", ")]])
            out.clear()
            return done

        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            for conv, turn, role, known, n, blank, truncated, fresh in zip(*[batch[c].to_pylist() for c in ("conv_id", "turn", "role", "known", "n", "blank", "truncated", "fresh")]):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(record(now))
                    now = _Segment(conv, now is not None)
                for i in range(n if known else 0):
                    if len(now.letters) >= SEGMENT:
                        out.append(record(now))
                        now = _Segment(conv, False)
                    fault = "blank" if blank else "duplicate" if i or not fresh else "truncated" if truncated else None
                    letter = "x" if fault in ("blank", "duplicate") else role[0] if role[:1] in ("s", "u", "a") else "o"
                    now.add(role, turn, letter.upper() if fault == "truncated" else letter, fault)
                    if len(out) >= 1000:
                        yield flush()
            if out:
                yield flush()
        if now is not None:
            out.append(record(now))
            yield flush()

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order[:3], F.col("digest").isNotNull().alias("known"), "n", "blank", "truncated", "fresh")
    return arrow_map(dealt, run, schema)


def _better(cells: dict, state: int, cell: tuple[int, str]):
    if state not in cells or cell < cells[state]:
        cells[state] = cell


def _inserted(cells: dict) -> dict:
    """With insertions after: two in a row lead from any state to each of the last two, more only lead back at a cost."""
    for _ in range(2):
        for state, (cost, edits) in list(cells.items()):
            _better(cells, _NEXT[state], (cost + INSERT, edits + "I"))
    return cells


def _after(cells: dict, letter: str) -> dict:
    """The layer after one more row."""
    out, kind = {}, letter.lower()
    extra = TRUNCATED if letter != kind else 0
    for state, (cost, edits) in cells.items():
        _better(out, state, (cost + DELETE, edits + "D"))
        if kind != "x":
            _better(out, _NEXT[state], (cost + REROLE + extra, edits + "R"))
            if state in _KEEP[kind]:
                _better(out, _KEEP[kind][state], (cost + extra, edits + "K"))
    return _inserted(out)


def answers(signatures: DataFrame) -> DataFrame:
    """(signature, cells) of each distinct ``signature``: for states before and after it the cost and the edits."""
    cell = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))

    def run(batches):
        path, before = [], ""  # path: the layers of the prefixes of the signature before, by length
        for batch in batches:
            found = []
            for signature in batch["signature"].to_pylist():
                shared = len(os.path.commonprefix((before, signature)))
                del path[shared:]
                if not path:
                    path.append([_inserted({s: (0, "")}) for s in ((_NOTHING,) if signature[0] == "^" else range(4))])
                for letter in signature[len(path) :]:
                    path.append([_after(cells, letter) for cells in path[-1]])
                found.append([{"before": i, "after": j, "cost": c, "edits": e} for i, cells in enumerate(path[-1]) for j, (c, e) in cells.items()])
                before = signature
            yield pa.RecordBatch.from_arrays([batch["signature"], pa.array(found, cell)], ["signature", "cells"])

    once = materialise(signatures.select("signature").distinct(), "signatures")
    out = materialise(arrow_map(once.repartitionByRange("signature").sortWithinPartitions("signature"), run, "signature string, cells array<struct<before int, after int, cost long, edits string>>"), "answers")
    discard(once)
    return out


def _folded(pieces) -> tuple:
    """The counts, cost and edits of a conversation from its pieces (rows of ``segments`` with ``cells``), in order.

    What all states' edits begin with is settled and put aside, so that only their short ends are
    copied from piece to piece.
    """
    total, settled, states = dict.fromkeys(_COUNTS, 0), [], {_NOTHING: (0, "")}
    closing = low = high = None
    for p in pieces:
        for c in _COUNTS:
            total[c] += p[c]
        if p["opening"] is not None:
            total["illegal"] += closing is not None and not _legal(closing, p["opening"])
            closing = p["closing"]
        if p["low"] is not None:
            total["turns"] -= p["low"] == high
            low, high = p["low"] if low is None else low, p["high"]
        reached: dict = {}
        for cell in p["cells"]:
            if cell["before"] in states:
                cost, edits = states[cell["before"]]
                _better(reached, cell["after"], (cost + cell["cost"], edits + cell["edits"]))
        common = os.path.commonprefix([e for _, e in reached.values()])
        settled.append(common)
        states = {s: (c, e[len(common) :]) for s, (c, e) in reached.items()}
    cost, edits = min(states[s] for s in (_NOTHING, _ASSISTANT) if s in states)
    gaps = 0 if low is None else min(high - low + 1 - total["turns"], _LONGEST)
    return gaps, *[total[c] for c in _COUNTS[:4]], cost, "".join((*settled, edits))


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def diagnose(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``rows`` (conv_id, turn, role, text, copies).

    A row with no copies only makes its conversation known; without other rows all is zero and the
    audit empty.  Null ids are one conversation.  Roles and texts must not be null (see ``damage``).
    """
    own = units(rows)
    pieces = materialise(segments(own), "pieces")
    found = answers(pieces)
    discard(own)
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[f.split()[0] for f in _SUMMARY.split(", ")]]

    def run(batches):
        arrow = None

        def stream():
            nonlocal arrow
            for batch in batches:
                arrow = batch.schema.field("conv_id").type
                yield from batch.to_pylist()

        def packed(out):
            types = [arrow, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)), types)], names)

        out = []
        for conv, some in groupby(stream(), key=lambda p: p["conv_id"]):
            out.append((conv, *_folded(some)))
            if len(out) >= 1000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    joined = pieces.join(found, "signature").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    out = materialise(arrow_map(joined, run, f"conv_id {kind}, {_SUMMARY}"), "summary")
    discard(pieces, found)
    return out


def _edited(rows):
    """Of a stream of conversations (their summary, then their rows in order): (summary, repaired (role, text) rows) of each, lazily."""
    rows = iter(rows)
    nothing = object()
    held = next(rows, nothing)
    while held is not nothing:
        summary = held

        def repaired(summary=summary):
            nonlocal held
            audit, at, state = summary["audit"], 0, _NOTHING
            names = {_USER: "user", _ASSISTANT: "assistant"}
            held = next(rows, nothing)
            while held is not nothing and held["audit"] is None:
                for _ in range(held["copies"]):
                    while audit[at] == "I":
                        state, at = _NEXT[state], at + 1
                        yield names[state], ""
                    if audit[at] != "D":
                        state = _NEXT[state] if audit[at] == "R" else _KEEP[held["role"][0]][state]
                        yield held["role"] if audit[at] == "K" else names[state], held["text"]
                    at += 1
                held = next(rows, nothing)
            for _ in audit[at:]:
                state = _NEXT[state]
                yield names[state], ""

        yield summary, repaired()


def _beside(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each conversation's summary and then its rows in order, all in one task; a task holds one batch of them."""
    kept = rows.where("copies > 0").select("conv_id", "turn", "role", "text", "copies", _digest().alias("digest"))
    both = summaries.unionByName(kept, allowMissingColumns=True)
    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").try_cast("long").asc_nulls_first(), "role", "digest"]
    return both.repartition("conv_id").sortWithinPartitions(*order).drop("digest", "turn")


def repair(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, their rows numbered from 0."""

    def run(batches):
        out, arrow = [], None

        def stream():
            nonlocal arrow
            for batch in batches:
                arrow = batch.schema.field("conv_id").type
                yield from batch.to_pylist()

        def packed():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (arrow, pa.int64(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text"])

        for summary, repaired in _edited(stream()):
            for place, (role, text) in enumerate(repaired):
                out.append((summary["conv_id"], place, role, text))
                if len(out) >= 500:
                    yield packed()
                    out.clear()
        if out:
            yield packed()

    beside = _beside(rows, summaries)
    return arrow_map(beside, run, f"conv_id {beside.schema['conv_id'].dataType.simpleString()}, place long, role string, text string")


def repair_digest(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """The summaries with ``repaired_sha256``, the digest of the repaired rows as ``role:text`` lines."""
    schema = summaries.schema
    beside = _beside(rows, summaries)

    def run(batches):
        out, arrow = [], None

        def stream():
            nonlocal arrow
            for batch in batches:
                arrow = arrow or [batch.schema.field(c).type for c in schema.names]
                yield from batch.to_pylist()

        def packed():
            done = [pa.array([row[c] for row, _ in out], t) for c, t in zip(schema.names, arrow)]
            return pa.RecordBatch.from_arrays([*done, pa.array([d for _, d in out], pa.string())], [*schema.names, "repaired_sha256"])

        for summary, repaired in _edited(stream()):
            digest = hashlib.sha256()
            for place, (role, text) in enumerate(repaired):
                digest.update((("\n" if place else "") + f"{role}:{text}").encode())
            out.append((summary, digest.hexdigest()))
            if len(out) >= 500:
                yield packed()
                out.clear()
        if out:
            yield packed()

    return arrow_map(beside, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + ", repaired_sha256 string")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: what was found after the damage, the edits, and the digest of the repaired rows."""
    rows = damage(conversations)
    return repair_digest(rows, diagnose(rows))
