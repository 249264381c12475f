"""Conversation repair against an exhaustive search, and fill-in-middle documents against plain slices."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from factorloom.llm import conversations, infill

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain_faults(rows):
    """The first fault of each of a conversation's ordered rows."""
    seen, out = set(), []
    for _, _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """All edits of at most the best cost so far, one by one: (cost, edits, repaired rows)."""
    best = [(2 * len(rows), "D" * len(rows), [])]

    def go(i, cost, edits, done):
        if cost > best[0][0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[0] if r else "?" for r, _ in done)):
                best[0] = min(best[0], (cost, edits, list(done)), key=lambda b: b[:2])
        else:
            role, text = rows[i][2:]
            go(i + 1, cost + 2, edits + "D", done)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                go(i + 1, cost + more, edits + "K", [*done, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, cost + more + 1, edits + "R", [*done, (r, text)])
        for r in ("user", "assistant"):
            go(i, cost + 5, edits + "I", [*done, (r, "")])

    go(0, 0, "", [])
    return best[0]


def plain_repair(rows):
    by, out = defaultdict(list), {}
    for r in rows:
        by[r[0]]
    for r in plain_damage(rows):
        by[r[0]].append(r)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults = plain_faults(own)
        cost, audit, done = cheapest(own, faults)
        turns = {r[1] for r in own if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out


def random_rows(n, seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "what?", "cut off", "cut off too ", " ", "", " \t\x0b\x0c\r\n", None, "a.\n", "中文。", "x . y"]
    rows = []
    for conv in range(n):
        for t in range(rng.randrange(1, 6)):
            rows.append((conv if conv % 50 else None, rng.choice([t, t, t, t + rng.randrange(3), None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return [r for r in rows if r[0] is not None or r[1] is None or r[1] < 2][: 6 * n]


def one_null_conversation(rows):
    """No more than four rows without a conversation: the exhaustive search can't take more."""
    none = [r for r in rows if r[0] is None][:4]
    return [r for r in rows if r[0] is not None] + none


@pytest.mark.parametrize("segment", [512, 2, 1])
def test_repair_against_exhaustive_search(spark, segment, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = one_null_conversation(random_rows(250))
    rows += [(7_000, 1, "user", "Same.")] * 3
    want = plain_repair(rows)
    got = conversations.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_repaired_rows_are_what_the_digest_covers(spark):
    rows = one_null_conversation(random_rows(60, 4))
    damaged = conversations.damage(spark.createDataFrame(rows, SCHEMA))
    summary = conversations.diagnose(damaged)
    texts = defaultdict(list)
    for r in sorted(conversations.repair(damaged, summary).collect(), key=lambda r: r.place):
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    for r in conversations.repair_digest(damaged, summary).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(texts[r.conv_id]).encode()).hexdigest()
        assert len(texts[r.conv_id]) == len(r.audit) - r.audit.count("D")


def test_long_conversation_in_many_pieces(spark):
    """A conversation of 20,000 rows lies in many tasks; kept, dropped and repeated rows add up, and the pieces' edits are those of one piece."""
    rows = [(5, t, "user" if t % 2 else "assistant", f"Row {t}.") for t in range(20_000)] + [(6, 0, "user", "One."), (6, 1, "assistant", "Two.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.conv_id: r for r in conversations.damaged_and_repaired(df).collect()}
    damaged = [r for r in plain_damage(rows) if r[0] == 5]
    faults = plain_faults(damaged)
    cells = [conversations._inserted({0: (0, "")})]
    for (_, _, role, _), fault in zip(damaged, faults):
        letter = "x" if fault in ("blank", "duplicate") else role[0]
        cells = [conversations._after(c, letter.upper() if fault == "truncated" else letter) for c in cells]
    assert (got[5].cost, got[5].audit) == min(cells[0][s] for s in (0, 3) if s in cells[0])
    assert got[5].gaps == damaged[-1][1] - damaged[0][1] + 1 - len({r[1] for r in damaged})
    assert (got[5].blank, got[5].duplicate, got[5].truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))


def test_repair_of_nothing_and_of_other_columns(spark):
    assert conversations.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hello.", "x", 3)], SCHEMA + ", audit string, copies int")
    row = conversations.damaged_and_repaired(df).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


TEXTS = [None, "", " ", "a", "<P>", "x <S> y", "<M", "<", "a<", "<P", "S>", "aé\U0001f600b c\n\n d", "one two  three\tfour " * 9, "< P>" * 20, "w" * 5000 + " \x0b" + "v" * 70_000, "    x", "<<P" * 7]


def plain_infill(doc, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    return n, form, a, b - a, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), words(p), words(m)


def test_infill_against_plain_slices(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, output string").repartition(3)
    got = infill.infill_digest(df).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *plain_infill(i, t)) for i, t in rows), key=key)
    assert infill.infill_digest(df.limit(0)).collect() == []


def test_infill_of_runs(spark):
    """In units of runs each cut is between a word and a space; the sentinels' characters in a text don't confuse the way back."""
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "P", "S", "M", ">", " ", "\n", "ab", "é"]) for _ in range(rng.randrange(1, 30)))
        runs = re.findall(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", text)
        h = [rng.randrange(1 << 32) for _ in range(4)]
        n, form, output, a, m, wa, wm = infill.cut(text, h, "run")
        assert n == len(runs) and infill.joined(output, form) == text
        if form != "plain":
            lo, hi = sorted(x % (n + 1) for x in h[:2])
            assert (a, m) == (len("".join(runs[:lo])), len("".join(runs[lo:hi])))
            assert (wa, wm) == tuple(sum(not r.isspace() for r in part) for part in (runs[:lo], runs[lo:hi]))
        n, form, output, *_ = infill.cut(text, h)
        assert n == len(text) and infill.joined(output, form) == text
    with pytest.raises(ValueError):
        infill.transform(spark.createDataFrame([], "doc_id long, text string"), "line")
