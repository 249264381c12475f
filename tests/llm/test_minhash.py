"""MinHash near duplicates against all pairs, and the sketches' properties."""

import random
import re

import numpy as np
import pytest

from factorloom.llm import minhash, similar


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(zip(words, words[1:], words[2:])) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(a & b) >= 85 * len(a | b):
                parent[root(a)] = root(b)
    least = {}
    for (doc, _), s in zip(rows, sets):
        if s and doc is not None:
            least[root(s)] = min(doc, least.get(root(s), doc))
    out = []
    for (doc, _), s in zip(rows, sets):
        component = least.get(root(s)) if s else doc
        out.append((doc, len(s), component, doc == component))
    return out


def corpus(seed, n_base=40, vocabulary=400):
    """Random texts with copies in which some words are changed, so that similarities lie on both sides of the bound."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_base):
        words = [f"W{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 2, 3, 8, 40, 120, 400]))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            other = list(words)
            for _ in range(rng.randrange(1 + len(words) // 25) if len(words) > 8 else rng.randrange(2)):
                other[rng.randrange(len(other))] = f"w{rng.randrange(vocabulary)}"
            out.append(rng.choice(["  ", " ", "\n"]).join(other).swapcase())
    return out


SCHEMA = "doc_id long, text string"
key = lambda r: tuple((x is None, x) for x in r)


def check(spark, rows):
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("bucket", [8, 2])
def test_near_duplicates_against_all_pairs(spark, bucket, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    texts = corpus(bucket) + [None, "", " \t", "a", "A ", "a b", "b a", "a b c", "é É", "é é"] * 2
    ids = random.Random(1).sample(range(10_000), len(texts))
    check(spark, [(i if k % 37 else None, t) for k, (i, t) in enumerate(zip(ids, texts))] + [(3, "same row"), (3, "same row"), (3, "another text of that id")])


def test_crowded_keys_of_copies_and_of_texts_that_share_a_passage(spark, monkeypatch):
    """Groups of copies, chains of copies, and texts that are alike but not enough, under the same keys."""
    monkeypatch.setattr(minhash, "BUCKET", 4)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(60):  # copies of one text, most of them less like each other than like it
        other = list(base)
        for _ in range(3):
            other[rng.randrange(150)] = f"x{i}_{rng.randrange(99)}"
        texts.append(" ".join(other))
    for i in range(60):  # a shared passage and an own one: similarity 0.6 to 0.9
        texts.append(" ".join([f"p{k}" for k in range(100)] + [f"q{i}_{k}" for k in range(rng.randrange(4, 26))]))
    drifting = [f"d{i}" for i in range(120)]
    for i in range(25):  # a chain
        drifting[5 * i % 120] = f"e{i}"
        texts.append(" ".join(drifting))
    check(spark, list(enumerate(texts)))


def test_sketch_against_a_plain_one_and_its_estimates():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) for n in (1, 2, 7, 100, 3000, 0)]
    got = minhash.sketches(np.concatenate(sets), np.array([len(s) for s in sets]), 16)
    for s, row in zip(sets, got):
        want = [None] * 16
        for i in range(32):
            for x in s.tolist():
                h = int(minhash.mix(np.array([x], np.uint64) ^ minhash.mix(np.full(1, i + 1, np.uint64) * minhash._ROUND))[0])
                at = h >> 60 if i < 16 else i - 16
                value = i << 55 | h % (1 << 55)
                want[at] = value if want[at] is None else min(want[at], value)
            if None not in want:
                break
        assert [None if x == minhash._EMPTY else int(x) for x in row] == want
    whole = rng.integers(0, 1 << 63, 40_000, dtype=np.int64).astype(np.uint64)
    for n, common in ((2000, 1700), (60, 51), (30, 3)):
        agree, apart, met = [], [], []
        for k in range(150):
            x = whole[rng.permutation(len(whole))[:n]]
            made = minhash.sketches(np.concatenate([x, x[n - common :]]), np.array([n, common]))
            agree.append((made[0] == made[1]).mean())
            m = minhash.marks(made).view(np.uint8)
            apart.append(sum((m[0] ^ m[1]) & 15 != 0) + sum((m[0] ^ m[1]) >> 4 != 0))
            met.append((minhash.band_keys(made)[0] == minhash.band_keys(made)[1]).any())
        assert abs(np.mean(agree) - common / n) < 0.02 and np.std(agree) < 0.05
        assert all(a <= round(128 * (1 - g)) for a, g in zip(apart, agree))
        if common / n > 0.8:
            assert all(met) and max(apart) <= minhash.MOST_APART


def test_no_links_between_texts_without_words_and_empty_tables(spark):
    check(spark, [(2, ""), (1, None), (3, " "), (None, None), (None, ""), (4, "x y"), (5, "X  y"), (None, "x Y")])
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    wide = spark.createDataFrame([(1, "a b c", 5, "n")], SCHEMA + ", node long, kept string")
    assert minhash.near_duplicates(wide).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_sets_are_of_words_as_they_are_asked_for(spark):
    data = np.frombuffer(b"one Two three Two three one Two three", np.uint8)
    values, size = similar.shingle_sets(data, np.array([0, len(data)]), 3)
    assert size.tolist() == [len(shingles(data.tobytes().decode()))]
