"""Cases that the text operators must take: short, repeated and long texts, ids that are null or repeated, failing reads; and models against slow versions."""

import collections
import hashlib
import math
import os
import random
import re
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import bpe, common, decontaminate, grammar, language, linear, media, quality, repeats, similar, simhash, substring, suffixes, toxicity
from factorloom.llm.fmindex import FMIndex

SPACES = rb"[^\x20\x09-\x0D]+"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("texts", [["two words"] * 6, ["one and the same text of a few words"] * 40_000, [None] * 9, [""] * 9, ["a b c d", "x", None, ""]])
def test_quality_of_short_and_equal_texts(spark, texts):
    """Runs of texts below five words, and one text for all rows, are trained on and scored; all rows get a score, equal texts the same."""
    docs = frame(spark, list(enumerate(texts)))
    rows = quality.score(docs, quality.train(docs)).collect()
    assert len(rows) == len(texts)
    assert len({(r.text, r.score, r.kept) for r in rows}) == len(set(texts))
    assert all(0 <= r.score <= 1 for r in rows)


def test_samples_are_bounded_and_do_not_depend_on_rows(spark):
    texts = [f"text {i} " + "w " * (i % 50) for i in range(500)]
    docs = frame(spark, [(i % 7, t) for i, t in enumerate(texts * 3)]).select("text")
    small = linear.sampled(docs, 40)
    assert small.num_rows == 40 and small["text"].to_pylist() == linear.sampled(docs.orderBy("text").dropDuplicates(), 40)["text"].to_pylist()
    few = linear.sampled(docs, 400, 2000)
    assert 0 < sum(map(len, few["text"].to_pylist())) <= 2000
    assert linear.sampled(docs, 1000).num_rows == 500
    assert linear.sampled(docs.limit(0), 10).num_rows == 0
    assert linear.sampled(docs.where("text is not null"), 10, 16).num_rows == 0  # no text is small enough


def test_ftrl_against_a_plain_version():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 64, 6)) for _ in range(200)]
    labels = (np.array([int(3 in r or 7 in r) for r in rows])).astype(float)
    model = linear.FTRL(bits=6, alpha=0.5, l1=0.3).fit(rows, labels, epochs=2, positive_weight=2.0)
    z, n, bz, bn = collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.3 else -(z[i] - math.copysign(0.3, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + 1.0)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            own = {int(i): weight(int(i)) for i in rows[k]}
            bias = -bz / ((1.0 + math.sqrt(bn)) / 0.5)
            g = (1 / (1 + math.exp(-(sum(own.values()) + bias))) - labels[k]) * (2.0 if labels[k] > 0.5 else 1.0)
            for i, w in own.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w
                n[i] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / 0.5 * bias
            bn += g * g
    at, weights, bias = model.compact()
    assert set(at.tolist()) == {i for i in range(64) if weight(i)}
    np.testing.assert_allclose(weights, [weight(i) for i in at.tolist()], rtol=1e-5)
    scores = linear.Scorer(at, weights, bias, bits=6)(np.concatenate(rows + rows[:1]), np.repeat(np.arange(201), [len(r) for r in rows + rows[:1]]), 201)
    want = [1 / (1 + math.exp(-(sum(weight(int(i)) for i in r) + bias))) for r in rows + rows[:1]]
    np.testing.assert_allclose(scores, want, rtol=1e-4)


def test_labellers_against_plain_expectation_maximisation():
    rng = np.random.default_rng(2)
    good = rng.random(400) < 0.7
    m = len(quality.NAMES)
    v = np.where(rng.random((400, m)) < 0.3, 1, np.where(good[:, None], np.where(rng.random((400, m)) < 0.002, 0, 2), np.where(rng.random((400, m)) < 0.6, 0, 2)))
    codes, counts = np.unique((v * 3 ** np.arange(m)).sum(axis=1), return_counts=True)
    prior, shares = quality.fit_labellers(codes, counts)
    p = {}
    kinds = [[int(c) // 3**j % 3 for j in range(m)] for c in codes]
    for c, k in zip(codes, kinds):
        votes = [x - 1 for x in k]
        p[c] = min(max(0.5 + 0.5 * sum(votes) / max(sum(x != 0 for x in votes), 1) - 0.4 * (0 in k), 0.01), 0.99)
    for _ in range(quality.EM_ROUNDS):
        table = [[[0.1] * 3 for _ in range(m)] for _ in range(2)]
        for c, k, n in zip(codes, kinds, counts):
            for j, x in enumerate(k):
                table[0][j][x] += (1 - p[c]) * n
                table[1][j][x] += p[c] * n
        table = [[[x / sum(row) for x in row] for row in side] for side in table]
        for row in table[1]:
            row[0] = min(row[0], quality.MOST_FALSE_LOW)
            total = sum(row)
            row[:] = [x / total for x in row]
        share = min(max(sum(p[c] * n for c, n in zip(codes, counts)) / counts.sum(), 0.01), 0.99)
        for c, k in zip(codes, kinds):
            x = math.log(share / (1 - share)) + sum(math.log(table[1][j][y] / table[0][j][y]) for j, y in enumerate(k) if y != 1)
            p[c] = 1 / (1 + math.exp(-min(max(x, -35), 35)))
    assert abs(prior - share) < 1e-9
    np.testing.assert_allclose(shares, table, atol=1e-9)
    assert np.mean((np.array([p[c] for c in (v * 3 ** np.arange(m)).sum(axis=1)]) > 0.5) == good) > 0.97


def test_kneser_ney_against_plain_counts():
    data = np.frombuffer("der die das und der hund".encode(), np.uint8)
    g, _, _ = language.grams(data, np.array([0, len(data)]))
    model = language.KneserNey(*np.unique(g, return_counts=True))
    bits = language.CODE_BITS
    split = lambda x, k: tuple(int(x) >> bits * i & (1 << bits) - 1 for i in range(k - 1, -1, -1))
    tables = {5: collections.Counter(split(x, 5) for x in g)}
    for k in range(4, 0, -1):  # kinds of characters before
        tables[k] = collections.Counter(x[1:] for x in tables[k + 1])

    def probability(x, k):
        if not k:
            return 1 / (1 << bits)
        t = tables[k]
        n1, n2 = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = {y: v for y, v in t.items() if y[:-1] == x[:-1]}
        lower = probability(x[1:], k - 1)
        return (max(t[x] - d, 0) + d * len(same) * lower) / sum(same.values()) if same else lower

    some = np.concatenate([g, g[::3] ^ 3, g[::4] ^ (1 << 30)])
    np.testing.assert_allclose(2.0 ** model.log_probability(some), [probability(split(x, 5), 5) for x in some], rtol=1e-9)


def test_near_duplicates_are_known_by_id_and_text(spark):
    a = " ".join(f"a{i}" for i in range(50))
    b = " ".join(f"b{i}" for i in range(50))
    rows = [(0, a, 1), (1, a, 2), (1, b, 3), (1, b, 4), (None, a, 5), (None, "only here " * 20, 6), (7, None, 7), (8, "", 8)]
    docs = frame(spark, rows, "doc_id long, text string, _identity int")
    for one in (similar.one_of_each, simhash.one_of_each):
        out = one(docs)
        assert out.schema == docs.schema
        got = collections.Counter((r.doc_id, r.text) for r in out.collect())
        assert got == collections.Counter([(0, a), (1, b), (None, "only here " * 20), (7, None)]), one
        assert one(docs.limit(0)).count() == 0


def test_hub_of_a_near_duplicate_key(spark):
    """Copies that are like the original but not like each other are one group with it."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for k in range(40):
        w = list(base)
        for j in rng.sample(range(300), 5):
            w[j] = f"n{k}x{j}"
        texts.append(" ".join(w))
    out = similar.one_of_each(frame(spark, [(100 - i, t) for i, t in enumerate(texts)])).collect()
    assert [r.doc_id for r in out] == [60]


@pytest.mark.parametrize("distance", [1, 2, 4, 7])
def test_near_fingerprints(spark, distance):
    """All pairs within the distance; under crowded keys some of them, and none that is farther apart."""
    rng = random.Random(distance)
    fps = {-1, 0, -(1 << 63)}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(20):
            for bit in rng.sample(range(64), rng.randint(0, distance + 1)):
                f ^= 1 << bit
            fps.add((f ^ (1 << 63)) - (1 << 63))
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    table = frame(spark, [(f,) for f in fps], "fp long")
    assert collections.Counter(tuple(r) for r in simhash.near(table, distance, 1000).collect()) == collections.Counter(want)
    some = {tuple(r) for r in simhash.near(table, distance, 1).collect()}
    assert some and some <= want


def test_near_duplicates_are_linked_by_fingerprints(spark, monkeypatch):
    """The pipeline's stage has its links within the fingerprints' distance from SimHash, the others from the prefixes."""
    import corpus_pipeline

    rng = random.Random(22)
    texts = ["", "one two"]
    for k in range(10):
        w = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for _ in range(5):
            texts.append(" ".join(w))
            w = list(w)
            w[rng.randrange(300)] = f"n{k}x{len(texts)}"
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    data, offsets = common.text_bytes(pa.array(texts))
    values, size = similar.shingle_sets(data, offsets)
    sets = np.split(values, np.cumsum(size)[:-1])
    fps = simhash.fingerprints_of([s.tolist() for s in sets]).tolist()
    node = similar.nodes_of(values, size).tolist()
    ones = {f: min(n for n, g in zip(node, fps) if g == f) for f in fps}
    like, near = set(), set()
    for i in range(len(texts)):
        for j in range(len(texts)):
            common_part = len(np.intersect1d(sets[i], sets[j]))
            if node[i] < node[j] and 5 * common_part >= 4 * len(np.union1d(sets[i], sets[j])):
                like.add((node[i], node[j]))
                # one set of each fingerprint is compared with those of other fingerprints
                if ones[fps[i]] == node[i] and (fps[i] == fps[j] or ones[fps[j]] == node[j]) and (fps[i] ^ fps[j]).bit_count() <= similar.DISTANCE:
                    near.add((node[i], node[j]))
    assert 20 < len(near) < len(like)
    rows = common.materialise(similar.described(docs), "described")
    assert {tuple(r) for r in similar.fingerprint_links(rows, docs).collect()} == near

    def first_ones(pairs):
        parent = {n: n for n in node}
        for a, b in list(pairs) * len(node):
            parent[a] = parent[b] = min(parent[a], parent[b])
        return sorted({p: i for i, p in reversed(list(enumerate(parent[n] for n in node)))}.values())

    stage = lambda: sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert stage() == first_ones(like)
    prefixes = similar.prefixes
    monkeypatch.setattr(similar, "prefixes", lambda *args: prefixes(*args).where("false"))
    assert stage() == first_ones(near)


@pytest.mark.parametrize("ids", [(1, 2), (None, None), (5, 5)])
def test_shared_passage_stays_once(spark, ids):
    """Texts without an id, or of one id, that share a passage at the same place: one of them keeps it."""
    common_part = " ".join(f"c{i}" for i in range(80))
    docs = frame(spark, [(ids[0], common_part + " x y"), (ids[1], common_part + " z")])
    assert sorted(r.n_removed for r in suffixes.repeated_passages(docs).collect()) == [0, 80]
    assert sorted(r.n_removed for r in substring.substring_dedup(docs).collect()) == [80, 80]


def test_repeated_rows_cost_no_more_than_their_number(spark):
    one, other = " ".join(f"c{i}" for i in range(120)), " ".join(f"c{i}" for i in range(90)) + " other words"
    docs = frame(spark, [(None, one)] * 300 + [(3, other)])
    texts = repeats.keyed(docs)
    assert repeats.repeated(texts, 35, substring.fm_groups, keep_first=False).count() == 2
    with common.stage_folder(spark, "own") as folder:
        rows = substring.substring_dedup(docs).collect()
        left = os.listdir(folder.removeprefix("file://"))
    assert collections.Counter(r.n_removed for r in rows) == {120: 300, 90: 1}
    assert len(left) == 2  # the tables that the result is read from; the others are deleted
    kept = suffixes.repeated_passages(docs).collect()
    assert collections.Counter(r.n_removed for r in kept) == {0: 300, 90: 1}


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(12):
        most, sigma = int(rng.integers(1, 7)), int(rng.integers(2, 5))
        parts = [rng.integers(1, sigma, rng.integers(0, 25)) for _ in range(rng.integers(1, 12))]
        text = np.concatenate([np.concatenate([p, [0]]) for p in parts]).astype(np.int64)
        size = np.array([len(p) for p in parts])
        index = FMIndex(text, sigma)
        length, row = index.matching_statistics(text, np.cumsum(size + 1) - size - 1, size, most)
        t = text.tolist()
        for i, x in enumerate(t):
            if x:
                runs = [n for n in range(1, most + 1) if i + n <= len(t) and 0 not in t[i : i + n] and sum(t[j : j + n] == t[i : i + n] for j in range(len(t))) > 1]
                assert length[i] == max(runs, default=0)
                if length[i] == most:
                    assert row[i] == index.search(np.array([t[i : i + most]]), np.array([most]))[0][0]


def test_media_forms_and_failing_reads(spark, tmp_path):
    texts = ["", "some text", None, "ünïcode " * 500, "x" * 64]
    docs = frame(spark, list(enumerate(texts)))
    for r in media.media_digest(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        form = media.encode_png(raw)
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        share = np.bincount(np.frombuffer(padded, np.uint8), minlength=256) / len(padded)
        mean = sum(i * s for i, s in enumerate(share))
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        assert r.feature.startswith(f"mean={mean:.4f};sd={math.sqrt(sum(s * (i - mean) ** 2 for i, s in enumerate(share))):.4f};entropy={abs(-sum(s * math.log2(s) for s in share if s)):.4f};") or "-0.0000" in r.feature

    class Flaky:
        """Fails on each second read."""

        def __init__(self, data):
            self.data, self.n = data, 0

        def read_at(self, n, at):
            self.n += 1
            if self.n % 2:
                raise OSError("lost")
            return self.data[at : at + n]

    good = b"PK\x03\x04" + bytes(22) + (1).to_bytes(2, "little") + (0).to_bytes(2, "little") + b"n" + b"payload"
    crc = zlib.crc32(b"payload")
    flaky = Flaky(good)
    with pytest.raises(OSError):
        media.ArchiveReader.member(flaky, b"", 0, 0, 7, crc)  # the head is read, its payload never
    flaky.read_at = lambda n, at: good[at : at + n]
    assert media.ArchiveReader.member(flaky, b"", 0, 0, 7, crc) == b"payload"
    reader = media.ArchiveReader([], None, 10)
    reader.paths = []
    assert reader.partitions()[0].ranges == []


def test_benchmark_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    items = [" ".join(f"q{k}w{i}" for i in range(14)) for k in range(9)]
    docs = frame(spark, [(k, f"before {t} after") for k, t in enumerate(items)] + [(99, "nothing of it")])
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(decontaminate.write_blocks(spark.createDataFrame(list(enumerate(items)), "item_id long, text string").repartition(9))) > 2
    assert all(rows[k].n_hit == 14 and rows[k].n_items == 1 and rows[k].contaminated for k in range(9)) and not rows[99].n_hit


def test_grammar_runs_until_no_pair_pays():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 500, 400)
    tokens = np.concatenate([np.concatenate([rng.integers(0, 500, 50), passage]) for _ in range(6)]).astype(np.int32)
    left, right, seq, ends = grammar.repair(tokens, np.array([len(tokens)]), 500)
    counts = collections.Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
    assert max(v for (a, b), v in counts.items() if a != b) < grammar.LEAST_COUNT
    assert grammar.expansion_lengths(left, right, 500).max() > 64
    shard = grammar.Shard(grammar.pack(pa.array([1]), tokens, np.array([len(tokens)]), 500))
    assert shard.document(0).tolist() == tokens.tolist()


def test_tokenizers_on_odd_texts():
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(3)
    parts = list("ab Z9 \n\t.,!?;:'\"-é日 ß") + ["  ", "\n\n", " \n", "\r\n", "　", "\xa0", "\x85", "'s", "'ll", "<|endoftext|>", "\x1c", "—", "“", "…", "🙂", "́", "²", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    ids, ends = bpe.rank_bpe(path, P.PATTERN).encode_column(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [encoding.encode_ordinary(t) for t in texts]
    path = P.path("byte_bpe_50k.json")
    assert [x.tolist() for x in grammar.library_bpe(path).encode(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_very_long_text(spark):
    """A text beyond any chunk goes through the operators whole."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(900)]
    long = " ".join(rng.choice(vocab) for _ in range(120_000))
    passage = " ".join(long.split()[70_000:70_060])
    docs = frame(spark, [(1, long), (2, "short one " + passage), (3, None)])
    words = re.findall(SPACES, long.encode())
    by = {r.doc_id: r for r in substring.substring_dedup(docs).collect()}
    assert by[1].n_words == len(words) and by[2].n_removed == 60 and by[1].n_removed >= 60 and by[3].n_words == 0
    assert {r.doc_id: r.n_bytes for r in media.media_digest(docs).collect()} == {1: len(long), 2: len("short one " + passage), 3: 0}
    assert simhash.near_duplicates(docs).count() == 3 and similar.one_of_each(docs).count() == 3
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 3


def test_shared_folder(spark):
    root = common.shared_root(spark)
    assert "://" in root
    df = common.materialise(spark.range(3), "t")
    assert df.count() == 3
    common.discard(df)
    exists = lambda t: os.path.exists(t.scratch_folder.removeprefix("file://"))
    assert not exists(df)
    before = common.materialise(spark.range(5), "before")
    with common.stage_folder(spark, "stage") as folder:
        a = common.materialise(spark.range(2), "a")
        b = common.materialise(a, "b", path=common.shared_root(spark) + "/kept-by-the-test")
        with ThreadPoolExecutor(1) as pool:  # another caller, at the same time
            other = pool.submit(lambda: common.materialise(spark.range(4), "other")).result()
        assert a.scratch_folder.startswith(folder) and not other.scratch_folder.startswith(folder)
    assert not exists(a) and b.count() == 2 and other.count() == 4 and before.count() == 5
    with pytest.raises(ZeroDivisionError), common.stage_folder(spark, "stage"):
        a = common.materialise(spark.range(2), "a")
        raise ZeroDivisionError
    assert not exists(a) and common.materialise(spark.range(1), "after").scratch_folder.startswith(root)
    common.discard(b)
