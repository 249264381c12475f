"""The text operators against brute force, on a table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from factorloom.llm import bpe, common, decontaminate, grammar, language, media, quality, repeats, simhash, similar, substring, suffixes, toxicity
from factorloom.llm.fmindex import FMIndex, suffix_array

SPACES = rb"[^\x20\x09-\x0D]+"
ITEM_WORDS = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage, item = say(120), say(60), say(20)
    line = " ".join(vocab[:9])
    texts = [base, base, base + " End", say(60) + " " + passage + " " + say(30), passage + "\n" + say(40), say(10) + "  " + passage, None, "", "   \n\t", "one", "Two words", "x " * 300, say(9000),
             f"{say(5)} {item.upper()}, {say(5)}", say(400) + " " + item, "!!! ??? 123", "日本語 テキスト です", "a b　c\x1cd", "<|endoftext|> here", line + " " + say(50), line + " " + say(60), line + " " + say(70)]
    for i in range(30):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    out = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", 7 if t is None else len(t), i) for i, t in enumerate(texts)]
    return out + [out[0], (None, "no id here at all", "en", "s", 1, 0), (None, base, "en", "s", 1, 0)], item


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint int"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows[0], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_media(spark, docs, rows, empty):
    got = multiset(media.media_digest(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = collections.Counter()
    for i, t, *_ in rows[0]:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == want
    assert media.media_digest(empty).count() == 0


def test_media_ranges_and_retry(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/m"
    media.write_archives(docs, folder)
    spark.dataSource.register(media.MediaArchive)
    small = spark.read.format("media_archive").option("paths", folder).option("range_bytes", "500").load()
    assert small.rdd.getNumPartitions() > 3
    assert multiset(small, "media") == multiset(media.read_archives(spark, folder), "media")
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(b"abc")[:-14] + b"x" * 14)

    class File:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    good = b"PK\x03\x04" + bytes(22) + (1).to_bytes(2, "little") + (0).to_bytes(2, "little") + b"n" + b"payload"
    bad = good.replace(b"payload", b"paXload")
    assert media.ArchiveReader.member(File(good), bad, 0, 0, 7, zlib.crc32(b"payload")) == b"payload"
    with pytest.raises(OSError):
        media.ArchiveReader.member(File(bad), bad, 0, 0, 7, zlib.crc32(b"payload"))


def brute_fingerprint(t):
    w = re.findall(SPACES, lower((t or "").encode()))
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(fps))]


def test_simhash(docs, rows, empty):
    got = multiset(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    fps = [brute_fingerprint(r[1]) for r in rows[0]]
    roots = brute_components(fps)
    least = {}
    for r, c in zip(rows[0], roots):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    assert got == collections.Counter((r[0], f"{f:016x}", least.get(c)) for r, f, c in zip(rows[0], fps, roots))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(least.values())


@pytest.mark.parametrize("bucket", [2, 32])
def test_near_duplicates_stage(spark, monkeypatch, bucket):
    """The pipeline's stage keeps one of each group of 5-word similarity 0.8, however many bits the fingerprints differ in."""
    import corpus_pipeline

    monkeypatch.setattr(similar, "BUCKET", bucket)
    monkeypatch.setattr(similar, "PIVOTS", 1)
    rng = random.Random(bucket)
    texts = []
    for _ in range(12):
        w = [f"w{rng.randrange(5000)}" for _ in range(80)]
        for _ in range(6):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(5000)}"
    line = " ".join(f"c{i}" for i in range(60))
    texts += [line + " " + " ".join(f"t{i}x{j}" for j in range(n)) for i in range(12) for n in (6, 9)] + ["", None, "one", "One"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    far = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 5 * both >= 4 * len(sets[a] | sets[b]):
            far += (brute_fingerprint(texts[a]) ^ brute_fingerprint(texts[b])).bit_count() > 2
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert far > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {root(x) for x in range(len(texts))}


@pytest.mark.parametrize("bucket", [1, 32])
def test_simhash_links(spark, monkeypatch, bucket):
    """Chains, stars and crowded keys: the components are those of all pairs."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    fps = set()
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(60):
            fps.add(f)
            f ^= 1 << rng.randrange(64)
            f ^= (1 << rng.randrange(64)) * (rng.random() < 0.6)
            f ^= (1 << rng.randrange(64)) * (rng.random() < 0.1)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    labels = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    roots = brute_components(fps)
    want = collections.defaultdict(set)
    for f, c in zip(signed, roots):
        want[c].add(f)
    have = collections.defaultdict(set)
    for f in signed:
        have[labels.get(f, f)].add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def brute_windows(rows, width, first):
    texts = [re.findall(SPACES, (t or "").encode()) for _, t, *_ in rows]
    seen = collections.defaultdict(list)
    for n, (r, w) in enumerate(zip(rows, texts)):
        for s in range(len(w) - width + 1):
            seen[tuple(w[s : s + width])].append(((-1 if r[0] is None else r[0], r[1], s), n, s))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            least = min(p[0] for p in places)
            for key, n, s in places:
                if not first or (key[0], key[2]) != (least[0], least[2]):
                    gone[n].update(range(s, s + width))
    return texts, gone


@pytest.mark.parametrize("hot", [0, 1000])
@pytest.mark.parametrize("run, width, first", [(substring.substring_dedup, 35, False), (suffixes.repeated_passages, 50, True)])
def test_repeats(docs, rows, empty, monkeypatch, hot, run, width, first):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts, gone = brute_windows(rows[0], width, first)
    want = collections.Counter((r[0], len(w), len(g), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in g)).hexdigest()) for r, w, g in zip(rows[0], texts, gone))
    assert multiset(run(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert run(empty).count() == 0


def test_remove_repeats(docs, rows):
    texts, gone = brute_windows(rows[0], 50, True)
    out = suffixes.remove_repeats(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = collections.Counter((r.doc_id, tuple((r.text or "").split())) for r in out.collect())
    # white space beyond ASCII is part of words here, so compare by ASCII words
    got = collections.Counter((r.doc_id, tuple(re.findall(SPACES, (r.text or "").encode()))) for r in out.collect())
    assert got == collections.Counter((r[0], tuple(x for i, x in enumerate(w) if i not in g)) for r, w, g in zip(rows[0], texts, gone))
    assert suffixes.cut_text("a  b\nc d", [(1, 2)]) == "a  c d"


def test_decontamination(spark, docs, rows, empty):
    item = rows[1]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Two words"), (5, item), (None, "one")], "item_id long, text string")
    words = lambda t: re.findall(ITEM_WORDS, lower((t or "").encode()))
    windows = collections.defaultdict(set)
    for r in bench.collect():
        w = words(r.text)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[s : s + 13])].add("" if r.item_id is None else str(r.item_id))
    want = collections.Counter()
    for i, t, *_ in rows[0]:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    ids |= found
        want[i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    out = decontaminate.contamination(docs, bench)
    assert multiset(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert sum(v for k, v in want.items() if k[5]) >= 2
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.schema == docs.schema and kept.count() == sum(v for k, v in want.items() if not k[5])
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_fm_index():
    rng = np.random.default_rng(3)
    for n, sigma in ((1, 3), (50, 3), (400, 5)):
        text = rng.integers(0, sigma, n)
        assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        index = FMIndex(text, sigma)
        for width in (1, 2, 3):
            for p in itertools.product(range(1, sigma), repeat=width):
                lo, hi = index.search(np.array([p]), np.array([width]))
                want = [i for i in range(n - width + 1) if tuple(text[i : i + width]) == p]
                assert hi[0] - lo[0] == len(want)
                assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_bpe(docs, rows, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.rank_bpe(path, P.PATTERN)
    for t in ["a  b\n\n c \t d", "it's 'tis 12 345", "\n \nfoo   ", "🙂🙂 a", "a" * 300, "ab" * 99 + " " * 50, "foo \nbar\x85 \xa0 baz ", "  x", "x\n y"]:
        assert own.encode(t).tolist() == encoding.encode_ordinary(t), t
        assert own.decode(own.encode(t).tolist()) == t.encode()
    want = collections.Counter()
    for i, t, *_ in rows[0]:
        ids = encoding.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert multiset(bpe.token_digest(docs, path, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.token_digest(empty, path, P.PATTERN).count() == 0
    assert bpe.encode_documents(docs, path, P.PATTERN).selectExpr("sum(size(ids))").first()[0] == sum(k[1] * v for k, v in want.items())


class Worker:
    """Stands for a DataFrame whose tasks all run here, as in one worker."""

    def __init__(self, *batches):
        self.batches, self.sparkSession, self.conf = batches, self, {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}

    def mapInArrow(self, run, schema):
        return list(run(iter(self.batches)))


def test_worker_keeps_one_operators_things(monkeypatch):
    path, kept, freed = P.path("byte_bpe_multi_50k.tiktoken"), bpe.rank_bpe.cache_info, []
    batch = pa.RecordBatch.from_pydict({"text": ["some text"]})
    monkeypatch.setattr(common, "give_back", lambda: freed.append(1), raising=False)

    def encode(batches):
        for b in batches:
            bpe.rank_bpe(path, P.PATTERN).encode_column(b["text"])
            yield b

    def other(batches):
        yield from batches

    encode.__module__, other.__module__ = bpe.__name__, similar.__name__
    for run, has in ((encode, 1), (encode, 1), (other, 0), (encode, 1)):
        assert common.arrow_map(Worker(batch, batch), run, "text string") == [batch, batch]
        assert kept().currsize == has
    assert len(freed) == 4  # once a task
    # of the same module's tasks nothing is made anew
    common.arrow_map(Worker(batch), other, "text string")
    common.arrow_map(Worker(batch), encode, "text string")
    before = kept().misses
    common.arrow_map(Worker(batch), encode, "text string")
    assert kept().misses == before


def test_driver_gives_back(spark, monkeypatch):
    freed = []
    monkeypatch.setattr(common, "give_back", lambda: freed.append(1), raising=False)
    common.discard(common.materialise(spark.range(3), "some"))
    assert freed


def test_token_shards(docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    own = grammar.library_bpe(path)
    for x in ["a  b\n\n c", "<|endoftext|> x<|endoftext|>", " \n", "é  ü", ""]:
        assert own.encode([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids
    manifest = grammar.write_shards(docs, path)
    got = grammar.read_shards(manifest).collect()
    want = collections.Counter()
    for i, x, *_ in rows[0]:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    assert grammar.read_shards(grammar.write_shards(empty, path)).count() == 0


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    for n, sigma in ((1, 2), (5000, 3), (20000, 300)):
        tokens = rng.integers(0, sigma, n).astype(np.int32)
        ends = np.unique(np.concatenate([rng.integers(1, n + 1, 20), [n]]))
        shard = grammar.Shard(grammar.pack(pa.array(range(len(ends))), tokens, ends, sigma))
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            assert shard.document(i).tolist() == tokens[a:b].tolist()
            mid = (b - a) // 2
            assert shard.tokens(i, mid, b - a).tolist() == tokens[a + mid : b].tolist()
            assert shard.tokens(i, 0, mid).tolist() == tokens[a : a + mid].tolist()
    assert len(grammar.repair(np.tile([1, 2, 3, 4], 500).astype(np.int32), np.array([2000]), 10)[2]) < 300


def _corpus(spark, n=400):
    rng = random.Random(2)
    tongue = {"en": "the and of ing tion er".split(), "de": "der und ung keit sch ß".split()}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        w = ["".join(rng.choice(tongue[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        bad = rng.random() < 0.3
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["awful", "rotten"])
        if i % 5 == 4:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w) + ".", lang, "s", 1, 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, empty):
    corpus, labels = _corpus(spark)
    model = toxicity.train(corpus, labels)
    out = {r.doc_id: r for r in toxicity.score(corpus, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in set(held)) for i in out)
    assert sum(out[i].predicted == truth[i] for i in held) / len(held) > 0.95
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert len(model[0]) < 5000


def test_language(spark, docs, empty):
    corpus, _ = _corpus(spark)
    out = {r.doc_id: r for r in language.identify(corpus).collect()}
    truth = {r.doc_id: r.lang for r in corpus.collect()}
    held = [i for i in out if out[i].held_out]
    assert held and sum(out[i].lang_pred == truth[i] for i in held) / len(held) > 0.98
    odd = language.identify(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in odd:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            t = texts[r.doc_id]
            assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_keeps_all_grams(spark, monkeypatch):
    """A language of very many n-grams that occur once is in the model; stored tables score as those in memory do."""
    monkeypatch.setattr(language, "BLOCK_GRAMS", 60_000, raising=False)
    monkeypatch.setattr(language, "HELD_BYTES", 1 << 20, raising=False)
    rng = np.random.default_rng(3)
    say = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 1500, n)))
    texts = [(i, say(30_000), "many") for i in range(30)] + [(100 + i, "the cat sat on a mat " * 20 + "abc"[i % 3], "few") for i in range(10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(4)
    out = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert out == {i: lang for i, _, lang in texts}
    counts = language.count_grams(docs)
    models = language.stored(counts)
    rows = counts.toPandas()
    assert (rows.lang == "many").sum() > 400_000
    for lang, own in rows.groupby("lang"):
        g = np.unique(np.concatenate([own.gram.to_numpy()[:2000], rows.gram.to_numpy()[-3000:], rng.integers(0, 1 << 60, 500)]))
        suffixes = [np.unique(g & ((1 << language.CODE_BITS * k) - 1), return_inverse=True) for k in range(1, language.ORDER + 1)]
        want = language.KneserNey(own.gram.to_numpy(), own.n.to_numpy()).log_probability(g)
        assert np.allclose(models[lang].log_probability(suffixes), want, rtol=0, atol=1e-9)


def test_kneser_ney_sums_to_one():
    data = np.frombuffer(b"abcabdabcabcabd", np.uint8)
    g, _, _ = language.grams(data, np.array([0, len(data)]))
    m = language.KneserNey(*np.unique(g, return_counts=True))
    context = int(g[7]) >> language.CODE_BITS << language.CODE_BITS
    p = 2 ** m.log_probability(context + np.arange(1 << language.CODE_BITS))
    assert abs(p.sum() - 1) < 1e-6


def test_quality(spark, docs, empty):
    corpus, _ = _corpus(spark)
    out = quality.score(corpus, quality.train(corpus)).collect()
    assert sum(r.kept == (r.doc_id % 5 == 4) for r in out) / len(out) < 0.02
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    assert len(quality.score(docs, quality.train(docs)).collect()) == docs.count()
    assert quality.keep_good(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    corpus, _ = _corpus(spark, 120)
    folder = str(tmp_path)
    extra = corpus.withColumn("doc_id", corpus.doc_id + 1000)
    corpus.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    first = corpus.first()
    spark.createDataFrame([("b", " ".join(first.text.split()[:14]))], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    want = {r.doc_id for r in corpus.collect() if r.doc_id % 5 != 4} - {first.doc_id}
    assert set(got) == want
