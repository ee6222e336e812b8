import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from edgeframe.llm import ans, bpe, bpecount, decontam, dedup, fingerprint, langid, licenses, packing, quality, sharding, textscan, tokenfiles, wordpiece
from edgeframe.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in a very old stone tower near the cold river bank"
LONG = " ".join(f"{BASE} {i}." for i in range(400))
ROWS = [
    (1, BASE, "en"), (2, BASE.upper(), "en"), (3, BASE + " today", "en"), (4, None, None), (5, "", "en"), (6, "  \n\t ", "en"), (7, "one two", "en"), (8, "one  TWO", "de"), (9, LONG, "en"),
    (10, "Dies ist ein ganz anderer Text über Häuser und Straßen, der nichts mit dem ersten zu tun hat.", "de"), (None, BASE, "en"), (None, None, None), (11, "Released under the MIT License. See the Apache License, Version 2.0, too: cc by", "en"), (12, "12 34 !!", "en"), (13, BASE, "en"), (13, BASE, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "s", 0, 0.5, 7) for i, t, lang in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_dedup(docs, empty):
    got = {}
    for r in dedup.near_duplicates(docs, 4).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(22, 1, True)] and got[2] == [(22, 1, False)] and got[3] == [(23, 1, False)] and got[13] == [(22, 1, False)] * 2
    assert got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)] and got[6] == [(0, 6, True)] and got[7] == [(1, 7, True)] and got[8] == [(1, 7, False)]
    assert all(c is None and kept for _, c, kept in got[None]) and len(got) == 14
    assert dedup.near_duplicates(empty, 4).count() == 0


def test_dedup_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in dedup.near_duplicates(df).collect()} == {i: find(i) for i in range(len(texts))}


def test_dedup_large_group(spark):
    """300 versions of one text, most of them apart from each other: far more components in a bucket than one."""
    rng = random.Random(0)
    texts = []
    for _ in range(300):
        copy = [f"w{i}" for i in range(120)]
        for p in rng.sample(range(120), rng.randint(2, 4)):
            copy[p] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i for i, c in _components(texts, 5).items() if got[i] != c} == set()


def _components(texts, k):
    """The smallest number of each text's component, by all pairs."""
    sets = [{tuple(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return dict(enumerate(root))


def test_dedup_short_texts(spark):
    """Pairs of 5 and 4 shingles: few enough for one shingle to fill many bins of the sketch."""
    texts = [" ".join(f"w{i}x{j}" for j in range(n)) for i in range(1000) for n in (8, 7)]
    got = dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()
    assert {r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2} == set()


def test_one_of_each(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (4, c + " more"), (5, ""), (5, a), (None, a), (None, None), (6, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    fours = [r for r in got if r[0] == 4]
    assert len(fours) == 1 and sorted(map(str, got)) == sorted(map(str, [(1, a), (2, b), (5, ""), (None, a), (None, None), (6, "one"), *fours]))


@pytest.mark.parametrize("n", [1, 2, 31, 64, 5000, 300_000])
def test_ans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 60_000).astype(np.uint32)
    freq, blocks = tokenfiles.pack_group(ids)
    assert (tokenfiles.unpack_group(freq, blocks) == ids).all()
    table = ans.Table.unpack(freq)
    n_segments = int(np.frombuffer(blocks[0], "<u4", 5)[4])
    parts = [ans.decode(blocks[0], table, s) for s in range(n_segments)]  # every checkpoint is a start
    assert (np.concatenate(parts) == ids[: ans.BLOCK]).all()
    broken = bytearray(blocks[0])
    broken[-1] ^= 1
    if n > 1000:
        with pytest.raises(ValueError):
            ans.decode(bytes(broken), table)


def test_ans_full_alphabet():
    ids = np.concatenate((np.arange(65536), np.zeros(100_000))).astype(np.uint32)
    assert (tokenfiles.unpack_group(*tokenfiles.pack_group(ids)) == ids).all()


def test_bpe_against_library():
    tok = bpe.load(tokenizer_path())
    rng = random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'ll", "1", "²", "½", "!", "漢字", "😀", "\x1c", "\x85", "_", " the", "'", "\r\n", "​", "　", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(400)]
    want = [np.array(tok.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tok.encode_all(texts) == want and tok.encode_all(["".join(texts)], 100) == [np.array(tok.tok.encode("".join(texts), add_special_tokens=False).ids, "<u4").tobytes()]


def test_token_files(spark, docs, empty, tmp_path):
    tokenfiles.write_token_files(docs, str(tmp_path / "f"), tokenizer_path())
    tok = bpe.load(tokenizer_path())
    at = 0
    rows = tokenfiles.read_token_index(spark, str(tmp_path / "f")).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (i, text, _), r in zip(order, rows, strict=True):
        ids = np.frombuffer(tok.encode(text or ""), "<u4").tolist() + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfiles.read_token_ids(spark, str(tmp_path / "f")).where("size(ids) = 1").count() == 3
    tokenfiles.write_token_files(empty, str(tmp_path / "e"), tokenizer_path())
    assert tokenfiles.read_token_index(spark, str(tmp_path / "e")).count() == 0


def prose(words, seed, signs=(" ", " ", " ", ". ", ".\n", ", ", "&&&\n")):
    """Words of four languages' letters, few of them twice, with marks and line ends between them."""
    rng = random.Random(seed)
    return "".join("".join(rng.choice("abdeghinorstuléüñç") for _ in range(rng.randint(1, 12))) + rng.choice(signs) for _ in range(words))


def test_lengths_without_ids(monkeypatch):
    """Plain prose is counted from its bytes: no ids of texts are made, and the library sees no piece twice."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = [prose(400, i) for i in range(40)]
    tok = Tokenizer.from_file(tokenizer_path())
    seen = []
    learn = bpecount.Counter._learn
    bpecount.load.cache_clear()
    monkeypatch.setattr(bpe.Bpe, "encode_all", None)
    monkeypatch.setattr(bpecount.Counter, "_learn", lambda self, pieces: (seen.extend(pieces), learn(self, pieces))[1])
    batches = (pa.RecordBatch.from_arrays([pa.array(range(i, i + 10)), pa.array(texts[i : i + 10])], ["doc_id", "text"]) for i in range(0, 40, 10))
    got = [n for b in packing._lengths(tokenizer_path())(batches) for n in b.column("length").to_pylist()]
    assert got == [len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert len(seen) == len(set(seen)) < sum(len(t.split()) for t in texts)


PARTS = ["'", "'s", "'re", "'ll", "'S", "'v", " ", "  ", "\n", "\r\n", "\t", "\xa0", "\x85", "\u2003", "\u3000", "\x1c", "\0", "a", "s", "B", "é", "e\u0301", "ß", "×", "ª", "²", "٣", "12", "!", "...", "€", "“", "—", "中文", "日本語のテキスト", "😀", "𝒳", "\U00020000", "<|endoftext|>", "<|endof", "antidisestablishmentarianism", "x" * 200, "word"]


@pytest.mark.parametrize("most", [20, 1_000_000])
def test_counts_against_library(most):
    """Odd texts in any slices; a table of 20 pieces starts anew again and again."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(tokenizer_path()), random.Random(most)
    counter = bpecount.Counter(tokenizer_path(), most)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [*PARTS, None, "", "don't we'll 's ''s 're x'", prose(3000, 1)]
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for size, longest in ((1, 10), (300, 100), (1 << 20, 1 << 22)):
        assert counter.counts(pa.array(texts), size, longest).tolist() == want
    assert counter.counts(pa.array(["x", *texts]).slice(1), 4096).tolist() == want
    assert counter.counts(pa.array([], pa.string())).tolist() == [] and counter.counts(pa.array([None], pa.string())).tolist() == [0]


def test_token_files_from_bytes(monkeypatch):
    """Plain prose is encoded from its bytes, not chunk by chunk, and the library sees no piece twice."""
    from types import SimpleNamespace

    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = [prose(400, i) for i in range(40)]
    tok = Tokenizer.from_file(tokenizer_path())
    seen = []
    learn = bpecount.Counter._learn
    monkeypatch.setattr(bpe.Bpe, "encode_all", None)
    monkeypatch.setattr(tokenfiles, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(bpecount.Counter, "_learn", lambda self, pieces: (seen.extend(pieces), learn(self, pieces))[1])
    batches = (pa.RecordBatch.from_arrays([pa.array(range(i, i + 10)), pa.array(texts[i : i + 10])], ["doc_id", "text"]) for i in range(0, 40, 10))
    want = [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    (row,) = [r for b in tokenfiles._writer(tokenizer_path(), 2)(batches) for r in b.to_pylist()]
    assert row["shard"] == 3 and row["lengths"] == [*map(len, want)] and tokenfiles.unpack_group(row["freq"], row["blocks"]).tolist() == sum(want, [])
    assert len(seen) == len(set(seen)) < sum(len(t.split()) for t in texts)


@pytest.mark.parametrize("most", [20, 1_000_000])
def test_encoder_against_library(most):
    """As the counts: odd texts in any slices; with 20 pieces the tables and the pool start anew again and again."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(tokenizer_path()), random.Random(most)
    encoder = bpecount.Encoder(tokenizer_path(), most)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [*PARTS, None, "", "don't we'll 's ''s 're x'", prose(3000, 1)]
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for size, longest in ((1, 10), (300, 100), (1 << 20, 1 << 22)):
        assert encoder.encode(pa.array(texts), size, longest) == want
    assert encoder.encode(pa.array(["x", *texts]).slice(1), 4096) == want
    assert encoder.encode(pa.array([], pa.string())) == [] and encoder.encode(pa.array([None], pa.string())) == [b""]
    assert encoder.used < 8 * most + 20_000


def test_packing(spark, docs, empty):
    lengths = np.random.default_rng(0).integers(1, 8192, 2000)
    where, offset, size = packing.best_fit(lengths)
    used = np.bincount(where, lengths)
    assert (used <= size).all() and used.sum() / size.sum() > 0.97
    assert all(min(c for c in packing.CAPACITIES if c >= u) == s for u, s in zip(used, size, strict=True))
    rows = packing.pack(spark.createDataFrame([(1, 20_000), (2, None), (None, 5), (3, 3), (3, 3)], "doc_id long, length long")).collect()
    assert sorted((r.length for r in rows if r.doc_id == 1), reverse=True) == [8192, 8192, 3616] and len(rows) == 7
    assert packing.pack(packing.token_lengths(docs, tokenizer_path())).count() >= len(ROWS) and packing.pack(packing.token_lengths(empty, tokenizer_path())).count() == 0


def test_fingerprints(docs, empty):
    rows = fingerprint.edited_fingerprints(docs.where("doc_id is not null and doc_id < 13"), 4).orderBy("doc_id").collect()
    texts = [t or "" for i, t, _ in ROWS if i is not None and i < 13]
    for i, r in enumerate(rows):
        n, after = len(texts[i]), texts[(i + 1) % len(texts)]
        edited = texts[i][: n - n // 4] + after[: n // 4]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest()) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[3].fingerprint == rows[4].fingerprint and rows[0].fingerprint != rows[1].fingerprint
    assert rows[8].near_edited > 0.5 > rows[8].near_next
    assert fingerprint.edited_fingerprints(docs).count() == len(ROWS) and fingerprint.edited_fingerprints(empty).count() == 0


@pytest.mark.parametrize("common,a,b", [(20, 0, 0), (20, 3, 2), (10, 40, 30), (0, 300, 5)])
def test_sketch_difference(spark, common, a, b):
    from pyspark.sql import functions as F

    rng = random.Random(common)
    keys = [rng.getrandbits(63) for _ in range(common + a + b)]
    df = spark.createDataFrame([(keys[: common + a], keys[:common] + keys[common + a :])], "a array<long>, b array<long>")
    first = fingerprint.subtract(fingerprint.sketch(F.col("a"), 1), fingerprint.sketch(F.col("b"), 1))
    assert df.select(fingerprint.differing(F.col("a"), F.col("b"), first)).first()[0] == a + b


def test_language(docs, empty):
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[4] == got[5] == got[12] == ("und", 0.0) and got[9][0] == "en" and got[10][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    assert langid.accept(docs, model).columns == docs.columns and langid.predict(empty, langid.learn(empty)).count() == 0


def test_language_sample(spark):
    """A language's n-grams come from at most ``sample`` rows, also where each has fewer than twice as many."""
    assert (langid.learn(spark.createDataFrame([(i, "abc", "en") for i in range(2)], "doc_id long, text string, lang string"), 1).masks == 0).all()


def test_wordpiece_against_greedy(docs, empty):
    pieces = set(wordpiece.byte_vocabulary(tokenizer_path()))
    for r in wordpiece.token_counts(docs.where("doc_id < 13 and doc_id <> 9"), tokenizer_path()).collect():
        raw = next(t or "" for i, t, _ in ROWS if i == r.doc_id).encode()
        n = 0
        start, end, _ = textscan.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), textscan.SPACE)
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            word = raw[a - (a > 0 and raw[a - 1] == 32) : b]
            while word:
                k = next(k for k in range(len(word), 0, -1) if word[:k] in pieces)
                word, n = word[k:], n + 1
        assert (r.n_words, r.n_pieces) == (len(start), n)
    assert wordpiece.token_counts(empty, tokenizer_path()).count() == 0


def test_automaton_with_failure_links():
    auto = wordpiece.Automaton([b"a", b"b", b"c", b"ab", b"abcab", b"ca"])
    raw = np.frombuffer(b"abcabbabcac", np.uint8)
    assert auto.counts(raw, np.array([0, 6]), np.array([6, 11])).tolist() == [2, 3]  # abcab b; ab ca c


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(quality.FEATURES))).astype(np.float32)
    y = (x[:, 3] + x[:, 5] ** 2 > 0.7).astype(float)
    trees = quality.fit(x[:600], y[:600], 40)
    assert ((trees.score(x[600:]) > 0.5) == y[600:]).mean() > 0.9
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, None, 1), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert [r.score for r in quality.score(docs, quality.learn(docs, labels.where("false"))).collect()] == [0.5] * len(ROWS) and quality.score(empty, trees).count() == 0


def test_sharding(docs, empty, spark):
    rows = sharding.kd_shards(docs, 4, 5).collect()
    assert len(rows) == len(ROWS) and all(r.text_crc32 == zlib.crc32((t or "").encode()) for r in rows for i, t, _ in ROWS if i == r.doc_id and i is not None)
    for s in range(4):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    many = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab ', 1 + cast(hash(id) % 50 AS int)) AS text")
    sizes = {r.shard: r.s for r in sharding.kd_shards(many, 8).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 1.1 * min(sizes.values()) and sharding.kd_shards(empty, 4).count() == 0


@pytest.mark.parametrize("block_bytes", [16 << 20, 40])
def test_winnowing(spark, docs, empty, block_bytes):
    words = BASE.split()
    bench = spark.createDataFrame([(1, " ".join(words[5:16])), (2, "one two"), (3, None), (None, BASE), (4, "nothing like the other rows here at all my friend"), (5, "!!"), (10, " ".join(words[:10]))], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, bench, block_bytes=block_bytes).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].items, got[1].spans[0].last) == (25, 16, ["1", "10"], 15)
    assert (got[7].items, got[8].n_hit, got[4].n_words, got[4].contaminated, got[10].n_hit) == (["2"], 2, 0, False, 0)
    assert got[9].n_hit == 400 * 16 and got[4].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} >= {4, 5, 10} and decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = got[11]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (15, 3, 3, 13, "apache,cc-by,mit") and set(r.base_labels.split(",")) <= set(r.labels.split(","))
    assert (got[4].n_words, got[4].labels, got[4].score, got[4].first_word) == (0, "", 0.0, None)
    assert licenses.scan(empty).count() == 0


def test_licence_templates(spark):
    label, text, _ = licenses.TEMPLATES[5]
    df = spark.createDataFrame([(1, f"some words first. {text.upper()}"), (2, " ".join(reversed(text.split()))), (3, "kind of software")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df).collect()}
    assert got == {1: (label, 1.0), 2: ("", 0.0), 3: ("", 0.0)}


def test_licences_together(spark):
    """Each template alone, all of different labels in one file, and each with the words of others around it."""
    other = " ".join(f"plain{i}" for i in range(30))
    vocabulary = " ".join(reversed(licenses.VOCABULARY))
    rows = [(t, f"{text} {other}") for t, (_, text, _) in enumerate(licenses.TEMPLATES)] + [(100 + t, f"{vocabulary} {other} {text}") for t, (_, text, _) in enumerate(licenses.TEMPLATES)]
    rows.append((200, f" {other} ".join(text for _, text, _ in licenses.TEMPLATES)))
    rows += [(201, "this essay is offered under cc by 4 0"), (202, "for any purpose with or without fee")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert {(m.label, m.word, round(m.share, 9)) for m in got[i].matches} == _verified(text), i
    assert set(got[200].labels.split(",")) == {t[0] for t in licenses.TEMPLATES}


def _verified(text):
    """Every template at every offset: mandatory phrase in place, and the share of words in place."""
    w, out = text.split(), set()
    for label, template, phrase in licenses.TEMPLATES:
        t, p = template.split(), phrase.split()
        at = next(i for i in range(len(t)) if t[i : i + len(p)] == p)
        for off in range(-at, len(w)):
            share = sum(0 <= off + j < len(w) and w[off + j] == x for j, x in enumerate(t)) / len(t)
            if share >= licenses.SHARE and w[off + at : off + at + len(p)] == p:
                out.add((label, max(off, 0), round(share, 9)))
    return out


def test_scan_slices():
    column = pa.array(["Ab  c", None, "", "é d", "x" * 50])
    whole = [(lo, hi) for lo, hi, _, _ in textscan.scan(column, textscan.SPACE, 5)]
    assert whole[0][0] == 0 and whole[-1][1] == 5
    (_, _, a, f), = textscan.scan(pa.array(["AB c", "ab C"]), textscan.SPACE)
    assert (a[:2] == a[2:]).all() and f.tolist() == [0, 2, 4]
