"""Each operator against a brute-force version on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eventclock.llm import bpe, embedding_dedup, exact_dedup, language_id, minhash_dedup, packing, quality, token_files, url_filter, word_pieces
from eventclock.llm import components as module
from eventclock.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, norm int, rep long, sequence_id string"


def _texts():
    r = random.Random(4)
    words = ["the", "of", "and", "Straße", "naïve", "don't", "it's", "x1", "42", "日本", "🙂", "thnt", "ering", "over", "under"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(6, 60))) for _ in range(14)]
    odd = [None, "", " ", "\n\n \t", "a", "one two three", "one  two\tthree", "’s 's  x", "ſK Σς ΑΣ", "\x85\x1c\u2003x", "<|endoftext|>", "é e\u0301"]
    near = []
    for b in base[:5]:
        w = b.split()
        near += [b, b.upper().lower(), " ".join([*w, "extra"]), " ".join(["new", *w[1:]])]
    return base + odd + near + [" ".join(r.choice(words) for _ in range(30_000))]


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else ("en", "fr")[i % 2], "s", None if t is None or i % 5 == 0 else len(t), "h", i, i, "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], rows[15]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def each():
    return [*enumerate(TEXTS), (3, TEXTS[3]), (15, TEXTS[15])]


def test_bpe(docs, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for i, t in each():
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert collected(bpe.round_trip(docs, path, portion=7)) == sorted(want, key=repr)
    assert sorted(bpe.decoded(bpe.encoded(docs, path), path).collect()) == sorted((i, t or "") for i, t in each())
    assert bpe.round_trip(none, path).count() == 0


def test_transducer_on_any_bytes():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine, r, tokens = bpe.Transducer(ranks, most_states=500), random.Random(1), list(ranks)
    for k in range(3_000):
        data = b"".join(r.choice(tokens) for _ in range(r.randint(1, 5))) if k % 2 else bytes(r.choice(b"aabethns\xc3\xa9") for _ in range(r.randint(1, 25)))
        assert machine.encode(data) == own._core_bpe.encode_single_piece(data)


def test_stream_decoder_replaces_what_is_ill_formed():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    vocabulary, r = bpe.TokenBytes(ranks), random.Random(2)
    for _ in range(2_000):
        data = bytes(r.choice([0x61, 0xC3, 0xA9, 0xE4, 0xBD, 0xF0, 0x9F, 0x99, 0xED, 0xA0, 0x80, 0xFF]) for _ in range(8))
        ids = np.array([ranks[bytes([c])] for c in data])
        decoder = bpe.StreamDecoder(vocabulary)
        assert decoder.feed(ids[:3]) + decoder.feed(ids[3:]) + decoder.end() == data.decode("utf-8", "replace")


def _spaced(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda t: F.substring(F.md5(t.cast("binary")), 1, 1)])
def test_exact_dedup(docs, none, hashed):
    groups = {}
    for i, t in each():
        groups.setdefault(_spaced(t), []).append(i)
    want = [(i, min(groups[_spaced(t)]), len(groups[_spaced(t)]), i == min(groups[_spaced(t)]), hashlib.sha256(_spaced(t).encode()).hexdigest()) for i, t in each()]
    assert collected(exact_dedup.exact_groups(docs, hashed)) == sorted(want, key=repr)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())
    assert exact_dedup.exact_groups(none).count() == exact_dedup.exact_dedup(none).count() == 0


def _library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_token_files(docs, none):
    encode, want, start = _library("byte_bpe_50k.json"), [], 0
    found = sorted(token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(i for i, _ in each())
    for r in found:
        ids = [*encode(TEXTS[r.doc_id]), 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found] == want
    assert token_files.token_files(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_token_coding(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 80_000).astype(np.uint32)
    assert (token_files.unpack(*token_files.pack(ids), n) == ids).all()


def test_packing(docs, none):
    encode = _library("word_bpe_49k.json")
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=64).collect()
    parts = {}
    for r in rows:
        parts.setdefault((r.doc_id, r.doc_tokens), set()).add((r.start, r.length, r.ids_crc32))
    for i, t in enumerate(TEXTS):
        ids = [*encode(t), 1]
        want = {(a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for a in range(0, len(ids), 64)}
        assert parts[i, len(ids)] == want
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_best_fit_by_brute_force():
    r = random.Random(5)
    lengths = sorted((r.randint(1, 50) for _ in range(400)), reverse=True)
    number, offset = packing.best_fit(lengths, 64)
    left = []
    for n in lengths:
        fits = [c for c in left if c >= n]
        left.append(64)
        if fits:
            left.pop()
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left[-1] -= n
    used = {}
    for n, k, o in zip(lengths, number, offset, strict=True):
        assert o == used.get(k, 0)
        used[k] = o + n
    assert sorted(64 - u for u in used.values()) == sorted(left)


def test_url_rules(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "")]
    hosts, paths = ["a.example.com", "Example.COM", "com", "xcom", "b.net", "example.net", "q.example.net", "w.org", ""], ["/en/75", "/en/", "/en", "/de/8?x", "/de/7#/de/8", "", "/es/1"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "a://b://c.com/en/", "x://w.org?q"]
    pages = spark.createDataFrame([(i, u, "html", "rule") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, html string, rule string")

    def judge(i, u):
        tail = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", tail)[0]
        path = re.match(r"[^?#]*", tail[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (i, host, path, *((max(fits)[1:]) if fits else (None, "allow")))

    found = url_filter.filter_urls(pages, url_filter.rules_table(spark, rules))
    assert collected(found) == sorted((judge(i, u) for i, u in enumerate([*urls, urls[0]])), key=repr)
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_table(spark, rules)).count() == 0


def _components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)]
    want = _components(range(200), links)
    for portion in (500_000, 4):  # all links at once, and rounds that must join what portions found
        before, module.PORTION = module.PORTION, portion
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        try:
            found = components(spark.createDataFrame(links, "u long, v long")).collect()
        finally:
            module.PORTION = before
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        assert dict(found) == {n: want[n] for a, b in links for n in (a, b) if a != b} and len(found) == len(dict(found))
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


def test_embedding_dedup(spark):
    g = np.random.default_rng(0)
    centres = g.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + g.normal(size=16) * 0.12).tolist(), i % 3) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(5)] + [(400, (2 * np.array(rows[0][1])).tolist(), 0), rows[7]]
    odd = [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, rows[1][1], None), (504, [1.0, None] * 8, 0), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, label int, rep string, n int")
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    close = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    ids = [r[0] for r in rows]
    group = _components({*ids, *(o[0] for o in odd)}, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close), strict=True)] + [(505, 506)])
    want = [(i, int(n), group[i], group[i] == i) for i, n in zip(ids, close.sum(axis=1), strict=True)]
    want += [(o[0], int(o[0] > 504), group[o[0]], group[o[0]] == o[0]) for o in odd]
    assert close.sum() > 200
    found = collected(embedding_dedup.near_duplicates(df))
    assert found == sorted(want, key=repr)
    embedding_dedup.TILE, kept = 8, embedding_dedup.TILE
    try:  # directions that are split into tiles give the same links
        assert collected(embedding_dedup.near_duplicates(df)) == found
    finally:
        embedding_dedup.TILE = kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def _shingles(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup(docs, none, percent):
    sets = {i: _shingles(t) for i, t in enumerate(TEXTS)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = _components(sets, links)
    want = [(i, len(sets[i]), group[i], group[i] == i) for i, _ in each()]
    assert links and collected(minhash_dedup.near_groups(docs, percent)) == sorted(want, key=repr)
    kept = minhash_dedup.near_dedup(docs, percent)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(group.values())
    assert minhash_dedup.near_groups(none).count() == 0


def test_mixed_bucket_is_compared_in_full(spark):
    """A chain of texts, each a little further from the first, links through its neighbours only."""
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join([*[f"c{i}" for i in range(4 * k)], *words[4 * k :]]) for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [_shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(8), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    group = _components(range(8), links)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_groups(docs).collect()} == group and len(set(group.values())) == 1


def test_odd_sketches_estimate_differences():
    g = np.random.default_rng(0)
    both = g.integers(0, 1 << 63, 900).astype(np.uint64)
    for other, allowed in ((0, True), (50, True), (2_000, False)):
        a, b = (np.sort(np.concatenate([both, g.integers(0, 1 << 63, other).astype(np.uint64)])) for _ in range(2))
        apart = np.bitwise_count((minhash_dedup.odd_sketch(minhash_dedup.samples(a)) ^ minhash_dedup.odd_sketch(minhash_dedup.samples(b))).view(np.uint64)).sum()
        assert (apart <= minhash_dedup.most_differing(85)) == allowed


def test_word_pieces(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary = word_pieces.read_vocabulary(path)

    def greedy(word):
        s, n, i = list(word.encode()), 0, 0
        s[-1] += 256
        while i < len(s):
            j = next((j for j in range(len(s), i, -1) if tuple(s[i:j]) in vocabulary), 0)
            if not j:
                return 1
            n, i = n + 1, j
        return n

    from eventclock.llm.pieces import split

    want = []
    for i, t in each():
        p = split([(t or "").lower()], keep_space=False)
        words = [p.joined[a:b] for a, b in zip(p.starts, p.ends, strict=True)]
        want.append((i, len(words), sum(map(greedy, words))))
    assert collected(word_pieces.token_counts(docs, path)) == sorted(want, key=repr)
    assert word_pieces.token_counts(none, path).count() == 0


def test_longest_match_with_failure_links():
    machine = word_pieces.LongestMatch({tuple(b"a"), tuple(b"abcd"), (98,), (99,), (100,), (97 + 256,), (98 + 256,), (99 + 256,), (100 + 256,), (98, 99 + 256)})
    assert [machine.count(w) for w in (b"a", b"abc", b"abcd", b"abcda", b"", b"azb")] == [1, 2, 4, 2, 0, 1]


def test_language(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(10_000, None, None), (10_001, "", "en"), (10_002, "42 !! \n", "en"), (10_003, "the of and that is", None)], "doc_id long, text string, lang string")
    found = language_id.identify(docs.select("doc_id", "text", "lang").unionByName(more)).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    odd = {r.doc_id: r.lang_pred for r in found if r.doc_id >= 10_000}
    assert odd == {10_000: "und", 10_001: "und", 10_002: "und", 10_003: "en"}
    assert language_id.identify(none).count() == 0
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


def test_subwords_of_all_texts():
    texts = [t or "" for t in TEXTS]
    buckets, counts = language_id.subwords(texts)
    one = [language_id.subwords([t])[0] for t in texts]
    assert [len(o) for o in one] == counts.tolist() and (np.concatenate(one) == buckets).all()


def test_quality(spark, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    more = spark.createDataFrame([(10_000, None, None, "s", None), (10_001, "", "en", "s", 0)], docs.schema)
    found = {r.doc_id: r for r in quality.score_quality(docs.unionByName(more), labels).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(found[r.doc_id].predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values()) and {10_000, 10_001} <= set(found)
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_interactions_in_linear_time():
    g = np.random.default_rng(0)
    model = quality.QualityModel(0.3, g.normal(size=quality._ALL), g.normal(size=(quality._ALL, quality.FACTORS)))
    buckets, values, counts = quality.features([t or "" for t in TEXTS[:20]], [None] * 20)
    at = 0
    for n, z in zip(counts.tolist(), model.raw(buckets, values, counts), strict=True):
        b, x = buckets[at : at + n], values[at : at + n]
        pairs = sum(model.factors[b[i]] @ model.factors[b[j]] * x[i] * x[j] for i, j in itertools.combinations(range(n), 2))
        assert z == pytest.approx(0.3 + (model.linear[b] * x).sum() + pairs)
        at += n


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "language", "exact_dedup", "near_dedup", "packing"]
    now, kept = docs, None
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, now, sf)
        assert after.columns == docs.columns and 0 < after.count() <= now.count(), name
        now = after.persist()
    kept = sorted(r.doc_id for r in now.collect())
    assert sorted({r.doc_id for r in p.run(spark, sf).collect()}) == kept
