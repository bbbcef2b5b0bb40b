"""Nulls, empty and very long texts, ties, repeats, empty tables, odd column names and hostile strings, for each operator."""

import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eventclock.llm import bpe, common, embedding_dedup, exact_dedup, language_id, minhash_dedup, packing, pieces, quality, shingles, token_files, url_filter, word_pieces

BPE, WORDS, MULTI = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))


def thue_morse(rounds):
    """Two words that any polynomial hash modulo 2 ** 64 confuses."""
    word = "a"
    for _ in range(rounds):
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


ONE, TWO = thue_morse(10)
HOSTILE = [ONE, TWO, f"{ONE} {TWO}", f"{TWO} one two three four five", f"{ONE} one two three four five", f"x {TWO}\n{ONE}"]
LONG = "many words of a long text " * 40_000
ROWS = [(1, HOSTILE[0]), (2, HOSTILE[1]), (3, HOSTILE[2]), (4, HOSTILE[3]), (5, HOSTILE[4]), (6, HOSTILE[5]), (None, "a text without id"), (None, "a text without id"), (None, None), (7, None), (8, ""), (9, LONG), (10, "a text without id"), (10, "a text without id")]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that hold a dot, a backtick and names that operators use inside."""
    rows = [(i, t, "s.x", "tick", 5, "h", "n", "r", "kept") for i, t in ROWS]
    names = ["doc_id", "text", "so.urce", "lan`g", "n_chars", "h", "n", "kept_id", "kept"]
    return spark.createDataFrame(rows, "doc_id long, text string, c string, d string, n_chars long, h string, n string, kept_id string, kept string").toDF(*names).repartition(2)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_runs_with_one_hash_are_told_apart():
    p = pieces.split([f"{ONE} {TWO}", TWO, ONE])
    codes, seen = p.distinct()
    assert [seen[c] for c in codes] == [ONE, " " + TWO, TWO, ONE]
    one, two = shingles.shingle_sets([f"{ONE} one two", f"{TWO} one two"])
    assert not set(one) & set(two)


def test_bpe(docs):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    want = []
    for i, t in ROWS:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(bpe.round_trip(docs, MULTI)) == sorted(want, key=repr)


def _library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_token_files(docs):
    encode, start = _library(BPE), 0
    found = sorted(token_files.token_files(docs, BPE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    by_id = {i: [*encode(t), 0] for i, t in ROWS if i is not None}
    unnamed = sorted([*encode(t), 0] for i, t in ROWS if i is None)
    for r in found:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None:
            assert (r.n_tokens, r.ids_crc32) == (len(by_id[r.doc_id]), zlib.crc32(np.array(by_id[r.doc_id], "<u4").tobytes()))
    assert sorted((r.n_tokens, r.ids_crc32) for r in found[:3]) == sorted((len(u), zlib.crc32(np.array(u, "<u4").tobytes())) for u in unnamed)


def test_packing(docs, spark):
    encode = _library(WORDS)
    found = packing.pack_documents(docs, WORDS, window=64).collect()
    want = []
    for i, t in ROWS:
        ids = [*encode(t), 1]
        want += [(i, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 64)]
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    # ids beyond 2 ** 53 stay whole beside null ids, and repeated rows are dealt to several groups
    big = (1 << 60) + 1
    many = spark.createDataFrame([(big, "one")] * 40 + [(None, "one")], "doc_id long, text string")
    parts = common.written(packing.pieces(many, WORDS), "pieces")
    placed = packing.packed(parts, 2048, group=8).collect()
    assert sorted((r.doc_id or 0) for r in placed) == [0] + [big] * 40
    assert len({r.sequence_id for r in placed}) > 2


def test_word_counts(docs):
    found = {r.doc_id: (r.n_words, r.n_tokens) for r in word_pieces.token_counts(docs, WORDS).collect()}
    alone = {w: word_pieces.LongestMatch(word_pieces.read_vocabulary(WORDS)).count(w.encode()) for w in (ONE, TWO)}
    assert found[1] == (1, alone[ONE]) and found[2] == (1, alone[TWO]) and found[3] == (2, alone[ONE] + alone[TWO])
    assert found[7] == found[8] == (0, 0) and found[9][0] == 240_000


def test_exact_dedup(docs):
    found = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    r = found[None, sha("a text without id")]
    assert (r.keep_id, r.group_size, r.kept) == (10, 4, False)
    r = found[7, sha("")]
    assert (r.keep_id, r.group_size, r.kept) == (7, 3, True)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.schema["text"].dataType == docs.schema["text"].dataType
    assert sorted((r.doc_id for r in kept.collect())) == [1, 2, 3, 4, 5, 6, 7, 9, 10]
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[7] is None and texts[9] == LONG and {tuple(r)[2:] for r in kept.collect()} == {("s.x", "tick", 5, "h", "n", "r", "kept")}


def test_exact_dedup_keeps_a_document_without_id(spark):
    docs = spark.createDataFrame([(None, "a  b"), (None, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(r.text.replace("  ", " ") for r in exact_dedup.exact_dedup(docs).collect()) == ["a b", "c"]
    assert {(r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()} == {(None, 2, True), (None, 1, True)}


def test_near_dedup(docs):
    found = {r.doc_id: r for r in minhash_dedup.near_groups(docs).collect() if r.doc_id is not None}
    assert {i: r.component_id for i, r in found.items()} == {i: i for i in found}  # hostile words don't link
    assert all(r.kept and r.component_id is None for r in minhash_dedup.near_groups(docs).where("doc_id IS NULL").collect())
    kept = minhash_dedup.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def _shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_large_components_have_tiles_of_their_own(spark):
    """Buckets of a large group of near copies and of others, in small tiles."""
    g = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:55], f"own{i}"]) for i in range(40)] + [" ".join([*[f"c{j}" for j in range(3 * k)], *words[3 * k :]]) for k in range(8)]
    texts += [" ".join(g.permutation(words)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(root[:], 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    minhash_dedup.TILE, before = 4, minhash_dedup.TILE
    try:
        found = {r.doc_id: r.component_id for r in minhash_dedup.near_groups(docs, 80).collect()}
    finally:
        minhash_dedup.TILE = before
    assert found == dict(enumerate(root)) and 1 < len(set(root)) < len(texts)


def test_vectors(spark):
    v, w = [1.0, 2.0, 3.0, 4.0, 5.0], [-1.0, 0.5, 2.0, 0.0, 1.0]
    rows = [(1, v, 0), (2, v, 0), (2, w, 0), (None, v, 0), (3, None, 0), (4, [], 0), (5, [0.0] * 5, 0), (6, v, None), (7, w, 0), (7, w, 0), (8, [1.0, None, 3.0, 4.0, 5.0], 0), (9, [float("inf")] * 5, 0), (10, [-0.0, 2.0], 1), (11, [0.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, d1 string, rep int, n int").toDF("vec_id", "embedding", "label", "d1", "re.p", "n")
    found = rows_of(embedding_dedup.near_duplicates(df))
    # id 2 holds two vectors, each with copies
    want = [(1, 1, 1, True), (2, 1, 1, False), (2, 2, 2, True), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 2, 2, False), (7, 2, 2, False), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False)]
    assert found == sorted(want, key=repr)


@pytest.mark.parametrize("per_part", [2, 3, 4, 8, 16, 32])
def test_recall_of_directions(per_part):
    """Pairs at the least cosine share a direction, at every number of directions."""
    g = np.random.default_rng(per_part)
    a = embedding_dedup.unit(g.standard_normal((1_000, 64)))
    b = g.standard_normal((1_000, 64))
    b = embedding_dedup.unit(b - (b * a).sum(axis=1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    one, two = embedding_dedup.directions(a, per_part), embedding_dedup.directions(b, per_part)
    met = np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(one, two, strict=True)])
    near = np.bitwise_count((embedding_dedup.sketches(a) ^ embedding_dedup.sketches(b)).view(np.uint64)).sum(axis=1)
    assert met >= 0.99 and (near <= embedding_dedup.most_differing(0.93)).all()
    assert min(map(len, one)) >= embedding_dedup.LEAST


def test_directions_by_brute_force():
    g = np.random.default_rng(3)
    code, v = embedding_dedup.ProductCode(12, 3), embedding_dedup.unit(g.standard_normal((50, 12)))
    every = np.array([sum(c[k] for c, k in zip(code.codes, at, strict=True)) for at in itertools.product(range(3), repeat=4)])
    row, direction = code.decode(v)
    for i in range(len(v)):
        own, bound = set(direction[row == i].tolist()), code.bound
        while len(want := set(np.flatnonzero(v[i] @ every.T > bound).tolist())) < code.least:
            bound -= 0.05 * abs(code.bound) + 1e-3
        assert own == want


def test_urls(spark):
    long_host, long_path = ".".join(["a"] * 30_000) + ".com", "/en/" + "x/" * 50_000
    urls = [f"http://{long_host}/en/1", f"http://q.com{long_path}", None, "", "http://", "http://a.com", "://com/en/", "http://com/en/", "http://comx/en/", "http://q.com/de/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in [*enumerate(urls), (None, urls[1]), (3, urls[1])]], "page_id long, url string, k string, w string").toDF("page_id", "url", "ke.y", "host")
    rules = url_filter.rules_table(spark, [("block", "com", "/en/"), ("allow", "q.com", "/de/"), ("block", "q.com", "/de/"), ("block", "com/e", "n/"), ("block", None, "/"), ("block", "comx", "en"), (None, "com", "/")])
    began = time.time()
    found = {(r.page_id, r.verdict, r.rule) for r in url_filter.filter_urls(pages, rules).collect()}
    assert time.time() - began < 30
    assert found == {(0, "block", "com/en/"), (1, "block", "com/en/"), (2, "allow", None), (3, "allow", None), (4, "allow", None), (5, "allow", None), (6, "block", "com/en/"), (7, "block", "com/en/"), (8, "allow", None), (9, "block", "q.com/de/"), (None, "block", "com/en/"), (3, "block", "com/en/")}
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def _language_score(model, text):
    """Scores of one text, one subword at a time."""
    raw = [32, 32, *(b if b < 128 and chr(b).isalpha() or b > 127 else 32 for b in text.lower().encode()), 32, 32]
    sums, count = np.zeros(len(model.languages)), 0
    for at in range(len(raw)):
        for n in (2, 3):
            gram = raw[at : at + n]
            if len(gram) < n or gram[:2] == [32, 32]:
                continue
            h = n * 0x27D4EB2F & 0xFFFFFFFF
            for c, turn in zip(gram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
                h = (h ^ c) * turn & 0xFFFFFFFF
            sums, count = sums + model.table[:, (h ^ h >> 15) % language_id.BUCKETS], count + 1
    z = (sums / max(count, 1) + model.bias) / model.temperature
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_language_scores_by_brute_force():
    g = np.random.default_rng(0)
    model = language_id.LanguageModel(["a", "b", "c"], g.normal(size=(3, language_id.BUCKETS)).astype(np.float32), g.normal(size=3), 0.7, 0.0)
    texts = ["The straße — is, long!", "x", "no  no\n\nno", "don't 42 日本", "", "!?", "ab" * 50]
    assert model.scores(texts) == pytest.approx(np.array([_language_score(model, t) for t in texts]), abs=1e-6)


def test_samples_of_classifiers_are_bounded(spark, monkeypatch):
    rows = [(i % 40, "the text of number " + "abc"[i % 3] * (i % 7), "en") for i in range(4_000)] + [(None, "none", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 1), (1, None), (2, 7), (None, 1), (99, 1)], "doc_id long, quality int")
    assert len(language_id.training_rows(docs, F.lit(True))) == len(quality.training_rows(docs, labels, F.lit(True))) == 40
    monkeypatch.setattr(language_id, "ENTRIES", 300)
    monkeypatch.setattr(quality, "SAMPLE", 12)
    kept = language_id.training_rows(docs, F.lit(True))
    assert 1 < len(kept) < 40 and sum(len(b) for _, b, _ in kept) <= 300 and len(quality.training_rows(docs, labels.where("doc_id < 40"), F.lit(True))) == 12


def test_classifiers(docs, spark):
    labelled = docs.withColumn("lang", F.lit("en"))
    found = language_id.identify(labelled).collect()
    assert len(found) == len(ROWS) and {r.lang_pred for r in found if r.doc_id in (7, 8)} == {"und"}
    assert not any(r.held_out for r in found if r.doc_id is None) and len({r.score for r in found if r.doc_id == 10}) == 1
    assert language_id.keep_known(labelled).columns == labelled.columns
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (10, 0), (10, 1)], "doc_id long, quality int")
    found = quality.score_quality(docs, labels).collect()
    assert len(found) == len(ROWS) and len({r.score for r in found if r.doc_id == 10}) == 1 and not any(r.held_out for r in found if r.doc_id is None)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score_quality(docs.withColumn("n_chars", F.lit("many")), labels).count() == len(ROWS)
    tied = quality.score_quality(docs, spark.createDataFrame([(1, 1), (2, 0)], labels.schema).limit(0)).collect()
    assert {(r.score, r.predicted) for r in tied} == {(0.5, 1)}


def test_written_tables_stay_until_released(spark):
    first = common.written(spark.range(5), "numbers")
    derived = first.where("id > 2")
    del first
    import gc

    gc.collect()
    common.written(spark.range(3), "numbers")
    assert derived.count() == 2
    inner = common.written(spark.range(4), "inner")
    common.discard(inner)
    with pytest.raises(Exception, match="not exist|does not|FILE_NOT_EXIST"):
        inner.select("id").collect()
    assert re.search("written-", common.run_dir(spark))
    with common.scratch() as kept:
        kept.append(common.written(spark.range(2), "kept"))
        gone = common.written(spark.range(2), "gone")
    assert kept[0].count() == 2
    with pytest.raises(Exception, match="not exist|does not|FILE_NOT_EXIST"):
        gone.select("id").collect()


def test_no_local_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

        class _jsc:
            class sc:
                def getCheckpointDir(self):
                    class Nothing:
                        def getOrElse(self, other):
                            return other

                    return Nothing()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_pipeline_of_edge_rows(docs, spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    now = docs.withColumn("lang", F.lit("en"))
    for table in (now, now.limit(0)):
        out = table
        for _, stage in p.STAGES[:-1]:
            after = stage(spark, out, sf)
            assert after.columns == table.columns
            out = common.written(after.toDF(*[f"c{i}" for i in range(len(after.columns))]), "stage").toDF(*after.columns)
        packed = p.STAGES[-1][1](spark, out, sf)
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in out.collect()}


def test_a_full_memo_forgets_what_is_rare():
    encoded = []

    def encode(new):
        encoded.extend(new)
        return pieces.flat([[ord(c) for c in p] for p in new])

    table = pieces.PieceTable(encode, most_pieces=40, most_ids=10_000)
    for k in range(60):
        texts = [f"often met words {'x' * (k + 1)} y{k}", "", "often"]
        ids, counts = table.ids(texts)
        assert "".join(map(chr, ids.tolist())) == "".join(texts) and counts.tolist() == [len(t) for t in texts]
        assert len(table.rows) <= 40 + 5
    assert encoded.count("often") == 1 and encoded.count(" words") == 1
