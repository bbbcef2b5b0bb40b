"""Operator 6: language by averaged embeddings of hashed subwords and a linear softmax.

A text's subwords are its byte n-grams of ``ORDERS`` after lower-casing, with white
space and ASCII marks as one border symbol.  Each has an embedding by its hash; their
average goes to a linear softmax.  Both are trained together by stochastic gradient
descent in numpy, on at most ``SAMPLE`` labelled documents (smallest hash of their id) and
``ENTRIES`` hashed counts, which is what the executors send of their whole texts.  A
quarter of the sample calibrates: a temperature for the scores, and the score below which a prediction is
rejected, under which ``REJECTED`` of right predictions fall.

As everything behind the average is linear, embeddings times weights are one table of
a row per hash, and a text costs one lookup per subword.

Null texts and texts without a letter are ``und`` with score 0 and rejected.  With no
labelled document all texts are ``und``.  Very long texts are read whole.  Of languages
that tie the first by name is taken.  Rows that repeat each have their score; in the
sample an id counts once.  A null id is scored, not learned from and not held out.  Columns
but ``doc_id``, ``text`` and ``lang`` are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventclock.llm.common import bounded_batches, filter_rows, map_rows, sampled
from eventclock.llm.pieces import chunks

ORDERS, BUCKETS, DIMENSIONS, SAMPLE, ENTRIES, EPOCHS, RATE, REJECTED = (2, 3), 1 << 14, 8, 2_000, 8_000_000, 12, 2.0, 0.001
_symbol = np.arange(256, dtype=np.uint8)
_symbol[[b for b in range(128) if not 97 <= b <= 122]] = 32
_turn = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def remainder(key: Column, n: int) -> Column:
    """CRC-32 of a number's decimal text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword of all texts, and the number of each text's; order by text."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    # two borders between texts: no subword holds parts of both
    data = _symbol[np.frombuffer(b"  ".join([b"", *raw, b""]), np.uint8)]
    border = data == 32
    stops = np.cumsum([len(r) + 2 for r in raw])
    owner_at = np.concatenate([[0], stops])
    wide = data.astype(np.uint32)
    found, counts = [], np.zeros(len(texts), np.int64)
    for n in ORDERS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        h = np.full(size, np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF))
        for k in range(n):
            h = (h ^ wide[k : k + size]) * _turn[k]
        h ^= h >> np.uint32(15)
        # no subword runs over two borders, so long stretches of marks don't count
        keep = np.flatnonzero(~(border[:size] & border[1 : size + 1]))
        found.append((h[keep] % np.uint32(BUCKETS), keep))
        counts += np.diff(np.searchsorted(keep, owner_at))
    if len(found) == 1:
        return found[0][0], counts
    buckets, at = np.concatenate([b for b, _ in found]), np.concatenate([k for _, k in found])
    return buckets[np.argsort(at, kind="stable")], counts


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities of each language."""
        buckets, counts = subwords(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        some = counts > 0
        if len(buckets):
            starts = (np.cumsum(counts) - counts)[some]
            for k in range(len(self.languages)):
                sums[some, k] = np.add.reduceat(self.table[k][buckets], starts, dtype=np.float64)
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        return _softmax(z)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 3) -> LanguageModel | None:
    """rows: language, distinct buckets, their counts."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    held, train = np.split(order, [len(rows) // 4])
    embed = (random.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS
    weight, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    goal = np.eye(len(languages))[[languages.index(r[0]) for r in rows]]

    def averaged(at: np.ndarray) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(rows[i][1]) for i in at])
        buckets = np.concatenate([rows[i][1] for i in at])
        share = np.concatenate([rows[i][2] / rows[i][2].sum() for i in at])
        return np.add.reduceat(embed[buckets] * share[:, None], np.cumsum(sizes) - sizes), buckets, share, sizes

    steps, total = 0, EPOCHS * -(-len(train) // 32)
    for _ in range(EPOCHS):
        for at in np.array_split(random.permutation(train), max(1, len(train) // 32)):
            if not len(at):
                continue
            x, buckets, share, sizes = averaged(at)
            error = (_softmax(x @ weight + bias) - goal[at]) / len(at)
            rate = RATE * (1 - steps / (total + 1))
            back = error @ weight.T
            weight -= rate * x.T @ error
            bias -= rate * error.sum(axis=0)
            np.subtract.at(embed, buckets, 50 * rate * np.repeat(back, sizes, axis=0) * share[:, None])
            steps += 1
    temperature, threshold = 1.0, 0.0
    if len(held):
        z = np.concatenate([averaged(at)[0] for at in np.array_split(held, -(-len(held) // 32))]) @ weight + bias
        losses = [(-np.log(np.maximum((_softmax(z / t) * goal[held]).sum(axis=1), 1e-12)).mean(), t) for t in np.geomspace(0.02, 5, 40)]
        temperature = float(min(losses)[1])
        p = _softmax(z / temperature)
        right = p.argmax(axis=1) == goal[held].argmax(axis=1)
        if right.any():
            threshold = float(min(0.5, np.quantile(p.max(axis=1)[right], REJECTED)))
    return LanguageModel(languages, np.ascontiguousarray((embed @ weight).T, np.float32), bias, temperature, threshold)


def training_rows(docs: DataFrame, learn: Column) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Hashed counts of the sample: at most SAMPLE documents and ENTRIES counts."""
    bounded_batches(docs.sparkSession)
    marked = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, h, lang, text in rows:
            buckets, counts = np.unique(subwords([text])[0], return_counts=True)
            yield doc, h, lang, buckets.astype("<u2").tobytes(), counts.astype("<u4").tobytes()

    def counted(drawn: DataFrame) -> DataFrame:
        # the sample is bounded, so its ids can go to all tasks
        texts = marked.join(F.broadcast(drawn), "doc_id").select("doc_id", "h", "lang", "text")
        schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("mark", pa.string()), ("buckets", pa.binary()), ("vals", pa.binary())])
        return map_rows(texts, kernel, schema, "doc_id long, h long, mark string, buckets binary, vals binary", 200)

    ids = marked.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return [(lang, np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64)) for lang, b, c in sampled(ids, counted, SAMPLE, ENTRIES)]


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = shared.value
        for group in chunks(rows, 1):
            texts = [t or "" for _, t in group]
            scores = known.scores(texts) if known else None
            for i, ((doc, _), text) in enumerate(zip(group, texts, strict=True)):
                if known is None or not has_letter(text):
                    yield doc, "und", 0.0, True
                else:
                    best = int(scores[i].argmax())
                    yield doc, known.languages[best], float(scores[i, best]), bool(scores[i, best] < known.threshold)

    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), kernel, schema, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns from three quarters of the documents."""
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = fit(training_rows(docs, ~held_out))
    return predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, with all columns."""
    model = fit(training_rows(docs, remainder(F.col("doc_id"), 4) != 2))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(rows: list[tuple]) -> list[bool]:
        known, out = shared.value, []
        for group in chunks(rows, 0):
            texts = [t or "" for (t,) in group]
            sure = known.scores(texts).max(axis=1) >= known.threshold if known else np.ones(len(texts), bool)
            out += [bool(s) and has_letter(t) for s, t in zip(sure.tolist(), texts, strict=True)]
        return out

    return filter_rows(docs, ["text"], decide)
