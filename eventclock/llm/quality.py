"""Operator 7: document quality by a factorisation machine.

Features of a text: its words and runs of marks, hashed, with the logarithm of their
counts; structure statistics (shares of upper case, digits, marks and line ends, word
length, distinct words) and the recorded number of characters, in steps.  The score
is a linear part plus all pairwise interactions through low-rank factors, found in time linear in
the features: half of (square of the sum less sum of the squares), for each factor.

Trained in numpy on at most ``SAMPLE`` labelled documents (smallest hash of their id) and
``ENTRIES`` hashed counts, which is what the executors send of their whole texts.

Null texts count as empty and have a score too; labels for absent documents, null
labels and such beside 0 and 1 are not used; with no label, or one kind only, every text
has the share of good ones as its score (0.5 without any).  A document with labels of
both kinds is a bad one.  A score of 0.5 counts as good.  Rows that repeat each have
their score; in the sample an id counts once.  A null id is scored, not learned from and
not held out.  Very long texts are read whole.  Columns but ``doc_id``, ``text`` and
``n_chars`` (a number, else ignored) are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventclock.llm.common import bounded_batches, filter_rows, map_rows, sampled, text_column
from eventclock.llm.language_id import remainder
from eventclock.llm.pieces import chunks, run_hashes
from eventclock.llm.shingles import mix

BUCKETS, FACTORS, SAMPLE, ENTRIES, EPOCHS, RATE, STEPS = 1 << 14, 6, 6_000, 8_000_000, 12, 0.1, 10
_WORD, _MARK, _GAP = 0, 1, 2
_kind = np.full(256, _MARK, np.uint8)
_kind[128:] = _WORD
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _kind[_a:_b] = _WORD
_kind[[32, *range(9, 14)]] = _GAP


def features(texts: list[str], sizes: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, values, and number of features of each text; values of a text have length one."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]) or b" ", np.uint8)
    lower = np.frombuffer(b" ".join([*raw, b""]).lower() or b" ", np.uint8)
    kind = _kind[data]
    start = np.append(True, kind[1:] != kind[:-1])
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(data))
    run = kind[starts] != _GAP
    starts, ends = starts[run], ends[run]
    h = mix(run_hashes(lower, starts, ends))
    stops = np.cumsum([len(r) + 1 for r in raw]).astype(np.int64)
    begins = np.append(0, stops[:-1])
    owner = np.searchsorted(stops, starts, side="right")
    key, times = np.unique(owner.astype(np.uint64) << np.uint64(14) | h % np.uint64(BUCKETS), return_counts=True)
    word_owner, bucket, value = (key >> np.uint64(14)).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64), np.log1p(times)

    n = len(texts)
    size = np.maximum(stops - begins - 1, 1)
    words, distinct = np.bincount(owner, minlength=n), np.bincount(word_owner, minlength=n)
    marks = np.bincount(owner, kind[starts] == _MARK, n)

    def share(mask: np.ndarray) -> np.ndarray:
        t = np.concatenate([[0], np.cumsum(mask)])
        return (t[stops - 1] - t[begins]) / size

    known = np.array([len(t) if s is None else max(0, s) for t, s in zip(texts, sizes, strict=True)], float)
    stats = np.stack([
        4 * share((data >= 65) & (data <= 90)), 4 * share((data >= 48) & (data < 58)), 4 * share(kind == _MARK), 40 * share(data == 10),
        np.bincount(owner, ends - starts, n) / np.maximum(words, 1) / 12, distinct / np.maximum(words, 1), marks / np.maximum(words, 1),
        np.log1p(known) / 12, np.log1p(words) / 12,
    ], axis=1)
    step = np.minimum((stats * STEPS).astype(np.int64), STEPS)
    code = BUCKETS + np.arange(stats.shape[1]) * (STEPS + 1) + step
    norm = np.sqrt(np.bincount(word_owner, value * value, n))
    value = value / np.maximum(norm, 1e-9)[word_owner]
    all_owner = np.concatenate([word_owner, np.repeat(np.arange(n), stats.shape[1])])
    order = np.argsort(all_owner, kind="stable")
    buckets = np.concatenate([bucket, code.ravel()])[order]
    values = np.concatenate([value, np.full(code.size, 1 / 3)])[order]
    return buckets, values, np.bincount(all_owner, minlength=n)


_ALL = BUCKETS + 9 * (STEPS + 1)


@dataclass
class QualityModel:
    base: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, buckets: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        starts = np.cumsum(counts) - counts
        x = values[:, None]
        v = self.factors[buckets] * x
        once = np.add.reduceat(v, starts)
        twice = np.add.reduceat((v * v).sum(axis=1), starts)
        return self.base + np.add.reduceat(self.linear[buckets] * values, starts) + 0.5 * ((once * once).sum(axis=1) - twice)

    def scores(self, texts: list[str], sizes: list[int | None]) -> np.ndarray:
        return _sigmoid(self.raw(*features(texts, sizes)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 5) -> QualityModel:
    """rows: label, buckets, values. Adaptive gradient descent on the logistic loss."""
    random = np.random.default_rng(seed)
    model = QualityModel(0.0, np.zeros(_ALL), random.normal(0, 0.05, (_ALL, FACTORS)))
    y = np.array([r[0] for r in rows], float)
    if len(set(y.tolist())) < 2:
        share = min(max(y.mean() if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return QualityModel(float(np.log(share / (1 - share))), model.linear, np.zeros_like(model.factors))
    g_linear, g_factors, g_base = np.full(_ALL, 1e-6), np.full((_ALL, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        for at in np.array_split(random.permutation(len(rows)), max(1, len(rows) // 64)):
            counts = np.array([len(rows[i][1]) for i in at])
            b, x = np.concatenate([rows[i][1] for i in at]), np.concatenate([rows[i][2] for i in at])
            owner = np.repeat(np.arange(len(at)), counts)
            error = (_sigmoid(model.raw(b, x, counts)) - y[at]) / len(at)
            v = model.factors[b]
            once = np.add.reduceat(v * x[:, None], np.cumsum(counts) - counts)
            used, inverse = np.unique(b, return_inverse=True)
            e = error[owner] * x
            d_linear = np.bincount(inverse, e) + 1e-6 * model.linear[used]
            pull = e[:, None] * (once[owner] - v * x[:, None])
            d_factors = np.stack([np.bincount(inverse, pull[:, k]) for k in range(FACTORS)], axis=1) + 1e-6 * model.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            g_base += error.sum() ** 2
            model.linear[used] -= RATE * d_linear / np.sqrt(g_linear[used])
            model.factors[used] -= 0.3 * RATE * d_factors / np.sqrt(g_factors[used])
            model.base -= RATE * error.sum() / np.sqrt(g_base)
    return model


def _size(docs: DataFrame) -> Column:
    return F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Features of the sample: at most SAMPLE documents and ENTRIES values."""
    bounded_batches(docs.sparkSession)
    quality = F.col("quality").cast("int")
    marked = labels.where(learn & quality.isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(quality).alias("quality"))

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, h, mark, text, size in rows:
            buckets, values, _ = features([text], [size])
            yield doc, h, mark, buckets.astype("<u2").tobytes(), values.astype("<f4").tobytes()

    def counted(drawn: DataFrame) -> DataFrame:
        # the sample is bounded, so it can go to all tasks
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"), _size(docs).alias("size")).join(F.broadcast(drawn), "doc_id").select("doc_id", "h", "quality", "text", "size")
        schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("mark", pa.int32()), ("buckets", pa.binary()), ("vals", pa.binary())])
        return map_rows(texts, kernel, schema, "doc_id long, h long, mark int, buckets binary, vals binary", 200)

    return [(q, np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for q, b, v in sampled(marked, counted, SAMPLE, ENTRIES)]


def _whole(size) -> int | None:
    try:
        return int(size)
    except (TypeError, ValueError):
        return None


def predict(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score of every whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for group in chunks(rows, 1):
            scores = shared.value.scores([t for _, t, _ in group], [s for _, _, s in group])
            yield from zip((d for d, _, _ in group), scores.tolist(), strict=True)

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text"), _size(docs).alias("size")), kernel, schema, "doc_id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from two thirds of the labels."""
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = fit(training_rows(docs, labels, ~held_out))
    return predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, with all columns."""
    model = fit(training_rows(docs, labels, remainder(F.col("doc_id"), 3) != 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sized = ["n_chars"] if "n_chars" in docs.columns else []

    def decide(rows: list[tuple]) -> list[bool]:
        out = []
        for group in chunks(rows, 0):
            sizes = [_whole(r[1]) if sized else None for r in group]
            out += (shared.value.scores([r[0] or "" for r in group], sizes) >= 0.5).tolist()
        return out

    return filter_rows(docs, ["text", *sized], decide)
