"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled text train a linear classifier on the words
that a text holds (hashed; whether, not how often, so length says little). With p the
share of toxic text among the labels, the risk p * R+(toxic) + max(0, R-(unlabelled) -
p * R-(toxic)) is made small; where the inner difference turns negative its gradient
is reversed, which keeps it from fitting the unlabelled part as if all were clean. The
words kept are those whose corrected frequency in clean text (that of unlabelled text
less p times that of toxic text) is far below that of toxic text; the frequency in
unlabelled text is counted over all rows of the training folds. Scores are brought
to probabilities by two numbers fitted on the labelled rows of the training folds.

Labels are read from the rows whose crc32(doc_id as text) mod 4 is not 2 alone, and
unlabelled text is drawn from the same rows. The gradient steps and the calibration read
at most MAX_TOXIC + MAX_CLEAN labelled and MAX_UNLABELLED other documents, the first by a
hash of the id; the prior, the words' frequencies and the scores cover every row. Only the texts enter a score.

Nulls are empty texts, which score the same as a text of unknown words. Without any
confirmed toxic row every score is 0. Rows that repeat are scored alike; a null
doc_id is in no held-out fold. Columns of the input that are named as the one added, in
any case, stay, and that one gets an underscore more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, distinct, free_name, plus, ship, span_hashes, text_slices, tidy

MAX_TOXIC, MAX_CLEAN, MAX_UNLABELLED = 8_000, 8_000, 12_000
BUCKET_BITS, FEATURES, LEAST_TOXIC = 20, 2048, 3
#: Bytes of the beginnings of words that count as words themselves.
BEGINNINGS = (5, 6, 7, 8)
THRESHOLD = 0.3


@dataclass
class Model:
    """weight of each bucket (0 for most), bias, and the scale and shift that make a probability."""

    weight: np.ndarray
    bias: float
    scale: float
    shift: float


def _buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every word and of the beginnings of longer words, which stand for its inflections."""
    h, every = [w.hash], np.arange(len(w))
    at = [every]
    size = w.end - w.start
    for n in BEGINNINGS:
        long = np.flatnonzero(size > n)
        h.append(span_hashes(w.low, w.start[long], w.start[long] + n) ^ np.uint64(n))
        at.append(long)
    return np.concatenate(at), (np.concatenate(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _sets(text: pa.Array) -> Iterator[np.ndarray]:
    """Of slices of texts: the texts' numbers and the buckets that each holds, once, as sorted numbers text << BUCKET_BITS | bucket."""
    for row, _, raw, off in text_slices(text):
        w = Words(raw, off)
        at, h = _buckets(w)
        yield distinct((row + np.searchsorted(w.first, at, side="right") - 1) << BUCKET_BITS | h)


def frequencies(documents: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many rows hold a word of each bucket, and how many rows there are. A task passes on one row a bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for held in _sets(b[text]):
                np.add.at(counts, held & ((1 << BUCKET_BITS) - 1), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[rows, counts[some]])], names=["bucket", "n"])

    got = documents.select(text).mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    counts = np.zeros(1 << BUCKET_BITS)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    return counts, int(n[bucket < 0].sum())


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _rows_of(sample: list[np.ndarray], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place among the features) of the features each text holds."""
    place = np.full(1 << BUCKET_BITS, -1)
    place[features] = np.arange(len(features))
    row = np.repeat(np.arange(len(sample)), [len(x) for x in sample])
    col = place[np.concatenate(sample)] if sample else np.zeros(0, np.int64)
    return row[col >= 0], col[col >= 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(toxic: list[np.ndarray], clean: list[np.ndarray], unlabelled: list[np.ndarray], n_toxic: int, n_clean: int, counts: np.ndarray, n_rows: int, rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """The classifier from the sets of word buckets of each sampled text. n_toxic and n_clean are all labelled rows, of
    which the samples may be unequal parts: the share of toxic text comes from them, and so do the weights of calibration.
    counts and n_rows are the frequencies in all unlabelled text."""
    weight = np.zeros(1 << BUCKET_BITS)
    if not toxic:
        return Model(weight, 0.0, 0.0, -np.inf)
    prior = min(0.5, max(0.005, n_toxic / (n_toxic + n_clean))) if clean else 0.1
    other = unlabelled or clean or [np.zeros(0, np.int64)]
    share = lambda texts: np.bincount(np.concatenate(texts), minlength=1 << BUCKET_BITS) / len(texts)
    p, u = share(toxic), counts / n_rows if n_rows else share(other)
    n = np.maximum(0, (u - prior * p) / (1 - prior))
    few = 1 / len(toxic) + 1 / (n_rows or len(other))
    lift = np.log((p + few) / (n + few))
    score = np.where((p * len(toxic) >= LEAST_TOXIC) & (lift > 0.7), p * lift, 0)
    features = np.argsort(-score, kind="stable")[: min(FEATURES, int((score > 0).sum()))]
    if not len(features):
        return Model(weight, 0.0, 0.0, float(np.log(prior / (1 - prior))))
    tr, tc = _rows_of(toxic, features)
    ur, uc = _rows_of(other, features)
    w, b, k = np.zeros(len(features)), float(np.log(prior / (1 - prior))), len(features)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        zt = b + np.bincount(tr, weights=w[tc], minlength=len(toxic))
        zu = b + np.bincount(ur, weights=w[uc], minlength=len(other))
        st, su = _sigmoid(zt), _sigmoid(zu)
        # sigmoid loss: l(z, +) = 1 - s, l(z, -) = s; both have slope s (1 - s)
        dt, du = st * (1 - st) / len(toxic), su * (1 - su) / len(other)
        fits = su.mean() - prior * st.mean()
        gt = np.bincount(tc, weights=dt[tr], minlength=k)
        gu = np.bincount(uc, weights=du[ur], minlength=k)
        if fits >= 0:
            grad = np.r_[-2 * prior * gt + gu, -2 * prior * dt.sum() + du.sum()]
        else:
            grad = np.r_[prior * gt - gu, prior * dt.sum() - du.sum()]
        grad[:k] += decay * w * prior
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:k], b - float(step[k])
    weight[features] = w
    z = np.array([b + weight[x].sum() for x in [*toxic, *clean]])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    each = np.r_[np.full(len(toxic), n_toxic / len(toxic)), np.full(len(clean), n_clean / max(1, len(clean)))]
    scale, shift = _calibrate(z, y, each) if len(clean) else (1.0, 0.0)
    return Model(weight, b, scale, shift)


def _calibrate(z: np.ndarray, y: np.ndarray, each: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through the labelled scores, each standing for so many rows, by Newton steps; a small ridge keeps it finite."""
    a = np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], axis=1)
    yes, no = each[y == 1].sum(), each[y == 0].sum()
    t = np.where(y == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    each = each * (len(z) / each.sum())
    for _ in range(30):
        p = _sigmoid(x @ a)
        h = (x * (each * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        a = a - np.linalg.solve(h, x.T @ (each * (p - t)) + 1e-3 * (a - [1.0, 0.0]))
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def train(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """A model from bounded samples; labels of the held-out fold are filtered away before anything else is read."""
    ship(documents.sparkSession)
    order = [F.xxhash64(doc_id), F.col(doc_id)]
    usable = labels.where(~held_out(doc_id) & F.col(doc_id).isNotNull())
    n_toxic, n_clean = usable.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    known = [usable.where(F.col(label) == k).select(doc_id).distinct().orderBy(*order).limit(n).select(doc_id, F.lit(k).alias("__kind")) for k, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    ids = documents.select(doc_id).where(~held_out(doc_id) & F.col(doc_id).isNotNull())
    known.append(ids.distinct().orderBy(*order).limit(MAX_UNLABELLED).select(doc_id, F.lit(2).alias("__kind")))
    wanted = known[0].unionByName(known[1]).unionByName(known[2]).groupBy(doc_id).agg(F.collect_set("__kind").alias("__kinds"))
    rows = documents.select(doc_id, text).join(F.broadcast(wanted), doc_id)  # at most the three bounds together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = np.concatenate([*_sets(b[text]), np.zeros(0, np.int64)])
            edge = np.searchsorted(held, np.arange(b.num_rows + 1) << BUCKET_BITS)
            held = (held & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
            out = [held[a:z] for a, z in zip(edge, edge[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b["__kinds"], pa.array(out, pa.list_(pa.int32()))], names=["kinds", "words"])

    got = rows.mapInArrow(tidy(run), "kinds array<int>, words array<int>").toArrow()
    kinds, words = got["kinds"].to_pylist(), got["words"].combine_chunks()
    off, flat = words.offsets.to_numpy(), words.values.to_numpy()
    sets = [flat[a:z] for a, z in zip(off, off[1:], strict=False)]
    of = [[x for x, ks in zip(sets, kinds, strict=True) if k in ks] for k in range(3)]
    # a text that is known to be toxic or clean is no less a draw from all text
    counts, n_rows = frequencies(documents.where(~held_out(doc_id) & F.col(doc_id).isNotNull()), text) if of[1] else (np.zeros(0), 0)
    return fit(of[1], of[0], of[2], n_toxic, n_clean, counts, n_rows)


def score(documents: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """documents with the probability that each whole text is toxic."""
    spark = documents.sparkSession
    ship(spark)
    schema = plus(documents, **{out: "double"})
    used = np.flatnonzero(model.weight)
    sent = spark.sparkContext.broadcast((used, model.weight[used], model.bias, model.scale, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, bias, scale, shift = sent.value
        weight = np.zeros(1 << BUCKET_BITS)
        weight[used] = values
        for b in batches:
            parts = []
            for _, n, raw, off in text_slices(b[text]):
                w = Words(raw, off)
                at, h = _buckets(w)
                used = np.flatnonzero(weight[h])
                held = distinct((np.searchsorted(w.first, at[used], side="right") - 1) << BUCKET_BITS | h[used])
                z = bias + np.bincount(held >> BUCKET_BITS, weights=weight[held & ((1 << BUCKET_BITS) - 1)], minlength=n)
                parts.append(_sigmoid(scale * z + shift) if np.isfinite(shift) else np.zeros(n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=[f.name for f in schema])

    return documents.mapInArrow(tidy(run), schema)


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold."""
    name = free_name(documents, "score")
    return score(documents, train(documents, labels), out=name).where(F.col(name) < threshold).drop(name)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of op9."""
    rows = documents.select("doc_id", "text")
    return score(rows, train(rows, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
