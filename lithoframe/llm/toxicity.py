"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy is trained from confirmed toxic documents and unlabelled ones: the class prior corrects
the risk, and the negative part of the risk is kept from going below zero. Features say which words and word beginnings
of four to six bytes a text has (A-Z lower-cased, end punctuation cut); those that confirmed documents do not have
clearly more often than unlabelled ones get no weight.

The prior is the share of toxic among labelled ids, which takes these as a random sample of all documents.

Learning sees only rows whose crc32(doc_id as text) mod 4 is not 2, and only their texts and whether they are confirmed
toxic. Every whole text is scored; a null or empty text gets the classifier's bias. A null id is held out as its text
"" is hashed. Repeated rows get equal scores; of several labels of an id, toxic wins. Without
documents or labels there is no feature and every score is the prior's; other columns than the two that are read do not
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, mix64, small_batches, span_codes, span_sums, texts_of, words_of

#: Rows collected to fit the classifier at most, those with the smallest hashes of their ids.
POSITIVES, UNLABELLED = 2000, 5000
#: Bits of a feature's hash; the rest of a 64-bit key numbers the text within a slice of a batch.
BITS = 44
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
#: A feature is used if this many confirmed documents have it, so many standard errors more often than unlabelled ones,
#: and if by the class prior at least this share of the documents that have it is toxic.
LEAST_POSITIVES, LEAST_Z, LEAST_SHARE = 3, 4.0, 0.75
#: Bytes that are cut from the ends of words.
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[np.frombuffer(b".,;:!?\"')]}", dtype=np.uint8)] = True


def features(offsets: np.ndarray, data: np.ndarray):
    """``(feature, first)`` of each text; features are distinct and ascending."""
    data = data.copy()
    capital = (data >= 65) & (data <= 90)
    data[capital] += 32
    _, first, start, end = words_of(offsets, data, lower=False)
    end = end.copy()
    for _ in range(3):
        cut = (end - start > 1) & _PUNCTUATION[data[end - 1]]
        end[cut] -= 1
    total = span_sums(data)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    each = [span_codes(total, start, end)]
    where = [text]
    for n in PREFIXES:
        long = end - start > n
        each.append(span_codes(total, start[long], start[long] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        where.append(text[long])
    key = (np.concatenate(where).astype(np.uint64) << np.uint64(BITS)) | (mix64(np.concatenate(each)) >> np.uint64(64 - BITS))
    key = np.unique(key)
    owner = (key >> np.uint64(BITS)).astype(np.int64)
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(owner, np.arange(len(offsets)))


@dataclass
class Model:
    """The features that count, ascending, with their weights."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, feature: np.ndarray, first: np.ndarray) -> np.ndarray:
        value = np.zeros(len(feature))
        if len(self.feature):
            at = np.searchsorted(self.feature, feature)
            at[at == len(self.feature)] = 0
            value = np.where(self.feature[at] == feature, self.weight[at], 0.0)
        sums = np.concatenate([[0.0], np.cumsum(value)])
        z = sums[first[1:]] - sums[first[:-1]] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss."""
    model = Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not positive or not unlabelled:
        return model
    known, count = np.unique(np.concatenate(positive), return_counts=True)
    known, count = known[count >= LEAST_POSITIVES], count[count >= LEAST_POSITIVES]

    def packed(rows):
        """Places in ``known`` of each row's features, and where rows begin."""
        kept = [np.searchsorted(known, f[np.isin(f, known, assume_unique=True)]) for f in rows]
        return np.concatenate(kept), np.concatenate([[0], np.cumsum([len(f) for f in kept])])

    has = [count, np.bincount(packed(unlabelled)[0], minlength=len(known))]
    share = [h / len(rows) for h, rows in zip(has, (positive, unlabelled), strict=True)]
    mean = (has[0] + has[1]) / (len(positive) + len(unlabelled))
    error = np.sqrt(mean * (1 - mean) * (1 / len(positive) + 1 / len(unlabelled))) + 1e-12
    toxic_share = prior * share[0] / (share[1] + 1 / len(unlabelled))
    known = known[((share[0] - share[1]) / error >= LEAST_Z) & (toxic_share >= LEAST_SHARE)]
    sides = [packed(positive), packed(unlabelled)]
    w = np.zeros(len(known) + 1)
    w[-1] = model.bias
    m, v2 = np.zeros_like(w), np.zeros_like(w)

    def score(side):
        f, first = side
        sums = np.concatenate([[0.0], np.cumsum(w[f])])
        return sums[first[1:]] - sums[first[:-1]] + w[-1]

    def gradient(side, g):
        f, first = side
        out = np.zeros_like(w)
        out[:-1] = np.bincount(f, weights=np.repeat(g, np.diff(first)), minlength=len(known))
        out[-1] = g.sum()
        return out

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp, zu = score(sides[0]), score(sides[1])
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp = prior * (sp - 1) / len(zp) - prior * sp / len(zp)
            gu = su / len(zu)
        else:  # the corrected part went below zero: walk back along it
            gp, gu = prior * sp / len(zp), -su / len(zu)
        g = gradient(sides[0], gp) + gradient(sides[1], gu)
        g[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * g
        v2 = 0.999 * v2 + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v2 / (1 - 0.999**t)) + 1e-8)
    return Model(known, w[:-1], float(w[-1]))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, offsets, data in texts_of(batch.column(1)):
            f, first = features(offsets, data)
            cut = [slice(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(cut)), pa.array([f[c].tobytes() for c in cut], pa.binary())], names=["toxic", "f"]
            )


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, data in texts_of(batch.column(2)):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(model.scores(*features(offsets, data)))], names=["doc_id", "held_out", "score"])

    return run


def held_out(key: Column) -> Column:
    """Whether learning must not see the row."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Trains on bounded samples in the order of the ids' hashes; the prior is the share of toxic among labelled ids."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("doc_id")).agg(F.max(label).alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).head()[0]
    prior = min(max(prior or 0.01, 1e-3), 0.9)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id")
    ids = ids.distinct()
    p = bounded(known.where("toxic = 1").join(ids, "doc_id", "left_semi").select("doc_id", F.xxhash64("doc_id").alias("hash")), "hash", positives)
    u = bounded(ids.select("doc_id", F.xxhash64("doc_id").alias("hash")), "hash", unlabelled)
    p, u = p.select("doc_id", F.lit(1).alias("toxic")), u.select("doc_id", F.lit(0).alias("toxic"))
    # the sample's ids are bounded by the two parameters
    sample = rows.join(F.broadcast(p.union(u)), "doc_id").select("toxic", "text")
    found = sample.mapInArrow(_featurize, "toxic int, f binary").collect()
    sides: tuple[list, list] = ([], [])
    for r in found:
        sides[1 - r["toxic"]].append(np.frombuffer(r["f"], np.int64))
    return train(*sides, prior=prior)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return out.select(F.col("doc_id").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from ``labels``."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
