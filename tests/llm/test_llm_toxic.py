"""Toxicity against a dense form of the risk and against scores added up word by word."""

import math
import zlib

import numpy as np
import pyarrow as pa

from lithoframe.llm import toxicity
from lithoframe.llm.common import texts_of


def codes(text):
    """The features of one text as numbers."""
    ((_, offsets, data),) = texts_of(pa.array([text]), 1 << 30)
    return toxicity.features(offsets, data)[0]


def words(text):
    """The features of a text as the definition says them: words without end punctuation, and beginnings of longer ones."""
    out = set()
    for w in (text or "").encode().lower().split():
        for _ in range(3):
            w = w[:-1] if len(w) > 1 and w[-1:] in b".,;:!?\"')]}" else w
        out |= {(0, w)} | {(n, w[:n]) for n in toxicity.PREFIXES if len(w) > n}
    return out


def dense(positive, unlabelled, prior, steps=300, rate=0.05, decay=1e-4):
    """The same risk on a matrix of texts x features with the same selection of features; features and weights."""
    every = sorted({f for row in positive for f in row})
    p, u = (np.array([[float(f in row) for f in every] for row in map(set, side)]).reshape(len(side), -1) for side in (positive, unlabelled))
    n, m = len(p), len(u)
    a, b = p.sum(0), u.sum(0)
    mean = (a + b) / (n + m)
    z = (a / n - b / m) / (np.sqrt(mean * (1 - mean) * (1 / n + 1 / m)) + 1e-12)
    keep = (a >= toxicity.LEAST_POSITIVES) & (z >= toxicity.LEAST_Z) & (prior * (a / n) / (b / m + 1 / m) >= toxicity.LEAST_SHARE)
    x = [np.hstack([side[:, keep], np.ones((len(side), 1))]) for side in (p, u)]
    w = np.zeros(keep.sum() + 1)
    w[-1] = math.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for t in range(1, steps + 1):
        zp, zu = x[0] @ w, x[1] @ w
        # risk: prior * mean loss(+) on positives + max(0, mean loss(-) on unlabelled - prior * mean loss(-) on positives)
        to_plus, to_minus = x[0].T @ (sigmoid(zp) - 1) / n, x[0].T @ sigmoid(zp) / n
        rest, grad_rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean(), x[1].T @ sigmoid(zu) / m - prior * to_minus
        g = prior * to_plus + grad_rest if rest >= 0 else -grad_rest
        g[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return [f for f, k in zip(every, keep, strict=True) if k], w


def test_training_against_dense():
    rng = np.random.default_rng(5)
    toxic = [np.unique(np.concatenate([rng.integers(0, 12, 3), rng.integers(50, 400, 15)])) for _ in range(40)]
    other = [np.unique(np.concatenate([rng.integers(0, 12, int(rng.random() < 0.02)), rng.integers(50, 400, 15)])) for _ in range(300)]
    for prior in (0.02, 0.2):
        model = toxicity.train(toxic, other + toxic[:6], prior)
        features, w = dense([set(r.tolist()) for r in toxic], [set(r.tolist()) for r in other + toxic[:6]], prior)
        assert model.feature.tolist() == features and len(features) > 3
        assert np.allclose(model.weight, w[:-1], atol=1e-6) and abs(model.bias - w[-1]) < 1e-6


def test_scores_word_by_word(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sample = [texts[k] or "" for k in sorted(texts)[:40]] + ["", "Ab, abcd. ABCDE!) \"x\" ..."]
    code = {}
    for f in {f for t in sample for f in words(t)}:
        # a word alone gives its own code and those of its beginnings: what is left is the word's
        if f[0] == 0:
            code[f] = set(codes(f[1].decode())) if not any(len(f[1]) > n for n in toxicity.PREFIXES) else None
    for t in sample:
        assert len(codes(t)) == len(words(t))
        assert all(code[f] <= set(codes(t)) for f in words(t) if code.get(f))
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weight = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        z = model.bias + sum(weight.get(f, 0.0) for f in codes(text or "").tolist())
        want = 1 / (1 + math.exp(-max(min(z, 40), -40)))
        assert abs(got[k]["score"] - want) < 1e-9 and got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert got[k]["predicted"] == int(got[k]["score"] >= 0.3)
