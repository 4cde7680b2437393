"""Benchmark decontamination by SimHash of item-sized windows.

For each benchmark item, the windows of a document that have as many words get a 128-bit SimHash of their 5-word
shingles. Fingerprints of items are indexed by sixteen 8-bit blocks: within radius 47 some block differs in two bits at
most, so probing the 37 values within two flips of each block finds every item within the radius. Candidates are
verified by weighted Jaccard similarity of shingle multisets (weight: how often a shingle occurs).

The radius is wide, so that it loses next to nothing: where the similarity is 0.8, eight ninths of the weight are shared
and a bit differs with probability 0.152, 19.4 of 128 on average, with a deviation of 4.1. More than 47 differ in one of
about 10**10 such pairs; more similar ones are closer still. The second
and further occurrences of a shingle in a window are hashed with their number, so that no shingle outweighs others.

Windows that cannot reach the similarity are left out before any fingerprint is made: at 0.8 at least 8/9 of a window's
shingles must occur in items of that size. A document shorter than an item is compared whole, if it has at least 0.8 of
the item's number of shingles. Items of fewer than five words count where a document consists of exactly these words,
and with ``short_inside`` (as in the query and the pipeline) wherever it contains them; items without words never match.
Null texts are empty, very long ones are searched whole. Repeated documents give repeated rows, items that repeat an id
count as one item whose best text is taken. Empty tables give an empty one; columns that are not read do not matter.
The benchmark is taken in blocks of bounded size, each broadcast with the closure of one pass over the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, sequences_of, shingles_of, small_batches, texts_of, words_of, written
from .neardup import without

K = 5
SIMILARITY = 0.8
#: Bits of 128 that may differ: sixteen blocks with two each, and fifteen more.
RADIUS = 47
#: The values within two flipped bits of each byte.
_NEAR = np.array([[v for v in range(256) if (v ^ x).bit_count() <= 2] for x in range(256)])
#: Items of one pass; at 60 words each about 10 MB.
BLOCK_ITEMS = 20_000
SCHEMA = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"


def fingerprint_of(shingles: np.ndarray) -> np.ndarray:
    """SimHash, 16 bytes, of a multiset of shingles; each occurrence counts as one of its own."""
    value = np.sort(shingles)
    new = np.append(True, value[1:] != value[:-1])
    nth = np.arange(len(value)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    value = mix64(value + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    both = np.stack([value, mix64(value + np.uint64(1))], axis=1).view(np.uint8).reshape(-1, 16)
    return np.packbits(2 * np.unpackbits(both, axis=1).sum(axis=0) > len(value))


class Index:
    """Items of one size with their shingles, and their fingerprints sorted by the value of each block."""

    def __init__(self, ids: list[int], shingles: list[np.ndarray]):
        self.ids = ids
        self.size = len(shingles[0])
        self.bags = [Counter(s.tolist()) for s in shingles]
        self.known = np.unique(np.concatenate(shingles))
        self.prints = np.stack([fingerprint_of(s) for s in shingles])
        self.order = np.argsort(self.prints, axis=0, kind="stable").T
        self.bounds = np.stack([np.searchsorted(self.prints[o, b], np.arange(257)) for b, o in enumerate(self.order)])

    def within(self, fingerprint: np.ndarray) -> list[tuple[int, int]]:
        """Every item within the radius, with its distance."""
        probes, block = _NEAR[fingerprint], np.arange(16)[:, None]
        first, last = self.bounds[block, probes], self.bounds[block, probes + 1]
        parts = [self.order[b, first[b, p] : last[b, p]] for b, p in zip(*np.nonzero(last > first), strict=True)]
        if not parts:
            return []
        found = np.unique(np.concatenate(parts))
        far = np.bitwise_count(self.prints[found] ^ fingerprint).sum(axis=1)
        return [(i, d) for i, d in zip(found.tolist(), far.tolist(), strict=True) if d <= RADIUS]


def similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def indexes(items: list[tuple[int, str]]) -> tuple[dict[int, Index], dict[int, dict[int, list[int]]]]:
    """By number of words: indexes of items with five words or more; whole-sequence hashes of shorter ones."""
    by_size: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    short: dict[int, dict[int, list[int]]] = {}
    for item_id, text in items:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        code, first, _, _ = words_of(np.array([0, len(raw)]), raw)
        value, _ = shingles_of(code, first, K)
        if len(code) >= K:
            ids, each = by_size.setdefault(len(code), ([], []))
            ids.append(item_id)
            each.append(value)
        elif len(code):
            short.setdefault(len(code), {}).setdefault(int(value[0]), []).append(item_id)
    return {n: Index(*x) for n, x in by_size.items()}, short


def matches(offsets: np.ndarray, data: np.ndarray, sizes: dict[int, Index], short: dict[int, dict[int, list[int]]], short_inside: bool = False):
    """``(text, item_id, first_word, n_words, distance, similarity)``: the best window of each text and item."""
    code, first, _, _ = words_of(offsets, data)
    count = np.diff(first)
    value, text = shingles_of(code, first, K)
    begin = np.searchsorted(text, np.arange(len(offsets)))
    best: dict[tuple[int, int], tuple] = {}
    for n, table in short.items():
        if short_inside:
            run = sequences_of(code, n)
            for s in np.flatnonzero(np.isin(run, np.array(list(table), dtype=np.uint64))).tolist():
                t = int(np.searchsorted(first, s, side="right")) - 1
                if s + n <= first[t + 1]:
                    for item_id in table[int(run[s])]:
                        best.setdefault((t, item_id), (1.0, 0, int(first[t]) - s, n))
            continue
        for t in np.flatnonzero(count == n):
            for item_id in table.get(int(value[begin[t]]), ()):
                best[int(t), item_id] = (1.0, 0, 0, n)
    everything = np.unique(np.concatenate([x.known for x in sizes.values()])) if sizes else np.zeros(0, np.uint64)

    def member(known: np.ndarray, of: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, of)
        at[at == len(known)] = 0
        return known[at] == of if len(known) else np.zeros(len(of), bool)

    hit = np.flatnonzero(member(everything, value) & (count[text] >= K)) if len(value) else np.zeros(0, int)
    bounds = np.searchsorted(text[hit], np.arange(len(offsets)))
    for t in np.flatnonzero(np.diff(bounds)):
        own = value[begin[t] : begin[t + 1]]
        places = hit[bounds[t] : bounds[t + 1]] - begin[t]
        for n, index in sizes.items():
            whole = n - K + 1
            m = min(whole, len(own))
            # windows and items of so many shingles share 4/9 of their sum at least where 0.8 of their union is shared
            if 5 * m < 4 * whole or len(places) * 9 < 4 * (m + whole):
                continue
            good = np.zeros(len(own) + 1, dtype=np.int64)
            good[places + 1] = member(index.known, own[places])
            good = np.cumsum(good)
            starts = np.flatnonzero((good[m:] - good[:-m]) * 9 >= 4 * (m + whole))
            if not len(starts):
                continue
            for s in starts.tolist():
                bag = None
                for item, distance in index.within(fingerprint_of(own[s : s + m])):
                    bag = bag if bag is not None else Counter(own[s : s + m].tolist())
                    alike = similarity(bag, index.bags[item])
                    key = int(t), index.ids[item]
                    if alike >= SIMILARITY and (alike, -distance, -s) > best.get(key, (0.0, 0, 0))[:3]:
                        best[key] = (alike, -distance, -s, m + K - 1)
    return [(t, i, -s, n, -d, a) for (t, i), (a, d, s, n) in sorted(best.items())]


def _scan(items: list[tuple[int, str]], short_inside: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, short = indexes(items)
        for batch in batches:
            ids = batch.column(0)
            for at, offsets, data in texts_of(batch.column(1)):
                if found := matches(offsets, data, sizes, short, short_inside):
                    text, item, start, n, far, alike = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.array(text) + at)), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(far, pa.int32()), pa.array(alike, pa.float64())],
                        names=["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"],
                    )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", block_items: int = BLOCK_ITEMS, short_inside: bool = False) -> DataFrame:
    """One row for each document and item that it contains, with the best window."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col("text"))
    n = max(1, -(-items.count() // block_items))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    passes = []
    for b in range(n):
        block = [(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == b).collect()]
        passes.append(rows.mapInArrow(_scan(block, short_inside), SCHEMA))
    return reduce(DataFrame.unionByName, passes).withColumnRenamed("doc_id", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", short_inside: bool = False) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    found = written(contaminated(docs, benchmark, key, text, short_inside=short_inside).select(key), "contaminated")
    return without(docs, found, key)


def query(spark, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` in all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_inside=True)
