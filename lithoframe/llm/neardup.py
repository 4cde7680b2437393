"""MinHash near-duplicates with sequential Bayesian verification.

Sets of k-word shingles (A-Z lower-cased) are banded by MinHash; signatures of candidates are compared batch by batch
and a pair is given up once the posterior probability of reaching the threshold is below the chosen miss probability;
survivors are verified on their full sets. Equal sets are one class from the start, so copies are never paired.

Buckets are not expanded into all pairs. Each member meets the bucket's smallest id. Then components are known; members
of buckets that still have several components are dealt to blocks by their largest bucket's center, and blocks
that share such a bucket meet inside a task, where only verified links leave it. So no link that could join two
components is lost, and no table of candidate pairs grows with the square of a group. Rows of buckets, centers and
components that very many texts share are dealt over several parts where they are joined.

A text without words is linked with nothing; a null id is kept and belongs to nothing. The nodes of the graph are the
smallest ids of equal sets: where ids repeat, a row gets the component of its own text, and an id that is the smallest of
several sets stands for all of them. Texts of any length are compared by
their full sets. An empty table gives an empty one; columns that are not read do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, met, mix64, shingles_of, small_batches, texts_of, words_of, written
from .components import components

BANDS, ROWS = 40, 5
#: Signature values that are compared at a time.
BATCH = 40
#: Chance that a pair at the threshold is given up by a comparison of signatures.
MISS = 1e-7
#: Per cent of the union that must be shared.
PER_CENT = 80
#: Members, and bytes of their sets, that a block holds about.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Up to this many ids (8 bytes each) a table of ids is broadcast; beyond it both sides shuffle.
BROADCAST_IDS = 1_000_000

_K = BANDS * ROWS
_RANDOM = np.random.default_rng(20240101)
_A = (_RANDOM.integers(0, 1 << 32, _K, dtype=np.uint64).astype(np.uint32) | np.uint32(1))
_B = _RANDOM.integers(0, 1 << 32, _K, dtype=np.uint64).astype(np.uint32)


def sets_of(offsets: np.ndarray, data: np.ndarray, k: int):
    """Distinct shingle hashes of each text, ascending: ``(hash, text, first)``."""
    code, first, _, _ = words_of(offsets, data)
    value, text = shingles_of(code, first, k)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, text, np.searchsorted(text, np.arange(len(offsets)))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values, a row of ``BANDS * ROWS`` for each text with a set."""
    some = np.flatnonzero(np.diff(first))
    out = np.empty((_K, len(some)), dtype=np.uint32)
    if len(some):
        x = (value >> np.uint64(32)).astype(np.uint32)
        h = np.empty_like(x)
        for i in range(_K):
            np.multiply(x, _A[i], out=h)
            h += _B[i]
            h ^= h >> np.uint32(15)
            out[i] = np.minimum.reduceat(h * np.uint32(0x9E3779B1), first[:-1][some])
    return out.T


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band."""
    keys = np.zeros((len(mins), BANDS), dtype=np.uint64)
    keys += np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        keys = mix64(keys ^ mins[:, r::ROWS].astype(np.uint64)) * np.uint64(0x100000001B3)
    return mix64(keys)


def least_matches(per_cent: int = PER_CENT, miss: float = MISS, batch: int = BATCH) -> list[int]:
    """For each number of compared one-byte values, the fewest matches with which a pair stays in play.

    Prior: every similarity is as likely; a byte also matches by chance once in 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in range(batch, _K + 1, batch):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(log - log.max())
            if like[s >= per_cent / 100].sum() >= miss * like.sum():
                out.append(m)
                break
    return out


def _sign(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("mins", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, offsets, data in texts_of(batch.column(1)):
                value, _, first = sets_of(offsets, data, k)
                size = np.diff(first)
                mins = signatures(value, first)
                digests, raw = [b""] * len(size), [b""] * len(size)
                for row, t in enumerate(np.flatnonzero(size)):
                    digests[t] = hashlib.blake2b(value[first[t] : first[t + 1]].tobytes(), digest_size=16).digest()
                    raw[t] = mins[row].tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(size)), pa.array(size), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], schema=schema)

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            mins = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, _K)
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(mins).ravel().view(np.int64)), pa.array(ids)], names=["band", "id"])


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The byte of each MinHash value that comparisons use."""
    for batch in batches:
        if batch.num_rows:
            mins = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, _K)
            low = (mix64(mins.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "sig"])


def _in_play(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of equally many signatures stay in play through all batches."""
    left, got = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for step, m in enumerate(least):
        cut = slice(step * BATCH, (step + 1) * BATCH)
        got[left] += (a[left, cut] == b[left, cut]).sum(axis=1)
        left = left[got[left] >= m]
    return left


def _prune(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, _K) for i in (2, 3))
                keep = pa.array(_in_play(a, b, least))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["u", "v"])

    return run


def _meet(least: list[int], per_cent: int):
    """Verified links between members of two blocks that are in different components; nothing else leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, members in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids = np.array([m["id"] for m in members], dtype=np.int64)
                comp = np.array([m["component"] for m in members], dtype=np.int64)
                at = np.array([m["block"] for m in members])
                sig = np.frombuffer(b"".join(m["sig"] for m in members), dtype=np.uint8).reshape(-1, _K)
                sets = [np.frombuffer(m["shingles"], dtype=np.uint64) for m in members]
                right = np.flatnonzero(at == j)
                for x in np.flatnonzero(at == i):
                    y = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) if i == j else True)]
                    y = y[_in_play(np.broadcast_to(sig[x], (len(y), _K)), sig[y], least)]
                    if not len(y):
                        continue
                    sizes = np.array([len(sets[k]) for k in y])
                    every = np.concatenate([sets[k] for k in y])
                    place = np.searchsorted(sets[x], every)
                    place[place == len(sets[x])] = 0
                    shared = np.add.reduceat((sets[x][place] == every).astype(np.int64), np.cumsum(sizes) - sizes)
                    linked = y[100 * shared >= per_cent * (sizes + len(sets[x]) - shared)]
                    u.append(np.minimum(ids[x], ids[linked]))
                    v.append(np.maximum(ids[x], ids[linked]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return run


def _shingles(k: int):
    """Full sets of texts, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, data in texts_of(batch.column(1)):
                value, _, first = sets_of(offsets, data, k)
                raw = [value[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raw)), pa.array(raw, pa.binary())], names=["id", "shingles"])

    return run


def _verify(k: int, per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in range(0, batch.num_rows, 100):
                part = batch.slice(row, 100)
                n = part.num_rows
                both = [x for i in (2, 3) for _, o, d in texts_of(part.column(i), 1 << 62) for x in (o, d)]
                sets = [sets_of(both[i], both[i + 1], k) for i in (0, 2)]
                value = np.concatenate([s[0] for s in sets])
                text = np.concatenate([s[1] for s in sets])
                order = np.lexsort((value, text))
                value, text = value[order], text[order]
                same = (value[1:] == value[:-1]) & (text[1:] == text[:-1])
                shared = np.bincount(text[1:][same], minlength=n)
                union = np.diff(sets[0][2]) + np.diff(sets[1][2]) - shared
                keep.append(row + np.flatnonzero((100 * shared >= per_cent * union) & (union > 0)))
            if keep:
                at = pa.array(np.concatenate(keep))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["u", "v"])

    return run


def without(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_anti") -> DataFrame:
    """``docs`` without (or, by ``left_semi``, with only) the rows whose key is in ``ids``; broadcast only if few."""
    ids = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


def _hot(pairs: DataFrame) -> list[int]:
    """Centers with very many of the pairs, of bounded number."""
    return hot_keys(pairs.groupBy("u").count(), pairs.count())


def _among_blocks(rows: DataFrame, open_: DataFrame, classes: DataFrame, sigs: DataFrame, least: list[int], k: int, per_cent: int) -> DataFrame:
    """Links between members of different components that share a bucket of ``open_`` (band, id, center, size, component).

    A member's home is its largest bucket, so that members of a bucket have few homes. In homes of more than a block,
    members of the largest component have blocks of their own, and blocks of one and the same component do not meet, so
    that what is exchanged grows with the members outside of it and not with the square of the bucket.
    """
    ids = open_.groupBy("id", "component").agg(F.max(F.struct("size", "center"))["center"].alias("home"))
    sized = ids.join(classes.groupBy("id").agg(F.sum("n").alias("n")), "id")
    each = sized.groupBy("home", "component").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    most = each.groupBy("home").agg(F.max(F.struct("size", "component"))["component"].alias("main"), (F.sum("size") > BLOCK).alias("large"))
    dealt = lambda size, n: F.greatest(F.ceil(size / BLOCK), F.ceil(n * 8 / BLOCK_BYTES), F.lit(1).cast("long"))
    of = lambda own, c: F.coalesce(F.sum(F.when((F.col("large") & (F.col("component") == F.col("main"))) == own, F.col(c))), F.lit(0).cast("long"))
    homes = each.join(most, "home").groupBy("home", "main", "large").agg(
        dealt(of(True, "size"), of(True, "n")).alias("main_parts"), dealt(of(False, "size"), of(False, "n")).alias("parts"), F.sum("size").alias("size")
    )
    homes = written(homes, "homes")
    hot = hot_keys(homes.select("home", "size"), homes.agg(F.sum("size")).head()[0] or 0)
    is_main = F.col("large") & (F.col("component") == F.col("main"))
    block = F.xxhash64("home", is_main, F.pmod(F.xxhash64("id"), F.when(is_main, F.col("main_parts")).otherwise(F.col("parts"))))
    who = written(met(ids, homes, "home", hot, "id").select("id", "component", block.alias("block")), "who")
    alone = who.groupBy("block").agg(F.when(F.min("component") == F.max("component"), F.min("component")).alias("only"))
    shared = open_.select("id", "band").join(who.select("id", "block"), "id").select("band", "block").distinct()
    touched = shared.join(alone, "block").groupBy("band").agg(F.sort_array(F.collect_set(F.struct("block", "only"))).alias("blocks")).select("blocks").distinct()
    # a bucket has a block for each BLOCK members or so of a home; pairs of blocks, not of members, and of two components
    pairs = touched.select(F.explode("blocks").alias("x"), "blocks")
    partners = F.filter("blocks", lambda y: (y["block"] >= F.col("x.block")) & ~F.coalesce(y["only"] == F.col("x.only"), F.lit(False)))
    pairs = written(pairs.select(F.col("x.block").alias("i"), F.explode(F.transform(partners, lambda y: y["block"])).alias("j")).distinct(), "block-pairs")
    texts = without(rows, who.select("id"), "doc_id", "left_semi")
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).drop("h")
    sets = texts.mapInArrow(_shingles(k), "id long, shingles binary")
    members = written(who.join(sigs, "id").join(sets, "id"), "block-members")
    both = pairs.select(F.col("i").alias("block"), "i", "j").union(pairs.where("i <> j").select(F.col("j").alias("block"), "i", "j"))
    met_ = members.join(both, "block").groupBy("i", "j").agg(F.collect_list(F.struct("id", "component", "block", "sig", "shingles")).alias("members"))
    return met_.select("i", "j", "members").mapInArrow(_meet(least, per_cent), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, per_cent: int = PER_CENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``."""
    small_batches(docs.sparkSession)
    least = least_matches(per_cent)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = written(rows.mapInArrow(_sign(k), "doc_id long, n long, digest binary, mins binary"), "signed")
    linked = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(
        linked.groupBy("digest").agg(F.min(F.struct("doc_id", "mins")).alias("r"), F.any_value("n").alias("n"), F.count("*").alias("copies"))
        .select("digest", F.col("r.doc_id").alias("id"), F.col("r.mins").alias("mins"), "n", "copies"), "classes"
    )
    sigs = classes.select("id", "mins").mapInArrow(_bytes_of, "id long, sig binary")
    bands = classes.select("id", "mins").mapInArrow(_bands, "band long, id long")
    buckets = written(bands.groupBy("band").agg(F.min("id").alias("center"), F.count("*").alias("size")).where("size > 1"), "buckets")
    size = classes.agg(F.count("*").alias("sets"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).head()
    hot = hot_keys(buckets.select("band", "size"), BANDS * size["sets"])
    members = written(met(bands, buckets, "band", hot, "id"), "members")

    star = written(members.where("id <> center").select(F.col("center").alias("u"), F.col("id").alias("v")).distinct(), "star")
    a, b = sigs.select(F.col("id").alias("u"), F.col("sig").alias("su")), sigs.select(F.col("id").alias("v"), F.col("sig").alias("sv"))
    pairs = met(star, a, "u", _hot(star), "v").join(b, "v").select("u", "v", "su", "sv").mapInArrow(_prune(least), "u long, v long")
    pairs = written(pairs, "pairs")
    texts = without(rows, pairs.select(F.col("u").alias("id")).union(pairs.select("v")), "doc_id", "left_semi")
    # equal texts of a repeated id are compared once
    texts = written(texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).drop("h"), "texts")
    a, b = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
    full = met(pairs, a, "u", _hot(pairs), "v").join(b, "v").select("u", "v", "tu", "tv")
    links = written(full.mapInArrow(_verify(k, per_cent), "u long, v long"), "links")
    known = components(links)

    placed = members.where("size > 2").join(known.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("band", "id", "center", "size", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    open_ = written(met(placed, mixed, "band", hot, "id"), "open")
    found = known
    if not open_.isEmpty():
        rest = written(_among_blocks(rows, open_, classes, sigs, least, k, per_cent), "rest")
        found = components(known.select(F.col("component").alias("u"), F.col("node").alias("v")).union(rest))
    joined = classes.select("digest", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    copied = hot_keys(classes.select("digest", "copies"), size["rows"])
    out = met(linked.select("doc_id", "n", "digest"), joined, "digest", copied, "doc_id").select("doc_id", "n", "component_id")
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, per_cent: int = PER_CENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id; rows without an id stay.

    A repeated id goes with all of its rows if one of its texts is a copy of a smaller id's.
    """
    gone = written(near_duplicates(docs, k, per_cent, key, text).where("NOT kept").select(key), "gone")
    return without(docs, gone, key)


def query(spark, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` by sets of 2-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=2)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
s AS (SELECT doc_id, len(g)::BIGINT AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM g UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.doc_id WHERE c.root < e.v)
SELECT g.doc_id, len(g)::BIGINT AS n_shingles, r.component_id, g.doc_id = r.component_id AS kept
FROM g JOIN (SELECT doc_id, min(root) AS component_id FROM c GROUP BY 1) r USING (doc_id)"""
