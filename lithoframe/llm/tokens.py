"""Token ids in files of directly addressable codes (DAC).

Texts are encoded with a public tokenizer, an end id follows each, and the ids are stored in ascending order of the keys.
A segment holds the ids of whole documents (at most ``SEGMENT_BYTES`` of text, or one longer text) as one image: an id's bits
are cut into chunks, chunk 0 of every id lies in level 0, and a bit a code says whether the id goes on in the next level.
Where it goes on is the number of set bits before it, which a directory of ranks gives from one block of 256 bits. So any
id is read from its position with one look per level, and nothing before it is decoded. Chunk widths are the cheapest for
the segment's own ids. Segments are rows of a Parquet table (the image as it is, uncompressed), a directory has the
position of each segment's first id.

Documents are dealt by ranges of keys, so that files ascend; the number of ranges follows from the bytes of all texts.
A null text is empty and has the end id alone; a null key comes first; rows that repeat a key stand one after another in
an order that is not defined between equal ones. An empty table gives empty files; further columns are not read.
Special tokens that stand in a text are what the library makes of them.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, texts_of, written

#: Bytes of text in a range of keys, about.
RANGE_BYTES = 32 << 20
#: Bytes of text in a segment, at most, unless one text has more.
SEGMENT_BYTES = 2 << 20
#: Chunks, and ids of them, beyond which an encoder forgets what it has encoded.
KNOWN, KNOWN_IDS = 300_000, 1 << 21
#: Ranges that are summed together in the directory, and positions of one segment that are looked up together.
RANGES, POSITIONS = 4096, 1 << 16
#: Positions of one cell of the directory.
CELL = 1 << 20
#: Bits that one rank of a level's directory covers.
RANK_BITS = 256
_MAGIC = b"DAC1"

# A tokenizer of bytes never joins a word with white space that follows it, so a text falls apart before every blank or
# line end that comes after a character which no version of Unicode counts as white space. Such characters are told here
# by their bytes: printable ASCII, two bytes that begin with C3 to DF, three that begin with E4 to EC. After any other
# character the text is not parted, which is right, too.
_PRINTABLE, _TWO, _THREE = (np.zeros(256, bool) for _ in range(3))
_PRINTABLE[0x21:0x7F], _TWO[0xC3:0xE0], _THREE[0xE4:0xED] = True, True, True
# New chunks are encoded together with NUL between them, where that stays a token of its own: no word takes in a NUL, and
# between a solid character and white space it changes no split.
_JOINED = 512


class _Known(dict):
    """Numbers of chunks; a new one gets the next number."""

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        return n


class Encoder:
    """Encodes texts as the tokenizer in the file ``path`` does, without added tokens.

    Where the tokenizer splits at white space before it merges bytes (``ByteLevel`` without a normalizer), chunks between
    blanks are encoded by the library once and remembered, which is exact and several times faster than whole texts.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        # a task has one core, and the library's threads spin while they wait
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        split = found.get("pre_tokenizer") or {}
        self.apart = found.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        vocabulary = found["model"].get("vocab", {})
        # the tokenizer writes byte 0 as U+0100
        self.nul = vocabulary.get("\u0100") if self.apart and sum("\u0100" in word for word in vocabulary) == 1 else None
        self.special = [x["content"] for x in found.get("added_tokens") or []]
        self._forget()

    @staticmethod
    @functools.lru_cache(1)
    def of(path: str) -> Encoder:
        """The one of this process; a worker keeps what it remembers from task to task."""
        return Encoder(path)

    def _forget(self) -> None:
        self.known = _Known()
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, number of ids of each text)``."""
        made = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made))

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks, most of them encoded many at a time."""
        if self.nul is None:
            return self._library([c.decode() for c in chunks])
        solid = lambda c: _PRINTABLE[c[-1]] or _TWO[c[-2]] or _THREE[c[-3]]
        fits = np.array([c[0] in b" \n" and (32 < c[-1] < 127 or c[-1] > 127 and bool(solid(c))) and 0 not in c for c in chunks], bool)
        joined = [c for c, fit in zip(chunks, fits.tolist(), strict=True) if fit]
        ids, _ = self._library([(b"\0".join(joined[k : k + _JOINED]) + b"\0").decode() for k in range(0, len(joined), _JOINED)])
        ends = np.flatnonzero(ids == self.nul)
        size = np.zeros(len(chunks), np.int64)
        size[fits] = np.diff(ends, prepend=-1) - 1
        other, size[~fits] = self._library([c.decode() for c, fit in zip(chunks, fits.tolist(), strict=True) if not fit])
        out = np.zeros(size.sum(), np.uint32)
        own = np.repeat(fits, size)
        out[own], out[~own] = np.delete(ids, ends), other
        return out, size

    def _parts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where chunks begin; every text that is not empty begins one."""
        begins = np.zeros(len(data) + 1, bool)
        if self.apart:
            solid = _PRINTABLE[data]
            solid[1:] |= (data[1:] >= 0x80) & _TWO[data[:-1]]
            solid[2:] |= (data[2:] >= 0x80) & _THREE[data[:-2]] & (data[1:-1] >= 0x80)
            begins[1:-1] = solid[:-1] & ((data[1:] == 32) | (data[1:] == 10))
            body = data.tobytes()
            for found in (m.start() for s in self.special for m in re.finditer(re.escape(s.encode()), body)):
                k = np.searchsorted(offsets, found, side="right")
                begins[offsets[k - 1] : offsets[k]] = False
        begins[offsets] = True
        begins[len(data)] = False
        return np.flatnonzero(begins)

    def __call__(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, number of ids of each text)`` of texts as :func:`texts_of` gives them."""
        begin = self._parts(offsets, data)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        bounds = np.append(begin, len(data)).astype(np.int64)
        own = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        old = len(self.known)
        words = own.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > old:
            made, n = self._chunks(list(itertools.islice(reversed(self.known), len(self.known) - old))[::-1])
            self.ids, self.start = np.concatenate([self.ids, made]), np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
        at = at[own.indices.to_numpy()]
        size = self.start[at + 1] - self.start[at]
        end = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.start[at] - end[:-1], size)
        where += np.arange(end[-1])
        ids = self.ids[where]
        if len(self.known) > KNOWN or len(self.ids) > KNOWN_IDS:
            self._forget()
        return ids, np.diff(end[np.searchsorted(begin, offsets)])


def widths(ids: np.ndarray) -> list[int]:
    """Chunk widths, lowest bits first, that take the fewest bits for ``ids`` with their continuation bits.

    Widths are even and at most 16, so that four codes are whole bytes of one 64-bit word.
    """
    sizes = np.zeros(35, np.int64)
    found, n = np.unique(np.frexp(ids.astype(np.float64))[1], return_counts=True)
    sizes[found] = n
    top = max(int(found[-1]) + 1 if len(found) else 0, 2) // 2 * 2
    over = np.cumsum(sizes[::-1])[::-1]  # over[b]: ids with at least b bits
    best, cut = {top: 0.0}, {}
    for a in range(top - 2, -1, -2):
        there = len(ids) if a == 0 else int(over[a + 1])
        ends = range(a + 2, min(a + 16, top) + 1, 2)
        cost = [there * (b - a + (0 if b == top else 1 + 32 / RANK_BITS)) + best[b] for b in ends]
        best[a], cut[a] = min(cost), ends[int(np.argmin(cost))]
    out, a = [], 0
    while a < top:
        out.append(cut[a] - a)
        a = cut[a]
    return out


def _pack(values: np.ndarray, width: int) -> bytes:
    four = np.zeros((-(-len(values) // 4), 4), np.uint64)
    four.reshape(-1)[: len(values)] = values
    words = four[:, 0].copy()
    for k in (1, 2, 3):
        words |= four[:, k] << np.uint64(k * width)
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width // 2]).tobytes()


def _unpack(data: np.ndarray, width: int, a: int, b: int) -> np.ndarray:
    """Codes ``a`` to ``b``."""
    first, last = a // 4, -(-b // 4)
    words = np.zeros((last - first, 8), np.uint8)
    words[:, : width // 2] = data[first * width // 2 : last * width // 2].reshape(-1, width // 2)
    words, mask = words.view("<u8")[:, 0], np.uint64((1 << width) - 1)
    four = np.stack([(words >> np.uint64(k * width)) & mask for k in range(4)], axis=1)
    return four.reshape(-1)[a - 4 * first : b - 4 * first].astype(np.uint32)


def _bits(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Bits ``a`` to ``b`` of ``data``."""
    return np.unpackbits(data[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a]


def image(ids: np.ndarray) -> bytes:
    """The bytes of a segment: magic, number of levels, then per level its width and number of codes, then per level the
    packed codes (whole groups of four) and, but for the last, the continuation bitmap (whole blocks) and one 32-bit rank a block."""
    parts, heads, rest = [], [], ids.astype(np.uint32)
    wide = widths(rest)
    for k, w in enumerate(wide):
        heads.append(struct.pack("<IQ", w, len(rest)))
        parts.append(_pack(rest & np.uint32((1 << w) - 1), w))
        if k + 1 == len(wide):
            break
        rest = rest >> np.uint32(w)
        goes_on = rest > 0
        blocks = -(-len(rest) // RANK_BITS)
        bits = np.zeros(blocks * RANK_BITS, np.uint8)
        bits[: len(rest)] = goes_on
        ranks = np.concatenate([[0], np.cumsum(bits.reshape(blocks, RANK_BITS).sum(1, dtype=np.int64))[:-1]]) if blocks else np.zeros(0)
        parts += [np.packbits(bits, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()]
        rest = rest[goes_on]
    return _MAGIC + struct.pack("<I", len(wide)) + b"".join(heads) + b"".join(parts)


class Codes:
    """A segment's image, opened without decoding it."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not an image of directly addressable codes")
        (levels,) = struct.unpack_from("<I", data, 4)
        at = 8 + 12 * levels
        self.levels = []
        for k in range(levels):
            width, n = struct.unpack_from("<IQ", data, 8 + 12 * k)
            blocks = -(-n // RANK_BITS) if k + 1 < levels else 0
            sizes = (-(-n // 4) * width // 2, blocks * RANK_BITS // 8, 4 * blocks)
            ends = np.cumsum((at, *sizes)).tolist()
            codes, bits, ranks = (np.frombuffer(data, np.uint8, s, e) for s, e in zip(sizes, ends, strict=False))
            self.levels.append((width, codes, bits, ranks.view("<u4")))
            at = ends[-1]
        self.n = struct.unpack_from("<IQ", data, 8)[1]

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each position: the block's rank and the bits before it in the block."""
        block = at // RANK_BITS
        step = RANK_BITS // 64
        words, inside = bits.view("<u8"), at % RANK_BITS
        out = ranks[block].astype(np.int64)
        for k in range(step):
            left = np.clip(inside - 64 * k, 0, 64).astype(np.uint64)
            mask = np.where(left == 64, np.uint64(2**64 - 1), (np.uint64(1) << (left % np.uint64(64))) - np.uint64(1))
            out += np.bitwise_count(words[block * step + k] & mask).astype(np.int64)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at any positions, in any order."""
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position outside the segment")
        out, left, low = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for width, codes, bits, ranks in self.levels:
            bit = at * width
            value = np.zeros(len(at), np.uint64)
            for k in range(3):
                here = (bit >> 3) + k
                value |= np.where(here < len(codes), codes[np.minimum(here, len(codes) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
            value = (value >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)
            out[left] |= (value << np.uint64(low)).astype(np.uint32)
            low += width
            if not len(ranks):
                break
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            left, at = left[on], self._rank(bits, ranks, at[on])
            if not len(left):
                break
        return out

    def span(self, a: int, b: int) -> np.ndarray:
        """The ids from position ``a`` up to ``b``; of each level only what belongs to them is read."""
        out = np.zeros(max(b - a, 0), np.uint32)
        left, low = None, 0
        for width, codes, bits, ranks in self.levels:
            if b <= a:
                break
            value = _unpack(codes, width, a, b)
            if left is None:
                out, left = value, np.arange(b - a)
            else:
                out[left] |= value << np.uint32(low)
            low += width
            if not len(ranks):
                break
            left = left[_bits(bits, a, b) == 1]
            a = int(self._rank(bits, ranks, np.array([a]))[0])
            b = a + len(left)
        return out


@dataclass
class Store:
    """``segments`` (shard, seq, n_tokens, keys, counts, image) and ``directory`` (shard, seq, n_tokens, start) as written."""

    segments: DataFrame
    directory: DataFrame
    key: str


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, range_bytes: int = RANGE_BYTES) -> Store:
    """Writes the ids of every text, each followed by ``end_id``, in ascending order of ``key``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(1).cast("long"))).head()[0] or 0
    # the last two only part rows that repeat a key
    order = ["key", "hash", "row"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(int(size // range_bytes) + 1, *order).sortWithinPartitions(*order).select("key", "text")
    kind = dealt.schema["key"].dataType

    def make(batches):
        encoder, shard, seq = Encoder.of(path), TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, off, data in texts_of(texts, SEGMENT_BYTES):
                n = len(off) - 1
                ids, count = encoder(off, data)
                ids = np.insert(ids, np.cumsum(count), np.uint32(end_id))
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (keys.slice(at, n), pa.array(count + 1, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([next(seq)], pa.int32()), pa.array([len(ids)], pa.int64()), *lists, pa.array([image(ids)], pa.binary())],
                    names=["shard", "seq", "n_tokens", "keys", "counts", "image"],
                )

    made = dealt.mapInArrow(make, f"shard int, seq int, n_tokens long, keys array<{kind.simpleString()}>, counts array<bigint>, image binary")
    segments = written(made, "segments", compression="none")
    return Store(segments, written(_directory(segments), "directory"), key)


def _directory(segments: DataFrame) -> DataFrame:
    """Positions of first ids: within a range, of ranges within ``RANGES`` of them, and of these, so that no task orders all."""
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w: F.coalesce(F.sum("n_tokens").over(w), F.lit(0).cast("long"))
    sizes = segments.select("shard", "seq", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("many", F.expr(f"shard div {RANGES}"))
    many = shards.groupBy("many").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("one", F.lit(0))
    many = many.select("many", upto(before("one", "many")).alias("many_at"))
    shards = shards.withColumn("shard_at", upto(before("many", "shard"))).join(many, "many").select("shard", (F.col("shard_at") + F.col("many_at")).alias("at"))
    return sizes.withColumn("in", upto(before("shard", "seq"))).join(shards, "shard").select("shard", "seq", "n_tokens", (F.col("at") + F.col("in")).alias("start"))


def read(store: Store, ids: bool = False) -> DataFrame:
    """Every document of the files: key, ``start``, ``n_tokens``, ``ids_crc32`` and, if wanted, ``ids``."""
    kind = store.segments.schema["keys"].dataType.elementType

    def look(batches):
        for batch in batches:
            for shard, seq, keys, counts, data in zip(*(batch.column(k) for k in ("shard", "seq", "keys", "counts", "image")), strict=True):
                own = Codes(data.as_py())
                all_ids = own.span(0, own.n).astype("<u4")
                end = np.cumsum(counts.values.to_numpy())
                at = end - counts.values.to_numpy()
                n = len(end)
                parts = [all_ids[a:b] for a, b in zip(at.tolist(), end.tolist(), strict=True)]
                cols = [pa.array([shard.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), keys.values, pa.array(at, pa.int64()), counts.values, pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["shard", "seq", "key", "at", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    found = store.segments.mapInArrow(look, f"shard int, seq int, key {kind.simpleString()}, at long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if ids else ""))
    out = found.join(store.directory.select("shard", "seq", "start"), ["shard", "seq"])
    return out.select(F.col("key").alias(store.key), (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def ids_at(store: Store, positions: DataFrame, position: str = "position") -> DataFrame:
    """``(position, id)`` for distinct positions of the whole store; those outside it have no row.

    A position meets its segment by cells of the directory; only segments that are wanted are opened, and in these only
    the wanted ids are read, at most ``POSITIONS`` a step.
    """
    cells = store.directory.withColumn("cell", F.explode(F.expr(f"sequence(start div {CELL}, (start + n_tokens - 1) div {CELL})")))
    wanted = positions.select(F.col(position).cast("long").alias("position")).distinct().withColumn("cell", F.expr(f"position div {CELL}"))
    near = wanted.join(cells, "cell").where("position >= start AND position < start + n_tokens").withColumn("at", F.col("position") - F.col("start"))
    asked = near.withColumn("step", F.expr(f"at div {POSITIONS}")).groupBy("shard", "seq", "step").agg(F.collect_list(F.struct("position", "at")).alias("asked"))
    both = store.segments.select("shard", "seq", "image").join(asked, ["shard", "seq"]).select("image", "asked.position", "asked.at")

    def look(batches):
        for batch in batches:
            for data, where, at in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([where.values, pa.array(Codes(data.as_py()).get(at.values.to_numpy()), pa.int64())], names=["position", "id"])

    return both.mapInArrow(look, "position long, id long")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents with the byte-level vocabulary, written and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(encode(docs, public_tokenizers.path("byte_bpe_50k.json")))
