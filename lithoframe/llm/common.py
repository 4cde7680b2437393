"""What several training-data operators share: shared-folder tables and vectorised text access.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes; only A-Z are lower-cased.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at most, unless a single text is longer.
SLICE_BYTES = 1 << 20

#: At most so many keys are hot, a key only with so many rows, and its rows are dealt over so many parts.
HOT_KEYS, LEAST_HOT, SALTS = 1000, 1000, 64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# odd constants of the 64-bit mixers
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new local one only where that is unset and Spark runs on this machine alone."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder; cuts lineage and survives lost executors.

    Results may read it until they are used, so it stays; :func:`clear` removes all tables of the application.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that the application has written; results that read them cannot be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hot_limit(rows: int) -> int:
    """Rows of one key above which it is hot; fewer than ``HOT_KEYS`` keys have so many."""
    return max(LEAST_HOT, rows // HOT_KEYS)


def hot_keys(counts: DataFrame, rows: int) -> list:
    """The keys of ``counts(key, n)`` that are hot in a table of so many rows, at most ``HOT_KEYS``."""
    if rows <= LEAST_HOT:
        return []
    found = [r[0] for r in counts.where(F.col(counts.columns[1]) > hot_limit(rows)).collect()]
    return [bytes(x) if isinstance(x, bytearray) else x for x in found]


def met(left: DataFrame, right: DataFrame, key: str, hot: list, spread: str) -> DataFrame:
    """The inner join on ``key``, where rows of ``left`` with a ``hot`` key are dealt by ``spread`` over ``SALTS`` parts.

    ``hot`` is from :func:`hot_keys`. Their rows of ``right``, where a key is rare, are repeated for each part.
    """
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    a = left.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    parts = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return a.join(right.withColumn("_part", F.explode(parts)), [key, "_part"]).drop("_part")


def bounded(df: DataFrame, by: str, most: int) -> DataFrame:
    """The ``most`` rows of ``df`` with the smallest 64-bit hashes ``by``, which are distinct.

    A threshold from the count leaves about twice as many rows before any are ordered, so tasks send few rows each.
    """
    n = df.count()
    if n > 2 * most:
        df = df.where(F.col(by) < int(-(2**63) + 2**64 * (2 * most / n)))
    return df.orderBy(by).limit(most)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay small, so that Python workers need little memory.

    The setting is read when a result is used, so it holds for the session from then on.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def texts_of(column: pa.Array, max_bytes: int = SLICE_BYTES):
    """Yield ``(first_row, offsets, bytes)`` for runs of rows of about ``max_bytes``; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, off_buf, data_buf = column.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, off[at : end + 1] - off[at], data[off[at] : off[end]]
        at = end


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def span_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`span_codes` hashes any span of ``data``."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def span_codes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes have equal hashes wherever they are."""
    return mix64((total[end] - total[start]) * _powers(len(total))[1][start])


def words_of(offsets: np.ndarray, data: np.ndarray, lower: bool = True):
    """Words of several texts: ``(hash, first_word)``; text k has the words first_word[k] to first_word[k + 1].

    The 64-bit hash is a polynomial of the word's bytes modulo 2**64, mixed; starts and ends are byte positions.
    """
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~_SPACE[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    stops = inside[:n] & ~inside[1:]
    cut = edges[edges > 0] - 1
    stops[cut] = inside[cut]
    end = np.flatnonzero(stops) + 1
    code = span_codes(span_sums(data), start, end)
    return code, np.searchsorted(start, offsets), start, end


def shingles_of(code: np.ndarray, first: np.ndarray, k: int):
    """``(hash, text)`` of each k-word shingle in order; a text with 1 to k-1 words has its whole sequence as one."""
    n = len(code)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    value = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        value[: n - i] = mix64(value[: n - i] * np.uint64(0x100000001B3) + code[i:] + np.uint64(i + 1)) if n > i else value[: n - i]
    at = np.arange(n) - first[:-1][text]
    full = at + k <= count[text]
    out_v, out_t = value[full], text[full]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = []
        for t in short:
            h = np.full(1, 0x5851F42D4C957F2D, dtype=np.uint64)
            for w in code[first[t] : first[t + 1]]:
                h = mix64(h * np.uint64(0x100000001B3) + w)
            own.append(h[0])
        out_v, out_t = np.concatenate([out_v, np.array(own, np.uint64)]), np.concatenate([out_t, short])
        order = np.argsort(out_t, kind="stable")
        out_v, out_t = out_v[order], out_t[order]
    return out_v, out_t


def sequences_of(code: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words, across texts too, as :func:`shingles_of` hashes a text of so few words."""
    value = np.full(max(len(code) - n + 1, 0), 0x5851F42D4C957F2D, dtype=np.uint64)
    for i in range(n):
        value = mix64(value * np.uint64(0x100000001B3) + code[i : i + len(value)])
    return value
