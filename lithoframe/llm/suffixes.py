"""Removal of repeated passages by a distributed merge sort of suffixes that keeps common prefixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Texts are UTF-8
bytes (null: empty), strings never cross documents and are judged on the input.

Which suffixes are sorted: every window of ``length`` bytes has a minimizer, the leftmost smallest hash of its 24-byte
strings, at the same place in every copy. Only suffixes at minimizers ("anchors") are sorted, with the bytes to their
left as context, and of these only the ones whose first 24 bytes occur in two documents.

1. Documents are packed into chunks of some megabytes, written once, in order of id within a chunk.
2. Chunks send delta-coded sorted hashes of their anchors; each hash range says which occur in two documents.
3. Chunks sort the suffixes at those anchors into runs. Copies within a chunk are settled there: only those of the
   smallest id go on. Runs are exchanged front-coded: each suffix as the length of the prefix that it shares with the
   one before it, and the rest.
4. Runs are merged by a loser tree that keeps each run's common prefix with the last winner. Of two candidates the
   one with the longer common prefix is smaller, unseen; equal ones are compared behind it; no known byte is read again.
   Neighbours' common prefixes and left contexts then say which windows a smaller id has.
   Anchors whose first 24 bytes are very common ("hot") are not sorted, as all of them would meet in one range: their
   windows are compared instead, each whole, and dealt by a hash of all its bytes. Each chunk settles copies of a window
   of its own and sends those of its smallest id.
5. Removed windows go back to the chunks, which cut them out.

Equal ids are one document's rows and never remove each other's bytes; a null id counts as larger than any other.
No step gathers more than a chunk, or a hash range whose number grows with the input; of one anchor hash a range has
``HOT`` entries at most, and of one window as many as there are chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, written

LENGTH = 50
#: Bytes of the strings that anchors begin with.
K = 24
CHUNK_BYTES = 8 << 20
#: Text bytes per hash range, and the fewest ranges.
RANGE_BYTES, LEAST_RANGES = 16 << 20, 64
#: Anchors with one hash, in all chunks, above which their windows are dealt one by one.
HOT = 50_000
_SEGMENT = 1 << 19
#: Windows of hot anchors that a chunk settles in one step.
_WINDOWS = 1 << 18
_LAST = np.iinfo(np.int64).max
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _loosen(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of integers, all first bytes first: small numbers compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)


def _unplanes(raw: np.ndarray, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _pack(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        texts: list[pa.Array] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            nonlocal number, size
            key = np.concatenate(ids)
            order = np.argsort(key, kind="stable")
            raw = [x.as_buffer() for t in texts for x in t]
            lengths = np.array([raw[i].size for i in order], dtype=np.int64)
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(raw[i] for i in order))
            name = (part << 32) + number
            number += 1
            ids.clear(), texts.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([key[order].tobytes()], pa.binary()), pa.array([lengths.tobytes()], pa.binary()), pa.array([body], pa.binary())], names=["chunk", "ids", "lengths", "body"])

        for batch in batches:
            at = 0
            column = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            length = pc.binary_length(column).to_numpy(zero_copy_only=False)
            key = pc.fill_null(batch.column(0), _LAST).to_numpy()
            total = np.cumsum(length)
            while at < batch.num_rows:
                room = chunk_bytes - size + (total[at - 1] if at else 0)
                end = min(max(int(np.searchsorted(total, room, side="right")), at + 1), batch.num_rows)
                ids.append(key[at:end])
                texts.append(column.slice(at, end - at))
                size += int(length[at:end].sum())
                at = end
                if size >= chunk_bytes or at < batch.num_rows:
                    yield chunk()
        if ids:
            yield chunk()

    return run


class Chunk:
    """A chunk's documents, and the anchors of its windows: anchor ``a`` owns the windows that start in ``lo`` to ``hi``."""

    def __init__(self, ids: bytes, lengths: bytes, body: bytes):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, dtype=np.int64))])
        self.data = np.frombuffer(_loosen(body), dtype=np.uint8)

    def anchors(self, length: int) -> None:
        n, w = len(self.data), length - K + 1
        valid = np.zeros(n + 1, dtype=np.int8)
        long = np.diff(self.offsets) >= length
        valid[self.offsets[:-1][long]] = 1
        valid[self.offsets[1:][long] - length + 1] = -1
        valid = np.cumsum(valid, dtype=np.int8)[:n].astype(bool)
        owner = np.zeros(n, dtype=np.uint32)
        for begin in range(0, max(n - length + 1, 0), _SEGMENT):
            end = min(begin + _SEGMENT, n - length + 1)
            raw = self.data[begin : end + length - 1]
            words = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw.tobytes(), strides=(1,))
            m = len(raw) - K + 1
            x = words[:m] * _C[0]
            x ^= x >> np.uint64(32)
            x += words[8 : 8 + m]
            x *= _C[1]
            x ^= x >> np.uint64(29)
            x += words[16 : 16 + m]
            x *= _C[2]
            x &= np.uint64(0xFFFFFFFF00000000)
            x |= np.arange(begin, begin + m, dtype=np.uint64)
            have = 1
            while have * 2 <= w:
                x = np.minimum(x[:-have], x[have:])
                have *= 2
            if have < w:
                x = np.minimum(x[: len(x) - (w - have)], x[w - have :])
            owner[begin:end] = x.astype(np.uint32)  # the low half is the place
        first = valid.copy()
        first[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1]
        self.lo = np.flatnonzero(first)
        ends = valid.copy()
        ends[:-1] &= (owner[1:] != owner[:-1]) | ~valid[1:]
        self.hi = np.flatnonzero(ends)
        self.a = owner[self.lo].astype(np.int64)
        self.doc = np.searchsorted(self.offsets, self.lo, side="right") - 1
        if len(self.a):
            words = np.ndarray(n - 7, dtype="<u8", buffer=self.data.tobytes(), strides=(1,))
            self.hash = mix64(mix64(mix64(words[self.a]) + words[self.a + 8]) + words[self.a + 16]) >> np.uint64(24)
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    def distinct(self):
        """Distinct 40-bit hashes of anchors, ascending, whether several ids have each, and how many anchors."""
        order = np.lexsort((self.ids[self.doc], self.hash))
        h, who = self.hash[order], self.ids[self.doc][order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(h)) - 1
        return h[start], who[start] != who[last] if len(h) else np.zeros(0, bool), last - start + 1


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a 40-bit hash; monotone in the hash."""
    return ((h >> np.uint64(8)) * np.uint64(ranges)) >> np.uint64(32)


def _hashes(length: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                c = Chunk(*parts)
                c.anchors(length)
                h, several, times = c.distinct()
                cut = np.searchsorted(_range_of(h, ranges), np.arange(ranges + 1))
                keys, blobs = [], []
                for r in np.flatnonzero(np.diff(cut)):
                    own = h[cut[r] : cut[r + 1]]
                    keys.append(int(r))
                    n = times[cut[r] : cut[r + 1]]
                    blobs.append(_squeeze(_planes(np.diff(own, prepend=np.uint64(0))), np.packbits(several[cut[r] : cut[r + 1]]), np.packbits(n > 1), n[n > 1].astype(np.uint32)))
                    keys[-1] = (int(r), len(own))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in keys], pa.int64()), pa.array([name] * len(keys), pa.int64()), pa.array([n for _, n in keys], pa.int64()), pa.array(blobs, pa.binary())], names=["range", "chunk", "n", "blob"]
                    )

    return run


def _shared(hot: int):
    """Of one hash range: for each chunk, a bit per hash, set if two documents have it, and then one set if it is hot."""

    def run(group: pa.Table) -> pa.Table:
        chunks, sizes = group["chunk"].to_pylist(), group["n"].to_pylist()
        hashes, several, times = [], [], []
        for n, blob in zip(sizes, group["blob"].to_pylist(), strict=True):
            raw = np.frombuffer(_loosen(blob), dtype=np.uint8)
            hashes.append(np.cumsum(_unplanes(raw[: 8 * n], np.uint64), dtype=np.uint64))
            bits = -(-n // 8)
            several.append(np.unpackbits(raw[8 * n : 8 * n + bits], count=n).astype(bool))
            times.append(np.ones(n, dtype=np.int64))
            times[-1][np.unpackbits(raw[8 * n + bits : 8 * n + 2 * bits], count=n).astype(bool)] = np.frombuffer(raw[8 * n + 2 * bits :].tobytes(), np.uint32)
        h, flag, count = np.concatenate(hashes), np.concatenate(several), np.concatenate(times)
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h), dtype=bool)
        same[1:] = h[order][1:] == h[order][:-1]
        first = np.flatnonzero(~same)
        many = np.zeros(len(h), dtype=bool)
        many[order] = np.repeat(np.add.reduceat(count[order], first) > hot, np.diff(first, append=len(h)))
        same[:-1] |= same[1:]
        flag[order] |= same
        # a chunk has each hash once, so a hash that is there twice is in two chunks, and documents do not cross chunks
        cut = np.concatenate([[0], np.cumsum(sizes)])
        some = [i for i in range(len(chunks)) if flag[cut[i] : cut[i + 1]].any()]
        bits = []
        for i in some:
            of = many[cut[i] : cut[i + 1]]
            bits.append(np.packbits(flag[cut[i] : cut[i + 1]]).tobytes() + (np.packbits(of).tobytes() if of.any() else b""))
        return pa.table({"chunk": pa.array([chunks[i] for i in some], pa.int64()), "range": pa.array([group["range"][0].as_py()] * len(some), pa.int64()), "bits": pa.array(bits, pa.binary())})

    return run


def _cut_windows(start: np.ndarray, count: np.ndarray) -> bytes:
    """Runs of window starts as they go back to a chunk."""
    order = np.argsort(start, kind="stable")
    return np.int64(len(start)).tobytes() + _squeeze(_planes(start[order].astype(np.uint32)), count[order].astype(np.uint8))


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit numbers in the same order."""
    rows = np.hstack([rows, np.zeros((len(rows), -rows.shape[1] % 8), np.uint8)])
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def _least(words: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows, then of ids; and in this order whether a smaller id has the same row."""
    order = np.lexsort((who, *words.T[::-1]))
    words, who = words[order], who[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (words[1:] != words[:-1]).any(axis=1)
    return order, who > who[np.flatnonzero(new)][np.cumsum(new) - 1]


def _windows(c: Chunk, name: int, lo: np.ndarray, hi: np.ndarray, who: np.ndarray, length: int, ranges: int) -> list[tuple]:
    """Windows that start in ``lo`` to ``hi``, dealt by their bytes to ranges behind the others, and those that the chunk settles."""
    rows = []
    end = np.cumsum(hi - lo + 1)
    for k in range(0, int(end[-1]) if len(end) else 0, _WINDOWS):
        nth = np.arange(k, min(k + _WINDOWS, int(end[-1])))
        e = np.searchsorted(end, nth, side="right")
        start, own = hi[e] + 1 - (end[e] - nth), who[e]
        words = _words(c.data[start[:, None] + np.arange(length)])
        order, mine = _least(words, own)
        start, own, words = start[order], own[order], words[order]
        if mine.any():
            rows.append((ranges + int(start[0]) % ranges, name, 1, 0, _cut_windows(start[mine], np.ones(mine.sum(), np.int64))))
        start, own, words = start[~mine], own[~mine], words[~mine]
        code = np.zeros(len(words), dtype=np.uint64)
        for x in words.T:
            code = mix64(code * np.uint64(0x100000001B3) + x)
        where = (code % np.uint64(ranges)).astype(np.int64)
        deal = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[deal], np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(bounds)):
            i = deal[bounds[r] : bounds[r + 1]]
            body = c.data[start[i][:, None] + np.arange(length)]
            rows.append((ranges + int(r), name, 2, len(i), _squeeze(body, _planes(own[i]), _planes(start[i].astype(np.uint32)))))
    return rows


def _runs(length: int, ranges: int):
    """Sorted front-coded runs of suffixes for each range, and the windows that the chunk settles itself (range of its own)."""
    w = length - K + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, lengths, body, found in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                c = Chunk(ids, lengths, body)
                c.anchors(length)
                h, _, _ = c.distinct()
                flag, many = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
                cut = np.searchsorted(_range_of(h, ranges), np.arange(ranges + 1))
                for x in found:
                    a, b = cut[x["range"]], cut[x["range"] + 1]
                    bits = np.frombuffer(x["bits"], np.uint8)
                    flag[a:b] = np.unpackbits(bits, count=b - a).astype(bool)
                    if len(bits) > -(-(b - a) // 8):
                        many[a:b] = np.unpackbits(bits[-(-(b - a) // 8) :], count=b - a).astype(bool)
                place = np.searchsorted(h, c.hash)
                at = np.flatnonzero(flag[place])
                if not len(at):
                    continue
                anchor, doc = c.a[at], c.doc[at]
                right = np.minimum(length, c.offsets[doc + 1] - anchor)
                left = np.minimum(w - 1, anchor - c.offsets[doc])
                steps = np.arange(length)
                suffix = np.where(steps < right[:, None], c.data[np.minimum(anchor[:, None] + steps, len(c.data) - 1)], 0).astype(np.uint8)
                back = np.arange(w - 1)
                context = np.where(back < left[:, None], c.data[np.maximum(anchor[:, None] - 1 - back, 0)], 0).astype(np.uint8)
                key = np.hstack([suffix, right[:, None].astype(np.uint8), context, left[:, None].astype(np.uint8)])
                who = c.ids[doc]
                order, mine = _least(_words(key), who)
                who = who[order]
                lo, hi, anchor = c.lo[at][order], c.hi[at][order], anchor[order]
                rows = [(int(c.hash[at[0]] % np.uint64(ranges)), name, 1, 0, _cut_windows(lo[mine], hi[mine] - lo[mine] + 1))] if mine.any() else []
                common = many[place[at]][order]
                keep = np.flatnonzero(~mine & common)
                rows += _windows(c, name, lo[keep], hi[keep], who[keep], length, ranges)
                keep = np.flatnonzero(~mine & ~common)
                where = _range_of(c.hash[at][order][keep], ranges)
                deal = keep[np.argsort(where, kind="stable")]
                bounds = np.searchsorted(np.sort(where), np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(bounds)):
                    e = deal[bounds[r] : bounds[r + 1]]
                    s, n_right = suffix[order[e]], right[order[e]].astype(np.uint8)
                    differ = s[1:] != s[:-1]
                    common = np.zeros(len(e), dtype=np.uint8)
                    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
                    common[1:] = np.minimum(common[1:], np.minimum(n_right[1:], n_right[:-1]))
                    rest = s[(steps >= common[:, None]) & (steps < n_right[:, None])]
                    n_left = left[order[e]].astype(np.uint8)
                    before = context[order[e]][back < n_left[:, None]]
                    places = [anchor[e].astype(np.uint32), (anchor[e] - hi[e]).astype(np.uint8), (anchor[e] - lo[e]).astype(np.uint8)]
                    rows.append((int(r), name, 0, len(e), _squeeze(common, n_right, n_left, *places[1:], _planes(places[0]), _planes(who[e]), rest, before)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["range", "chunk", "kind", "n", "blob"]
                )

    return run


def merge(runs: list[list[bytes]], common: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs: the run and place of each string in order, and its common prefix with the string before.

    ``common[r][i]`` is the prefix that string i of run r shares with string i - 1. The loser of a match keeps its common
    prefix with the winner; a run's next string brings its own with the last winner, which came from that run.
    """
    n = 1
    while n < len(runs):
        n *= 2
    now: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (n - len(runs))
    at = [0] * n
    shared = [0] * n
    loser = [0] * n
    out_run, out_place, out_shared = [], [], []

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' strings, behind what both share with the last winner."""
        x, y = now[a], now[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        i = shared[a]
        if i != shared[b]:
            return (a, b) if i > shared[b] else (b, a)
        most = min(len(x), len(y))
        if x[i:most] == y[i:most]:
            i = most
        else:
            while x[i] == y[i]:
                i += 1
        if i < most and x[i] > y[i] or i == most and len(x) > len(y):
            shared[a] = i
            return b, a
        shared[b] = i
        return a, b

    level = list(range(n))
    size = n
    while size > 1:
        size //= 2
        up = []
        for i in range(size):
            won, lost = play(level[2 * i], level[2 * i + 1])
            loser[size + i] = lost
            up.append(won)
        level = up
    best = level[0]
    while now[best] is not None:
        out_run.append(best)
        out_place.append(at[best])
        out_shared.append(shared[best])
        at[best] += 1
        i = at[best]
        if i < len(runs[best]):
            now[best], shared[best] = runs[best][i], common[best][i]
        else:
            now[best] = None
        node = (best + n) // 2
        while node:
            a, b = best, loser[node]
            # most matches are settled by the known prefixes alone
            x, y = now[a], now[b]
            if x is not None and y is not None and shared[a] != shared[b]:
                if shared[a] < shared[b]:
                    best, loser[node] = b, a
            else:
                best, loser[node] = play(a, b)
            node //= 2
    return out_run, out_place, out_shared


def _settle(length: int):
    """Merges the runs of one range, or compares its windows, and says which windows a smaller id has."""
    w = length - K + 1

    def whole(group: list[tuple[int, int, bytes]], out_chunk: list[int], out_blob: list[bytes]) -> None:
        keys, ids, places = [], [], []
        for _, n, blob in group:
            raw = np.frombuffer(_loosen(blob), dtype=np.uint8)
            keys.append(_words(raw[: length * n].reshape(n, length)))
            ids.append(_unplanes(raw[length * n : (length + 8) * n], np.int64))
            places.append(_unplanes(raw[(length + 8) * n :], np.uint32))
        of = np.repeat(np.arange(len(group)), [n for _, n, _ in group])
        order, gone = _least(np.concatenate(keys), np.concatenate(ids))
        gone = np.sort(order[gone])
        start, of = np.concatenate(places)[gone].astype(np.int64), of[gone]
        bounds = np.searchsorted(of, np.arange(len(group) + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            own = start[bounds[i] : bounds[i + 1]]
            out_chunk.append(group[i][0])
            out_blob.append(_cut_windows(own, np.ones(len(own), np.int64)))

    def run(group: pa.Table) -> pa.Table:
        out_chunk, out_blob = [], []
        names, runs, commons, cols, windows = [], [], [], [], []
        for name, kind, n, blob in zip(*(group[x].to_pylist() for x in ("chunk", "kind", "n", "blob")), strict=True):
            if kind == 2:
                windows.append((name, n, blob))
                continue
            if kind:
                out_chunk.append(name)
                out_blob.append(blob)
                continue
            raw = np.frombuffer(_loosen(blob), dtype=np.uint8)
            common, right, left, near, far = raw[: 5 * n].reshape(5, n)
            anchor, who = _unplanes(raw[5 * n : 9 * n], np.uint32), _unplanes(raw[9 * n : 17 * n], np.int64)
            tail = right.astype(np.int64) - common
            rest_end = np.cumsum(tail) + 17 * n
            body = raw.tobytes()
            strings, last = [], b""
            for i, j, k in zip(common.tolist(), (rest_end - tail).tolist(), rest_end.tolist(), strict=True):
                last = last[:i] + body[j:k]
                strings.append(last)
            before = np.zeros((n, w - 1), dtype=np.uint8)
            before[np.arange(w - 1) < left[:, None]] = raw[rest_end[-1] :]
            names.append(name)
            runs.append(strings)
            commons.append(common.tolist())
            cols.append((right, left, near, far, anchor, who, before))
        if windows:
            whole(windows, out_chunk, out_blob)
        if runs:
            r, p, shared = (np.array(x, dtype=np.int64) for x in merge(runs, commons))
            base = np.concatenate([[0], np.cumsum([len(x) for x in runs])])
            flat = base[r] + p
            right, left, near, far, anchor, who, before = (np.concatenate([c[i] for c in cols])[flat] for i in range(7))
            codes = np.zeros((len(flat), w), dtype=np.uint64)
            for o in range(1, w):
                codes[:, o] = mix64(codes[:, o - 1] * np.uint64(0x100000001B3) + before[:, o - 1] + np.uint64(1))
            group_start = shared < K
            group_of = np.cumsum(group_start) - 1
            starts = np.flatnonzero(group_start)
            like = np.zeros(len(flat), dtype=bool)
            like[1:] = (shared[1:] == right[1:]) & (right[1:] == right[:-1]) & (left[1:] == left[:-1]) & (before[1:] == before[:-1]).all(axis=1)
            uniform = np.logical_and.reduceat(like | group_start, starts)[group_of]
            least = np.minimum.reduceat(who, starts)
            full = uniform & (who > least[group_of])
            taken = [(r[full], anchor[full].astype(np.int64) - far[full], far[full].astype(np.int64) - near[full] + 1)]
            odd = np.flatnonzero(~uniform)
            if len(odd):
                # blocks of suffixes that share at least `length - o` bytes; neighbours that were left out end every block
                link = np.minimum(shared[odd], np.where(np.diff(odd, prepend=-2) == 1, length, 0))
                for o in range(w):
                    block = np.cumsum(link < length - o)
                    fit = np.flatnonzero((right[odd] >= length - o) & (left[odd] >= o))
                    if len(fit) < 2:
                        continue
                    e = odd[fit]
                    order = np.lexsort((who[e], codes[e, o], block[fit]))
                    e, b = e[order], block[fit][order]
                    new = np.ones(len(e), dtype=bool)
                    new[1:] = (b[1:] != b[:-1]) | (codes[e[1:], o] != codes[e[:-1], o])
                    first = who[e[np.flatnonzero(new)]][np.cumsum(new) - 1]
                    gone = e[(who[e] > first) & (near[e] <= o) & (o <= far[e])]
                    taken.append((r[gone], anchor[gone].astype(np.int64) - o, np.ones(len(gone), dtype=np.int64)))
            where, start, count = (np.concatenate(x) for x in zip(*taken, strict=True))
            for i in np.unique(where):
                own = where == i
                out_chunk.append(names[i])
                out_blob.append(_cut_windows(start[own], count[own]))
        return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "blob": pa.array(out_blob, pa.binary())})

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, lengths, body, found in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                c = Chunk(ids, lengths, body)
                n = len(c.data)
                edge = np.zeros(n + 1, dtype=np.int32)
                for blob in found or ():
                    k = int(np.frombuffer(blob[:8], np.int64)[0])
                    raw = np.frombuffer(_loosen(blob[8:]), dtype=np.uint8)
                    start, count = _unplanes(raw[: 4 * k], np.uint32).astype(np.int64), raw[4 * k :].astype(np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + count - 1 + length, -1)
                gone = np.cumsum(edge[:n]) > 0
                turns = np.zeros(n + 1, dtype=bool)
                turns[:n] = gone
                turns[1:n] ^= gone[:-1]
                # windows lie within documents, but one document's cut may touch the next one's
                inner = c.offsets[1:-1][c.offsets[1:-1] < n]
                begins = turns[:n] & gone
                begins[inner] = gone[inner]
                begin = np.flatnonzero(begins)
                stops = gone.copy()
                stops[:-1] &= ~gone[1:]
                inner = inner[inner > 0] - 1
                stops[inner] = gone[inner]
                end = np.flatnonzero(stops) + 1
                cut = np.searchsorted(begin, c.offsets)
                kept = [c.data[a:b][~gone[a:b]].tobytes() for a, b in zip(c.offsets[:-1], c.offsets[1:], strict=True)]
                base = np.repeat(c.offsets[:-1], np.diff(cut))
                spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["begin", "end"]))
                key = pa.array(c.ids, mask=c.ids == _LAST)
                yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(c.offsets)), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def sorted_runs(chunks: DataFrame, length: int, ranges: int) -> DataFrame:
    """What chunks send to each ``range``: sorted runs (kind 0), windows that they settle (1), windows of hot anchors (2)."""
    hashes = chunks.mapInArrow(_hashes(length, ranges), "range long, chunk long, n long, blob binary")
    bits = hashes.groupBy("range").applyInArrow(_shared(HOT), "chunk long, range long, bits binary")
    bits = bits.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits")).alias("found"))
    return chunks.join(bits, "chunk").select("chunk", "ids", "lengths", "body", "found").mapInArrow(_runs(length, ranges), "range long, chunk long, kind long, n long, blob binary")


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``key``, ``n_bytes``, ``spans`` (removed byte ranges, begin and end) and ``kept`` (remaining bytes) for every row."""
    if not 32 <= length <= 80:
        raise ValueError("length must be from 32 to 80 bytes")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    chunks = written(rows.mapInArrow(_pack(CHUNK_BYTES), "chunk long, ids binary, lengths binary, body binary"), "chunks")
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    ranges = max(LEAST_RANGES, -(-total // RANGE_BYTES))
    runs = sorted_runs(chunks, length, ranges)
    cuts = runs.groupBy("range").applyInArrow(_settle(length), "chunk long, blob binary")
    cuts = cuts.groupBy("chunk").agg(F.collect_list("blob").alias("found"))
    whole = chunks.join(cuts, "chunk", "left").select("chunk", "ids", "lengths", "body", "found")
    out = whole.mapInArrow(_cut(length), "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
    return out.withColumnRenamed("doc_id", key)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's repeated 50-byte strings cut out."""
    out = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
