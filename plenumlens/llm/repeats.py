"""Removing passages that repeat, by a hash-compared suffix sort.

Every byte goes that lies in a string of ``LENGTH`` bytes which also starts somewhere else.

1. Each window of that length has an anchor: of the short strings in it the one of least hash.
   Equal windows have equal anchors at equal places, so that only occurrences of one anchor need
   be compared, and one byte in 77 or so is an anchor.
2. Anchors that occur once are left out. Of the others, the bytes around them that their windows
   cover travel to the task of the anchor's hash.
3. There the occurrences of an anchor are sorted by what follows it, and by what precedes it,
   with a mergesort that compares two suffixes by binary search on prefix hashes. Neighbours'
   common lengths are checked byte by byte. Two windows are equal if they agree far enough to
   the right and to the left, that is, if they are in one class of both orders.
4. Anchors with more than ``GATHERED`` occurrences are in no task's hands as a whole: occurrences
   with the same bytes around them are counted as one, and the windows of what is left are dealt
   and counted by the SHA-256 of their bytes. A task sends each of its surroundings once, with all
   the places where its texts have it, and gets one row of spans for each text back.

Distinct texts are what is compared; of texts that occur more often every string repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumlens.llm.jaccard import text_keys
from plenumlens.llm.tables import BATCH_ROWS, mix64, settled, small_batches, text_bytes

LENGTH = 200
ANCHOR = 48
#: Bytes of texts, and occurrences of anchors, that are worked on at once.
SLICE = 1 << 20
SORTED = 12_000
#: Occurrences of an anchor that one task sorts at most.
GATHERED = 12_000
#: Bits of an anchor's hash that give way to its place: fixed, so that a window has the same anchor in any buffer.
PLACE_BITS = np.uint64(32)

TEXT = "k1 long, k2 long, text binary"
SPOT = "h long, k1 long, k2 long, pos long, low int, high int"
AROUND = "h long, k1 long, k2 long, pos long, low int, high int, left int, around binary"
PACK = "h long, low int, high int, around binary, n long, spots array<struct<k1:long,k2:long,pos:long>>, origin long"
SPANS = "k1 long, k2 long, spans array<struct<first:long,last:long>>"
SPAN = "k1 long, k2 long, first long, last long"


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        out = np.full(n, b, np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


#: A random 64-bit number for each byte, from the mixing function.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def window_anchors(buffer: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchors of all windows within the texts of a buffer (texts end at ``ends``).

    Returns position, hash, and the least and greatest distance from the start of a window that
    has the anchor. Each window of a text belongs to one anchor, the leftmost of equal hashes.
    """
    none = np.empty(0, np.int64)
    n, reach = len(buffer), length - anchor + 1
    if n < length:
        return none, none.astype(np.uint64), none, none
    up, down = _powers(1 << max(20, int(n).bit_length()))
    summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buffer] * up[:n], dtype=np.uint64)))
    hashes = mix64((summed[anchor:] - summed[:-anchor]) * down[:n - anchor + 1])
    bits = PLACE_BITS  # a buffer has less than 4 GB
    ranked = hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)
    blocks = -(-len(ranked) // reach)
    wide = np.full(blocks * reach, np.iinfo(np.uint64).max, np.uint64)
    wide[: len(ranked)] = ranked
    wide = wide.reshape(blocks, reach)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1]).ravel()
    least = np.minimum(behind[: n - length + 1], ahead[reach - 1: n - length + reach])
    inside = np.ones(n - length + 1, bool)
    for end in ends[:-1]:
        inside[max(0, end - length + 1):end] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none.astype(np.uint64), none, none
    where = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-1))
    last = np.append(first[1:], len(where)) - 1
    spots = where[first]
    return spots, hashes[spots], spots - starts[last], spots - starts[first]


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    first = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int]], pa.RecordBatch]]:
    """Of each batch, the rows whose key the task hasn't had."""
    seen: set[tuple[int, int]] = set()
    for batch in settled(batches):
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        new = []
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                new.append(i)
        if new:
            yield [keys[i] for i in new], batch.take(pa.array(new, pa.int64()))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, batch in _fresh(batches):
        yield batch


def _anchorer(length: int):
    anchor = max(1, min(ANCHOR, length // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, batch in _fresh(batches):
            texts = batch.column(2).to_pylist()
            sizes = [len(t) for t in texts]
            for a, b in _slices(sizes, SLICE):
                ends = np.cumsum(sizes[a:b])
                spots, hashes, low, high = window_anchors(np.frombuffer(b"".join(texts[a:b]), np.uint8), ends, length, anchor)
                if not len(spots):
                    continue
                doc = np.searchsorted(ends, spots, "right")
                k = np.array(keys[a:b], np.int64)[doc]
                pos = spots - np.concatenate(([0], ends[:-1]))[doc]
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes.view(np.int64)), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(pos.astype(np.int64)),
                    pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["h", "k1", "k2", "pos", "low", "high"])

    return run


def _surrounder(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, batch in _fresh(batches):
            for key, text, spots in zip(keys, batch.column(2).to_pylist(), batch.column(3), strict=True):
                flat = spots.values.flatten()
                h, pos, low, high = (c.to_numpy(zero_copy_only=False) for c in flat)
                for i in range(0, len(h), BATCH_ROWS):
                    part = slice(i, i + BATCH_ROWS)
                    first = pos[part] - high[part]
                    around = [text[f:p - lo + length] for f, p, lo in zip(first.tolist(), pos[part].tolist(), low[part].tolist(), strict=True)]
                    n = len(around)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h[part]), pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(pos[part]), pa.array(low[part]),
                        pa.array(high[part]), pa.array(high[part]), pa.array(around, pa.binary())],
                        ["h", "k1", "k2", "pos", "low", "high", "left", "around"])

    return run


def _alike(rows: pa.Table) -> np.ndarray:
    """A number for each row of AROUND, the same for equal anchors with equal surroundings, in order of appearance."""
    h, low, high, around = (rows.column(c).to_pylist() for c in ("h", "low", "high", "around"))
    known: dict[tuple, int] = {}
    return np.array([known.setdefault(x, len(known)) for x in zip(h, low, high, around, strict=True)])


def _packer(length: int):
    """Occurrences with equal surroundings as one row, within some thousand at a time."""
    surround = _surrounder(length)

    def pack(rows: pa.Table, place: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        of = _alike(rows)
        n, one = np.bincount(of), pa.array(np.unique(of, return_index=True)[1])
        spots = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in ("k1", "k2", "pos")], ["k1", "k2", "pos"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), spots.take(pa.array(np.argsort(of, kind="stable"))))
        firsts = [rows.column(c).combine_chunks().take(one) for c in ("h", "low", "high", "around")]
        origin = pa.array(np.full(len(one), place))
        return pa.RecordBatch.from_arrays([*firsts, pa.array(n), lists, origin], ["h", "low", "high", "around", "n", "spots", "origin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task, n = TaskContext.get().partitionId() << 32, 0
        for batch in surround(batches):
            held.append(batch)
            if sum(b.num_rows for b in held) >= SORTED:
                yield pack(pa.Table.from_batches(held), task + n)
                held, n = [], n + 1
        if held:
            yield pack(pa.Table.from_batches(held), task + n)

    return run


def _unpacker(length: int):
    """Of the packs of one origin with their runs, one row for each text with its spans."""

    def emit(rows: pa.Table) -> pa.RecordBatch:
        spots = rows.column("spots").combine_chunks()
        runs = [rows.column(c).combine_chunks() for c in ("near", "far")]
        of_spot = np.repeat(np.arange(len(spots)), np.diff(spots.offsets.to_numpy()))
        n_runs = np.diff(runs[0].offsets.to_numpy())
        near, far = (r.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for r in runs)
        k1, k2, pos = (c.to_numpy(zero_copy_only=False) for c in spots.flatten().flatten())
        n = n_runs[of_spot]  # each spot has the runs of its surroundings
        first_run = (np.cumsum(n_runs) - n_runs)[of_spot]
        at = np.repeat(first_run - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        k1, k2, pos = np.repeat(k1, n), np.repeat(k2, n), np.repeat(pos, n)
        first, last = pos - far[at], pos - near[at] + length
        order = np.lexsort((k2, k1))
        k1, k2, first, last = k1[order], k2[order], first[order], last[order]
        begin = np.flatnonzero((np.diff(k1, prepend=0) != 0) | (np.diff(k2, prepend=0) != 0) | (np.arange(len(k1)) == 0))
        merged = [merge_spans(first[a:b], last[a:b]) for a, b in zip(begin, np.append(begin[1:], len(k1)))]
        sizes = np.array([len(m[0]) for m in merged], np.int64)
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate([m[i] for m in merged])) for i in (0, 1)], ["first", "last"])
        return pa.RecordBatch.from_arrays([pa.array(k1[begin]), pa.array(k2[begin]), pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), spans)], ["k1", "k2", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in settled(batches):
            origin = batch.column(0).to_numpy()
            cuts = [0, *np.flatnonzero(np.diff(origin)) + 1, len(origin)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and a < b and held[0].column(0)[0].as_py() != origin[a]:
                    yield emit(pa.Table.from_batches(held))
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield emit(pa.Table.from_batches(held))

    return run


class Suffixes:
    """Byte strings (rows of a matrix, of given lengths), compared by their prefix hashes."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray):
        self.rows, self.sizes = rows, sizes.astype(np.int64)
        m, width = rows.shape
        self.hashes = np.zeros((width + 1, m), np.uint64)
        base = np.uint64(0x9E3779B97F4A7C15)
        for j in range(width):
            self.hashes[j + 1] = (self.hashes[j] + _BYTE[rows[:, j]]) * base
        self.steps = int(width).bit_length()

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the common beginnings, by binary search on the prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.sizes[x], self.sizes[y])
        for _ in range(self.steps):
            mid = (low + high + 1) >> 1
            same = self.hashes[mid, x] == self.hashes[mid, y]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _next(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        inner = np.minimum(at, self.rows.shape[1] - 1)
        return np.where(at < self.sizes[x], self.rows[x, inner].astype(np.int64), -1)

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = self.common(x, y)
        return self._next(x, at) < self._next(y, at)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """The order of the strings within each group (groups are runs of equal numbers): mergesort, all runs at once."""
        m = len(group)
        begin = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
        size = np.diff(np.append(begin, m))
        start, held = np.repeat(begin, size), np.repeat(size, size)
        order, width = np.arange(m), 1
        while width < (size.max() if m else 0):
            i = np.flatnonzero(held > width)
            base, total, place = start[i], held[i], i - start[i]
            run = place // width
            right = run % 2 == 1
            other = np.where(right, run - 1, run + 1) * width
            low = np.minimum(other, total)
            stop = np.minimum(other + width, total)
            first, high = low.copy(), stop.copy()
            x = order[i]
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                mid = (low[live] + high[live]) >> 1
                y, mine = order[base[live] + mid], x[live]
                turned = right[live]
                before = self.less(np.where(turned, mine, y), np.where(turned, y, mine)) ^ turned
                low[live] = np.where(before, mid + 1, low[live])
                high[live] = np.where(before, high[live], mid)
            pair = run // 2 * 2 * width
            merged = order.copy()
            merged[base + pair + place - run * width + low - first] = x
            order, width = merged, width * 2
        return order

    def sorted_common(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and each one's common length with the one before (-1 at the start of a group).

        The lengths are verified on the bytes. If hashes have deceived, the groups are sorted by
        their bytes instead.
        """
        order = self.sort(group)
        with_before = self._lengths(order, group)
        at = np.flatnonzero(with_before >= 0)
        x, y, n = order[at - 1], order[at], with_before[at]
        inside = np.arange(self.rows.shape[1]) < n[:, None]
        differ = ((self.rows[x] != self.rows[y]) & inside).any(1)
        after = (self._next(x, n) > self._next(y, n)) | ((self._next(x, n) == self._next(y, n)) & (n < np.minimum(self.sizes[x], self.sizes[y])))
        if (differ | after).any():
            whole = [self.rows[i, : self.sizes[i]].tobytes() for i in range(len(group))]
            order = np.array(sorted(range(len(group)), key=lambda i: (group[i], whole[i])), np.int64)
            x, y = order[at - 1], order[at]
            equal = (self.rows[x] == self.rows[y]) & (np.arange(self.rows.shape[1]) < np.minimum(self.sizes[x], self.sizes[y])[:, None])
            with_before[at] = np.where(equal.all(1), equal.shape[1], np.argmin(equal, 1))
        return order, with_before

    def _lengths(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        out = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(np.diff(group, prepend=group[:1] - 1) == 0)
        out[at] = self.common(order[at - 1], order[at])
        return out


def repeated_windows(group: np.ndarray, around: list[bytes], left: np.ndarray, low: np.ndarray, high: np.ndarray,
                     times: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows (occurrence x distance from window start to anchor) occur more than once.

    ``group`` are runs of occurrences of one anchor, ``around`` the bytes around it of which
    ``left`` precede it, ``low`` and ``high`` the distances of its windows, ``times`` how often
    exactly this occurrence stands.
    """
    m = len(group)
    reach = int(high.max()) + 1 if m else 1
    flat = np.frombuffer(b"".join(around), np.uint8)
    sizes = np.array([len(a) for a in around], np.int64)
    begin = np.cumsum(sizes) - sizes

    def matrix(first: np.ndarray, n: np.ndarray, width: int, step: int) -> np.ndarray:
        place = np.arange(width)
        at = np.clip(first[:, None] + step * place, 0, max(0, len(flat) - 1))
        return np.where(place < n[:, None], flat[at], 0).astype(np.uint8)

    after = sizes - left
    ahead = Suffixes(matrix(begin + left, after, length, 1), np.minimum(after, length))
    behind = Suffixes(matrix(begin + left - 1, left, max(reach, 1), -1), left)
    order_a, common_a = ahead.sorted_common(group)
    order_b, common_b = behind.sorted_common(group)
    out = np.zeros((m, reach), bool)
    class_a, class_b = np.empty(m, np.int64), np.empty(m, np.int64)
    for distance in range(int(low.min()) if m else 0, reach):
        live = np.flatnonzero((low <= distance) & (distance <= high))
        if not len(live):
            continue
        class_a[order_a] = np.cumsum(common_a < length - distance)
        class_b[order_b] = np.cumsum(common_b < distance)
        both = class_a[live] * (m + 1) + class_b[live]
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.diff(both, prepend=both[:1] - 1))
        many = np.add.reduceat(times[live][order], first) > 1
        out[live[order], distance] = np.repeat(many, np.diff(np.append(first, len(both))))
    return out


def _matcher(length: int):
    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        h, k1, k2, pos, low, high, left = (rows.column(i).to_numpy() for i in range(7))
        around = rows.column(7).to_pylist()
        # equal surroundings are sorted once
        of = _alike(rows)
        one = np.unique(of, return_index=True)[1]
        hit = repeated_windows(h[one], [around[i] for i in one], left[one].astype(np.int64), low[one], high[one], np.bincount(of), length)
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, near = np.nonzero(edge == 1)
        far = np.nonzero(edge == -1)[1] - 1
        # an occurrence has the runs of its surroundings
        runs = np.bincount(row, minlength=len(one))
        n = runs[of]
        begin = (np.cumsum(runs) - runs)[of]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        p = np.repeat(pos, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k1, n)), pa.array(np.repeat(k2, n)), pa.array(p - far[at]),
                                          pa.array(p - near[at] + length)], ["k1", "k2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in settled(batches):
            for part in (batch.slice(i, SORTED) for i in range(0, batch.num_rows, SORTED)):
                held.append(part)
                n += part.num_rows
                if n < SORTED:
                    continue
                rows = pa.Table.from_batches(held)
                h = rows.column(0).to_numpy()
                whole = int(np.flatnonzero(np.diff(h, prepend=h[:1] - 1))[-1])  # the last anchor may go on
                if whole:
                    yield from emit(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
                    n = sum(b.num_rows for b in held)
        if n:
            yield from emit(pa.Table.from_batches(held))

    return run


def merge_spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.append(True, first[1:] > last[:-1]))
    return first[new], last[np.append(new[1:], len(last)) - 1]


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, batch in _fresh(batches):
        out = []
        for (k1, k2), text, spans in zip(keys, batch.column(2).to_pylist(), batch.column(3), strict=True):
            first, last = merge_spans(*(c.to_numpy(zero_copy_only=False) for c in spans.values.flatten()))
            starts, ends = [0, *last.tolist()], [*first.tolist(), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(starts, ends, strict=True))
            out.append((k1, k2, len(text) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)],
            ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])


def _two_hashes(first: str, second: str, *values: Column) -> list[Column]:
    return [F.xxhash64(*values).alias(first), F.xxhash64(F.lit("second"), *values).alias(second)]


def _counted_spans(found: DataFrame, length: int, parts: int) -> DataFrame:
    """The repeated spans (SPANS) of occurrences (PACK) of any number, by counting; no task gathers those of one anchor."""
    packs = found.select(*_two_hashes("s1", "s2", F.col("h"), F.col("low"), F.col("high"), F.col("around")),
                         "low", "high", "around", "n", "spots", "origin")
    # counted before the shuffle; the bytes are a key, so that equal hashes of others aren't counted
    kinds = packs.groupBy("s1", "s2", "low", "high", "around").agg(F.sum("n").alias("n"))
    placed = kinds.select("s1", "s2", "n", "high", "around", F.explode(F.sequence("low", "high")).alias("d"))
    window = F.substring("around", F.col("high") - F.col("d") + 1, F.lit(length))
    windows = placed.select("s1", "s2", "n", "d", F.unhex(F.sha2(window, 256)).alias("w"))
    several = windows.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").select("w")
    # surroundings that stand once have those windows that stand elsewhere too; the others have all
    hit = windows.where("n = 1").join(several, "w").groupBy("s1", "s2").agg(F.array_sort(F.collect_list("d")).alias("d"))
    near = F.array_except("d", F.transform("d", lambda x: x + 1)).alias("near")
    far = F.array_except("d", F.transform("d", lambda x: x - 1)).alias("far")
    runs = kinds.where("n > 1").select("s1", "s2", F.array("low").alias("near"), F.array("high").alias("far")).union(
        hit.select("s1", "s2", near, far))
    # a surrounding has at most one row for each SORTED occurrences here, and one with its runs there
    met = packs.select("s1", "s2", "spots", "origin").join(runs, ["s1", "s2"]).select("origin", "spots", "near", "far")
    return met.repartition(parts, "origin").sortWithinPartitions("origin").mapInArrow(_unpacker(length), SPANS)


def _span_lists(docs: DataFrame, text: str, length: int) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (k1, k2, text), dealt by key, and lists of repeated spans (SPANS), any number for each."""
    small_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = docs.select(*text_keys(text), text_bytes(text).alias("text")).mapInArrow(_once, TEXT)
    # the filter that joins would add, so that all readers share one exchange
    texts = known.where("k1 is not null and k2 is not null").repartition(parts, "k1", "k2")
    anchors = texts.mapInArrow(_anchorer(length), SPOT)
    counts = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("__n"))
    # one in GATHERED anchors at most
    large = F.broadcast(counts.where(F.col("__n") > GATHERED).select("h"))
    several = counts.where(F.col("__n").between(2, GATHERED)).select("h")

    def beside(found: DataFrame) -> DataFrame:
        return texts.join(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "pos", "low", "high")).alias("spots")), ["k1", "k2"])

    small = beside(anchors.join(large, "h", "left_anti").join(several, "h")).mapInArrow(_surrounder(length), AROUND)
    spans = small.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_matcher(length), SPAN)
    single = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return texts, single.union(_counted_spans(beside(anchors.join(large, "h")).mapInArrow(_packer(length), PACK), length, parts))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (k1, k2, text), dealt by key, and their repeated spans (k1, k2, first, last)."""
    texts, lists = _span_lists(docs, text, length)
    return texts, lists.select("k1", "k2", F.inline("spans"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """What is left of each document without its repeated strings of ``length`` bytes.

    Returns key, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left) and, on demand,
    ``kept``. Null texts are empty, texts shorter than ``length`` stay whole, a text that several
    rows have is removed as a whole (if long enough), rows with null or equal keys are separate
    rows, and an empty table gives an empty result. Other columns are left out.
    """
    texts, found = _span_lists(docs, text, length)
    lists = found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cut = texts.join(lists, ["k1", "k2"]).mapInArrow(
        _cutter, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    value = text_bytes(text)
    rows = docs.select(docs[key].alias("id"), *text_keys(text), F.octet_length(value).cast("long").alias("n_bytes"),
                       F.sha2(value, 256).alias("whole"), *([value.alias("bytes")] if with_text else []))
    copies = docs.select(*text_keys(text)).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    found = copies.join(cut if with_text else cut.drop("kept"), ["k1", "k2"], "left")
    joined = rows.join(found, ["k1", "k2"])
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = joined.select(
        F.col("id").alias(key), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", "bytes")).alias("kept")] if with_text else []))
    return out
