"""Byte-level BPE encoding and decoding with segment trees.

A text is cut into pieces by the pattern of the rank file; each piece is merged on its own. The
leaves of a piece's segment tree are its bytes; a leaf that begins a live token holds the rank of
merging this token with the next one, and an inner node the least rank below it and its leftmost
place. A merge takes the root's pair, and updates three leaves: the merged token, the token
before it, and the one that is gone. New short pieces of a batch are merged together, all pieces
of one width in step; long ones one after the other, in n log n steps.

Pieces come again, so a worker keeps the ids of the chunks between blanks it has seen.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenumlens.llm.tables import settled, small_batches

#: Chunks whose ids a worker keeps.
CHUNKS_KEPT = 500_000
#: Characters that are encoded at once.
SLICE = 4 << 20
#: Bytes up to which pieces are merged in step with others.
SHORT = 64

_NONE = np.int64(1) << 40  # the rank of a pair that doesn't merge

#: A blank between two characters that are no white space: a piece always begins there.
_BORDER = regex.compile(r"(?<=\S) (?=\S)")
#: A blank beside other white space or at an end, where splitting at blanks would cut elsewhere.
_LOOSE = regex.compile(r"\s | \s|^ | $")

CODES = "n_tokens long, ids binary"


def runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions first, first + 1... of runs of the given sizes, one after the other."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Ranks:
    """The tokens of a rank file: ids by bytes, bytes by id, and the rank of each pair that merges."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        most = max(self.ids.values()) + 1
        tokens = [b""] * most
        for token, i in self.ids.items():
            tokens[i] = token
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.base = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.most = most

    @cached_property
    def pair(self) -> dict[int, int]:
        """The rank of each pair of tokens that together are one; not needed for decoding."""
        ids, most = self.ids, self.most
        return {ids[t[:k]] * most + ids[t[k:]]: i for t, i in ids.items()
                for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}

    @cached_property
    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.fromiter(self.pair, np.int64, len(self.pair))
        order = np.argsort(keys)
        ranks = np.fromiter(self.pair.values(), np.int64, len(keys))
        return np.append(keys[order], np.iinfo(np.int64).max), np.append(ranks[order], _NONE)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, or ``_NONE``."""
        keys, ranks = self._sorted
        key = a * self.most + b
        at = np.searchsorted(keys, key)
        return np.where(keys[at] == key, ranks[at], _NONE)


def merge_long(data: bytes, ranks: Ranks) -> list[int]:
    """The ids of one piece, by one segment tree."""
    n, none, most, pair = len(data), int(_NONE), ranks.most, ranks.pair
    token = ranks.base[np.frombuffer(data, np.uint8)]
    width = 1 << max(n - 1, 1).bit_length()
    leaf = np.full(width, _NONE, np.int64)
    leaf[:n - 1] = ranks.of_pairs(token[:-1], token[1:])
    level = leaf * width + np.arange(width)  # the least rank, then the leftmost place
    levels = [level]
    while len(level) > 1:
        level = np.minimum(level[::2], level[1::2])
        levels.append(level)
    tree = [0, *np.concatenate(levels[::-1]).tolist()]
    token = token.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, rank: int) -> None:
        node = width + place
        tree[node] = rank * width + place
        while node > 1:
            a, b = tree[node & ~1], tree[node | 1]
            node >>= 1
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least

    while True:
        rank, place = divmod(tree[1], width)
        if rank >= none:
            break
        gone = after[place]
        token[place] = rank
        token[gone] = -1
        following = after[place] = after[gone]
        put(gone, none)
        if following < n:
            before[following] = place
            put(place, pair.get(rank * most + token[following], none))
        else:
            put(place, none)
        if before[place] >= 0:
            put(before[place], pair.get(token[before[place]] * most + rank, none))
    return [t for t in token if t >= 0]


def merge_short(rows: np.ndarray, sizes: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces of one width, and their numbers: one segment tree a row, merged in step.

    ``rows`` holds the bytes of each piece, padded to a power of two; ``sizes`` their numbers.
    """
    m, width = rows.shape
    place = np.arange(width)
    token = ranks.base[rows]
    token[place >= sizes[:, None]] = -1
    tree = np.empty((m, 2 * width), np.int64)
    leaf = np.full((m, width), _NONE)
    there = place[:-1] < sizes[:, None] - 1
    a, b = np.nonzero(there)
    leaf[a, b] = ranks.of_pairs(token[a, b], token[a, b + 1])
    tree[:, width:] = leaf * width + place
    half = width
    while half > 1:
        tree[:, half // 2:half] = np.minimum(tree[:, half:2 * half:2], tree[:, half + 1:2 * half:2])
        half //= 2
    after = np.broadcast_to(place + 1, (m, width)).copy()
    before = np.broadcast_to(place - 1, (m, width)).copy()
    live = np.flatnonzero(tree[:, 1] < _NONE * width)
    while len(live):
        rank, at = np.divmod(tree[live, 1], width)
        gone = after[live, at]
        token[live, at] = rank
        token[live, gone] = -1
        following = after[live, gone]
        after[live, at] = following
        inside = following < sizes[live]
        own = np.full(len(live), _NONE)
        r, f, p = live[inside], following[inside], at[inside]
        before[r, f] = p
        own[inside] = ranks.of_pairs(rank[inside], token[r, f])
        _put(tree, width, live, gone, np.full(len(live), _NONE))
        _put(tree, width, live, at, own)
        prior = before[live, at]
        led = prior >= 0
        r, p = live[led], prior[led]
        _put(tree, width, r, p, ranks.of_pairs(token[r, p], rank[led]))
        live = live[tree[live, 1] < _NONE * width]
    kept = token >= 0
    return token[kept], kept.sum(axis=1)


def _put(tree: np.ndarray, width: int, rows: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> None:
    """Set one leaf of each row's tree, and the nodes above it."""
    node = width + places
    tree[rows, node] = ranks * width + places
    while width > 1:
        low = node & ~1
        least = np.minimum(tree[rows, low], tree[rows, low + 1])
        node = node >> 1
        tree[rows, node] = least
        width >>= 1


def merged(pieces: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces, one after the other, and the number of each piece's ids.

    A piece that is a token is this token, whether or not merges lead to it.
    """
    sizes = np.zeros(len(pieces), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    of_width: dict[int, list[int]] = {}
    whole, long = [], []
    for i, piece in enumerate(pieces):
        if piece in ranks.ids:
            whole.append(i)
        elif len(piece) > SHORT:
            long.append(i)
        elif piece:
            of_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    if whole:
        sizes[whole] = 1
        found.append((np.array(whole), np.array([ranks.ids[pieces[i]] for i in whole], np.int64)))
    for width, members in of_width.items():
        lengths = np.array([len(pieces[i]) for i in members])
        rows = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in members), np.uint8).reshape(-1, width)
        ids, n = merge_short(rows, lengths, ranks)
        sizes[members] = n
        found.append((np.array(members), ids))
    for i in long:
        ids = merge_long(pieces[i], ranks)
        sizes[i] = len(ids)
        found.append((np.array([i]), np.array(ids, np.int64)))
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint32)
    for members, ids in found:
        out[runs(first[members], sizes[members])] = ids
    return out, sizes


class _Chunks(dict):
    """Numbers of chunks (a str stands with a blank before it, a tuple as it is), and their ids."""

    def __init__(self):
        super().__init__()
        self.size = 0
        self.new: list[str] = []
        self.first = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def __missing__(self, chunk) -> int:
        number = self.size
        self.size = number + 1
        if type(chunk) is tuple:
            self.new.append(chunk[0])
        else:
            self[chunk] = number
            self.new.append(" " + chunk)
        return number


class Codec:
    """Encodes texts by a rank file and a pattern, and decodes ids."""

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self.pieces = regex.compile(pattern).findall
        self.chunks = _Chunks()

    def _learn(self) -> None:
        """Cut the waiting chunks into pieces, and merge each different piece once."""
        known = self.chunks
        numbers: dict[str, int] = {}
        of: list[int] = []
        ends: list[int] = []
        for chunk in known.new:
            for piece in self.pieces(chunk):
                of.append(numbers.setdefault(piece, len(numbers)))
            ends.append(len(of))
        known.new = []
        ids, sizes = merged([p.encode() for p in numbers], self.ranks)
        first = np.cumsum(sizes) - sizes
        at = np.array(of, np.int64)
        known.ids = np.concatenate([known.ids, ids[runs(first[at], sizes[at])]])
        spread = np.concatenate([[0], np.cumsum(sizes[at])])
        known.first = np.concatenate([known.first, known.first[-1] + spread[np.array(ends, np.int64)]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one after the other, and each text's number of ids."""
        if self.chunks.size > CHUNKS_KEPT:
            self.chunks = _Chunks()
        number = self.chunks.__getitem__
        plan: list[int] = []
        counts = []
        for text in texts:
            head, *rest = _BORDER.split(text) if _LOOSE.search(text) else text.split(" ")
            plan.append(number((head,)))
            plan.extend(map(number, rest))
            counts.append(1 + len(rest))
        if not plan:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        known = self.chunks
        if known.new:
            self._learn()
        at = np.array(plan, np.int64)
        sizes = known.first[at + 1] - known.first[at]
        counts = np.array(counts)
        return known.ids[runs(known.first[at], sizes)], np.add.reduceat(sizes, np.cumsum(counts) - counts)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        first = self.ranks.first
        return self.ranks.bytes[runs(first[ids], first[ids.astype(np.int64) + 1] - first[ids])]


@lru_cache(maxsize=1)
def _codec(path: str, pattern: str) -> Codec:
    """The codec of this worker; what it has learnt serves the worker's next tasks too."""
    return Codec(path, pattern)


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold some SLICE units, or one row that alone holds more."""
    first = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= SLICE:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in settled(batches):
            texts = batch.column(1).to_pylist()
            for a, b in _slices([len(t) for t in texts]):
                ids, sizes = codec.encode(texts[a:b])
                edges = np.concatenate([[0], np.cumsum(sizes)])
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((4 * edges).astype(np.int64)),
                                                                                     pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), packed.cast(pa.binary())],
                                                 ["key", "n_tokens", "ids"])

    return run


def with_ids(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, ids): the ids of each whole text as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Every row has its own result, whether ids repeat or are null;
    other columns are left out. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(docs[key].alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(_encoder(path, pattern), f"key {dict(plain.dtypes)['key']}, {CODES}").withColumnRenamed("key", key)


def _decoder(path: str, pattern: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in settled(batches):
            packed = batch.column(2).to_pylist()
            for i, ids in enumerate(packed):
                ids = ids or b""
                text = codec.decode(np.frombuffer(ids, "<u4"))
                done = [hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()] if digest else [text.tobytes()]
                packed[i] = done
            outs = [pa.array([p[j] for p in packed], pa.string() if digest else pa.binary()) for j in range(2 if digest else 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *outs],
                                             ["key", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["decoded"])])

    return run


def decoded(codes: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, n_tokens, decoded): the bytes that the ids of :func:`with_ids` stand for; null ids give none."""
    return _decoded(codes, path, pattern, key, False, "decoded binary")


def digests(codes: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256) of the rows of :func:`with_ids`."""
    return _decoded(codes, path, pattern, key, True, "ids_sha256 string, decoded_sha256 string")


def _decoded(codes: DataFrame, path: str, pattern: str, key: str, digest: bool, columns: str) -> DataFrame:
    plain = codes.select(codes[key].alias("key"), "n_tokens", "ids")
    return plain.mapInArrow(_decoder(path, pattern, digest), f"key {dict(plain.dtypes)['key']}, n_tokens long, {columns}").withColumnRenamed("key", key)
