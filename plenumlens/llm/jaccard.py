"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of shingles. Order all shingles from rare to frequent. Two sets that
overlap enough share a shingle within their first few (the prefix), and ``k`` shingles within
prefixes that are ``k - 1`` longer. Documents whose prefix has costly shingles get longer
prefixes, and pairs must then share more before they are compared.

1. Shingle hashes travel packed, in sorted blobs of one hash range each. The task of a range
   sees how many documents hold each shingle, and tells the documents of those that several hold.
   A shingle only one document holds can link nothing, and comes first in the order; so these
   lists and the set sizes are all that the join needs, and no text is read again.
2. Documents whose prefix is made of own shingles have no partner and leave.
3. The rest are linked in rounds. First every document is compared with one leader of the
   shingles it shares; whoever agrees is joined into one class. Shingles whose holders are in
   one class need no more work, so that large groups of copies shrink fast and never become
   all pairs. The last round counts shared prefix shingles of every pair of documents that are
   still in different classes, and compares all pairs that reach their number.

Shingles that a task holds often ("hot") reach their documents at once; only a count travels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenumlens.llm.graph import components
from plenumlens.llm.tables import mix64, settled, small_batches, text_bytes
from plenumlens.session import materialize

SHINGLE = 5
PERCENT = 80
#: Frequencies from here on are one class. A shingle this frequent within a task's chunk is hot.
HOT = 64
#: Shingles and documents of a chunk.
CHUNK = 500_000
CHUNK_DOCS = 60_000
#: The document number of an entry that stands for a hot shingle's count.
NOBODY = 65_535
#: Bits of a shingle's hash that are kept. Two sets of a thousand shingles take a wrong one for
#: common with a chance of one in 10^8; a code has 7 bits more for the frequency.
TOKEN_BITS = 48
#: Distinct words whose hashes a task keeps.
WORDS_KEPT = 150_000
#: Cost that the first prefix may have; each doubling asks for some more shared shingles.
FREE_COST = 16
MORE_PER_DOUBLING = 2
MOST_MATCHES = 24
#: Rounds with leaders go on while the pairs to look at are more than this many per posting, and
#: while more than this share of the comparisons joins documents.
PAIRS_PER_POSTING = 4
LEAST_JOINED = 0.1
MOST_ROUNDS = 4

#: Packed rows: ``docs`` (keys and set sizes of a chunk), ``hashes`` of one range, ``shared`` codes of a chunk's documents.
PACKED = "route int, block long, kind string, data binary"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(text: bytes, known: dict[bytes, int], length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``length`` words (A-Z lower-cased).

    Fewer words make one shingle of all of them; no words make none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    size = min(length, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out) + h[k:len(h) - size + 1 + k]
    return np.unique(mix64(out))


def _rows(rows: list[tuple[int, int, str, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["route", "block", "kind", "data"])


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, byte plane by byte plane; planes that aren't random are deflated."""
    deflate = zstandard.ZstdCompressor(level=1).compress
    out = [np.array([len(arrays[0])], np.int64).tobytes()]
    for array in arrays:
        planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T
        for plane in planes:
            raw = plane.tobytes()
            small = deflate(raw)
            body = small if len(small) < len(raw) else raw
            out += [np.array([len(body)], np.int32).tobytes(), body]
    return b"".join(out)


def _loosen(data: bytes, *kinds: type) -> list[np.ndarray]:
    inflate = zstandard.ZstdDecompressor().decompress
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.empty((width, n), np.uint8)
        for plane in planes:
            size = int(np.frombuffer(data, np.int32, 1, at)[0])
            body = data[at + 4:at + 4 + size]
            plane[:] = np.frombuffer(body if size == n else inflate(body), np.uint8)
            at += 4 + size
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return out


def _gaps(values: np.ndarray) -> np.ndarray:
    """Steps between ascending numbers, of 32 bits where they fit."""
    steps = np.diff(values, prepend=np.uint64(0))
    return steps if len(steps) and int(steps.max()) >> 32 else steps.astype(np.uint32)


def _pack(values: np.ndarray, *others: np.ndarray) -> bytes:
    """Ascending numbers with columns beside them."""
    steps = _gaps(values)
    return bytes([steps.itemsize]) + _squeeze(steps, *others)


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    steps, *others = _loosen(data[1:], np.uint64 if data[0] == 8 else np.uint32, *kinds)
    return [np.cumsum(steps, dtype=np.uint64), *others]


def _chunk(block: int, sets: list[np.ndarray], keys: list[tuple[int, int]], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk: its documents, their hot shingles, and a blob for each range of hashes."""
    n = np.array([len(s) for s in sets], np.int32)
    tokens = np.concatenate(sets) >> np.uint64(64 - TOKEN_BITS)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint64(1))) if len(tokens) else np.empty(0, int)
    count = np.diff(np.append(first, len(tokens)))
    each = np.repeat(count, count)
    hot = each >= HOT
    pairs = np.array(keys, np.int64).reshape(-1, 2)
    where = block % (1 << bits)
    yield _rows([(where, block, "docs", _squeeze(pairs[:, 0], pairs[:, 1], n)),
                 (where, block, "shared", _pack(tokens[hot], np.full(int(hot.sum()), HOT, np.uint8), owner[hot]))])
    keep = ~hot
    keep[first] = True  # of a hot shingle, one entry with its count
    tokens, owner, each = tokens[keep], np.where(hot, np.uint16(NOBODY), owner)[keep], np.where(hot, each, 1)[keep].astype(np.uint32)
    low_bits = TOKEN_BITS - bits
    route = (tokens >> np.uint64(low_bits)).astype(np.int64)
    low = tokens & np.uint64((1 << low_bits) - 1)
    edges = np.searchsorted(route, np.arange((1 << bits) + 1))
    for r in np.flatnonzero(np.diff(edges)).tolist():
        yield _rows([(r, block, "hashes", _pack(*(x[edges[r]:edges[r + 1]] for x in (low, owner, each))))])


def _packer(bits: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = _WordHashes(), set(), TaskContext.get().partitionId()
        sets, keys, total, chunks = [], [], 0, 0
        for batch in settled(batches):
            for k1, k2, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                key = (k1.as_py(), k2.as_py())
                if key in seen:
                    continue
                seen.add(key)
                sets.append(shingle_hashes(text.as_py(), words, length))
                keys.append(key)
                total += len(sets[-1])
                if total >= CHUNK or len(sets) >= CHUNK_DOCS:
                    yield from _chunk(part << 20 | chunks, sets, keys, bits)
                    sets, keys, total, chunks = [], [], 0, chunks + 1
        if sets:
            yield from _chunk(part << 20 | chunks, sets, keys, bits)

    return run


def _shared(route: int, bits: int, blocks: list[int], blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of one range: chunk, document, hash and frequency of shingles that several documents hold."""
    parts = [_unpack(b, np.uint16, np.uint32) for b in blobs]
    low, docs, counts = (np.concatenate([p[i] for p in parts]) for i in range(3))
    block = np.repeat(np.array(blocks, np.int64), [len(p[0]) for p in parts])
    order = np.argsort(low, kind="stable")
    low, docs, counts, block = low[order], docs[order], counts[order], block[order]
    first = np.flatnonzero(np.diff(low, prepend=low[:1] + np.uint64(1)))
    held = np.add.reduceat(counts.astype(np.int64), first)
    each = np.repeat(held, np.diff(np.append(first, len(low))))
    keep = (each > 1) & (docs != NOBODY)
    token = low[keep] | np.uint64(route << (TOKEN_BITS - bits))
    return block[keep], docs[keep], token, np.minimum(each[keep], HOT).astype(np.uint8)


def _tell(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row per chunk: the shared shingles of its documents, with their frequency."""
    block, docs, tokens, often = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((tokens, block))
    block, docs, tokens, often = block[order], docs[order], tokens[order], often[order]
    first = np.flatnonzero(np.diff(block, prepend=block[:1] - 1))
    last = np.append(first[1:], len(block))
    return _rows([(0, int(block[f]), "shared", _pack(tokens[f:t], often[f:t], docs[f:t])) for f, t in zip(first, last, strict=True)])


def _counter(bits: int):
    """Rows come sorted by range. Passes documents on, and turns hashes into the chunks' shared shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, blobs, parts, held = -1, [], [], [], 0
        for batch in settled(batches):
            packed = pc.equal(batch.column(2), "hashes")
            plain = batch.filter(pc.invert(packed))
            if plain.num_rows:
                yield plain
            batch = batch.filter(packed)
            for route, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if route != at and blobs:
                    parts.append(_shared(at, bits, blocks, blobs))
                    held += len(parts[-1][0])
                    blocks, blobs = [], []
                    if held > 4 * CHUNK:
                        yield _tell(parts)
                        parts, held = [], 0
                at = route
                blocks.append(block)
                blobs.append(data.as_py())
        if blobs:
            parts.append(_shared(at, bits, blocks, blobs))
        if sum(len(p[0]) for p in parts):
            yield _tell(parts)

    return run


SET = "node long, k1 long, k2 long, n int, codes array<long>"


def _gather(percent: int):
    """Rows come sorted by chunk. The documents with their codes in order, where they have enough of them for a partner."""
    def emit(block: int, docs: bytes, shared: list[bytes]) -> pa.RecordBatch:
        k1, k2, n = _loosen(docs, np.int64, np.int64, np.int32)
        parts = [_unpack(x, np.uint8, np.uint16) for x in shared]
        held = sum(np.bincount(p[2], minlength=len(n)) for p in parts)
        joins = (held * 100 >= n.astype(np.int64) * percent) & (n > 0)
        chosen = [joins[p[2]] for p in parts]
        codes = np.concatenate([p[0][c].astype(np.int64) | p[1][c].astype(np.int64) << 56 for p, c in zip(parts, chosen, strict=True)])
        owner = np.concatenate([p[2][c] for p, c in zip(parts, chosen, strict=True)])
        codes = codes[np.lexsort((codes, owner))]
        edges = np.concatenate(([0], np.cumsum(np.where(joins, held, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(codes, pa.int64()), mask=pa.array(~joins))
        node = np.int64(block) << 16 | np.arange(len(n))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(k1), pa.array(k2), pa.array(n), lists], ["node", "k1", "k2", "n", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, shared = None, None, []
        for batch in settled(batches):
            for block, kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if block != at:
                    if docs is not None:
                        yield emit(at, docs, shared)
                    at, docs, shared = block, None, []
                if kind == "docs":
                    docs = data.as_py()
                else:
                    shared.append(data.as_py())
        if docs is not None:
            yield emit(at, docs, shared)

    return run


def text_keys(text: str) -> list[Column]:
    """Two 64-bit hashes that stand for a text; null is as empty."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(value).alias("k1"), F.xxhash64(F.lit("second"), value).alias("k2")]


def range_bits(rows: int) -> int:
    """Bits of the hash ranges, so that a range holds some hundred thousand shingles up to 10^8 documents."""
    return int(np.clip(np.ceil(np.log2(max(rows, 1))) - 10, 6, 18))


def shared_shingles(docs: DataFrame, text: str = "text", length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows (node, k1, k2, n, codes): texts, each once a task, with set size and the codes of shingles that several hold.

    A code is the frequency (up to ``HOT``) and the hash, so that ascending codes go from rare
    to frequent in the same order for all. Texts with too few of them for a partner have null.
    """
    small_batches(docs.sparkSession)
    bits = range_bits(docs.count())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select(*text_keys(text), text_bytes(text).alias("text")).mapInArrow(_packer(bits, length), PACKED)
    told = packed.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(_counter(bits), PACKED)
    return told.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_gather(percent), SET)


def _needed(n: Column, percent: int) -> Column:
    """Least overlap of a set of ``n`` with any partner."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) with sizes na and nb, the exact overlap ``both``, and the shared codes of a beyond b."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("codes").alias("ca"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("codes").alias("cb"))
    both = F.size(F.array_intersect("ca", "cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", both.alias("both"), F.array_except("ca", "cb").alias("beyond"))


def _similar(overlap: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether an overlap makes sets of these sizes similar enough."""
    return overlap * (100 + percent) >= percent * (na + nb)


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Join the classes of linked documents."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("class").alias(f"c{side}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("u"), F.col("cb").alias("v"))
    roots = components(edges)
    merged = labels.join(roots.withColumnRenamed("node", "was"), F.col("class") == F.col("was"), "left")
    return materialize(merged.select("node", F.coalesce("root", "class").alias("class")), "classes")


def near_classes(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (node, class) of ``nodes`` (node, n, codes): documents joined by similar pairs, and no others."""
    need = _needed(F.col("n"), percent)
    common = F.aggregate("codes", F.lit(0).cast("long"), lambda t, c: t + F.shiftright(c, 56)) / F.col("n")
    ordered = nodes.select("node", "n", F.size("codes").alias("s"), common.alias("common"), "codes", (F.size("codes") - need + 1).alias("take"))
    # frequencies of the first prefix, less one each, are the candidates that it leads to
    cost = F.aggregate(F.slice("codes", 1, F.greatest("take", F.lit(0))), F.lit(0).cast("long"), lambda t, c: t + F.shiftright(c, 56) - 1)
    more = F.least(F.greatest(F.ceil(F.log2((cost + 1) / FREE_COST) * MORE_PER_DOUBLING), F.lit(0)), F.lit(MOST_MATCHES - 1), need - 1).cast("int")
    grown = materialize(ordered.select("node", "n", "s", "common", (more + 1).alias("k"), F.slice(
        "codes", 1, F.greatest(F.col("take") + more, F.lit(0))).alias("prefix")), "prefixes")
    facts = grown.select("node", "n", "s", "k")
    postings = grown.select("node", "common", F.explode("prefix").alias("code"))
    labels = materialize(nodes.select("node", F.col("node").alias("class")), "classes")
    size, units, worth = grown.agg(F.sum(F.size("prefix"))).first()[0] or 0, None, True
    for turn in range(MOST_ROUNDS + 1):
        # the most common document leads first; later rounds try others of the largest class
        lead = F.struct("common", F.col("node")) if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)).cast("double").alias("common"), F.col("node"))
        held = postings.withColumn("class", F.col("node")) if turn == 0 else postings.join(labels, "node")
        per_class = held.groupBy("code", "class").agg(F.count(F.lit(1)).alias("members"), F.max(lead).alias("lead"))
        code = Window.partitionBy("code")
        order = code.orderBy(F.col("members").desc(), F.col("lead").desc())
        open_codes = (per_class.withColumn("all", F.sum("members").over(code)).withColumn("rank", F.row_number().over(order))
                      .withColumn("largest", F.max("members").over(code)).where("all > largest"))
        open_codes = materialize(open_codes.select("code", "class", "members", "all", "rank", F.col("lead.node").alias("lead")), "open")
        left = open_codes.where("rank > 1").agg(F.sum(F.col("members") * F.col("all"))).first()[0] or 0
        if not left:
            break
        last = turn and (left <= PAIRS_PER_POSTING * size or not worth or turn == MOST_ROUNDS)
        held = held.select("node", "code", "class").join(open_codes.select("code", "class", "rank"), ["code", "class"])
        if last:
            near = _met_in_prefix(held.join(facts, "node").join(units.drop("beyond"), "node", "left"), percent)
            beside = _met_beside_leader(units.join(facts, "node"), labels, percent)
            found = _compared(near.union(beside).distinct(), nodes).where(_similar(F.col("both"), F.col("na"), F.col("nb"), percent))
            links = materialize(found.select("a", "b"), "links")
        else:
            minor = held.where("rank > 1").select("code", F.col("node").alias("a"))
            leads = open_codes.where("rank = 1").select("code", F.col("lead").alias("b"))
            best = minor.join(leads, "code").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best"))
            compared = materialize(_compared(best.select("a", F.col("best.b").alias("b")), nodes), "compared")
            if units is None:
                units = compared.select(F.col("a").alias("node"), F.col("b").alias("unit"), F.col("nb").alias("of"),
                                        (F.col("nb") - F.col("both")).alias("gap"), "beyond")
            links = compared.where(_similar(F.col("both"), F.col("na"), F.col("nb"), percent)).select("a", "b")
            worth = links.count() > LEAST_JOINED * compared.count()
        labels = _relabel(labels, links)
        if last:
            break
    return labels


def _met_in_prefix(held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents in different classes that share as many prefix shingles as either asks for.

    Of each shingle, documents outside its largest class meet all others. Pairs are left out
    whose overlap is bounded below what it needs: by what each shares with anyone, or, if both
    were compared with one leader, by what both have of it. (What they have in common beyond the
    leader is looked at by :func:`_met_beside_leader`.)
    """
    def side(suffix: str) -> DataFrame:
        return held.select("code", *[F.col(c).alias(f"{c}{suffix}") for c in ("node", "n", "s", "k", "class", "rank", "unit", "of", "gap")])

    c, minor, other = F.col, side("_a").where("rank_a > 1"), side("_b")
    bound = F.least("s_a", "s_b", F.when(c("unit_a") == c("unit_b"), c("of_a") - F.greatest("gap_a", "gap_b")))
    met = minor.join(other, (minor["code"] == other["code"]) & (c("class_a") != c("class_b")) & ((c("rank_b") == 1) | (c("node_a") < c("node_b")))
                     & _similar(bound, c("n_a"), c("n_b"), percent))
    return (met.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
            .agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("k_a", "k_b")).alias("asked"))
            .where("shared >= asked").select("a", "b"))


def _met_beside_leader(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different classes that were compared with one leader and are similar only through what it lacks.

    The overlap is at most what both have of the leader, and what they share beyond it, which is
    counted here in full. So pairs meet on shingles beyond the leader, and those are rare.
    """
    head = labels.select(F.col("node").alias("unit"), F.col("class").alias("head"))
    known = members.join(labels, "node").join(head, "unit")
    spread = known.select("unit", "of", "node", "n", "gap", "class", "head", F.size("beyond").alias("extra"), F.explode("beyond").alias("code"))

    def side(suffix: str) -> DataFrame:
        return spread.select("unit", "code", *[F.col(c).alias(f"{c}{suffix}") for c in ("of", "node", "n", "gap", "class", "head", "extra")])

    c = F.col
    of_leader = c("of_a") - F.greatest("gap_a", "gap_b")
    met = side("_a").where("class_a <> head_a").join(side("_b"), ["unit", "code"]).where(
        (c("class_a") != c("class_b")) & ((c("class_b") == c("head_b")) | (c("node_a") < c("node_b")))
        & ~_similar(of_leader, c("n_a"), c("n_b"), percent)
        & _similar(of_leader + F.least("extra_a", "extra_b"), c("n_a"), c("n_b"), percent))
    counted = met.groupBy("node_a", "node_b", "n_a", "n_b", of_leader.alias("of_leader")).agg(F.count(F.lit(1)).alias("shared"))
    return counted.where(_similar(c("of_leader") + c("shared"), c("n_a"), c("n_b"), percent)).select(
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = SHINGLE, percent: int = PERCENT,
                    extra: list[str] | None = None) -> DataFrame:
    """Each document's set size, and the class it is joined into by links of similarity ``percent`` or more.

    Returns key, n_shingles, component_id (the least key of the class) and ``extra`` columns of
    the input that don't clash. Documents without words are alone. Equal texts are one class,
    rows with equal or null keys stay separate rows (a null key is never the least unless all
    are null), and an empty table gives an empty result.
    """
    extra = [c for c in extra or [] if c not in (key, "n_shingles", "component_id")]
    sets = materialize(shared_shingles(docs, text, length, percent), "sets")
    nodes = sets.where("codes is not null").select("node", "n", "codes")
    labels = near_classes(nodes, percent)
    rows = docs.select(F.struct(docs[key].alias("id"), *[docs[c].alias(f"x{i}") for i, c in enumerate(extra)]).alias("row"), *text_keys(text))
    least = rows.groupBy("k1", "k2").agg(F.min("row.id").alias("least"))
    # copies of a text that several tasks hold are in one class
    named = sets.select("node", "k1", "k2", "n").join(labels, "node", "left").groupBy("k1", "k2").agg(F.max("n").alias("n"), F.max("class").alias("class"))
    texts = least.join(named, ["k1", "k2"])
    roots = texts.where("class is not null").groupBy("class").agg(F.min("least").alias("root"))
    texts = texts.join(roots, "class", "left").select("k1", "k2", "n", F.coalesce("root", "least").alias("component"))
    whole = rows.join(texts, ["k1", "k2"])
    return whole.select(F.col("row.id").alias(key), F.col("n").cast("long").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("row.id")).alias("component_id"),
                        *[F.col(f"row.x{i}").alias(c) for i, c in enumerate(extra)])
