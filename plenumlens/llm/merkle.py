"""A Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Every row is a leaf of the tree of its group, whose leaves ascend by key; the groups' roots are
the leaves of one more tree. Trees are built in bounded subtrees of ``BLOCK_LEVELS`` levels, one
shuffle each. A proof is found by pointer jumping: every node first holds the siblings towards
its parent; joining the nodes with themselves then doubles the distance that a node's segment
spans, until every leaf's segment ends at its root. Only nodes at multiples of a distance are
pointed at from there on, so all rounds together touch little more than the leaves.

Digests are 32 bytes in tables and lower-case hexadecimal text where they are hashed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenumlens.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
#: Levels of a subtree that one call builds, from at most ARITY ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 12
#: Ancestors' segments are broadcast up to so many bytes (rows are counted from the sizes of the trees).
BROADCAST_BYTES = 8 << 20

_NODE = "tree string, size long, level int, idx long, digest binary, entry binary, key {key}, shown binary"
_PROVEN = "key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def height_of(size: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree with ``size`` leaves."""
    height, reach = 0, 1
    while reach < size:
        height, reach = height + 1, reach * arity
    return height


def field(value: Column) -> Column:
    """A value as hashed: its UTF-8 length, a colon and itself, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: Sequence[Column]) -> Column:
    """The 32-byte digest of a row's fields in the given order."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def _numbered(leaves: DataFrame) -> DataFrame:
    """The leaves with their place ``idx`` in their tree and the tree's ``size``.

    Ranges of (tree, key, digest) are sorted on their own; leaves counted per range and tree give
    the offsets. Equal leaves are spread over ranges; which comes first makes no difference.
    """
    ends = [F.col("tree"), F.col("key").asc_nulls_first(), F.col("digest"), F.col("spread")]
    loose = leaves.withColumn("spread", F.rand(7))
    sorted_ = loose.repartitionByRange(*ends).sortWithinPartitions(*ends).drop("spread")
    placed = materialize(sorted_.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    counts = placed.groupBy("tree", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    whole = Window.partitionBy("tree")
    offsets = materialize(counts.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                                        F.sum("n").over(whole).alias("size")), "merkle-offsets")
    joined = placed.withColumn("part", F.shiftright("at", 33)).join(offsets, ["tree", "part"])
    return joined.select("tree", "size", F.lit(0).alias("level"), (F.col("at") + F.col("shift")).alias("idx"),
                         "digest", F.lit(None).cast("binary").alias("entry"), "key", "shown")


def _subtree(arity: int, levels: int):
    """Build one block's levels: its nodes with their siblings, and its topmost node with its digest."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, size, base = (table.column(c)[0].as_py() for c in ("tree", "size", "level"))
        height = height_of(size, arity)
        at, raw = table.column("idx")[0].as_py(), table.column("digest").to_pylist()
        nodes = [d.hex() for d in raw]
        out: list[tuple] = []  # level, idx, digest, entry
        for level in range(base, min(base + levels, height)):
            above = []
            for i in range(0, len(nodes), arity):
                run = nodes[i:i + arity]
                for place in range(len(run)):
                    others = "".join(run[:place] + run[place + 1:])
                    out.append((level, at + i + place, None, bytes((place, len(run) - 1)) + bytes.fromhex(others)))
                above.append(sha256("".join(run).encode()).hexdigest())
            nodes, at = above, at // arity
        n = table.num_rows
        if base == 0:  # the leaves keep their digests, keys and what is shown in their place
            own = out[:n] if height else [(0, at, None, b"")]
            rows = [(0, idx, raw[i], entry) for i, (_, idx, _, entry) in enumerate(own)] + (out[n:] if height else [])
        else:
            rows = out
        top = min(base + levels, height)
        level, idx, digest, entry = map(list, zip(*rows, (top, at, bytes.fromhex(nodes[0]), None), strict=True))
        rest = len(level) - n if base == 0 else len(level)
        pad = [pa.nulls(rest, table.schema.field(c).type) for c in ("key", "shown")]
        kept = [table.column(c).combine_chunks() if base == 0 else None for c in ("key", "shown")]
        key, shown = (pa.concat_arrays([k, p]) if k is not None else p for k, p in zip(kept, pad))
        return pa.table([pa.array([tree] * len(level), pa.string()), pa.array([size] * len(level), pa.int64()), pa.array(level, pa.int32()),
                         pa.array(idx, pa.int64()), pa.array(digest, pa.binary()), pa.array(entry, pa.binary()), key, shown],
                        ["tree", "size", "level", "idx", "digest", "entry", "key", "shown"])

    return build


def forest(leaves: DataFrame, arity: int = ARITY, block_levels: int = BLOCK_LEVELS) -> tuple[DataFrame, DataFrame]:
    """The trees over rows (tree, key, digest, shown), ascending by key, null first, then by digest.

    Returns (proofs, roots). Proofs are the rows (tree, key, digest, shown, segment); a segment
    lists, from the leaf up, the place in its run, the number of the others, and their digests.
    Roots are the rows (tree, size, root). No leaves give no rows; a lone leaf is its root.
    """
    kind = dict(leaves.dtypes)["key"]
    build = _subtree(arity, block_levels)
    reach = arity ** block_levels
    wave, passes = _numbered(leaves.select("tree", "key", "digest", "shown")), []
    while True:
        block = wave.groupBy("tree", F.floor(F.col("idx") / F.lit(reach)).alias("block"))
        passes.append(materialize(block.applyInArrow(lambda t: build(t), _NODE.format(key=kind)), "merkle-nodes"))
        tops = passes[-1].where("entry IS NULL")
        wave = tops.where(F.col("size") > F.lit(reach) ** (F.lit(len(passes))))  # the others are roots
        if not wave.take(1):
            break
    roots = passes[0].where("false").select("tree", "size", F.col("digest").alias("root"))
    for i, nodes in enumerate(passes):
        done = nodes.where("entry IS NULL").where(F.col("size") <= F.lit(reach) ** F.lit(i + 1))
        roots = roots.union(done.select("tree", "size", "digest"))
    roots = materialize(roots, "merkle-roots")
    below = passes[0].where("level = 0 AND entry IS NOT NULL")
    found = below.select("tree", "idx", "key", "digest", "shown", F.col("entry").alias("segment"))
    held = passes[0].where("level > 0 AND entry IS NOT NULL")
    for nodes in passes[1:]:
        held = held.unionByName(nodes.where("entry IS NOT NULL"))
    return _jump(found, held.select("tree", "level", "idx", F.col("entry").alias("segment")), roots, arity), roots


def _jump(leaves: DataFrame, nodes: DataFrame, roots: DataFrame, arity: int) -> DataFrame:
    """Double the distance of the segments until the leaves' ones end at their roots."""
    facts = roots.agg(F.max("size").alias("most"), F.max(F.octet_length("tree")).alias("name"),
                      *[F.sum(F.ceil(F.col("size") / F.lit(float(arity)) ** F.lit(2.0 ** k))).alias(f"n{k}") for k in range(7)]).first()
    height = height_of(facts["most"] or 0, arity)
    distance, k = 1, 0
    while distance < height:
        step, rows = arity ** distance, facts[f"n{k}"]
        up = nodes.where(F.col("level") == distance).select("tree", F.col("idx").alias("up"), F.col("segment").alias("further"))
        if rows * (distance * (2 + 32 * (arity - 1)) + facts["name"] + 16) <= BROADCAST_BYTES:
            up = F.broadcast(up)
        ahead = leaves.withColumn("up", F.floor(F.col("idx") / F.lit(step)).cast("long")).join(up, ["tree", "up"], "left")
        leaves = ahead.withColumn("segment", F.concat("segment", F.coalesce("further", F.lit(b"")))).drop("up", "further")
        twice = 2 * distance
        if twice < height:
            low = nodes.where(F.col("level") % twice == 0).withColumn("above", F.col("level") + distance).withColumn(
                "up", F.floor(F.col("idx") / F.lit(step)).cast("long"))
            high = nodes.where(F.col("level") % twice == distance).select(
                "tree", F.col("level").alias("above"), F.col("idx").alias("up"), F.col("segment").alias("further"))
            nodes = materialize(low.join(high, ["tree", "above", "up"], "left").select(
                "tree", "level", "idx", F.concat("segment", F.coalesce("further", F.lit(b""))).alias("segment")), "merkle-jump")
        distance, k = twice, k + 1
    return leaves.drop("idx")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS,
             shown: Mapping[str, Column] | None = None, arity: int = ARITY, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row (key, digest, shown, segment, subroot, root) per row of ``docs``.

    ``segment`` is the proof from the leaf over its group's root to the root of all. ``shown`` gives
    other values of some fields, as somebody presents them later: its digest is then that of the
    changed row (null where nothing differs). Groups ascend by their UTF-8 bytes, null first;
    leaves ascend by key, null first, then by digest; repeated rows are leaves of their own. Null
    and empty values are told apart. Other columns are left out. No rows give no rows.
    """
    own = row_digest([docs[c] for c in fields])
    other = F.lit(None).cast("binary")
    if shown:
        changed = [shown.get(c, docs[c]) for c in fields]
        differs = F.lit(False)
        for c, value in shown.items():
            differs = differs | ~docs[c].eqNullSafe(value)
        other = F.when(differs, row_digest(changed))
    tree = F.coalesce(F.concat(F.lit("1"), docs[group].cast("string")), F.lit("0"))
    leaves = materialize(docs.select(tree.alias("tree"), docs[key].alias("key"), own.alias("digest"), other.alias("shown")), "merkle-leaves")
    proofs, subroots = forest(leaves, arity, block_levels)
    tops, root = forest(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("digest"),
                                        F.lit(None).cast("binary").alias("shown")), arity, block_levels)
    ends = materialize(tops.join(root, "tree").select(
        F.col("key").alias("tree"), F.col("digest").alias("subroot"), F.col("segment").alias("further"), "root"), "merkle-tops")
    return proofs.join(ends, "tree").select("key", "digest", "shown", F.concat("segment", "further").alias("segment"), "subroot", "root")


def fold(leaf: str, segment: bytes) -> tuple[str, str]:
    """The root that a leaf and its segment lead to, and the segment's siblings as text (all hexadecimal)."""
    at, seen = 0, []
    while at < len(segment):
        place, n = segment[at], segment[at + 1]
        others = segment[at + 2:at + 2 + 32 * n].hex()
        leaf = sha256((others[:64 * place] + leaf + others[64 * place:]).encode()).hexdigest()
        seen.append(others)
        at += 2 + 32 * n
    return leaf, "".join(seen)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        cols = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c != "key"}
        leaf = [d.hex() for d in cols["digest"]]
        start = [s.hex() if s is not None else d for s, d in zip(cols["shown"], leaf)]
        folds = [fold(s, seg) for s, seg in zip(start, cols["segment"])]
        root = [r.hex() for r in cols["root"]]
        yield pa.RecordBatch.from_arrays([
            batch.column(batch.schema.get_field_index("key")), pa.array(leaf, pa.string()), pa.array([s.hex() for s in cols["subroot"]], pa.string()),
            pa.array(root, pa.string()), pa.array([sha256(text.encode()).hexdigest() for _, text in folds], pa.string()),
            pa.array([end for end, _ in folds], pa.string()), pa.array([end == r for (end, _), r in zip(folds, root)], pa.bool_())], names)


def verify(proofs: DataFrame) -> DataFrame:
    """Fold what is shown (or the leaf itself) along its segment, and compare with the root.

    Rows (key, leaf, subroot, root, proof_sha256, folded_root, verified) for the rows of :func:`manifest`.
    """
    return proofs.mapInArrow(_check, _PROVEN.format(key=dict(proofs.dtypes)["key"]))
