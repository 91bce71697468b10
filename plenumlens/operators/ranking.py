"""Top-k, first/latest per key and ranks that hold when one group has a third of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT_BUCKETS = 64


def topk_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread_by: Sequence[str],
    buckets: int = SALT_BUCKETS,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows of every group under ``order``, with their rank.

    Two rounds: best ``k`` of each (group, salt), then best ``k`` of the survivors. A hot
    group is sorted by ``buckets`` tasks, and its last round sees at most ``k * buckets``
    rows. ``order`` must be total within a group; ``spread_by`` names the columns hashed
    into the salt.
    """
    salted = df.withColumn("_salt", F.pmod(F.hash(*spread_by), F.lit(buckets)))
    near = Window.partitionBy(*group, "_salt").orderBy(*order)
    survivors = salted.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k).drop("_r", "_salt")
    final = Window.partitionBy(*group).orderBy(*order)
    return survivors.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], number: str | None = None) -> DataFrame:
    """The row that comes first under ``order`` for every key.

    With ``number``, rows whose number is null or 0 are left out first.

    A group limit before the shuffle lets a hot key send one row per task.
    """
    rows = df if number is None else df.where(F.col(number).isNotNull() & (F.col(number) != 0))
    return _edge_per_key(rows, key, [F.col(c).asc_nulls_first() for c in order])


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row that comes last under ``order`` for every key."""
    return _edge_per_key(df, key, [F.col(c).desc_nulls_last() for c in order])


def _edge_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key; the group limit leaves one row per key and task before the shuffle."""
    first = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def rank_all(
    df: DataFrame,
    group: Sequence[str],
    coarse: Sequence[Column],
    fine: Sequence[Column],
    rank: str = "rank",
) -> DataFrame:
    """Number every row of every group without sorting a group in one task.

    ``coarse`` expressions (ascending) are a prefix of the wanted order and cut a group
    into ever smaller blocks; ``fine`` orders the rows of the smallest blocks. Blocks are
    counted first (combined before the shuffle); at each level a running count over the
    blocks of one parent gives their offsets. Choose levels so that no parent has very
    many children. ``df`` is read twice: pass a written table if it is dear to compute.
    """
    names = [f"_c{i}" for i in range(len(coarse))]
    blocked = df.select("*", *[c.alias(n) for c, n in zip(coarse, names)])
    places = blocked.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_n"))
    levels = [*group, *names]
    places = places.withColumn("_offset", F.lit(0).cast("long"))
    for level, name in enumerate(names):  # what lies before a block within its parent
        block = [*group, *names[:level + 1]]
        sums = places.groupBy(*block).agg(F.sum("_n").alias("_all"))
        before = Window.partitionBy(*block[:-1]).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(*[F.col(c).alias(f"_p{c}") for c in block], F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
        placed = places.join(offsets, _same(block, "_p"))
        places = placed.select(*levels, "_n", (F.col("_offset") + F.col("_before")).alias("_offset"))
    inside = Window.partitionBy(*group, *names).orderBy(*fine)
    numbered = blocked.withColumn("_r", F.row_number().over(inside))
    offsets = places.select(*[F.col(c).alias(f"_q{c}") for c in levels], "_offset")
    joined = numbered.join(offsets, _same(levels, "_q"))
    return joined.select(*df.columns, (F.col("_r") + F.col("_offset")).cast("long").alias(rank))


def _same(names: Sequence[str], prefix: str) -> Column:
    """Equality of columns with their prefixed twins; null equals null."""
    return reduce(and_, [F.col(n).eqNullSafe(F.col(f"{prefix}{n}")) for n in names], F.lit(True))


#: Parts that a range of scores is cut into at once.
SPLITS = 1_000


def top_fraction(df: DataFrame, score: str, fraction: float, accuracy: int = 10_000) -> DataFrame:
    """Rows at or above the score quantile that keeps ``fraction`` of the rows with a score; its ties are all kept.

    The score is the least one with enough rows at or below it; :func:`nth_score` finds it.
    Rows without a score, and NaN, are not ranked and not kept.
    """
    ranked = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    n = ranked.count()
    if not n:
        return df.where(F.lit(False))
    wanted = max(1, math.ceil((1.0 - fraction) * n - 1e-9))
    return ranked.where(F.col(score) >= F.lit(nth_score(ranked, score, wanted, accuracy)))


def nth_score(df: DataFrame, score: str, n: int, accuracy: int = 10_000):
    """The ``n``-th smallest score (1-based, ties counted), exact at any number of rows and distinct scores.

    A sketch gives a first bracket; rounds then count the rows below each of some cuts in it and
    go on in the part that holds the place, until its scores are one. A round is one aggregate
    with at most ``SPLITS`` + 1 groups; no scores are sorted or gathered. Cuts are quantiles of
    the bracket by sketch, and the bracket's ends: a part between two of them has at most a few
    thousandths of its rows, or its scores are one.
    """
    rows = df.select(F.col(score).alias("s")).where("s IS NOT NULL")
    total = rows.count()
    if not 1 <= n <= total:
        raise ValueError(f"no place {n} among {total} scores")
    low = high = None  # the wanted score s has low < s <= high; None is open
    below = 0  # scores <= low
    while True:
        inside = rows
        if low is not None:
            inside = inside.where(F.col("s") > F.lit(low))
        if high is not None:
            inside = inside.where(F.col("s") <= F.lit(high))
        shares = [k / SPLITS for k in range(1, SPLITS)]
        seen = inside.agg(F.min("s").alias("least"), F.max("s").alias("most"), F.percentile_approx("s", shares, accuracy).alias("cuts")).first()
        least, most = seen["least"], seen["most"]
        if least == most:
            return least
        cuts = sorted({c for c in [least, *seen["cuts"], most] if c is not None})
        counts = {r["k"]: r["c"] for r in inside.groupBy(_place(cuts).alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
        for k, cut in enumerate(cuts):
            here = counts.get(k, 0)
            if below + here >= n:
                low, high = (cuts[k - 1] if k else low), cut
                break
            below += here


def _place(cuts: Sequence) -> Column:
    """The number of the first cut that is not below ``s``, by binary search through a literal array."""
    array = F.array(*[F.lit(c) for c in cuts])
    steps = max(1, len(cuts).bit_length())

    def narrow(range_: Column, _: Column) -> Column:
        middle = F.floor((range_["a"] + range_["b"]) / 2).cast("int")
        above = F.element_at(array, middle + 1) >= F.col("s")
        done = range_["a"] >= range_["b"]
        return F.struct(F.when(done | above, range_["a"]).otherwise(middle + 1).alias("a"),
                        F.when(done | ~above, range_["b"]).otherwise(middle).alias("b"))

    first = F.struct(F.lit(0).alias("a"), F.lit(len(cuts) - 1).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, narrow)["a"]
