"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of all documents are thought of as blocks of equal length. Blocks are dealt to the
sources, and then to the shards of each source, by highest quotients ``votes / (2k + 1)``. That
gives every shard an integer quota; which of its blocks fill it follows from a seed alone.

Blocks are never made as rows. Of the quotients, only those near the cut are: a party's seats
differ from its exact share by at most its part of what all parties' rounding can add up to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenumlens.llm.tables import SPACE_WORD

WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
REPEATS = 3
#: Words of a block.
BLOCK = 64
#: Documents of a source that share a shard, about.
SHARD_DOCS = 20_000
SEED = 17


def n_words(text: Column) -> Column:
    """Number of words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Add ``quota``: the seats of each party by highest quotients votes / (2k + 1).

    ``seats`` holds the number of seats of the party's group, the same in all its rows; ``order``
    settles equal quotients. Parties without votes get none. One row per party in and out; a few
    rows per party are ranked.
    """
    all_of = Window.partitionBy(*group)
    part = F.try_divide(F.col(votes), F.col("__votes"))
    known = (parties.withColumn("__votes", F.sum(votes).over(all_of).cast("double"))
             .withColumn("__parties", F.count(F.lit(1)).over(all_of))
             .withColumn("__margin", F.coalesce(F.ceil(F.col("__parties") * part), F.lit(0)).cast("long") + 2)
             .withColumn("__base", F.coalesce(F.greatest(F.floor(F.col(seats) * part).cast("long") - F.col("__margin"), F.lit(0)), F.lit(0)))
             .withColumn("__open", F.col(seats) - F.sum("__base").over(all_of)))
    tries = known.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("__margin") + 1)))
    quotient = F.col(votes) / (2 * (F.col("__base") + F.col("__k")) + 1).cast("double")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc(), *order, "__k"))
    won = F.sum(F.when((F.col("__rank") <= F.col("__open")) & (F.col(votes) > 0), 1).otherwise(0))
    return tries.withColumn("__rank", rank).groupBy(*parties.columns, "__base").agg(won.alias("__won")).select(
        *parties.columns, (F.col("__base") + F.col("__won")).alias("quota"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Add ``place`` and ``target`` to rows (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``repeats`` times its size, and the excess goes to the others by
    weight until none is above. With the sources in order of limit per weight, those above form
    a leading run, so running sums find them. One row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * repeats
    ranked = (sources.withColumn("place", place).withColumn("__w", weight).withColumn("__limit", limit)
              .withColumn("__per", F.col("__limit") / F.col("__w")))
    before = Window.partitionBy(F.lit(0)).orderBy("__per", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("__limit").over(before), F.lit(0))
    rest_w = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    full = ranked.withColumn("__full", F.col("__per") < rest / rest_w)
    left = F.sum("source_size").over(everything) - F.sum(F.when(F.col("__full"), F.col("__limit")).otherwise(0)).over(everything)
    left_w = F.sum(F.when(F.col("__full"), F.lit(0.0)).otherwise(F.col("__w"))).over(everything)
    target = F.when(F.col("__full"), F.col("__limit").cast("double")).otherwise(left / left_w * F.col("__w"))
    return full.withColumn("target", target).select(*sources.columns, "place", "target")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None,
        weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK,
        shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    Returns the columns ``keep`` (default: only the key) with size, source_size, target (of the
    source) and taken (words, repeats counted). Documents of a source are spread over shards by
    the MD5 of seed and key, and lie in its order in their shard. A shard with quota q and b
    blocks takes all blocks q // b times, and q % b blocks on from a seeded one once more, so no
    document exceeds ``repeats`` times its size. Null or empty texts have size 0 and taken 0, a
    null source is one source, rows without a key are spread by their text, rows with equal keys
    are separate rows in the order of size and text hash (ties are equal rows), and an empty
    table gives an empty result. Other columns are left out; result names win.
    """
    keep = [key] if keep is None else keep
    words, tie = F.coalesce(docs[text].cast("string"), F.lit("")), F.xxhash64(docs[text].cast("string"))
    name = F.coalesce(docs[key].cast("string"), F.concat(F.lit("null:"), F.md5(words)))
    sized = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), docs[source].cast("string").alias("source"),
                        n_words(docs[text]).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("__md5"), tie.alias("__tie"))
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__docs")),
                             weights, repeats)
    everything = Window.partitionBy(F.lit(0))
    seats = F.floor(F.sum("source_size").over(everything) / float(block) + 0.5)
    sources = apportion(sources.withColumn("__all", F.lit(0)).withColumn("__seats", seats),
                        ["__all"], "target", "__seats", ["place"]).withColumnRenamed("quota", "__quota")
    sources = sources.withColumn("__shards", F.ceil(F.col("__docs") / float(shard_docs)))
    per_source = sources.select(F.col("source").alias("__source"), "source_size", "target", "place", "__quota", "__shards")
    shard = F.pmod(F.conv(F.substring("__md5", 1, 12), 16, 10).cast("long"), F.col("__shards"))
    placed = sized.join(per_source, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__shard", shard)
    shards = placed.groupBy("place", "__shard").agg(
        F.sum("size").alias("__tokens"), F.first("__quota").alias("__seats"))
    shards = apportion(shards, ["place"], "__tokens", "__seats", ["__shard"])
    blocks = F.ceil(F.col("__tokens") / float(block))
    shards = shards.select(
        F.col("place").alias("__place"), F.col("__shard").alias("__s"), blocks.alias("__blocks"),
        F.least("quota", blocks * repeats).alias("__take"),
        F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "place", "__shard")), 1, 12), 16, 10).cast("long").alias("__at"))
    shards = shards.select(
        "__place", "__s", "__blocks", F.floor(F.col("__take") / F.greatest("__blocks", F.lit(1))).alias("__passes"),
        F.pmod("__take", F.greatest("__blocks", F.lit(1))).alias("__more"),
        F.pmod("__at", F.greatest("__blocks", F.lit(1))).alias("__at"))
    own = Window.partitionBy("place", "__shard").orderBy("__md5", "size", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("__end", F.sum("size").over(own)).join(
        shards, (F.col("place") == F.col("__place")) & (F.col("__shard") == F.col("__s")))

    def within(first: Column, last: Column) -> Column:
        return F.greatest(F.least(F.col("__end"), last) - F.greatest(F.col("__end") - F.col("size"), first), F.lit(0))

    once = within(F.col("__at") * block, (F.col("__at") + F.col("__more")) * block)
    wrapped = within(F.lit(0), (F.col("__at") + F.col("__more") - F.col("__blocks")) * block)
    named = [c for c in keep if c not in ("size", "source_size", "target", "taken")]
    return laid.select(*[F.col("__row")[c].alias(c) for c in named], "size", "source_size", "target",
                       (F.col("__passes") * F.col("size") + once + wrapped).cast("long").alias("taken"))


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each row as often as the mix takes it.

    A row stands as many times as its taken words hold its size, to the nearest whole number
    (halves up); rows taken less than half, and rows without words, go.
    """
    columns = docs.columns
    row = F.struct(*[docs[c] for c in columns]).alias("__doc")
    counted = mix(docs.select(docs[key].alias("__k"), docs[text].alias("__t"), docs[source].alias("__o"), row),
                  "__k", "__t", "__o", keep=["__doc"], **options)
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    return (counted.withColumn("__n", times).where("__n > 0")
            .select("__doc", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__doc.*"))
