"""The same operators on arriving files: ingest, de-duplicate, score, audit and notify."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plenumlens.functions.keywords import Keyword
from plenumlens.operators.evaluation import CALLS_PER_MINUTE, quota_usage
from plenumlens.operators.fragments import extract_fragments
from plenumlens.operators.refresh import STATE_DAYS, digest_lines

POLL_MINUTES = 30


def arriving_files(
    spark: SparkSession, folder: str, schema, file_format: str = "json", glob: str | None = None,
    files_per_batch: int | None = None, **options: str,
) -> DataFrame:
    """New files of a folder as a stream; each file is read once, remembered in the checkpoint."""
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def start_stream(stream: DataFrame, checkpoint: str, poll_minutes: int | None, mode: str):
    """A writer that takes what is there, or polls every ``poll_minutes``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if poll_minutes is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{poll_minutes} minutes")


def ingest(
    stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), poll_minutes: int | None = None,
    spread: int = 4,
) -> StreamingQuery:
    """Append a stream to a parquet table; one pass, or polling every ``poll_minutes``.

    Rows are clustered by ``partition_by`` first, a hot folder over ``spread`` tasks, so that a
    batch writes few files.
    """
    if partition_by:
        salt = F.pmod(F.xxhash64(*stream.columns), F.lit(spread))
        stream = stream.repartition(*partition_by, salt)
    writer = start_stream(stream, checkpoint, poll_minutes, "append").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start(path)


def new_days(
    stream: DataFrame, keys: Sequence[str], event_time: str, keep_days: int = STATE_DAYS, buckets: int = 16,
    carry: Sequence[str] = (),
) -> DataFrame:
    """First arrival of each (proceeding, date) as ``keys``, event time and ``carry``; old state is evicted.

    Two rounds, as one day may hold a third of all arrivals: first per (key, salt), which
    spreads a hot day over ``buckets`` tasks and leaves at most that many rows of it, then
    per key. Only these columns are shuffled.
    """
    rows = stream.select(*keys, event_time, *carry, F.pmod(F.xxhash64(*stream.columns), F.lit(buckets)).alias("_salt"))
    timed = rows.withWatermark(event_time, f"{keep_days} days")
    spread = timed.dropDuplicatesWithinWatermark([*keys, "_salt"])
    return spread.dropDuplicatesWithinWatermark(list(keys)).drop("_salt")


def within_age(stream: DataFrame, date: str, ref: Column, max_age_days: int = 7) -> DataFrame:
    """Days from ``max_age_days`` ago to one day ahead of ``ref``, which the caller passes."""
    return stream.where(F.datediff(ref, F.col(date)).between(-1, max_age_days))


def score_arriving(stream: DataFrame, lexicon: Sequence[Keyword], keys: Sequence[str], text: str = "text") -> DataFrame:
    """Fragments of arriving statements; stateless, since cutting and scoring stay in a row."""
    return extract_fragments(stream, lexicon, keys, text)


def quota_stream(
    calls: DataFrame, ts: str, provider: str, delay: str = "5 minutes", caps: dict[str, int] = CALLS_PER_MINUTE,
) -> DataFrame:
    """Calls per provider and minute while they arrive."""
    return quota_usage(calls.withWatermark(ts, delay), ts, provider, caps)


def updates(stream: DataFrame, path: str, checkpoint: str, poll_minutes: int | None = None) -> StreamingQuery:
    """Write the rows of an aggregate that each batch changes under the batch's own folder.

    Unlike with appending, a window can be read before the watermark closes it, and state older
    than the watermark still goes. A reader takes the last row of each window.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start_stream(stream, checkpoint, poll_minutes, "update").foreachBatch(each).start()


def notify(
    stream: DataFrame, key: str, date: str, title: str, event_time: str, path: str, checkpoint: str,
    poll_minutes: int | None = None, deliver: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """One digest per batch that brings a day that no batch before it brought.

    Digests are written under the batch's own folder, so that a batch run again after a
    failure replaces its digest instead of repeating it.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        lines = digest_lines(batch, key, date, title).persist()
        if not lines.isEmpty():
            lines.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            if deliver is not None:
                deliver(lines, batch_id)
        lines.unpersist()

    fresh = new_days(stream, [key, date], event_time, carry=[title])
    return start_stream(fresh, checkpoint, poll_minutes, "append").foreachBatch(each).start()
