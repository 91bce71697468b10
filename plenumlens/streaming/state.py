"""Keyed state with a lifetime of its own, timers, and two notions of lateness.

Time is event time throughout: a watermark that follows the rows' own times decides what
expires, so a run over old files ends in the same state as one that saw them arrive. A row
without a key carries no data; it only moves the clock on (see :func:`clock_rows`).
"""

from __future__ import annotations

import datetime
import json
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plenumlens.operators.refresh import COMPLETE_HOURS, FUTURE_HOURS, ONGOING_HOURS, STATE_DAYS
from plenumlens.streaming.jobs import start_stream

#: The state store that these operators need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

DAY_MS = 86_400_000


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, on local disk and in the checkpoint."""
    key, provider = STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@lru_cache(maxsize=4096)
def _day_ms(day: str) -> int | None:
    """Midnight of a calendar day ``YYYY-MM-DD`` in milliseconds, None if it is no such day."""
    try:
        parsed = datetime.datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=datetime.timezone.utc)
    except (TypeError, ValueError):
        return None
    return int(parsed.timestamp() * 1000)


class ProcessedDays(StatefulProcessor):
    """The days of a proceeding that were taken, each once; a day is forgotten ``keep_days`` after it.

    A day that cannot be read has no age and is kept. Emits each day at its first arrival. What is
    held is one value, read and written once for all rows of a batch, and one timer waits for the
    day that ends next: a day costs no call to the state store of its own.
    """

    def __init__(self, keep_days: int):
        self.keep_ms = keep_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getValueState("days", "days array<string>, expires array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return iter(())
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        ends, fresh = _next_end(held), []
        for day in dict.fromkeys(row["day"] for row in rows):
            name = "" if day is None else day
            if name in held:
                continue
            begins = _day_ms(name)
            expires = None if begins is None else begins + self.keep_ms + DAY_MS  # kept through its last day
            if expires is not None and expires <= now:
                continue  # older than what is remembered: neither new nor known
            held[name] = expires if expires is not None else -1
            fresh.append(day)
        if fresh:
            self._hold(held, ends)
        return iter([Row(proceeding=key[0], day=day) for day in fresh])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        kept = {name: expires for name, expires in held.items() if not 0 <= expires <= now}
        if len(kept) < len(held):
            self._hold(kept, None)
        return iter(())

    def _held(self) -> dict[str, int]:
        known = self.days.get()
        return {} if known is None else dict(zip(known[0], known[1], strict=True))

    def _hold(self, held: dict[str, int], waited: int | None) -> None:
        """Keep these days; ``waited`` is the moment that a timer waits for already."""
        if held:
            self.days.update((list(held), list(held.values())))
        else:
            self.days.clear()
        ends = _next_end(held)
        if ends is not None and ends != waited:
            self.handle.registerTimer(ends)

    def close(self) -> None:
        pass


def _next_end(held: dict[str, int]) -> int | None:
    """When the first of the held days ends."""
    return min((expires for expires in held.values() if expires >= 0), default=None)


def processed_days(stream: DataFrame, proceeding: str, day: str, event_time: str, delay: str = "1 hour", keep_days: int = STATE_DAYS) -> DataFrame:
    """First arrivals (proceeding, day) of a stream; what was taken is state that ends with its lifetime.

    ``proceeding`` and ``day`` are read as text, a null day is a day of its own. A day is held
    until the watermark is ``keep_days`` whole days past it. Start it within :func:`state_store`.
    """
    keyed = stream.select(F.col(proceeding).cast("string").alias("proceeding"), F.col(day).cast("string").alias("day"), F.col(event_time).alias("at"))
    timed = keyed.withWatermark("at", delay)
    return timed.groupBy("proceeding").transformWithState(
        ProcessedDays(keep_days), "proceeding string, day string", "Append", "EventTime")


def held_days(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows (proceeding, day) that the state of :func:`processed_days` holds now."""
    state = spark.read.format("statestore").option("stateVarName", "days").load(checkpoint)
    held = state.select(F.col("key.proceeding").alias("proceeding"), F.explode("value.days").alias("day"))
    return held.select("proceeding", F.nullif("day", F.lit("")).alias("day"))


class SourceHealth(StatefulProcessor):
    """When a source turns healthy or stale: stale as its last check is ``limit_ms`` old, without another row of it.

    Checks wait in state until the watermark has passed them, so that they are judged in the
    order of their times however they come. The last check and those that wait are one value, read
    and written once for all rows of a batch.
    """

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "at bigint, stale boolean, waiting array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return iter(())
        return self._settle(key, timerValues.getCurrentWatermarkInMs(), {row["at_ms"] for row in rows} - {None})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._settle(key, timerValues.getCurrentWatermarkInMs(), set())

    def _settle(self, key, now: int, came: set[int]) -> Iterator[Row]:
        last, stale, held = self.known.get() or (None, True, [])
        was = last, stale, len(held)
        turns: list[tuple[str, int, int]] = []
        waiting = sorted(came.union(held))
        passed = bisect_right(waiting, now)
        for at in waiting[:passed]:
            if last is not None and at <= last:
                continue
            if last is not None and not stale and at - last >= self.limit:
                turns.append(("stale", last + self.limit, last))
                stale = True
            if stale:
                turns.append(("healthy", at, at))
                stale = False
            last = at
        if last is not None and not stale and last + self.limit <= now:
            turns.append(("stale", last + self.limit, last))
            stale = True
        waiting = waiting[passed:]
        if (last, stale, len(waiting)) != was or passed:
            self.known.update((last, stale, waiting))
        due = waiting[:1] + ([last + self.limit] if last is not None and not stale else [])
        if due:
            self.handle.registerTimer(min(due))
        return iter([Row(source=key[0], status=status, at_ms=at, last_ms=seen) for status, at, seen in turns])

    def close(self) -> None:
        pass


def health_turns(stream: DataFrame, source: str, checked_at: str, interval_minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """Rows (source, status, at, last_check) for each moment at which a source turns healthy or stale.

    Stale is the moment two intervals after the last check; a timer emits it when the watermark
    gets there, without a new row of that source. The status at any moment up to the watermark
    is that of the last turn, and none before it is unknown, as :func:`operators.refresh.health`
    has it. Checks without a time are passed over; checks behind the watermark are dropped.
    """
    at = F.col(checked_at).cast("timestamp")
    keyed = stream.select(F.col(source).cast("string").alias("source"), at.alias("at"), F.unix_millis(at).alias("at_ms"))
    turns = keyed.withWatermark("at", delay).groupBy("source").transformWithState(
        SourceHealth(2 * interval_minutes * 60_000), "source string, status string, at_ms long, last_ms long", "Append", "EventTime")
    return turns.select("source", "status", F.timestamp_millis("at_ms").alias("at"), F.timestamp_millis("last_ms").alias("last_check"))


class Worklist(StatefulProcessor):
    """The refresh tier of a proceeding and whether it is due, kept up to date by what arrives and by timers.

    Holds the listed dates, the landed days and the last check, as one value that is read and
    written once for all rows of a batch; a date that is reached and a check that gets too old
    change the answer without a row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "dates string, checked bigint, tier string, refresh boolean, landed array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return iter(())
        dates, checked, tier, refresh, landed = known = self._known()
        days, listed = dict.fromkeys(landed), None
        for row in rows:
            if row["kind"] == "listing":  # of several listings the latest one counts
                at, text = row["at_ms"], row["dates"]
                place = at is None, at or 0, text is None, text or ""
                if listed is None or place >= listed:
                    listed, dates = place, text
            elif row["kind"] == "landed" and row["day"] is not None:
                days[row["day"]] = None
            elif row["kind"] == "check" and row["checked_ms"] is not None:
                checked = row["checked_ms"] if checked is None else max(checked, row["checked_ms"])
        return self._judge(key, timerValues.getCurrentWatermarkInMs(), known, (dates, checked, tier, refresh, list(days)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self._known()
        return self._judge(key, timerValues.getCurrentWatermarkInMs(), known, known)

    def _known(self) -> tuple:
        return self.known.get() or (None, None, None, None, [])

    def _judge(self, key, now: int, before: tuple, known: tuple) -> Iterator[Row]:
        """The change, if there is one, of what is ``known``; it is kept where it is not as ``before``."""
        dates, checked, tier, refresh, landed = known
        told = []
        if dates is not None:  # else not listed yet
            begins = sorted(ms for d in json.loads(dates) if (ms := _day_ms(d)) is not None)
            today = now // DAY_MS * DAY_MS
            past = sum(ms <= today for ms in begins)
            future = len(begins) - past
            if future and not past:
                found = "future"
            elif past and not future:
                found = "complete" if len(landed) >= past else "incomplete"
            else:
                found = "ongoing"
            hours = _TIER_HOURS.get(found)
            due = checked is None or hours is None or now - checked > hours * 3_600_000
            turns = [begins[past]] if future else []
            if not due:
                turns.append(checked + hours * 3_600_000 + 1)
            if turns:
                self.handle.registerTimer(min(turns))
            if (found, due) != (tier, refresh):
                known = dates, checked, found, due, landed
                told.append(Row(proceeding=key[0], tier=found, refresh=due, as_of_ms=now))
        if known != before:
            self.known.update(known)
        return iter(told)

    def close(self) -> None:
        pass


_TIER_HOURS = {"future": FUTURE_HOURS, "complete": COMPLETE_HOURS, "ongoing": ONGOING_HOURS}

#: What arrives for a work-list: listings with ``dates``, landed days with ``day``, checks with ``checked_at``; ``at`` is the arrival.
NEWS = "kind string, proceeding string, dates array<string>, day string, checked_at timestamp, at timestamp"


def worklist_changes(news: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Rows (proceeding, tier, refresh, as_of) for each change, of a stream of :data:`NEWS`.

    The last row of a proceeding is what :func:`operators.refresh.refresh_worklist` gives for all
    that has arrived, with the watermark as the present. A proceeding that is not listed has none.
    """
    rows = news.select(
        "kind", "proceeding", F.to_json("dates").alias("dates"), "day", F.unix_millis("checked_at").alias("checked_ms"),
        "at", F.unix_millis("at").alias("at_ms"))
    changes = rows.withWatermark("at", delay).groupBy("proceeding").transformWithState(
        Worklist(), "proceeding string, tier string, refresh boolean, as_of_ms long", "Update", "EventTime")
    return changes.select("proceeding", "tier", "refresh", F.timestamp_millis("as_of_ms").alias("as_of"))


def clock_rows(spark: SparkSession, like: DataFrame, event_time: str, moment: Column) -> DataFrame:
    """One row with the columns of ``like``, all null but its time: it moves a watermark on and is no data."""
    columns = [(moment.cast(t) if c == event_time else F.lit(None).cast(t)).alias(c) for c, t in like.dtypes]
    return spark.range(1).select(*columns)


def route_late(
    stream: DataFrame, event_time: str, day: str, ref: Column, path: str, checkpoint: str, delay: str = "7 days",
    max_age_days: int = 7, poll_minutes: int | None = None,
) -> StreamingQuery:
    """Write every row with both answers to whether it is late, and how many there are of each kind.

    ``behind``: its time is before the watermark, which is the latest time of all earlier batches
    less ``delay``, as Spark's own. ``aged``: its day is not within ``max_age_days`` before and one
    day after ``ref``; without a day it is aged, without a time never behind. Rows go to
    ``path/rows`` in folders ``behind=.../aged=...``, counts to ``path/counts``, both below the batch's own
    folder: a batch that runs again replaces what it wrote, and no row is lost.
    """
    spark = stream.sparkSession
    gap = F.expr(f"INTERVAL {delay}")

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        marks = session.read.schema("latest timestamp, batch_id long").parquet(f"{path}/marks")
        before = marks.where(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
        late = F.lit(False) if before is None else F.coalesce(F.col(event_time) < F.lit(before) - gap, F.lit(False))
        age = F.coalesce(~F.datediff(ref, F.col(day)).between(-1, max_age_days), F.lit(True))
        marked = batch.withColumns({"behind": late, "aged": age})
        marked.write.mode("overwrite").partitionBy("behind", "aged").parquet(f"{path}/rows/batch_id={batch_id}")
        written = session.read.schema(marked.schema).parquet(f"{path}/rows/batch_id={batch_id}")
        written.groupBy("behind", "aged").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/counts/batch_id={batch_id}")
        written.agg(F.max(event_time).cast("timestamp").alias("latest")).write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")

    spark.createDataFrame([], "latest timestamp").write.mode("overwrite").parquet(f"{path}/marks/batch_id=-1")
    return start_stream(stream.withWatermark(event_time, delay), checkpoint, poll_minutes, "append").foreachBatch(each).start()
