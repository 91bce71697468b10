"""Streams with state of their own: lifetimes, timers, late rows and restarts."""

import datetime
import random
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from plenumlens.operators import refresh
from plenumlens.streaming import jobs, state

SCHEMA = "source string, day string, ts timestamp"


def moment(text):
    return datetime.datetime.fromisoformat(text)


class Feed:
    """A folder where rows arrive, and a stream over it that ends when it has read them."""

    def __init__(self, spark, folder, shape):
        self.spark, self.src, self.out, self.marks, self.shape = spark, f"{folder}/in", f"{folder}/out", f"{folder}/marks", shape

    def run(self, rows=(), clock=None):
        df = self.spark.createDataFrame([(s, d, None if t is None else moment(t)) for s, d, t in rows], SCHEMA)
        if clock:
            df = df.union(state.clock_rows(self.spark, df, "ts", F.to_timestamp(F.lit(clock))))
        df.coalesce(1).write.mode("append").parquet(self.src)
        with state.state_store(self.spark):
            made = self.shape(jobs.arriving_files(self.spark, self.src, SCHEMA, "parquet"))
            jobs.ingest(made, self.out, self.marks).awaitTermination()
        return sorted(map(tuple, self.spark.read.schema(made.schema).parquet(self.out).collect()), key=str)


def days_feed(spark, folder):
    return Feed(spark, folder, lambda s: state.processed_days(s, "source", "day", "ts", delay="0 seconds", keep_days=30))


def held(spark, feed):
    return {(r.proceeding, r.day) for r in state.held_days(spark, feed.marks).collect()}


def test_days_are_held_for_their_lifetime_and_no_longer(spark, tmp_path):
    feed = days_feed(spark, tmp_path)
    rows = [("p", "2024-01-01", "2024-01-01T10:00:00"), ("p", "2024-01-02", "2024-01-02T10:00:00"), ("q", "soon", "2024-01-02T11:00:00"),
            ("q", None, "2024-01-02T12:00:00"), ("p", "2024-01-01", "2024-01-02T13:00:00")]
    first = feed.run(rows)
    assert first == sorted([("p", "2024-01-01"), ("p", "2024-01-02"), ("q", "soon"), ("q", None)], key=str)
    assert feed.run([("p", "2024-01-02", "2024-01-03T00:00:00")]) == first  # taken already, also after a restart
    feed.run(clock="2024-01-31T23:59:59")  # the first day's last
    assert held(spark, feed) == {("p", "2024-01-01"), ("p", "2024-01-02"), ("q", "soon"), ("q", None)}
    feed.run(clock="2024-02-01T00:00:01")
    assert held(spark, feed) == {("p", "2024-01-02"), ("q", "soon"), ("q", None)}
    feed.run(clock="2024-06-01T00:00:00")
    assert held(spark, feed) == {("q", "soon"), ("q", None)}  # days that cannot be read have no age
    assert feed.run([("p", "2024-01-02", "2024-06-02T00:00:00"), ("p", "2024-06-01", "2024-06-02T00:00:00")]) == sorted(
        [*first, ("p", "2024-06-01")], key=str)  # older than what is remembered: not new
    assert held(spark, feed) == {("q", "soon"), ("q", None), ("p", "2024-06-01")}


def test_state_agrees_with_the_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=12 * k)
        rows.append((rng.choice("abc"), at.date().isoformat() if rng.random() < 0.9 else "?", at.isoformat()))
    feed = days_feed(spark, tmp_path)
    for part in (rows[:20], rows[20:40], rows[40:]):
        feed.run(part)
    feed.run(clock="2024-02-09T00:00:01")
    table = spark.createDataFrame([(s, d) for s, d, _ in rows], "proceeding string, day string").distinct()
    kept = refresh.prune_state(table, "day", F.to_date(F.lit("2024-02-09")))
    assert held(spark, feed) == set(map(tuple, kept.collect()))


def turns_feed(spark, folder, delay="0 seconds"):
    return Feed(spark, folder, lambda s: state.health_turns(s, "source", "ts", interval_minutes=30, delay=delay))


def test_a_source_turns_stale_without_a_row_of_its_own(spark, tmp_path):
    feed = turns_feed(spark, tmp_path)
    feed.run([("a", None, "2024-01-01T10:00:00"), ("a", None, "2024-01-01T10:59:59"), ("b", None, "2024-01-01T10:30:00"), ("b", None, None)])
    told = feed.run([("b", None, "2024-01-01T11:25:00")])
    assert [(s, k) for s, k, *_ in told] == [("a", "healthy"), ("b", "healthy")]
    told = feed.run([("b", None, "2024-01-01T12:10:00"), ("c", None, "2024-01-01T12:10:00")])  # nothing of a: its hour is over
    assert ("a", "stale", moment("2024-01-01T11:59:59"), moment("2024-01-01T10:59:59")) in told
    assert Counter(s for s, *_ in told) == {"a": 2, "b": 1, "c": 1}
    told = feed.run([("a", None, "2024-01-01T12:30:00")], clock="2024-01-01T20:00:00")
    assert [(k, str(t)[11:]) for s, k, t, _ in sorted(told, key=lambda r: r[2]) if s == "a"] == [
        ("healthy", "10:00:00"), ("stale", "11:59:59"), ("healthy", "12:30:00"), ("stale", "13:30:00")]
    before = feed.run()
    assert before == told  # a run without rows repeats nothing


@pytest.mark.parametrize("parts", [1, 4])
def test_turns_agree_with_the_batch_at_each_moment(spark, tmp_path, parts):
    rng = random.Random(7)
    checks, at = [], datetime.datetime(2024, 1, 1)
    for _ in range(80):
        at += datetime.timedelta(minutes=rng.choice([3, 7, 20, 45, 70]))
        checks.append((rng.choice("ab"), None, at.isoformat()))
    late = [checks[i + (1 if i % 2 == 0 else -1)] for i in range(80)]  # neighbours change places
    feed = turns_feed(spark, tmp_path, "2 hours")
    size = 80 // parts
    for k in range(parts):
        feed.run(late[k * size:(k + 1) * size])
    told = feed.run(clock=(at + datetime.timedelta(hours=9)).isoformat())
    table = spark.createDataFrame([(s, moment(t)) for s, _, t in checks], "source string, ts timestamp").cache()
    for _ in range(6):
        when = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(60, 2600))
        seen = table.where(F.col("ts") <= F.lit(when))
        want = {r.source: r.status for r in refresh.health(seen, ["source"], "ts", F.lit(when), 30).collect()}
        got = {}
        for s, status, turned, _ in sorted(told, key=lambda r: r[2]):
            if turned <= when:
                got[s] = status
        assert got == want


def test_late_rows_are_told_apart_and_none_is_lost(spark, tmp_path):
    path, marks, src = (str(tmp_path / n) for n in ("routed", "marks", "in"))
    batches = [[("a", "2024-01-10", "2024-01-10T00:00:00"), ("a", None, None)],
               [("b", "2024-01-08", "2024-01-08T00:00:00"), ("b", "2024-01-01", "2024-01-01T00:00:00"), ("c", "2024-01-22", "2024-01-22T00:00:00")],
               [("d", "2024-01-14", "2024-01-14T12:00:00"), ("d", "2024-01-15", "2024-01-15T00:00:00"), ("e", "2024-01-21", "2024-01-21T00:00:00")]]
    watermarks = []
    for rows in batches:
        df = spark.createDataFrame([(s, d, None if t is None else moment(t)) for s, d, t in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(src)
        stream = jobs.arriving_files(spark, src, SCHEMA, "parquet")
        run = state.route_late(stream, "ts", "day", F.to_date(F.lit("2024-01-15")), path, marks)
        run.awaitTermination()
        watermarks.append(run.lastProgress["eventTime"].get("watermark"))
    rows = spark.read.schema(f"{SCHEMA}, batch_id long, behind boolean, aged boolean").parquet(f"{path}/rows").collect()
    assert {(r.batch_id, r.source, r.day): (r.behind, r.aged) for r in rows} == {
        (0, "a", "2024-01-10"): (False, False), (0, "a", None): (False, True),
        (1, "b", "2024-01-08"): (False, False), (1, "b", "2024-01-01"): (True, True), (1, "c", "2024-01-22"): (False, True),
        (2, "d", "2024-01-14"): (True, False), (2, "d", "2024-01-15"): (False, False), (2, "e", "2024-01-21"): (False, True)}
    counts = spark.read.schema("behind boolean, aged boolean, rows long, batch_id long").parquet(f"{path}/counts").collect()
    per_batch = Counter()
    for r in counts:
        per_batch[r.batch_id] += r.rows
    assert per_batch == {0: 2, 1: 3, 2: 3}
    assert [w[:10] for w in watermarks[1:]] == ["2024-01-03", "2024-01-15"]  # Spark's own watermarks


def test_the_kept_worklist_is_that_of_a_new_computation(spark, tmp_path):
    rng = random.Random(8)
    src, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    start = datetime.datetime(2024, 1, 10)
    seen = []
    for k in range(5):
        at = start + datetime.timedelta(hours=31 * k)
        rows = [("check", rng.choice("abcd"), None, None, at - datetime.timedelta(hours=rng.randrange(200)), at) for _ in range(2)]
        rows += [("landed", rng.choice("abcd"), None, f"2024-01-{rng.randrange(8, 16):02}", None, at) for _ in range(4)]
        rows += [("listing", p, [f"2024-01-{d:02}" for d in sorted(rng.sample(range(8, 18), 3))] + ["soon"] * (p == "d"), None, None, at) for p in "abd" if k in (0, 3)]
        seen += rows
        df = spark.createDataFrame(rows, state.NEWS)
        clock = at + datetime.timedelta(hours=7)
        df.union(state.clock_rows(spark, df, "at", F.lit(clock))).coalesce(1).write.mode("append").parquet(src)
        with state.state_store(spark):
            jobs.updates(state.worklist_changes(jobs.arriving_files(spark, src, state.NEWS, "parquet")), out, marks).awaitTermination()
        told = spark.read.schema("proceeding string, tier string, refresh boolean, as_of timestamp, batch_id long").parquet(out).collect()
        got = {r.proceeding: (r.tier, r.refresh) for r in sorted(told, key=lambda r: (r.batch_id, r.as_of))}
        news = spark.createDataFrame(seen, state.NEWS)
        listed = news.where("kind = 'listing'").groupBy("proceeding").agg(F.max_by("dates", "at").alias("dates"))
        landed = news.where("kind = 'landed'").select("proceeding", F.col("day").alias("date"))
        checks = refresh.latest_checks(news.where("kind = 'check'"), ["proceeding"])
        want = refresh.refresh_worklist(listed, landed, checks, ["proceeding"], F.lit(clock))
        assert got == {r.proceeding: (r.tier, r.refresh) for r in want.collect()}


class Kept:
    """State and timers of one key in memory, and how often they are called."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def days_of(n):
    return [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in range(n)]


@pytest.mark.parametrize("made, rows", [
    (lambda: state.ProcessedDays(30), lambda n: [{"day": str(d)} for d in days_of(n)]),
    (lambda: state.SourceHealth(1000), lambda n: [{"at_ms": 700 * k} for k in range(n)]),
    (state.Worklist, lambda n: [{"kind": "listing", "at_ms": 1, "dates": '["2024-01-01"]'}] + [{"kind": "landed", "day": str(d)} for d in days_of(n)]),
], ids=["days", "health", "worklist"])
def test_state_is_called_as_often_for_many_rows_as_for_one(made, rows):
    calls = []
    for n in (1, 400):
        processor, kept = made(), Kept()
        processor.init(kept)
        for now in (0, 10 ** 13):
            clock = SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now)
            list(processor.handleInputRows(("p",), iter(rows(n)) if not now else iter(()), clock))
            for at in sorted(kept.timers):
                list(processor.handleExpiredTimer(("p",), clock, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)))
        calls.append(kept.calls)
    assert calls[1] <= calls[0] + 2 and calls[1] < 20
