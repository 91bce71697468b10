"""Queries over ``events``: a user is a proceeding, the days of the events are its dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenumlens.functions import fields
from plenumlens.operators import ranking, refresh, statements, summaries
from plenumlens.operators.evaluation import CALLS_PER_MINUTE
from plenumlens.plans.registry import query, table
from plenumlens.session import materialize, scratch_path
from plenumlens.sinks import writers
from plenumlens.sources import tables, transcripts
from plenumlens.streaming import jobs, state

REF = "2024-01-20"
NOW = "2024-01-20 12:00:00"

_DAYS = "SELECT DISTINCT user_id, ts::DATE AS d FROM events"
_PROCEEDINGS = f"""SELECT user_id, list_sort(list(strftime(d, '%Y-%m-%d'))) AS dates,
  user_id % 3 = 0 AS current FROM ({_DAYS}) GROUP BY user_id"""


def ref():
    return F.to_date(F.lit(REF))


def now():
    return F.to_timestamp(F.lit(NOW))


def events(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events").select(*columns)


def days(spark, sf_dir):
    """Distinct (user, day): at most one row per calendar day."""
    rows = events(spark, sf_dir, "user_id", F.to_date("ts").alias("date"))
    return rows.groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("n"))


def proceedings(spark, sf_dir):
    dates = F.array_sort(F.collect_list(F.date_format("date", "yyyy-MM-dd")))
    listed = days(spark, sf_dir).groupBy("user_id").agg(dates.alias("dates"))
    return listed.withColumn("current", F.col("user_id") % 3 == 0)


@query("flt_future_dates", f"""WITH p AS ({_PROCEEDINGS})
SELECT user_id, len(list_filter(dates, lambda x: x::DATE <= DATE '2024-01-05'))::BIGINT AS past,
  len(list_filter(dates, lambda x: x::DATE > DATE '2024-01-05')) = len(dates) AS skipped FROM p""")
def flt_future_dates(spark, sf_dir):
    day = F.to_date(F.lit("2024-01-05"))
    return proceedings(spark, sf_dir).select(
        "user_id", F.size(statements.past_dates(F.col("dates"), day)).alias("past"),
        statements.all_future(F.col("dates"), day).alias("skipped"),
    )


@query("flt_current", f"""WITH p AS ({_PROCEEDINGS})
SELECT user_id FROM p WHERE current OR len(list_filter(dates, lambda x: date_diff('day', x::DATE, DATE '2024-02-05') BETWEEN -1 AND 7)) > 0""")
def flt_current(spark, sf_dir):
    rows = proceedings(spark, sf_dir)
    day = F.to_date(F.lit("2024-02-05"))
    return rows.where(statements.is_current(F.col("dates"), F.col("current"), day)).select("user_id")


@query("flt_with_id_and_dates", f"SELECT DISTINCT user_id AS number FROM ({_DAYS}) WHERE user_id > 0")
def flt_with_id_and_dates(spark, sf_dir):
    return statements.with_id_and_dates(proceedings(spark, sf_dir).withColumnRenamed("user_id", "number")).select("number")


@query("flt_valid_keys", """WITH k AS (SELECT event_id, user_id % 25 AS term, user_id AS proceeding,
 CASE event_type WHEN 'error' THEN '2024-02-30' WHEN 'signup' THEN strftime(ts, '%Y%m%d') WHEN 'view' THEN strftime(ts, '%Y-%m-%d') || 'x'
 ELSE strftime(ts, '%Y-%m-%d') END AS d FROM events)
SELECT event_id, concat_ws(',', CASE WHEN term NOT BETWEEN 1 AND 20 THEN 'term' END,
 CASE WHEN proceeding NOT BETWEEN 1 AND 200 THEN 'proceeding' END,
 CASE WHEN NOT regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date_format' WHEN try_cast(d AS DATE) IS NULL THEN 'date_value' END) AS errors FROM k""")
def flt_valid_keys(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    date = (
        F.when(F.col("event_type") == "error", F.lit("2024-02-30"))
        .when(F.col("event_type") == "signup", F.date_format("ts", "yyyyMMdd"))
        .when(F.col("event_type") == "view", F.concat(day, F.lit("x"))).otherwise(day)
    )
    errors = fields.validation_errors(F.col("user_id") % 25, F.col("user_id"), date)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(errors, ",").alias("errors"))


_LISTED = "SELECT user_id AS number, 10::BIGINT AS term, 'listed ' || user_id AS title, count(*) AS n FROM events GROUP BY user_id"
_DETAIL = "SELECT user_id AS number, 10::BIGINT AS term, 'detail ' || user_id AS title, count(*) AS n FROM events WHERE value > 200 GROUP BY user_id"


def listed(spark, sf_dir):
    return events(spark, sf_dir, "user_id").groupBy(F.col("user_id").alias("number")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(10).alias("term"), "number", F.concat(F.lit("listed "), "number").alias("title"), "n")


def detail(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id", "value").where(F.col("value") > 200)
    return rows.groupBy(F.col("user_id").alias("number")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(10).alias("term"), "number", F.concat(F.lit("detail "), "number").alias("title"), "n")


@query("join_proceeding_detail", f"""SELECT l.number, l.term, coalesce(d.title, l.title) AS title, coalesce(d.n, l.n) AS n,
 d.number IS NOT NULL AS from_detail FROM ({_LISTED}) l LEFT JOIN ({_DETAIL}) d USING (term, number)""")
def join_proceeding_detail(spark, sf_dir):
    return statements.prefer_detail(listed(spark, sf_dir), detail(spark, sf_dir), ["term", "number"], ["title", "n"])


@query("flt_select_proceeding", f"""SELECT l.number, l.term, coalesce(d.title, l.title) AS title, coalesce(d.n, l.n) AS n,
 d.number IS NOT NULL AS from_detail FROM ({_LISTED}) l LEFT JOIN ({_DETAIL}) d USING (term, number) WHERE l.number = 7""")
def flt_select_proceeding(spark, sf_dir):
    return statements.select_proceeding(listed(spark, sf_dir), detail(spark, sf_dir), 10, 7, ["title", "n"])


@query("agg_proceeding_summary", """SELECT user_id, count(DISTINCT ts::DATE) AS total_days, count(*) AS total_statements,
 count(DISTINCT event_type) FILTER (WHERE event_type <> 'view') AS total_speakers,
 array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y-%m-%d'))), ',') AS dates FROM events GROUP BY user_id""")
def agg_proceeding_summary(spark, sf_dir):
    speaker = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type"))
    rows = events(spark, sf_dir, "user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), speaker.alias("speaker"))
    return summaries.proceeding_summary(rows, ["user_id"], "date", "speaker").withColumn("dates", F.array_join("dates", ","))


@query("agg_term_summary", """WITH p AS (SELECT event_type AS term, user_id, count(DISTINCT ts::DATE) AS t, count(*) AS n FROM events GROUP BY ALL)
SELECT term, user_id, false AS is_term_total, 1::BIGINT AS proceedings, t::BIGINT AS transcripts, n::BIGINT AS total_statements FROM p
UNION ALL SELECT term, NULL, true, count(*), sum(t)::BIGINT, sum(n)::BIGINT FROM p GROUP BY term""")
def agg_term_summary(spark, sf_dir):
    rows = events(spark, sf_dir, F.col("event_type").alias("term"), "user_id", F.to_date("ts").alias("date"))
    return summaries.term_summary(rows, "term", "user_id", "date")


def kept_partials(spark, sf_dir, keys, date):
    """The partial aggregates of all days, kept in three updates; the days of the last came in part before."""
    speaker = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type")).alias("speaker")
    rows = events(spark, sf_dir, *[k for k in keys], date.alias("date"), speaker, F.col("ts").alias("at"))
    path = scratch_path(spark, "partials")
    again, first = F.dayofmonth("at") % 4 == 1, F.dayofmonth("at") <= 15
    names = [k if isinstance(k, str) else "term" for k in keys]
    for some in (rows.where(first & (~again | (F.hour("at") < 12))), rows.where(~first & ~again), rows.where(again)):
        summaries.store_partials(some, path, names, "date", "speaker")
    return summaries.read_partials(rows, path, names, "date", "speaker")


@query("agg_proceeding_increments", """SELECT user_id, count(DISTINCT ts::DATE) AS total_days, count(*) AS total_statements,
 count(DISTINCT event_type) FILTER (WHERE event_type <> 'view') AS total_speakers,
 array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y-%m-%d'))), ',') AS dates FROM events GROUP BY user_id""")
def agg_proceeding_increments(spark, sf_dir):
    """The summary of proceedings from what was kept of each day as it came, or came again."""
    partials = kept_partials(spark, sf_dir, ["user_id"], F.date_format("ts", "yyyy-MM-dd"))
    return summaries.proceeding_summary_of(partials, ["user_id"], "date", "speaker").withColumn("dates", F.array_join("dates", ","))


@query("agg_term_increments", """WITH p AS (SELECT event_type AS term, user_id, count(DISTINCT ts::DATE) AS t, count(*) AS n FROM events GROUP BY ALL)
SELECT term, user_id, false AS is_term_total, 1::BIGINT AS proceedings, t::BIGINT AS transcripts, n::BIGINT AS total_statements FROM p
UNION ALL SELECT term, NULL, true, count(*), sum(t)::BIGINT, sum(n)::BIGINT FROM p GROUP BY term""")
def agg_term_increments(spark, sf_dir):
    """The summary of terms from the same kind of partial aggregates."""
    partials = kept_partials(spark, sf_dir, [F.col("event_type").alias("term"), "user_id"], F.to_date("ts"))
    return summaries.term_summary_of(partials, "term", "user_id", "date")


@query("agg_state_totals", f"SELECT count(DISTINCT user_id) AS processed_proceedings, count(*) AS processed_dates FROM ({_DAYS})")
def agg_state_totals(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id", F.to_date("ts").alias("date"))
    return summaries.state_totals(rows, "user_id", "date")


@query("win_first_per_key", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
 ORDER BY ts, event_id) AS r FROM events WHERE user_id % 7 <> 0) WHERE r = 1""")
def win_first_per_key(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id", "ts", "event_id", "event_type", "value")
    # every seventh user's rows are unnumbered: 0 or null
    number = F.when(F.col("user_id") % 7 != 0, F.col("user_id")).when(F.col("event_id") % 2 == 0, 0)
    return ranking.first_per_key(rows.withColumn("user_id", number), ["user_id"], ["ts", "event_id"], number="user_id").drop("ts")


@query("win_latest", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
 ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def win_latest(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id", "ts", "event_id", "event_type", "value")
    return ranking.latest_per_key(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("ord_dates", f"SELECT user_id, array_to_string(dates, ',') AS dates FROM ({_PROCEEDINGS})")
def ord_dates(spark, sf_dir):
    return proceedings(spark, sf_dir).select("user_id", F.array_join("dates", ",").alias("dates"))


@query("win_first_dates", f"""SELECT user_id, d AS date, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) AS pos
 FROM ({_DAYS})) WHERE pos <= 2""")
def win_first_dates(spark, sf_dir):
    return ranking.topk_per_group(days(spark, sf_dir).drop("n"), ["user_id"], [F.col("date")], 2, ["date"], rank="pos")


_EXISTING = "SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'purchase'"


@query("join_refresh", f"""SELECT * FROM (SELECT user_id, d AS date FROM ({_DAYS}) WHERE d <= DATE '{REF}'
 EXCEPT SELECT user_id, d FROM ({_EXISTING}))""")
def join_refresh(spark, sf_dir):
    landed = events(spark, sf_dir, "user_id", "event_type", F.to_date("ts").alias("date")).where(F.col("event_type") == "purchase")
    return refresh.new_dates(proceedings(spark, sf_dir), landed, ["user_id"], ref())


@query("upd_worklist", f"""WITH p AS (SELECT user_id, count(*) FILTER (WHERE d > DATE '{REF}') AS f, count(*) FILTER (WHERE d <= DATE '{REF}') AS b
  FROM (SELECT DISTINCT user_id, d FROM ({_DAYS}) WHERE user_id % 2 = 0 OR (user_id % 4 = 1) = (d <= DATE '{REF}')) GROUP BY user_id),
e AS (SELECT user_id, count(*) AS landed FROM ({_DAYS}) WHERE user_id % 5 > 0 AND d <= DATE '{REF}' GROUP BY user_id),
c AS (SELECT user_id, max(ts) AS last_check FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '{NOW}' GROUP BY user_id),
t AS (SELECT user_id, CASE WHEN f > 0 AND b = 0 THEN 'future' WHEN b > 0 AND f = 0 THEN CASE WHEN coalesce(landed, 0) >= b THEN 'complete' ELSE 'incomplete' END
  ELSE 'ongoing' END AS tier, last_check FROM p LEFT JOIN e USING (user_id) LEFT JOIN c USING (user_id))
SELECT user_id, tier, last_check IS NULL OR tier = 'incomplete' OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_check) >
  3600000000 * CASE tier WHEN 'future' THEN 24 WHEN 'complete' THEN 168 ELSE 2 END AS refresh FROM t""")
def upd_worklist(spark, sf_dir):
    """Odd users keep only their past or only their future days, so that every tier occurs."""
    past = F.col("date") <= ref()
    kept = days(spark, sf_dir).where((F.col("user_id") % 2 == 0) | ((F.col("user_id") % 4 == 1) == past))
    listed_ = kept.groupBy("user_id").agg(F.array_sort(F.collect_list(F.date_format("date", "yyyy-MM-dd"))).alias("dates"))
    existing = days(spark, sf_dir).where((F.col("user_id") % 5 > 0) & past).select("user_id", "date")
    log = events(spark, sf_dir, "user_id", "event_type", F.col("ts").cast("timestamp").alias("checked_at"))
    checks = refresh.latest_checks(log.where((F.col("event_type") == "signup") & (F.col("checked_at") <= now())), ["user_id"])
    return refresh.refresh_worklist(listed_, existing, checks, ["user_id"], now())


@query("flt_state_age", f"""SELECT event_id FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS d FROM events)
WHERE try_cast(d AS DATE) IS NULL OR d::DATE >= DATE '2024-02-14' - 30""")
def flt_state_age(spark, sf_dir):
    day = F.when(F.col("event_type") == "error", F.lit("unknown")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    state = events(spark, sf_dir, "event_id", day.alias("date"))
    return refresh.prune_state(state, "date", F.to_date(F.lit("2024-02-14"))).select("event_id")


@query("str_health", """WITH h AS (SELECT user_id, max(ts) AS last_check FROM events GROUP BY user_id),
a AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(last_check)) / 3600000000.0::DOUBLE AS hours FROM h)
SELECT user_id, CASE WHEN hours < 6.0 THEN 'healthy' ELSE 'stale' END AS status, round(hours, 2) AS hours_since_check FROM a""")
def str_health(spark, sf_dir):
    log = events(spark, sf_dir, "user_id", "ts")
    moment = F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    return refresh.health(log, ["user_id"], "ts", moment, interval_minutes=180).drop("last_check")


@query("str_quota", """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, provider, count(*) AS calls,
 count(*) > CASE provider WHEN 'ollama' THEN 1000 WHEN 'openai' THEN 50 WHEN 'claude' THEN 40 ELSE 60 END AS over_quota
FROM (SELECT ts, ['ollama', 'openai', 'claude', 'gemini'][1 + user_id % 4] AS provider FROM events) GROUP BY date_trunc('minute', ts), provider""")
def str_quota(spark, sf_dir):
    names = F.array(*[F.lit(p) for p in ("ollama", "openai", "claude", "gemini")])
    provider = F.element_at(names, (F.col("user_id") % 4 + 1).cast("int"))
    path = scratch_path(spark, "quota")
    state = scratch_path(spark, "quota-state")

    def usage(stream):
        return jobs.quota_stream(stream.select("ts", provider.alias("provider")), "ts", "provider")

    run_in_parts(spark, sf_dir, lambda stream: jobs.updates(usage(stream), path, state))
    # a minute cut in two by the end of a part is counted on by the next batch
    last = F.max_by(F.struct("calls", "over_quota"), "batch_id").alias("last")
    kind = "minute timestamp, provider string, calls long, over_quota boolean, batch_id long"
    used = spark.read.schema(kind).parquet(path).groupBy("minute", "provider").agg(last)
    timed = used.select(F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), "provider", "last.*")
    # windows leave out calls without a time, which are of no minute
    untimed = events(spark, sf_dir, "ts", provider.alias("provider")).where("ts is null").groupBy("provider").agg(F.count(F.lit(1)).alias("calls"))
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in CALLS_PER_MINUTE.items() for x in kv]), F.col("provider"))
    return timed.union(untimed.select(F.lit(None).cast("string").alias("minute"), "provider", "calls", (F.col("calls") > cap).alias("over_quota")))


_TITLE = "'Sitting of the house, on the matters listed under number ' || user_id"


@query("sink_digest", f"""WITH n AS (SELECT user_id, d FROM ({_DAYS}) WHERE d > DATE '{REF}')
SELECT user_id, count(*) AS new_days, string_agg(strftime(d, '%Y-%m-%d'), ', ' ORDER BY d) AS dates,
 '• ' || user_id || ': ' || string_agg(strftime(d, '%Y-%m-%d'), ', ' ORDER BY d) || chr(10) || '  ' ||
 left({_TITLE}, 50) || '...' AS line FROM n GROUP BY user_id""")
def sink_digest(spark, sf_dir):
    fresh = days(spark, sf_dir).where(F.col("date") > ref())
    title = F.concat(F.lit("Sitting of the house, on the matters listed under number "), "user_id")
    path = scratch_path(spark, "digest")
    lines = refresh.digest_lines(fresh.withColumn("title", title), "user_id", "date", "title")
    writers.write_json(lines, path)
    return spark.read.schema(lines.schema).json(path)


# --- streams over the same file ---


def _dated(stream):
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("date", F.to_date("ts"))


def event_stream(spark, sf_dir):
    """The events as they arrive: the table's files."""
    return _dated(jobs.arriving_files(spark, sf_dir, table(spark, sf_dir, "events").schema, "parquet", "events.parquet"))


def run_in_parts(spark, sf_dir, start, parts: int = 3, clock=None):
    """Run a stream in ``parts`` passes, each over the events written since the last: days cut in two, null times first.

    ``start`` starts the query over the arriving events, always with the same checkpoint. A part
    is as many files as tasks write, and one batch.
    """
    known = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = known.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)])).first()[0] or []
    ranges = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        earlier = F.lit(True) if high is None else at < high
        ranges.append(at.isNull() | earlier if low is None else (at >= low) & earlier)
    run_parts(spark, sf_dir, ranges, start, clock)


def run_parts(spark, sf_dir, conditions, start, clock=None):
    """Let the rows of each condition arrive after the other, and at last a row that only tells the time."""
    known = table(spark, sf_dir, "events")
    path = scratch_path(spark, "arriving")
    arrivals = [known.where(c) for c in conditions] + ([] if clock is None else [state.clock_rows(spark, known, "ts", clock)])
    for rows in arrivals:
        rows.write.mode("append").parquet(path)
        start(_dated(jobs.arriving_files(spark, path, known.schema, "parquet"))).awaitTermination()


@query("str_ingest", "SELECT event_id, user_id, ts::DATE AS date, event_type FROM events")
def str_ingest(spark, sf_dir):
    """One pass over the arriving files into a table partitioned by day."""
    path = scratch_path(spark, "ingested")
    stream = event_stream(spark, sf_dir).select("event_id", "user_id", "date", "event_type")
    jobs.ingest(stream, path, scratch_path(spark, "ingest-state"), ["date"]).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select("event_id", "user_id", "date", "event_type")


@query("str_dedup", f"SELECT user_id, d AS date FROM ({_DAYS})")
def str_dedup(spark, sf_dir):
    path = scratch_path(spark, "new-days")
    state = scratch_path(spark, "new-days-state")

    def fresh(stream):
        return jobs.new_days(stream, ["user_id", "date"], "ts").select("user_id", "date")

    run_in_parts(spark, sf_dir, lambda stream: jobs.ingest(fresh(stream), path, state))
    return spark.read.schema(fresh(event_stream(spark, sf_dir)).schema).parquet(path)


@query("str_late", f"""WITH p AS (SELECT event_id % 3 AS part, max(ts) AS latest FROM events GROUP BY event_id % 3)
SELECT event_id, coalesce(ts < (SELECT max(latest) FROM p WHERE part < e.event_id % 3) - INTERVAL 7 DAY, false) AS behind,
 NOT coalesce(date_diff('day', ts::DATE, DATE '{REF}') BETWEEN -1 AND 7, false) AS aged FROM events e""")
def str_late(spark, sf_dir):
    """Events that come in another order than that of their times: behind the watermark, too old by their day, or both."""
    path, marks = scratch_path(spark, "late"), scratch_path(spark, "late-state")
    run_parts(spark, sf_dir, [F.pmod("event_id", F.lit(3)) == k for k in range(3)],
              lambda stream: state.route_late(stream, "ts", "date", ref(), path, marks))
    kind = dict(table(spark, sf_dir, "events").dtypes)["event_id"]
    rows = spark.read.schema(f"event_id {kind}, batch_id long, behind boolean, aged boolean").parquet(f"{path}/rows")
    return rows.select("event_id", "behind", "aged")


@query("str_state_ttl", """SELECT DISTINCT user_id::VARCHAR AS proceeding, d AS day FROM (SELECT user_id,
 CASE WHEN event_type = 'error' THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS d FROM events)
WHERE try_cast(d AS DATE) IS NULL OR d::DATE >= DATE '2024-02-14' - 30""")
def str_state_ttl(spark, sf_dir):
    """What the state of taken days holds as the clock gets to a later day: the others are gone by themselves."""
    path, marks = scratch_path(spark, "taken-days"), scratch_path(spark, "taken-days-state")
    day = F.when(F.col("event_type") == "error", F.lit("unknown")).otherwise(F.date_format("ts", "yyyy-MM-dd"))

    def taken(stream):
        return state.processed_days(stream.withColumn("day", day), "user_id", "day", "ts")

    with state.state_store(spark):
        run_in_parts(spark, sf_dir, lambda stream: jobs.ingest(taken(stream), path, marks),
                     clock=F.to_timestamp(F.lit("2024-02-14 01:00:01")))
        return materialize(state.held_days(spark, marks), "held-days")


@query("str_health_turns", """WITH c AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS t FROM events WHERE ts <= TIMESTAMP '2024-02-01 12:00:00'),
n AS (SELECT *, lag(t) OVER w AS prior, lead(t) OVER w AS next FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id::VARCHAR AS source, 'healthy' AS status, t AS at_ms, t AS last_ms FROM n WHERE prior IS NULL OR t - prior >= 21600000
UNION ALL SELECT user_id::VARCHAR, 'stale', t + 21600000, t FROM n
 WHERE t + 21600000 <= least(coalesce(next, epoch_ms(TIMESTAMP '2024-02-01 12:00:00')), epoch_ms(TIMESTAMP '2024-02-01 12:00:00'))""")
def str_health_turns(spark, sf_dir):
    """When each source turns stale and healthy again, told by timers."""
    path, marks = scratch_path(spark, "health"), scratch_path(spark, "health-state")

    def turns(stream):
        return state.health_turns(stream, "user_id", "ts", interval_minutes=180)

    with state.state_store(spark):
        run_in_parts(spark, sf_dir, lambda stream: jobs.ingest(turns(stream), path, marks),
                     clock=F.to_timestamp(F.lit("2024-02-01 12:10:00.001")))
    told = spark.read.schema("source string, status string, at timestamp, last_check timestamp").parquet(path)
    return told.where(F.col("at") <= F.to_timestamp(F.lit("2024-02-01 12:00:00"))).select(
        "source", "status", F.unix_millis("at").alias("at_ms"), F.unix_millis("last_check").alias("last_ms"))


@query("upd_worklist_kept", f"""WITH p AS (SELECT user_id, count(*) FILTER (WHERE d > DATE '{REF}') AS f, count(*) FILTER (WHERE d <= DATE '{REF}') AS b
  FROM (SELECT DISTINCT user_id, d FROM ({_DAYS}) WHERE user_id % 2 = 0 OR (user_id % 4 = 1) = (d <= DATE '{REF}')) GROUP BY user_id),
e AS (SELECT user_id, count(*) AS landed FROM ({_DAYS}) WHERE user_id % 5 > 0 AND d <= DATE '{REF}' GROUP BY user_id),
c AS (SELECT user_id, max(ts) AS last_check FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '{NOW}' GROUP BY user_id),
t AS (SELECT user_id, CASE WHEN f > 0 AND b = 0 THEN 'future' WHEN b > 0 AND f = 0 THEN CASE WHEN coalesce(landed, 0) >= b THEN 'complete' ELSE 'incomplete' END
  ELSE 'ongoing' END AS tier, last_check FROM p LEFT JOIN e USING (user_id) LEFT JOIN c USING (user_id))
SELECT user_id::VARCHAR AS proceeding, tier, last_check IS NULL OR tier = 'incomplete' OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_check) >
  3600000000 * CASE tier WHEN 'future' THEN 24 WHEN 'complete' THEN 168 ELSE 2 END AS refresh FROM t""")
def upd_worklist_kept(spark, sf_dir):
    """The same work-list, kept by a stream of listings, landed days and checks; of each proceeding the last change."""
    path, changes, marks = (scratch_path(spark, f"worklist-{n}") for n in ("news", "changes", "state"))
    past = F.col("date") <= ref()
    kept = days(spark, sf_dir).where((F.col("user_id") % 2 == 0) | ((F.col("user_id") % 4 == 1) == past))
    listed_ = kept.groupBy("user_id").agg(F.array_sort(F.collect_list(F.date_format("date", "yyyy-MM-dd"))).alias("dates"))
    existing = days(spark, sf_dir).where((F.col("user_id") % 5 > 0) & past)
    log = events(spark, sf_dir, "user_id", "event_type", F.col("ts").cast("timestamp").alias("checked_at"))
    checks = log.where((F.col("event_type") == "signup") & (F.col("checked_at") <= now()))

    def news(rows, kind, at, **columns):
        given = {"kind": F.lit(kind), "proceeding": F.col("user_id"), "at": F.lit(at), **columns}
        return rows.select(*[(given.get(n, F.lit(None))).cast(t).alias(n) for n, t in (c.split(" ") for c in state.NEWS.split(", "))])

    day = F.date_format("date", "yyyy-MM-dd")
    half = F.col("user_id") % 3 == 0
    arrivals = [
        news(existing.where(half), "landed", "2024-01-02", day=day).union(news(listed_, "listing", "2024-01-02", dates=F.col("dates"))),
        news(existing.where(~half), "landed", "2024-01-03", day=day),
        news(checks, "check", "2024-01-04", checked_at=F.col("checked_at")),
    ]
    arrivals.append(state.clock_rows(spark, arrivals[0], "at", now()))
    with state.state_store(spark):
        for rows in arrivals:
            rows.write.mode("append").parquet(path)
            stream = state.worklist_changes(jobs.arriving_files(spark, path, state.NEWS, "parquet"))
            jobs.updates(stream, changes, marks).awaitTermination()
    told = spark.read.schema("proceeding string, tier string, refresh boolean, as_of timestamp, batch_id long").parquet(changes)
    last = told.groupBy("proceeding").agg(F.max_by(F.struct("tier", "refresh"), F.struct("batch_id", "as_of")).alias("last"))
    return last.select("proceeding", "last.*")


@query("str_notify", f"""SELECT user_id, count(*) AS new_days, string_agg(strftime(d, '%Y-%m-%d'), ', ' ORDER BY d) AS dates
 FROM ({_DAYS}) GROUP BY user_id""")
def str_notify(spark, sf_dir):
    path = scratch_path(spark, "digests")
    state = scratch_path(spark, "digest-state")
    run_in_parts(spark, sf_dir, lambda stream: jobs.notify(stream.withColumn("title", F.lit("sitting")), "user_id", "date", "title", "ts", path, state))
    kind = table(spark, sf_dir, "events").schema["user_id"].dataType.simpleString()
    columns = f"user_id {kind}, new_days long, dates string"
    # without any event no batch writes a digest
    spark.createDataFrame([], columns).write.parquet(f"{path}/batch_id=-1")
    told = spark.read.schema(columns).parquet(path)
    # each day is announced once, in whichever batch brought it first; a null day is counted without a date
    days_of = F.array_sort(F.flatten(F.collect_list(F.split(F.nullif("dates", F.lit("")), ", "))))
    return told.groupBy("user_id").agg(F.sum("new_days").alias("new_days"), F.nullif(F.array_join(days_of, ", "), F.lit("")).alias("dates"))


# --- files of proceedings ---


@query("src_pathkeys", f"SELECT user_id, array_to_string(list_sort(list(strftime(d, '%Y-%m-%d'))), ',') AS dates FROM ({_DAYS}) GROUP BY user_id")
def src_pathkeys(spark, sf_dir):
    """Dates recovered from the names of written transcript files; misnamed files beside them are left out."""
    path = scratch_path(spark, "landed")
    day = F.date_format("date", "yyyy-MM-dd")
    rows = materialize(days(spark, sf_dir).select(F.lit(10).alias("term"), F.col("user_id").alias("proceeding_id"), "date", day.alias("day"), "n"), "landed-days")
    found = rows.select("term", "proceeding_id", F.col("day").alias("date"), F.col("n").alias("num"), F.concat(F.lit("Sitting of "), "day").alias("text"))
    writers.write_transcript_documents(found, path, ["num", "text"], F.lit(NOW))
    # names that are no day: another form of the date, and files about a day
    other = F.when(F.dayofmonth("date") % 5 == 0, F.concat(F.date_format("date", "yyyy_MM_dd"))).when(F.dayofmonth("date") % 7 == 0, F.concat(day, F.lit("_old")))
    writers.write_transcript_documents(found.join(rows.select("proceeding_id", F.col("day").alias("date"), other.alias("other")), ["proceeding_id", "date"]).where(
        "other IS NOT NULL").withColumn("date", F.col("other")), path, ["num", "text"], F.lit(NOW))
    files = transcripts.list_files(spark, path, recursive=True)
    kind = dict(rows.dtypes)["proceeding_id"]
    keyed = files.select(F.regexp_extract("path", "proceeding_id=([^/]+)/", 1).cast(kind).alias("user_id"), "name")
    return transcripts.landed_dates(keyed, ["user_id"]).withColumn("dates", F.array_join("dates", ","))


@query("sink_info_json", f"SELECT user_id AS number, 'Sitting ' || user_id AS title, array_to_string(dates, ',') AS dates, current FROM ({_PROCEEDINGS})")
def sink_info_json(spark, sf_dir):
    """Headers written in their envelope and read by the header reader."""
    rows = proceedings(spark, sf_dir).select(
        F.col("user_id").cast("int").alias("number"), F.concat(F.lit("Sitting "), "user_id").alias("title"), "dates", "current"
    )
    wrapped = writers.in_envelope(rows, F.lit(NOW), "1", ["number", "title", "dates", "current"])
    path = scratch_path(spark, "headers-envelope")
    writers.write_json(wrapped, path)
    return tables.read_proceeding_info(spark, path, json_lines=True).withColumn("dates", F.array_join("dates", ","))


@query("src_proceeding_info", f"SELECT user_id AS number, 'Sitting ' || user_id AS title, array_to_string(dates, ',') AS dates, current FROM ({_PROCEEDINGS})")
def src_proceeding_info(spark, sf_dir):
    """Headers read back from files, each third one in another envelope."""
    rows = proceedings(spark, sf_dir).select(
        F.col("user_id").cast("int").alias("number"), F.concat(F.lit("Sitting "), "user_id").alias("title"), "dates", "current"
    )
    header = F.struct("number", "title", "dates", "current")
    form = F.col("number") % 3
    line = (
        F.when(form == 0, F.to_json(F.struct(header.alias("data"))))
        .when(form == 1, F.to_json(F.struct(header.alias("proceeding_data")))).otherwise(F.to_json(header))
    )
    path = scratch_path(spark, "headers")
    rows.select(line.alias("value")).write.text(path)
    back = tables.read_proceeding_info(spark, path, json_lines=True)
    return back.withColumn("dates", F.array_join("dates", ","))
