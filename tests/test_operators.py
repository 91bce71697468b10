"""Operators on small tables: edge cases the driver's tables do not hold."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plenumlens.functions import replies
from plenumlens.operators import evaluation, joins, ranking, refresh, statements, summaries


def dates_frame(spark):
    rows = [
        (1, ["2024-01-01", "2024-01-02"], False),      # all past
        (2, ["2024-03-01"], False),                    # all future
        (3, ["2024-01-02", "2024-03-01"], False),      # mixed
        (4, ["not a date"], False),                    # unreadable
        (5, [], True),                                 # no dates
        (6, ["2024-01-11"], False),                    # one day ahead
        (7, ["2023-01-01"], True),                     # flagged
    ]
    return spark.createDataFrame(rows, "number int, dates array<string>, current boolean")


def ref():
    return F.to_date(F.lit("2024-01-10"))


def test_date_predicates(spark):
    df = dates_frame(spark)
    got = df.select(
        "number", F.size(statements.past_dates(F.col("dates"), ref())).alias("past"),
        statements.all_future(F.col("dates"), ref()).alias("skip"),
        statements.is_current(F.col("dates"), F.col("current"), ref(), 7).alias("current"),
    ).orderBy("number").collect()
    assert [r.past for r in got] == [2, 0, 1, 1, 0, 0, 1]
    assert [r.skip for r in got] == [False, True, False, False, False, True, False]
    assert [r.current for r in got] == [False, False, False, False, False, True, True]
    assert [r.number for r in statements.with_id_and_dates(df).orderBy("number").collect()] == [1, 2, 3, 4, 6, 7]


def test_refresh_tiers(spark):
    now = F.to_timestamp(F.lit("2024-01-10 12:00:00"))
    existing = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-02")], "number int, date string")

    def work(log):
        checks = refresh.latest_checks(spark.createDataFrame(log, "number int, checked_at string").withColumn(
            "checked_at", F.to_timestamp("checked_at")), ["number"])
        rows = refresh.refresh_worklist(dates_frame(spark), existing, checks, ["number"], now).collect()
        return {r.number: (r.tier, r.refresh) for r in rows}

    exact = work([(1, "2024-01-03 12:00:00"), (2, "2024-01-09 12:00:00"), (3, "2024-01-10 10:00:00"),
                  (4, "2024-01-10 09:59:59"), (7, "2024-01-10 11:59:00")])
    assert exact[1] == ("complete", False)      # exactly 168 hours is not older
    assert exact[2] == ("future", False)
    assert exact[3] == ("ongoing", False)
    assert exact[4] == ("ongoing", True)
    assert exact[5] == ("ongoing", True)        # never checked
    assert exact[7] == ("incomplete", True)     # past, but its day is not landed
    assert work([(1, "2024-01-03 11:59:59")])[1] == ("complete", True)


def test_new_dates_and_state(spark):
    landed = spark.createDataFrame([(1, datetime.date(2024, 1, 1))], "number int, date date")
    got = refresh.new_dates(dates_frame(spark), landed, ["number"], ref()).orderBy("number", "date").collect()
    assert [(r.number, str(r.date)) for r in got] == [(1, "2024-01-02"), (3, "2024-01-02"), (7, "2023-01-01")]
    state = spark.createDataFrame([("2024-01-10",), ("2023-12-11",), ("2023-12-10",), ("odd",)], "date string")
    assert sorted(r.date for r in refresh.prune_state(state, "date", ref()).collect()) == ["2023-12-11", "2024-01-10", "odd"]


def test_health(spark):
    log = spark.createDataFrame(
        [("a", "2024-01-10 11:00:01"), ("b", "2024-01-10 11:00:00"), ("c", "never"), ("a", "2024-01-01 00:00:00")],
        "source string, at string")
    got = refresh.health(log, ["source"], "at", F.to_timestamp(F.lit("2024-01-10 12:00:00"))).collect()
    assert {r.source: (r.status, r.hours_since_check) for r in got} == {
        "a": ("healthy", 1.0), "b": ("stale", 1.0), "c": ("unknown", None)}


def test_digest_cuts_titles(spark):
    rows = spark.createDataFrame([(1, "2024-01-02", "t" * 51), (1, "2024-01-01", "t" * 51), (2, "2024-01-01", "t" * 50)],
                                 "number int, date string, title string")
    got = {r.number: r.line for r in refresh.digest_lines(rows, "number", "date", "title").collect()}
    assert got == {1: "• 1: 2024-01-01, 2024-01-02\n  " + "t" * 50 + "...", 2: "• 2: 2024-01-01\n  " + "t" * 50}


def test_speakers(spark):
    members = spark.createDataFrame(
        [(0, 1, "Jan", "Kot", "A"), (1, 2, "Ewa", "Kot", "B"), (2, 3, None, "Lis", None), (3, 4, "", "", "C")],
        "ord int, id int, firstName string, lastName string, club string",
    ).withColumns({"districtName": F.lit(None).cast("string"), "districtNum": F.lit(None).cast("int"),
                   "profession": F.lit("x"), "voivodeship": F.lit(None).cast("string")})
    said = spark.createDataFrame(
        [(1, "Jan Kot"), (2, " Kot Jan "), (3, "Kot"), (4, "Lis"), (5, ""), (6, None), (7, "Nikt"), (8, "jan kot")],
        "n int, name string")
    got = {r.n: r for r in joins.join_speaker(said, members, "name", "ord").collect()}
    assert {n: r.mp_data.id if r.mp_data else None for n, r in got.items()} == {
        1: 1, 2: 1, 3: 2, 4: 3, 5: None, 6: None, 7: None, 8: None}
    assert got[4].mp_data.club == "" and got[4].is_mp and not got[7].is_mp


def test_hot_group_top_k_and_ranks(spark):
    # one group holds nearly all rows; ties are broken by id
    df = spark.range(3000).select(
        F.when(F.col("id") < 2900, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"),
        (F.col("id") % 7).cast("double").alias("score"), "id")
    order = [F.col("score").desc(), F.col("id")]
    pdf = df.toPandas().sort_values(["g", "score", "id"], ascending=[True, False, True])
    pdf["rank"] = pdf.groupby("g").cumcount() + 1
    want = {(r.g, r.id): r["rank"] for _, r in pdf.iterrows()}
    top = {(r.g, r.id): r["rank"] for r in ranking.topk_per_group(df, ["g"], order, 5, ["id"], 8).collect()}
    assert top == {k: v for k, v in want.items() if v <= 5}
    ranked = ranking.rank_all(df, ["g"], [-F.col("score"), F.floor(F.col("id") / 100)], [F.col("id")])
    assert {(r.g, r.id): r["rank"] for r in ranked.collect()} == want


def test_first_and_latest(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, "z")], "k int, o int, v string")
    assert sorted(map(tuple, ranking.first_per_key(df, ["k"], ["o"]).collect())) == [(1, 1, "a"), (2, 5, "z")]
    assert sorted(map(tuple, ranking.latest_per_key(df, ["k"], ["o"]).collect())) == [(1, 3, "c"), (2, 5, "z")]


def test_evaluator_runs_once_per_text(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    folder = str(log)

    def counting(frame: pd.DataFrame) -> pd.DataFrame:
        import uuid
        from pathlib import Path

        Path(folder, uuid.uuid4().hex).write_text("\n".join(frame["text"]), encoding="utf-8")
        failed = frame["text"].str.contains("fail")
        return pd.DataFrame({
            "content_key": frame["content_key"], "is_funny": ~failed, "confidence": 0.9, "reason": "r",
            "api_used": failed.map({True: evaluation.FAILED, False: "rule"}),
        })

    rows = [(1, "A text that is long enough"), (2, "a  TEXT that is long enough "), (3, "short"),
            (4, "known text, already evaluated"), (5, "this one will fail to be evaluated")]
    fragments = spark.createDataFrame(rows, "id int, text string")
    known = evaluation.with_content_key(fragments.where("id = 4")).select(
        "content_key", F.lit(False).alias("is_funny"), F.lit(0.1).alias("confidence"), F.lit("old").alias("reason"),
        F.lit("rule").alias("api_used"))
    result, kept = evaluation.evaluate_fragments(fragments, known, counting, ["id"], parallelism=2)
    got = {r.id: (r.cached, r.is_funny, r.reason) for r in result.collect()}
    result.count()
    assert got == {1: (False, True, "r"), 2: (False, True, "r"), 3: (False, None, None),
                   4: (True, False, "old"), 5: (False, False, "r")}
    asked = sorted(t for f in log.iterdir() for t in f.read_text(encoding="utf-8").split("\n"))
    assert asked == ["A text that is long enough", "this one will fail to be evaluated"]
    assert kept.count() == 2  # the failed verdict is not kept


def test_provider_choice(spark):
    rows = [(1, None, 0.0, "", "ollama"), (1, True, 0.7, "", "gemini"), (1, False, 0.2, "", "claude"), (2, None, 0.0, "", "ollama")]
    df = spark.createDataFrame(rows, "id int, is_funny boolean, confidence double, reason string, api_used string")
    pick = lambda p: {r.id: (r.is_funny, r.api_used) for r in evaluation.choose_provider(df, ["id"], p).collect()}
    assert pick("ollama") == {1: (True, "gemini"), 2: (False, "none")}
    assert pick("claude") == {1: (False, "claude"), 2: (False, "none")}


def parse(spark, texts, parser):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r.p) for r in df.select("i", parser(F.col("t")).alias("p")).orderBy("i").collect()]


def test_text_replies(spark):
    got = parse(spark, [
        "ŚMIESZNE: TAK\nPEWNOŚĆ: 75%\nKATEGORIA: absurd\nPOWÓD: bo tak",
        "POWÓD: x: y\nPEWNOŚĆ: 150%\nFUNNY: yes",
        "ŚMIESZNE: TAK\nPEWNOŚĆ: duża\nŚMIESZNE: NIE",
        "ŚMIESZNE: TAK\nPEWNOŚĆ: bez liczby",
        "ŚMIESZNE: TAK POWÓD: na jednej linii\nKATEGORIA: coś o ironii",
        "krótko", None, "PEWNOŚĆ: 30\nPEWNOŚĆ: wcale",
    ], replies.parse_text_reply)
    negative = "Brak wyraźnych elementów humorystycznych"
    assert got == [
        (True, 0.75, "bo tak", "absurd"),
        (True, 1.0, "x: y", "brak"),
        (False, 0.0, negative, "brak"),
        (True, 0.5, "Model rozpoznał element brak", "brak"),
        (True, 0.5, "Model rozpoznał element ironia", "ironia"),
        (False, 0.0, "Brak odpowiedzi", "brak"), (False, 0.0, "Brak odpowiedzi", "brak"),
        (False, 0.3, negative, "brak"),
    ]


def test_json_replies(spark):
    got = parse(spark, [
        'Oto: {"is_funny": true, "confidence": "0.8", "reason": "r {x}"} koniec', '{"confidence": 0.25}', "{}", "nic", None,
        '{"is_funny": true, "confidence": "high"}', '{"is_funny": tru',
    ], replies.parse_json_reply)
    assert got == [
        (True, True, 0.8, "r {x}"), (True, False, 0.25, ""), (True, False, 0.0, ""), (False, False, 0.0, ""),
        (False, False, 0.0, ""), (False, False, 0.0, ""), (False, False, 0.0, ""),
    ]


def test_prompt(spark):
    row = spark.range(1).select(replies.build_prompt(
        F.lit("x" * 900), F.lit("Jan"), F.lit(""), F.expr("array(named_struct('keyword','a'), named_struct('keyword','b'))"),
        template="<{text}|{context}>").alias("p")).first()
    assert row.p == "<" + "x" * 900 + "|Speaker: Jan\nKeywords: a, b>"
    short = spark.range(1).select(replies.build_prompt(F.lit("x" * 900), template="<{text}|{context}>", limit=800).alias("p")).first()
    assert short.p == "<" + "x" * 800 + "|>"


def test_summaries(spark):
    rows = [(10, 1, "d1", "A"), (10, 1, "d1", "A"), (10, 1, "d2", ""), (10, 2, "d1", "B"), (9, 1, "d9", None)]
    df = spark.createDataFrame(rows, "term int, proceeding_id int, date string, speaker string")
    got = {(r.term, r.proceeding_id): (r.total_days, r.total_statements, r.total_speakers, r.dates)
           for r in summaries.proceeding_summary(df, ["term", "proceeding_id"], "date", "speaker").collect()}
    assert got == {(10, 1): (2, 3, 1, ["d1", "d2"]), (10, 2): (1, 1, 1, ["d1"]), (9, 1): (1, 1, 0, ["d9"])}
    totals = {r.term: (r.proceedings, r.transcripts, r.total_statements)
              for r in summaries.term_summary(df, "term", "proceeding_id", "date").where("is_term_total").collect()}
    assert totals == {10: (2, 3, 4), 9: (1, 1, 1)}


def test_statistics_without_rows(spark):
    empty = spark.createDataFrame([], "is_funny boolean, confidence double, failed boolean")
    row = summaries.analysis_stats(empty).first()
    assert tuple(row) == (0, 0, 0.0, 0.0, 0)


def test_processed_and_canonical(spark):
    listing = spark.createDataFrame(
        [(10, 1, "2024-01-01", 0, None, "", "2024-01-01T10:00:00", "2024-01-01T10:00:05"),
         (10, 1, "2024-01-01", 1, "", None, None, "x")],
        "term int, proceeding_id int, date string, num bigint, name string, club string, startDateTime string, endDateTime string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("function", "firstName", "lastName")})
    rows = statements.to_processed(listing).orderBy("num").collect()
    assert rows[0].speaker.name == "Nieznany" and rows[1].speaker.name == ""
    assert rows[0].timing.duration_seconds == 5 and rows[1].timing.duration_seconds is None
    assert rows[0].technical.api_url == "/term10/proceedings/1/2024-01-01/transcripts/0"
    content = spark.createDataFrame(
        [(1, "", None, "plain text here", None), (2, None, None, "", "<p>page &amp; text</p>"), (3, "tiny", None, None, None)],
        "n int, text string, text_content string, plain string, html_content string")
    got = [r.t for r in content.select("n", statements.content_text(F.struct(
        "text", "text_content", "plain", "html_content")).alias("t")).orderBy("n").collect()]
    assert got == ["plain text here", "page & text", "tiny"]


def test_ranks_and_rest_keep_nulls(spark):
    df = spark.createDataFrame([(None, 1.0, 1), ("a", None, 2), ("a", 2.0, 3), (None, 1.0, 4)], "g string, score double, id int")
    ranked = ranking.rank_all(df, ["g"], [-F.col("score")], [F.col("id")])
    assert sorted((r.id, r["rank"]) for r in ranked.collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    chosen = df.where("id in (2, 4)").select("g", "id")
    parts = {(r.id): r.part for r in joins.join_rest(df, chosen, ["g", "id"]).collect()}
    assert parts == {1: 1, 2: 0, 3: 1, 4: 0}


def test_repeated_numbers_stay_apart(spark):
    from plenumlens.functions import keywords as kw
    from plenumlens.operators import detector, evaluation
    from plenumlens.schemas import VERDICT

    rows = [("s", 1, 0, "To jest bardzo dobry żart."), ("s", 1, 1, "A to już drugi żart tutaj."), ("s", None, 2, "Trzeci żart bez numeru tu.")]
    df = spark.createDataFrame(rows, "source string, num long, pos long, text string")
    found = detector.detect(df, kw.make_lexicon([("żart", 2.0)]), "source", "num", ident=["pos"])
    none = spark.createDataFrame([], f"content_key string, {VERDICT}")
    result, _ = detector.evaluate_best(found, none, evaluation.rule_evaluator({"żart": 2.0}), "source", "num", top_n=2, ident=["pos"])
    assert sorted((r.pos, r.part) for r in result.collect()) == [(0, 0), (1, 1), (2, 0)]


def test_providers_in_turn(spark):
    import pandas as pd

    from plenumlens.operators.evaluation import FAILED, judge

    frame = pd.DataFrame({"content_key": list("abcdef"), "text": ["ok", "bad", "ok", "none", "bad none", "ok"]})

    def answers(name, breaks, silent):
        def run(part):
            if part["text"].str.contains(breaks).any():
                raise ValueError(f"{breaks} text")
            return pd.DataFrame({"content_key": part["content_key"], "is_funny": [None if silent in t else True for t in part["text"]],
                                 "confidence": 0.5, "reason": "r", "api_used": name})
        return run

    got = judge(frame, [("one", answers("one", "bad", "none")), ("two", answers("two", "none", "zzz"))], retries=1)
    by = {r.content_key: (r.api_used, bool(r.is_funny), r.reason) for r in got.itertuples()}
    assert by == {"a": ("one", True, "r"), "b": ("two", True, "r"), "c": ("one", True, "r"), "f": ("one", True, "r"),
                  "d": (FAILED, False, "two: none text"), "e": (FAILED, False, "two: none text")}


def test_top_fraction_is_exact(spark):
    df = spark.range(30_000).withColumn("score", (F.col("id") * 7919) % 30_000)
    assert ranking.top_fraction(df, "score", 0.33, accuracy=100).count() == 9_900 + 1
    assert ranking.top_fraction(df.where("id < 0"), "score", 0.5).count() == 0


@pytest.mark.parametrize("kind", ["distinct", "few", "doubles", "one"])
def test_selection_is_exact(spark, kind):
    value = {"distinct": "(id * 7919) % 20011", "few": "id % 3", "doubles": "cast(id % 977 as double) / 7 - 50", "one": "5"}[kind]
    df = spark.range(20_000).selectExpr(f"{value} AS score").repartition(5).cache()
    scores = sorted(r.score for r in df.collect())
    for n in (1, 2, 777, 13_400, 19_999, 20_000):
        assert ranking.nth_score(df, "score", n, accuracy=50) == scores[n - 1]
    with pytest.raises(ValueError):
        ranking.nth_score(df, "score", 20_001)
    with_gaps = df.selectExpr("cast(score as double) AS score").union(spark.range(50).selectExpr("CASE WHEN id % 2 = 0 THEN double('NaN') END"))
    assert sorted(r.score for r in ranking.top_fraction(with_gaps, "score", 0.25).collect()) == [s for s in scores if s >= scores[15_000 - 1]]


def test_selection_has_no_window_over_all_scores(spark):
    plan = ranking.top_fraction(spark.range(100_000).withColumnRenamed("id", "score"), "score", 0.33)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_summaries_of_kept_days_equal_those_of_all_statements(spark, tmp_path):
    rows = [(p, d, s) for p in (1, 2) for d in ("2024-01-01", "2024-01-02", None) for s in ("A", "B", "", None)] + [(1, "2024-01-02", "C")] * 3
    df = spark.createDataFrame(rows, "proceeding int, date string, speaker string")
    landed, path = str(tmp_path / "landed"), str(tmp_path / "partials")
    df.write.partitionBy("date").parquet(landed)
    days = spark.read.schema("proceeding int, speaker string, date string").parquet(landed)
    columns = (["proceeding"], "date", "speaker")
    for some in (days.where("date = '2024-01-01' OR date IS NULL"), days.where("date = '2024-01-02'").limit(2), days.where("date = '2024-01-02'")):
        summaries.store_partials(some, path, *columns)
    partials = summaries.read_partials(days, path, *columns)
    got = summaries.proceeding_summary_of(partials, *columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, summaries.proceeding_summary(df, *columns).collect()))
    termed = df.withColumn("term", F.lit(10))
    got = summaries.term_summary_of(summaries.day_partials(termed, ["term", "proceeding"], "date", "speaker"), "term", "proceeding", "date")
    assert sorted(map(str, got.collect())) == sorted(map(str, summaries.term_summary(termed, "term", "proceeding", "date").collect()))
    update = summaries.day_partials(days.where("date = '2024-01-02'"), *columns)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in update and "= 2024-01-02)]" in update  # one day's folder is read
