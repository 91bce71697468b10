"""Readers, writers and streams on files written here."""

import json

import pytest
from pyspark.sql import functions as F

from plenumlens.functions import keywords as kw
from plenumlens.operators import fragments as fr
from plenumlens.operators.evaluation import quota_usage
from plenumlens.session import scratch_path
from plenumlens.sinks import writers
from plenumlens.sources import tables, transcripts
from plenumlens.streaming import jobs


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


STATEMENTS = [{"num": 0, "speaker": {"name": "A"}, "text": "Pierwsze zdanie."}, {"num": 1, "name": "B", "segment": "Drugie."}]


def test_every_envelope(spark, tmp_path):
    meta = {"term": 10, "proceeding_id": 1, "date": "2024-01-01"}
    put(tmp_path / "transkrypty_2024-01-01.json", {"metadata": meta, "statements": STATEMENTS})
    put(tmp_path / "sub" / "nested.json", {"metadata": meta, "data": {"statements": STATEMENTS}})
    put(tmp_path / "bare.json", STATEMENTS)
    put(tmp_path / "broken.json", '{"statements": [')
    files = transcripts.read_transcript_files(spark, str(tmp_path))
    rows = transcripts.statements_of(files).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file_name, []).append((r.num, r.speaker, r.text))
    want = [(0, "A", "Pierwsze zdanie."), (1, "B", "Drugie.")]
    assert {k: sorted(v) for k, v in by_file.items()} == {
        "transkrypty_2024-01-01.json": want, "nested.json": want, "bare.json": want}
    assert [r.file_name for r in transcripts.quarantine(files).collect()] == ["broken.json"]


def test_discovery_and_path_keys(spark, tmp_path):
    put(tmp_path / "data" / "p1" / "transkrypty_2024-01-02.json", [])
    put(tmp_path / "data" / "p1" / "transkrypty_2024-01-01.json", [])
    put(tmp_path / "data" / "p1" / "transkrypty_2024_01_01.json", [])
    put(tmp_path / "data" / "Detector" / "results.json", [])
    (tmp_path / "in").mkdir()
    found = transcripts.discover(spark, str(tmp_path / "in"), [str(tmp_path / "data")])
    assert [r.name for r in found.collect()] == [
        "transkrypty_2024-01-01.json", "transkrypty_2024-01-02.json", "transkrypty_2024_01_01.json"]
    dated = transcripts.landed_dates(found.withColumn("p", F.lit(1)), ["p"]).first()
    assert dated.dates == ["2024-01-01", "2024-01-02"]
    put(tmp_path / "in" / "own.json", [])
    assert [r.name for r in transcripts.discover(spark, str(tmp_path / "in"), [str(tmp_path / "data")]).collect()] == ["own.json"]


def test_lexicon_file(spark, tmp_path):
    put(tmp_path / "k.json", [{"keyword": "ok", "weight": 1.5}, "no", {"no_keyword": "x"}, {"keyword": ""},
                              {"keyword": "a", "weight": "bad"}, {"keyword": "b"}, {"keyword": "ć", "weight": "2.5"}])
    lexicon = tables.read_lexicon(spark, str(tmp_path / "k.json"))
    assert [(k.keyword, k.weight) for k in tables.lexicon_literals(lexicon)] == [("ok", 1.5), ("a", 1.0), ("b", 1.0), ("ć", 2.5)]


def test_newest_members_and_results(spark, tmp_path):
    import os

    put(tmp_path / "m" / "old.json", [{"id": 1, "lastName": "Stary"}])
    put(tmp_path / "m" / "new.json", {"metadata": {}, "data": [{"id": 2, "lastName": "Nowy"}]})
    os.utime(tmp_path / "m" / "old.json", (1, 1))
    assert [r.lastName for r in tables.read_members(spark, str(tmp_path / "m")).collect()] == ["Nowy"]
    put(tmp_path / "r" / "results_1.json", {"data": {"source_file": "s", "fragments": [{"text": "t", "score": 2.0}]}})
    assert [(r.source_file, r.score) for r in tables.read_latest_results(spark, str(tmp_path / "r")).collect()] == [("s", 2.0)]
    with pytest.raises(Exception):
        tables.newest_export(spark, str(tmp_path / "nothing"))


def test_newest_export_has_all_its_parts(spark, tmp_path):
    folder = str(tmp_path / "exports")
    for mark, parts in (("old", 3), ("new", 4)):
        rows = spark.range(100).select(F.col("id").cast("int").alias("id"), F.lit(mark).alias("lastName"))
        rows.repartition(parts).write.mode("append").json(folder)
    got = tables.read_members(spark, folder, json_lines=True)
    assert got.count() == 100 and {r.lastName for r in got.collect()} == {"new"}


def test_mistyped_fields_cost_only_themselves(spark, tmp_path):
    put(tmp_path / "transkrypty_2024-01-01.json", {"metadata": {"term": "10", "proceeding_id": [1], "date": "2024-01-01"}, "statements": [
        {"num": 1, "speaker": {"name": "A", "id": "seven"}, "text": "raz"}, {"num": "2", "speaker": "B", "text": "dwa"},
        {"num": {"x": 1}, "id": 3, "name": "C", "text": 33}, {"num": 4.5, "text": None, "segment": "cztery"}]})
    rows = transcripts.statements_of(transcripts.read_transcript_files(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.term, r.num, r.speaker, r.text) for r in rows] == [
        (10, 1, "A", "raz"), (10, 2, "B", "dwa"), (10, 3, "C", "33"), (10, None, None, "cztery")]


def test_text_binary_and_csv(spark, tmp_path):
    put(tmp_path / "a.txt", "linia 1\nlinia 2")
    assert tables.read_text(spark, str(tmp_path / "a.txt")).first().value == "linia 1\nlinia 2"
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "x.bin").write_bytes(bytes.fromhex("89504e47") + b"1234")
    (tmp_path / "pics" / "y.bin").write_bytes(b"????")
    files = tables.read_binary(spark, str(tmp_path / "pics"))
    assert sorted(map(tuple, tables.media_inventory(files).collect())) == [("jpg", 1, 4), ("png", 1, 8)]
    df = spark.createDataFrame([(1, 'a "q", b\nc', None)], "id int, firstName string, club string")
    writers.write_csv(writers.members_csv(df), str(tmp_path / "csv"))
    row = tables.read_csv(spark, str(tmp_path / "csv")).na.fill("").first()
    assert (row.id, row.firstName, row.club, row.email) == ("1", 'a "q", b\nc', "", "")


def canonical(spark, rows):
    return spark.createDataFrame(rows, "term int, proceeding_id int, date string, num bigint, text string")


def test_days_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "days")
    long = "long enough text"
    writers.write_transcripts(canonical(spark, [(10, 1, "2024-01-01", n, f"{long} {n}") for n in range(50)]
                                        + [(10, 1, "2024-01-02", 1, long), (10, 1, "2024-01-03", 1, "short")]), path)
    writers.write_transcripts(canonical(spark, [(10, 1, "2024-01-02", 7, long)]), path)
    back = spark.read.schema("num bigint, text string, term int, proceeding_id int, date string").json(path)
    assert {(r.date, r["count"]) for r in back.groupBy("date").count().collect()} == {("2024-01-01", 50), ("2024-01-02", 1)}
    files = sorted((tmp_path / "days" / "term=10" / "proceeding_id=1" / "date=2024-01-01").glob("*.json"))
    nums = [json.loads(line)["num"] for f in files for line in f.read_text().splitlines()]
    assert nums == list(range(50))


def test_report(spark):
    df = spark.createDataFrame([(i, i % 2 == 0, i / 200, f"text {i}", None if i == 2 else "why") for i in range(30)],
                               "id int, is_funny boolean, confidence double, text string, reason string")
    lines = [r.line for r in writers.report_lines(df, [F.col("confidence").desc(), F.col("id")]).orderBy("line_no").collect()]
    assert lines[0] == "Best fragments\nFound: 15/30" and len(lines) == 11
    assert lines[1] == "1. [14%] text 28...\n   → why"
    assert lines[2] == "2. [13%] text 26...\n   → why"


def run(spark, stream, label):
    path = scratch_path(spark, label)
    jobs.ingest(stream, path, scratch_path(spark, f"{label}-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def test_stream_scores_like_batch(spark, tmp_path):
    lexicon = kw.make_lexicon(kw.DEFAULT_LEXICON)
    for day in range(3):
        put(tmp_path / f"d{day}.json", json.dumps({"id": day, "text": f"Żart {day}. To był humor! Nic. Koniec."}))
    schema = "id int, text string"
    stream = jobs.score_arriving(jobs.arriving_files(spark, str(tmp_path), schema, files_per_batch=1), lexicon, ["id"])
    batch = fr.extract_fragments(spark.read.schema(schema).json(str(tmp_path)), lexicon, ["id"])
    key = lambda rows: sorted((r.id, r.segment_idx, r.text, r.score) for r in rows)
    assert key(run(spark, stream, "scored").collect()) == key(batch.collect())


def test_days_are_taken_once(spark, tmp_path):
    events = [("2024-01-01", 1), ("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-02", 2), ("2024-01-01", 1)]
    for i, (day, number) in enumerate(events):
        put(tmp_path / f"e{i}.json", json.dumps({"number": number, "date": day, "ts": f"{day} 10:00:00"}))
    stream = jobs.arriving_files(spark, str(tmp_path), "number int, date string, ts timestamp", files_per_batch=2)
    fresh = jobs.new_days(stream, ["number", "date"], "ts").select("number", "date")
    assert sorted(map(tuple, run(spark, fresh, "days").collect())) == [(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-02")]


def test_one_digest_per_batch(spark, tmp_path):
    src = tmp_path / "in"
    seen = []
    schema = "number int, date string, title string, ts timestamp"
    state = scratch_path(spark, "digest-state")
    out = scratch_path(spark, "digests")

    def deliver(lines, batch_id):
        seen.append((batch_id, sorted((r.number, r.dates) for r in lines.collect())))

    for i, day in enumerate(("2024-01-01", "2024-01-02", "2024-01-02", "2024-01-03")):
        put(src / f"{i}.json", json.dumps({"number": 1, "date": day, "title": "t", "ts": f"{day} 10:00:00"}))
        stream = jobs.arriving_files(spark, str(src), schema)
        jobs.notify(stream, "number", "date", "title", "ts", out, state, deliver=deliver).awaitTermination()
    # the second arrival of a day is not announced again
    assert [lines for _, lines in seen] == [[(1, "2024-01-01")], [(1, "2024-01-02")], [(1, "2024-01-03")]]


def test_quota_stream_equals_batch(spark, tmp_path):
    calls = [{"ts": f"2024-01-01 10:00:{s:02d}", "provider": "claude"} for s in range(45)]
    calls += [{"ts": "2024-01-01 10:01:00", "provider": "openai"}, {"ts": "2024-01-01 11:00:00", "provider": "openai"}]
    put(tmp_path / "calls.json", "\n".join(json.dumps(c) for c in calls))
    schema = "ts timestamp, provider string"
    stream = jobs.quota_stream(jobs.arriving_files(spark, str(tmp_path), schema), "ts", "provider")
    batch = {tuple(r) for r in quota_usage(spark.read.schema(schema).json(str(tmp_path)), "ts", "provider").collect()}
    assert {(r[1], r[2], r[3]) for r in batch} == {("claude", 45, True), ("openai", 1, False)}
    # the last minute stays open until the watermark passes it
    got = {tuple(r) for r in run(spark, stream, "quota").collect()}
    assert got == {r for r in batch if r[0].hour == 10}
