"""Nested JSON documents, read and written piece by piece."""

import io
import json
import os
import pickle
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plenumlens.sinks import documents, writers
from plenumlens.sources import json_items, tables, transcripts

META = {"term": 10, "proceeding_id": 1, "date": "2024-01-01"}
SPOKEN = [{"num": 0, "speaker": {"name": "A", "club": "X"}, "text": "Pierwsze zdanie."}, {"num": 1, "name": "B", "segment": "Drugie."}]


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def wanted(lists, keep=(), bare=False):
    return json_items.Wanted(frozenset(lists), frozenset(keep), bare)


def items(data, want, chunk=json_items.CHUNK):
    return list(json_items.items_of(lambda: io.BytesIO(data), want, chunk))


# --- reading ---

def test_every_envelope_and_broken_files(spark, tmp_path):
    put(tmp_path / "a" / "one.json", {"metadata": META, "statements": SPOKEN})
    put(tmp_path / "two.json", {"metadata": META, "data": {"other": [1, [2]], "statements": SPOKEN}})
    put(tmp_path / "bare.json", [*SPOKEN, "no object"])
    put(tmp_path / "single.json", SPOKEN[0])
    put(tmp_path / "late.json", {"statements": SPOKEN, "metadata": META})
    put(tmp_path / "cut.json", '{"metadata": {"term": 9}, "statements": [{"num": 1, "text": "ok"}, {"num": 2, "te')
    put(tmp_path / "comma.json", '{"statements": [{"num": 1, "text": "ok"} {"num": 2}]}')
    (tmp_path / "bytes.json").write_bytes(b'[{"num": 1, "text": "ok"}, {"num": 2, "text": "\xff"}]')
    put(tmp_path / "empty.json", "")
    put(tmp_path / "other.json", "17")
    put(tmp_path / "_hidden.json", [SPOKEN[0]])
    got = transcripts.read_statements(spark, str(tmp_path))
    by_file = {}
    for r in got.where("_corrupt_record IS NULL").orderBy("pos").collect():
        by_file.setdefault(r.file_name, []).append((r.term, r.date, r.pos, r.num, r.speaker, r.club, r.text))
    first, second = (0, 0, "A", "X", "Pierwsze zdanie."), (1, 1, "B", None, "Drugie.")
    keyed = [(10, "2024-01-01", *first), (10, "2024-01-01", *second)]
    assert by_file == {"one.json": keyed, "two.json": keyed, "late.json": keyed, "single.json": [(None, None, *first)],
                       "bare.json": [(None, None, *first), (None, None, *second)],
                       "cut.json": [(9, None, 0, 1, None, None, "ok")], "comma.json": [(None, None, 0, 1, None, None, "ok")],
                       **({"bytes.json": by_file["bytes.json"]} if "bytes.json" in by_file else {})}
    broken = {r.file_name: r.read for r in transcripts.broken_files(got).collect()}
    assert set(broken) == {"cut.json", "comma.json", "bytes.json"} and broken["cut.json"] == broken["comma.json"] == 1
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, transcripts.read_statements(spark, str(tmp_path)).collect()), key=str)


def test_mistyped_fields_cost_only_themselves(spark, tmp_path):
    put(tmp_path / "x.json", {"metadata": {"term": "10", "proceeding_id": [1], "date": "2024-01-01"}, "statements": [
        {"num": 1, "speaker": {"name": "A", "id": "seven"}, "text": "raz"}, {"num": "2", "speaker": "B", "text": "dwa"},
        {"num": {"x": 1}, "id": 3, "name": "C", "text": 33}, {"num": 4.5, "text": None, "segment": "cztery"}]})
    rows = transcripts.read_statements(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.term, r.proceeding_id, r.num, r.speaker, r.text) for r in rows] == [
        (10, None, 1, "A", "raz"), (10, None, 2, "B", "dwa"), (10, None, 3, "C", "33"), (10, None, None, None, "cztery")]


def some_json(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind < 5:
        return rng.choice([None, True, 12, -3.5e10, 0, "", "zażółć", 'q"\\u\n', "😀" * rng.randrange(4), "]},{["])
    if kind == 5:
        return [some_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcdxyz") + str(i): some_json(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 20])
def test_pieces_of_any_size_give_the_same_items(chunk):
    rng = random.Random(chunk)
    for _ in range(60):
        listed = [some_json(rng) for _ in range(rng.randrange(5))]
        inner = [{"k": i, "list": [some_json(rng) for _ in range(rng.randrange(3))], "rest": some_json(rng)} for i in range(3)]
        doc = {"before": some_json(rng), "m": some_json(rng), "a": {"list": listed, "x": some_json(rng)}, "deep": inner, "after": some_json(rng)}
        data = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        got = items(data, wanted(["a.list", "deep.list"], ["m", "deep.k"]), chunk)
        assert [json.loads(i) for _, _, i, _ in got] == listed + [x for d in inner for x in d["list"]]
        assert [p for p, *_ in got] == list(range(len(got)))
        heads = [json.loads(h) for _, h, _, _ in got]
        assert heads[:len(listed)] == [{"m": doc["m"]}] * len(listed)
        assert [h["deep.k"] for h in heads[len(listed):]] == [d["k"] for d in inner for _ in d["list"]]


@pytest.mark.parametrize("chunk", [1, 5, 1 << 20])
def test_documents_cut_anywhere_keep_what_was_whole(chunk):
    data = json.dumps({"m": 1, "list": [{"a": "x y"}, [12, "]"], "z", 345]}).encode()
    whole = [json.loads(i) for _, _, i, _ in items(data, wanted(["list"]), chunk)]
    for end in range(1, len(data)):
        got = items(data[:end], wanted(["list"]), chunk)
        assert got[-1][3] is not None and got[-1][2] is None
        read = [json.loads(i) for _, _, i, _ in got[:-1]]
        assert read == whole[:len(read)] or read[:-1] == whole[:len(read) - 1] and str(whole[len(read) - 1]).startswith(str(read[-1]))


def test_several_values_in_a_file():
    data = b'{"list": [1, 2], "m": 1} {"list": [3]}\n[4] {"m": 2, "list": [5]}'
    assert [(p, json.loads(h), i) for p, h, i, _ in items(data, wanted(["list"], ["m"]))] == [
        (0, {"m": 1}, "1"), (1, {"m": 1}, "2"), (2, {}, "3"), (3, {"m": 2}, "5")]


class Endless:
    """A document of many statements that is made while it is read."""

    def __init__(self, count, fault=None):
        self.parts, self.rest = self.make(count, fault), b""

    @staticmethod
    def make(count, fault):
        yield b'{"metadata": {"term": 10}, "statements": ['
        one = b'{"num": 1, "text": "' + b"a word and another " * 50 + b'"}'
        for i in range(count):
            yield (b"," if i else b"") + one
            if i == fault:
                yield b" oops "
        yield b"]}"

    def read(self, size):
        while len(self.rest) < size and (part := next(self.parts, None)):
            self.rest += part
        out, self.rest = self.rest[:size], self.rest[size:]
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


@pytest.mark.parametrize("fault", [None, 1000])
def test_memory_does_not_grow_with_a_document(fault):
    tracemalloc.start()
    try:
        count = errors = 0
        for _, _, item, error in json_items.items_of(lambda: Endless(60_000, fault), wanted(["statements"], ["metadata"])):
            count += item is not None
            errors += error is not None
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (count, errors) == ((60_000, 0) if fault is None else (1001, 1))
    assert peak < 12 << 20  # the document has 60 MB


@pytest.mark.parametrize("task_bytes", [1, 50, 333, 1 << 20])
def test_lines_in_ranges_of_any_size(spark, tmp_path, task_bytes):
    lines = [json.dumps({"num": i, "text": "ż" * (i % 40)}, ensure_ascii=False) for i in range(40)] + ["", "{broken", json.dumps(SPOKEN), "[] 5"]
    put(tmp_path / "x.json", "\n".join(lines))
    reader = json_items._Reader({"path": str(tmp_path), "lists": "statements", "lines": "true", "bare": "true", "taskbytes": str(task_bytes)})
    shares = reader.partitions()
    assert sum(stop - start for s in shares for _, start, stop in s.files) == (tmp_path / "x.json").stat().st_size
    rows = [r for s in shares for batch in reader.read(s) for r in batch.to_pylist()]
    assert [json.loads(r["item"])["num"] for r in rows if r["item"]] == [*range(40), 0, 1]
    assert [r["pos"] for r in rows] == sorted({r["pos"] for r in rows})
    assert sum(r["_corrupt_record"] is not None for r in rows) == 2
    if task_bytes == 333:
        got = json_items.read_items(spark, str(tmp_path), ["statements"], bare=True, lines=True, task_bytes=task_bytes)
        assert Counter((r.pos, r.item) for r in got.collect()) == Counter((r["pos"], r["item"]) for r in rows)


def test_small_files_share_tasks(tmp_path):
    for i in range(300):
        put(tmp_path / f"d{i % 7}" / f"{i}.json", [{"num": i, "text": "x" * 100}])
    reader = json_items._Reader({"path": f"file://{tmp_path}", "lists": "", "taskbytes": str(100 * 4096)})
    shares = reader.partitions()
    assert [len(s.files) for s in shares] == [100, 100, 100]
    nums = [json.loads(r["item"])["num"] for s in shares for b in reader.read(s) for r in b.to_pylist()]
    assert sorted(nums) == list(range(300))
    put(tmp_path / "large.json", [{"num": 1, "text": "x" * 1000}] * 1000)
    assert max(len(s.files) for s in reader.partitions()) <= 100 and len(reader.partitions()) >= 4


def test_other_stores_are_refused(spark):
    with pytest.raises(Exception, match="only Spark's own readers"):
        json_items.read_items(spark, "viewfs://store/in", ["statements"]).collect()


# --- writing ---

@pytest.fixture
def many_parts(spark):
    """Small results stay in several tasks."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def rows_of(spark, n):
    return spark.range(n).select((F.col("id") % 3).alias("term"), (F.col("id") % 7).alias("p"), F.floor(F.col("id") / 20).alias("d"), "id")


def write_nested(df, path, rows_per_part=1000):
    levels = [documents.level(F.to_json(F.struct("term")), "proceedings"), documents.level(F.to_json(F.struct("p")), "transcripts"),
              documents.level(F.to_json(F.struct("d")), "statements")]
    name = F.concat(F.lit("term="), "term", F.lit("/x.json"))
    documents.write_documents(df, path, name, levels, F.to_json(F.struct("id")), ["p", "d", "id"], rows_per_part)


def flat(path):
    doc = json.loads(path.read_text())
    return [(doc["term"], p["p"], t["d"], s["id"]) for p in doc["proceedings"] for t in p["transcripts"] for s in t["statements"]]


def names_below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_nested_documents(spark, tmp_path):
    write_nested(rows_of(spark, 200), str(tmp_path))
    assert names_below(tmp_path) == [f"term={t}/x.json" for t in range(3)]
    for term in range(3):
        got = flat(tmp_path / f"term={term}" / "x.json")
        assert got == sorted((i % 3, i % 7, i // 20, i) for i in range(200) if i % 3 == term)
        doc = json.loads((tmp_path / f"term={term}" / "x.json").read_text())
        assert [p["p"] for p in doc["proceedings"]] == list(range(7))  # each level is opened once
        assert all(len({t["d"] for t in p["transcripts"]}) == len(p["transcripts"]) for p in doc["proceedings"])
    write_nested(rows_of(spark, 50).where("term = 1"), str(tmp_path))  # others stay
    assert len(flat(tmp_path / "term=1" / "x.json")) == 17 and len(flat(tmp_path / "term=2" / "x.json")) == 66
    write_nested(rows_of(spark, 0), str(tmp_path))
    assert len(names_below(tmp_path)) == 3


def test_a_large_document_becomes_parts_with_a_manifest(spark, tmp_path, many_parts):
    write_nested(rows_of(spark, 3000), str(tmp_path), rows_per_part=100)
    folder = tmp_path / "term=1"
    manifest = json.loads((folder / "_x.json.parts").read_text())["parts"]
    assert len(manifest) > 1 and [m["name"] for m in manifest[:2]] == ["x.json", "x.part-00001.json"]
    parts = [flat(folder / m["name"]) for m in manifest]
    assert [len(p) for p in parts] == [m["items"] for m in manifest]
    assert sum(parts, []) == sorted((1, i % 7, i // 20, i) for i in range(3000) if i % 3 == 1)
    back = json_items.read_items(spark, str(tmp_path), ["proceedings.transcripts.statements"], ["term", "proceedings.p", "proceedings.transcripts.d"])
    seen = [(json.loads(r.head), json.loads(r.item)["id"]) for r in back.collect()]
    assert sorted(i for _, i in seen) == list(range(3000))
    assert all(h == {"term": i % 3, "proceedings.p": i % 7, "proceedings.transcripts.d": i // 20} for h, i in seen)
    write_nested(rows_of(spark, 3000), str(tmp_path))  # fewer parts than before
    assert names_below(tmp_path) == [f"term={t}/x.json" for t in range(3)]


def task(monkeypatch, partition, attempt):
    monkeypatch.setattr(documents.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: partition, taskAttemptId=lambda: attempt)))


def batch(*rows):
    return pa.RecordBatch.from_pylist([{"file": f, "opens": ["["], "closes": ["]"], "item": i} for f, i in rows])


def test_a_task_that_runs_twice_leaves_one_document(monkeypatch, tmp_path):
    writer = documents._Writer(str(tmp_path), ["file", "opens", "closes", "item"])
    task(monkeypatch, 0, 1)
    with pytest.raises(ZeroDivisionError):
        writer.write(batch(("a.json", str(i))) if i < 2 else 1 // 0 for i in range(3))
    task(monkeypatch, 0, 2)
    one = writer.write(iter([batch(("a.json", "1"), ("a.json", "2")), batch(("b.json", "3"))]))
    task(monkeypatch, 0, 3)
    writer.write(iter([batch(("a.json", "1"), ("a.json", "2")), batch(("b.json", "3"))]))  # a speculative copy, not committed
    task(monkeypatch, 1, 4)
    two = writer.write(iter([]))
    assert all(n.startswith("_staging") for n in names_below(tmp_path))  # nothing shows before the commit
    writer.commit([two, None, one])
    assert names_below(tmp_path) == ["a.json", "b.json"]
    assert json.loads((tmp_path / "a.json").read_text()) == [1, 2]
    again = documents._Writer(str(tmp_path), ["file", "opens", "closes", "item"])
    again.abort([again.write(iter([batch(("a.json", "9"))]))])
    assert names_below(tmp_path) == ["a.json", "b.json"] and json.loads((tmp_path / "a.json").read_text()) == [1, 2]


def test_null_names_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="null"):
        write_nested(rows_of(spark, 5).withColumn("term", F.when(F.col("id") > 2, F.col("term"))), str(tmp_path))
    assert names_below(tmp_path) == []


def test_transcript_days(spark, tmp_path):
    text = "long enough text"
    schema = "term int, proceeding_id int, title string, date string, num bigint, text string"
    days = [(10, 1, 'Sitting "1"', "2024-01-01", n, f"{text} {n}") for n in range(50, 0, -1)]
    days += [(10, 1, 'Sitting "1"', "2024-01-02", 1, text), (10, 1, None, "2024-01-03", 1, "short"), (10, 2, "T", None, 1, text)]

    def write(rows):
        df = spark.createDataFrame(rows, schema)
        writers.write_transcript_documents(df, str(tmp_path), ["num", "text"], F.lit("2024-02-01"), ["title"])

    write(days)
    folder = tmp_path / "term=10" / "proceeding_id=1" / "transcripts"
    assert names_below(folder) == ["transkrypty_2024-01-01.json", "transkrypty_2024-01-02.json"]
    doc = json.loads((folder / "transkrypty_2024-01-01.json").read_text())
    assert doc["metadata"] == {**META, "generated_at": "2024-02-01", "proceeding_info": {"title": 'Sitting "1"'}}
    assert [s["num"] for s in doc["statements"]] == list(range(1, 51))
    write([(10, 1, "T", "2024-01-02", 7, text)])
    rows = transcripts.read_statements(spark, str(tmp_path))
    assert Counter((r.proceeding_id, r.date) for r in rows.collect()) == {(1, "2024-01-01"): 50, (1, "2024-01-02"): 1, (2, None): 1}
    found = transcripts.list_files(spark, str(tmp_path), recursive=True).withColumn("p", F.regexp_extract("path", "proceeding_id=([^/]+)", 1))
    assert [tuple(r) for r in transcripts.landed_dates(found, ["p"]).collect()] == [("1", ["2024-01-01", "2024-01-02"])]


def test_result_and_term_documents(spark, tmp_path):
    rows = spark.createDataFrame([("in/a b.json", 2, i, f"t{i}", 1.5 * i) for i in range(5)] + [("other/a b.json", 1, 9, "u", 0.0), (None, 0, 8, "v", 1.0)],
                                 "source string, n int, statement_id bigint, text string, score double")
    for run in ("run0", "run1"):
        writers.write_result_documents(rows, f"{tmp_path}/r", "source", ["statement_id", "text", "score"], ["statement_id"], F.lit("now"), "1", run, ["n"])
    names = names_below(tmp_path / "r")
    assert len(names) == 6 and all(n.startswith(("run_id=run0/source_stem=", "run_id=run1/source_stem=")) for n in names)
    docs = [json.loads((tmp_path / "r" / n).read_text()) for n in names]
    assert all(d["metadata"] == {"generated_at": "now", "scraper_version": "1"} for d in docs)
    one = next(d["data"] for d in docs if d["data"].get("source_file") == "in/a b.json")
    assert one["n"] == 2 and [f["statement_id"] for f in one["fragments"]] == list(range(5))
    back = tables.read_result_documents(spark, f"{tmp_path}/r").collect()
    assert Counter((r.source_file, r.generated_at, r.statement_id, r.score) for r in back) == Counter((r.source, "now", r.statement_id, r.score) for r in rows.collect())
    said = spark.createDataFrame([(10, p, f"2024-01-0{d}", n, f"x{n}") for p in (2, 11) for d in (1, 2) for n in (2, 1)] + [(9, None, "2024-01-01", 1, "y")],
                                 "term int, proceeding_id int, date string, num int, text string")
    writers.write_term_documents(said, f"{tmp_path}/t", F.lit("20240201_000000"), ["num", "text"])
    assert names_below(tmp_path / "t") == ["term_10_export.json", "term_9_export.json"]
    term = json.loads((tmp_path / "t" / "term_10_export.json").read_text())
    assert (term["term"], term["export_timestamp"]) == (10, "20240201_000000")
    assert [(p["directory_name"], [(t["metadata"]["date"], [s["num"] for s in t["statements"]]) for t in p["transcripts"]]) for p in term["proceedings"]] == [
        (f"proceeding_{p}", [("2024-01-01", [1, 2]), ("2024-01-02", [1, 2])]) for p in ("002", "011")]


def test_the_driver_holds_no_names_and_tasks_name_documents(spark, monkeypatch, tmp_path):
    writer = documents._Writer(str(tmp_path), ["file", "opens", "closes", "item"], "_staging-1")
    sizes = []
    for k, n in enumerate((1, 300)):
        task(monkeypatch, k, k)
        sizes.append(writer.write(iter([batch(*[(f"p{i}/{k}-{i}.json", str(i)) for i in range(n)])])))
    assert len({len(pickle.dumps(m)) for m in sizes}) == 1  # whatever a task has written
    writer.commit(sizes)
    assert all(n.startswith("_staging-1") for n in names_below(tmp_path))
    documents._publish(spark, str(tmp_path), "_staging-1")
    documents._publish(spark, str(tmp_path), "_staging-1")  # as after a lost task
    documents._drop_staging(str(tmp_path), "_staging-1")
    assert names_below(tmp_path) == sorted([f"p{i}/1-{i}.json" for i in range(300)] + ["p0/0-0.json"])


def test_a_large_tree_is_listed_by_tasks(spark, tmp_path):
    for i in range(40):
        put(tmp_path / f"term={i % 2}" / f"p {i % 5}" / f"{i}.json", [])
    put(tmp_path / "top.json", [1])
    put(tmp_path / "other.txt", [1])
    put(tmp_path / "_hidden" / "a.json", [1])
    put(tmp_path / "_key=1" / "a.json", [1])
    few, many = (transcripts.list_files(spark, f"{tmp_path}{slash}", recursive=True, few=n) for slash, n in (("", 1000), ("/", 10)))
    assert "inner" in many._jdf.queryExecution().toString() and "inner" not in few._jdf.queryExecution().toString()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and many.count() == 42
    assert many.dtypes == few.dtypes
