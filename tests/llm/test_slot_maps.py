"""Stored slot maps and their edits, and records that spread whatever their keys."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plenumlens.llm import slots
from plenumlens.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def check_places(rows):
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def loads(rows, shards):
    held = Counter(dict.fromkeys(range(shards), 0))
    for r in rows:
        held[r.shard] += r["size"]
    return held


def test_versions_are_stored_and_edited(spark, docs, tmp_path):
    maps = str(tmp_path / "maps")
    records = slots.spread_records(docs)
    sizes = slots.slot_bytes(records)
    first = {r.vslot: r.shard for r in slots.update_map(sizes, 5, maps).collect()}
    plain = {r.vslot: r.shard for r in slots.first_map(sizes, 5).collect()}
    assert first == plain
    second = slots.update_map(sizes, 6, maps).collect()
    assert {r.version for r in second} == {2} and {r.vslot for r in second} == set(first)
    assert {r.version for r in slots.stored_map(spark, maps).collect()} == {2}
    assert {r.vslot: r.shard for r in slots.stored_map(spark, maps, 1).collect()} == first
    moved = [r.vslot for r in second if r.shard != first[r.vslot]]
    assert 0 < len(moved) < len(first) / 2  # most slots stay where they were
    rows = slots.place_records(records, slots.stored_map(spark, maps)).collect()
    check_places(rows)
    held = loads(rows, 6)
    assert max(held.values()) - min(held.values()) <= 2 * max(r.bytes for r in sizes.collect())
    owner = {r.vslot: r.shard for r in second}
    assert all(r.shard == owner[r.vslot] and r.version == 2 for r in rows)


def test_rows_of_one_key_or_none_are_spread(spark, tmp_path):
    rows = [(None if i % 3 else 7, f"text {i}" if i % 2 else "the same") for i in range(3000)] + [(5, None)] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    records = slots.spread_records(docs)
    assert Counter(r.vslot for r in records.collect()).most_common(1)[0][1] < 15
    sizes = slots.slot_bytes(records)
    placed = slots.place_records(records, slots.update_map(sizes, 8, str(tmp_path / "m"))).collect()
    check_places(placed)
    held = loads(placed, 8)
    assert Counter(r.doc_id for r in placed) == Counter(r[0] for r in rows)
    assert max(held.values()) < 1.05 * min(held.values())


def test_a_record_keeps_its_slot(spark, docs):
    one = {r["__key"]: r.vslot for r in slots.spread_records(docs).collect()}
    two = {r["__key"]: r.vslot for r in slots.spread_records(docs.where("doc_id % 3 > 0").repartition(7)).collect()}
    assert all(one[k] == v for k, v in two.items())


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty, tmp_path):
    for df, n in ((odd, len(odd_rows)), (empty, 0)):
        records = slots.spread_records(df, keep=df.columns)
        placed = slots.place_records(records, slots.update_map(slots.slot_bytes(records), 3, str(tmp_path / str(n))))
        assert len(set(placed.columns)) == len(placed.columns)
        assert placed.count() == n
        check_places(placed.collect())


def test_query(spark, docs):
    rows = QUERIES["op9_sharding"](spark, SF_DIR).collect()
    sizes = {r.doc_id: len(r.text.encode()) + 8 for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == sizes and {r.version for r in rows} == {2}
    check_places(rows)
    held = loads(rows, 24)
    assert set(held) == set(range(24)) and max(held.values()) - min(held.values()) <= max(sizes.values())
