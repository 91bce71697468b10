"""The registered queries against their SQL, and the pipeline against brute force, over the whole smallest tables."""

import os
import re
from collections import Counter

import duckdb
import pytest
from test_brute import classes_of, hits_of

import corpus_pipeline
from plenumlens.llm import leaks, mixing, quality, slots
from plenumlens.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    order = sorted(df.columns)
    found = con.sql(ORACLES[name])
    assert sorted(found.columns) == order
    want = Counter(tuple(plain(r[found.columns.index(c)]) for c in order) for r in found.fetchall())
    assert Counter(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op13_whitening"}))
def test_one_row_per_document(spark, docs, name):
    assert sorted(r.doc_id for r in QUERIES[name](spark, SF_DIR).collect()) == sorted(r.doc_id for r in docs.collect())


def test_stages(spark, docs):
    """Each stage on what the one before it kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    held = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = held.collect()
        held = stage(spark, held, SF_DIR)
        after = held.collect()
        held = spark.createDataFrame(after, held.schema)
        if k < 4:
            assert held.columns == docs.columns
        if k == 0:
            labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
            scored = quality.with_score(docs, quality.fit_field(docs, labels)).collect()
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in scored if r.score >= quality.THRESHOLD)
        if k == 1:
            rows = sorted(before, key=lambda r: r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted({rows[g].doc_id for _, g in classes_of([r.text for r in rows])})
        if k == 2:
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            hits = dict(zip((r.doc_id for r in before), hits_of([r.text for r in before], items), strict=True))
            assert {r.doc_id for r in after} == {i for i, (n, h, _) in hits.items() if h <= leaks.MAX_COVERAGE * n}
            texts = {r.doc_id: r.text for r in before}
            assert all(r.text == texts[r.doc_id] for r in after if not hits[r.doc_id][1])
            assert all(not h for _, h, _ in hits_of([r.text for r in after], items))
        if k == 3:
            size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before}
            taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(before)).collect()}
            assert Counter(r.doc_id for r in after) == Counter({i: int(t / max(size[i], 1) + 0.5) for i, t in taken.items() if int(t / max(size[i], 1) + 0.5)})
        if k == 4:
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
            load = Counter()
            for r in after:
                load[r.shard] += r["size"]
                assert r["size"] == len(r.text.encode()) + slots.OVERHEAD
            assert max(load.values()) - min(load.values()) <= max(r["size"] for r in after)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, odd, empty, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in (odd, empty):
        plain = rows.select(columns)
        got = run(spark, plain, SF_DIR)
        assert got.columns[:5] == columns
        ids = {r.doc_id for r in plain.collect()}
        kept = got.collect()
        assert {r.doc_id for r in kept} <= ids and (kept or not ids)
    if stage == "n-gram jaccard join":  # one row of each class: the copies of document 1 and the nameless one are one class
        kept = Counter(r.doc_id for r in run(spark, odd.select(columns), SF_DIR).collect())
        assert kept[1] == 1 and 6 not in kept and 8 not in kept and max(n for i, n in kept.items() if i is not None) <= 2


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 100
