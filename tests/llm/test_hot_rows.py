"""One node, key or missing key that holds a large part of all rows."""

from collections import Counter

import corpus_pipeline
from plenumlens.llm import graph, mixing


def test_components_of_a_hot_node(spark):
    edges = [(1, i) for i in range(2, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(2999, 4999), (4999, 4998)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in [*range(1, 3000), 4998, 4999]} | dict.fromkeys(range(5000, 5041), 5000)


def test_mix_of_rows_without_a_key_or_of_one(spark):
    rows = [(None if i % 3 else 7, f"{'w ' * (i % 9)}t{i}", "ab"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"keep": ["doc_id", "text"], "block": 4, "shard_docs": 100}
    got = mixing.mix(df, **options).collect()
    again = mixing.mix(df.repartition(7, "text"), **options).collect()
    assert {(r.doc_id, r.text): r.taken for r in got} == {(r.doc_id, r.text): r.taken for r in again}
    assert Counter(r.text for r in got) == Counter(t for _, t, _ in rows)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - target[s]) <= 4 * (1 + 3 * 15) for s in target)


def test_pipeline_shards_of_rows_without_a_key(spark, tmp_path):
    rows = [(None if i % 2 else i, f"text {i % 400}", "a", "en", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = corpus_pipeline.sharded(spark, df, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == Counter((r[0], r[1], r[4]) for r in rows)
    load, places = Counter(), Counter((r.shard, r.slot) for r in got)
    for r in got:
        load[r.shard] += r["size"]
    assert len(load) == corpus_pipeline.SHARDS and max(load.values()) < 1.1 * min(load.values())
    assert set(places.values()) == {1}
