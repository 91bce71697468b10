"""The bucketed store of verdicts."""

import pytest
from pyspark.sql import functions as F

from plenumlens.operators import evaluation
from plenumlens.operators.verdict_store import VerdictStore

SCHEMA = "content_key string, is_funny boolean, confidence double, reason string, api_used string"


def verdicts(spark, keys, confidence=0.5, used="rule"):
    return spark.createDataFrame([(k, True, confidence, "why", used) for k in keys], SCHEMA)


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def held(store):
    return sorted((r.content_key, r.confidence) for r in store.verdicts().collect())


def test_verdicts_are_kept_once_and_failed_ones_never(spark, tmp_path):
    store = VerdictStore(spark, f"{tmp_path}/store", buckets=4)
    assert held(store) == []
    store.append(verdicts(spark, ["a", "b", "b", None]))
    store.append(verdicts(spark, ["b", "c"], 0.9))
    store.append(verdicts(spark, ["d"], 0.1, evaluation.FAILED))
    want = [("a", 0.5), ("b", 0.5), ("c", 0.9)]
    assert held(store) == want
    store.compact()
    assert held(store) == want
    store.append(verdicts(spark, ["e"]))
    again = VerdictStore(spark, f"{tmp_path}/store", buckets=99)  # an existing store keeps its buckets
    assert held(again) == [*want, ("e", 0.5)] and (again.buckets, again.generation) == (4, 2)
    again.compact(buckets=7)
    again.compact()
    assert held(again) == [*want, ("e", 0.5)] and again.buckets == 7
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["generation-000003-of-7", "generation-000004-of-7"]


def test_a_compaction_that_breaks_off_changes_nothing(spark, tmp_path):
    store = VerdictStore(spark, f"{tmp_path}/store", buckets=3)
    store.append(verdicts(spark, ["a", "b"]))
    half = tmp_path / "store" / "generation-000002-of-3"
    verdicts(spark, ["x"]).write.parquet(str(half))
    again = VerdictStore(spark, f"{tmp_path}/store")
    assert again.generation == 1 and [k for k, _ in held(again)] == ["a", "b"]
    again.compact()
    assert [k for k, _ in held(again)] == ["a", "b"]


def test_lookup_does_not_shuffle_the_store(spark, tmp_path, no_broadcast):
    store = VerdictStore(spark, f"{tmp_path}/store", buckets=8)
    store.append(verdicts(spark, [f"k{i}" for i in range(200)]))
    keyed = spark.range(300).select(F.concat(F.lit("k"), F.col("id") * 2).alias("content_key"), "id").union(
        spark.createDataFrame([(None, -1), ("k0", -2), ("k0", -3)], "content_key string, id long"))
    plan = store.known(keyed)._jdf.queryExecution().executedPlan().toString()
    above_the_store = plan[:plan.index("FileScan parquet")]  # the store's side comes first
    assert "Bucketed: true" in plan and "SortMergeJoin" in above_the_store and "Exchange" not in above_the_store
    got = store.lookup(keyed).collect()
    assert {r.id: r.cached for r in got} == {**{i: i < 100 for i in range(300)}, -1: False, -2: True, -3: True}
