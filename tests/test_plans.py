"""Shapes of physical plans that matter at scale."""

from pyspark.sql import functions as F

from plenumlens.functions import keywords as kw
from plenumlens.operators import fragments as fr
from plenumlens.operators import matching, ranking, statements
from plenumlens.session import spread_few_files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def landed(spark, tmp_path):
    rows = [(i, f"s{i % 3}", f"Żart numer {i}. To był humor.", "unused") for i in range(40)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id long, source string, text string, extra string").write.parquet(path)
    return spark.read.parquet(path)


def test_reading_to_fragments_is_one_narrow_stage(spark, tmp_path):
    lexicon = kw.make_lexicon(kw.DEFAULT_LEXICON)
    found = fr.extract_fragments(landed(spark, tmp_path), lexicon, ["source", "id"])
    text = plan(found)
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<id:bigint,source:string,text:string>" in text


def test_filter_on_score_does_not_repeat_the_matching(spark, tmp_path):
    lexicon = kw.make_lexicon([("żart", 1.0)])
    found = fr.extract_fragments(landed(spark, tmp_path), lexicon, ["source", "id"])
    pattern = kw.strict_pattern("żart")
    matched_once = plan(found).count(pattern)
    assert plan(found.where("score >= 2")).count(pattern) == matched_once


def test_segments_are_cut_once(spark, tmp_path):
    segments = fr.explode_segments(fr.segment_statements(landed(spark, tmp_path), ["id"]), ["id"])
    assert plan(segments).count("[ ](?<=[.!?][ ])") == 1


def test_top_k_limits_groups_before_each_shuffle(spark, tmp_path):
    top = ranking.topk_per_group(landed(spark, tmp_path), ["source"], [F.col("id")], 5, ["id"])
    text = plan(top)
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("row_number(), 5, Partial") == 2


def test_first_per_key_combines_before_the_shuffle(spark, tmp_path):
    text = plan(ranking.first_per_key(landed(spark, tmp_path).select("source", "id"), ["source"], ["id"]))
    assert text.count("row_number(), 1, Partial") == 1 and text.count("Exchange hashpartitioning") == 1


def test_literal_matching_needs_no_shuffle(spark, tmp_path):
    lexicon = kw.make_lexicon(kw.DEFAULT_LEXICON)
    rows = landed(spark, tmp_path).withColumnRenamed("text", "segment")
    assert "Exchange" not in plan(matching.literal_matches(rows, lexicon, ["id"]))


def test_one_proceeding_is_filtered_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(10, n, f"t{n}") for n in range(9)], "term int, number int, title string").write.parquet(path)
    rows = spark.read.parquet(path)
    text = plan(statements.select_proceeding(rows, rows.where("number > 5"), 10, 7, ["title"]))
    assert "PushedFilters: [IsNotNull(term), IsNotNull(number)" in text and "EqualTo(number,7)" in text


def test_many_splits_are_left_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, cores + 1)
    assert "Exchange" not in plan(spread_few_files(wide)) and "Exchange" in plan(spread_few_files(spark.range(0, 9, 1, 1)))
