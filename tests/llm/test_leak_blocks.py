"""Items in several blocks: the same texts are left as with one automaton, and one automaton is in a plan."""

import random

import pytest

from plenumlens.llm import leaks


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(str(i), draw(rng.choice([0, 3, 9, 10, 12]))) for i in range(12)] + [(None, draw(11)), ("x", None)]
    texts = [(i, draw(rng.randrange(60)), str(i)) for i in range(40)] + [(40, None, "n"), (41, "", "e"), (None, "a b", "k"), (1, draw(30), "r")]
    return (spark.createDataFrame(texts, "doc_id long, text string, hits string"),
            spark.createDataFrame(items, "item_id string, text string"))


@pytest.mark.parametrize("coverage", [0.5, 1.0])
def test_clean(case, coverage):
    docs, items = case
    one, several = (leaks.clean(docs, items, max_coverage=coverage, block_words=n) for n in (300_000, 40))
    assert leaks.n_blocks(items, "text", 40) > 1 == leaks.n_blocks(items, "text", 300_000)
    assert several.columns == docs.columns
    assert sorted(map(repr, several.collect())) == sorted(map(repr, one.collect()))


def test_clean_without_rows(case):
    docs, items = case
    assert leaks.clean(docs.where("false"), items, block_words=40).count() == 0
    assert leaks.clean(docs, items.where("false")).count() == docs.count()


def test_one_automaton_in_a_plan(case):
    docs, items = case
    plan = leaks.with_hits(docs.drop("hits"), items, block_words=40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("read_more(") == 1 and "read_first(" not in plan
