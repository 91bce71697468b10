"""Labels of lines, training on runs of adjacent lines, and scores computed plainly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenumlens.llm import quality


@pytest.fixture(scope="module")
def field():
    rng = np.random.default_rng(11)
    return quality.LineField(rng.normal(size=(3, quality.FEATURES, quality.BINS)), 0.2, rng.normal(size=(2, 2)))


def plain_lines(field, text):
    """Probability of each line to be good, line by line, by sums over all that can come before and after."""
    bins = quality.bin_statistics(np.array(quality.line_statistics(text)[1], float))
    odds = []
    for i in range(len(bins)):
        near = [(0, i)] + ([(1, i - 1)] if i else []) + ([(2, i + 1)] if i + 1 < len(bins) else [])
        odds.append(field.bias + sum(field.weights[part, f, bins[j, f]] for part, j in near for f in range(quality.FEATURES)))
    local = [np.array([1, np.exp(np.clip(o, -30, 30))]) for o in odds]
    move = np.exp(field.moves)
    forth, back = [local[0] / local[0].sum()], [np.ones(2)]
    for x in local[1:]:
        y = (forth[-1] @ move) * x
        forth.append(y / y.sum())
    for x in local[:0:-1]:
        y = move @ (x * back[0])
        back.insert(0, y / y.sum())
    both = [a * b for a, b in zip(forth, back, strict=True)]
    return [b[1] / b.sum() for b in both]


def test_lines_and_scores(field, odd, odd_rows):
    got = quality.with_lines(odd, field).select("doc_id", "text", "judged").collect()
    assert len(got) == len(odd_rows)
    for r in got:
        text = (r.text or "").encode()
        want = plain_lines(field, text)
        lengths = [len(x) + 1 for x in text.split(b"\n")]
        assert [x.no for x in r.judged.lines] == list(range(len(want)))
        assert np.allclose([x.good for x in r.judged.lines], want)
        assert all(x.label == int(x.good >= 0.5) for x in r.judged.lines)
        assert r.judged.score == pytest.approx(np.dot(lengths, want) / sum(lengths))
    scores = quality.with_score(odd, field).select("doc_id", "text", "score").collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.score) for r in scores))) == sorted(map(repr, ((r.doc_id, r.text, r.judged.score) for r in got)))


def test_texts_beyond_a_slice(field, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [b"\n".join(b"word " * rng.integers(0, 9) for _ in range(n)) for n in (1, 3000, 2, 500, 1)]
    want, lines = field.judge(texts)
    one = [field.judge([t]) for t in texts]
    assert np.allclose(want, [s[0] for s, _ in one]) and all(np.allclose(a, b[0]) for a, (_, b) in zip(lines, one, strict=True))


def test_runs_cover_ends_and_keep_neighbours(field):
    assert quality.training_runs(400) == [(0, 400)] and quality.training_runs(1) == [(0, 1)]
    runs = quality.training_runs(1000)
    assert runs[0][0] == 0 and runs[-1][1] == 1000 and sum(e - f for f, e in runs) == quality.TRAIN_LINES
    rng = np.random.default_rng(7)
    bins = rng.integers(0, quality.BINS, (30, quality.FEATURES)).astype(np.uint8)
    whole = field.emissions(quality.Chains.of(bins, np.array([30]))[0])
    parts, sizes, lead, tail, at = [], [], [], [], []
    for first, end in [(0, 8), (10, 20), (25, 30)]:
        lead.append(first > 0)
        tail.append(end < 30)
        parts.append(bins[first - lead[-1] : end + tail[-1]])
        at.append((sum(map(len, parts[:-1])) + lead[-1], first, end))
        sizes.append(end - first)
    chains, _ = quality.Chains.of(np.concatenate(parts), np.array(sizes), np.array(lead), np.array(tail))
    odds = field.emissions(chains)
    assert all(np.allclose(odds[place : place + end - first], whole[first:end]) for place, first, end in at)
    assert chains.inside().sum() == sum(sizes)


def test_slope_is_that_of_the_likelihood(field):
    """One step of the fit moves each weight as the differences of the likelihood say, lines around runs included."""
    rng = np.random.default_rng(9)
    bins = rng.integers(0, 3, (9, quality.FEATURES)).astype(np.uint8)
    chains, _ = quality.Chains.of(bins, np.array([3, 4]), np.array([False, True]), np.array([True, False]))
    labels = np.repeat([0, 1], [4, 5])

    def gain(weights):
        odds = quality.LineField(weights, 0.0, np.zeros((2, 2))).emissions(chains)
        inside = chains.inside()
        return (labels * odds - np.log1p(np.exp(odds)))[inside].sum() / inside.sum()

    fitted = quality.LineField.blank().fit(chains, labels, rounds=1, decay=0.0)
    blank = np.zeros((3, quality.FEATURES, quality.BINS))
    for part in range(3):
        for bin_ in range(3):
            moved = blank.copy()
            moved[part, 0, bin_] = 1e-5
            slope = (gain(moved) - gain(blank)) / 1e-5
            step = fitted.weights[part, 0, bin_]
            assert np.sign(step) == (np.sign(slope) if abs(slope) > 1e-6 else 0) or abs(slope) < 1e-4


def test_repeated_ids_give_one_training_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}\nof one id") for i in range(40)] + [(2, "good. line"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (1, 1), (None, 1)], "doc_id long, quality int")
    one = quality.fit_field(docs, labels, rounds=3)
    again = quality.fit_field(docs.repartition(7).orderBy(F.desc("text")), labels, rounds=3)
    assert np.array_equal(one.weights, again.weights)
