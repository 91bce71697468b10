"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are binned statistics of the line and of the lines
before and after it; neighbouring labels are tied by transition weights. The forward-backward
pass gives each line's probability to be good: that labels the line, and a document's score is
the mean, weighted by length. Labels exist for documents only, so that every line is trained
with its document's.

The model is fitted on a bounded sample of labelled documents, whose binned lines alone come to
the driver, and is a few hundred numbers large. Scoring reads whole texts, in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumlens.llm.tables import settled, small_batches, text_bytes

#: Labelled documents that the model is fitted on, at most (the ones of smallest id hash).
TRAIN_DOCS = 6_000
#: Lines of one training document, at most: a longer text gives runs of adjacent lines, spread evenly over it.
TRAIN_LINES = 400
#: Lines of such a run.
RUN_LINES = 50
THRESHOLD = 0.3
#: Upper edges of the bins of a share.
SHARES = np.array([0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75])
BINS = 16
FEATURES = 13
#: Binned at once: lines of about this many bytes.
SLICE_BYTES = 4 << 20

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_LETTER = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_PLAIN = bytes([*_LETTER, *_DIGIT, 32])
#: Bytes that prose ends a word with.
_CLOSE = bytes([*_LETTER, *_DIGIT, *b".,;:?\")'"])


def line_statistics(text: bytes) -> tuple[list[int], list[tuple[float, ...]]]:
    """Length in bytes and raw statistics of each line; a text without line feeds is one line."""
    lines = text.split(b"\n")
    seen = Counter(lines)
    lengths, out = [], []
    for line in lines:
        n, words = len(line), line.split()
        m = len(words)
        lengths.append(n)
        if not m:
            out.append((n, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0))
            continue
        ends = bytes([w[-1] for w in words])
        bare = b" ".join(words)
        common = Counter(words)
        out.append((
            n,
            (n - len(line.translate(None, _UPPER))) / n,
            len(line.translate(None, _PLAIN)) / n,
            (n - len(line.translate(None, _DIGIT))) / n,
            len(common) / m,
            sum(map(bytes.__eq__, words, words[1:])) / m,
            (len(bare) - m + 1) / m,
            len(ends.translate(None, _CLOSE)) / m,
            sum(not w.translate(None, _PLAIN[:-1]) for w in set(words)) / m,
            (n - len(line.translate(None, bytes(range(128, 256))))) / n,
            seen[line],
            max(common.values()) / m,
            1 if ends[-1:] in b".!?" else 2 if ends[-1:] in _LETTER else 3,
        ))
    return lengths, out


def bin_statistics(raw: np.ndarray) -> np.ndarray:
    """Bin numbers (lines x features) of raw statistics."""
    out = np.zeros((len(raw), FEATURES), np.uint8)
    if not len(raw):
        return out
    share = lambda x: np.searchsorted(SHARES, x, "left")
    counts = np.log2(raw[:, [0, 10]] + 1).astype(int)
    for f in (1, 2, 3, 4, 5, 7, 8, 9, 11):
        out[:, f] = share(raw[:, f])
    out[:, 0], out[:, 10] = np.minimum(counts[:, 0], BINS - 1), np.minimum(counts[:, 1], BINS - 1)
    out[:, 6] = np.minimum(raw[:, 6], BINS - 1)
    out[:, 12] = raw[:, 12]
    return out


@dataclass
class Chains:
    """Lines of many chains, one after the other; chains by falling number of lines.

    A chain is a document, or a run of its lines. Around a run may stand the lines before and
    after it: their features count for their neighbours, they have no label themselves.
    """

    bins: np.ndarray
    start: np.ndarray
    length: np.ndarray
    lead: np.ndarray
    tail: np.ndarray

    @staticmethod
    def of(bins: np.ndarray, counts: np.ndarray, lead: np.ndarray | None = None,
           tail: np.ndarray | None = None) -> tuple[Chains, np.ndarray]:
        """The chains, and the order that they now have; ``lead`` and ``tail`` tell which of them have a line before or after."""
        lead = np.zeros(len(counts), bool) if lead is None else lead
        tail = np.zeros(len(counts), bool) if tail is None else tail
        whole = counts + lead + tail
        order = np.argsort(-counts, kind="stable")
        return Chains(bins, (np.cumsum(whole) - whole + lead)[order], counts[order], lead[order], tail[order]), order

    def active(self, t: int) -> np.ndarray:
        """Positions of line ``t`` of all documents that have one."""
        return self.start[: np.searchsorted(-self.length, -t, "left")] + t

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Which lines have one before, and one after, in their document."""
        inside = self.inside()
        before, after = inside.copy(), inside
        before[self.start] = self.lead
        after[self.start + self.length - 1] = self.tail
        return before, after

    def inside(self) -> np.ndarray:
        """Which lines belong to a chain."""
        out = np.ones(len(self.bins), bool)
        out[(self.start - 1)[self.lead]] = False
        out[(self.start + self.length)[self.tail]] = False
        return out


class LineField:
    """The conditional random field: bin weights for own, previous and next line, and transitions."""

    def __init__(self, weights: np.ndarray, bias: float, moves: np.ndarray):
        self.weights, self.bias, self.moves = weights, bias, moves

    @staticmethod
    def blank() -> LineField:
        return LineField(np.zeros((3, FEATURES, BINS)), 0.0, np.zeros((2, 2)))

    def emissions(self, chains: Chains) -> np.ndarray:
        """Log odds of each line to be good, without its neighbours' labels."""
        columns = np.arange(FEATURES)
        own, behind, ahead = (w[columns, chains.bins].sum(1) for w in self.weights)
        before, after = chains.edges()
        out = own + self.bias
        out[1:] += np.where(before[1:], behind[:-1], 0)
        out[:-1] += np.where(after[:-1], ahead[1:], 0)
        return out

    def marginals(self, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability to be good, and the expected numbers of the four transitions."""
        good = 1 / (1 + np.exp(-np.clip(self.emissions(chains), -30, 30)))
        phi = np.stack([1 - good, good], 1)
        move = np.exp(self.moves)
        forth, back = np.ones_like(phi), np.ones_like(phi)
        steps = int(chains.length[0]) if len(chains.length) else 0
        for t in range(steps):
            at = chains.active(t)
            x = phi[at] if t == 0 else (forth[at - 1] @ move) * phi[at]
            forth[at] = x / x.sum(1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            at = chains.active(t + 1)
            tail = phi[at] * back[at]
            x = tail @ move.T
            back[at - 1] = x / x.sum(1, keepdims=True)
            pair = forth[at - 1][:, :, None] * move * tail[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        both = forth * back
        return both[:, 1] / both.sum(1), expected

    def fit(self, chains: Chains, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 2e-4) -> LineField:
        """Fit to lines with labels (one per line), by gradient ascent on the conditional likelihood."""
        before, after = chains.edges()
        told = np.zeros((2, 2))
        inside = chains.inside()
        follows = inside.copy()
        follows[chains.start] = False
        inner = np.flatnonzero(follows)
        np.add.at(told, (labels[inner - 1], labels[inner]), 1)
        flat = chains.bins + np.arange(FEATURES) * BINS
        values = np.concatenate([self.weights.ravel(), [self.bias], self.moves.ravel()])
        first, second = np.zeros_like(values), np.zeros_like(values)
        for i in range(1, rounds + 1):
            sure, expected = self.marginals(chains)
            off = np.where(inside, labels - sure, 0)
            parts = [np.bincount(flat.ravel(), np.repeat(x, FEATURES), FEATURES * BINS) for x in (
                off, np.concatenate([np.where(before, off, 0)[1:], [0]]), np.concatenate([[0], np.where(after, off, 0)[:-1]]))]
            slope = np.concatenate([*parts, [off.sum()], (told - expected).ravel()]) / inside.sum() - decay * values
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            values = values + rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
            size = self.weights.size
            self.weights, self.bias, self.moves = values[:size].reshape(self.weights.shape), values[size], values[size + 1:].reshape(2, 2)
        return self

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per text, the length-weighted mean of the lines' probabilities, and these themselves."""
        lengths, raw, counts = [], [], []
        for text in texts:
            n, rows = line_statistics(text)
            lengths += n
            raw += rows
            counts.append(len(n))
        counts = np.array(counts)
        chains, _ = Chains.of(bin_statistics(np.array(raw, float).reshape(-1, FEATURES)), counts)
        sure, _ = self.marginals(chains)
        weight, doc = np.array(lengths) + 1.0, np.repeat(np.arange(len(texts)), counts)
        scores = np.bincount(doc, weight * sure, len(texts)) / np.bincount(doc, weight, len(texts))
        return scores, np.split(sure, np.cumsum(counts)[:-1])


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key as text is divisible by ``folds``. A null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def training_runs(lines: int, most: int = TRAIN_LINES, run: int = RUN_LINES) -> list[tuple[int, int]]:
    """Bounds of the runs of adjacent lines that a text of so many lines is trained with.

    That is the whole text up to ``most`` lines; of a longer one ``most // run`` runs that begin
    at even distances, the first with its first line and the last with its last.
    """
    if lines <= most:
        return [(0, lines)]
    starts = np.linspace(0, lines - run, max(most // run, 1)).astype(int)
    return [(int(at), int(at) + run) for at in starts]


def _binned(texts: pd.Series) -> pd.DataFrame:
    def one(text: bytes) -> tuple[bytes, list[int]]:
        bins = bin_statistics(np.array(line_statistics(text)[1], float))
        parts, runs = [], []
        for first, end in training_runs(len(bins)):
            lead, tail = int(first > 0), int(end < len(bins))
            parts.append(bins[first - lead : end + tail].tobytes())
            runs += [end - first, lead, tail]
        return b"".join(parts), runs

    return pd.DataFrame([one(t) for t in texts], columns=["bins", "runs"])


def fit_field(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
              max_docs: int = TRAIN_DOCS, rounds: int = 150) -> LineField:
    """Fit the field on labelled documents that aren't held out, ``max_docs`` at most.

    Rows with null key or label are passed over; of several labels of a document the smallest
    counts, of several texts that with the least hash. A text beyond ``TRAIN_LINES`` lines is
    trained in runs of adjacent lines (see :func:`training_runs`). Without any labelled document
    the blank field comes back, which scores 0.5.
    """
    small_batches(docs.sparkSession)
    known = (labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y"))
             .where(F.col("__k").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__k"))))
    sample = known.groupBy("__k").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__k"), "__k").limit(max_docs)
    chosen = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(sample), "__k")  # max_docs rows
    one = (chosen.groupBy("__k", "__y").agg(F.min_by("__t", F.xxhash64("__t")).alias("__t"))
           .withColumn("__b", F.pandas_udf(_binned, "struct<bins:binary,runs:array<int>>")(text_bytes("__t"))))
    rows = sorted(one.select("__k", "__y", "__b.*").collect(), key=lambda r: r["__k"])  # a row for each of max_docs keys
    if not rows:
        return LineField.blank()
    runs = np.array([n for r in rows for n in r["runs"]]).reshape(-1, 3)
    bins = np.frombuffer(b"".join(r["bins"] for r in rows), np.uint8).reshape(-1, FEATURES)
    labels = np.repeat([r["__y"] for r in rows], [len(r["bins"]) // FEATURES for r in rows])
    return LineField.blank().fit(Chains.of(bins, runs[:, 0], runs[:, 1] > 0, runs[:, 2] > 0)[0], labels, rounds)


JUDGED = "struct<score:double,lines:array<double>>"


def judge(field: LineField):
    """A column function: the score of a text (as bytes), and the probability of each of its lines to be good."""

    @F.pandas_udf(JUDGED)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in settled(batches):
            size = texts.map(len).cumsum().to_numpy() // SLICE_BYTES
            parts = [field.judge(part.tolist()) for _, part in texts.groupby(size)]
            scores = np.concatenate([s for s, _ in parts]) if parts else np.zeros(0)
            yield pd.DataFrame({"score": scores, "lines": [line for _, lines in parts for line in lines]})

    return judged


def scorer(field: LineField):
    """A column function: the score of a text (as bytes)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in settled(batches):
            size = texts.map(len).cumsum().to_numpy() // SLICE_BYTES
            yield pd.Series(np.concatenate([field.judge(part.tolist())[0] for _, part in texts.groupby(size)]) if len(texts) else [], dtype=float)

    return score


def with_lines(docs: DataFrame, field: LineField, text: str = "text", into: str = "judged") -> DataFrame:
    """Add the column ``into``: the score, and ``lines``, each line's number, probability and label (1: good).

    Lines are what line feeds part, numbered from 0; one is good from a probability of 0.5. Null
    and empty texts are one empty line; rows stay as they are, a column ``into`` is replaced.
    """
    labelled = F.transform(F.col(into)["lines"], lambda p, i: F.struct(i.alias("no"), p.alias("good"), (p >= 0.5).cast("int").alias("label")))
    return docs.withColumn(into, judge(field)(text_bytes(text))).withColumn(
        into, F.struct(F.col(into)["score"].alias("score"), labelled.alias("lines")))


def with_score(docs: DataFrame, field: LineField, text: str = "text", into: str = "score") -> DataFrame:
    """Add the column ``into``, the score from 0 to 1 (higher: better); a column of that name is replaced.

    Null and empty texts are one empty line and get its score; equal texts get equal scores;
    rows stay as they are.
    """
    return docs.withColumn(into, scorer(field)(text_bytes(text)))
