"""Verdicts on fragments: reuse by content, one evaluation per distinct text, choice, selection."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenumlens.functions.base import compute_once
from plenumlens.functions.text import content_key
from plenumlens.operators.statements import MIN_EVALUATED
from plenumlens.schemas import VERDICT
from plenumlens.session import materialize

#: Provider name of a verdict that no provider could give; such verdicts are not kept.
FAILED = "none"
NO_PROVIDER = "no provider answered"

# Provider order by preferred provider, and calls allowed per minute.
PROVIDER_ORDER = {
    "ollama": ["ollama", "gemini", "openai", "claude"],
    "gemini": ["gemini", "ollama", "openai", "claude"],
    "openai": ["openai", "ollama", "gemini", "claude"],
    "claude": ["claude", "ollama", "gemini", "openai"],
}
CALLS_PER_MINUTE = {"ollama": 1000, "openai": 50, "claude": 40, "gemini": 60}

VERDICT_FIELDS = ["is_funny", "confidence", "reason", "api_used"]

Evaluator = Callable[[pd.DataFrame], pd.DataFrame]


def with_content_key(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``content_key``, null for texts too short to evaluate."""
    long_enough = F.length(text) >= MIN_EVALUATED
    return compute_once(df, df.columns, "content_key", F.when(long_enough, content_key(F.col(text))))


def lookup_verdicts(keyed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Attach known verdicts; ``cached`` tells whether there was one."""
    known = verdicts.where(F.col("api_used") != FAILED).select("content_key", *VERDICT_FIELDS)
    return _attach(keyed, known.withColumn("_cached", F.lit(True)))


def _attach(keyed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One left join to a table with one row per content.

    Copies of one text, and texts too short to have a key, make hot keys on the fragment
    side only, which is the side AQE may split. There is deliberately one join and not
    one per verdict table: joins stacked on one key share a stage that is not split.
    """
    joined = keyed.join(verdicts, "content_key", "left")
    return joined.withColumn("cached", F.coalesce("_cached", F.lit(False))).drop("_cached")


def open_requests(
    keyed: DataFrame, verdicts: DataFrame, order: Sequence[str], text: str = "text", context: Sequence[str] = ()
) -> DataFrame:
    """One row per distinct content without a verdict: the text that comes first under ``order``, with its ``context``.

    A group limit before the shuffle leaves one copy of a text per task.
    """
    first = Window.partitionBy("content_key").orderBy(*order)
    wanted = keyed.where(F.col("content_key").isNotNull()).select("content_key", F.col(text).alias("text"), *context, *order)
    distinct = wanted.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("content_key", "text", *context)
    known = verdicts.where(F.col("api_used") != FAILED).select("content_key")
    return distinct.join(known, "content_key", "left_anti")


def _asked(frame: pd.DataFrame, name: str, evaluate: Evaluator, retries: int) -> tuple[list[pd.DataFrame], dict[str, str]]:
    """A provider's answers, and the reason for each text it gave none for.

    A provider that raises on a batch is asked again for its halves, so that one bad text
    costs the others little; a single text is tried ``retries`` times more.
    """
    answers, failed = [], {}

    def once(part: pd.DataFrame) -> None:
        got = evaluate(part)[["content_key", *VERDICT_FIELDS]]
        good = got[got["is_funny"].notna() & got["content_key"].isin(part["content_key"])]
        answers.append(good.drop_duplicates("content_key"))
        failed.update(dict.fromkeys(set(part["content_key"]) - set(good["content_key"]), f"{name}: no answer"))

    parts = [(frame, retries)]
    while parts:
        part, left = parts.pop()
        try:
            once(part)
        except Exception as why:  # noqa: BLE001  a provider may fail in any way
            half = len(part) // 2
            if half:
                parts += [(part.iloc[half:], retries), (part.iloc[:half], retries)]
            elif left:
                parts.append((part, left - 1))
            else:
                failed[part["content_key"].iloc[0]] = f"{name}: {why}"
    return answers, failed


def judge(frame: pd.DataFrame, providers: Sequence[tuple[str, Evaluator]], retries: int = 2) -> pd.DataFrame:
    """Verdicts of a batch: providers in turn, each on what is still open; who has none gets a failed verdict."""
    answers: list[pd.DataFrame] = []
    reasons: dict[str, str] = {}
    left = frame
    for name, evaluate in providers:
        if not len(left):
            break
        got, reasons = _asked(left, name, evaluate, retries)
        answers += got
        left = left[left["content_key"].isin(reasons)]
    failed = pd.DataFrame({
        "content_key": left["content_key"], "is_funny": False, "confidence": 0.0,
        "reason": [reasons.get(k, "no provider") for k in left["content_key"]], "api_used": FAILED,
    })
    return pd.concat([*answers, failed], ignore_index=True)[["content_key", *VERDICT_FIELDS]]


def run_evaluator(
    requests: DataFrame, providers: Evaluator | Sequence[tuple[str, Evaluator]], parallelism: int | None = None, retries: int = 2,
) -> DataFrame:
    """Judge distinct texts in Arrow batches; keep the verdicts in a written table.

    A provider sees ``content_key, text`` and the context columns. Tasks follow from the size of
    the data; ``parallelism`` bounds concurrent calls where a provider asks for it. The table is
    written once, so no later step evaluates again, also after an executor is lost.
    """
    asked = [("evaluator", providers)] if callable(providers) else list(providers)

    def batches(frames):
        for frame in frames:
            if len(frame):
                yield judge(frame, asked, retries)

    spread = requests.repartition(parallelism, "content_key") if parallelism else requests.repartition("content_key")
    return materialize(spread.mapInPandas(batches, schema=f"content_key string, {VERDICT}"), "verdicts")


def evaluate_fragments(
    fragments: DataFrame, verdicts: DataFrame, providers: Evaluator | Sequence[tuple[str, Evaluator]], order: Sequence[str],
    parallelism: int | None = None, context: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Fragments with verdicts, and the verdict table to keep for the next run.

    Too short fragments stay in the result without a verdict; failed verdicts have a reason and
    are not kept. ``context`` names the columns that providers see besides the text.
    """
    keyed = with_content_key(fragments)
    fresh = run_evaluator(open_requests(keyed, verdicts, order, context=context), providers, parallelism)
    known = verdicts.where(F.col("api_used") != FAILED).select("content_key", *VERDICT_FIELDS)
    every = known.withColumn("_cached", F.lit(True)).unionByName(fresh.withColumn("_cached", F.lit(False)))
    kept = known.unionByName(fresh.where(F.col("api_used") != FAILED))
    return _attach(keyed, every), kept


def rule_evaluator(words: dict[str, float], threshold: float = 2.0, scale: float = 8.0) -> Evaluator:
    """A deterministic evaluator for tests and dry runs: weighted substring counts."""

    def evaluate(frame: pd.DataFrame) -> pd.DataFrame:
        lowered = frame["text"].str.lower()
        score = sum(lowered.str.count(re.escape(word)) * weight for word, weight in words.items())
        return pd.DataFrame({
            "content_key": frame["content_key"],
            "is_funny": score >= threshold,
            "confidence": (score / scale).clip(upper=1.0),
            "reason": score.map(lambda s: f"score {int(s)}"),
            "api_used": "rule",
        })

    return evaluate


def choose_provider(candidates: DataFrame, keys: Sequence[str], preferred: str) -> DataFrame:
    """First answering provider of each row's candidates, in the order of the preferred one.

    Candidates without an answer (null ``is_funny``) are passed over; if none answers the
    verdict is negative, marked as failed, with the reason of the first that could not.
    """
    order = F.array(*[F.lit(p) for p in PROVIDER_ORDER[preferred]])
    answered = F.col("is_funny").isNotNull() & (F.array_position(order, F.col("api_used")) > 0)
    priority = F.when(answered, F.array_position(order, F.col("api_used")))
    best = F.min_by(F.struct("is_funny", "confidence", "reason", "api_used"), priority)
    rank = F.array_position(order, F.col("api_used"))
    why = F.min_by("reason", F.when(rank > 0, rank))
    chosen = candidates.groupBy(*keys).agg(best.alias("v"), why.alias("why"))
    return chosen.select(
        *keys,
        F.coalesce("v.is_funny", F.lit(False)).alias("is_funny"),
        F.coalesce("v.confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("v.api_used").isNotNull(), F.col("v.reason")).otherwise(F.coalesce("why", F.lit(NO_PROVIDER))).alias("reason"),
        F.coalesce("v.api_used", F.lit(FAILED)).alias("api_used"),
    )


def confident(analysed: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Positive verdicts at or above the confidence threshold."""
    return analysed.where(F.col("is_funny") & (F.col("confidence") >= threshold))


def positive(evaluated: DataFrame) -> DataFrame:
    """Only positive verdicts."""
    return evaluated.where(F.coalesce("is_funny", F.lit(False)))


def enrich_with(df: DataFrame, enricher: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Plug in a user's DataFrame -> DataFrame step."""
    return df.transform(enricher)


def quota_usage(calls: DataFrame, ts: str, provider: str, caps: dict[str, int] = CALLS_PER_MINUTE) -> DataFrame:
    """Calls per provider and minute against the provider's cap."""
    cap: Column = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(provider))
    return calls.groupBy(F.window(ts, "1 minute"), provider).agg(F.count(F.lit(1)).alias("calls")).select(
        F.col("window.start").alias("minute"), provider, "calls", (F.col("calls") > cap).alias("over_quota")
    )
