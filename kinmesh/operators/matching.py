"""Matchers and filters: pairs become outcomes, in which a pair is decided or has an error."""

from __future__ import annotations

import string
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.functions.text import jaccard, tokens

OUTCOME = ["left_id", "right_id", "similarity", "match", "confidence", "reason", "error"]


def _outcomes(pairs: DataFrame, match: Column, error: Column, confidence: Column | None = None, reason: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return pairs.select(
        "left_id", "right_id", F.col("similarity").cast("double").alias("similarity"), F.when(error.isNull(), match).alias("match"),
        F.when(error.isNull(), none if confidence is None else confidence).cast("double").alias("confidence"),
        F.when(error.isNull(), none if reason is None else reason).cast("string").alias("reason"), error.cast("string").alias("error"),
    )


def at_least(score: Column, threshold: float) -> Column:
    """score >= threshold, false for NaN, which Spark would rank above all numbers."""
    return (score >= threshold) & ~F.isnan(score)


class Matcher:
    """Pairs to outcomes, one row for each pair.  needs_text: whether the pairs' texts are read."""

    needs_text = False

    def match(self, pairs: DataFrame) -> DataFrame:
        raise NotImplementedError


class ThresholdMatcher(Matcher):
    """A match if the similarity is at least the threshold; a pair without one is an error."""

    def __init__(self, *, threshold: float = 0.5):
        self.threshold = threshold

    def match(self, pairs: DataFrame) -> DataFrame:
        s = F.col("similarity").cast("double")
        error = F.when(s.isNull(), "ThresholdMatcher needs a similarity score; the candidate pair carried none")
        return _outcomes(pairs, at_least(s, self.threshold), error)


class TokenJaccardMatcher(Matcher):
    """A match if the Jaccard similarity of the texts' words is at least the threshold; a text without words is an error."""

    needs_text = True

    def __init__(self, threshold: float = 0.5):
        self.threshold = threshold

    def match(self, pairs: DataFrame) -> DataFrame:
        a, b = tokens(F.coalesce("left_text", F.lit(""))), tokens(F.coalesce("right_text", F.lit("")))
        error = F.when((F.size(a) == 0) | (F.size(b) == 0), "a text has no words")
        score = jaccard(a, b)
        return _outcomes(pairs, score >= self.threshold, error, score)


class LevenshteinMatcher(Matcher):
    """A match if 1 - distance / length of the longer text, lowered, is at least the threshold; stays in the JVM."""

    needs_text = True

    def __init__(self, threshold: float = 0.6):
        self.threshold = threshold

    def match(self, pairs: DataFrame) -> DataFrame:
        a, b = F.lower(F.coalesce("left_text", F.lit(""))), F.lower(F.coalesce("right_text", F.lit("")))
        error = F.when((F.length(F.trim(a)) == 0) | (F.length(F.trim(b)) == 0), "a text is empty")
        longer = F.greatest(F.length(a), F.length(b), F.lit(1))
        score = 1 - F.levenshtein(a, b) / longer
        return _outcomes(pairs, score >= self.threshold, error, score)


class EditDistanceMatcher(Matcher):
    """A match if difflib's ratio of the lowered texts is at least the threshold; in Arrow batches, as SQL has no such ratio."""

    needs_text = True

    def __init__(self, threshold: float = 0.6):
        self.threshold = threshold

    def match(self, pairs: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def ratio(a, b):
            import difflib

            import pandas as pd

            ratios = [difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if x.strip() and y.strip() else None for x, y in zip(a, b)]
            return pd.Series(ratios, dtype="float64")

        scored = pairs.withColumn("__ratio", ratio(F.coalesce("left_text", F.lit("")), F.coalesce("right_text", F.lit(""))))
        score = F.col("__ratio")
        return _outcomes(scored, score >= self.threshold, F.when(score.isNull(), "a text is empty"), score)


@dataclass(frozen=True)
class RetryPolicy:
    max_retries: int = 3
    backoff_seconds: float = 0.0


class CallableMatcher(Matcher):
    """A Python function of two texts, such as a model's, with retries and a thread pool for each batch.

    It returns a dict or an object with is_match, confidence and rationale.  What still fails after the retries is an
    error row and does not touch its neighbours.  The outcomes should be written once before they are read twice:
    the linker does so.
    """

    needs_text = True
    persist = True

    def __init__(self, decide: Callable[[str, str], object], *, retry: RetryPolicy | None = None, max_concurrency: int = 1):
        if max_concurrency < 1:
            raise ValueError("max_concurrency must be positive")
        self.decide, self.retry, self.max_concurrency = decide, retry or RetryPolicy(), max_concurrency

    def match(self, pairs: DataFrame) -> DataFrame:
        decide, retry, n = self.decide, self.retry, self.max_concurrency
        schema = "left_id string, right_id string, similarity double, match boolean, confidence double, reason string, error string"

        def one(a: str, b: str):
            failure = None
            for attempt in range(retry.max_retries + 1):
                if attempt and retry.backoff_seconds:
                    time.sleep(retry.backoff_seconds)
                try:
                    got = decide(a, b)
                    read = got.get if isinstance(got, dict) else lambda k, g=got: getattr(g, k, None)
                    confidence, reason = read("confidence"), read("rationale")
                    return bool(read("is_match")), None if confidence is None else float(confidence), None if reason is None else str(reason), None
                except Exception as e:  # noqa: BLE001  any failure of the model is the pair's outcome
                    failure = e
            return None, None, None, f"LLM matching failed after {retry.max_retries + 1} attempt(s): {failure!r}"

        def run(batches):
            from concurrent.futures import ThreadPoolExecutor

            import pyarrow as pa

            with ThreadPoolExecutor(n) as pool:
                for batch in batches:
                    a, b = ([t or "" for t in batch.column(c).to_pylist()] for c in ("left_text", "right_text"))
                    got = list(pool.map(one, a, b))
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*got), (pa.bool_(), pa.float64(), pa.string(), pa.string()))] if got else None
                    if columns:
                        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], OUTCOME)

        rows = pairs.select("left_id", "right_id", F.col("similarity").cast("double").alias("similarity"), "left_text", "right_text")
        return rows.mapInArrow(run, schema)


def check_prompt(prompt: str) -> None:
    wrong = sorted({f for _, f, _, _ in string.Formatter().parse(prompt) if f is not None} - {"record_a", "record_b"})
    if wrong:
        raise ValueError(f"the prompt may use record_a and record_b only, not {wrong}; write {{{{ and }}}} for braces")


class PromptMatcher(CallableMatcher):
    """A model that takes a prompt with {record_a} and {record_b} in it, and gives a decision."""

    def __init__(self, *, llm: Callable[[str], object], prompt: str, retry: RetryPolicy | None = None, max_concurrency: int = 1):
        check_prompt(prompt)
        super().__init__(lambda a, b: llm(prompt.format(record_a=a, record_b=b)), retry=retry, max_concurrency=max_concurrency)


#: What a model is asked to give.
VERDICT = {
    "title": "Verdict", "description": "Whether two records are the same entity.", "type": "object", "required": ["is_match"],
    "properties": {"is_match": {"type": "boolean"}, "confidence": {"type": ["number", "null"]}, "rationale": {"type": ["string", "null"]}},
}


class StructuredModelMatcher(Matcher):
    """A chat model of LangChain's interface, bound once to the structure of a verdict.

    The model has with_structured_output(schema), and what that gives has batch(prompts, config=, return_exceptions=).
    An Arrow batch's prompts are asked in one call; those that failed, and only those, are asked again as one smaller
    call after the backoff.  What still fails is an error row.  The model goes to the workers, so it must be picklable.
    """

    needs_text = True
    persist = True

    def __init__(self, *, llm, prompt: str, retry: RetryPolicy | None = None, max_concurrency: int = 1):
        check_prompt(prompt)
        self.model, self.prompt = llm.with_structured_output(VERDICT), prompt
        self.retry, self.max_concurrency = retry or RetryPolicy(), max_concurrency

    def match(self, pairs: DataFrame) -> DataFrame:
        model, prompt, retry, n = self.model, self.prompt, self.retry, self.max_concurrency
        schema = "left_id string, right_id string, similarity double, match boolean, confidence double, reason string, error string"

        def verdict(got) -> tuple:
            value = got.get if isinstance(got, dict) else lambda k: getattr(got, k, None)
            sure, why = value("confidence"), value("rationale")
            return bool(value("is_match")), None if sure is None else float(sure), None if why is None else str(why), None

        def ask(prompts: list[str]) -> list[tuple]:
            out: list = [None] * len(prompts)
            tries = retry.max_retries + 1
            for attempt in range(tries):
                open_ = [k for k, x in enumerate(out) if x is None or x[3] is not None]
                if not open_:
                    break
                if attempt and retry.backoff_seconds:
                    time.sleep(retry.backoff_seconds)
                answers = model.batch([prompts[k] for k in open_], config={"max_concurrency": n}, return_exceptions=True)
                for k, x in zip(open_, answers, strict=True):
                    out[k] = (None, None, None, f"LLM matching failed after {tries} attempt(s): {x!r}") if isinstance(x, Exception) else verdict(x)
            return out

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                a, b = ([t or "" for t in batch.column(c).to_pylist()] for c in ("left_text", "right_text"))
                if got := ask([prompt.format(record_a=x, record_b=y) for x, y in zip(a, b)]):
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*got), (pa.bool_(), pa.float64(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], OUTCOME)

        rows = pairs.select("left_id", "right_id", F.col("similarity").cast("double").alias("similarity"), "left_text", "right_text")
        return rows.mapInArrow(run, schema)


class FlakyMatcher(Matcher):
    """A matcher of which a share of pairs fails, chosen by crc32 of 'left|right': as errors, or silently as no match."""

    def __init__(self, base: Matcher, fail_rate: float, on_failure: str = "error"):
        if on_failure not in ("error", "silent"):
            raise ValueError("on_failure is 'error' or 'silent'")
        self.base, self.fail_rate, self.on_failure, self.needs_text = base, fail_rate, on_failure, base.needs_text

    def match(self, pairs: DataFrame) -> DataFrame:
        fails = F.crc32(F.encode(F.concat_ws("|", "left_id", "right_id"), "UTF-8")) / F.lit(4294967296.0) < self.fail_rate
        got = self.base.match(pairs)
        if self.on_failure == "error":
            hurt = fails & F.col("error").isNull()
            return got.select(
                "left_id", "right_id", "similarity", F.when(~hurt, F.col("match")).alias("match"), F.when(~hurt, F.col("confidence")).alias("confidence"),
                F.when(~hurt, F.col("reason")).alias("reason"), F.when(hurt, "injected failure").otherwise(F.col("error")).alias("error"),
            )
        return got.withColumn("match", F.when(fails & F.col("match").isNotNull(), False).otherwise(F.col("match")))


class SimilarityThresholdFilter:
    """Keeps pairs of at least the threshold, and pairs without a score unless told to drop them."""

    def __init__(self, *, threshold: float = 0.0, drop_unscored: bool = False):
        self.threshold, self.drop_unscored = threshold, drop_unscored

    def filter(self, pairs: DataFrame) -> DataFrame:
        keep = at_least(F.col("similarity"), self.threshold)
        return pairs.where(keep if self.drop_unscored else F.col("similarity").isNull() | keep)
