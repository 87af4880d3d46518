"""The linker's verbs: link, dedupe, match_pairs, block and index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.functions.embedders import HashedNGramEmbedder, embed
from kinmesh.operators.blocking import DenseBlocker, DenseBlockingIndex
from kinmesh.operators.matching import OUTCOME, Matcher, ThresholdMatcher
from kinmesh.operators.results import LinkageResult
from kinmesh.sources.records import PAIR_COLUMNS, Source, read_records
from kinmesh.storage import stash


def decide(pairs: DataFrame, matcher: Matcher) -> LinkageResult:
    """The matcher's outcomes, which must be as many as the pairs; those of models are written once."""
    got = matcher.match(pairs)
    if missing := set(OUTCOME) - set(got.columns):
        raise ValueError(f"a matcher's outcomes lack {sorted(missing)}")
    if getattr(matcher, "persist", False):
        pairs = stash(pairs, "pairs")
        got = stash(matcher.match(pairs).select(OUTCOME), "outcomes")
        if got.count() != pairs.count():
            raise ValueError("a matcher must give one outcome per input pair")
    return LinkageResult(got.select(OUTCOME))


class LinkageIndex:
    """An index that can be asked again and again, saved and loaded."""

    def __init__(self, blocking: DenseBlockingIndex, matcher: Matcher):
        self.blocking, self.matcher = blocking, matcher

    def candidates(self, source: Source, *, top_k: int | None = None, similarity_threshold: float | None = None) -> DataFrame:
        records = read_records(source)
        return self.blocking.query(records, top_k=top_k, similarity_threshold=similarity_threshold).select(PAIR_COLUMNS)

    def query(self, source: Source, *, top_k: int | None = None, similarity_threshold: float | None = None) -> LinkageResult:
        records = read_records(source)
        needs = self.matcher.needs_text
        pairs = self.blocking.query(records, top_k=top_k, similarity_threshold=similarity_threshold, texts=needs)
        return decide(pairs.select(PAIR_COLUMNS), self.matcher)

    def save(self, path: str) -> None:
        from kinmesh.sources.store import save_index

        save_index(self, path)

    @classmethod
    def load(cls, path: str, *, embedder, matcher: Matcher) -> LinkageIndex:
        from kinmesh.sources.store import load_index

        return load_index(path, embedder=embedder, matcher=matcher)


class DenseLinker:
    """Blocker and matcher together.  link(a, b) is index(a).query(b); block(a, b) is index(a).candidates(b)."""

    def __init__(self, *, blocker: DenseBlocker | None, matcher: Matcher):
        self.blocker, self.matcher = blocker, matcher

    @classmethod
    def with_defaults(cls, *, blocker: DenseBlocker | None = None, matcher: Matcher | None = None) -> DenseLinker:
        blocker = blocker or DenseBlocker(embedder=HashedNGramEmbedder(1024, 3), top_k=5, similarity_threshold=0.0)
        return cls(blocker=blocker, matcher=matcher or ThresholdMatcher(threshold=0.5))

    def _blocker(self, verb: str) -> DenseBlocker:
        if self.blocker is None:
            raise ValueError(f"{verb} requires a blocker; match_pairs does not")
        return self.blocker

    def index(self, source: Source) -> LinkageIndex:
        blocker = self._blocker("index")
        return LinkageIndex(blocker.build(read_records(source)), self.matcher)

    def link(self, left: Source, right: Source) -> LinkageResult:
        self._blocker("link")
        return self.index(left).query(right)

    def block(self, left: Source, right: Source, *, top_k: int | None = None, similarity_threshold: float | None = None) -> DataFrame:
        self._blocker("block")
        return self.index(left).candidates(right, top_k=top_k, similarity_threshold=similarity_threshold)

    def dedupe(self, source: Source) -> LinkageResult:
        """Each unordered pair of the source's records once.

        Records are embedded once.  A record's own hit takes one of its top_k places.  Of both directions that which
        comes first stays: the pair whose query (right) stands earlier in the source.
        """
        blocker = self._blocker("dedupe")
        index = blocker.build(read_records(source))
        hits = index.hits(index.vectors, right=index.records if self.matcher.needs_text else None).where(F.col("left_id") != F.col("right_id"))
        return decide(canonical(hits).select(PAIR_COLUMNS), self.matcher)

    def match_pairs(self, candidates: DataFrame) -> LinkageResult:
        return decide(candidates, self.matcher)


def canonical(hits: DataFrame) -> DataFrame:
    """Of the two directions of a pair, that which comes first by query and rank."""
    pair = Window.partitionBy(F.least("left_id", "right_id"), F.greatest("left_id", "right_id")).orderBy("right_pos", "rank", "right_id")
    return hits.withColumn("__n", F.row_number().over(pair)).where("__n = 1").drop("__n")


def embed_source(source: Source, embedder) -> DataFrame:
    return embed(read_records(source), embedder)
