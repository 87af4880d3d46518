"""What the engine asks of parts that a user may put in: tables in, tables out, nothing kept between calls.

Vectors are (id, pos, vector), records (id, text, fields, pos), pairs as in sources.records, outcomes as in
operators.matching.  A spec holds configuration only; its build() gives an artifact over one table.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, TypeVar, runtime_checkable

from pyspark.sql import DataFrame

from kinmesh.functions.embedders import Embedder
from kinmesh.functions.text import Serializer

__all__ = [
    "Blocker", "BlockingIndex", "Clusterer", "Embedder", "Filter", "Matcher", "SearchableIndex", "Serializer", "Trainer", "TrainingPairs", "VectorIndex",
]

Component = TypeVar("Component")


@runtime_checkable
class SearchableIndex(Protocol):
    """Indexed vectors.  search() gives right_id, right_pos, left_id, similarity and rank; another width is DimensionMismatch."""

    @property
    def vectors(self) -> DataFrame: ...

    @property
    def ids(self) -> DataFrame: ...

    def search(self, queries: DataFrame, *, top_k: int, threshold: float | None = None) -> DataFrame: ...

    def extended(self, vectors: DataFrame) -> SearchableIndex: ...


@runtime_checkable
class VectorIndex(Protocol):
    """How vectors are indexed."""

    def build(self, vectors: DataFrame, dim: int) -> SearchableIndex: ...


@runtime_checkable
class BlockingIndex(Protocol):
    """Indexed records; query() gives candidate pairs."""

    def query(self, records: DataFrame, *, top_k: int | None = None, similarity_threshold: float | None = None) -> DataFrame: ...


@runtime_checkable
class Blocker(Protocol):
    """How records are indexed."""

    def build(self, records: DataFrame) -> BlockingIndex: ...


@runtime_checkable
class Filter(Protocol):
    """Pairs to fewer pairs, before matching."""

    def filter(self, pairs: DataFrame) -> DataFrame: ...


@runtime_checkable
class Matcher(Protocol):
    """Pairs to outcomes, one for each pair."""

    def match(self, pairs: DataFrame) -> DataFrame: ...


@runtime_checkable
class Clusterer(Protocol):
    """A result's matches to clusters."""

    def cluster(self, result): ...


@dataclass(frozen=True)
class TrainingPairs:
    """Pairs of records to learn from: (left_id, right_id, left_text, right_text, and batch where training goes by batches)."""

    positives: DataFrame
    negatives: DataFrame
    batches: str | None = None  # the column that names a pair's batch


@runtime_checkable
class Trainer(Protocol[Component]):
    """Gives a new component from pairs, beginning from `base` if there is one, which stays as it is."""

    def train(self, pairs: TrainingPairs, *, base: Component | None = None) -> Component: ...
