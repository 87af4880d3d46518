"""Dense blocking: records to vectors, and each query's nearest indexed records as candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.errors import InvalidTopK
from kinmesh.functions.embedders import Embedder, embed
from kinmesh.operators.index import FlatIndex
from kinmesh.operators.knn import check_width
from kinmesh.ports import SearchableIndex, VectorIndex
from kinmesh.storage import stash


def check_top_k(k: int) -> int:
    if k <= 0:
        raise InvalidTopK(f"top_k must be positive, not {k}")
    return k


class DenseBlocker:
    """How records are indexed; build() gives the index."""

    def __init__(self, *, embedder: Embedder, similarity_threshold: float = 0.0, top_k: int = 10, batch_size: int | None = None, strategy: str | None = None, index: VectorIndex | None = None):
        self.embedder, self.similarity_threshold, self.top_k = embedder, similarity_threshold, top_k
        self.batch_size, self.strategy = batch_size, strategy
        self.index = index or FlatIndex(strategy)

    def build(self, records: DataFrame) -> DenseBlockingIndex:
        check_top_k(self.top_k)
        vectors = stash(embed(records, self.embedder, batch_size=self.batch_size), "vectors")
        return DenseBlockingIndex(self, records, vectors)


class DenseBlockingIndex:
    """Indexed records (id, text, fields, pos) and their vectors (id, pos, vector)."""

    def __init__(self, spec: DenseBlocker, records: DataFrame, vectors: DataFrame):
        self.spec, self.records = spec, records
        self.searchable: SearchableIndex = spec.index.build(vectors, spec.embedder.embedding_dim)

        self._n: int | None = None

    @property
    def vectors(self) -> DataFrame:
        return self.searchable.vectors

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.vectors.count()
        return self._n

    def query(self, records: DataFrame, *, top_k: int | None = None, similarity_threshold: float | None = None, texts: bool = True) -> DataFrame:
        """Candidate pairs: left is the indexed record, right the query, scores at least the threshold, top_k for each query."""
        return self.hits(embed(records, self.spec.embedder), top_k=top_k, similarity_threshold=similarity_threshold, right=records if texts else None)

    def hits(self, vectors: DataFrame, *, top_k=None, similarity_threshold=None, right: DataFrame | None = None) -> DataFrame:
        k = check_top_k(self.spec.top_k if top_k is None else top_k)
        least = self.spec.similarity_threshold if similarity_threshold is None else similarity_threshold
        got = self.searchable.search(vectors, top_k=k, threshold=least)
        if right is None:
            return got.select("left_id", "right_id", "similarity", F.lit(None).cast("string").alias("left_text"), F.lit(None).cast("string").alias("right_text"), "right_pos", "rank")
        left_text = self.records.select(F.col("id").alias("left_id"), F.col("text").alias("left_text"))
        right_text = right.select(F.col("id").alias("right_id"), F.col("text").alias("right_text"))
        return got.join(left_text, "left_id").join(right_text, "right_id").select("left_id", "right_id", "similarity", "left_text", "right_text", "right_pos", "rank")

    def extended(self, records: DataFrame) -> DenseBlockingIndex:
        """A new index with more records, whose ids must be new."""
        if again := records.join(self.vectors, "id", "left_semi").limit(1).collect():
            raise ValueError(f"id {again[0].id!r} is indexed already")
        vectors = embed(records, self.spec.embedder, batch_size=self.spec.batch_size)
        check_width(vectors, self.spec.embedder.embedding_dim)
        return DenseBlockingIndex(self.spec, self.records.unionByName(records), stash(self.vectors.unionByName(vectors), "vectors"))
