"""Flat vector indexes: exact inner products over all indexed vectors, with numpy or, where it is installed, FAISS."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from kinmesh.errors import DimensionMismatch
from kinmesh.operators.knn import PLACES, Rows, check_width, knn_join, top_k
from kinmesh.storage import stash


class FlatIndex:
    """How vectors are indexed.  strategy: broadcast or blocks; by the matrix's size if it is not told."""

    def __init__(self, strategy: str | None = None):
        self.strategy = strategy

    kernel = staticmethod(top_k)

    def build(self, vectors: DataFrame, dim: int) -> FlatSearchable:
        return FlatSearchable(self, vectors, dim)


class FlatSearchable:
    """Indexed vectors, which do not change."""

    def __init__(self, spec: FlatIndex, vectors: DataFrame, dim: int):
        self.spec, self._vectors, self.dim = spec, vectors, dim
        self._n: int | None = None

    @property
    def vectors(self) -> DataFrame:
        return self._vectors

    @property
    def ids(self) -> DataFrame:
        return self._vectors.select("id")

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self._vectors.count()
        return self._n

    def search(self, queries: DataFrame, *, top_k: int, threshold: float | None = None) -> DataFrame:
        """right_id, right_pos, left_id, similarity and rank of each query's best vectors, ties by left_id."""
        return knn_join(
            queries, self._vectors, k=top_k, dim=self.dim, threshold=threshold, strategy=self.spec.strategy, n_index=self.n, kernel=self.spec.kernel
        )

    def extended(self, vectors: DataFrame) -> FlatSearchable:
        """A new index with more vectors, whose ids must be new; this one stays as it is."""
        if again := vectors.join(self._vectors, "id", "left_semi").limit(1).collect():
            raise ValueError(f"id {again[0].id!r} is indexed already")
        check_width(vectors, self.dim)
        return FlatSearchable(self.spec, stash(self._vectors.unionByName(vectors), "vectors"), self.dim)


def faiss_top_k(queries: np.ndarray, rows: Rows, k: int, least: float | None):
    """As top_k(), but FAISS finds the rows; those beyond the k-th distinct one that tie with it are FAISS's choice."""
    from kinmesh.functions.optional import require

    matrix = np.ascontiguousarray(rows.matrix, np.float32)
    flat = require("faiss").IndexFlatIP(matrix.shape[1])
    flat.add(matrix)
    if not len(matrix) or not len(queries):
        yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in queries)
        return
    if queries.shape[1] != matrix.shape[1]:
        raise DimensionMismatch(f"vectors of {queries.shape[1]} numbers, not {matrix.shape[1]}")
    _, found = flat.search(np.ascontiguousarray(queries, np.float32), min(k, len(matrix)))
    for q, kinds in zip(queries, found):
        kinds = np.sort(kinds[kinds >= 0])
        score = np.round(matrix[kinds].astype(np.float64) @ q.astype(np.float64), PLACES)
        keep = ~np.isnan(score) if least is None else score >= least
        yield rows.expanded(kinds[keep], score[keep], k)


class FaissFlatIndex(FlatIndex):
    """The same with FAISS's flat inner-product index in the workers; needs faiss where it is made and where it runs."""

    def __init__(self, strategy: str | None = None):
        from kinmesh.functions.optional import require

        require("faiss")
        super().__init__(strategy)

    kernel = staticmethod(faiss_top_k)
