"""Saved indexes: Parquet of records and vectors, and one JSON row that says what made them."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinmesh.errors import IncompatibleStore
from kinmesh.operators.blocking import DenseBlocker, DenseBlockingIndex

FORMAT = 1
_KEYS = ("format", "model_id", "embedding_dim", "top_k", "similarity_threshold", "n", "strategy")


def save_index(index, path: str) -> None:
    """Write an index; one that is at the path goes.  The matcher and the embedder are not saved."""
    blocking = index.blocking
    spec, spark = blocking.spec, blocking.records.sparkSession
    blocking.records.write.mode("overwrite").parquet(f"{path}/records")
    blocking.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    meta = {
        "format": FORMAT, "model_id": spec.embedder.model_id, "embedding_dim": spec.embedder.embedding_dim, "top_k": spec.top_k,
        "similarity_threshold": spec.similarity_threshold, "n": spark.read.parquet(f"{path}/vectors").count(), "strategy": spec.strategy,
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(path: str, *, embedder, matcher):
    """The saved index with a matcher and the embedder that made it, else IncompatibleStore.

    Checked in this order: the description is a JSON object, has all keys, the format, the model, its width, the vectors.
    """
    from kinmesh.operators.linker import LinkageIndex

    spark = SparkSession.getActiveSession()
    text = "\n".join(r.value for r in spark.read.text(f"{path}/meta").limit(100).collect())
    try:
        meta = json.loads(text)
    except ValueError as e:
        raise IncompatibleStore(f"the description is not JSON: {e}") from e
    if not isinstance(meta, dict):
        raise IncompatibleStore("the description is no JSON object")
    if lacking := [k for k in _KEYS if k not in meta]:
        raise IncompatibleStore(f"the description lacks {lacking}")
    for key, want in (("format", FORMAT), ("model_id", embedder.model_id), ("embedding_dim", embedder.embedding_dim)):
        if meta[key] != want:
            raise IncompatibleStore(f"{key} is {meta[key]!r}, not {want!r}")
    records, vectors = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/vectors")
    size = F.size("vector")
    n, low, high = vectors.agg(F.count("*"), F.min(size), F.max(size)).first()
    if n != meta["n"] or n != records.count() or (n and (low, high) != (want, want)):
        raise IncompatibleStore(f"{n} vectors of {low} to {high} numbers, not {meta['n']} of {want}")
    spec = DenseBlocker(embedder=embedder, similarity_threshold=meta["similarity_threshold"], top_k=meta["top_k"], strategy=meta["strategy"])
    return LinkageIndex(DenseBlockingIndex(spec, records, vectors), matcher)
