"""Embedders: text to unit vectors, in Arrow batches."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame


@runtime_checkable
class Embedder(Protocol):
    """What the engine asks of an embedder.  encode() runs on the executors, a batch at a time."""

    model_id: str
    embedding_dim: int

    def encode(self, texts: list[str], *, batch_size: int | None = None, show_progress: bool = False) -> np.ndarray: ...


class HashedNGramEmbedder:
    """Counts of character n-grams by crc32 bucket, of length one; a blank text is the zero vector."""

    def __init__(self, n_features: int = 256, ngram: int = 3):
        if n_features < 1 or ngram < 1:
            raise ValueError("n_features and ngram must be positive")
        self.embedding_dim, self.ngram = n_features, ngram
        self.model_id = f"hashed-ngram-{ngram}-{n_features}"

    def encode(self, texts, *, batch_size=None, show_progress=False) -> np.ndarray:
        out = np.zeros((len(texts), self.embedding_dim), np.float32)
        rows, lowered, n = [], [], 0
        for k, text in enumerate(texts):
            low = (text or "").lower()
            if low.strip():
                rows.append(k)
                lowered.append(low.encode("utf-8", "surrogatepass"))
                n += len(lowered[-1])
            if rows and (n >= 1 << 21 or k + 1 == len(texts)):
                counts = gram_counts(lowered, self.ngram, self.embedding_dim)
                length = np.sqrt((counts * counts).sum(1)).astype(np.float32)
                out[rows] = counts.astype(np.float32) / length[:, None]
                rows, lowered, n = [], [], 0
        return out


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def gram_counts(texts: list[bytes], n: int, buckets: int, step: int = 1 << 20) -> np.ndarray:
    """For each text, its character n-grams by crc32 modulo buckets; a text of fewer characters is one gram.

    All grams of all texts go through the checksum together, byte by byte, at most `step` of them at a time.
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    chars = np.flatnonzero(raw & 0xC0 != 0x80)
    end_of = np.cumsum([len(t) for t in texts])
    owner = np.searchsorted(end_of, chars, "right")
    size = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(chars)) - (np.cumsum(size) - size)[owner]
    starts = np.flatnonzero((place == 0) | (place + n <= size[owner]))
    edges = np.append(chars, len(raw))
    counts = np.zeros(len(texts) * buckets, np.int64)
    for at in range(0, len(starts), step):
        i = starts[at : at + step]
        own = owner[i]
        begin = chars[i]
        stop = np.minimum(edges[np.minimum(i + n, len(chars))], end_of[own])
        crc = np.full(len(i), 0xFFFFFFFF, np.uint32)
        for j in range(int((stop - begin).max())):
            on = np.flatnonzero(begin + j < stop)
            c = crc[on]
            crc[on] = _TABLE[(c ^ raw[begin[on] + j]) & 255] ^ c >> 8
        counts += np.bincount(own * buckets + (~crc % np.uint32(buckets)).astype(np.int64), minlength=len(counts))
    return counts.reshape(len(texts), buckets)


class SentenceTransformerEmbedder:
    """A sentence-transformers model by name, loaded once in each Python process that encodes; vectors have length one."""

    _models: dict = {}

    def __init__(self, model_name: str):
        self.model_id = model_name
        self.embedding_dim = int(self._sizes(self._model()))

    @staticmethod
    def _sizes(model) -> int:
        for name in ("get_embedding_dimension", "get_sentence_embedding_dimension"):  # the newer name first
            if hasattr(model, name):
                return getattr(model, name)()
        raise AttributeError("the model does not tell the width of its vectors")

    def _model(self):
        from kinmesh.functions.optional import require

        if self.model_id not in self._models:
            self._models[self.model_id] = require("sentence_transformers").SentenceTransformer(self.model_id)
        return self._models[self.model_id]

    def encode(self, texts, *, batch_size=None, show_progress=False) -> np.ndarray:
        how = {"batch_size": batch_size or 32, "show_progress_bar": show_progress, "normalize_embeddings": True}
        return np.asarray(self._model().encode(list(texts), **how), np.float32)


def embed(records: DataFrame, embedder: Embedder, *, batch_size: int | None = None) -> DataFrame:
    """The records' id and pos with their vectors."""
    dim = embedder.embedding_dim

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = [t or "" for t in part.column("text").to_pylist()]
                got = np.ascontiguousarray(embedder.encode(texts, batch_size=batch_size), np.float32)
                if got.shape != (len(texts), dim):
                    raise ValueError(f"the embedder gave shape {got.shape}, not {(len(texts), dim)}")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, dim, dtype=np.int32)), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("pos"), vectors], ["id", "pos", "vector"])

    return records.select("id", "pos", "text").mapInArrow(encode, "id string, pos long, vector array<float>")
