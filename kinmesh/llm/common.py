"""Helpers that the training-data operators share: tables, shared storage and words."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinmesh.storage import shared_dir, stash

__all__ = ["ALNUM", "LOWER", "NON_WORD", "UPPER", "binary", "scratch_path", "shared_dir", "stash", "table"]

#: Maps every byte of UTF-8 text to itself, A-Z to a-z, and ASCII non-alphanumerics to a blank, so
#: that ``text.translate(ALNUM).split()`` gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: The same words for Java's regular expressions, on text whose A-Z have been lowered.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kinmesh/{name}-{uuid.uuid4().hex}"


def binary(batch, name: str):
    """A string column of an Arrow batch as bytes objects, null as b''."""
    import pyarrow as pa

    column = batch.column(name)
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]
