"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 bits.  Each bit i gets a nonzero vector m(i) of r + 1 bits; table v (a nonzero vector too)
keeps the bits with <m(i), v> = 1 (mod 2).  For r or fewer differing bits there is a v that is orthogonal to all
their vectors (r equations, r + 1 unknowns), so the pair agrees on all bits of table v: every pair within the
radius collides in one of the 2^(r+1) - 1 tables, and each table keeps about half of the bits.

Only distinct fingerprints are compared, so exact copies cost nothing.  A task goes through its buckets in sorted
order and emits no more links than a spanning forest of a bucket needs.  Buckets of more than `block`
fingerprints are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.operators.clustering import smallest_reachable

from .common import binary, stash, table

_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, th (a hash of the text) and fingerprint (the 64 bits as a long) of every row; null and empty texts have 0."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            got = np.fromiter((fingerprint(t, shingle) for t in binary(batch, "text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(got.view(np.int64), pa.int64())], ["doc_id", "th", "fingerprint"]
            )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("th"), text.alias("text"))
    return rows.mapInArrow(scan, "doc_id long, th long, fingerprint long")


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def covering_masks(radius: int) -> list[int]:
    """The bits that each table keeps."""
    m = [1 + i % ((1 << (radius + 1)) - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if (m[i] & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def forest(bits: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Index pairs within the radius that connect whatever the radius connects."""
    left = np.arange(len(bits))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            a = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[a]) <= radius
            for b in left[near].tolist():
                yield a, b
                queue.append(b)
            left = left[~near]


def links(fingerprints: DataFrame, *, radius: int = 3, block: int = 4096) -> DataFrame:
    """(a, b) with a > b: links between distinct fingerprints that connect all those within the radius."""
    spark = fingerprints.sparkSession
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in covering_masks(radius)))
    rows = fingerprints.select(F.col("fingerprint").alias("fp")).select("fp", F.posexplode(keys).alias("t", "key"))
    large = stash(rows.groupBy("t", "key").count().where(F.col("count") > block), "simhash-large")
    n_large = large.count()
    zero = F.lit(0)
    if n_large:
        n = F.ceil(F.col("count") / block).cast("int")
        side = F.broadcast(large) if n_large <= 100_000 else large
        own = F.pmod(F.xxhash64("fp"), n).cast("int")
        met = rows.join(side, ["t", "key"], "left").withColumn("n", F.coalesce(n, F.lit(1))).withColumn("own", F.coalesce(own, zero))
        other = F.explode(F.sequence(zero, F.col("n") - 1)).alias("o")
        met = met.select("t", "key", "fp", "own", other)
        rows = met.select("t", "key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "fp")
    else:
        rows = rows.select("t", "key", zero.alias("i"), zero.alias("j"), "fp")
    group = ["t", "key", "i", "j"]

    def scan(batches):
        import pyarrow as pa

        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = np.ones(len(now[0]), bool)
            for x in now[:4]:
                last &= x == x[-1]
            cut = len(last) - int(last.sum())  # the last group may go on in the next batch
            held = [x[cut:] for x in now]
            if cut:
                yield from emit([x[:cut] for x in now], pa)
        if held is not None:
            yield from emit(held, pa)

    def emit(x, pa):
        change = np.zeros(len(x[0]), bool)
        change[0] = True
        for y in x[:4]:
            change[1:] |= y[1:] != y[:-1]
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, len(change)))
        fps, a, b = x[4].view(np.uint64), [], []
        two = start[size == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        a.append(near)
        b.append(near + 1)
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            if pairs := list(forest(fps[s : s + n], radius)):
                got = np.array(pairs)
                a.append(got[:, 0] + s)
                b.append(got[:, 1] + s)
        a, b = x[4][np.concatenate(a)], x[4][np.concatenate(b)]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    # equal fingerprints come once, so no group has a repeated one
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(scan, "a long, b long").distinct()


def _classes(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fingerprint, first) where first is the component's first (no id, doc_id, th)."""
    marked = stash(with_fingerprints(docs, shingle), "simhash")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    distinct = stash(marked.groupBy("fingerprint").agg(F.min(row).alias("least")), "simhash-distinct")
    found = stash(smallest_reachable(links(distinct, radius=radius)), "simhash-roots")
    rooted = distinct.join(found, distinct.fingerprint == found.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return marked, rooted.join(first, "root").select("fingerprint", "first")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (long) and component_id (the smallest doc_id that links reach) of every row.

    Null and empty texts share fingerprint 0 and are linked like any other.  Repeated rows come out once for each
    row.  A null doc_id names a component only if no row of it has an id.
    """
    marked, named = _classes(docs, shingle, radius)
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, that of the smallest doc_id (then text hash), all its columns as they were.

    Of rows that are equal in doc_id and text, any one stays.
    """
    marked, named = _classes(docs, shingle, radius)
    keep = named.select(F.col("first.doc_id").alias("__id"), F.col("first.th").alias("__th")).distinct()
    met = docs.withColumn("__own", _text_hash())
    met = met.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th")), "left_semi")
    if marked.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        met = met.dropDuplicates(["doc_id", "__own"])
    return met.drop("__own")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprint and component of every document."""
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
