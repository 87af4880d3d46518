"""Benchmark decontamination with a generalised suffix automaton.

The test items' words become one suffix automaton (a few states a word).  Documents stream through it:
after each word the automaton's state and the matching length say which item text ends here.  Where the
length reaches ``window`` words, or a whole item that is shorter, the words are hit.  Words that the items
do not have, and word pairs that they do not have, put the automaton back to its start, so those are
skipped in numpy and only stretches that may hold a window are streamed word by word.

Items come in blocks of about ``block_words`` words, each its own broadcast automaton.  A single block is one stage
without a shuffle.  With more, each has a pass of its own over the documents, which writes the hit ones' spans; these
are gathered by text and meet their rows again in a join.  So the memory of workers and driver does not grow with the
items: a worker holds one automaton at a time and the driver two.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.operators.skew import join_hot

from .common import ALNUM, binary, scratch_path, stash, table

_BITS = 22
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Generalised suffix automaton over words, with the items of its windows."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(key, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]) for key, words in items if words]
        for _, ids in texts:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.items: dict[int, set] = {}  # of states that hold a text of `window` words
        self.short: dict[int, dict[int, set]] = {}  # state -> length of a whole short item -> items
        for key, ids in texts:
            state = 0
            for n, w in enumerate(ids, 1):
                state = self.next[state][w]
                if n >= window:
                    self.items.setdefault(self.up(state, window), set()).add(key)
            if len(ids) < window:
                self.short.setdefault(self.up(state, len(ids)), {}).setdefault(len(ids), set()).add(key)
        above = [False] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above[s] = s in self.short or (self.link[s] > 0 and above[self.link[s]])
        self.above = above
        self.least = min([window, *(len(ids) for _, ids in texts)])
        self.pairs = np.zeros(1 << _BITS, bool)
        for _, ids in texts:
            a = np.array(ids, np.int64)
            self.pairs[pair_key(a[:-1], a[1:])] = True

    def up(self, state: int, n: int) -> int:
        """The state of the suffix of n words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, follows: dict[int, int]) -> int:
        self.next.append(follows)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of q for the shorter texts that p leads to."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def stream(self, ids: list[int], at: int, spans: list[list[int]], found: set) -> None:
        """Run over the word ids that begin at word `at`; add [start, end) spans, merged, and items."""
        state = length = 0
        for i, w in enumerate(ids, at):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (to := self.next[state].get(w)) is None:
                continue
            state, length = to, length + 1
            hit = 0
            if length >= self.window:
                hit = self.window
                found |= self.items[self.up(state, hit)]
            if self.above[state]:
                s = state
                while s > 0:
                    for n, keys in self.short.get(s, {}).items():
                        if n <= length:
                            hit = max(hit, n)
                            found |= keys
                    s = self.link[s]
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])

    def matches(self, texts: list[list[bytes]]) -> dict[int, tuple[list[list[int]], set]]:
        """By the index of each text that is hit: its spans and the items."""
        out: dict[int, tuple[list[list[int]], set]] = {}
        n = sum(map(len, texts))
        ids = np.fromiter(map(self.vocab.get, (w for t in texts for w in t), repeat(0)), np.int64, n)
        ends = np.cumsum([len(t) for t in texts])
        good = (ids[:-1] > 0) & (ids[1:] > 0)
        good &= self.pairs[pair_key(ids[:-1], ids[1:])]
        good[ends[(ends > 0) & (ends < n)] - 1] = False  # the next word is another text's
        stops = np.concatenate([[-1], np.flatnonzero(~good), [n - 1]])
        keep = np.flatnonzero(np.diff(stops) >= self.least)
        for a, b in zip((stops[keep] + 1).tolist(), (stops[keep + 1] + 1).tolist()):
            k = int(np.searchsorted(ends, a, "right"))
            first = int(ends[k - 1]) if k else 0
            spans, found = out.setdefault(k, ([], set()))
            self.stream(ids[a:b].tolist(), a - first, spans, found)
        return {k: v for k, v in out.items() if v[0]}


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 0x9E3779B1 + b * 0x85EBCA77) >> 7 & ((1 << _BITS) - 1)


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _groups(rows: list, words: int = 200_000) -> Iterator[list]:
    group, n = [], 0
    for x in rows:
        group.append(x)
        n += len(x)
        if n >= words:
            yield group
            group, n = [], 0
    if group:
        yield group


def item_blocks(items: DataFrame, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """One automaton for each block of items, at least one."""
    block, n, made = [], 0, 0
    for row in items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        words = bytes(row[1] or b"").translate(ALNUM).split()
        block.append((row[0] if row[0] is not None else "", words))
        n += len(words)
        if n >= block_words:
            yield SuffixAutomaton(block, window)
            block, n, made = [], 0, made + 1
    if block or not made:
        yield SuffixAutomaton(block, window)


_HITS = "__key string, spans array<array<int>>, item_ids array<string>"
#: Rows of hits that a join may broadcast have so many spans and items at most.
_SMALL_HITS = 100


def _search(automaton: SuffixAutomaton, texts: list[list[bytes]]) -> tuple[list[list[list[int]]], list[list[str]]]:
    """Merged spans and sorted items of each text."""
    spans: list = [[]] * len(texts)
    keys: list = [[]] * len(texts)
    at = 0
    for group in _groups(texts):
        for k, (s, found) in automaton.matches(group).items():
            spans[at + k], keys[at + k] = merge(s), sorted(found)
        at += len(group)
    return spans, keys


def _words(batch) -> list[list[bytes]]:
    return [t.translate(ALNUM).split() for t in binary(batch, "text")]


def _through(
    spark: SparkSession, docs: DataFrame, items: DataFrame, window: int, block_words: int, finish: Callable, schema
) -> DataFrame:
    """What finish(batch, n_words, spans, item_ids) makes of the Arrow batches of the documents."""
    blocks = item_blocks(items, window, block_words)
    automaton, after = next(blocks), next(blocks, None)
    if after is None:
        held = spark.sparkContext.broadcast(automaton)

        def scan(batches):
            for batch in batches:
                texts = _words(batch)
                yield from finish(batch, [len(t) for t in texts], *_search(held.value, texts))

        return docs.mapInArrow(scan, schema)
    # a text's hits depend on it alone; the id spreads the copies of one text
    text = F.col("text").cast("string")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))))
    keyed = docs.select(key.alias("__key"), text.alias("text"))
    path = scratch_path(spark, "block-hits")
    while automaton is not None:
        held = spark.sparkContext.broadcast(automaton)
        hits = keyed.mapInArrow(_hit_rows(held), _HITS).groupBy("__key")
        hits = hits.agg(F.first("spans").alias("spans"), F.first("item_ids").alias("item_ids"), F.count("*").alias("__n"))
        hits.write.mode("append").parquet(path)
        held.destroy()
        automaton, after = after, next(blocks, None)
    found = spark.read.schema(hits.schema).parquet(path).groupBy("__key")
    found = found.agg(
        F.flatten(F.collect_list("spans")).alias("__spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("__items"), F.max("__n").alias("__n"),
    )
    # rows with many hits are left to the shuffle
    small = F.size("__spans") + F.size("__items") <= _SMALL_HITS
    found = stash(found.withColumn("__n", F.when(small, F.col("__n")).otherwise(0)), "hits")
    rows = docs.select(key.alias("__key"), F.struct("*").alias("__row"))
    met = join_hot(rows, found, ["__key"], n="__n", how="left").select("__row", "__spans", "__items")

    def gather(batches):
        import pyarrow as pa

        for batch in batches:
            own = pa.RecordBatch.from_struct_array(batch.column("__row"))
            spans, keys = ([x or [] for x in batch.column(name).to_pylist()] for name in ("__spans", "__items"))
            yield from finish(own, [len(t) for t in _words(own)], [merge(s) for s in spans], keys)

    return met.mapInArrow(gather, schema)


def _hit_rows(held):
    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            spans, keys = _search(held.value, _words(batch))
            hit = [k for k, s in enumerate(spans) if s]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__key").take(pa.array(hit, pa.int64())),
                    pa.array([spans[k] for k in hit], pa.list_(pa.list_(pa.int32()))),
                    pa.array([keys[k] for k in hit], pa.list_(pa.string())),
                ],
                ["__key", "spans", "item_ids"],
            )

    return scan


def match_documents(
    spark: SparkSession, docs: DataFrame, items: DataFrame, *, window: int = 13, block_words: int = 200_000
) -> DataFrame:
    """doc_id, n_words, spans (array of [start, end) in words), item_ids (sorted strings), text.

    A null or empty text has no words, no spans and no items; an empty item table hits nothing; null item ids
    count as ''.  Repeated rows of documents come out once for each row; equal items each count.  Other columns
    of the inputs are ignored.
    """

    def finish(batch, n_words, spans, keys):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()),
                pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(keys, pa.list_(pa.string())),
            ],
            ["doc_id", "text", "n_words", "spans", "item_ids"],
        )

    schema = "doc_id long, text string, n_words long, spans array<array<int>>, item_ids array<string>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _through(spark, rows, items, window, block_words, finish, schema)


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, *, share: int = 20, **how) -> DataFrame:
    """match_documents() with n_hit, n_items and contaminated: a hit, and at least one word in `share` is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return (
        match_documents(spark, docs, items, **how)
        .withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: one row per document with its contamination counts."""
    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated")


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(
    spark: SparkSession, docs: DataFrame, items: DataFrame, *, window: int = 13, share: int = 20, longest: int = 25,
    drop: bool = True, block_words: int = 200_000,
) -> DataFrame:
    """The documents after removal, with all their columns as they were.

    A document is over the coverage limit if at least one word in `share` is hit.  Those go (drop=True) or stay
    without their hit spans, each of which has at least `window` words or is a whole shorter item (drop=False).
    Others stay without the spans that exceed the length limit, more than `longest` words; n_chars, if there is such a
    column, is counted anew for texts that are cut.  Documents without such spans stay untouched, as do null and empty
    texts.  Repeated rows are judged each by itself, alike.
    """

    def finish(batch, n_words, spans, _):
        import pyarrow as pa

        over = [bool(s) and share * sum(b - a for a, b in s) >= n for s, n in zip(spans, n_words)]
        gone = [s if x else [y for y in s if y[1] - y[0] > longest] for s, x in zip(spans, over)]
        if drop:
            stay = [k for k, x in enumerate(over) if not x]
            batch, gone = batch.take(pa.array(stay, pa.int64())), [gone[k] for k in stay]
        if any(gone):
            names = batch.schema.names
            k = names.index("text")
            clean = [cut(t, s) if s else t for t, s in zip(batch.column(k).to_pylist(), gone)]
            batch = batch.set_column(k, batch.schema.field(k), pa.array(clean, batch.schema.field(k).type))
            if "n_chars" in names:
                k = names.index("n_chars")
                n = [len(t) if s else old for t, s, old in zip(clean, gone, batch.column(k).to_pylist())]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(n, batch.schema.field(k).type))
        yield batch

    return _through(spark, docs, items, window, block_words, finish, docs.schema)


#: The query in DuckDB's SQL.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
         FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM wins))),
hits AS (SELECT DISTINCT doc_id, item_id, n, i FROM grams JOIN wins USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
