"""Best-fit packing by hierarchical residual rounds.

Each task tokenizes its documents and packs their pieces best-fit decreasing.  Bins that are nearly full are done;
the underfull ones become items of the next round, in which those of `fan_in` tasks are merged, until one group is
left.  No bin is left out: a round needs only the number of underfull bins by task and fill, of which there are at most
`capacity` for each task however many bins there are, and packs whole ranges of equal fills at once.  Its plan says
which ranges go into which; bins find their place by (task, fill, rank), in a join that spreads like the bins do.
Rounds are written to the shared folder, so that bins keep their numbers if an executor is lost.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, stash, table

_PIECES = "task int, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill int, rank long"
#: Ranges of a round: n items of one task and fill, from `rank` on, `per` of them in a bin one after the other from
#: `at` on; their bins are `bin` and the next, which are ranges of the group's bins of fill to_fill, from to_rank on.
_PLAN = "group int, task int, fill int, rank long, n long, per int, at int, bin long, to_fill int, to_rank long"


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The tokenizer's own parting of text, for lowered bytes; bytes of other characters count as letters.
_UNIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")


class WordCache:
    """Token ids of texts, as little-endian bytes, put together from those of their units.

    The tokenizer lowers a text and parts it into runs of letters, single digits, runs of other characters and a few
    endings after an apostrophe, and encodes each by itself; so do the units here.  New letter units are encoded many
    at a time and parted where a token ends a word.  A text in which a unit beyond ASCII is not all letters, or which
    may hold a special token, is encoded word by word.
    """

    def __init__(self, path: str, most: int = 500_000):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.ids: dict[bytes, bytes | None] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    def _letters(self, words: list[str]) -> list[bytes]:
        import numpy as np

        out = []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part):
                out += self._each(part)
                continue
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _learn(self, new: set[bytes]) -> None:
        letters, rest = [], []
        for u in new:
            if u.isalpha() or (not u.isascii() and u.decode().isalpha()):
                letters.append(u)
            elif u.isascii():
                rest.append(u)
            else:
                self.ids[u] = None
        self.ids.update(zip(letters, self._letters([u.decode() for u in letters])))
        self.ids.update(zip(rest, self._each([u.decode() for u in rest])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [_UNIT.findall(t.lower()) for t in texts]
        if len(self.ids) > self.most:
            self.ids.clear()
        self._learn(set().union(*split).difference(self.ids))
        out = []
        for text, units in zip(texts, split):
            ids = None
            if b"<|" not in text:
                try:
                    ids = b"".join(map(self.ids.__getitem__, units))
                except TypeError:  # a unit without ids
                    pass
            out.append(b"".join(self._each([w.decode() for w in text.split()])) if ids is None else ids)
        return out


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each item, in the order given, and the bins' fills.  Best fit: the fullest bin that has room."""
    fills: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    bins, places = [], []
    for n in sizes:
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        places.append(fills[b])
        fills[b] += n
        if rest := room - n:
            if rest not in by_room:
                by_room[rest] = []
                insort(rooms, rest)
            by_room[rest].append(b)
    return bins, places, fills


def pack_ranges(counts: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, ...]]:
    """Best fit decreasing of many equal items at once.

    From (task, fill, count), rows (task, fill, rank, n, per, at, bin, to_fill, to_rank) as in _PLAN; tasks of equal
    fill come in order.  The bins are those that best_fit() makes of the single items, up to their order.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # by room, ranges (first bin, bins)
    rooms: list[int] = []
    rows: list[list[int]] = []
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((first, n))

    for task, fill, left in sorted(counts, key=lambda x: (-x[1], x[0])):
        rank = 0
        while left:
            k = bisect_left(rooms, fill)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(k)
            else:
                room, first, n = capacity, made, -(-left // (capacity // fill))
                made += n
            # best fit fills one bin with equal items before it takes the next
            per = room // fill
            whole = min(n, left // per)
            if whole:
                rows.append([task, fill, rank, whole * per, per, capacity - room, first])
                put(room - per * fill, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if whole < n and left:
                rows.append([task, fill, rank, left, left, capacity - room, first + whole])
                put(room - left * fill, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            if whole < n:
                put(room, first + whole, n - whole)
    # a bin's final fill and its rank among the bins of that fill
    ends = sorted((first, n, capacity - room) for room, ranges in open_bins.items() for first, n in ranges)
    ranks: dict[int, int] = {}
    starts, named = [], []
    for first, n, fill in ends:
        starts.append(first)
        named.append((first + n, fill, ranks.get(fill, 0)))
        ranks[fill] = ranks.get(fill, 0) + n
    out = []
    for task, fill, rank, n, per, at, bin_ in rows:
        while n:
            k = bisect_right(starts, bin_) - 1
            stop, to_fill, to_rank = named[k]
            bins = min(-(-n // per), stop - bin_)
            part = min(n, bins * per)
            out.append((task, fill, rank, part, per, at, bin_, to_fill, to_rank + bin_ - starts[k]))
            rank, n, bin_ = rank + part, n - part, bin_ + bins
    return out


def pack(
    docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end: int = 1, nearly: float = 0.995, fan_in: int = 8,
    chunk: int = 200_000,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row's token ids.

    A document's ids end with `end`; a null or empty text has only that one.  Documents of more than `capacity`
    ids are cut into pieces of that length.  Repeated rows are packed once for each row.
    """
    spark, full = docs.sparkSession, int(capacity * nearly)

    def tokenize(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        cache, task, made = WordCache(tokenizer), TaskContext.get().partitionId(), 0
        tail = end.to_bytes(4, "little")
        rows: list[list] = []
        ranks = [0] * (capacity + 1)  # underfull bins so far, by fill

        def flush():
            nonlocal made
            rows.sort(key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[4]))
            bins, places, fills = best_fit([r[3] for r in rows], capacity)
            base = (task << 34) + made
            made += len(fills)
            rank: list[int | None] = []
            for f in fills:
                rank.append(ranks[f] if f < full else None)
                ranks[f] += 1
            cols = list(zip(*rows))
            out = [
                pa.array([task] * len(rows), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array([base + b for b in bins], pa.int64()),
                pa.array(places, pa.int64()), pa.array([fills[b] for b in bins], pa.int32()),
                pa.array([rank[b] for b in bins], pa.int64()),
            ]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in _PIECES.split(", ")])

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), binary(batch, "text")
            for at in range(0, len(ids), 256):
                for doc, got in zip(ids[at : at + 256], cache.encode(texts[at : at + 256])):
                    got += tail
                    for k, start in enumerate(range(0, len(got), 4 * capacity)):
                        part = got[start : start + 4 * capacity]
                        rows.append([doc, k, start // 4, len(part) // 4, zlib.crc32(part)])
            if len(rows) >= chunk:
                yield flush()
        if rows:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stash(texts.mapInArrow(tokenize, _PIECES), "pack-pieces")
    tasks = (pieces.agg(F.max("task")).first()[0] or 0) + 1
    under = pieces.where("rank is not null")
    counts = under.groupBy("task", "fill").agg((F.max("rank") + 1).alias("n"))
    # each underfull bin, where it is now: a bin of (task, fill, rank), at its place in it
    now = under.select("bin", "task", "fill", "rank").distinct().withColumn("at", F.lit(0).cast("long"))
    done, level = None, 0
    while True:
        tasks, level = -(-tasks // fan_in), level + 1
        plan = stash(_round(counts, capacity, fan_in), "pack-plan")
        item = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")
        of = F.floor(F.col("i") / F.col("per"))
        moves = plan.select("*", item).select(
            "task", "fill", (F.col("rank") + F.col("i")).alias("rank"), "group", "to_fill", (F.col("to_rank") + of).alias("to_rank"),
            (F.col("at") + F.pmod("i", F.col("per").cast("long")) * F.col("fill")).alias("up"),
            (F.lit(level).cast("long") * (1 << 58) + F.col("group").cast("long") * (1 << 34) + F.col("bin") + of).alias("sequence"),
        )
        now = stash(
            now.join(moves, ["task", "fill", "rank"]).select(
                "bin", F.col("group").alias("task"), F.col("to_fill").alias("fill"), F.col("to_rank").alias("rank"),
                (F.col("at") + F.col("up")).cast("long").alias("at"), "sequence",
            ),
            "pack-round",
        )
        last = tasks == 1
        ended = (now if last else now.where(F.col("fill") >= full)).select("bin", "sequence", "at")
        done = ended if done is None else done.union(ended)
        if last:
            break
        bins = plan.where(F.col("to_fill") < full).groupBy(F.col("group").alias("task"), F.col("to_fill").alias("fill"))
        counts = bins.agg(F.max(F.col("to_rank") + F.ceil(F.col("n") / F.col("per"))).alias("n"))
        now = now.where(F.col("fill") < full).drop("sequence")
    return pieces.join(done, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("at", F.lit(0))).alias("offset"),
    )


def _round(counts: DataFrame, capacity: int, fan_in: int) -> DataFrame:
    """The plan of a round, for each group of `fan_in` tasks, from counts by task and fill."""

    def merge(pdf):
        import pandas as pd

        rows = pack_ranges(list(zip(pdf["task"].tolist(), pdf["fill"].tolist(), pdf["n"].tolist())), capacity)
        out = pd.DataFrame(rows, columns=["task", "fill", "rank", "n", "per", "at", "bin", "to_fill", "to_rank"])
        out.insert(0, "group", int(pdf["group"].iloc[0]))
        return out

    group = F.floor(F.col("task") / fan_in).cast("int")
    return counts.withColumn("group", group).groupBy("group").applyInPandas(merge, _PLAN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents packed into sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())
