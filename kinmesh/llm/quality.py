"""Quality rules: base counts, and a hashed word and character n-gram logistic regression.

The model is trained on labelled quality rows, calibrated by Platt's method on rows that training did not
see, and scored in Arrow batches.  It reads whole texts; features are the shares of hashed word unigrams and
bigrams and of hashed character 3-, 4- and 5-grams (of code points), so a text's length does not matter to them.
Bigrams of one word twice share a slot, as repetition tells more than the word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, table

_SYMBOL = re.compile(rb"[#*$%&|<>]")
_U = np.uint64
_PRIMES = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


@dataclass(frozen=True)
class QualityRules:
    """Fixed thresholds of the verdict."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_score: float = 0.5


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(_SYMBOL.findall(joined))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup += 1
            seen.add(line)
    return n, chars, symbols, dup, repeat_words(words) if n > 3 else 0


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    v = len(ids)
    if v < 2_000_000:  # v^3 fits in 63 bits
        key = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:  # pairs first, as numbers
        pair = np.unique(a[:-2] * v + a[1:-1], return_inverse=True)[1].astype(np.int64)
        key = np.unique(pair * v + a[2:], return_inverse=True)[1]
    order = np.sort(key)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    twice = np.flatnonzero(np.isin(key, order[1:][same]))
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[twice + k] = True
    return int(hit.sum())


def code_points(text: bytes) -> np.ndarray:
    """The text's characters as numbers."""
    if text.isascii():
        return np.frombuffer(text, np.uint8).astype(np.uint32)
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_slots(parts: list[np.ndarray], bits: int, own: list[int] | None = None):
    """Hashed n-grams of many texts at once: yields (slots, text of each slot) for each kind of gram.

    With `own`, only grams that begin in the first own[k] characters of part k count; the rest is there to end them.
    """
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    if not size.sum():
        return
    raw = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), size)
    start_of = np.cumsum(size) - size
    counts = np.ones(len(raw), bool) if own is None else np.arange(len(raw)) - start_of[owner] < np.array(own)[owner]
    wide = raw.astype(np.uint64)
    h = wide * _PRIMES[0]
    for n in (2, 3, 4, 5):
        if len(raw) < n:
            break
        h = (h[: len(raw) - n + 1] ^ (wide[n - 1 :] + _U(n))) * _PRIMES[n - 1]
        if n > 2:
            inside = (owner[: len(h)] == owner[n - 1 :]) & counts[: len(h)]
            yield (h >> _U(64 - bits)).astype(np.int32)[inside], owner[: len(h)][inside]
    # words: a hash of what stands between blanks or the ends of parts, by differences of a running sum
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.zeros(len(raw), bool)
    first[start_of[size > 0]] = True
    begins = np.flatnonzero(~blank & (first | np.concatenate([[True], blank[:-1]])))
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:] | first[1:], [True]])) + 1
    mixed = (wide + _U(7)) * _PRIMES[1]
    mixed ^= mixed >> _U(29)
    mixed *= _PRIMES[2]
    at = np.zeros(len(raw), np.int64)
    at[begins] = begins
    place = (np.arange(len(raw)) - np.maximum.accumulate(at)).astype(np.uint64)
    total = np.concatenate([[_U(0)], np.cumsum(mixed * (place * _U(2) + _U(1)), dtype=np.uint64)])
    w = (total[ends] - total[begins]) * _PRIMES[3]
    whose, mine = owner[begins], counts[begins]
    yield (w >> _U(64 - bits)).astype(np.int32)[mine], whose[mine]
    # a word that comes twice in a row is one gram, whatever the word
    pair = np.where(w[:-1] == w[1:], _U(0), (w[:-1] ^ (w[1:] >> _U(7))) * _PRIMES[4])
    same = (whose[1:] == whose[:-1]) & mine[:-1]
    yield (pair >> _U(64 - bits)).astype(np.int32)[same], whose[1:][same]


_KINDS = 5
#: At most so many labelled rows train the model, none of them with more bytes than this.
TRAIN_ROWS, TRAIN_BYTES = 3000, 1 << 18
_BLANK = re.compile(rb"[\x20\x09-\x0D]+")


def pieces(texts: list[bytes], most: int = 1 << 20):
    """Texts in groups of about `most` bytes, so that memory is bounded: (parts, index of each part's text, own).

    A longer text is cut after blanks.  A piece goes on beyond its cut to the end of the next word, or for `most` bytes
    if that word does not end, so grams that begin before the cut are whole; `own` says how many characters are before
    the cut.  Words of more than `most` bytes are cut as well, after that many bytes.
    """
    group, index, own, n = [], [], [], 0
    for k, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = len(t) if len(t) - at <= most else t.rfind(b" ", at + 1, at + most) + 1 or at + most
            while end < len(t) and t[end] & 0xC0 == 0x80:  # not within a character
                end += 1
            more = end
            if end < len(t):
                word = _BLANK.search(t, min(len(t), end + 5 * 4), min(len(t), end + most))
                more = word.start() if word else min(len(t), end + most)
                while more < len(t) and t[more] & 0xC0 == 0x80:
                    more += 1
            points = code_points(t[at:more])
            group.append(points)
            own.append(len(points) if more == end else len(code_points(t[at:end])))
            index.append(k)
            n, at = n + more - at, end
            if n >= most:
                yield group, index, own
                group, index, own, n = [], [], [], 0
    if group:
        yield group, index, own


def sums_of(texts: list[bytes], weights: np.ndarray, bits: int, most: int = 1 << 20) -> np.ndarray:
    """For each text, the mean weight of its grams of each kind, summed over kinds."""
    total, count = np.zeros((_KINDS, len(texts))), np.zeros((_KINDS, len(texts)))
    for group, index, own in pieces(texts, most):
        where = np.array(index)
        for kind, (slots, owner) in enumerate(gram_slots(group, bits, own)):
            np.add.at(total[kind], where, np.bincount(owner, weights[kind][slots], len(group)))
            np.add.at(count[kind], where, np.bincount(owner, minlength=len(group)))
    return (total / np.maximum(count, 1)).sum(0)


@dataclass
class QualityModel:
    weights: np.ndarray  # kinds x slots
    bits: int
    bias: float
    slope: float  # Platt's
    offset: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        margin = sums_of(texts, self.weights, self.bits) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def train(texts: list[bytes], labels: list[int], *, bits: int = 16, rounds: int = 30, l2: float = 1e-3, rare: float = 1e-3) -> QualityModel:
    """Fit on four fifths of the rows, calibrate on the rest.  Without rows of both labels every score is the base rate."""
    y = np.array(labels, float)
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return QualityModel(np.zeros((_KINDS, 1 << bits), np.float32), bits, 0.0, 0.0, float(np.log(rate / (1 - rate))))
    # sparse rows: (row, kind * slots + slot, share)
    rows, cols, vals = [], [], []
    for at in range(0, len(texts), 64):
        part = [code_points(t) for t in texts[at : at + 64]]
        for kind, (slots, owner) in enumerate(gram_slots(part, bits)):
            key, n = np.unique(owner.astype(np.int64) << bits | slots, return_counts=True)
            own = key >> bits
            rows.append((own + at).astype(np.int32))
            cols.append(((key & ((1 << bits) - 1)) + (kind << bits)).astype(np.int32))
            vals.append((n / np.maximum(np.bincount(own, n, len(part)), 1)[own]).astype(np.float32))
    rows = np.concatenate(rows)  # one after the other, so that no two lists and their arrays are held at once
    cols = np.concatenate(cols)
    vals = np.concatenate(vals)
    # shares are scaled by each slot's spread, so that grams other than the commonest count; `rare` keeps the rarest down
    scale = 1 / np.sqrt(np.bincount(cols, vals**2, _KINDS << bits) / len(y) + rare)
    vals *= scale[cols].astype(np.float32)
    held = np.arange(len(y)) % 5 == 4
    # rows that calibrate have no cost, so they need no second copy of the features
    cost = np.where(y > 0, 0.5 / max(y[~held].mean(), 1e-3), 0.5 / max(1 - y[~held].mean(), 1e-3)) * ~held
    cost /= cost.sum()

    def forward(w):
        return np.bincount(rows, vals * w.astype(np.float32)[cols], len(y))

    def back(g):
        return np.bincount(cols, vals * g.astype(np.float32)[rows], _KINDS << bits)

    x = back(cost)
    for _ in range(4):  # the steepest curvature, by power iteration
        x /= np.linalg.norm(x) + 1e-12
        x = back(cost * forward(x))
    step = 1 / (0.25 * (1.2 * np.linalg.norm(x) + 1) + l2)
    w, b = np.zeros(_KINDS << bits), 0.0
    v, vb = w, b
    for t in range(rounds):  # accelerated gradient descent on the whole set
        g = cost * (1 / (1 + np.exp(-np.clip(forward(v) + vb, -40, 40))) - y)
        w, old, b, old_b = v - step * (back(g) + l2 * v), w, vb - step * g.sum(), b
        v, vb = w + t / (t + 3) * (w - old), b + t / (t + 3) * (b - old_b)
    margin = forward(w) + b
    use = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    slope, offset = platt(margin[use], y[use])
    return QualityModel((w * scale).reshape(_KINDS, -1).astype(np.float32), bits, float(b), slope, offset)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and offset of the logistic curve that fits best, with Platt's smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    a = np.array([0.0, np.log((up + 1) / (down + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        a = a - np.clip(np.linalg.solve(h, x.T @ (p - goal) + 1e-6 * a), -2, 2)
    return float(max(a[0], 0.0)), float(a[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> list[tuple[bytes, int]]:
    """The texts and labels of `most` labelled ids at most, those of the smallest hashes, without rows of over TRAIN_BYTES."""
    marked = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(column).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(
        F.broadcast(marked), "doc_id"
    )
    got = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_BYTES).select("doc_id", "text", "label").collect()
    got.sort(key=lambda x: (x[0], bytes(x[1] or b"")))
    return [(bytes(x[1] or b""), int(x[2] > 0)) for x in got]


def quality(docs: DataFrame, model: QualityModel, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, the base counts, score, base_failed and kept of every row.

    A null or empty text has no words: all counts 0, base_failed.  Repeated rows come out once for each row.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            texts = binary(batch, "text")
            counts = [base_counts(t) for t in texts]
            columns = [pa.array(x, pa.int64()) for x in zip(*counts)] if counts else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(held.value.scores(texts), pa.float64())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
            )

    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(
            score,
            "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double",
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= rules.min_score))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: base counts and the verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", TRAIN_ROWS)
    return quality(docs, train([t for t, _ in sample], [y for _, y in sample]))
