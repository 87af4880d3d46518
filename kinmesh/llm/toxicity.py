"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel, with Nystroem landmarks.

The kernel compares two segments (a word, or a window of a long one, with marks at its ends) by the character
triples that they share as subsequences, gaps allowed: a triple that spans b + 1 characters weighs LAMBDA ** b, so
"id.iot" and "idioot" stay close to "idiot".  It is divided by a norm that depends on the lengths.  A sentence is as
toxic as its worst segment and a document as its worst sentence, so one clear insult is enough, however long the text,
and more of them do not count against it.  The unit of the machine is the word: abuse in words that are each harmless
is not learned.

Training rows are the sentences of labelled documents, so most segments of a toxic document are harmless: the machine
is trained in rounds, in which the worst segments of toxic documents stand for them and the worst segments of clean
documents are added as negatives.  A segment stands for toxic documents at first only if several of them have it and
clean ones hardly do, and later also if the machine finds it close to such ones.  Landmarks are segments of both kinds;
the machine is linear in the Nystroem features K(x, landmarks) K_mm^(-1/2).  As the kernel is an inner product of
triple weights, the trained machine folds into one table of weights by hashed triple, and scoring a segment costs its
triples only.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, table
from .quality import platt

LAMBDA, REACH, BITS, WINDOW = 0.75, 5, 20, 16
_GAPS = [(a, b) for b in range(2, REACH + 1) for a in range(1, b)]
#: Single characters with blanks between them, read as one word.
_SPACED = re.compile(rb"(?:(?<=\s)|^)[^\s](?: [^\s]){3,}(?=\s|$)")
#: What may be put between the characters of a word to disguise it.
_MARKS = re.compile(r"[.*_~`'+|#$%&-]+")
_DOUBLED = re.compile(r"(.)\1+")
_SENTENCE = re.compile(rb"[.!?\n]+")
_FLOOR = -3.0
#: A segment with this margin is like one that is known.
CLOSE = 0.3

#: At most so many labelled rows of each label train the machine, none of them with more bytes than the last.
TRAIN_ROWS, TRAIN_BYTES, LANDMARKS = 2500, 1 << 17, 240


def segments(word: str) -> list[str]:
    """The word in lower case with end marks, or windows of a long one; also without marks within it, and without doubled
    characters, if it has any."""
    bare = word.lower().strip("!?.,;:|#*$%&<>()[]{}\"'-_~`=+/\\ ")
    out = []
    plain = _MARKS.sub("", bare)
    for x in dict.fromkeys((bare, plain, _DOUBLED.sub(r"\1", plain))):
        w = "^" + x + "$"
        out += [w] if len(w) <= WINDOW else [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)]
    return out


def triples(parts: list[str]):
    """(hashed triples, segment, weight) for each gap; the weights include the norm."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(parts)), size)
    norm = np.sqrt(sum(LAMBDA ** (2 * b) * np.maximum(size - b, 0) for _, b in _GAPS))
    scale = 1 / np.maximum(norm, LAMBDA**2)
    first = c * np.uint64(0x9E3779B97F4A7C15)
    for a, b in _GAPS:
        if len(c) <= b:
            continue
        n = len(c) - b
        inside = np.flatnonzero(owner[:n] == owner[b:])
        h = (first[inside] ^ c[inside + a]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(31)) ^ c[inside + b]) * np.uint64(0xD6E8FEB86659FD93)
        own = owner[inside]
        yield (h >> np.uint64(64 - BITS)).astype(np.int64), own, LAMBDA**b * scale[own]


def apply_table(parts: list[str], weights: np.ndarray) -> np.ndarray:
    """The weighted sum of each segment's triples."""
    out = np.zeros(len(parts))
    for at in range(0, len(parts), 10_000):
        part = parts[at : at + 10_000]
        for h, own, w in triples(part):
            out[at : at + len(part)] += np.bincount(own, w * weights[h], len(part))
    return out


def features(parts: list[str]) -> list[dict[int, float]]:
    out: list[dict[int, float]] = [{} for _ in parts]
    for h, own, w in triples(parts):
        for k, i, x in zip(h.tolist(), own.tolist(), w.tolist()):
            out[i][k] = out[i].get(k, 0.0) + x
    return out


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by hashed triple
    bias: float
    slope: float  # Platt's, of the worst margin
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's margin of each word, that of its worst segment."""
        split = [segments(w) for w in words]
        flat = apply_table([s for x in split for s in x], self.weights) + self.bias
        out = np.full(len(words), _FLOOR)
        np.maximum.at(out, np.repeat(np.arange(len(words)), [len(x) for x in split]), flat)
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        """From the margin of each text's worst word."""
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -40, 40)))


class Scorer:
    """Margins of texts; a word's margin is kept, for `most` words at a time."""

    def __init__(self, model: ToxicityModel, most: int = 500_000):
        self.model, self.most, self.known = model, most, {}

    def worst(self, texts: list[bytes]) -> np.ndarray:
        """The margin of each text's worst word, the floor without words."""
        split = [set(words_of(t)) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        self.known.update(zip(new, self.model.margins([w.decode() for w in new]).tolist()))
        return np.array([max(map(self.known.__getitem__, words), default=_FLOOR) for words in split])


def words_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    for m in _SPACED.finditer(text):
        words.append(m.group().replace(b" ", b"").lower())
    return words


def svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Squared hinge, by Newton steps."""
    x = np.concatenate([z, np.ones((len(z), 1))], 1)
    a = np.zeros(x.shape[1])
    reg = np.full(len(a), l2 * cost.sum())
    reg[-1] = 1e-6
    for _ in range(30):
        slack = 1 - y * (x @ a)
        on = slack > 0
        xo, co = x[on], cost[on]
        g = reg * a - xo.T @ (co * y[on] * slack[on])
        step = np.linalg.solve(xo.T @ (xo * co[:, None]) + np.diag(reg), g)
        a = a - step
        if np.abs(step).max() < 1e-6:
            break
    return a


def fit_table(landmarks: list[str], good: list[str], bad: list[str], cost: np.ndarray) -> tuple[np.ndarray, float]:
    """The machine as weights by hashed triple, and its bias."""
    phi = features(landmarks)
    used = {h: k for k, h in enumerate(sorted({h for f in phi for h in f}))}
    p = np.zeros((len(landmarks), len(used)))
    for i, f in enumerate(phi):
        for h, x in f.items():
            p[i, used[h]] = x
    slot = np.full(1 << BITS, -1, np.int32)
    slot[list(used)] = list(used.values())
    values, vectors = np.linalg.eigh(p @ p.T)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    rows = good + bad
    k = np.zeros((len(rows), len(landmarks)))
    for at in range(0, len(rows), 400):
        part = rows[at : at + 400]
        x = np.zeros((len(part), len(used)), np.float32)
        for h, own, w in triples(part):
            s = slot[h]
            np.add.at(x, (own[s >= 0], s[s >= 0]), w[s >= 0])
        k[at : at + len(part)] = x @ p.T
    y = np.concatenate([-np.ones(len(good)), np.ones(len(bad))])
    a = svm(k @ root, y, cost)
    out = np.zeros(1 << BITS, np.float32)
    out[list(used)] = (p.T @ (root @ a[:-1]))[list(used.values())]
    return out, float(a[-1])


def train(texts: list[bytes], labels: list[int], rounds: int = 3) -> ToxicityModel:
    """Fit on four fifths of the rows, calibrate on the rest.  Without rows of both labels every score is the base rate."""
    y = np.array(labels, int)
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    bags, parted = [], {}
    shared: dict[str, str] = {}  # texts have most segments in common
    for t in texts:
        words = {w for part in _SENTENCE.split(t) for w in words_of(part)}
        for w in words.difference(parted):
            parted[w] = [shared.setdefault(s, s) for s in segments(w.decode())]
        bags.append(sorted({s for w in words for s in parted[w]}))
    del parted, shared
    fold = np.arange(len(y)) % 5 == 4
    toxic, clean = np.flatnonzero((y > 0) & ~fold), np.flatnonzero((y == 0) & ~fold)
    in_toxic, in_clean = Counter(s for i in toxic for s in bags[i]), Counter(s for i in clean for s in bags[i])

    def odds(s: str) -> float:
        return np.log((in_toxic[s] + 0.1) / (len(toxic) + 1)) - np.log((in_clean[s] + 1) / (len(clean) + 1)) + 0.5 * np.log(min(in_toxic[s], 50) + 0.1)

    score = {s: odds(s) for s in in_toxic}
    # several toxic documents have it, clean ones hardly: what chance alone hardly does
    least = max(round(0.02 * len(toxic)), min(4, 1 + len(toxic) // 8))
    known = {s for s, n in in_toxic.items() if n >= least and in_clean[s] * len(toxic) <= 0.1 * n * len(clean)}
    everyday = [s for s, _ in in_clean.most_common(4000)]
    rare = sorted(in_clean, key=lambda s: hash_of(s))[:6000]
    hard: list[str] = []
    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    for k in range(rounds):
        # with those of a document's two worst segments that the machine finds close to known ones
        near = Counter(s for i in toxic if k for s in sorted(bags[i], key=lambda s: (-score[s], s))[:2] if score[s] > CLOSE)
        near = {s: n for s, n in near.items() if s not in known and in_clean[s] * len(toxic) <= 0.1 * in_toxic[s] * len(clean)}
        worst = Counter({s: in_toxic[s] for s in known} | near)
        bad = [s for s, _ in worst.most_common(1500)]
        if not bad:
            break
        n = np.array([worst[s] for s in bad], float)
        gapped = [v for s in bad[:80] if len(s) > 5 for v in disguised(s)]
        good = list(dict.fromkeys([*everyday, *rare, *hard]))
        good = [s for s in good if s not in worst or in_clean[s] > 0]
        cost = np.concatenate([np.full(len(good), 1 / len(good)), n / n.sum(), np.full(len(gapped), 1.0 / max(len(gapped), 1))])
        landmarks = list(dict.fromkeys([*bad[: LANDMARKS // 3], *gapped[: LANDMARKS // 3], *hard[: LANDMARKS // 4], *everyday]))[:LANDMARKS]
        weights, bias = fit_table(landmarks, good, bad + gapped, cost)
        names = list(in_toxic)
        score = dict(zip(names, (apply_table(names, weights) + bias).tolist()))
        names = list(in_clean)
        margin = apply_table(names, weights) + bias
        hard = list(dict.fromkeys([*(names[i] for i in np.argsort(-margin)[:1500]), *hard]))
    model = ToxicityModel(weights, bias, 0.0, 0.0)
    held = np.flatnonzero(fold) if len(set(y[fold])) == 2 else np.arange(len(y))
    model.slope, model.offset = platt(Scorer(model).worst([texts[i] for i in held]), y[held])
    return model


def disguised(s: str) -> list[str]:
    """A segment with a character put in or doubled, at three places."""
    places = sorted({2, len(s) // 2, len(s) - 2})
    return [s[:i] + c + s[i:] for i in places for c in (".*-"[i % 3], s[i - 1])]


def hash_of(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def train_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[list[bytes], list[int], float]:
    """Texts and labels of at most `most` ids of each label, by hash of the id, and the share of toxic labels.

    Only ids whose crc32, as text, is not divisible by 5 are looked at.
    """
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("label"))
    )
    by = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    one, zero = (marked.where(F.col("label") == k).orderBy(order, "doc_id").limit(most) for k in (1, 0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_BYTES).join(F.broadcast(one.union(zero)), "doc_id").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.text or b"")))
    return [bytes(r.text or b"") for r in rows], [r.label for r in rows], by.get(1, 0) / max(1, sum(by.values()))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return train(*train_sample(docs, labels)[:2])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and predicted (1 if score >= 0.5) of every row; null and empty texts have the lowest margin.

    Rows with equal texts score alike, repeated rows come out once for each row, and words of equal margin make no
    difference.  A very long text is split into its words as a whole; its distinct words are held at once.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        import pyarrow as pa

        scorer = Scorer(held.value)
        for batch in batches:
            texts = binary(batch, "text")
            worst = [scorer.worst(texts[at : at + 512]) for at in range(0, len(texts), 512)]
            p = held.value.probability(np.concatenate([np.zeros(0), *worst]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows whose texts score below the threshold, with all their columns as they were."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        import pyarrow as pa

        scorer = Scorer(held.value)
        for batch in batches:
            texts = binary(batch, "text")
            worst = [scorer.worst(texts[at : at + 512]) for at in range(0, len(texts), 512)]
            yield batch.filter(pa.array(held.value.probability(np.concatenate([np.zeros(0), *worst])) < threshold))

    return docs.mapInArrow(scan, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: toxicity of every document; rows whose crc32 of doc_id is divisible by 5 are held out.

    So are rows without a doc_id, which are never learned from.
    """
    docs = table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)))
