"""Embedding, components, skewed joins, indexes, model matchers and splits against plain Python."""

import random
import sys
import types
import zlib

import numpy as np
import pytest

from kinmesh import LabeledPairs, Source, ports
from kinmesh.functions.embedders import HashedNGramEmbedder, SentenceTransformerEmbedder
from kinmesh.operators import index as indexes
from kinmesh.operators import knn, skew
from kinmesh.operators.blocking import DenseBlocker
from kinmesh.operators.clustering import ConnectedComponentsClusterer, smallest_reachable
from kinmesh.operators.linker import decide
from kinmesh.operators.matching import EditDistanceMatcher, RetryPolicy, SimilarityThresholdFilter, StructuredModelMatcher, ThresholdMatcher
from kinmesh.operators.metrics import LinkageMetrics, ThresholdSweep
from kinmesh.sources import records


def plain_vector(text, n, dim):
    out, low = np.zeros(dim), text.lower()
    if low.strip():
        for i in range(max(1, len(low) - n + 1)):
            out[zlib.crc32(low[i : i + n].encode("utf-8", "surrogatepass")) % dim] += 1
        out /= np.linalg.norm(out)
    return out


@pytest.mark.parametrize("n,dim", [(3, 256), (1, 7), (5, 1024)])
def test_hashed_ngrams(n, dim):
    rng = random.Random(1)
    texts = ["", " \t", "a", "ab", "Äpfel", "x\ud800y", "日本語のテキスト", "\U0001f600 ok", "İstanbul", "same", "same"]
    texts += ["".join(rng.choice("ab é日\U0001f600") for _ in range(rng.randrange(60))) for _ in range(200)]
    got = HashedNGramEmbedder(dim, n).encode(texts)
    assert got.dtype == np.float32 and np.allclose(got, [plain_vector(t, n, dim) for t in texts], atol=1e-6)


def test_components_small_and_large(spark):
    rng = random.Random(2)
    edges = [(f"n{a}", f"n{b}") for a, b in ((i + 1, i) for i in range(40))] + [("hub", f"h{i}") for i in range(300)]
    edges += [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(60)] + [("s", "s")]
    df = spark.createDataFrame(edges, "a string, b string")
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(root.setdefault(a, a)), find(root.setdefault(b, b))))
            root[y] = x
    want = {x: find(x) for x in root}
    assert dict(smallest_reachable(df).collect()) == want
    assert dict(smallest_reachable(df, small=0).collect()) == want
    assert smallest_reachable(df.limit(0)).count() == 0


def test_hot_keys_and_bitmaps(spark):
    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(120)] + [(-1, -1)], "key long, v long")
    side = rows.where("key >= 0").groupBy("key").count().withColumnRenamed("count", "n")
    plain = sorted(map(tuple, rows.join(side, "key").collect()))
    for least in (5, 10_000):
        assert sorted(map(tuple, skew.join_hot(rows, side, ["key"], least=least).select("key", "v", "n").collect())) == plain
    left = sorted(map(tuple, skew.join_hot(rows, side, ["key"], least=5, how="left").select("key", "v", "n").collect()))
    assert len(left) == 121 and left[0] == (-1, -1, None)
    keys = spark.createDataFrame([(k,) for k in range(90, 100)], "key long")
    hit = {r.v for r in skew.within(rows, skew.key_bitmap(keys, ["key"]), ["key"]).where("__within").collect()}
    assert set(range(90, 100)) <= hit and len(hit) < 14
    assert not skew.within(rows, skew.key_bitmap(keys.limit(0), ["key"]), ["key"]).where("__within").count()


def plain_top(q, m, k, least):
    s = [(-round(float(np.dot(m[j].astype(float), q.astype(float))), 9), j) for j in range(len(m))]
    return [(j, -x) for x, j in sorted(s) if least is None or -x >= least][:k]


def test_top_k_with_copies_and_blanks():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 8)).astype(np.float32)
    m[10:40] = m[3]
    m[50] = 0
    queries = np.concatenate([m[[3, 10, 50, 59]], rng.normal(size=(5, 8)).astype(np.float32)])
    for k in (1, 4, 100):
        for least in (None, 0.0, 0.5):
            for q, (rows, score) in zip(queries, knn.top_k(queries, knn.Rows(m), k, least)):
                assert list(zip(rows.tolist(), score.tolist())) == [(j, pytest.approx(s)) for j, s in plain_top(q, m, k, least)]


class FakeFaiss(types.ModuleType):
    class IndexFlatIP:
        def __init__(self, d):
            self.d, self.rows = d, np.zeros((0, d), np.float32)

        def add(self, x):
            self.rows = np.concatenate([self.rows, x])

        def search(self, q, k):
            s = q @ self.rows.T
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            return np.take_along_axis(s, best, 1), best


def test_indexes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(30, 4)).astype(np.float32)
    df = spark.createDataFrame([(f"i{k:02}", k, v.tolist()) for k, v in enumerate(m)], "id string, pos long, vector array<float>")
    flat = indexes.FlatIndex().build(df, 4)
    assert isinstance(flat, ports.SearchableIndex) and isinstance(indexes.FlatIndex(), ports.VectorIndex)
    got = sorted(map(tuple, flat.search(df, top_k=3).select("right_pos", "rank", "left_id").collect()))
    assert [int(x[2][1:]) for x in got] == [j for q in m for j, _ in plain_top(q, m, 3, None)]
    assert flat.ids.count() == 30 and flat.vectors.columns == ["id", "pos", "vector"]
    more = flat.extended(spark.createDataFrame([("j", 30, [9.0, 9.0, 9.0, 9.0])], df.schema))
    assert more.n == 31 and flat.n == 30
    with pytest.raises(ValueError):
        flat.extended(df)
    with pytest.raises(ImportError):
        indexes.FaissFlatIndex()
    monkeypatch.setitem(sys.modules, "faiss", FakeFaiss("faiss"))
    for least in (None, 0.2):
        for q, (rows, score) in zip(m, indexes.faiss_top_k(m, knn.Rows(m), 3, least)):
            assert list(zip(rows.tolist(), score.tolist())) == [(j, pytest.approx(s)) for j, s in plain_top(q, m, 3, least)]
    blocker = DenseBlocker(embedder=HashedNGramEmbedder(), index=indexes.FlatIndex("blocks"))
    built = blocker.build(records.read_records(Source(spark.createDataFrame([(1, "ab cd"), (2, "ab ce")], "id long, t string"), "id")))
    assert isinstance(blocker, ports.Blocker) and isinstance(built, ports.BlockingIndex) and built.searchable.spec.strategy == "blocks"
    for part, port in ((ThresholdMatcher(), ports.Matcher), (SimilarityThresholdFilter(), ports.Filter), (ConnectedComponentsClusterer(), ports.Clusterer), (HashedNGramEmbedder(), ports.Embedder)):
        assert isinstance(part, port)


def test_structured_model(spark):
    class FakeModel:
        """Fails for a prompt with 'bad' always, and with 'slow' the first time."""

        def __init__(self):
            self.calls = []

        def with_structured_output(self, schema):
            assert schema["required"] == ["is_match"]
            return self

        def batch(self, prompts, config, return_exceptions):
            assert return_exceptions and config["max_concurrency"] == 2 and len(prompts) <= 4
            first = not self.calls
            self.calls.append(prompts)
            out = []
            for p in prompts:
                if "bad" in p or ("slow" in p and first):
                    out.append(RuntimeError("no"))
                else:
                    out.append({"is_match": p[0] == p[-1], "confidence": 0.5, "rationale": f"call {len(self.calls)} of {len(prompts)}"})
            return out

    rows = [("1", "2", 0.5, "a", "a"), ("3", "4", None, "a", "b"), ("5", "6", 0.1, "slow", "s"), ("7", "8", 0.1, "bad", "b")]
    pairs = spark.createDataFrame(rows, "left_id string, right_id string, similarity double, left_text string, right_text string").coalesce(1)
    matcher = StructuredModelMatcher(llm=FakeModel(), prompt="{record_a}={record_b}", retry=RetryPolicy(max_retries=2), max_concurrency=2)
    got = {r.left_id: r for r in decide(pairs, matcher).outcomes.collect()}
    assert (got["1"].match, got["3"].match, got["5"].match, got["7"].match) == (True, False, True, None)
    assert got["1"].reason == "call 1 of 4" and got["5"].reason == "call 2 of 2" and "after 3 attempt(s): RuntimeError('no')" in got["7"].error
    with pytest.raises(ValueError):
        StructuredModelMatcher(llm=FakeModel(), prompt="{left}")


def test_difflib_against_python(spark):
    import difflib

    rows = [(str(k), str(k + 1), None, a, b) for k, (a, b) in enumerate([("Acme Corp", "ACME Corporation"), ("", "x"), (None, "x"), ("abc", "abc"), ("abcd", "dcba"), ("Ünited", "united ")])]
    pairs = spark.createDataFrame(rows, "left_id string, right_id string, similarity double, left_text string, right_text string")
    got = {r.left_id: r for r in EditDistanceMatcher(0.6).match(pairs).collect()}
    for k, _, _, a, b in rows:
        if not (a or "").strip():
            assert got[k].error and got[k].match is None
            continue
        ratio = difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
        assert got[k].confidence == pytest.approx(ratio) and got[k].match == (ratio >= 0.6)


def test_sentence_transformer_with_a_fake(monkeypatch):
    module = types.ModuleType("sentence_transformers")

    class Model:
        def __init__(self, name):
            self.name = name

        def get_sentence_embedding_dimension(self):
            return 2

        def encode(self, texts, **how):
            assert how["normalize_embeddings"] and how["batch_size"] == 7
            return [[len(t), 0.0] for t in texts]

    module.SentenceTransformer = Model
    monkeypatch.setitem(sys.modules, "sentence_transformers", module)
    e = SentenceTransformerEmbedder("tiny")
    assert e.embedding_dim == 2 and e.encode(["abc"], batch_size=7).tolist() == [[3.0, 0.0]] and e.encode(["abc"], batch_size=7).dtype == np.float32


def test_at_recall_takes_the_best_f1():
    row = lambda t, tp, fp, fn: (t, LinkageMetrics(tp, fp, fn, tp + fn, 0))
    sweep = ThresholdSweep((row(0.2, 9, 9, 1), row(0.4, 8, 0, 2), row(0.6, 7, 5, 3), row(0.8, 2, 0, 8)))
    assert sweep.at_recall(0.7)[0] == 0.4 and sweep.at_recall(0.85)[0] == 0.2 and sweep.best_f1()[0] == 0.4
    assert ThresholdSweep((row(0.1, 5, 5, 5), row(0.3, 5, 5, 5))).at_recall(0.5)[0] == 0.3
    with pytest.raises(ValueError):
        sweep.at_recall(0.95)


def test_split_is_a_seeded_shuffle(spark, monkeypatch):
    pairs = [(f"a{k}", f"b{k}") for k in range(21)]
    order = sorted(pairs)
    random.Random(7).shuffle(order)
    train, test = LabeledPairs.from_pairs(pairs, spark).split(test_size=0.5, seed=7)
    assert set(map(tuple, test.pairs.collect())) == set(order[:10]) and set(map(tuple, train.pairs.collect())) == set(order[10:])
    monkeypatch.setattr(records, "SHUFFLED", 0)
    train, test = LabeledPairs.from_pairs(pairs, spark).split(test_size=0.5, seed=7)
    assert (train.pairs.count(), test.pairs.count()) == (11, 10)


def test_dedupe_does_not_hang_on_partitions(spark):
    from kinmesh import DenseLinker

    rows = [(k, f"record number {k % 5} of them") for k in range(20)]
    df = spark.createDataFrame(rows, "id long, t string")
    one, other = (DenseLinker.with_defaults().dedupe(Source(x, "id")).to_frame() for x in (df.coalesce(1), df.repartition(7, "t")))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, other.collect()), key=repr)


def test_tiles_find_what_all_rows_do():
    rng = np.random.default_rng(8)
    centres = np.abs(rng.normal(size=(6, 24)))
    m = (centres[rng.integers(0, 6, 3000)] + 0.15 * rng.normal(size=(3000, 24))).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[100:300] = m[7]
    m[400] = 0
    queries = np.concatenate([m[::50], 3 * m[5:20], np.zeros((1, 24), np.float32), rng.normal(size=(5, 24)).astype(np.float32)])
    tiled = knn.Rows(m, 1000)
    assert tiled.tiles is not None and len(tiled.tiles[1]) > 6
    for least in (0.5, 0.95, 0.999):
        for (rows, score), (want, s) in zip(knn.top_k(queries, tiled, 5, least), knn.top_k(queries, knn.Rows(m), 5, least), strict=True):
            assert rows.tolist() == want.tolist() and score.tolist() == s.tolist()


def test_blocks_shuffle_no_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(900, 8)).astype(np.float32)
    df = spark.createDataFrame([(f"i{k:03}", k, v.tolist()) for k, v in enumerate(m)], "id string, pos long, vector array<float>")
    monkeypatch.setattr(knn, "BLOCK_BYTES", 100 * 8 * 4)
    monkeypatch.setattr(knn, "TILED", 50)
    for least in (None, 6.0):
        want = sorted(knn.knn_join(df, df, k=4, dim=8, threshold=least, strategy="broadcast").collect())
        got = knn.knn_join(df, df, k=4, dim=8, threshold=least, strategy="blocks")
        assert sorted(got.collect()) == want and want
        assert "CoGroup" not in got._jdf.queryExecution().toString()


def test_slices_find_what_a_plain_search_does(monkeypatch):
    rng = np.random.default_rng(7)
    for name, value in {"SLICED": 50, "ASKED": 40, "SLICE": 60, "GROUPS": 8, "CROWD": 25}.items():
        monkeypatch.setattr(knn, name, value)
    plain, alone = knn._plain_top_k, []
    monkeypatch.setattr(knn, "_plain_top_k", lambda queries, *a: alone.append(len(queries)) or plain(queries, *a))
    m = rng.normal(size=(400, 6)).astype(np.float32)
    m[::2] = np.round(m[::2])  # whole numbers tie
    m[5:400:40], m[150:160] = m[5], 0
    queries = np.concatenate([m[::3], rng.normal(size=(30, 6)).astype(np.float32), np.eye(6, dtype=np.float32), m[1:9] * np.float32(1e20)])
    rows = knn.Rows(m)
    for k in (1, 5, 30):
        for least in (None, -0.5, 0.0, 1.5):
            got = list(knn.top_k(queries, rows, k, least))
            for (row, score), (want, s) in zip(got, plain(queries, rows, k, least), strict=True):
                assert row.tolist() == want.tolist() and score.tolist() == s.tolist()
    assert 0 in alone and any(0 < n < 40 for n in alone)  # no query of a block is searched by itself, or some are


def test_own_vectors_of_one_file_are_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(knn, "PRODUCTS", 10_000, raising=False)
    rng = np.random.default_rng(8)
    rows = [(str(k), k, [float(x) for x in rng.normal(size=8)]) for k in range(200)]
    spark.createDataFrame(rows, "id string, pos long, vector array<float>").coalesce(1).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    assert knn._broadcast(df, df, 4, 8, 0.0, knn.top_k).rdd.getNumPartitions() == 4
    got = sorted(knn.knn_join(df, df, k=4, dim=8, threshold=0.0, strategy="broadcast").collect())
    assert got == sorted(knn.knn_join(df.select("*"), df, k=4, dim=8, threshold=0.0, strategy="broadcast").collect())
    assert got == sorted(knn.knn_join(df, df, k=4, dim=8, threshold=0.0, strategy="blocks").select(*got[0].__fields__).collect()) and len(got) > 700
