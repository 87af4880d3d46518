"""The engine on small tables with known results."""

import numpy as np
import pandas as pd
import pytest

import kinmesh as K
from kinmesh import errors as E
from kinmesh.functions.embedders import HashedNGramEmbedder
from kinmesh.functions.optional import require
from kinmesh.functions.text import FunctionSerializer
from kinmesh.operators import matching as X
from kinmesh.operators import metrics as M
from kinmesh.operators.blocking import DenseBlocker
from kinmesh.operators.clustering import ConnectedComponentsClusterer, connected_components, label_components
from kinmesh.operators.knn import knn_join
from kinmesh.operators.linker import DenseLinker, LinkageIndex
from kinmesh.sources.records import read_records

LEFT = pd.DataFrame({"id": ["A1", "A2", "A3"], "name": ["Apple Inc", "Microsoft Corp", "Google LLC"], "city": ["Cupertino", "Redmond", "Mountain View"]})
RIGHT = pd.DataFrame({"id": ["B1", "B2", "B3"], "name": ["Apple Incorporated", "Microsoft", "Google"], "city": ["Cupertino", "Redmond", "Mountain View"]})
NAME_CITY = K.TemplateSerializer("{name} — {city}")


def pairs_frame(spark, rows):
    """Candidate pairs of (left, right, similarity)."""
    return spark.createDataFrame([(a, b, s, a, b) for a, b, s in rows], "left_id string, right_id string, similarity double, left_text string, right_text string")


def result(spark, rows):
    """Outcomes of (left, right, match or error text)."""
    data = [(a, b, None, m if isinstance(m, bool) else None, None, None, m if isinstance(m, str) else None) for a, b, m in rows]
    return K.LinkageResult(spark.createDataFrame(data, "left_id string, right_id string, similarity double, match boolean, confidence double, reason string, error string"))


def gold(spark, pairs):
    return K.LabeledPairs.from_pairs(pairs, spark)


def test_quickstart(spark):
    for serializer in (NAME_CITY, None):
        got = DenseLinker.with_defaults().link(K.Source(LEFT, "id", serializer), K.Source(RIGHT, "id", serializer))
        rows = {(r.left_id, r.right_id): r for r in got.to_frame().collect()}
        assert len(rows) == 9 and got.errors.count() == 0
        assert got.to_frame().columns == ["left_id", "right_id", "similarity", "match", "confidence", "reason"]
    rows = {(r.left_id, r.right_id): r.similarity for r in got.to_frame().collect()}
    assert [round(rows[f"A{k}", f"B{k}"], 6) for k in (1, 2, 3)] == [0.762443, 0.833908, 0.864126]
    metrics = M.linkage_metrics(got, gold=gold(spark, [("A1", "B1"), ("A2", "B2"), ("A3", "B3")]))
    assert (metrics.precision, metrics.recall, metrics.f1, metrics.n_errors) == (1, 1, 1, 0)


def test_dedupe_three(spark):
    frame = pd.DataFrame({"id": [1, 2, 3], "name": ["Apple Inc", "Apple Incorporated", "Microsoft Corp"], "city": ["Cupertino", "Cupertino", "Redmond"]})
    got = DenseLinker.with_defaults().dedupe(K.Source(frame, "id", NAME_CITY))
    rows = got.to_frame().collect()
    assert {frozenset((r.left_id, r.right_id)) for r in rows if r.match} == {frozenset("12")}
    assert all(r.left_id != r.right_id for r in rows) and len({frozenset((r.left_id, r.right_id)) for r in rows}) == len(rows)
    clusters = connected_components(got)
    assert clusters.n_clusters == 2
    b3 = M.clustering_metrics(clusters, gold=gold(spark, [("1", "2")]))
    assert (b3.b3_precision, b3.b3_recall, b3.b3_f1, b3.n_clusters, b3.n_gold_clusters) == (1, 1, 1, 2, 2)


def test_record_checks(spark):
    with pytest.raises(E.UnknownIdColumn):
        read_records(K.Source(LEFT, "nope"))
    with pytest.raises(E.EmptySource):
        read_records(K.Source(spark.createDataFrame([], "id string"), "id"))
    with pytest.raises(E.DuplicateRecordId):
        read_records(K.Source(pd.DataFrame({"id": ["A1", "A1"]}), "id"))
    row = read_records(K.Source(pd.DataFrame({"id": [1], "name": ["Acme"]}), "id")).first()
    assert (row.id, row.text, row.fields.id) == ("1", "1 | Acme", 1)


def test_values_print_as_in_python(spark):
    values = [10000000.0, 0.0001, 1e-5, 1.5e16, 123456789.125, 0.5, -2.0, 1e22, float("nan"), float("inf"), 0.00012345, 12345678.9, None]
    df = spark.createDataFrame([(str(k), v, k % 2 == 0) for k, v in enumerate(values)], "id string, x double, b boolean")
    got = {r.id: r.text for r in read_records(K.Source(df, "id", K.FieldwiseSerializer(["x", "b"], "/"))).collect()}
    assert [got[str(k)] for k in range(len(values))] == [f"{v}/{k % 2 == 0}" for k, v in enumerate(values)]
    df = spark.sql("select 'a' id, timestamp'2020-01-02 03:04:05' t, timestamp'2020-01-02 03:04:05.5' u, date'2020-01-02' d, cast(null as int) n")
    assert read_records(K.Source(df, "id")).first().text == "a | 2020-01-02 03:04:05 | 2020-01-02 03:04:05.500000 | 2020-01-02 | None"


def test_serializers(spark):
    text = lambda s: read_records(K.Source(LEFT, "id", s)).orderBy("pos").first().text
    assert text(K.FieldwiseSerializer(["name", "gone", "city"])) == "Apple Inc |  | Cupertino"
    assert text(K.TemplateSerializer("{{x}} {title}", column_mapping={"name": "title", "gone": "y"})) == "{x} Apple Inc"
    assert text(K.TemplateSerializer("{name!r:>12}|{city:.3}")) == " 'Apple Inc'|Cup"
    assert text(FunctionSerializer(lambda r: r["name"].upper())) == "APPLE INC"
    with pytest.raises(KeyError):
        text(K.TemplateSerializer("{nope}"))


def test_embedder_and_missing_package():
    v = HashedNGramEmbedder().encode(["", "   ", "real text", "Real Text", "ab"])
    assert not v[0].any() and not v[1].any() and np.allclose(v[2], v[3]) and np.isclose(np.linalg.norm(v[4]), 1)
    assert HashedNGramEmbedder(64, 2).model_id == "hashed-ngram-2-64"
    with pytest.raises(ModuleNotFoundError, match="install"):
        require("no_such_module_here")


def vectors(spark, rows):
    return spark.createDataFrame([(i, k, [float(x) for x in v]) for k, (i, v) in enumerate(rows)], "id string, pos long, vector array<float>")


def test_knn_small(spark):
    index = vectors(spark, [("b", [0, 1]), ("a", [1, 0]), ("c", [1, 0])])
    asked = vectors(spark, [("q", [1, 0])])
    for strategy in ("broadcast", "blocks"):
        got = knn_join(asked, index, k=5, dim=2, strategy=strategy).orderBy("rank").collect()
        assert [(r.left_id, r.similarity) for r in got] == [("a", 1.0), ("c", 1.0), ("b", 0.0)]
        assert knn_join(asked, index.limit(0), k=5, dim=2, strategy=strategy).count() == 0
    with pytest.raises(Exception, match="DimensionMismatch"):
        knn_join(vectors(spark, [("q", [1, 0, 0])]), index, k=1, dim=2).collect()


def test_knn_strategies_agree_with_numpy(spark):
    m = np.random.default_rng(0).normal(size=(40, 8)).astype(np.float32)
    m[7] = m[3]
    df = vectors(spark, [(f"{k:03d}", v) for k, v in enumerate(m)])
    scores = np.round(m.astype(float) @ m.T.astype(float), 9)
    want = {(f"{q:03d}", f"{x:03d}") for q in range(40) for x in sorted(range(40), key=lambda x: (-scores[q, x], x))[:5] if scores[q, x] >= 0.5}
    for strategy in ("broadcast", "blocks"):
        got = knn_join(df, df, k=5, dim=8, threshold=0.5, strategy=strategy).collect()
        assert {(r.right_id, r.left_id) for r in got} == want


def test_blocking(spark):
    left, right = K.Source(LEFT[:2], "id"), K.Source(RIGHT[:2], "id")
    linker = DenseLinker.with_defaults()
    assert linker.block(left, right, top_k=1).count() == 2
    assert linker.block(left, right, similarity_threshold=1.1).count() == 0
    with pytest.raises(E.InvalidTopK):
        linker.block(left, right, top_k=0)
    with pytest.raises(E.InvalidTopK):
        DenseBlocker(embedder=HashedNGramEmbedder(), top_k=0).build(read_records(left))
    with pytest.raises(ValueError, match="requires a blocker"):
        DenseLinker(blocker=None, matcher=X.ThresholdMatcher()).link(left, right)
    blank = pd.DataFrame({"id": ["E"], "t": ["  "]})
    pairs = linker.block(left, K.Source(blank, "id", K.FieldwiseSerializer(["t"]))).collect()
    assert [r.similarity for r in pairs] == [0.0, 0.0]  # zero vectors still have candidates
    index = linker.index(left).blocking
    more = index.extended(read_records(K.Source(LEFT[2:], "id")))
    assert more.n == 3 and index.n == 2
    with pytest.raises(ValueError):
        more.extended(read_records(K.Source(LEFT[:1], "id")))


def test_candidates_from_frame(spark):
    left, right = K.Source(LEFT, "id"), K.Source(RIGHT, "id")
    frame = pd.DataFrame({"l": ["A1", "A2", "A2"], "r": ["B1", "B2", "B2"], "sim": [0.9, 0.2, float("nan")]})
    take = lambda f, **k: K.candidate_pairs_from_frame(f, left=left, right=right, left_id="l", right_id="r", **k)
    got = take(frame, similarity="sim")
    assert sorted((r.left_id, r.similarity) for r in got.collect() if r.similarity is not None) == [("A1", 0.9), ("A2", 0.2)] and got.count() == 3
    decided = DenseLinker(blocker=None, matcher=X.ThresholdMatcher()).match_pairs(got)
    assert decided.errors.count() == 1 and decided.decisions.where("match").count() == 1
    assert {r.similarity for r in take(frame).collect()} == {None}
    with pytest.raises(ValueError, match="left"):
        take(pd.DataFrame({"l": ["Z"], "r": ["Y"]}))
    with pytest.raises(ValueError):
        take(frame, similarity="gone")


def test_matchers_and_filter(spark):
    rows = pairs_frame(spark, [("a b", "a b c", 0.9), ("x", "y", 0.1), ("", "q", None), ("p", "p", 0.5), ("n", "n", float("nan"))])
    by = lambda m: {r.right_id: (r.match, r.error is not None) for r in m.match(rows).collect()}
    assert by(X.ThresholdMatcher()) == {"a b c": (True, False), "y": (False, False), "q": (None, True), "p": (True, False), "n": (False, False)}
    assert by(X.TokenJaccardMatcher()) == {"a b c": (True, False), "y": (False, False), "q": (None, True), "p": (True, False), "n": (True, False)}
    for m in (X.EditDistanceMatcher(), X.LevenshteinMatcher()):
        assert by(m) == {"a b c": (True, False), "y": (False, False), "q": (None, True), "p": (True, False), "n": (True, False)}
    kept = lambda **k: sorted(r.right_id for r in X.SimilarityThresholdFilter(threshold=0.5, **k).filter(rows).collect())
    assert kept() == ["a b c", "p", "q"] and kept(drop_unscored=True) == ["a b c", "p"]


def test_callable_matcher_retries(spark, tmp_path):
    log = tmp_path / "calls"

    def decide(a, b):
        with log.open("a") as f:
            f.write(a + "\n")
        if a == "boom" or (a == "once" and log.read_text().count("once") == 1):
            raise RuntimeError("kaboom")
        return {"is_match": a == b, "confidence": 0.25, "rationale": "why"}

    rows = pairs_frame(spark, [("boom", "x", None), ("once", "once", None), ("y", "z", None)]).coalesce(1)
    got = {r.left_id: r for r in DenseLinker(blocker=None, matcher=X.CallableMatcher(decide, retry=X.RetryPolicy(1))).match_pairs(rows).outcomes.collect()}
    assert got["boom"].error == "LLM matching failed after 2 attempt(s): RuntimeError('kaboom')" and got["boom"].match is None
    assert got["once"].match and not got["y"].match and got["y"].reason == "why" and got["y"].confidence == 0.25
    calls = log.read_text().split()
    assert (calls.count("boom"), calls.count("once"), calls.count("y")) == (2, 2, 1)


def test_prompts(spark):
    for wrong in ("{record_left}", "{}", '{"a": 1}'):
        with pytest.raises(ValueError):
            X.PromptMatcher(llm=None, prompt=wrong)
    m = X.PromptMatcher(llm=lambda p: {"is_match": p == "only y {}"}, prompt="only {record_b} {{}}", max_concurrency=3)
    assert {r.right_id: r.match for r in m.match(pairs_frame(spark, [("x", "y", 0.1), ("x", "z", 0.1)])).collect()} == {"y": True, "z": False}
    X.PromptMatcher(llm=None, prompt="none")


def test_flaky_matcher(spark):
    n = 150
    left = pd.DataFrame({"id": [f"L{i}" for i in range(n)], "name": [f"Northwind {i} Logistics Inc" for i in range(n)]})
    right = pd.DataFrame({"id": [f"R{i}" for i in range(n)], "name": [f"northwind {i} logistics incorporated" for i in range(n)]})
    serializer = K.FieldwiseSerializer(["name"])
    blocker = DenseBlocker(embedder=HashedNGramEmbedder(1024, 3), top_k=1)
    pairs = DenseLinker(blocker=blocker, matcher=None).block(K.Source(left, "id", serializer), K.Source(right, "id", serializer))
    pairs = pairs.cache()
    golden = gold(spark, [(f"L{i}", f"R{i}") for i in range(n)])
    for rate in (0.0, 0.2):
        apart = K.LinkageResult(X.FlakyMatcher(X.ThresholdMatcher(), rate).match(pairs))
        silent = K.LinkageResult(X.FlakyMatcher(X.ThresholdMatcher(), rate, "silent").match(pairs))
        a, b = (M.linkage_metrics(r, gold=golden) for r in (apart, silent))
        assert a.f1 >= b.f1 and b.n_errors == 0 and (a.n_errors > 0) == (rate > 0)
        assert M.coverage(apart) == pytest.approx(1 - a.n_errors / n) and M.coverage(silent) == 1


@pytest.mark.parametrize(
    "edges, nodes, want",
    [
        ([("A", "B"), ("B", "C")], [], {"A": 0, "B": 0, "C": 0}),
        ([("C", "D"), ("B", "A")], [], {"A": 0, "B": 0, "C": 1, "D": 1}),
        ([], ["B", "A"], {"A": 0, "B": 1}),
        ([], [], {}),
    ],
)
def test_components(spark, edges, nodes, want):
    got = label_components(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([(n,) for n in nodes], "id string"))
    assert {r.record_id: r.cluster_id for r in got.collect()} == want


def test_clusters_of_results(spark):
    got = result(spark, [("A", "B", False), ("C", "D", "failed"), ("2", "1", True)])
    labels = {r.record_id: r.cluster_id for r in ConnectedComponentsClusterer().cluster(got).to_frame().collect()}
    assert labels == {"1": 0, "2": 0, "A": 1, "B": 2, "C": 3, "D": 4}
    more = connected_components(result(spark, [("1", "2", True)]), all_record_ids=spark.createDataFrame([(1,), (2,), (3,)], "id int"))
    b3 = M.clustering_metrics(more, gold=gold(spark, [("1", "2"), ("1", "3")]))
    assert (round(b3.b3_recall, 9), b3.b3_precision) == (round(5 / 9, 9), 1)


@pytest.mark.parametrize(
    "labels, pairs, precision, recall, n_gold",
    [
        ({"A": 0, "B": 0, "C": 0}, [("A", "B")], 5 / 9, 1, 2),
        ({"A": 0, "B": 1}, [("A", "B")], 1, 0.5, 1),
        ({"A": 0, "B": 0, "C": 1}, [("A", "C")], 2 / 3, 2 / 3, 2),
        ({"A": 0, "B": 1}, [("A", "Z")], 1, 1, 2),
        ({}, [], 0, 0, 0),
    ],
)
def test_b3(spark, labels, pairs, precision, recall, n_gold):
    got = M.clustering_metrics(K.ClusteringResult(spark.createDataFrame(list(labels.items()), "record_id string, cluster_id int")), gold=gold(spark, pairs))
    assert (got.b3_precision, got.b3_recall, got.n_gold_clusters) == (pytest.approx(precision), pytest.approx(recall), n_gold)


@pytest.mark.parametrize(
    "rows, directed, counts",
    [
        ([("A", "B", True)], True, (1, 0, 1)),
        ([("A", "B", True), ("C", "D", "failed")], True, (1, 0, 0)),
        ([("A", "B", False)], True, (0, 0, 2)),
        ([("A", "Z", True)], True, (0, 1, 2)),
        ([("B", "A", True)], True, (0, 1, 2)),
        ([("B", "A", True)], False, (1, 0, 1)),
        ([], True, (0, 0, 2)),
    ],
)
def test_linkage_counts(spark, rows, directed, counts):
    got = M.linkage_metrics(result(spark, rows), gold=gold(spark, [("A", "B"), ("C", "D")]), directed=directed)
    assert (got.tp, got.fp, got.fn) == counts and got.n_gold == 2
    assert M.LinkageMetrics(0, 0, 0, 0, 0).f1 == 0.0


def test_pair_completeness(spark):
    rows = pairs_frame(spark, [("X", "R1", 0.9), ("L1", "R1", 0.5), ("L2", "R2", 0.8)])
    golden = gold(spark, [("L1", "R1"), ("L2", "R2")])
    got = M.blocking_metrics(rows, gold=golden, ks=[2, 1, 2, 0])
    assert dict(got.pc) == {0: 0.0, 1: 0.5, 2: 1.0}
    with pytest.raises(KeyError):
        got.pc_at(9)
    assert M.pair_completeness_at_k(rows, gold=gold(spark, []), k=1) == 0.0
    with pytest.raises(ValueError):
        M.blocking_metrics(rows, gold=golden, ks=[-1])


def test_threshold_sweep(spark):
    rows = pairs_frame(spark, [("A1", "B1", 0.9), ("A2", "B2", 0.6), ("A3", "B3", 0.3), ("A4", "B4", None)])
    golden = gold(spark, [("A1", "B1"), ("A2", "B2")])
    sweep = M.tune_threshold(rows, gold=golden)
    assert [(t, m.tp, m.fp, m.fn) for t, m in sweep.points] == [(0.3, 2, 1, 0), (0.6, 2, 0, 0), (0.9, 1, 0, 1)]
    assert sweep.best_f1()[0] == 0.6 and sweep.at_recall(1.0)[0] == 0.6 and sweep.points[0][1].n_errors == 1
    grid = M.tune_threshold(rows, gold=golden, thresholds=[0.95, 0.5, 0.5])
    assert [(t, m.tp) for t, m in grid.points] == [(0.5, 2), (0.5, 2), (0.95, 0)]
    with pytest.raises(ValueError):
        M.tune_threshold(rows.limit(0), gold=golden).best_f1()


def test_adjusted_metrics(spark):
    rows = pairs_frame(spark, [("A", "B", 0.9)])
    got = M.adjusted_metrics(result(spark, [("A", "B", True)]), rows, gold=gold(spark, [("A", "B"), ("C", "D")]), k=1)
    assert (got.pc, got.matcher.recall, got.recall_adjusted, round(got.f1_adjusted, 9)) == (0.5, 1.0, 0.5, round(2 / 3, 9))


def test_hard_negatives_and_sample(spark):
    rows = pairs_frame(spark, [("g", "g", 0.9), ("b", "x", 0.4), ("a", "x", 0.4), ("c", "x", 0.8), ("d", "x", None)])
    golden = gold(spark, [("g", "g")])
    ids = lambda df: [r.left_id for r in df.collect()]
    assert ids(M.mine_hard_negatives(rows, gold=golden)) == ["c", "a", "b"] and ids(M.mine_hard_negatives(rows, gold=golden, n=1)) == ["c"]
    assert sorted(ids(M.stratified_sample(rows, gold=golden, n_negatives=1))) == ["c", "g"]
    with pytest.raises(ValueError):
        M.mine_hard_negatives(rows, gold=golden, n=-1)


def test_split(spark):
    golden = gold(spark, [(f"a{k}", f"b{k}") for k in range(10)])
    for size, n in ((0.3, 3), (0.4, 4), (0.0, 0), (1.0, 10), (0.25, 2)):
        train, test = golden.split(test_size=size, seed=1)
        a, b = ({tuple(r) for r in p.pairs.collect()} for p in (train, test))
        assert len(b) == n and len(a) == 10 - n and not a & b
        assert {tuple(r) for r in golden.split(test_size=size, seed=1)[1].pairs.collect()} == b
    for size in (1.5, -0.1):
        with pytest.raises(ValueError):
            golden.split(test_size=size)


def test_gold_is_an_ordered_set(spark):
    assert gold(spark, [("1", "2"), ("1", "2"), ("2", "1")]).pairs.count() == 2
    frame = pd.DataFrame({"l": [1, 1], "r": [2, 2]})
    assert [tuple(r) for r in K.LabeledPairs.from_frame(frame, "l", "r").pairs.collect()] == [("1", "2")]


def test_store(spark, tmp_path):
    left = LEFT.assign(t=pd.Timestamp("2020-01-01"))
    path, embedder = str(tmp_path / "index"), HashedNGramEmbedder(1024, 3)
    index = DenseLinker.with_defaults().index(K.Source(left, "id"))
    index.save(path)
    loaded = LinkageIndex.load(path, embedder=embedder, matcher=X.ThresholdMatcher())
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(loaded.query(K.Source(RIGHT, "id")).to_frame()) == key(index.query(K.Source(RIGHT, "id")).to_frame())
    for wrong in (HashedNGramEmbedder(512, 3), HashedNGramEmbedder(1024, 2)):
        with pytest.raises(E.IncompatibleStore):
            LinkageIndex.load(path, embedder=wrong, matcher=None)
    meta = spark.read.text(f"{path}/meta").first().value
    for text in ("[]", "no json", "{}", meta.replace('"format": 1', '"format": 9'), meta.replace('"n": 3', '"n": 4')):
        spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/meta")
        with pytest.raises(E.IncompatibleStore):
            LinkageIndex.load(path, embedder=embedder, matcher=None)


def test_verdicts(spark):
    df = spark.createDataFrame([("Yes, same.",), ("no",), ("It is a match",), ("maybe",), (None,), ("they do not",)], "t string")
    assert [r[0] for r in df.select(M.parse_verdict(df.t)).collect()] == [True, False, True, None, None, False]
