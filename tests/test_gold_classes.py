"""Queries on gold matches by label, on odd tables, against their SQL; gold pairs must not be written out."""

import random

import pytest

import __spark_entry__
from kinmesh.operators import metrics as M
from kinmesh.operators.matching import ThresholdMatcher
from kinmesh.operators.linker import decide
from kinmesh.plans import registry
from kinmesh.sources.records import LabeledClasses, LabeledPairs

QUERIES = [
    "adjusted_metrics",
    "hard_negatives",
    "pair_completeness",
    "threshold_sweep",
    "b3",
    "linkage_metrics",
    "best_f1",
    "linkage_metrics_undirected",
    "threshold_grid",
]  # all


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Ids of one to three digits, labels that are null, of one row only, and of half of the rows; but no nulls for b3, whose SQL
    leaves their rows out."""
    r, out = random.Random(3), {}
    label = lambda k: None if k % 11 == 0 else 100 + k if k % 13 == 0 else r.choice([1, 1, 1, 2, 3])
    rows = [(k * 7 + 2, [r.gauss(0, 0.125) + (0.1 if j % 3 == k % 3 else 0) for j in range(64)], label(k)) for k in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)
    for name, kept in (("all", df), ("b3", df.where("label is not null"))):
        out[name] = str(tmp_path_factory.mktemp(name))
        kept.write.parquet(f"{out[name]}/embeddings.parquet")
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_query_makes_no_gold_pairs(spark, odd, name, monkeypatch):
    odd = odd.get(name, odd["all"])
    duckdb = pytest.importorskip("duckdb")

    def pairs(*_):
        raise AssertionError("gold pairs are written out")

    monkeypatch.setattr(registry, "gold", pairs)
    monkeypatch.setattr(LabeledClasses, "pairs", property(pairs))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{odd}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert sorted(map(tuple, __spark_entry__.queries()[name](spark, odd).collect())) == want and want


def test_classes_are_their_pairs(spark):
    r = random.Random(4)
    members = [(str(k), k, r.choice(["x", "y", None, "z"])) for k in range(5, 40) for _ in range(1 + k % 3)]
    classes = LabeledClasses(spark.createDataFrame(members, "id string, pos long, label string"))
    written = LabeledPairs(classes.pairs)
    assert classes.n() == written.pairs.count() > 100
    rows = [(str(r.randrange(3, 44)), str(r.randrange(3, 44)), r.choice([None, 0.1, 0.4, 0.4, 0.8]), None, None) for _ in range(300)]
    rows = spark.createDataFrame(rows, "left_id string, right_id string, similarity double, left_text string, right_text string")
    result = decide(rows, ThresholdMatcher(threshold=0.5))
    for directed in (True, False):
        a, b = (M.linkage_metrics(result, gold=g, directed=directed) for g in (classes, written))
        assert a == b and a.tp and a.fp and a.fn
        a, b = (M.adjusted_metrics(result, rows, gold=g, k=2, directed=directed) for g in (classes, written))
        assert a == b and 0 < a.pc < 1
        a, b = (M.blocking_metrics(rows, gold=g, ks=[1, 3], directed=directed) for g in (classes, written))
        assert a == b
    none = LabeledClasses(classes.members.limit(0))
    assert none.n() == 0 and M.linkage_metrics(result, gold=none).tp == 0
