"""Licence scans on small texts; the whole query has SQL."""

from kinmesh.llm import license_scan

MIT = license_scan.TEMPLATES[0][1]


def run(spark, rows):
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string"))
    return {r.doc_id: r for r in got.collect()}


def test_base_places_overlap_and_count(spark):
    got = run(spark, [(1, "x CC-BY-NC cc by nc! Under the MIT\nLicense, under the mit licence", None), (2, "Apache  License; version 2.0", "")])
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 1, 7, "cc-by-nc,mit")
    assert (got[2].n_base, got[2].first_word, got[2].base_labels, got[2].score) == (1, 0, "apache-2", 1.0)


def test_edited_notices_are_found_on_near_diagonals(spark):
    w = MIT.split()
    edited = " ".join([*w[:10], "really", *w[10:25], *w[26:]])
    got = run(spark, [(1, "start " + edited + " end", ""), (2, " ".join(w[:20]), "")])
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.8 < got[1].score < 1
    assert got[1].spans[0].first == 1 and got[1].spans[0].end == len(w) + 1
    assert got[2].labels == "" and got[2].first_word is None


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "x"), (3, "cc", "x"), (4, "K cc by nc", ""), (5, "cc by nc", ""), (5, "cc by nc", "y"), (None, "cc by nc", "")]
    df = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string"))
    out = sorted((r.doc_id or 0, r.n_words, r.n_base) for r in df.collect())
    assert out == [(0, 3, 1), (1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 4, 1), (5, 3, 1), (5, 3, 1)]
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text(spark):
    text = "cc by nc " * 60_000
    r = run(spark, [(1, text, "")])[1]
    assert (r.n_words, r.n_base, r.last_word) == (180_000, 60_000, 179_997)
