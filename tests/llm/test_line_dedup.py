"""Line dedup on small texts; the whole query has SQL."""

from kinmesh.llm import line_dedup

LONG = " ".join(f"w{i}" for i in range(55))
MULTI = "\n".join(" ".join(f"v{i}_{j}" for j in range(8)) for i in range(14))


def run(spark, rows, columns="doc_id long, text string, n_chars long, source string"):
    return line_dedup.dedup_lines(spark.createDataFrame(rows, columns))


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_long_lines_and_passages_go_once(spark):
    rows = [(k, f"Own start {k}.\n{LONG}\nown end {k}", 0, "s") for k in range(4)]
    rows += [(k, f"Other {k}\nand more {k}\n{MULTI}\nlast {k}", 0, "s") for k in range(10, 13)]
    got = texts(run(spark, rows))
    assert got[0] == rows[0][1] and got[10] == rows[4][1]
    for k in range(1, 4):
        assert got[k] == f"Own start {k}.\nown end {k}"
    for k in (11, 12):
        assert got[k].startswith(f"Other {k}") and got[k].endswith(f"last {k}")
        assert len(got[k].split()) < 50


def test_blank_lines_between_paragraphs_do_not_end_a_run(spark):
    passage = "\n\n".join(" ".join(f"p{i}_{j}" for j in range(25)) for i in range(5))
    got = texts(run(spark, [(k, f"Own start {k}\n\n{passage}\n\nown end {k}", 0, "s") for k in range(3)]))
    assert got[0] == f"Own start 0\n\n{passage}\n\nown end 0"
    for k in (1, 2):
        assert got[k].split() == f"Own start {k} own end {k}".split()


def test_clean_and_short_repeats_stay(spark):
    rows = [(k, f"Alone {k}\nshort line that many have\nend {k}", 5, "s") for k in range(5)]
    out = run(spark, rows).collect()
    assert {r.doc_id: r.text for r in out} == {r[0]: r[1] for r in rows}
    assert {r.n_chars for r in out} == {5}


def test_odd_rows(spark):
    rows = [(1, None, 1, None), (2, "", 0, "a"), (3, LONG, 9, "a"), (3, LONG, 9, "b"), (4, LONG, 9, None), (None, "\n\n", 2, "a"), (5, "\n" * 50, 3, "a")]
    df = run(spark, rows, "doc_id long, text string, n_chars long, words string")
    assert df.columns == ["doc_id", "text", "n_chars", "words", "__removed"]
    out = sorted(((r.doc_id or 0, r.text, r.n_chars) for r in df.collect()), key=lambda x: x[0])
    assert out == [(0, "\n\n", 2), (1, None, 1), (2, "", 0), (3, LONG, 9), (3, LONG, 9), (4, "", 0), (5, "\n" * 50, 3)]
    assert run(spark, rows[:0]).count() == 0


def test_hash_collisions_are_compared(spark, monkeypatch):
    other = LONG.replace("w7", "x7")
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda c: line_dedup.F.length(c).cast("long"))
    got = texts(run(spark, [(1, LONG, 0, ""), (2, other, 0, ""), (3, LONG, 0, "")]))
    assert got == {1: LONG, 2: other, 3: ""}


def test_passages_of_short_lines_go_to_their_edges(spark):
    shapes = [(6, 9), (4, 13), (8, 8), (10, 8), (3, 17), (13, 4)]
    for shape, (lines, words) in enumerate(shapes):
        rows = []
        for p in range(25):
            passage = "\n".join(" ".join(f"p{shape}_{p}_{i}_{j}" for j in range(words)) for i in range(lines))
            for d in range(3):
                k = 10 * p + d
                rows.append((k, f"Start {k}\nof it {k}\n{passage}\nthen {k}\nend {k}", 0, "s"))
        got = texts(run(spark, rows))
        whole = [k for k, t, _, _ in rows if got[k] == f"Start {k}\nof it {k}\nthen {k}\nend {k}"]
        assert all(got[k] == t for k, t, _, _ in rows if k % 10 == 0)
        if lines * words < 60 and words >= 10:  # a line of ten words is a chunk by itself
            assert len(whole) == 50
        assert len(whole) >= 46, shape


def test_a_chunk_of_many_documents_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_SALT", 3)
    rows = [(k, f"a {k}\n{LONG}\nb {k}", 0, "s") for k in range(40)]
    long = "\n".join(f"line {i} of a long text" for i in range(30_000))
    rows += [(100, long, 0, "s"), (101, long + "\nmore", 0, "s")]
    got = texts(run(spark, rows))
    assert got[0] == rows[0][1] and all(got[k] == f"a {k}\nb {k}" for k in range(1, 40))
    assert got[100] == long and got[101] == "more"
