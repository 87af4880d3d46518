"""Operators on documents against brute force, and on odd rows."""

import functools
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from kinmesh.llm import decontaminate, packing, quality, registry, simhash

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
ODD = [(1, None, "x"), (2, "", "y"), (None, "a b", None), (3, "One two three four. " * 30, "z"), (3, "One two three four. " * 30, "z"), (4, "\n \t\n", "q"), (5, "é" * 5000, "w")]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows(name, at=SMALL):
    return pq.read_table(f"{at}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n_words string")


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    docs = rows("documents")
    got = {r.doc_id: r for r in registry.QUERIES["op5_simhash"](spark, SMALL).collect()}
    want = {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == want
    root = {k: k for k in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(want)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (want[a] ^ want[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {k: r.component_id for k, r in got.items()} == {k: find(k) for k in ids}


def test_covering_masks_cover():
    masks = simhash.covering_masks(3)
    rng = np.random.default_rng(0)
    assert len(masks) == 15
    for _ in range(3000):
        bits = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not m & bits for m in masks)


def test_links_in_blocks_connect_the_same(spark):
    rng = np.random.default_rng(1)
    centre = [int(x) for x in rng.integers(0, 2**62, 3)]
    fps = {c ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in rng.integers(0, 63, (60, 2))}
    df = spark.createDataFrame([(x,) for x in fps], "fingerprint long")
    whole = {(r.node, r.root) for r in simhash.smallest_reachable(simhash.links(df)).collect()}
    split = {(r.node, r.root) for r in simhash.smallest_reachable(simhash.links(df, block=7)).collect()}
    assert whole == split and whole


def test_simhash_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[4].fingerprint == 0
    assert by[2].component_id == by[4].component_id == 1 and by[3].component_id == 3
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 5]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def brute_hits(text, items):
    w = WORD.findall(lowered(text))
    hit, found = set(), set()
    for key, other in items:
        v = WORD.findall(lowered(other))
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(key))
    return len(w), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    items = [(r["item_id"], r["text"]) for r in rows("benchmark")]
    got = {r.doc_id: r for r in registry.QUERIES["op6_decontaminate"](spark, SMALL).collect()}
    n = 0
    for d in rows("documents"):
        words, hit, found = brute_hits(d["text"], items)
        r = got[d["doc_id"]]
        sha = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (words, hit, len(found), sha)
        assert r.contaminated == (hit > 0 and 20 * hit >= words)
        n += hit > 0
    assert n


def test_decontamination_on_few_words(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(rng.choice(list("abc"), n))
    items = [(k, text(int(n))) for k, n in enumerate(rng.integers(1, 25, 30) * (rng.random(30) < 0.9))] + [(99, "a b a b a")]
    items = [(k, t) for k, t in items if len(t) != 1]
    docs = [(k, text(int(n))) for k, n in enumerate(rng.integers(0, 120, 60))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (200_000, 40):
        got = {r.doc_id: r for r in decontaminate.contamination(spark, d, b, block_words=block_words).collect()}
        for k, t in docs:
            assert (got[k].n_words, got[k].n_hit, got[k].item_ids) == brute_hits(t, items), (k, t)


def test_decontamination_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "four one two three"), (2, None), (None, "")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_hit for r in decontaminate.contamination(spark, odd, items).collect()}
    assert got[(3, 120)] == 116 + 0 and got[(1, 0)] == got[(2, 0)] == 0
    for drop in (True, False):
        out = decontaminate.decontaminate(spark, odd, items, drop=drop)
        assert out.columns == odd.columns and out.count() == len(ODD) - 2 * drop
    none = decontaminate.contamination(spark, odd, items.limit(0)).collect()
    assert len(none) == len(ODD) and not any(r.contaminated for r in none)
    assert decontaminate.cut("One two, three four!", [[1, 3]]) == "One  four!"
    # a block for each item
    for d in (odd, odd.limit(0)):
        for f in (decontaminate.contamination, decontaminate.decontaminate):
            one, many = (sorted(map(repr, f(spark, d, items, block_words=n).collect())) for n in (200_000, 1))
            assert one == many


def test_decontamination_by_length_and_coverage(spark):
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    item, other = words("a", 40), words("b", 30)
    few, many = words("x", 100), words("y", 2000)
    texts = [f"{few} {item}", f"{many} {item}, {few}", f"{many} {words('a', 20)}", f"{many} {item} {few} {other} {many}", many, None]
    docs = [(k % 4, t, len(t or ""), "s") for k, t in enumerate(texts * 2)]
    want = {1: f"{many} , {few}", 2: texts[2], 3: f"{many}  {few}  {many}", 4: many, 5: None}
    want = sorted((repr(k), repr(want[k % 6]), n if (t := want[k % 6]) == docs[k][1] else len(t)) for k, (_, _, n, _) in enumerate(docs) if k % 6)
    d = spark.createDataFrame([(*x, k) for k, x in enumerate(docs)], "doc_id long, text string, n_chars long, __key string, row long")
    b = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    for n in (200_000, 10):
        got = decontaminate.decontaminate(spark, d, b, block_words=n)
        assert got.columns == d.columns
        assert sorted((repr(r.row), repr(r.text), r.n_chars) for r in got.collect()) == want
    whole = decontaminate.decontaminate(spark, d, b, drop=False, block_words=10)
    assert {r.text for r in whole.where("row in (0, 6)").collect()} == {few + " "}


def test_decontamination_of_very_many_equal_rows(spark):
    d = spark.range(12_000).selectExpr("if(id < 11500, 7, id) as doc_id", "if(id % 4 = 0 or id < 11500, 'z a b c d', 'q') as text")
    b = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "q r")], "item_id long, text string")
    got = decontaminate.contamination(spark, d, b, block_words=2).groupBy("n_hit", "n_items").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 375), (4, 2, 11_625)]


def test_decontamination_of_a_very_long_text(spark):
    rng = np.random.default_rng(5)
    item = [f"w{k}" for k in range(30)]
    w = [f"v{k}" for k in rng.integers(0, 500, 400_000)]
    places = list(range(1000, 400_000, 50_000))
    for p in places:
        w[p : p + 30] = item
    d = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, "never met")], "item_id long, text string")
    for n in (200_000, 10):
        r = decontaminate.contamination(spark, d, b, block_words=n).first()
        assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == (400_000, 30 * len(places), ["1"], False)
        assert [s for s in r.spans] == [[p, p + 30] for p in places]
        text = decontaminate.decontaminate(spark, d, b, block_words=n).first().text
        assert len(text.split()) == 400_000 - 30 * len(places) and "w0" not in text.split()


def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep)


def test_quality_counts_and_accuracy(spark):
    docs = {d["doc_id"]: d["text"] for d in rows("documents", SF)}
    got = registry.QUERIES["op7_quality"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute_base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.base_failed and r.kept) and 0 <= r.score <= 1


def test_quality_held_out_accuracy():
    docs = {d["doc_id"]: d["text"].encode() for d in rows("documents", "/root/testdata/sf0.1")}
    marked = [(docs[r["doc_id"]], r["quality"]) for r in rows("labels", "/root/testdata/sf0.1") if r["doc_id"] in docs]
    cut = quality.TRAIN_ROWS
    model = quality.train([t for t, _ in marked[:cut]], [y for _, y in marked[:cut]])
    score = model.scores([t for t, _ in marked[cut:]])
    y = np.array([y for _, y in marked[cut:]])
    long = np.array([len(t.split()) >= 50 for t, _ in marked[cut:]])
    assert (score[(y == 1) & long] >= 0.5).mean() > 0.95
    assert (score[(y == 0) & long] < 0.5).mean() > 0.8


def test_quality_of_long_texts_in_pieces():
    texts = [("Eine Zeile mit Wörtern, ça va; %d é.\n" * 40 % tuple(range(40))).encode(), b"", b"x" * 700, "ü".encode() * 400, b"words and " * 900, b" a b  c \t" * 90]
    weights = np.random.default_rng(3).normal(size=(quality._KINDS, 1 << 12))
    whole = quality.sums_of(texts, weights, 12)
    assert quality.sums_of(texts, weights, 12, most=1500).tolist() == pytest.approx(whole.tolist())
    assert sum(len(own) for _, _, own in quality.pieces(texts, 1500)) > len(texts)
    one = quality.sums_of([texts[0]], weights, 12)  # texts do not touch each other's grams
    assert one[0] == pytest.approx(whole[0])
    assert quality.code_points("aé\U0001f600".encode()).tolist() == [97, 233, 0x1F600]


def test_quality_odd_rows(spark, odd):
    model = quality.train([b"good words here " * 20, b"### $$$ bad"] * 20, [1, 0] * 20)
    got = quality.quality(odd, model).collect()
    assert len(got) == len(ODD) and {r.n_words for r in got if r.doc_id in (1, 2, 4)} == {0}
    assert quality.quality(odd.limit(0), model).count() == 0
    assert quality.train([b"x"], [1]).scores([b"", b"y"]).tolist() == pytest.approx([2 / 3, 2 / 3])


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.word_tokenizer())


def tokens(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def check_packing(got, docs, capacity):
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for k, text in docs.items():
        ids = tokens(text)
        pieces = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), capacity))
        for r in pieces:
            part = ids[r.start : r.start + capacity]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for r in by_bin.values():
        at = 0
        for x in sorted(r, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= capacity
    return len(by_bin), sum(r.length for r in got)


def test_packing_round_trip(spark):
    docs = {d["doc_id"]: d["text"] for d in rows("documents", SF)}
    got = registry.QUERIES["op8_packing"](spark, SF).collect()
    bins, total = check_packing(got, docs, 4096)
    assert bins <= 1.02 * -(-total // 4096) + 1


def test_packing_in_many_tasks_and_odd_rows(spark, odd):
    docs = {d["doc_id"]: d["text"] for d in rows("documents")}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(11)
    got = packing.pack(df, packing.word_tokenizer(), capacity=512, fan_in=2, chunk=7).collect()
    bins, total = check_packing(got, docs, 512)
    assert bins <= 1.1 * -(-total // 512) + 1
    out = packing.pack(odd, packing.word_tokenizer()).collect()
    assert len(out) == len(ODD) + 1 and sorted(r.length for r in out)[:3] == [1, 1, 1]  # one has over 4096 tokens
    assert packing.pack(odd.limit(0), packing.word_tokenizer()).count() == 0


def test_ranges_are_packed_like_single_items():
    rng = np.random.default_rng(4)
    for capacity, high in ((10, 9), (64, 40), (512, 500), (512, 60)):
        for _ in range(40):
            fills = rng.integers(1, high, int(rng.integers(1, 400)))
            counts = [(t, f, n) for t in range(3) for f, n in Counter(fills[t::3].tolist()).items()]
            got = packing.pack_ranges(counts, capacity)
            _, _, want = packing.best_fit(sorted(fills.tolist(), reverse=True), capacity)
            bins, seen = {}, set()
            for task, fill, rank, n, per, at, first, to_fill, to_rank in got:
                for i in range(n):
                    assert (task, fill, rank + i) not in seen
                    seen.add((task, fill, rank + i))
                    bins.setdefault((first + i // per, to_fill, to_rank + i // per), []).append((at + i % per * fill, fill))
            assert len(seen) == len(fills) and len(bins) == len({b for b, _, _ in bins}) == len({x[1:] for x in bins})
            for (_, to_fill, _), items in bins.items():
                end = 0
                for at, n in sorted(items):
                    assert at == end
                    end += n
                assert end == to_fill <= capacity
            assert sorted(f for _, f, _ in bins) == sorted(want)


def test_many_underfull_bins_are_all_handed_on():
    # bins a little over half full, more than any task would hold one by one, and small ones that fit
    counts = [(t, f, 50_000) for t in range(8) for f in range(2100, 2140)] + [(8, 1900, 16_000_000)]
    got = packing.pack_ranges(counts, 4096)
    assert sum(r[3] for r in got) == 8 * 40 * 50_000 + 16_000_000 and len(got) < 20_000
    assert max(r[6] + -(-r[3] // r[4]) for r in got) == 16_000_000


def test_word_cache_is_the_tokenizer():
    texts = ["It's don't THE The the, the,, (the) a1b2 3.14 e\u0301t\u00e9 \u00c9t\u00e9! \u0130x \u03a3\u039f\u03a3 \u212a \ufb01n x\u0338 \U0001f600ok", "", "<|endoftext|> a<|endoftext|>, l'an'", "\u4f60\u597d,\u4e16\u754c \u1112\u1161\u11ab a\u00a0b\u2003c"]
    texts += [d["text"] for d in rows("documents")]
    cache = packing.WordCache(packing.word_tokenizer(), most=50)
    for _ in range(2):
        got = cache.encode([t.encode() for t in texts])
        for t, g in zip(texts, got):
            assert np.frombuffer(g, "<u4").tolist() == tokens(t)[:-1], t[:80]


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 5], 10) == ([0, 1, 0, 1], [0, 0, 6, 5], [10, 10])
