"""Content-defined line chunks: passages that other documents had first are removed.  DataFrame functions only.

A line's hash is its MD5.  A rolling hash over the last two line hashes ends a chunk where its first hex digit is
below c, and a line of ``long_line`` words or more is a chunk by itself, so boundaries depend on nearby lines only
and shift with the text.  A chunk that several documents have is kept by that of the smallest doc_id.  In the others,
neighbouring repeated chunks make a run; hashes only propose chunks, each is compared with the kept one byte by byte.
A run's ends are moved outwards line by line, into the neighbouring chunks, as long as the keeper's lines there are
equal.  Runs of ``min_words`` words or more, with what was added, go.  Rows of one doc_id are one document here.

Shuffles: rows of fixed size by hash and by document; the texts of documents that may have a run, found by a bitmap of
their keys; the texts of repeated chunks, by hash and a salt, so that a chunk that many documents have is many tasks'
work; and the documents that lose lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmesh.operators.skew import join_hot, key_bitmap, within

from .common import stash, table

#: A word: what stands between blanks.
_BLANKS = r"[\x20\x09-\x0D]+"
_KEY = ["__id", "__th"]
#: Rows of one chunk that meet the kept text in one task.
_SALT = 256


def _words(line: Column) -> Column:
    """Words of a line; a leading blank makes an empty first part."""
    parts = F.split(line, _BLANKS)
    return F.size(F.array_remove(parts, ""))


def _chunked(docs: DataFrame, long_line: int) -> DataFrame:
    """A row for each chunk with words: the document's key, number, first line, lines, words and hash; the lines at
    which the two chunks before and the one after it begin and end (above, below), and their words (w_above, w_below).
    """
    lines = docs.select(*_KEY, F.split("__text", "\n", -1).alias("lines"))
    lines = lines.select(*_KEY, "lines", F.transform("lines", lambda x: F.md5(x)).alias("h"), F.transform("lines", _words).alias("w"))
    n = F.size("h")

    def ends(i: Column) -> Column:
        """Whether line i (from 1) ends a chunk."""
        before = F.when(i > 1, F.get("h", i - 2)).otherwise("")
        rolled = F.substring(F.md5(F.concat(before, F.get("h", i - 1))), 1, 1) < "c"
        return rolled | (F.get("w", i - 1) >= long_line) | (F.coalesce(F.get("w", i), F.lit(0)) >= long_line) | (i == n)

    cut = lines.select(*_KEY, "lines", "w", F.filter(F.sequence(F.lit(1), n), ends).alias("end"))
    cut = cut.select(
        *_KEY, "lines", "w",
        F.arrays_zip(
            F.concat(F.array(F.lit(0)), F.slice("end", 1, F.size("end") - 1)).alias("a"), F.col("end").alias("b")
        ).alias("cut"),
    )

    def chunk(c: Column) -> Column:
        size = c["b"] - c["a"]
        body = F.array_join(F.slice("lines", c["a"] + 1, size), "\n")
        words = F.aggregate(F.slice("w", c["a"] + 1, size), F.lit(0), lambda x, y: x + y)
        return F.struct(c["a"].alias("first"), size.alias("lines"), words.alias("words"), F.xxhash64(body).alias("hash"))

    # numbered without those that have no words, so that blank lines between paragraphs do not end a run
    worded = cut.select(*_KEY, F.size("lines").alias("n"), F.filter(F.transform("cut", chunk), lambda c: c["words"] > 0).alias("c"))
    # no filter here: it would go below the projections and compute their arrays anew for every line
    n_c, zero = F.size("c"), F.lit(0)
    first, words = F.transform("c", lambda c: c["first"]), F.transform("c", lambda c: c["words"])
    before = F.slice(F.concat(F.array(zero), words), 1, n_c)
    beside = F.arrays_zip(
        "c",
        # two chunks back, as a chunk's first line may end it in one document and not in another
        F.slice(F.concat(F.array(zero, zero), first), 1, n_c).alias("above"),
        F.slice(F.concat(F.transform(F.slice("c", 2, n_c), lambda c: c["first"] + c["lines"]), F.array("n")), 1, n_c).alias("below"),
        F.zip_with(before, F.slice(F.concat(F.array(zero, zero), words), 1, n_c), lambda x, y: x + y).alias("w_above"),
        F.slice(F.concat(F.slice(words, 2, n_c), F.array(zero)), 1, n_c).alias("w_below"),
    )
    rows = worded.select(*_KEY, F.posexplode(beside).alias("no", "x"))
    return rows.select(*_KEY, "no", "x.c.first", "x.c.lines", "x.c.words", "x.c.hash", "x.above", "x.below", "x.w_above", "x.w_below")


def _runs(rows: DataFrame) -> DataFrame:
    """The rows, repeated ones once, with the number of their run: neighbours by `no` in one document."""
    rows = rows.repartition(*_KEY).dropDuplicates([*_KEY, "no"])
    return rows.withColumn("run", F.col("no") - F.row_number().over(Window.partitionBy(*_KEY).orderBy("no")))


def _common(mine: str, held: str, nearest_last: bool) -> Column:
    """Of two arrays of lines, the mine ones that are equal from the chunk outwards: (lines, words) up to the last that has words."""
    a, b = (F.reverse(c) if nearest_last else F.col(c) for c in (mine, held))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    odd = F.array_position(same, False).cast("int")
    words = F.transform(F.slice(a, 1, F.when(odd > 0, odd - 1).otherwise(F.size(same))), _words)
    lines = F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(w > 0, i + 1).otherwise(0))), F.lit(0))
    return F.struct(lines.alias("lines"), F.aggregate(words, F.lit(0), lambda x, y: x + y).alias("words"))


def repeated_lines(keyed: DataFrame, *, long_line: int = 10, min_words: int = 30) -> DataFrame:
    """The lines to remove: the document's key, first line and lines; they may overlap."""
    rows = stash(_chunked(keyed, long_line), "chunks")
    kept = rows.groupBy("hash").agg(F.min("__id").alias("keeper"), F.max("__id").alias("last"), F.count("*").alias("n"))
    kept = stash(kept.where("keeper <> last").drop("last"), "chunks-kept")
    rows = within(rows, key_bitmap(kept, ["hash"]), ["hash"]).where("__within").drop("__within")
    met = stash(join_hot(rows, kept, ["hash"]), "chunks-met")
    # runs that may have the words, with all of the chunks beside them
    run = Window.partitionBy(*_KEY, "run")
    later = _runs(met.where("__id <> keeper"))
    later = later.withColumns({"l": F.col("no") == F.min("no").over(run), "r": F.col("no") == F.max("no").over(run)})
    most = F.sum(F.col("words") + F.when(F.col("l"), F.col("w_above")).otherwise(0) + F.when(F.col("r"), F.col("w_below")).otherwise(0))
    later = later.withColumn("most", most.over(run)).where(F.col("most") >= min_words)
    place = ["no", "first", "lines", "words", "above", "below"]
    mine = stash(later.select(*_KEY, *place, "hash", "l", "r", "n"), "chunks-marks")
    asked = mine.groupBy("hash").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    held = met.where("__id = keeper").join(asked, "hash").groupBy("hash", "l", "r", "n").agg(F.min(F.struct(*_KEY, *place)).alias("x"))
    # texts of marked chunks and of those that are kept, with the lines beside them where a run ends
    wanted = mine.withColumn("mine", F.lit(True)).unionByName(held.select("hash", "l", "r", "n", "x.*").withColumn("mine", F.lit(False)))
    wanted = stash(wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("mine", "hash", "n", "l", "r", *place)).alias("x")), "chunks-wanted")
    texts = within(keyed, key_bitmap(wanted, _KEY), _KEY).where("__within").drop("__within").join(wanted, _KEY)
    texts = texts.select(*_KEY, F.split("__text", "\n", -1).alias("ls"), F.explode("x").alias("x")).select(
        *_KEY, "x.*", F.array_join(F.slice("ls", F.col("x.first") + 1, F.col("x.lines")), "\n").alias("text"),
        F.when(F.col("x.l"), F.slice("ls", F.col("x.above") + 1, F.col("x.first") - F.col("x.above"))).alias("before"),
        F.when(F.col("x.r"), F.slice("ls", F.col("x.first") + F.col("x.lines") + 1, F.col("x.below") - F.col("x.first") - F.col("x.lines"))).alias("after"),
    )
    salts = F.ceil(F.col("n") / _SALT).cast("int")
    salt = F.when(F.col("mine"), F.array(F.pmod(F.hash(*_KEY, "no"), salts))).otherwise(F.sequence(F.lit(0), salts - 1))
    texts = texts.withColumn("salt", F.explode(salt)).select(*_KEY, "no", "first", "lines", "words", "mine", "hash", "salt", "text", "before", "after")
    kept_first = Window.partitionBy("hash", "salt").orderBy("mine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    texts = texts.withColumn("held", F.first(F.struct("mine", "text", "before", "after")).over(kept_first)).where("mine and not held.mine and text = held.text")
    none = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("words"))
    equal = texts.select(
        *_KEY, "no", "first", "lines", "words",
        F.when(F.col("before").isNotNull(), _common("before", "held.before", True)).otherwise(none).alias("up"),
        F.when(F.col("after").isNotNull(), _common("after", "held.after", False)).otherwise(none).alias("down"),
    )
    all_words = F.sum(F.col("words") + F.col("up.words") + F.col("down.words")).over(run)
    gone = _runs(stash(equal, "chunks-equal")).withColumn("all", all_words).where(F.col("all") >= min_words)
    return gone.select(*_KEY, (F.col("first") - F.col("up.lines")).alias("first"), (F.col("lines") + F.col("up.lines") + F.col("down.lines")).alias("lines"))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """All rows and columns of the documents, texts without passages that another document had first.

    n_chars, if there is such a column, is counted anew where lines went.  Adds the struct __removed(lines, words)
    of counts.  A null or empty text stays as it is, and so do lines without words beside passages that stay.
    Repeated rows (equal doc_id and text) count as one document and come out alike, rows of one doc_id with different
    texts do not lose lines to each other; a null doc_id sorts first.
    """
    th = F.xxhash64(F.col("text").cast("string"))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    keyed = docs.select(own.alias("__id"), th.alias("__th"), F.col("text").cast("string").alias("__text")).where("__text is not null")
    gone = repeated_lines(keyed, **how)
    lists = stash(gone.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "lines")).alias("__cut")), "chunks-lists")
    marked = within(docs.withColumns({"__id": own, "__th": th}), key_bitmap(lists, _KEY), _KEY)
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    zero = F.struct(F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("words"))
    whole = marked.where("not __within").select(*out.values(), zero.alias("__removed"))
    met = marked.where("__within").join(lists, _KEY, "left")
    met = met.withColumn("__lines", F.when(F.col("__cut").isNotNull(), F.split("text", "\n", -1)))
    ranges = F.transform("__cut", lambda c: F.sequence(c["first"], c["first"] + c["lines"] - 1))
    met = met.withColumn("__gone", F.array_distinct(F.flatten(ranges)))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    met = met.withColumn("__left", F.when(F.col("__cut").isNotNull(), F.array_join(F.transform(places, lambda i: F.get("__lines", i)), "\n")))
    went = F.aggregate("__gone", F.lit(0), lambda n, i: n + _words(F.get("__lines", i)))
    removed = F.struct(F.size("__gone").cast("long").alias("lines"), went.cast("long").alias("words"))
    out["text"] = F.coalesce("__left", "text").alias("text")
    if "n_chars" in out:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.coalesce(F.length("__left").cast(kind), "n_chars").alias("n_chars")
    return whole.unionAll(met.select(*out.values(), F.when(F.col("__cut").isNotNull(), removed).otherwise(zero).alias("__removed")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's text after line dedup, and how many lines and words went."""
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id", "text", F.col("__removed.lines").alias("n_lines_removed"), F.col("__removed.words").alias("n_words_removed")
    )


def stage(docs: DataFrame) -> DataFrame:
    """The documents with shorter texts, and no other column than they had."""
    return dedup_lines(docs).drop("__removed")


#: The query in DuckDB's SQL.
ORACLE_SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM docs),
l2 AS (SELECT *, md5(line) AS h, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM l1),
l3 AS (SELECT *, coalesce(lag(h) OVER d, '') AS before, lead(w) OVER d AS nw FROM l2 WINDOW d AS (PARTITION BY doc_id, text ORDER BY i)),
l4 AS (SELECT *, substr(md5(before || h), 1, 1) < 'c' OR w >= 10 OR coalesce(nw, 99) >= 10 AS ends FROM l3),
l5 AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw FROM l4),
c0 AS (SELECT doc_id, text, n, raw, min(i) AS a, max(i) AS b, sum(w) AS words, string_agg(line, chr(10) ORDER BY i) AS body FROM l5 GROUP BY ALL HAVING sum(w) > 0),
c1 AS (SELECT *, row_number() OVER d AS no, coalesce(lag(a, 2) OVER d, 1) AS above, coalesce(lead(b) OVER d, n) AS below
       FROM c0 WINDOW d AS (PARTITION BY doc_id, text ORDER BY raw)),
kept AS (SELECT body, min(doc_id) AS keeper FROM c0 GROUP BY body HAVING min(doc_id) <> max(doc_id)),
held AS (SELECT body, any_value(keeper) AS keeper, arg_min({'t': text, 'a': a, 'b': b, 'above': above, 'below': below}, no) AS k
         FROM c1 JOIN kept USING (body) WHERE doc_id = keeper GROUP BY body),
r0 AS (SELECT c1.*, keeper, k, no - row_number() OVER (PARTITION BY doc_id, text ORDER BY no) AS run FROM c1 JOIN held USING (body) WHERE doc_id <> keeper),
r1 AS (SELECT *, no = min(no) OVER g AS l, no = max(no) OVER g AS r FROM r0 WINDOW g AS (PARTITION BY doc_id, text, run)),
x0 AS (SELECT r1.*, list_reverse(d.ls[above:a - 1]) AS lx, list_reverse(e.ls[k.above:k.a - 1]) AS ly, d.ls[b + 1:below] AS rx, e.ls[k.b + 1:k.below] AS ry
       FROM r1 JOIN docs d ON d.doc_id = r1.doc_id AND d.text = r1.text JOIN docs e ON e.doc_id = keeper AND e.text = k.t),
x1 AS (SELECT * EXCLUDE (lx, ly, rx, ry), CASE WHEN l THEN lx[1:len(list_filter(range(1, least(len(lx), len(ly)) + 1), lambda j: lx[1:j] = ly[1:j]))] ELSE [] END AS lx,
       CASE WHEN r THEN rx[1:len(list_filter(range(1, least(len(rx), len(ry)) + 1), lambda j: rx[1:j] = ry[1:j]))] ELSE [] END AS rx FROM x0),
x2 AS (SELECT *, list_transform(lx, lambda t: len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS lw,
       list_transform(rx, lambda t: len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS rw FROM x1),
x3 AS (SELECT *, coalesce(list_max(list_filter(range(1, len(lw) + 1), lambda j: lw[j] > 0)), 0) AS up, coalesce(list_max(list_filter(range(1, len(rw) + 1), lambda j: rw[j] > 0)), 0) AS down,
       sum(words + coalesce(list_sum(lw), 0) + coalesce(list_sum(rw), 0)) OVER (PARTITION BY doc_id, text, run) AS al FROM x2),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(a - up, b + down + 1)) AS i FROM x3 WHERE al >= 30),
left_over AS (SELECT l2.doc_id, l2.text, string_agg(line, chr(10) ORDER BY l2.i) FILTER (gone.i IS NULL) AS t,
       count(gone.i) AS nl, coalesce(sum(w) FILTER (gone.i IS NOT NULL), 0) AS nw
       FROM l2 LEFT JOIN gone ON gone.doc_id = l2.doc_id AND gone.text = l2.text AND gone.i = l2.i GROUP BY ALL)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text,
       coalesce(nl, 0)::BIGINT AS n_lines_removed, coalesce(nw, 0)::BIGINT AS n_words_removed
FROM documents d LEFT JOIN left_over o ON o.doc_id = d.doc_id AND o.text = d.text
"""
