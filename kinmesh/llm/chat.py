"""Preference formatting of chosen and rejected conversations.

The turns of both are aligned by number; the first number at which they differ ends their common prefix.  The prefix
is rendered once, as prompt; what follows gives the two completions, in which only the assistant's words are trained
on (``train`` has their [start, end) places, in characters; all else is masked).  Text is rendered in parts of at most
``part`` turn numbers, so a conversation of any length is no single row.

Turns are dealt out by (pair, turn) and rendered by (pair, side, part).  What all turns of a pair need, where its sides
part and how long its prefix is, comes from partial aggregates, and goes to pairs with very many turns by broadcast, so
that none is one task's work.  Turns of one number are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.operators.skew import join_hot

from .common import stash, table

START, STOP = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """Text in which the template's marks are ordinary text."""
    for mark in (START, STOP):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<|", "< |")))
    return text


def preferences(turns: DataFrame, *, part: int = 256) -> DataFrame:
    """From (pair_id, side, turn, role, text) with side chosen or rejected: rows of pair_id, section, part, n_turns,
    text, train and n_prefix.

    section is prompt, chosen or rejected.  Sections without turns have no rows.  A null turn counts as -1, null role
    and text as ''.  Turns of one number come in the order of role and text.  Rows without a pair_id are no
    conversation and are left out.  A side that is not there shares no prefix.
    """
    rows = turns.where(F.col("pair_id").isNotNull()).select(
        "pair_id", "side", F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"),
        _plain(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        _plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    said = F.array_sort(F.collect_list(F.when(F.col("side") == "chosen", F.struct("role", "text")))).alias("chosen")
    against = F.array_sort(F.collect_list(F.when(F.col("side") == "rejected", F.struct("role", "text")))).alias("rejected")
    met = stash(rows.groupBy("pair_id", "turn").agg(said, against), "chat-turns")
    first = F.min(F.when(F.col("chosen") != F.col("rejected"), F.col("turn"))).alias("from")
    apart = stash(met.groupBy("pair_id").agg(first, F.count("*").alias("n")), "chat-apart")
    met = join_hot(met, apart, ["pair_id"]).drop("n")
    common = F.col("from").isNull() | (F.col("turn") < F.col("from"))
    section = lambda name, of: F.struct(F.lit(name).alias("section"), F.col(of).alias("said"))
    sides = F.when(common, F.array(section("prompt", "chosen"))).otherwise(
        F.array(section("chosen", "chosen"), section("rejected", "rejected"))
    )
    each = met.select("pair_id", "turn", F.explode(sides).alias("s")).select("pair_id", "turn", "s.section", "s.said").where(F.size("said") > 0)

    def render(x: Column) -> Column:
        head = F.concat(F.lit(START), x["role"], F.lit("\n"))
        return F.struct(
            F.concat(head, x["text"], F.lit(STOP + "\n")).alias("text"), F.length(head).alias("a"),
            (F.length(head) + F.length(x["text"]) + len(STOP)).alias("b"), (x["role"] == "assistant").alias("own"),
        )

    each = each.select("pair_id", "section", "turn", F.floor(F.col("turn") / part).alias("part"), F.transform("said", render).alias("said"))
    parts = each.groupBy("pair_id", "section", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("t"))
    parts = parts.withColumn("t", F.flatten(F.transform("t", lambda x: x["said"])))
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    zero = F.from_json(F.lit('{"at":0,"spans":[]}'), kind)

    def step(acc: Column, x: Column) -> Column:
        span = F.struct((acc["at"] + x["a"]).alias("start"), (acc["at"] + x["b"]).alias("end"))
        more = F.when(x["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(x["text"])).alias("at"), more.alias("spans"))

    spans = F.aggregate("t", zero, step)["spans"]
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = parts.select(
        "pair_id", "section", "part", F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"),
        F.when(F.col("section") == "prompt", none).otherwise(spans).alias("train"),
    )
    prefix = F.coalesce(F.sum(F.when(common, F.size("chosen"))), F.lit(0)).cast("long").alias("n_prefix")
    shared = stash(met.groupBy("pair_id").agg(prefix, F.count("*").alias("n")), "chat-prefix")
    return join_hot(out, shared, ["pair_id"]).drop("n")


def neighbours(conversations: DataFrame) -> DataFrame:
    """Turns of conversations 2k as chosen and 2k + 1 as rejected of pair k, the pairing that the tables have."""
    conv = F.col("conv_id").cast("long")
    return conversations.select(
        F.floor(conv / 2).alias("pair_id"), F.when(F.pmod(conv, F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "turn", "role", "text",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: prompts and completions of all pairs of neighbouring conversations; train as text, start-end by commas."""
    got = preferences(neighbours(table(spark, sf_dir, "conversations")))
    spans = F.array_join(F.transform("train", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return got.withColumn("train", spans)


#: The query in DuckDB's SQL.
ORACLE_SQL = """
WITH r AS (SELECT conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, coalesce(turn, -1) AS turn,
  replace(replace(coalesce(role, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS role,
  replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT pair_id, turn, list({'r': role, 't': text} ORDER BY role, text) FILTER (side = 'chosen') AS c,
  list({'r': role, 't': text} ORDER BY role, text) FILTER (side = 'rejected') AS j FROM r GROUP BY ALL),
f AS (SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM j) AS apart FROM g GROUP BY ALL),
m AS (SELECT r.*, apart IS NULL OR turn < apart AS common FROM r JOIN f USING (pair_id)),
s AS (SELECT pair_id, CASE WHEN common THEN 'prompt' ELSE side END AS section, turn, role, text,
  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS whole FROM m WHERE NOT common OR side = 'chosen'),
w AS (SELECT *, coalesce(sum(length(whole)) OVER (PARTITION BY pair_id, section, floor(turn / 256) ORDER BY turn, role, text
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS a FROM s),
o AS (SELECT pair_id, section, floor(turn / 256)::BIGINT AS part, count(*) AS n_turns, string_agg(whole, '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg(a::BIGINT || '-' || (a + length(text) + 10)::BIGINT, ',' ORDER BY turn, role, text) FILTER (role = 'assistant' AND section <> 'prompt'), '') AS train
  FROM w GROUP BY ALL)
SELECT o.*, coalesce((SELECT count(*) FROM s WHERE s.pair_id = o.pair_id AND section = 'prompt'), 0) AS n_prefix FROM o
"""
