"""Sources, records, gold pairs and candidate pairs from frames."""

from __future__ import annotations

import random
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.errors import DuplicateRecordId, EmptySource, UnknownIdColumn
from kinmesh.functions.text import Serializer, default_serializer, id_text

#: Candidate pairs: left is the indexed record, right the query.
PAIR_COLUMNS = ["left_id", "right_id", "similarity", "left_text", "right_text"]


#: Gold pairs that are split on the driver.
SHUFFLED = 50_000


def as_frame(frame) -> DataFrame:
    """A Spark DataFrame as it is; a pandas frame through the active session."""
    if isinstance(frame, DataFrame):
        return frame
    return SparkSession.getActiveSession().createDataFrame(frame)


@dataclass(frozen=True)
class Source:
    """A table, its id column, and how a row becomes text."""

    frame: object
    id_column: str
    serializer: Serializer | None = None


def read_records(source: Source, *, validate: bool = True) -> DataFrame:
    """id, text, fields (the row as it is) and pos (the order of the source: a Spark table's is that of whole-number ids, and
    of none else; a pandas frame's is that of its rows).

    Raises UnknownIdColumn, EmptySource or DuplicateRecordId, in that order.  One job checks the ids: a count by id
    with a partial aggregation, of which one offending row at most reaches the driver.
    """
    df = as_frame(source.frame)
    if source.id_column not in df.columns:
        raise UnknownIdColumn(f"no column {source.id_column!r} among {df.columns}")
    if validate:
        if df.isEmpty():
            raise EmptySource("the source has no rows")
        ids = df.select(id_text(df, source.id_column).alias("id"))
        if again := ids.groupBy("id").count().where("count > 1").limit(1).collect():
            raise DuplicateRecordId(f"id {again[0].id!r} comes {again[0]['count']} times")
    if not isinstance(source.frame, DataFrame):
        pos = F.monotonically_increasing_id()
    elif isinstance(df.schema[source.id_column].dataType, T.IntegralType):
        pos = F.col(f"`{source.id_column}`").cast("long")
    else:
        pos = F.lit(0).cast("long")  # ties go by id
    text = (source.serializer or default_serializer()).to_column(df)
    fields = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.select(
        id_text(df, source.id_column).alias("id"), text.alias("text"), fields.alias("fields"), pos.alias("pos")
    )


@dataclass(frozen=True)
class LabeledPairs:
    """Gold matches, (left, right) in order; a set."""

    pairs: DataFrame  # left_id, right_id

    @classmethod
    def from_pairs(cls, pairs: Iterable[tuple[str, str]], spark: SparkSession | None = None) -> LabeledPairs:
        spark = spark or SparkSession.getActiveSession()
        return cls(spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "left_id string, right_id string").distinct())

    @classmethod
    def from_frame(cls, frame, left_id: str, right_id: str) -> LabeledPairs:
        df = as_frame(frame)
        return cls(df.select(id_text(df, left_id).alias("left_id"), id_text(df, right_id).alias("right_id")).distinct())

    def split(self, *, test_size: float, seed: int | None = None) -> tuple[LabeledPairs, LabeledPairs]:
        """(train, test); test has round(test_size * n) pairs, half to even.

        Up to SHUFFLED pairs, which are counted, are put in order and shuffled by Python's generator with the seed, as a
        user of a list of pairs expects.  More are ordered by a hash of seed and pair, so the split is the same wherever
        it runs, and no pair reaches the driver: the hash below which pairs are for testing comes from counts of hash
        prefixes.
        """
        if not 0 <= test_size <= 1:
            raise ValueError("test_size must lie between 0 and 1")
        n = self.pairs.count()
        want = round(test_size * n)
        if n <= SHUFFLED:
            order = sorted(map(tuple, self.pairs.select("left_id", "right_id").collect()))
            random.Random(seed).shuffle(order)
            spark, kind = self.pairs.sparkSession, "left_id string, right_id string"
            return tuple(LabeledPairs(spark.createDataFrame(part, kind)) for part in (order[want:], order[:want]))
        salt = random.random() if seed is None else seed
        h = F.xxhash64(F.lit(str(salt)), "left_id", "right_id")
        marked = self.pairs.withColumns({"__slot": F.shiftrightunsigned(h, 48), "__h": h})
        # 65,536 slots at most come to the driver; ranks are counted within the one slot that the cut divides
        left, edge = want, None
        for slot, count in sorted((r[0], r[1]) for r in marked.groupBy("__slot").count().collect()):
            if left < count:
                edge = slot
                break
            left -= count
        if edge is None:
            test = F.lit(True)
            cut = marked
        else:
            from pyspark.sql import Window

            within = marked.where(F.col("__slot") == edge)
            rank = F.row_number().over(Window.partitionBy("__slot").orderBy("__h", "left_id", "right_id"))
            chosen = within.withColumn("__r", rank).where(F.col("__r") <= left).select("left_id", "right_id", F.lit(True).alias("__in"))
            cut = marked.join(chosen, ["left_id", "right_id"], "left")
            test = (F.col("__slot") < edge) | F.col("__in").isNotNull()
        keep = ["left_id", "right_id"]
        return LabeledPairs(cut.where(~test).select(keep)), LabeledPairs(cut.where(test).select(keep))


@dataclass(frozen=True)
class LabeledClasses:
    """Gold matches that are not written out: two records that share a label match, that of the smaller pos left.

    An id has one pos and no two ids the same.  A class of n records stands for n (n - 1) / 2 pairs; none of them is made
    to count them or to tell which candidates are among them.
    """

    members: DataFrame  # id, pos, label

    @property
    def pairs(self) -> DataFrame:
        """All pairs, whose number grows with the square of the classes."""
        a, b = (self._rows().select("label", F.col("id").alias(f"{s}_id"), F.col("pos").alias(f"{s}_pos")) for s in ("left", "right"))
        return a.join(b, "label").where("left_pos < right_pos").select("left_id", "right_id").distinct()

    def _rows(self) -> DataFrame:
        return self.members.where("id is not null and pos is not null and label is not null").select("id", "pos", "label").distinct()

    def _sets(self) -> DataFrame:
        return self._rows().groupBy("id").agg(F.min("pos").alias("pos"), F.collect_set("label").alias("labels"))

    def n(self) -> int:
        """The number of pairs; one that shares several labels counts once."""
        sizes = self._rows().groupBy("label").agg(F.count("*").alias("c"))
        total = sizes.agg(F.expr("coalesce(sum(c * (c - 1) div 2), 0)")).first()[0]
        several = self._sets().where(F.size("labels") > 1).select("id", F.explode("labels").alias("label"))
        a, b = (several.select("label", F.col("id").alias(c)) for c in ("a", "b"))
        again = a.join(b, "label").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
        return total - again.agg(F.expr("coalesce(sum(c - 1), 0)")).first()[0]

    def marked(self, keyed: DataFrame, directed: bool) -> DataFrame:
        """The rows, by key (k1, k2), with g: 1 if their key is gold, else 0."""
        sets = self._sets()
        for s in ("1", "2"):
            keyed = keyed.join(sets.select(F.col("id").alias(f"k{s}"), F.col("pos").alias(f"__p{s}"), F.col("labels").alias(f"__l{s}")), f"k{s}", "left")
        apart = F.col("__p1") < F.col("__p2") if directed else F.col("k1") != F.col("k2")
        g = F.coalesce(F.arrays_overlap("__l1", "__l2") & apart, F.lit(False)).cast("int")
        return keyed.withColumn("g", g).drop("__p1", "__p2", "__l1", "__l2")


def candidate_pairs_from_frame(frame, *, left: Source, right: Source, left_id: str, right_id: str, similarity: str | None = None) -> DataFrame:
    """Scored pairs with texts from a frame of id pairs; repeated pairs stay, NaN scores become null.

    A missing column or an id that its source does not have raises ValueError, the left side first.
    """
    df = as_frame(frame)
    for c in (left_id, right_id, *([similarity] if similarity else [])):
        if c not in df.columns:
            raise ValueError(f"no column {c!r} among {df.columns}")
    score = F.col(f"`{similarity}`").cast("double") if similarity else F.lit(None).cast("double")
    pairs = df.select(
        id_text(df, left_id).alias("left_id"), id_text(df, right_id).alias("right_id"), F.when(~F.isnan(score), score).alias("similarity")
    )
    for side, source in (("left", left), ("right", right)):
        texts = read_records(source).select(F.col("id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text"))
        if lost := pairs.join(texts, f"{side}_id", "left_anti").limit(1).collect():
            raise ValueError(f"the {side} source has no id {lost[0][f'{side}_id']!r}")
        pairs = pairs.join(texts, f"{side}_id")
    return pairs.select(PAIR_COLUMNS)
