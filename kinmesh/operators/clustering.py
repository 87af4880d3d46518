"""Connected components of matched pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.functions.text import id_text
from kinmesh.operators.results import ClusteringResult, LinkageResult
from kinmesh.operators.skew import join_hot
from kinmesh.storage import stash


#: Edges that one task may hold.
SMALL = 1_000_000


def smallest_reachable(edges: DataFrame, most_rounds: int = 200, small: int = SMALL) -> DataFrame:
    """(node, root): the smallest node of each linked node's component.

    Edges are (a, b).  Up to `small` edges, which are counted, are one task's work.  Beyond that, large-star and
    small-star steps alternate; they end as stars after a number of rounds in the logarithm of the nodes, each written
    to the shared folder.  Only minima by node are aggregated, and a node with many edges is no join's hot key.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stash(edges.where("a <> b").select(a, b).distinct(), "edges")
    if edges.count() <= small:
        return _in_one_task(edges)

    def minima(df: DataFrame) -> DataFrame:
        return stash(df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "edges-minima")

    before = None
    for _ in range(most_rounds):
        both = stash(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges-both")
        larger = join_hot(both, minima(both), ["a"]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        starred = stash(larger.where("a > b").distinct(), "edges-starred")
        low = minima(starred)
        below = join_hot(starred, low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stash(below.union(low.select("a", F.col("m").alias("b"))).where("a > b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError("components did not settle")


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["a"].dataType.simpleString()

    def unite(batches):
        import pyarrow as pa

        up: dict = {}

        def root(x):
            while (y := up[x]) != x:
                up[x] = x = up[y]
            return x

        column = None
        for batch in batches:
            column = batch.column(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up.setdefault(x, x)
                up.setdefault(y, y)
                p, q = root(x), root(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
        if up:
            nodes = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, column), pa.array([root(x) for x in nodes], column)], ["node", "root"])

    return edges.coalesce(1).mapInArrow(unite, f"node {kind}, root {kind}")


def numbered(roots: DataFrame) -> DataFrame:
    """(root, cluster_id) with ids 0, 1, ... by root.

    Roots are sorted by range partitions; an id is the row's place in its partition plus the rows of those before, so
    no task sees all roots.  Only one count for each partition comes to the driver.
    """
    spark = roots.sparkSession
    sorted_roots = stash(
        roots.distinct().repartitionByRange("root").sortWithinPartitions("root").withColumn("p", F.spark_partition_id()), "roots"
    )
    counts = sorted(tuple(r) for r in sorted_roots.groupBy("p").count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    place = F.row_number().over(Window.partitionBy("p").orderBy("root"))
    offsets = F.broadcast(spark.createDataFrame(starts, "p int, start long"))
    return sorted_roots.join(offsets, "p").select("root", (F.col("start") + place - 1).cast("int").alias("cluster_id"))


def label_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """record_id and cluster_id of all nodes and of the ends of edges."""
    found = stash(smallest_reachable(edges), "components")
    ends = edges.select(F.col("a").alias("record_id")).union(edges.select(F.col("b").alias("record_id")))
    everyone = nodes.select(F.col(nodes.columns[0]).alias("record_id")).union(ends).distinct()
    rooted = everyone.join(found, F.col("record_id") == F.col("node"), "left").select("record_id", F.coalesce("root", "record_id").alias("root"))
    rooted = stash(rooted, "rooted")
    return rooted.join(numbered(rooted.select("root")), "root").select("record_id", "cluster_id")


def connected_components(result: LinkageResult, *, all_record_ids: DataFrame | None = None) -> ClusteringResult:
    """Clusters of matches.  Records are those of all outcomes, errors included, and of all_record_ids' first column."""
    out = result.outcomes
    nodes = out.select(F.col("left_id").alias("id")).union(out.select(F.col("right_id").alias("id")))
    if all_record_ids is not None:
        nodes = nodes.union(all_record_ids.select(id_text(all_record_ids, all_record_ids.columns[0]).alias("id")))
    edges = out.where(F.col("error").isNull() & F.col("match")).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    return ClusteringResult(label_components(edges, nodes.distinct()))


class ConnectedComponentsClusterer:
    def cluster(self, result: LinkageResult) -> ClusteringResult:
        return connected_components(result)
