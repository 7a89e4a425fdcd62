"""PageRank over directed edges with three ways to deal out resets."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.lineage import cut

RESET = 0.15
MODES = ("sources", "growing", "inlinks")


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree``: edges that leave a node, repeated edges counted."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``node, neighbours``: where a node's edges lead, sorted, repeated edges kept.

    A list is one value, so it has to fit a task; ``weighted`` has the same edges as rows.
    """
    return edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def weighted(edges: DataFrame) -> DataFrame:
    """``src, dst, w``: the share of a node's score that each of its neighbours gets."""
    merged = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    return merged.join(degrees(edges).withColumnRenamed("node", "src"), "src").select("src", "dst", (F.col("m") / F.col("degree")).alias("w"))


def _moves(edges: DataFrame, mode: str, reset: float, parts: int) -> DataFrame:
    """``src, dst, w, r``, dealt and sorted by source: what a node with a score hands on in a step is ``w`` of the score, and ``r``.

    Resets are edges from a node to itself that carry nothing of the score, so
    a step reads the scores once. Edges are dealt once: repeated ones are
    merged, degrees summed and resets added where a source's edges lie.
    """
    rows = edges.where(F.col("src").isNotNull()).select("src", "dst", F.lit(1).alias("edge"))
    if mode == "growing":  # nodes without edges that leave them are reset, too
        rows = rows.unionByName(edges.where(F.col("dst").isNotNull()).select(F.col("dst").alias("src"), "dst", F.lit(0).alias("edge")).distinct())
    dealt = rows.repartition(parts, "src").groupBy("src", "dst", "edge").agg(F.count(F.lit(1)).alias("m"))
    degree = F.sum(F.when(F.col("edge") > 0, F.col("m"))).over(Window.partitionBy("src"))
    move = F.struct("dst", (F.col("m") / degree).alias("w"), F.lit(0.0).alias("r"))
    if mode == "inlinks":
        return dealt.select("src", "dst", move["w"].alias("w"), move["r"].alias("r"))
    back = F.struct(F.col("src").alias("dst"), F.lit(0.0).alias("w"), F.lit(reset).alias("r"))
    first = F.row_number().over(Window.partitionBy("src").orderBy("src")) == 1
    held = dealt.select("src", move.alias("move"), first.alias("first"), (F.col("edge") > 0).alias("edge"))
    both = F.concat(F.when(F.col("edge"), F.array("move")).otherwise(F.array()), F.when(F.col("first"), F.array(back)).otherwise(F.array()))
    return held.select("src", F.inline(both))


def _step(moves: DataFrame, scores: DataFrame, mode: str, reset: float) -> DataFrame:
    carried = F.sum(F.lit(1 - reset) * F.col("score") * F.col("w") + F.col("r"))
    joined = moves.join(scores, moves.src == scores.node)
    return joined.groupBy(F.col("dst").alias("node")).agg((carried + F.lit(reset) if mode == "inlinks" else carried).alias("score"))


def pagerank_steps(edges: DataFrame, iterations: int = 10, mode: str = "sources", reset: float = RESET, every: int = 5):
    """Scores ``node, score`` that enter each iteration, and at last the result.

    Every source starts at 1. A step adds up, for each node, what its incoming
    edges carry, and resets: to all sources (``sources``), to every node that
    has a score (``growing``), or to nodes with incoming edges (``inlinks``).
    Lineage is cut ``every`` so many steps. Weights are computed once and held
    dealt and sorted by source in the executors' memory and on their disks, so
    a step moves scores only; what an executor loses is worked out again.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moves = _moves(edges, mode, reset, parts).sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
    scores = moves.where("w > 0").select(F.col("src").alias("node")).distinct().withColumn("score", F.lit(1.0))
    for i in range(iterations):
        yield scores
        scores = _step(moves, scores, mode, reset)
        if (i + 1) % every == 0 and i + 1 < iterations:
            scores = cut(scores)
    yield scores


def pagerank(edges: DataFrame, iterations: int = 10, mode: str = "sources", reset: float = RESET) -> DataFrame:
    """``node, score`` after so many iterations."""
    scores = None
    for scores in pagerank_steps(edges, iterations, mode, reset):
        pass
    return scores


def progress(edges: DataFrame, iterations: int = 10, mode: str = "sources", reset: float = RESET) -> DataFrame:
    """``iteration, n, high, low, mean`` of the scores that enter each iteration."""
    rows = None
    for i, scores in enumerate(pagerank_steps(edges, iterations, mode, reset, every=2)):
        if i == iterations:
            break
        row = scores.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("high"), F.min("score").alias("low"), F.avg("score").alias("mean"))
        row = row.select(F.lit(i).alias("iteration"), "n", "high", "low", "mean")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def ends(scores: DataFrame, k: int = 3) -> DataFrame:
    """The first and the last ``k`` nodes, by node, with ``place``."""
    first = scores.orderBy("node").limit(k).select(F.lit("first").alias("place"), "node", "score")
    return first.unionByName(scores.orderBy(F.desc("node")).limit(k).select(F.lit("last").alias("place"), "node", "score"))
