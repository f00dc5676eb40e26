"""Fixpoints over edges, with the frontier as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.scans import shared_dir


def written(df: DataFrame) -> DataFrame:
    """Cuts the plan by a table in the shared folder."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def recursive_union(start: DataFrame, step, max_rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE under UNION: ``step`` maps the newest rows to more; rows seen before are dropped; ends when none is new.

    Only a row count per round comes to the driver.
    """
    seen = new = written(start.distinct())
    for _ in range(max_rounds):
        new = written(step(new).distinct().join(seen, seen.columns, "left_anti"))
        if new.limit(1).count() == 0:
            break
        seen = written(seen.unionByName(new))
    return seen


def bfs_levels(edges: DataFrame, source: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """node, level: hops from the source nodes along src -> dst."""
    seen = frontier = written(source.toDF("node").distinct().withColumn("level", F.lit(0)))
    for level in range(1, max_rounds):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.limit(1).count() == 0:
            break
        seen = written(seen.unionByName(frontier))
    return seen


def shortest_paths(edges: DataFrame, source: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """node, cost: least total weight from the source nodes (weights not negative), by relaxation of improved nodes only."""
    best = frontier = written(source.toDF("node").distinct().withColumn("cost", F.lit(0.0)))
    for _ in range(max_rounds):
        reach = frontier.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("weight")).alias("cost"))
        old = best.withColumnRenamed("cost", "old")
        frontier = written(reach.join(old, "node", "left").filter(F.col("old").isNull() | (F.col("cost") < F.col("old"))).select("node", "cost"))
        if frontier.limit(1).count() == 0:
            break
        best = written(best.unionByName(frontier).groupBy("node").agg(F.min("cost").alias("cost")))
    return best


def topological_levels(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """node, level: the longest path that ends in the node; nodes on or behind a cycle are absent."""
    left = written(edges.select("src", "dst").distinct())
    nodes = written(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    out = None
    for level in range(max_rounds):
        ready = written(nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.limit(1).count() == 0:
            break
        out = ready if out is None else written(out.unionByName(ready))
        nodes = written(nodes.join(ready.select("node"), "node", "left_anti"))
        left = written(left.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
    return out if out is not None else nodes.limit(0).withColumn("level", F.lit(0))


def min_label_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """node, component: the smallest node connected with it, by label propagation with pointer jumping."""
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = written(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        near = both.join(label, both["dst"] == label["node"]).groupBy("src").agg(F.min("component").alias("m")).withColumnRenamed("src", "node")
        hooked = label.join(near, "node").select("node", F.least("component", "m").alias("component"))
        hooked = written(hooked)
        jumped = hooked.select("node", F.col("component").alias("c")).join(hooked.select(F.col("node").alias("c"), F.col("component").alias("cc")), "c")
        new = written(jumped.select("node", F.least("c", "cc").alias("component")))
        if new.join(label.withColumnRenamed("component", "old"), "node").filter("component <> old").limit(1).count() == 0:
            return new
        label = new
    return label


def has_cycle(edges: DataFrame) -> bool:
    """Whether any cycle exists, of any length: nodes are left when all that hang on no cycle have been taken off in turn."""
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    return nodes.join(topological_levels(edges).select(F.col("node").alias("src")), "src", "left_anti").limit(1).count() > 0


def shortest_routes(edges: DataFrame, source: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """node, cost, path: a least-cost path from the source nodes, as an array of nodes; of equal costs the path with fewer nodes, then the least one. Weights are over zero."""
    best = frontier = written(source.toDF("node").distinct().select("node", F.lit(0.0).alias("cost"), F.array("node").alias("path")))
    rank = F.struct("cost", F.size("path").alias("n"), "path")
    for _ in range(max_rounds):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.array_append("path", F.col("dst")).alias("path"))
        reach = step.groupBy("node").agg(F.min(rank).alias("new"))
        old = best.select("node", rank.alias("old"))
        frontier = written(reach.join(old, "node", "left").filter(F.col("old").isNull() | (F.col("new") < F.col("old"))).select("node", "new.cost", "new.path"))
        if frontier.limit(1).count() == 0:
            break
        best = written(best.unionByName(frontier).groupBy("node").agg(F.min(rank).alias("b")).select("node", "b.cost", "b.path"))
    return best


def depth_first(edges: DataFrame, source: DataFrame, max_depth: int = 1000) -> DataFrame:
    """node, path: every path from the source nodes that visits no node twice; ordered by path they stand in depth-first order."""
    seen = frontier = written(source.toDF("node").distinct().select("node", F.array("node").alias("path")))
    for _ in range(max_depth):
        step = frontier.join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        frontier = written(step.select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")))
        if frontier.limit(1).count() == 0:
            break
        seen = written(seen.unionByName(frontier))
    return seen
