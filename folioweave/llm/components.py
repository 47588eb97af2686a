"""Connected components over an edge table, by alternating star contractions.

No step holds more than the edges that remain; each round is written to the shared folder and the driver
sees counts only. A node in the middle of a large star is met by aggregation, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    In each round every node points at the smallest of itself and its neighbours, and an edge moves to what
    its ends point at; the ends' own pointers are kept as edges. Loops and repeats go. When only stars are
    left, their middles are the answer. The pointers are tables of their own so that Spark can split the joins
    with them at hot nodes.
    """
    now = work.put(f"{name}/0", edges.filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    step = 0
    while True:
        step += 1
        # large star: neighbours above a node are hung on the least of node and neighbours
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        least = work.put(f"{name}/{step}l", both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).selectExpr("n", "least(n, m) AS m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).selectExpr("m AS a", "b").distinct()
        large = work.put(f"{name}/{step}a", large)
        # small star: neighbours below a node, and the node, are hung on the least of those
        low = work.put(f"{name}/{step}s", large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m")))
        small = large.join(low, F.col("b") == F.col("n")).selectExpr("m AS a", "explode(array(a, b)) AS b").filter("a <> b").distinct()
        then = work.put(f"{name}/{step}b", small)
        if _are_stars(then):
            return then.selectExpr("b AS node", "a AS root").unionByName(then.selectExpr("a AS node", "a AS root").distinct())
        work.drop(*([f"{name}/{step - 1}b"] if step > 1 else [f"{name}/0"]), f"{name}/{step}a", f"{name}/{step}l", f"{name}/{step}s")
        now = then


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is a root that hangs on none or a leaf that hangs on one."""
    ends = edges.selectExpr("explode(array(named_struct('n', a, 'up', 0, 'down', 1), named_struct('n', b, 'up', 1, 'down', 0))) AS e").select("e.*")
    roles = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0
