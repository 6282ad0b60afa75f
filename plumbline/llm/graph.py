"""Connected components as DataFrame operations: alternating large and small stars.

Every round is two aggregations with map-side combine and two equi joins; no neighbour list is
ever gathered in a row, and nothing goes to the driver but a count and a checksum.  The links of
a hub share a join key; that they are split over several tasks is left to the adaptive
skew join.  Each round is written to the shared workspace, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Workspace

#: The stars converge in a logarithmic number of rounds; this only guards against a fault.
MAX_ROUNDS = 60
#: Links of a shuffle's partition.
LINKS = 50_000


def _state(df: DataFrame) -> tuple:
    row = df.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _large_star(e: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.filter("v > u")
        .join(least, "u")
        .select(F.col("m").alias("a"), F.col("v").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges have a < b."""
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    moved = e.join(least, "b").select(F.col("m").alias("m"), F.col("a").alias("x"))
    own = least.select("m", F.col("b").alias("x"))
    return (
        moved.unionByName(own)
        .filter("m <> x")
        .select(F.col("m").alias("a"), F.col("x").alias("b"))
        .distinct()
    )


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``edges(a, b)`` (long) to ``(node, root)``: root is the smallest node reachable.

    Nulls, self links and repeated links are ignored; nodes without a link to another node
    do not appear.  An empty input gives an empty result.
    """
    e = ws.write(
        edges.filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    before = _state(e)
    if before[0] == 0:
        return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(MAX_ROUNDS):
        with ws.dealt(2 * before[0], LINKS):
            nxt = ws.write(_small_star(_large_star(e)), before[0])
        ws.drop(e)
        e, after = nxt, _state(nxt)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
