"""Connected components of a link table by alternating large-star and small-star rounds.

Only links are shuffled; nothing is collected. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SALTS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # small star: only neighbours below the node, which edges (a > b) already give
    low = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("m", F.least("u", "w"))
    # a node with very many neighbours meets its least one in SALTS places, and the planner may split those again;
    # salted rows compress so well that the planner would take them for small, so they are never broadcast
    salted = low.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["u", "salt"])
    moved = out.where((F.col("v") > F.col("u")) if large else (F.col("v") != F.col("m"))).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id on a link, component the smallest id reachable, itself included."""
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    edges = scratch.table(edges, "edges")
    mark = None
    while True:
        after = scratch.table(_star(_star(edges, True), False), "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = after
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
