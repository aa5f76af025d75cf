"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.runtime import stage, unstage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of ``edges`` the smallest node that it is joined to.

    Rounds of contraction: every node moves to the neighbour that comes first in a hash
    order, then edges are drawn between what nodes moved to. The hash order keeps the
    rounds few, whatever the shape and numbering; each round is written to the shared
    folder. Edges with a null end are left out; loops make single nodes.
    """
    kept = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    kept = stage(kept, "edges")
    # A node as (hash, id): the smaller one leads.
    node = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("id"))
    nodes = kept.select(F.col("u").alias("node")).unionAll(kept.select(F.col("v").alias("node"))).distinct()
    now = kept.where("u <> v").select(node("u").alias("u"), node("v").alias("v"))
    moves = []
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = stage(both.groupBy("u").agg(F.min("v").alias("v")).where("v < u"), "move")
        if step.isEmpty():
            unstage(step)
            break
        moves.append(step)
        to_u = step.select(F.col("u"), F.col("v").alias("nu"))
        to_v = step.select(F.col("u").alias("v"), F.col("v").alias("nv"))
        moved = now.join(to_u, "u", "left").select(F.coalesce("nu", "u").alias("u"), "v").join(to_v, "v", "left").select("u", F.coalesce("nv", "v").alias("v"))
        nxt = stage(moved.where("u <> v").distinct(), "edges")
        unstage(now)
        now = nxt
    where = nodes.select("node", node("node").alias("at"))
    for step in moves:
        where = where.join(step.select(F.col("u").alias("at"), "v"), "at", "left").select("node", F.coalesce("v", "at").alias("at"))
    where = stage(where, "components")
    low = where.groupBy("at").agg(F.min("node").alias("component"))
    return where.join(low, "at").select("node", "component")
