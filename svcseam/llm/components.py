"""Connected components of an undirected link table, by large-star / small-star
rounds (Kiveris et al. 2014): every round is two grouped minima and joins, no
node's neighbours are ever collected, and stars around hot nodes are aggregated
partially before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over (u, v): neighbours of each node are linked to the
    smallest of them and the node itself (larger neighbours, or all others)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    pairs = near.where("v > u") if large else near
    out = pairs.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return (out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); component is
    the smallest node reachable. Nulls and self links are ignored; no edges give
    an empty table. The rounds end when nothing changes; not ending within
    ``max_rounds`` (log^2 of the nodes suffices) is an error, never a wrong result."""
    e = kept(edges.where("u is not null and v is not null and u <> v")
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    for _ in range(max_rounds):
        e = kept(_star(_star(e, large=True), large=False))
        now = tuple(e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                          F.max("v")).first())
        if now == sign or not now[0]:
            return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .union(e.select(F.col("v"), F.col("v"))).distinct())
        sign = now
    raise RuntimeError("components did not converge")
