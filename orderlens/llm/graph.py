"""Connected components of an edge table, without collecting edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def relabelled(links: DataFrame, star: DataFrame) -> DataFrame:
    """The distinct links (u, v), u the larger, between the ends' smallest nodes by a star in which every node has a row or is one's end."""
    names = star.union(star.select("v", "v").distinct())
    one = links.join(names.select("u", F.col("v").alias("a")), "u").select("a", F.col("v").alias("u"))
    both = one.join(names.select("u", F.col("v").alias("b")), "u").where("a <> b")
    return both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def stars(edges: DataFrame, dense: float = 4) -> DataFrame:
    """Turn links (u, v) into stars (u, v), each linking a node u to the smallest node v of its component; a smallest node has no row.

    Where there are over `dense` links a node, a round first takes one link of each node, the one to its smallest neighbour (Borůvka's step). These join every node to another, so that
    the links between what they join, which the next round takes, are of half as many nodes at most; the steps of alternated() see a link a node and never all links.
    """
    held = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    named = None
    while True:
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends, nodes = both.agg(F.count(F.lit(1)), F.approx_count_distinct("u")).first()
        thin = ends <= 2 * dense * nodes
        star = alternated(held if thin else keep(both.groupBy("u").agg(F.min("v").alias("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
        if not thin:
            held = keep(relabelled(held, star), instead_of=held)
        if named is None:
            named = star
        elif ends:
            # Ends of earlier stars that aren't the smallest any more go on to those that are.
            on = star.select(F.col("u").alias("v"), F.col("v").alias("next"))
            named = keep(named.join(on, "v", "left").select("u", F.coalesce("next", "v").alias("v")).union(star))
        if thin:
            return named


def alternated(held: DataFrame) -> DataFrame:
    """The stars of a kept table of distinct links (u, v), u the larger, which it deletes, by the large-star and the small-star step in turn (Kiveris and others, 2014).

    Each keeps the components and links nodes to smaller ones, until nothing changes. A step is one aggregation (combined before the shuffle) and one
    equi-join, which AQE splits where a node is hot; every round's edges are written to the shared folder.
    """
    before = None
    while True:
        state = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return held
        before = state
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        held = keep(small.where("u <> v").distinct(), instead_of=held)
