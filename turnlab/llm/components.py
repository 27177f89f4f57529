"""Connected components of a graph that is only ever held in distributed tables."""

from pyspark.sql import functions as F

from turnlab.llm.common import cut


def connected_components(edges, most_rounds=60):
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node.

    Alternating star contraction: a round links each larger neighbour of a node to the smallest one, then each
    node and its smaller neighbours to the smallest, until the table stays the same (about log of the number of
    nodes rounds). Links never grow in number. The minimum of a hot node is combined before the shuffle, and its
    links are joined with one row, which adaptive execution splits. Each round is a written table, which goes when the
    next one is written.
    Nulls and loops are left out; no edges give no rows; repeated edges count once.
    """
    now = (edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
           .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = cut(now, "links")
    was = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if mark.n == 0 or mark == was:
            return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
                    .union(now.select("b", "b")).distinct())
        was = mark
        now = cut(_small_star(_large_star(now)), "links", read=[now])
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _large_star(links):
    """Links of each node's larger neighbours to the smallest node it knows."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .where("a != b").distinct())


def _small_star(links):
    """Links of each node and its smaller neighbours to the smallest of them (here a > b always)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
