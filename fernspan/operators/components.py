"""Connected components by contraction: every vertex points to the vertex of least priority around it, edges are rewritten to the pointers, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernspan.session import Kept

#: Contractions after which something must be wrong. In every other round priorities are drawn anew, so that a constant share of
#: the vertices that still have an edge goes, in expectation, whatever the graph and its ids: twice their log2 suffices. In
#: the rounds between the ids themselves are priorities, which ends the stars about small ids at once.
MOST_ROUNDS = 200


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(v, component) for every vertex of an undirected edge list of longs; component is the smallest vertex that v reaches.

    Loops and repeated edges are harmless and null ends are ignored.  A round costs the same shuffles whatever the graph, and
    rounds grow with the logarithm of the vertices; running out of ``MOST_ROUNDS`` raises.  Nothing is collected but one
    test a round; every round's tables are written to the shared folder, and both sides of each join come from an exchange,
    so that AQE can split the rows of a hub.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    start = Kept(edges.filter(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "cc_edges")
    labels: Kept | None = None
    e = Kept(start.df.filter("u <> v"), "cc_edges")
    loops = start.df.filter("u = v").select(F.col("u").alias("v"))
    rounds = 0
    while not e.df.isEmpty():
        if (rounds := rounds + 1) > MOST_ROUNDS:
            raise RuntimeError(f"components: edges are left after {MOST_ROUNDS} contractions")
        rank = lambda x, r=rounds: F.struct((F.xxhash64(x, F.lit(r)) if r % 2 == 0 else F.col(x)).alias("h"), F.col(x).alias("x"))
        both = e.df.unionAll(e.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = Kept(both.groupBy("u").agg(F.min(rank("v")).alias("m")).select(F.col("u").alias("k"), F.least("m", rank("u"))["x"].alias("m")), "cc_parent")
        # one pointer jump, so that more goes in a round
        jump = p.df.select(F.col("k").alias("k2"), F.col("m").alias("m2"))
        parent = Kept(p.df.join(jump, F.col("m") == F.col("k2"), "left").select("k", F.coalesce("m2", "m").alias("m")), "cc_parent")
        p.drop()
        if labels is None:
            new = Kept(parent.df.select(F.col("k").alias("v"), F.col("m").alias("root")), "cc_labels")
        else:
            new = Kept(labels.df.join(parent.df, F.col("root") == F.col("k"), "left").select("v", F.coalesce("m", "root").alias("root")), "cc_labels")
            labels.drop()
        labels = new
        q = parent.df.select(F.col("k").alias("k2"), F.col("m").alias("m2"))
        moved = e.df.join(parent.df, F.col("u") == F.col("k")).select("v", F.col("m").alias("x")).join(q, F.col("v") == F.col("k2")).select("x", F.col("m2").alias("y"))
        nxt = Kept(moved.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "cc_edges")
        e.drop()
        parent.drop()
        e = nxt
    own = loops.select("v", F.col("v").alias("component"))
    if labels is None:
        return own
    least = labels.df.groupBy(F.col("root").alias("r")).agg(F.min("v").alias("component"))
    named = Kept(labels.df.join(least, F.col("root") == F.col("r")).select("v", "component"), "cc_components").df
    return named.unionAll(own.join(named, "v", "left_anti"))
