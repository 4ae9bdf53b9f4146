"""Connected components by contraction: hook each node to its least neighbour, compress, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_ROWS, discard, materialize, written_rows


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node that is reachable.

    Each round points every node at its least neighbour (a minimum, summed before the shuffle, so that a hub costs no
    more than any node), doubles the pointers until they end in roots, and contracts the edges to edges between
    roots. At least half of the nodes with edges go in each round. A round whose counted edges bound its tables by
    BROADCAST_ROWS follows pointers without a shuffle. Self loops, repeated edges, nulls and an empty table are allowed;
    rows with a null give no link. All tables stay in the shared folder and none is collected.
    """
    a, b = F.col("a"), F.col("b")
    left = materialize(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    label = None  # a written table, once there is a second round
    while True:
        count = written_rows(left)
        if label is not None and not count:
            discard(left)
            return label
        side = F.broadcast if 2 * count <= BROADCAST_ROWS else (lambda df: df)
        both = left.union(left.select(b.alias("a"), a.alias("b")))
        held = materialize(both.groupBy("a").agg(F.least(a, F.min("b")).alias("p")))
        parent = held
        while count:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            held, last = materialize(parent.join(side(up), "p").select("a", "p", "q")), held
            discard(last)
            parent = held.select("a", F.col("q").alias("p"))
            if held.where("p <> q").isEmpty():
                break
        if label is None:
            new = parent.select(a.alias("node"), F.col("p").alias("root"))
        else:
            new = label.join(side(parent.select(a.alias("root"), "p")), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        new, last = materialize(new), label
        discard(last)
        label = new
        if count:
            pa, pb = (side(parent.select(F.col("a").alias(c), F.col("p").alias(f"p{c}"))) for c in "ab")
            left, last = materialize(left.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()), left
            discard(last)
        discard(held)
