"""Connected components of a graph given as links, without leaving the cluster.

Alternating large-star and small-star contraction (Kiveris et al., 2014): each
round replaces links by links to smaller neighbours, so the number of links
never grows and hot nodes cost an aggregation (combined before the shuffle),
not a gathered list.  A round's links are written to the shared folder, and the last
round's deleted.  A node with over ``HUB`` links is joined by a broadcast of the
few such nodes (no more than links / ``HUB``), so its links don't meet in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import SMALL_IDS, discard, saved

#: Links of a node that may meet in one task.
HUB = 200_000


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_low(links: DataFrame, node: str, low: DataFrame, n_links: int) -> DataFrame:
    """links joined with low (node, m, n); nodes of many links apart from the others."""
    if n_links <= HUB:
        return links.join(low.drop("n"), node)
    low = saved(low, "low")
    hubs = low.filter(F.col("n") > HUB).drop("n")
    if not (n := hubs.count()):
        return links.join(low.drop("n"), node)
    hubs = F.broadcast(hubs) if n <= SMALL_IDS else hubs
    return links.join(hubs, node).unionByName(links.join(hubs.select(node), node, "left_anti").join(low.filter(F.col("n") <= HUB).drop("n"), node))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node id that can be reached, for every node with a link to another.

    Null ends, links of a node with itself and repeated links count for nothing.
    An empty input gives no rows.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    e = saved(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"), F.count("*").alias("n"))
        large = _with_low(both.filter("y > x"), "x", low, 2 * state[0]).select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_low(large, "u", low, 2 * state[0])
        old, e = e, saved(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct(), "edges")
        discard(old)
        before, state = state, _state(e)
        if state == before:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
