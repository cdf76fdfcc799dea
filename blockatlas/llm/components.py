"""Connected components of a link table by alternating large-star and small-star rounds.

Each round only groups by node and joins on node, so no component is ever gathered anywhere. Groups
are pre-aggregated before the shuffle. A hub, a node with more than one ``HUBS``-th of all links, takes no
part in the join: there are at most ``2 * HUBS`` hubs, so what they need is known to the plan as a
literal and their links are not brought together. Rounds needed grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Scratch

HUBS = 64
HUB_LINKS = 1000  # a node with fewer links is no hub


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(u, v, m): edges with m of their u, from least (u, m, n), n being u's number of edges."""
    hubs = {r["u"]: r["m"] for r in least.filter(F.col("n") > max(HUB_LINKS, total // HUBS)).collect()}
    if not hubs:
        return edges.join(least.drop("n"), "u")
    is_hub = F.col("u").isin(list(hubs))
    known = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in hubs.items() for x in pair]), F.col("u"))
    return edges.filter(~is_hub).join(least.filter(~is_hub).drop("n"), "u").unionByName(edges.filter(is_hub).withColumn("m", known))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """From links (u, v) to (node, component): the smallest node reachable, for every linked node.

    Links of a node with itself and links with null are ignored; an empty table gives none.
    """
    down = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    edges = links.filter(F.col("u") != F.col("v")).select(*down(F.col("u"), F.col("v"))).distinct()
    edges = scratch.save(edges, f"{name}-0")
    state = _state(edges)
    if not state[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for k in range(1, most_rounds + 1):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        least = scratch.save(least, f"{name}-m{k}")
        large = _with_least(both.filter("v > u"), least, 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{name}-l{k}")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-s{k}")
        joined = _with_least(large, least, state[0])
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.save(small, f"{name}-{k}")
        scratch.drop(*(f"{name}-{x}" for x in (f"m{k}", f"l{k}", f"s{k}", k - 1)))
        edges, before = small, state
        state = _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return scratch.save(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct(), f"{name}-done")
