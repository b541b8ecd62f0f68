"""Connected components over link tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import stage, unstage


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """``edges(a, b)`` of long ids to ``(node, component)``, component the smallest id reachable.

    Each round points every node's larger neighbours at its smallest one and
    then its smaller neighbours likewise, until the links are stars: a number
    of rounds logarithmic in the longest chain, each linear in the links. Rows
    with a null end and self-links are ignored. An empty table gives no rows.
    Nodes without links aren't listed.
    """
    u, v = F.col("u"), F.col("v")
    links = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    links = links.where(edges["a"].isNotNull() & edges["b"].isNotNull() & (u < v)).distinct()
    now = stage(links, name)
    state = _state(now)
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(v > u).select(F.col("m").alias("u"), v).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        pairs = large.join(low, "v").select("u", "v", "m")
        # (v, m) and (u, m) for every u above v's smallest neighbour m
        star = pairs.select(F.explode(F.array(F.struct("m", u.alias("x")), F.struct("m", v.alias("x")))).alias("p"))
        star = star.select(F.col("p.m").alias("u"), F.col("p.x").alias("v")).where(u < v).distinct()
        after = stage(star, name)
        was, state = state, _state(after)
        unstage(now)
        now = after
        if state == was:
            break
    roots = now.select(u.alias("node"), u.alias("component")).distinct()
    return now.select(v.alias("node"), u.alias("component")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first())
