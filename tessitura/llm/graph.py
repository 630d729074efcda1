"""Connected components by contraction, for links of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs to (node, root): equal roots for connected nodes.

    Each round maps every node to the smallest of itself and its neighbours
    and contracts the links by that map, until none is left; then the maps are
    composed. Callers number nodes in random order, which makes the number of
    rounds logarithmic for paths too. Each round's links and maps are written
    to the shared folder. A node with very many links is only ever reduced by
    a minimum, which is taken on the map side first, or joined on its key.
    """
    links = materialise(_tidy(edges), "links")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = materialise(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("parent")), "parents")
        maps.append(step)
        left = step.select("u", F.col("parent").alias("pu"))
        right = step.select(F.col("u").alias("v"), F.col("parent").alias("pv"))
        before, links = links, materialise(_tidy(links.join(left, "u").join(right, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))), "links")
        discard(before)
    if not maps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = maps[0].select(F.col("u").alias("node"), F.col("parent").alias("root"))
    for step in maps[1:]:
        further = step.select(F.col("u").alias("root"), "parent")
        found = found.join(further, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    return found


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
