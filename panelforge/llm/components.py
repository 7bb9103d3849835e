"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, join_counted, shared_table


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the least node that links reach, for each node with a link to another.

    Alternates two steps until nothing changes: each node passes the least of its neighbourhood to its larger
    neighbours, then to its smaller ones. Links stay a distributed table and their number never grows; every
    round is written to the shared folder and the one before it deleted. The neighbours of a node with a great share of the links
    are not one task's work (:func:`join_counted`). Repeated links, links of a node to itself and either
    order of the two nodes are allowed; links with a null are left out. No links give an empty table. Nodes may be of any
    type that has an order.
    """
    spark = links.sparkSession
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null").where("u <> v")
    links, path = shared_table(links.distinct())
    state = lambda: tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state()
    while before[0]:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        up = join_counted(both, least, "u", "n", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up, up_path = shared_table(up.where("u <> v").distinct())
        least = up.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        down = join_counted(up, least, "u", "n", before[0]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        links, new = shared_table(down.where("u <> v").distinct())
        for old in (path, up_path):
            drop_table(spark, old)
        path, now = new, state()
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


class Forest:
    """Components of nodes 0 to n-1 in one task, to which links come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return
        nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b = ends[: len(a)], ends[len(a) :]
        label = np.arange(len(nodes))
        while True:
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                jumped = label[label]
                if np.array_equal(jumped, label):
                    break
                label = jumped
        moved = np.arange(len(self.root))
        moved[nodes] = nodes[label]
        self.root = moved[self.root]
