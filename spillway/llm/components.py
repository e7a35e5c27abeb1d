"""Connected components of an edge table, by stars: no links or labels pass the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _around(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (a, b) to labels (u, label): the least id that is reachable. Ids without edges are left out.

    Large-star links each greater neighbour of a node to the least id around it, small-star the
    other ones; edges never grow in number, and rounds are few, about the logarithm of the
    greatest component's size. A node's greatest number of edges meets only partial minima.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    step, was = 0, _sum(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_around(both), "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        step += 1
        now = scratch.save(small.filter("u <> v").distinct(), f"{name}-{step}")
        before, was = was, _sum(now)
        scratch.drop(f"{name}-{step - 1}")
        if was == before:
            break
    lone = now.select(F.col("v").alias("u"), F.col("v").alias("label")).distinct()
    return now.select("u", F.col("v").alias("label")).unionByName(lone)


def joined(labels: DataFrame | None, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Labels (u, label) after more edges (a, b): only the labels that these link are looked at again."""
    if labels is None:
        return scratch.save(components(edges, scratch, name), f"{name}-labels")
    of = lambda c: labels.select(F.col("u").alias(c), F.col("label").alias(f"{c}_label"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    new = scratch.save(components(between.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")), scratch, name), f"{name}-new")
    moved = labels.join(new.select(F.col("u").alias("label"), F.col("label").alias("_to")), "label", "left")
    old = moved.select("u", F.coalesce("_to", "label").alias("label"))
    return scratch.save(old.unionByName(new.join(labels.select("u"), "u", "left_anti").select("u", "label")), f"{name}-labels")
