"""Connected components of a graph given as a table of links, by alternating star steps.

A large-star step points every larger neighbour of a vertex, a small-star step every
smaller one, at the smallest vertex seen; both keep components, and after a number of
rounds that is logarithmic in the longest chain every vertex points at the smallest of
its component.  A vertex with very many links is reduced per salt, never gathered.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import attach_groups, salted, written


def _smallest_neighbour(directed: DataFrame) -> DataFrame:
    """Adds to every (v, u) the smallest u of its v."""
    low = {"m": F.min("u")}
    return attach_groups(salted(directed, "u"), ["v"], low, {"m": F.min("m")}).drop("_salt")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("v", "u").unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _smallest_neighbour(_both_ways(links))
    return (near.select(F.col("u").alias("v"), F.least("m", "v").alias("u"), F.col("v").alias("at"))
            .filter((F.col("v") > F.col("at")) & (F.col("v") != F.col("u"))).select("v", "u").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct()
    near = _smallest_neighbour(down)
    return (near.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(near.select("v", F.col("m").alias("u")))
            .filter(F.col("v") != F.col("u")).distinct())


def _print(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(v, component) of every vertex that is not the smallest of its component.

    ``links`` has vertices ``v`` and ``u`` of one orderable type, none null.
    """
    links = written(links.filter(F.col("v") != F.col("u")).select("v", "u").distinct(), "links")
    seen = _print(links)
    while seen[0]:
        links = written(_small_star(_large_star(links)), "links")
        now = _print(links)
        if now == seen:
            break
        seen = now
    return links.select("v", F.col("u").alias("component"))
