"""Connected components of an edge table by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node of its component, roots themselves left out) for `edges` a, b of one ordered type.

    Every step is written to the shared folder; the loop ends when a step changes nothing.
    """
    held = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    mark, turn = None, 0
    while True:
        row = held.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == tuple(row):
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, turn = tuple(row), turn + 1
        both = held.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(held.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        held = scratch.keep(pairs.select("e.a", "e.b").where("a != b").distinct(), f"edges{turn}")
        if turn > 1:
            scratch.drop(f"edges{turn - 2}")
