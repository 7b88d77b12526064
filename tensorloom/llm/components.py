"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Parts that the rows of one key are split into.
SALTS = 64


def shuffled(rows: DataFrame) -> DataFrame:
    """rows, to be joined by shuffle whatever size Spark takes them for.

    Before a join runs, Spark judges its sides by the bytes of compressed files, and counts
    exploded rows as if each were still one; while it runs, by what shuffles turned out to
    hold. A side that seems to lie under the broadcast threshold goes through the driver
    whole, however many rows it has.
    """
    return rows.hint("merge")


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: Column, parts: int = SALTS) -> DataFrame:
    """rows.join(facts, key) where one key may have any share of the rows; facts has a row a key.

    Rows are dealt by key and a part, taken from by. The facts meet the parts that occur, at
    most parts of them a key, so neither side puts a key's rows in one place.
    """
    salted = rows.withColumn("__part", F.pmod(by, F.lit(parts)))
    there = shuffled(salted.select(key, "__part").distinct()).join(facts, key)
    return shuffled(salted).join(there, [key, "__part"]).drop("__part")


def _smallest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest v of each u as m; the edges of a hub are spread over parts."""
    salted = edges.withColumn("__part", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    of_part = salted.groupBy("u", "__part").agg(F.min("v").alias("own"))
    least = of_part.groupBy("u").agg(F.min("own").alias("m"))
    return shuffled(salted).join(shuffled(of_part).join(least, "u").select("u", "__part", "m"), ["u", "__part"]).select("u", "v", "m")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of an undirected edge list (u, v) that is not its own root.

    root is the smallest node reachable. Each round is written to the shared folder, so a
    lost executor never costs more than a round. Stars are formed around minima, so a
    node's edges stay bounded by its component and never become all its pairs. Nulls are no
    nodes; loops and repeated edges change nothing; no edges give an empty result.
    """
    state = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        small = _smallest(large)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        state = materialize(small, name)
        now = tuple(state.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == before or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
