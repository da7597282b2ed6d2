"""Connected components of an edge table by alternating stars, every round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def forest(pairs: Iterator[tuple]) -> list[tuple]:
    """A spanning forest of the pairs as (vertex, smallest vertex of its tree), roots left out."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [(x, r) for x in parent if (r := root(x)) != x]


def contract(edges: DataFrame) -> DataFrame:
    """The same components with at most one edge for each vertex of a partition."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(forest(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True)), columns=["a", "b"]).astype({"a": pdf["a"].dtype, "b": pdf["b"].dtype})

    return edges.mapInPandas(run, f"a {kind}, b {kind}")


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, comp): comp is the smallest vertex reachable from v; only vertices with an edge to another appear.

    edges has columns a and b of one orderable type, in either direction, repeated or not; self-loops
    and nulls count as no edge.  Rounds of large and small stars halve the depth of every tree, so the
    number of rounds grows with the logarithm of the longest path.
    """
    now = edges.select("a", "b").where("a is not null and b is not null and a != b")
    now = materialise(contract(now).distinct(), "edges")
    last = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            break
        last = seen
        # Large star: each neighbour above a vertex turns to the least vertex around it.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: a vertex and its lower neighbours turn to the least of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        old, now = now, materialise(small.where("a != b").distinct(), "edges")
        discard(old)
    roots = now.select(F.col("b").alias("v"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("comp")).unionByName(roots)
