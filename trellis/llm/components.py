"""Connected components of a graph by large and small stars (Kiveris et al., 2014), each round a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, kept, salted_join


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of the links (a, b); loops and repeats do no harm.

    A node's neighbours are never gathered: each round is a minimum by node, which sums up map-side, and a join on the
    node, in which a node with very many neighbours is dealt over many tasks. Two rounds that give the same links end it."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = kept(edges, "edges")
    last = _mark(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * last[0], F.least(F.min("v"), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _with_least(down, 2 * last[0], F.min("v")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        old, edges = edges, kept(small, "edges")
        forget(old)
        now = _mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _with_least(edges: DataFrame, n_rows: int, least: Column) -> DataFrame:
    """The edges (u, v), of which there are at most n_rows, with m, what `least` gives for their u."""
    by = edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("n"))
    return salted_join(edges, by.select("u", "m"), "u", "v", by, n_rows)


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30))), F.lit(0)).alias("s")).first()
    return row["n"], row["x"], row["s"]
