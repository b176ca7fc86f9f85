"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import stored, with_fact


def components(links: DataFrame) -> DataFrame:
    """id, root (the least id reachable) of every id in links (a, b) but the roots, by large-star and small-star rounds.

    Each round is stored. The least id of a class of any size is never one task's key: rows that need a fact of
    such an id get it by a bounded broadcast.
    """
    e = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    before = mark(e)
    while before["n"]:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(sym.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = stored(with_fact(sym, least, "u", "n", 2 * before["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        small = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small")
        pairs = with_fact(large, small, "u", "n", 2 * before["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(pairs.union(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
