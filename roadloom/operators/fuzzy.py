"""Scored fuzzy join of two edge-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.scalars import d

#: Weights of the parts of the score.
WEIGHTS = {"overlap": 0.35, "distance": 0.20, "name": 0.20, "direction": 0.15, "subtype": 0.10}


def best_match(pairs: DataFrame, parts: dict[str, Column], left: str, right: str, distance: Column, accept: float = 0.50, margin: float = 0.03) -> DataFrame:
    """Of each left row the pair of the best score (then overlap, distance, right id), its margin to the
    second, whether it is accepted, whether it is ambiguous, and how many candidates there were.

    What agrees to nine places is a tie: last bits, which hang on the order of sums, must not decide."""
    total = sum((d(WEIGHTS[n]) * c for n, c in parts.items()), d(0))
    order = Window.partitionBy(left).orderBy(F.round("score", 9).desc(), F.round("__o", 9).desc(), F.round("__d", 9), right)
    held = pairs.withColumns({"score": total, "__o": parts["overlap"], "__d": distance})
    ranked = held.withColumns({"__r": F.row_number().over(order), "second": F.lead("score").over(order), "candidates": F.count("*").over(Window.partitionBy(left))})
    top = ranked.where("__r = 1").withColumn("margin", F.col("score") - F.coalesce("second", d(0)))
    return top.select(left, right, "score", "margin", (F.col("score") >= accept).alias("accepted"), ((F.col("candidates") > 1) & (F.col("margin") < margin)).alias("ambiguous"), "candidates")
