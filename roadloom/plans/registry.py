"""Every registered query with, where SQL can express it, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadloom.plans import coerce, decoding, evaluation, fixes, formats, fusing, lookups, making, network, scoring, validating

FLAGSHIP = "j1_j2_candidates"
PLANS = [*formats.PLANS, *fixes.PLANS, *coerce.PLANS, *fusing.PLANS, *validating.PLANS, *network.PLANS, *lookups.PLANS, *decoding.PLANS, *scoring.PLANS, *making.PLANS, *evaluation.PLANS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {p.name: p.run for p in PLANS}


def oracle_sql() -> dict[str, str]:
    return {p.name: p.sql for p in PLANS if p.sql}
