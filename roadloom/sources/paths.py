"""Where a case's tables lie, and the coordinate system of its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metric coordinate systems by the state that ends a case's name.
CRS = {"vic": "EPSG:7855", "nsw": "EPSG:7856"}
KINDS = {"raw_graph": "{case}.graphml", "unified_graph": "{case}_unified.graphml", "trajectories": "{case}_trajectories.csv", "candidates": "{case}_candidates.json", "weights": "{case}_weights.parquet", "transition_weights": "{case}_transition_weights.parquet", "threshold": "{case}_threshold.json"}


def case_path(base: str, case: str, kind: str) -> str:
    return f"{base.rstrip('/')}/{kind}/{KINDS[kind].format(case=case)}"


def crs(case: str) -> str:
    """Raises for a state without a system: a wrong one would put every point elsewhere."""
    state = case.rsplit("_", 1)[-1].strip().lower()
    if state not in CRS:
        raise ValueError(f"no metric coordinate system for {case}")
    return CRS[state]


def crs_of(case: Column) -> Column:
    """crs as a column; null for an unknown state."""
    state = F.lower(F.trim(F.element_at(F.split(case, "_"), -1)))
    return F.create_map(*[F.lit(x) for kv in CRS.items() for x in kv])[state]


def first_folder(candidates: list[str | None], exists) -> str:
    """The first folder that there is (an override first, if set), else the first that is named."""
    named = [c for c in candidates if c]
    return next((c for c in named if exists(c)), named[0])
