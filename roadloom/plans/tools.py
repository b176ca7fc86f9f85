"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    """A query; SQL that must give its rows (None where SQL cannot); its name if it is not that of the function."""

    run: Callable
    sql: str | None = None
    named: str | None = None

    @property
    def name(self) -> str:
        return self.named or self.run.__name__


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' last bits do not count."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def half_up(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded as `half_up_sql` rounds them: a value that is a tie but for its last bits is a tie, and goes up, in any engine."""
    scale = F.lit(10.0**places)
    return df.select(*[(F.floor(F.round(F.col(c) * scale, 3) + 0.5) / scale).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def half_up_sql(value: str, places: int = 6) -> str:
    scale = f"{10.0**places}::DOUBLE"
    return f"(floor(round(CAST({value} AS DOUBLE) * {scale}, 3) + 0.5) / {scale})"
