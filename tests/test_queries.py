"""Every query with SQL gives the rows that DuckDB gives for it, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from roadloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="tables are not here")


def plain(rows, columns):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{round(float(v), 4) + 0.0:.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(registry.oracle_sql()[name]).df().astype(object)
    assert columns == sorted(want.columns)
    assert plain([r.asDict() for r in got.collect()], columns) == plain(want.where(want.notna(), None).to_dict("records"), columns)


def test_entry_names_a_query():
    import __spark_entry__

    assert registry.FLAGSHIP in __spark_entry__.queries()
