"""Queries on rows that the generated tables do not have, against their SQL."""

import duckdb
import pytest

from roadloom.plans import registry

from tests.test_queries import plain


def same(spark, name, folder):
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = registry.queries()[name](spark, str(folder))
    want = con.execute(registry.oracle_sql()[name]).df().astype(object)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain([r.asDict() for r in got.collect()], columns) == plain(want.where(want.notna(), None).to_dict("records"), columns)


@pytest.mark.parametrize("props", ['{"k": null}', "{}", None, '{"k": 12.5}', '{"k": -2.5}', '{"k": "1e2"}', '{"a": 3, "k": 5}', '{"k": " 9 "}'])
def test_coercions_of_odd_rows(spark, tmp_path, props):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (event_id BIGINT, user_id BIGINT, event_type VARCHAR, props VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(1, 7, "view", props), (2, None, None, props), (None, 7, "view", props), (-4, 1234567890123456789, "view", props)])
    con.execute(f"COPY t TO '{tmp_path}/events.parquet'")
    same(spark, "b1_coercions", tmp_path)


def test_every_emission_that_is_made_is_returned(spark):
    """The product circuit's, too, which is not the matched network's under another name."""
    got = registry.queries()["q7_emissions"](spark, "/root/testdata/sf0.001")
    assert {"emit_spatial", "emit_context", "emit_matched", "emit_product"} <= set(got.columns)
    assert got.where("emit_product <> emit_matched").take(1)
