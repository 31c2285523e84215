"""Every light-curve query against its SQL on the smallest tables."""

import pytest

from dimwatch.plans import catalog_queries, oracle, peak_queries, queries, stream_queries

from .compare import difference

SQL = queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert not difference(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df())


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(queries.QUERIES) and len(SQL) == sum(len(m.SQL) for m in (oracle, catalog_queries, peak_queries, stream_queries))


def test_flagship_has_a_row_per_source(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.count() == rows.select("source_id").distinct().count() > 0


@pytest.mark.parametrize("name", ["box_gate", "dip_peaks", "delta_peaks", "prominent_peaks", "finder_bands"])
def test_peaks_match_sql_where_points_repeat(spark, sf_dir, tmp_path, name):
    """A third of the events and line items come again under other keys, so that curves have plateaus."""
    import duckdb

    con = duckdb.connect()
    for table, key in (("events", "event_id"), ("lineitem", "l_orderkey")):
        con.execute(f"create view t_{table} as select * from '{sf_dir}/{table}.parquet'")
        con.execute(f"copy (select * from t_{table} union all select * replace ({key} + 1000000 as {key}) from t_{table} where {key} % 3 = 0) to '{tmp_path}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    assert not difference(queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(SQL[name]).df())
