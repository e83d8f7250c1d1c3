"""Each registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from ledgerspark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    want = oracle.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(rows, got.columns) == rows_of(want.fetchall(), want.columns)


#: Price, discount and quantity of loans whose result lies so near a half that the last digits of the growth decide.
HALVES = {
    "compound_interest": [(68670.04, 0.1, 47), (33898.89, 0.09, 48), (48370.92, 0.1, 41), (102971.91, 0.08, 35)],
    "emi_batch": [(100985.98, 0.01, 2), (11524.8, 0.01, 4), (30000.51, 0.01, 7), (16016.54, 0.01, 29)],
    "sip_future_value": [(99396.12, 0.01, 24), (101292.18, 0.03, 49), (77832.24, 0.05, 19), (43550.3, 0.05, 35)],
}


@pytest.mark.parametrize("name", sorted(HALVES))
def test_loans_near_a_half(spark, tmp_path, name):
    rows = ", ".join(f"({i}, 1, {q}::double, {p}::double, {d}::double, timestamp '1998-01-01')" for i, (p, d, q) in enumerate(HALVES[name]))
    con = duckdb.connect()
    con.sql(f"create table lineitem as select * from (values {rows}) t(l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_shipdate)")
    con.execute(f"copy (select * replace (l_orderkey::bigint as l_orderkey) from lineitem) to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.sql(catalog.SQL[name])
    assert rows_of([tuple(r) for r in got.collect()], got.columns) == rows_of(want.fetchall(), want.columns)
