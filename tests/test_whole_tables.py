"""Queries that once had an id subset read every row."""

import pytest

from conftest import SMALL
from driftline import catalog

PARTS = "part", "p_partkey"


@pytest.mark.parametrize("name, table, key, column, times", [
    ("proj_struct_field", "orders", "o_orderkey", "id", 1), ("proj_kv_lookup", "events", "event_id", "event_id", 1),
    ("ip_mask_explode", *PARTS, "p_partkey", 25), ("join_multi_meta", "lineitem", "l_orderkey", "id", 1),
])
def test_every_row(spark, name, table, key, column, times):
    rows = spark.read.parquet(f"{SMALL}/{table}.parquet")
    got = catalog.queries()[name](spark, SMALL)
    assert got.count() == times * rows.count()
    assert {r[0] for r in got.select(column).distinct().collect()} == {r[0] for r in rows.select(key).distinct().collect()}


def test_unmatched_by_data(spark):
    parts = spark.read.parquet(f"{SMALL}/part.parquet").count()
    assert 0 < catalog.queries()["join_lpm"](spark, SMALL).count() < parts
    assert 0 < catalog.queries()["join_ip_in_net"](spark, SMALL).count() < parts
    got = catalog.queries()["d32_resolved"](spark, SMALL)
    assert 0 < got.where("edge = 'unresolved'").count() < got.count()


def test_resolved_pairs_come_once_and_are_not_shuffled(spark, tmp_path):
    """Repeated keys with several nations, null keys and null nations; the pairs have no exchange above their joins."""
    from driftline.harness import relational

    c = [(1, 1), (1, 2), (1, 2), (2, None), (3, 3), (None, 1), (None, 1), (4, 9)]
    s = [(1, 1), (1, 2), (2, 5), (2, None), (3, 3), (None, 1), (5, 2)]
    spark.createDataFrame(c, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(s, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {(a, x) for a, n in c for x, m in s if n is not None and n == m or a is not None and a == x}
    made = relational.join_full_outer_resolved(spark, str(tmp_path))
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert made._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
