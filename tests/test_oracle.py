"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import DATA, compare, connect

from metalint.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect("0.001")


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, name, "0.001", con)
    assert result["ok"], result


@pytest.mark.parametrize("name", ["reach_states", "reason_pick", "bind_models", "theme_match", "tab_rank", "rename_chain"])
def test_partitioning_does_not_change_rows(spark, name):
    """Nothing may depend on the order rows arrive in."""
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES[name](spark, f"{DATA}/sf0.001")
        got.append(sorted(map(tuple, df.collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
