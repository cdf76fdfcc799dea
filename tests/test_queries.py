import pytest

from blockatlas.queries import ORACLES, QUERIES

from .oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_entry_imports_and_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rank_has_no_single_partition_exchange_of_blocks(spark, sf_dir):
    plan = QUERIES["q02_block_rank_two_level"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    window = [line for line in plan.splitlines() if "Exchange SinglePartition" in line]
    assert len(window) <= 1  # of the strides' sums, one row a stride


def test_bucketed_lookup_is_no_nested_loop(spark, sf_dir):
    plan = QUERIES["q12_range_lookup_bucketed"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
