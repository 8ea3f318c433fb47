"""Every registered query with an SQL oracle: Spark result == DuckDB result at sf0.001."""

import duckdb
import pytest

from sentiforge.plans.registry import ORACLE, QUERIES, load_all
from sentiforge.sources.tables import TABLES
from tools_compare import normalised_rows

from conftest import SF_SMALL

load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, name):
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    sdf = QUERIES[name](spark, SF_SMALL)
    rel = con.execute(ORACLE[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(ocols)
    assert normalised_rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == normalised_rows(ocols, rel.fetchall())
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached      # a query leaves nothing cached


def test_run_folder_is_removed_on_request(spark):
    """Intermediate tables lie in one folder per application, which one call removes."""
    from sentiforge import scratch
    kept = scratch.written(spark.range(3), "test")
    system, path = scratch.hadoop_path(spark, scratch.run_folder(spark))
    assert system.exists(path) and kept.count() == 3
    assert scratch.clear_run_folder(spark) and not system.exists(path)
    assert scratch.written(spark.range(2), "test").count() == 2
