import verify
from driftloom.plans import registry


def test_queries_equal_their_sql(spark):
    assert verify.main(["--sf", "/root/testdata/sf0.001", *registry.oracle_sql()]) == 0


def test_queries_run_on_empty_tables(spark, tmp_path):
    from pathlib import Path

    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(str(tmp_path / p.name))
    for name, query in registry.queries().items():
        query(spark, str(tmp_path)).collect()
