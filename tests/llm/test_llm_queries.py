from pathlib import Path

import verify
from driftloom.llm import queries


def test_queries_equal_their_sql(spark):
    assert verify.main(["--sf", "/root/testdata/sf0.001", *queries.ORACLE]) == 0


def test_queries_run_on_empty_tables(spark, tmp_path):
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(str(tmp_path / p.name))
    for name, query in queries.QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        assert not rows or name in ("p8_fill", "p9_shares"), name
