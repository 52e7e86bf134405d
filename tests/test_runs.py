import json

import pytest
from pyspark.sql import functions as F

from driftloom import cli, runs, schemas

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_contracts_parse_and_match(spark):
    for name in schemas.CONTRACTS:
        assert schemas.schema_of(name).fields
    df = spark.createDataFrame([], schemas.schema_of("loading"))
    assert schemas.missing_columns(df, "loading") == [] and schemas.missing_columns(df.drop("pc1_loading"), "loading") == ["pc1_loading"]


def test_violations(spark):
    df = spark.createDataFrame([("a", "role", 1), ("a", "other", None), (None, "default", -1)], "id string, kind string, n int")
    rules = schemas.Rules(key=("id",), required=("id", "n"), allowed={"kind": ("role", "default")}, conditions={"positive": F.col("n") > 0})
    got = {r.rule: r.violations for r in schemas.violations(df, rules).collect()}
    assert got == {"key:id": 1, "required:id": 1, "required:n": 1, "allowed:kind": 1, "condition:positive": 2}


def test_runs_skip_when_completed_and_keep_failures(spark, tmp_path):
    make = lambda: spark.range(3)
    assert runs.run(tmp_path / "r", "s", make) == "completed" and runs.run(tmp_path / "r", "s", make) == "skipped" and runs.run(tmp_path / "r", "s", make, force=True) == "completed"
    assert json.loads((tmp_path / "r/meta/manifest.json").read_text())["rows"] == 3
    with pytest.raises(ZeroDivisionError):
        runs.run(tmp_path / "f", "s", lambda: 1 / 0)
    assert runs.status_of(tmp_path / "f") == "failed"
    assert "| id |" in runs.markdown(spark.range(2), "t")
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError):
        runs.load_config(str(tmp_path / "c.json"))


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "vector_filter" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--tables", SF, "--out", str(tmp_path)]) == 1
    assert cli.main(["run", "set_ops", "--tables", SF, "--out", str(tmp_path), "--dry-run"]) == 0
    assert cli.main(["run", "set_ops", "--tables", SF, "--out", str(tmp_path), "--report"]) == 0
    assert cli.main(["run", "activation_audit", "--tables", SF, "--out", str(tmp_path)]) == 2


@pytest.mark.parametrize(
    "args,code",
    [
        (["window-planner", "--splits", "primary"], 0),
        (["run-comparator", "--tolerance", "1e9"], 0),
        (["run-comparator", "--tolerance", "1e-12"], 2),
        (["batch-invariance", "--tolerance", "1e-12"], 2),
        (["response-importer"], 1),
        (["checkpoint-sweep", "--dry-run"], 1),
        (["sequence-sampler", "--dry-run"], 0),
        (["geometry-report", "--cosine", "2,1.5", "--report"], 0),
        (["vector-filter", "--axes", "aa_step0,innovation", "--top-k", "2"], 0),
    ],
)
def test_stages(spark, tmp_path, args, code):
    assert cli.main([args[0], "--tables", SF, "--out", str(tmp_path), *args[1:]]) == code
    results = tmp_path / args[0] / "results"
    if args[0] == "window-planner":
        assert {r.split for r in spark.read.parquet(str(results / "split_filter")).collect()} == {"primary"}
    if args[0] == "vector-filter":
        assert {r.axis_name for r in spark.read.parquet(str(results / "multi_axis_filter")).collect()} == {"aa_step0", "innovation"}
    if args[0] == "geometry-report":
        assert spark.read.parquet(str(results / "geometry_gate")).first().gate == "stop" and "geometry_gate" in (tmp_path / args[0] / "report.md").read_text()
    if args[0] == "response-importer":
        assert not results.exists() and json.loads((tmp_path / args[0] / "meta/manifest.json").read_text())["violations"]


def test_stages_name_registered_queries():
    from driftloom import stages

    queries = entry.queries()
    for stage in stages.STAGES.values():
        assert set(stage.tables) <= set(queries) and (stage.refuse is None or stage.refuse in queries)
        import inspect

        taken = {p for t in stage.tables for p in inspect.signature(queries[t]).parameters}
        assert set(stage.options) <= taken
    assert len(stages.STAGES) == 25 and cli.main(["preflight"]) == 0  # the 26th stage is the preflight


def test_every_query_has_a_stable_schema_on_the_smallest_tables(spark):
    assert entry.entry(spark).count() > 0
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    for name, query in queries.items():
        if not name.startswith("p"):
            assert query(spark, SF).columns
