import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as X

from driftloom.functions import codec
from driftloom.functions import text as T
from driftloom.operators import attribution as A
from driftloom.operators import resampling, targets
from driftloom.operators import selection as S
from driftloom.operators.ranges import range_join
from driftloom.sources import jsonl, tables
from driftloom.streaming import resume


def test_range_join_equals_brute_force(spark):
    rng = random.Random(1)
    ranges = [(i, a, a + rng.choice([0, 1, 2, 7, 64, 1000, 70000])) for i, a in enumerate(rng.randrange(-5000, 90000) for _ in range(150))] + [(999, None, 5)]
    points = [(i, rng.randrange(-6000, 100000)) for i in range(400)] + [(1000, None)]
    p, r = spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(ranges, "r long, lo long, hi long")
    got = sorted((x.p, x.r) for x in range_join(p, r, "at", "lo", "hi").collect())
    assert got == sorted((i, j) for i, at in points if at is not None for j, lo, hi in ranges if lo is not None and lo <= at < hi)
    assert range_join(p, r.limit(0), "at", "lo", "hi").count() == 0


def test_text_rules(spark):
    rows = ["a  b c\x1f d ", "\r\n", "", None, "step12", "step12 -> step300", "step1_to_step2x", "Intro. More:\n1. first\n2. second", "no end", "x　y"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    t = F.col("t")
    a, b = T.window_parts(t)
    got = df.select(T.collapse(t).alias("c"), T.word_count(t).alias("n"), T.step_of(t).alias("s"), a.alias("a"), b.alias("b"), T.cleaned_response(t).alias("r"), T.sanitized(t).alias("z")).collect()
    for x, r in zip(rows, got):
        assert r.c == (None if x is None else " ".join(x.split()))
        if x is not None:
            assert r.n == len(x.split())
    assert got[4].s == 12 and got[5].s is None and (got[5].a, got[5].b) == ("step12", "step300") and got[6].a is None
    assert got[7].r == "Intro. More." and got[8].r == "no end" and got[5].z == "step12_-_step300"


def test_latest_and_round_robin(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z"), (None, 5, "n")], "k string, at int, v string")
    rows = {r.k: (r.v, r.first_0) for r in S.latest(df, ["k"], [F.col("at")], [F.col("at")]).collect()}
    assert rows == {"a": (None, 1), "b": ("z", 1), None: ("n", 5)}
    got = [(r.k, r.at) for r in S.round_robin(df, "k", ["at"], 4).collect()]
    assert got == [("a", 1), ("b", 1), (None, 5), ("a", 2)]


def test_hash_rank_is_the_same_in_any_order_and_nested(spark):
    df = spark.createDataFrame([(i,) for i in range(300)], "i long")
    one = {r.i for r in S.hash_ranked(df, "i", 40, 7, "m").collect()}
    assert one == {r.i for r in S.hash_ranked(df.orderBy(F.desc("i")).repartition(5), "i", 40, 7, "m").collect()} and len(one) == 40
    flags = S.nested(df, "i", [("m", 40), ("a", 20), ("r", 5)], 7).collect()
    assert {r.i for r in flags} == one and sum(r.a for r in flags) == 20 and sum(r.r for r in flags) == 5 and all(r.a for r in flags if r.r)
    assert S.hash_ranked(df.limit(0), "i", 5, 7, "m").count() == 0


def test_drawn_rows_are_those_of_the_standard_generator(spark):
    df = spark.createDataFrame([(i * 10,) for i in range(50)], "v long")
    want = sorted(random.Random(1729).sample(range(50), 8))
    assert sorted(r.v for r in S.drawn(df, ["v"], 8, 1729).collect()) == [i * 10 for i in want]
    assert S.drawn_indices(3, 5, 1) == [0, 1, 2]


SCHEMA = X.StructType([X.StructField("a", X.LongType()), X.StructField("b", X.StringType())])


def test_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1, "b": "x"}\n\n{"b": "y"}\n')
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n[1]\n{"a": \n')
    assert {(r.a, r.b) for r in jsonl.read_strict(spark, str(good), SCHEMA).collect()} == {(1, "x"), (None, "y")}
    assert jsonl.read_lenient(spark, str(tmp_path / "none.jsonl"), SCHEMA).count() == 0
    assert {r.line for r in jsonl.bad_lines(spark, str(bad), SCHEMA).collect()} == {2, 3}
    assert jsonl.bad_lines(spark, str(good), SCHEMA).count() == 0
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(bad), SCHEMA).collect()


def test_shards_inventory_and_all_or_nothing(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("batch_idx"), (F.col("id") * 2).alias("v"))
    df.where("batch_idx < 50").coalesce(1).write.parquet(str(tmp_path / "s1"))
    df.where("batch_idx >= 50").coalesce(1).write.parquet(str(tmp_path / "s2"))
    rows = tables.read_shards(spark, [str(tmp_path / "s1"), str(tmp_path / "s2")], ["batch_idx"], 45, 55)
    assert rows.count() == 10 and rows.select("source_file").distinct().count() == 2
    (tmp_path / "f.txt").write_text("hello")
    assert tables.inventory(spark, str(tmp_path), "f.txt").first().sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    rules = spark.createDataFrame([("r", 1)], "rule string, violations long")
    assert not tables.write_if_valid(df, rules, str(tmp_path / "o")) and spark.read.parquet(str(tmp_path / "o")).count() == 0
    assert tables.write_if_valid(df, rules.withColumn("violations", F.lit(0)), str(tmp_path / "o")) and spark.read.parquet(str(tmp_path / "o")).count() == 100


def test_ingest_takes_each_file_once_and_upsert_keeps_the_last(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, at int").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    resume.ingest_available(spark, src, schema, lambda d: d, out, cp)
    spark.createDataFrame([("a", 2)], "k string, at int").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        resume.ingest_available(spark, src, schema, lambda d: d, out, cp)
    assert spark.read.schema(schema).parquet(out).count() == 3
    resume.upsert_available(spark, src, schema, "k", "at", str(tmp_path / "up"), str(tmp_path / "cp2"))
    assert sorted(map(tuple, resume.state(spark, str(tmp_path / "up"), schema).collect())) == [("a", 2), ("b", 1)]


def test_upsert_writes_the_buckets_of_its_keys_and_removes_what_is_superseded(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "up", "cp"))
    want = {}
    for n, rows in enumerate([[(f"k{i}", 1, f"v{i}") for i in range(40)], [("k1", 2, "x"), ("k1", 2, "y"), (None, 5, "n")], [("k1", 1, "late"), ("k2", 3, "z")], [("k1", 9, "last")]]):
        spark.createDataFrame(rows, "k string, at int, v string").coalesce(1).write.mode("append").parquet(src)
        schema = spark.read.parquet(src).schema
        resume.upsert_available(spark, src, schema, "k", "at", out, cp, buckets=8)
        for k, at, v in rows:
            want[k] = max(want.get(k, (0, "")), (at, v))
        got = {r.k: (r.at, r.v) for r in resume.state(spark, out, schema).collect()}
        assert got == want, n
    parts = resume._parts(spark, out)
    assert max(map(len, parts.values())) <= 2 and len([b for b, e in parts.items() if e[-1] == 3]) == 1


def test_closed_form_gradients_equal_finite_differences():
    model = A.TinyCausalModel(vocabulary=11, width=4)
    ids = np.array([1, 5, 3, 5, 9])
    loss, g = model.gradient(ids)
    params = model.parameter_gradients(ids)
    for block, at in (("read", 1), ("embed", 0)):
        for i, j in ((5, 2), (3, 0), (9, 3)):
            w = model.weights[at]
            old, eps = w[i, j], 1e-6
            w[i, j] = old + eps
            up = model.gradient(ids)[0]
            w[i, j] = old - eps
            down = model.gradient(ids)[0]
            w[i, j] = old
            assert abs((up - down) / (2 * eps) - params[block][i, j]) < 1e-6
    assert g.shape == (4, 4) and loss > 0


def test_backends_do_not_depend_on_batches(spark):
    rows = [(i, [1 + (7 * i + 3 * p) % 46 for p in range(7 + i % 5)]) for i in range(8)] + [(8, None), (9, [1]), (10, [1, None, 2])]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    model, axis = A.TinyCausalModel(), [1.0] * 8
    one = sorted(map(tuple, A.pressure(df.repartition(1), "id", "ids", model, axis).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    many = sorted(map(tuple, A.pressure(df.repartition(4), "id", "ids", model, axis).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == many and all(r[1] is None for r in one[8:])
    q = rows[0][1]
    own = {r.id: r for r in A.influence(df, "id", "ids", model, q).collect()}
    flat = lambda x: np.concatenate([b.ravel() for b in model.parameter_gradients(np.array(x)).values()])
    assert abs(own[3].negative_dot + flat(rows[3][1]) @ flat(q)) < 1e-9 and abs(own[0].cosine + 1) < 1e-9
    assert A.project(df, "id", "ids", model, {"x": axis, "y": axis}).count() == 16


def test_bad_lines_are_named_by_file_and_number_across_splits(spark, tmp_path):
    schema = X.StructType([X.StructField("a", X.LongType())])
    lines = ['{"a": 1}', "", "[1]", '{"a": 2', "   ", '{"a": "x"}'] + ['{"a": 3}'] * 2000 + ["end"]
    (tmp_path / "in.json").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.line, r.text) for r in jsonl.bad_lines(spark, str(tmp_path / "in.json"), schema).collect())
            assert got == [(3, "[1]"), (4, '{"a": 2'), (6, '{"a": "x"}'), (2007, "end")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert schema.names == ["a"]
    with pytest.raises(ValueError, match="line 3 in .*in.json"):
        jsonl.read_checked(spark, str(tmp_path / "in.json"), schema)


def test_cleaned_responses_with_and_without_both_switches(spark):
    cases = {" Steps :\n- one\n- two": ("Steps.", "Steps :\n- one\n- two"), "One. Two:\n1) x": ("One. Two.", "One."), "No end": ("No end", "No end"), "A. b\u00a0:\n* c": ("A. b.", "A."), "": ("", "")}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", T.cleaned_response(F.col("t")).alias("a"), T.cleaned_response(F.col("t"), strip_lists=False).alias("b"), T.cleaned_response(F.col("t"), False, False).alias("c")).collect():
        assert (r.a, r.b) == cases[r.t] and r.c == r.t.strip(), r
    assert spark.range(1).select(T.cleaned_response(F.lit(None).cast("string")).alias("x")).first().x is None


def test_planned_shards_and_portable_paths(spark, tmp_path):
    rows = lambda lo, n: spark.range(lo, lo + n).withColumnRenamed("id", "batch_idx").coalesce(1)
    rows(0, 10).write.parquet(str(tmp_path / "train-001000.parquet"))
    rows(10, 10).write.parquet(str(tmp_path / "data" / "train-002000.parquet"))
    rows(0, 99).write.parquet(str(tmp_path / "train-009000.parquet"))  # planned by nobody
    plans = spark.createDataFrame([("p", ["train-001000.parquet", "train-002000.parquet"], 8, 12), ("q", ["train-001000.parquet"], 0, 100), ("empty", [], 0, 5)], "plan_id string, files array<string>, start long, end long")
    got = sorted(map(tuple, tables.read_planned(spark, plans, str(tmp_path), ["batch_idx"]).groupBy("plan_id", "source_file").count().collect()))
    assert got == [("p", "train-001000.parquet", 2), ("p", "train-002000.parquet", 2), ("q", "train-001000.parquet", 10)]
    with pytest.raises(FileNotFoundError):
        tables.resolve_shards(spark, str(tmp_path), ["nothing.parquet"])
    assert tables.resolve_shards(spark, str(tmp_path), ["nothing.parquet"], "skip") == {}
    (tmp_path / "vectors").mkdir()
    (tmp_path / "vectors" / "a.pt").write_text("x")
    base = str(tmp_path)
    assert [tables.portable(spark, x, base, "vectors") for x in (f"{base}/vectors/a.pt", "vectors/a.pt", "/elsewhere/a.pt")] == [f"{base}/vectors/a.pt"] * 3
    with pytest.raises(FileNotFoundError):
        tables.portable(spark, "/elsewhere/b.pt", base, "vectors")


def test_artifacts_that_may_go(spark):
    files = spark.createDataFrame([("a/x.json", 5, "0" * 64), ("a/__pycache__/x.pyc", 5, "0" * 64), (".DS_Store", 1, "0" * 64), ("empty", 0, "0" * 64)], "path string, size_bytes long, sha256 string")
    got = {r.path: (r.path_in_repo, r.skipped, r.ready) for r in tables.artifact_records(files, "/runs/").collect()}
    assert got == {"a/x.json": ("runs/a/x.json", False, True), "a/__pycache__/x.pyc": ("runs/a/__pycache__/x.pyc", True, True), ".DS_Store": ("runs/.DS_Store", True, True), "empty": ("runs/empty", False, False)}
    assert tables.artifact_records(files, "").where("path = 'a/x.json'").first().path_in_repo == "a/x.json"


def test_bundles_load_wanted_targets_only(spark):
    axes = spark.createDataFrame([("n", [3.0, 0.0], 3.0), ("e", [1.0, 1.0], 1.4), ("zero", [0.0, 0.0], 0.0)], "name string, axis array<double>, raw_norm double")
    made = targets.bundle(axes.withColumn("axis", F.when(F.col("name") == "n", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.col("axis"))), "name", "e", "n")
    held = {r.axis_name: r.axis for r in targets.load(made, ["n", "innovation"]).collect()}
    assert held == {"n": [1.0, 0.0], "innovation": [0.0, 1.0]}
    for names in (["n", "absent"], ["zero"]):
        with pytest.raises(ValueError):
            targets.load(made, names)


def test_codec(spark):
    vocabulary = codec.vocabulary(codec.RANKS)
    back = {v: k for k, v in vocabulary.items()}
    ids = [back[b"The"], back[b" cat"], 0, back[b"."], None, 10**8]
    rows = spark.createDataFrame([(1, ids), (2, None), (3, [])], "id int, ids array<int>").select("id", codec.decoded("ids").alias("t"), codec.token_ids(F.col("ids")).alias("n"))
    assert sorted((r.id, r.t, r.n) for r in rows.collect()) == [(1, "The cat\n.\ufffd", None), (2, None, None), (3, "", None)]


def test_bootstrap_covers_the_mean_and_does_not_depend_on_layout(spark):
    rng = random.Random(3)
    rows = [("g", i, rng.gauss(5, 2)) for i in range(4000)] + [("one", 1, 7.0), ("none", 1, float("nan")), ("g", None, None)]
    df = spark.createDataFrame(rows, "g string, i long, x double")
    a, b = (sorted(map(tuple, resampling.bootstrap_means(d, "g", "i", "x", 200, 1, (0.05, 0.95)).collect())) for d in (df, df.repartition(7)))
    assert a == b and [r[0] for r in a] == ["g", "one"]
    assert a[0][3] < a[0][2] < a[0][4] and abs((a[0][4] - a[0][3]) / (2 * 1.645 * 2 / 4000**0.5) - 1) < 0.3 and a[1][2:] == (7.0, 7.0, 7.0)
