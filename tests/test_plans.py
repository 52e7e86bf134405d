import hashlib

from driftloom.plans import governance_queries as G
from driftloom.plans import window_queries as W

POLICY = "struct<sample_size: bigint, seed: bigint>"


def test_samples_are_as_large_as_planned(spark, tmp_path):
    plans = [("a", (7, 1)), ("b", (None, 2)), ("c", (3, 3)), ("d", (4, 4))]
    spark.createDataFrame(plans, f"window_id string, sample_policy {POLICY}").write.parquet(str(tmp_path / "window_plan.parquet"))
    rows = [(w, f"u{i}") for w, n in (("a", 9), ("b", 8), ("c", 5)) for i in range(n)]
    spark.createDataFrame([*rows, *rows[:4], (None, "u0")], "window_id string, uid string").write.parquet(str(tmp_path / "sampled_sequences.parquet"))
    ranks = {}
    for r in W.seeded_sample(spark, str(tmp_path)).collect():
        ranks.setdefault(r.window_id, []).append(r["rank"])
    assert {w: sorted(x) for w, x in ranks.items()} == {"a": [*range(1, 8)], "b": [*range(1, 9)], "c": [1, 2, 3]}
    got = {r.window_id: (r.planned, r.existing, r.missing, r.status) for r in W.sample_summary(spark, str(tmp_path)).collect()}
    assert got == {"a": (7, 9, 0, "completed"), "b": (1000, 8, 992, "partial"), "c": (3, 5, 0, "completed"), "d": (4, 0, 4, "partial")}


def test_the_inventory_has_every_file(spark, tmp_path):
    files = {"nation.parquet": b"n", "region.parquet": b"r", "rollouts.parquet": b"rows" * 9, "empty.parquet": b"", "a.parquet/part-0.parquet": b"same", "b.parquet/part-0.parquet": b"same"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = sorted((r.path, r.size_bytes, r.sha256) for r in G.artifact_inventory(spark, str(tmp_path)).collect())
    assert got == sorted((name, len(c), hashlib.sha256(c).hexdigest()) for name, c in files.items())
