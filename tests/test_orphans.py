from datetime import datetime as D

from driftloom.operators import orphans
from driftloom.operators.orphans import Edge, cascade, direct_orphans, orphan_report

A = Edge("a", "a_id", "b_ref", "b", "b_id", "made", "born", "gone")
B = Edge("b", "b_id", "c_ref", "c", "c_id")
C = Edge("c", "c_id", "parent_id", "c", "c_id")


def frames(spark):
    a = [(1, "x", D(2025, 1, 2), 0), (1, "x", D(2025, 1, 2), 0), (2, None, D(2025, 1, 2), 0), (3, "zz", None, 0), (4, "y", D(2025, 1, 1), 0), (5, "y", D(2025, 3, 1), 0), (6, "X", D(2025, 1, 2), 0), (7, "w", D(2025, 1, 2), 0)]
    b = [("x", "c1", D(2025, 1, 1), None), ("y", None, D(2025, 1, 15), D(2025, 3, 1)), ("w", "c3", D(2025, 1, 1), None)]
    c = [("c1", "nowhere"), ("c2", "c1"), ("c3", "c2"), (None, "c1")]
    return {
        "a": spark.createDataFrame(a, "a_id long, b_ref string, made timestamp_ntz, ref int"),
        "b": spark.createDataFrame(b, "b_id string, c_ref string, born timestamp_ntz, gone timestamp_ntz"),
        "c": spark.createDataFrame(c, "c_id string, parent_id string"),
    }


def test_direct(spark):
    f = frames(spark)
    got = {r.row_key: r.reason for r in direct_orphans(f["a"], f["b"], A).collect()}
    assert got == {"3": "missing", "4": "late", "5": "deleted", "6": "missing"}


def test_cascade_reaches_the_end_of_the_graph_and_of_self_references(spark):
    got = {(r.table_name, r.row_key): (r.kind, r.depth) for r in cascade(frames(spark), [A, B, C]).collect()}
    assert got[("c", "c1")] == ("direct", 0)
    assert got[("c", "c2")] == ("inherited", 1) and got[("c", "c3")] == ("inherited", 2)
    assert got[("b", "x")] == ("inherited", 1) and got[("b", "w")] == ("inherited", 3)
    assert got[("a", "1")] == ("inherited", 2) and got[("a", "7")] == ("inherited", 4)
    assert ("a", "2") not in got and ("b", "y") not in got


def test_empty_tables(spark):
    f = {k: v.limit(0) for k, v in frames(spark).items()}
    assert cascade(f, [A, B, C]).count() == 0
    full = frames(spark)
    assert direct_orphans(full["a"], f["b"], A).count() == 6
    assert direct_orphans(f["a"], full["b"], A).count() == 0


def test_report_keeps_rows_without_a_time(spark):
    f = frames(spark)
    got = {(r.month, r.reason): r.orphans for r in orphan_report(cascade(f, [A])).collect()}
    assert got == {(None, "missing"): 1, ("2025-01", "late"): 1, ("2025-03", "deleted"): 1, ("2025-01", "missing"): 1}


def test_hot_references_are_met_in_several_tasks(spark, monkeypatch):
    rows = [(i, "gone" if i % 3 else "late", i % 5) for i in range(300)] + [(1000 + i, "ok", 9) for i in range(50)] + [(None, "gone", 1), (None, "gone", 2)]
    child = spark.createDataFrame(rows, "k long, r string, t int").selectExpr("k", "r", "timestamp_seconds(t) AS at")
    parent = spark.createDataFrame([("late", 3), ("ok", 0)], "id string, t int").selectExpr("id", "timestamp_seconds(t) AS made")
    edge = Edge("c", "k", "r", "p", "id", "at", "made")
    got = []
    for hot in (10, 1_000_000):
        monkeypatch.setattr(orphans, "HOT", hot)
        got.append(sorted(map(str, direct_orphans(child, parent, edge).collect())))
    want = sum(1 for _, r, t in rows if r == "gone" or r == "late" and t < 3)
    assert got[0] == got[1] and len(got[0]) == want
