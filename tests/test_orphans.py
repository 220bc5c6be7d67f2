import datetime as dt

from folioscope.operators.orphans import ForeignKey, find_orphans, orphan_report

D = lambda month, day=1: dt.datetime(2024, month, day)
FKS = (
    ForeignKey("leaf", "mid", "at", "mid", "id"),
    ForeignKey("mid", "root", "loaded_at", "root", "id"),
)


def tables(spark, leaf, mid, root):
    times = "loaded_at timestamp_ntz, deleted_at timestamp_ntz"
    return {
        "leaf": spark.createDataFrame(leaf, "mid long, at timestamp_ntz, value string, key string"),
        "mid": spark.createDataFrame(mid, f"id long, root string, {times}"),
        "root": spark.createDataFrame(root, f"id string, {times}, start string, stop string"),
    }


def found(spark, *rows):
    out = find_orphans(tables(spark, *rows), FKS).collect()
    return {(r.ref_table, r.ref_value, r.period, r.reason, r.kind) for r in out}


def test_reasons_and_inheritance(spark):
    root = [("r", D(1), None, "x", "y"), ("gone", D(1), D(3), None, None)]
    mid = [(1, "r", D(2), None), (2, "gone", D(4), None), (3, "none", D(2), None), (4, "r", D(6), None), (5, "r", D(1), D(2))]
    leaf = [(k, D(5), "v", "k") for k in (1, 2, 3, 4, 5, 9)] + [(9, D(5), "v", "k"), (None, D(5), "v", "k"), (1, None, "v", "k")]
    assert found(spark, leaf, mid, root) == {
        ("mid", "gone", "2024-04", "deleted", "direct"),
        ("mid", "none", "2024-02", "missing", "direct"),
        ("leaf", "4", "2024-05", "late", "direct"),
        ("leaf", "5", "2024-05", "deleted", "direct"),
        ("leaf", "9", "2024-05", "missing", "direct"),
        ("leaf", "2", "2024-05", "inherited", "inherited"),
        ("leaf", "3", "2024-05", "inherited", "inherited"),
    }


def test_several_rows_of_one_key(spark):
    root = [("r", D(1), None, None, None)]
    mid = [(1, "r", D(1), D(2)), (1, "r", D(4), D(5)), (1, "r", D(4), D(8)), (1, "r", D(1), D(2)), (2, "r", None, None), (3, "r", D(5), D(4))]
    leaf = [(1, D(m), "", "") for m in (1, 2, 3, 4, 6, 8)] + [(2, D(3), "", ""), (3, D(6), "", "")]
    got = found(spark, leaf, mid, root)
    assert got == {("leaf", "1", f"2024-{m:02}", "deleted", "direct") for m in (2, 3, 8)} | {
        ("leaf", "2", "2024-03", "deleted", "direct"),
        ("leaf", "3", "2024-06", "deleted", "direct"),
    }


def test_empty_tables(spark):
    assert found(spark, [], [], []) == set()
    assert found(spark, [(1, D(5), "", "")], [], []) == {("leaf", "1", "2024-05", "missing", "direct")}


def test_cycle_reaches_a_fixpoint(spark):
    rows = [(1, 2, D(1), None), (2, 3, D(1), None), (3, 99, D(1), None), (4, 4, D(1), None)]
    node = spark.createDataFrame(rows, "id long, parent long, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    out = find_orphans({"node": node}, [ForeignKey("node", "parent", "loaded_at", "node", "id")])
    assert {(r.ref_value, r.kind) for r in out.collect()} == {("99", "direct"), ("3", "inherited"), ("2", "inherited")}
    report = orphan_report(out).collect()
    assert [(r.direct_refs, r.inherited_refs) for r in report] == [(1, 2)]
