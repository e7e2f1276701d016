from datetime import datetime as dt

from strataseek.functions.text import instant, json_strings, slugify
from strataseek.operators import references
from strataseek.plans.records import summary_references

REFS = "ref_table string, ref_id string, ref_at timestamp, child long, since string"
PARENTS = "ref_table string, ref_id string, valid_from timestamp, valid_to timestamp"


def reasons(spark, refs, parents):
    out = references.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    return sorted((r.child, r.reason) for r in out.collect())


def test_reasons_and_bounds(spark):
    t = dt(2025, 3, 1)
    refs = [("a", "gone", t, 1, "x"), ("a", "late", t, 2, "x"), ("a", "ended", t, 3, None), ("a", "fine", t, 4, "x"), ("a", "edge", t, 5, "x"), ("b", "fine", t, 6, "x")]
    parents = [("a", "late", dt(2025, 4, 1), None), ("a", "ended", dt(2025, 1, 1), t), ("a", "fine", None, None), ("a", "edge", t, dt(2025, 3, 2))]
    assert reasons(spark, refs, parents) == [(1, "missing"), (2, "later"), (3, "ended"), (6, "missing")]


def test_null_time_ids_repeats_and_empty(spark):
    refs = [("a", "x", None, 1, None), ("a", None, None, 2, None), (None, "x", None, 3, None), ("a", "y", None, 4, None), ("a", "y", None, 4, None)]
    parents = [("a", "x", dt(2025, 1, 1), dt(2025, 1, 2)), ("a", "x", dt(2025, 1, 1), None), (None, None, None, None)]
    assert reasons(spark, refs, parents) == [(4, "missing"), (4, "missing")]
    assert reasons(spark, [], parents) == []
    assert reasons(spark, refs[:1], []) == [(1, "missing")]


def test_hot_key_against_brute_force(spark):
    refs = [("a", "hot" if i % 3 else f"k{i}", dt(2025, 1, 1 + i % 28), i, None) for i in range(900)]
    parents = [("a", "hot", dt(2025, 1, 10), dt(2025, 1, 20))] + [("a", f"k{i}", None, None) for i in range(0, 900, 2)]
    life = {p[1]: p[2:] for p in parents}

    def case(r):
        if r[1] not in life:
            return "missing"
        since, until = life[r[1]]
        return "later" if since and r[2] < since else "ended" if until and r[2] >= until else None

    assert reasons(spark, refs, parents) == sorted((r[3], case(r)) for r in refs if case(r))
    report = references.orphan_report(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert sum(r.n_orphans for r in report.collect()) == sum(case(r) is not None for r in refs)


def test_summary_references(spark):
    schema = "id long, target_type string, target_id string, evidence_ids string, created_at string"
    rows = [
        (1, "project", " /srv/src/Opal Atlas", '["AB ", " kb://evidence/cd", "", "  ", 5, null, {"x": "y"}, ["z"], "KB://evidence/EF"]', "2025-04-07T22:09:58+02:00"),
        (1, "project", " /srv/src/Opal Atlas", '["AB ", " kb://evidence/cd", "", "  ", 5, null, {"x": "y"}, ["z"], "KB://evidence/EF"]', "2025-04-07T22:09:58+02:00"),
        (2, "workflow", "free name", '["ab"', "soon"),
        (3, "file", None, None, None),
        (4, "concept", "..", '{"a": "b"}', "2025-04-07 22:09:58"),
    ]
    got = {(r.summary_id, r.ref_table, r.ref_id) for r in summary_references(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "evidence", "ab"), (1, "evidence", "cd"), (1, "evidence", "ef"), (1, "project", "opal-atlas"), (4, "concept", "item")}


def test_scalars(spark):
    df = spark.createDataFrame([("2025-04-07T22:09:58+02:00", '["a"]', "会议"), ("2025-04-07T20:09:58.000000Z", "nope", "A b/"), ("2025-04-07T20:09:58", None, None)], "t string, j string, s string")
    rows = df.select(instant(df.t).cast("long").alias("t"), json_strings(df.j).alias("j"), slugify(df.s).alias("s")).collect()
    assert {r.t for r in rows} == {1744056598}
    assert [r.j for r in rows] == [["a"], [], []]
    assert [r.s for r in rows] == ["item", "item", None]
