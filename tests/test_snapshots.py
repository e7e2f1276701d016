import random
from datetime import datetime as dt
from datetime import timedelta

from strataseek.operators.snapshots import file_changes

JOBS = "project_id string, scan_no int, state string, step string"
ROWS = "project_id string, scan_no int, rel_path string, loaded_at timestamp, sha256 string, size long, mtime double, prev string"


def changes(spark, jobs, rows):
    out = file_changes(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(rows, ROWS))
    return sorted(tuple(r) for r in out.collect())


T = dt(2025, 1, 1)
DONE = [("p", n, "committed", "") for n in (1, 3, 4, 6)] + [("p", 2, "failed", "")]


def test_kinds_of_change(spark):
    rows = [
        ("p", 1, "A.py", T, "x", 1, 5.2, ""),
        ("p", 3, "./a.py", T, "X", 2, 9.0, ""),  # same digest in another case
        ("p", 4, "a.py", T, None, 2, 9.9, ""),  # null digest, same size and second
        ("p", 6, "a.py", T, "y", 3, 9.9, ""),  # null before, size differs
        ("p", 2, "b.py", T, "x", 1, 1.0, ""),  # failed scan
        ("p", 3, "c\\d.py", T, "x", 1, 1.0, ""),
        ("p", 6, "c/d.py", T, "x", 1, 1.0, ""),
        ("p", 4, "e.py", T, "old", 1, 1.0, ""),
        ("p", 4, "e.py", T + timedelta(days=90), "new", 1, 1.0, ""),
        ("p", 4, "e.py", T + timedelta(days=90), "new", 1, 1.0, ""),
        ("p", 6, "e.py", T, "new", 1, 1.0, ""),
        ("q", 1, "z.py", T, "x", 1, 1.0, ""),  # no such job
        (None, 1, "n.py", T, "x", 1, 1.0, ""),
        ("p", 1, None, T, "x", 1, 1.0, ""),
    ]
    assert changes(spark, DONE, rows) == [(3, "p", "c/d.py", "added"), (4, "p", "c/d.py", "removed"), (4, "p", "e.py", "added"), (6, "p", "a.py", "changed"), (6, "p", "c/d.py", "added")]


def test_empty_inputs_and_null_payload(spark):
    assert changes(spark, [], [("p", 1, "a", T, "x", 1, 1.0, "")]) == []
    assert changes(spark, DONE, []) == []
    rows = [("p", 1, "a", None, None, None, None, ""), ("p", 3, "a", None, None, None, None, ""), ("p", 4, "a", None, None, 1, None, ""), ("p", 6, "a", None, "h", 1, None, "")]
    assert changes(spark, DONE, rows) == [(4, "p", "a", "changed")]


def test_against_brute_force(spark):
    r = random.Random(7)
    rows = []
    for scan in range(1, 7):
        for f in range(30):
            for _ in range(r.choice([0, 1, 1, 1, 2])):
                rows.append(("p", scan, f"f{f}", T + timedelta(seconds=len(rows)), r.choice(["u", "v", None]), r.choice([1, 2]), r.choice([1.0, 1.5, 2.0]), ""))
    state = {}
    for p, n, path, at, h, size, m, _ in rows:
        state[n, path] = (h, size, int(m))
    want = []
    steps = [1, 3, 4, 6]
    for a, b in zip(steps, steps[1:], strict=False):
        for f in range(30):
            x, y = state.get((a, f"f{f}")), state.get((b, f"f{f}"))
            if x is None and y is None:
                continue
            kind = "added" if x is None else "removed" if y is None else "changed" if (x[0] != y[0] if x[0] and y[0] else x[1:] != y[1:]) else None
            if kind:
                want.append((b, "p", f"f{f}", kind))
    assert changes(spark, DONE, rows) == sorted(want)
