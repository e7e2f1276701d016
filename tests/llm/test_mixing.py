import random
from itertools import product

from strataseek.llm import mixing as M


def test_subset_sum_is_exact():
    r = random.Random(9)
    for _ in range(150):
        items = [(r.randint(1, 12), r.randint(1, 3)) for _ in range(r.randint(1, 4))]
        items = list(dict(items).items())
        budget = r.randint(0, 40)
        sums = {sum(k * x for k, (x, _) in zip(ks, items, strict=True)) for ks in product(*(range(n + 1) for _, n in items))}
        best = min(sums, key=lambda s: (abs(s - budget), s))
        got = M.subset_sum(items, budget)
        assert sum(x * k for x, k in got.items()) == best and all(k <= dict(items)[x] for x, k in got.items())


def test_plan_source():
    r = random.Random(2)
    for _ in range(60):
        lengths = sorted({r.randint(0, 900): r.randint(1, 60) for _ in range(30)}.items())
        size = sum(x * n for x, n in lengths)
        k = r.randint(1, 3)
        budget = r.randint(0, k * size)
        uses = M.plan_source(lengths, budget, k, "s")
        total = sum(x * (p * n + e) for (x, n), (p, e) in zip(lengths, (uses[x] for x, _ in lengths), strict=True))
        assert all(0 <= e <= n and p + (e > 0) <= k for (x, n), (p, e) in zip(lengths, (uses[x] for x, _ in lengths), strict=True))
        assert abs(budget - total) <= 3
    assert M.plan_source([], 10, 2, "s") == {} and M.plan_source([(0, 5)], 10, 2, "s") == {0: (0, 0)}


def test_few_long_documents():
    assert M.plan_source([(248, 1), (797, 1), (1286, 1)], 2083, 1, "s") == {248: (0, 0), 797: (0, 1), 1286: (0, 1)}
    assert M.plan_source([(100, 1), (1000, 1)], 900, 1, "s") == {100: (0, 0), 1000: (0, 1)}  # 1000 is nearer than 100
    assert M.plan_source([(3_000_000, 2)], 2_900_000, 1, "s") == {3_000_000: (0, 1)}
    assert M.subset_sum([], 5) == {} and M.subset_sum([(9, 1)], 0) == {}


def test_the_binding_source_is_used_up():
    r = random.Random(4)
    for _ in range(500):
        weights = [r.random() + 0.01 for _ in range(r.randint(1, 9))]
        targets = {str(i): (w / sum(weights), r.randint(1, 4)) for i, w in enumerate(weights)}
        sizes = {s: r.randint(1, 90_000) for s in targets}
        got = M.budgets(sizes, targets)
        assert all(got[s] <= targets[s][1] * sizes[s] for s in got) and any(got[s] == targets[s][1] * sizes[s] for s in got)


def test_budgets():
    assert M.budgets({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 2)}) == {"a": 100, "b": 100}
    assert M.budgets({"a": 100}, {"a": (0.25, 2), "gone": (0.75, 9)}) == {"a": 200}
    assert M.budgets({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 2)}, total=300) == {"a": 100, "b": 150}
    assert M.budgets({}, {"a": (1.0, 1)}) == {} and M.budgets({"a": 5}, {"a": (0.0, 1)}) == {}


def run(spark, rows, targets, seed=0):
    sized = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, source string, n_tokens long, uses int")
    goal = spark.createDataFrame([(*t, 1) for t in targets], "source string, target_share double, max_repeats int, n_docs int")
    used = M.mix(sized, goal, seed)
    return {r.doc_id: r.uses for r in used.collect()}, {r.source: r for r in M.shares(used, sized, goal).collect()}


TARGETS = [("a", 0.6, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.0, 1)]


def test_mix(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "x", None]), r.choice([0, 7, 7, 7, r.randint(1, 400)])) for i in range(3000)]
    used, got = run(spark, rows, TARGETS)
    caps = {s: k for s, _, k in TARGETS}
    by = {d: (s, n) for d, s, n in rows}
    assert all(by[d][0] in caps and 1 <= u <= caps[by[d][0]] for d, u in used.items())
    assert all(abs(got[s].actual_share - share) < 1e-3 for s, share, _ in TARGETS)
    assert used == run(spark, rows, TARGETS)[0] != run(spark, rows, TARGETS, seed=5)[0]


def test_hot_length_is_picked_in_buckets(spark, monkeypatch):
    rows = [(i, "a" if i % 3 else "b", 5) for i in range(900)]
    plain = run(spark, rows, [("a", 0.5, 1), ("b", 0.5, 1)])[0]
    monkeypatch.setattr(M, "LENGTH_GROUP", 10)
    cut, got = run(spark, rows, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert len(cut) == len(plain) == 600 and got["a"].used_tokens == got["b"].used_tokens == 1500


def test_empty(spark):
    used, got = run(spark, [(1, None, 5), (2, "z", 5)], TARGETS)
    assert used == {} and got["a"].actual_share == 0 and got["a"].n_docs == 0
    assert run(spark, [], TARGETS)[0] == {}
