"""Small cases of the ranking, versioning, graph, dedup and skew operators."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataseek import runtime
from strataseek.functions import text as T
from strataseek.operators import fulltext as X
from strataseek.operators import graph as G
from strataseek.operators import ranking as R
from strataseek.operators import skew
from strataseek.operators import versioning as V
from strataseek.operators import dedup
from strataseek.operators.dedup import distinct_by_key, one_per_key


def brute_bm25(texts, phrases):
    toks = {k: re.findall(r"[^\W_]+", T.fold_text(t or "")) for k, t in texts.items()}
    avg = sum(map(len, toks.values())) / len(toks)
    tf = {k: [sum(ts[i : i + len(p)] == p for i in range(len(ts))) for p in phrases] for k, ts in toks.items()}
    df = [sum(f[i] > 0 for f in tf.values()) for i in range(len(phrases))]
    out = {}
    for k, f in tf.items():
        if any(f):
            norm = 1.2 * (0.25 + 0.75 * len(toks[k]) / avg)
            out[k] = -sum(max(1e-6, math.log((len(toks) - d + 0.5) / (d + 0.5))) * x * 2.2 / (x + norm) for x, d in zip(f, df, strict=True))
    return out


def test_bm25_both_ways(spark):
    r = random.Random(3)
    texts = {i: " ".join(r.choice(["Été", "foo", "bar", "foo.bar", "common", "数据", "x_y"]) for _ in range(r.randint(0, 9))) for i in range(40)} | {40: None, 41: "", 42: "foo foo foo bar bar", 43: "common " * 400}
    df = spark.createDataFrame([(k, t, 1.0) for k, t in texts.items()], "id long, text string, score double")
    phrases = R.query_phrases("foo.bar ete Common common 数据")
    assert phrases == [["foo", "bar"], ["ete"], ["common"], ["common"], ["数据"]]
    want = brute_bm25(texts, phrases)
    path = runtime.scratch_path(spark)
    X.write(df, "id", "text", path)
    index, stats = spark.read.schema(X.POSTINGS).parquet(f"{path}/postings"), spark.read.schema(X.STATS).parquet(f"{path}/stats")
    stored = X.search(index, stats, phrases)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", stored._jdf.queryExecution().toString())
    for got in (R.bm25(df, "text", phrases), stored.selectExpr("CAST(doc AS long) AS id", "score")):
        rows = {x.id: x.score for x in got.collect()}
        assert rows.keys() == want.keys() and all(math.isclose(rows[k], want[k], rel_tol=1e-9) for k in want)
    assert R.bm25(df.where("id < 0"), "text", phrases).count() == 0
    assert X.search(index.where("doc = '-1'"), stats.where("n_docs < 0"), phrases).count() == 0
    with pytest.raises(R.QueryError):
        R.query_phrases("the of a")


def test_pages_walk_everything_once(spark):
    df = spark.createDataFrame([(float(i % 3), i) for i in range(25)], "score double, id long")
    seen, after = [], None
    while rows := R.page(df, ["score", "id"], 4, after).collect():
        seen += [tuple(x) for x in rows]
        after = seen[-1]
    assert seen == sorted((float(i % 3), i) for i in range(25))


def test_scalars(spark):
    df = spark.createDataFrame([("a  b\n c",), ("x" * 100,), (None,), ("",)], "s string")
    assert [x.c for x in df.select(T.compact_line(F.col("s"), 10).alias("c")).collect()] == ["a b c", "x" * 9 + "…", None, ""]
    t = spark.createDataFrame([("One. Two is 3.5! 三。四\nfive",)], "s string")
    assert t.select(T.claims(F.col("s"))).first()[0] == ["One", "Two is 3.5", "三", "四", "five"]
    assert t.select(T.window(F.lit("a😀b"), 1, 1)).first()[0] == "😀"


def test_lineages(spark):
    rows = [(f"g{i}", f"g{i - 1}" if i else None, "published") for i in range(150)] + [("b", "g3", "published"), ("c", "b", "building"), ("d", "c", "published"), ("d", "c", "published")]
    got = V.lineages(spark.createDataFrame(rows, "id string, parent_id string, state string"))
    assert {r.ancestor: r.depth for r in got.where("id = 'b'").collect()} == {"b": 0, "g3": 1, "g2": 2, "g1": 3, "g0": 4}
    assert got.where("id = 'g149'").count() == 150 and got.where("id = 'd'").count() == 1
    assert V.lineages(spark.createDataFrame([], "id string, parent_id string, state string")).count() == 0


def test_refresh_diff(spark):
    old = [("p", "same", "s1", 1, 5), ("p", "edit", "s2", 2, 5), ("p", "gone", "s3", 3, 5), ("p", "away", "s4", 4, 5), ("p", "nul", None, 7, 5), ("p", "nul2", None, 8, 5), ("p", "nul3", None, 9, None), ("p", "d1", "s5", 5, 5), ("p", "d2", "s5", 5, 5), ("p", "big", None, 70, 5), ("p", "twin1", None, 80, 5), ("p", "twin2", None, 80, 5)]
    new = [("p", "same", "s1", 1, 9), ("p", "edit", "s9", 2, 5), ("p", "here", "s4", 4, 5), ("p", "fresh", "s8", 8, 5), ("p", "nul", None, 7, 5), ("p", "nul2", None, 8, 6), ("p", "nul3", None, 9, None), ("p", "d3", "s5", 5, 5), ("p", "bigger", None, 70, 8), ("p", "twin3", None, 80, 5), ("q", "here", "s3", 3, 5)]
    s = "project_id string, rel_path string, sha256 string, size long, modified long"
    got = {(r.project_id, r.rel_path): (r.action, r.moved_from) for r in V.refresh_diff(spark.createDataFrame(old, s), spark.createDataFrame(new, s)).collect()}
    want = {"same": ("unchanged", None), "edit": ("new_version", None), "gone": ("tombstone", None), "away": ("renamed_away", None), "here": ("renamed", "away"), "fresh": ("new", None), "nul": ("unchanged", None), "nul2": ("new_version", None), "nul3": ("new_version", None)}
    want |= {"d1": ("tombstone", None), "d2": ("tombstone", None), "d3": ("new", None), "big": ("tombstone", None), "bigger": ("possible_move", "big"), "twin1": ("tombstone", None), "twin2": ("tombstone", None), "twin3": ("new", None)}
    assert got == {("p", k): v for k, v in want.items()} | {("q", "here"): ("new", None)}


def test_latest_per_key(spark):
    rows = [(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "d"), (None, 1, "e"), (None, 2, "f")]
    df = spark.createDataFrame(rows, "k long, at long, v string")
    assert {(r.k, r.v) for r in V.latest_per_key(df, ["k"], F.col("at"), F.col("v")).collect()} == {(1, "c"), (2, "d"), (None, "f")}
    assert {(r.k, r.v) for r in V.latest_per_key(df, ["k"], F.col("at"), F.col("v"), smallest=True).collect()} == {(1, "a"), (2, "d"), (None, "e")}


def test_superseded_and_equality(spark):
    n = spark.createDataFrame([(1, None, "note"), (2, 1, "note"), (3, 1, None)], "id long, supersedes_id long, record_type string")
    assert {r.id: (r.is_superseded, r.is_current) for r in V.superseded(n).collect()} == {1: (True, False), 2: (False, True), 3: (False, False)}
    a, b = (spark.createDataFrame([(x,) for x in v], "v int") for v in ([1, 1, 2], [1, 2, 3]))
    assert Counter((r.v, r.side) for r in V.same_rows(a, b).collect()) == {(1, "left"): 1, (3, "right"): 1}


def test_graph(spark):
    e = spark.createDataFrame([("a", "project", "b", "t", 1.0), ("b", "project", "a", "t", 1.0), ("b", "concept", "x", "u", 0.5), ("x", "concept", "y", "u", 0.5), *[("c", "concept", f"z{i:03}", "u", 0.1) for i in range(100)], ("b", "project", "c", "t", 0.2)], "source_id string, target_type string, target_id string, relation_type string, weight double")
    got = G.bfs(e, "a", 3)
    assert {(r.source_id, r.depth) for r in got.select("source_id", "depth").distinct().collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert got.where("source_id = 'c'").count() == G.FANOUT and G.bfs(e, "nobody", 2).count() == 0
    assert G.neighbours(e, "b").count() == 4 and G.neighbours(e, "b", "in").count() == 1
    with pytest.raises(ValueError):
        G.bfs(e, "a", 5)


def test_one_per_key(spark):
    rows = [(1, "a"), (1, "a"), (1, None), (2, "b"), (None, "c"), (None, "c")]
    df = spark.createDataFrame(rows, "id long, v string")
    assert Counter(map(tuple, one_per_key(df, "id").collect())) == {(1, "a"): 1, (2, "b"): 1, (None, "c"): 2}


def test_join_facts(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rows = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(60)] + [(None, 99)], "k string, i long")
    facts = spark.createDataFrame([("hot", 30, "h"), *[(f"k{i}", 1, "c") for i in range(0, 60, 2)]], "k string, n long, f string")
    out = skew.join_facts(rows, facts, ["k"], "n", 61, share=0.1).collect()
    assert Counter(r.f for r in out) == {"h": 30, "c": 30} and len({r.i for r in out}) == 60


def test_distinct_by_key(spark, monkeypatch):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d"), (None, "e"), (3, None), (3, None)]
    for keep in (rows, [r for r in rows if r[0] is not None], [(2, "c"), (None, "d")], [(2, "c")], [(1, "a"), (1, "a"), (None, "x")]):
        df = spark.createDataFrame(keep, "id long, v string")
        for bound in (500_000, 0):
            monkeypatch.setattr(dedup, "REPEATED_MAX", bound)
            assert Counter(map(tuple, distinct_by_key(df, "id").collect())) == Counter(dict.fromkeys(keep, 1))
            assert len({r.id for r in one_per_key(df, "id").collect() if r.id}) == len({k for k, _ in keep if k})
