import math
from collections import Counter

import regex

from strataseek.llm.terms import score_terms


def brute(records, window):
    toks = {k: regex.findall(r"[\p{L}\p{N}]+", t.lower()) for k, t in records.items() if t}
    df = Counter(x for ts in toks.values() for x in set(ts))
    out = {}
    for k, ts in toks.items():
        near = {x: set() for x in ts}
        for i, a in enumerate(ts):
            for b in ts[i + 1 : i + window]:
                if a != b:
                    near[a].add(b)
                    near[b].add(a)
        for x, c in Counter(ts).items():
            out[k, x] = (c, len(near[x]), df[x], round(len(near[x]) * math.log((len(records) + 1) / df[x]), 9))
    return out


def test_against_brute_force(spark):
    texts = ["The cat sat on the mat; the cat_sat!", "", None, "été ÉTÉ x² 数据 数据库 數", "one", "a a a a", "the " * 50 + "end", "İstanbul ﬁne", "the cat " * 5]
    rows = [("chunks" if i % 2 else "summaries", i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "source_table string, record_id long, content string, term long")
    got = {(r.record_id, r.term): (r.tf, r.degree, r.df, r.weight) for r in score_terms(df.drop("term")).collect()}
    want = brute(dict(enumerate(texts)), 4)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][:3] == v[:3] and abs(got[k][3] - v[3]) < 1e-6


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "source_table string, record_id long, content string, term string, df long")
    assert score_terms(df).count() == 0


def test_hot_terms_take_the_broadcast(spark, monkeypatch):
    from strataseek.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rows = [("chunks", i, f"common word{i} word{i}") for i in range(40)]
    out = score_terms(spark.createDataFrame(rows, "source_table string, record_id long, content string")).collect()
    assert len(out) == 80 and {r.df for r in out if r.term == "common"} == {40}
