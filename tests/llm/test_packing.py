import random
from itertools import product

import numpy as np
import pytest

from strataseek.llm import packing as P
from strataseek.llm.tokens import encoder, token_counts


def optimum(sizes, cap):
    best = len(sizes)
    for code in product(range(len(sizes)), repeat=len(sizes)):
        if all(c <= max(code[:i], default=-1) + 1 for i, c in enumerate(code)):
            fill = [0] * len(sizes)
            for c, s in zip(code, sizes, strict=True):
                fill[c] += s
            if max(fill) <= cap:
                best = min(best, sum(f > 0 for f in fill))
    return best


def test_bound_never_exceeds_the_optimum():
    r = random.Random(4)
    tight = 0
    for _ in range(120):
        cap = r.randint(4, 30)
        sizes = [r.randint(1, cap) for _ in range(r.randint(1, 6))]
        best, bound = optimum(sizes, cap), P.lower_bound(np.array(sizes), cap)
        assert bound <= best
        tight += bound == best
    assert tight > 100
    assert P.lower_bound(np.array([6, 6, 6]), 10) == 3 and P.lower_bound(np.array([0, 0]), 10) == 0


def test_best_fit():
    assert P.best_fit_decreasing([7, 6, 4, 3], 10) == [0, 1, 1, 0]
    assert P.best_fit_decreasing([10, 0, 0], 10) == [0, 1, 1]
    assert P.best_fit_decreasing([], 10) == []


def test_pack(spark, monkeypatch):
    r = random.Random(1)
    sizes = [(i, r.choice([0, 3, 40, 51, 49, 26, 100, 101, 250, r.randint(1, 99)])) for i in range(800)] + [(1000, None), (1001, 500)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "doc_id long, n_tokens long, container string")
    out = P.pack(df, 100, partition_items=100).collect()
    fill, places, got = {}, {}, {}
    for x in out:
        fill[x.container] = fill.get(x.container, 0) + x.n_tokens
        places.setdefault(x.container, []).append(x.position)
        got.setdefault(x.doc_id, []).append((x.piece_no, x.n_tokens))
    assert max(fill.values()) <= 100 and all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    for i, n in sizes:
        n = n or 0
        pieces = sorted(got[i])
        assert sum(s for _, s in pieces) == n and [k for k, _ in pieces] == list(range(len(pieces)))
        assert len(pieces) == max(1, -(-n // 100)) and all(s == 100 for _, s in pieces[:-1])
    assert len(fill) <= 1.03 * -(-sum(s or 0 for _, s in sizes) // 100) + 2
    assert P.pack(df.where("doc_id < 0"), 100).count() == 0
    assert [(x.n_tokens, x.position) for x in P.pack(df.where("doc_id = 1000"), 100).collect()] == [(0, 1)]
    with pytest.raises(ValueError):
        P.pack(df, 0)


def test_documents(spark):
    texts = ["", None, "one two", "word " * 3000, "<|endoftext|>", "数据 " * 100, "one two"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    sizes = {x.doc_id: x.n_tokens for x in token_counts(docs, ["doc_id"]).collect()}
    assert sizes == {i: len(encoder().encode_ordinary(t or "")) for i, t in enumerate(texts)}
    limits = spark.createDataFrame([("s", "token", 64, 0), ("l", "token", 4096, 0), ("c", "char", 10, 0)], "limit_id string, unit string, capacity long, overlap long")
    packed = P.pack_documents(docs, limits)
    rep = {x.limit_id: x for x in P.report(packed, limits).collect()}
    assert set(rep) == {"s", "l"} and all(x.n_containers == x.least and x.n_tokens == sum(sizes.values()) for x in rep.values())
