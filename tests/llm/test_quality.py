import math
import random
from collections import Counter

import pytest

from strataseek.llm import quality as Q

COMMON = {
    "en": "the a of and in to for that is was by with on as if at from it this we but so one when while because since".split(),
    "de": "der die das den dem und in am im bei mit für von wenn weil aber ohne nach vor eine ein sich zu".split(),
    "fr": "le la les de des du et en à pour dans une un sans avec mais que qui après avant chaque quand".split(),
}
J = Q.Judge(COMMON)
PROSE = "The membership log closes a window of forty lines, while the newer offset closes the public item. We saw 3 of 9 cases in which the reader keeps the record. "


def share(text):
    return Q.natural_share(text, J)


@pytest.mark.parametrize(
    "text",
    [
        PROSE, PROSE.upper(), PROSE.lower().replace(".", "").replace(",", ""), PROSE.replace(", ", ",\n").replace("in which", "in\nwhich"), "Die neue Fassung sammelt die belegten Zeilen am Ende des Monats. Zum Schluss heißt das: die Quelle prüft den älteren Stand.",
        "L'ancien index compare l'élément manquant. Cette note vérifie les limites de la recherche.", "在月底这条笔记比较了过期的摘要。在夜间扫描之后，扫描器会检查整个项目目录。", "# Head\n\n" + PROSE * 1,
        "Calling line.score(4) twice returned HTTP 409, so streljeje retries stopped. Vekipibran needs Python 3.14, 32 GB RAM and picedi 3.",
    ],
)
def test_prose(text):
    assert share(text) > 0.6


@pytest.mark.parametrize(
    "text",
    [
        "", "   \n", "- the graph\n- the plain page\n* one more item\n", "| a | 12 | b |\n| c | 13 | d |\n", "path/status/member_entry.ts\nrank/group/total_label.md\n", "lock reader term record vault kind digest state\nplan path record stage parser doc",
        "2025-08-05 00:01:15 DEBUG lock.version[8359]: cache=entry model=66\n" * 4, "def f(a, b=None):\n    for x in sorted(a, key=len):\n        y.append(x ** 2)\n    return y\n", "Back to the keys\nMore on this note\nAll of the items\nGo to version\n",
        "of open rare pass because renamed the term end total files for month policy the membership scan collects The window rejects at during The of model even compares former Most every lines a the repairs primary of of short the a",
        "Nc vre rglzoriz ik jhzcna mqtq ahvxcgsfi et kzqzf orxnjpagt. Txqosvoi edsdpb fdx kddzhjpw pns rtfjxsvfak ml alu.", (PROSE.split(". ")[0] + ".\n") * 6, "VTdBLbPM487BuPoQO4vptZbYWeXnXZwXc3L2I5oTJbwRS2NmtKhoqFFyLyQ18EAHWGYPoLF9WAbk\n" * 3,
        "Seed » Group » Keys\nColumn » Claim » Status\n", "the older snapshot ; in most of the cases that we have seen ; the collection policy ; 743\n", "User............ reader 75\nText........ option 294\n", '{"list": 83, "status": "scope", "doc": [4, 9]}\n',
    ],
)
def test_not_prose(text):
    assert share(text) < 0.4


def stats(text):
    return dict(zip(Q.STATS, (*Q.described(text), *Q.ranked(text, J)), strict=True))


def test_statistics():
    v = stats("The cat sat. The cat sat.\nIs it 12?\n\n- a\n")
    assert (v["n_words"], v["n_lines"]) == (11, 3) and v["end_punct_share"] == 2 / 3 and v["repeated_share"] == 1 / 4 and v["digit_ratio"] == 2 / 29 and v["symbol_ratio"] == 4 / 29
    assert v["sentence_rate"] == 3 / 29 and v["short_line_share"] == 1 / 3 and v["common_share"] == 5 / 11
    assert stats("the of and so")["wrong_order_share"] == 1.0 and stats("在月底这条笔记。")["n_words"] == 8
    assert set(stats("").values()) == {0} == set(stats(" \n").values()) and len(stats("\ud800 x")) == len(Q.STATS)


def test_tails_are_exact(spark):
    r = random.Random(5)
    rows = [(g, "s", float(r.choice([0, 0, 0, 1, 2, r.random()]))) for g in "aab" for _ in range(400)] + [("c", "s", 7.0)]
    counted = spark.createDataFrame([(*k, n) for k, n in Counter(rows).items()], "grp string, stat string, value double, n long")
    got = {(t.grp, t.value): (t.n, t.left, t.right) for t in Q.tail_probabilities(counted, 7).collect()}
    groups = {g: [v for h, _, v in rows if h == g] for g in "abc"}
    want = {(g, v): (vs.count(v), sum(x <= v for x in vs) / len(vs), sum(x >= v for x in vs) / len(vs)) for g, vs in groups.items() for v in vs}
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and math.isclose(got[k][1], a) and math.isclose(got[k][2], b) for k, (n, a, b) in want.items())


def corpus(spark):
    rows = [(i, PROSE + f"The reader keeps item {i} for the team.", "en") for i in range(30)] + [(100, "a | b | c\n" * 5, "en"), (101, None, None), (102, "", "en"), (103, PROSE * 2_000 + "x y\n" * 9, None), (104, PROSE + "The end is here for the team.", "xx")]
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, outlier double")


def test_verdicts(spark):
    df = corpus(spark)
    out = {r.doc_id: r for r in Q.verdicts(df, COMMON).collect()}
    assert len(out) == df.count()
    assert {k for k, r in out.items() if not r.is_prose} == {100, 101, 102, 103}
    assert out[104].is_prose and out[101].lang == "und" and out[100].outlier > 4
    assert Q.verdicts(df.where("doc_id < 0"), COMMON).count() == 0


def test_many_languages_give_the_same(spark, monkeypatch):
    want = sorted(map(str, Q.verdicts(corpus(spark), COMMON).collect()))
    monkeypatch.setattr(Q, "LANGUAGES_MAX", 1)
    assert sorted(map(str, Q.verdicts(corpus(spark), COMMON).collect())) == want


def test_the_score_picks_what_is_read(spark):
    df = corpus(spark)
    read = {r.doc_id for r in Q.verdicts(df, COMMON).collect() if r.natural_share is not None}
    assert {100, 102} <= read and len(read) < 20
    assert {r.doc_id for r in Q.verdicts(df, COMMON, 1e9).where("NOT is_prose").collect()} == {101, 102}  # the empty texts
    # among tables a table does not stand out, one in another language does
    same = spark.createDataFrame([(i, "a | b | c\n" * 5, "en") for i in range(30)], "doc_id long, text string, lang string")
    assert Q.verdicts(same, COMMON).where("outlier > 0").count() == 0


def test_scores_against_brute_force(spark):
    rows = corpus(spark).collect()
    known = {r.doc_id: stats(r.text or "") for r in rows}
    lang = {r.doc_id: r.lang or "und" for r in rows}
    for r in Q.verdicts(corpus(spark), COMMON).collect():
        want = 0.0
        for s, side in Q.TAILS.items():
            group = [round(known[k][s], Q.DIGITS) for k in known if lang[k] == r.lang or r.lang != "en"]
            mine = round(known[r.doc_id][s], Q.DIGITS)
            p = sum(x <= mine if side < 0 else x >= mine for x in group) / len(group)
            want += -math.log(p) if p <= Q.TAIL_MAX else 0.0
        assert math.isclose(r.outlier, want, abs_tol=1e-5)
