import json
import random

import pytest
from pyspark.sql import functions as F

from strataseek.llm import markup as M


def kinds(text):
    return {s.partition("__")[0] for s in M.signature(text).split() if "__" in s} & set(M.LANGUAGES)


@pytest.mark.parametrize(
    "text, want",
    [
        ("# Head\n", {"markdown"}), ("Head\n=====\n", {"markdown"}), ("a **b** c", {"markdown"}), ("see [x](y.md)", {"markdown"}), ("| a | b |\n|---|---:|\n", {"markdown"}), ("x `y()` z", {"markdown"}), ("~~a~~", {"markdown"}),
        ("> quoted", {"markdown"}), ("fact.[^1]", {"markdown"}), ("- [ ] task", {"markdown"}), ("an *old* one", {"markdown"}), ("![a](b.png", {"markdown"}),
        ("<b>x</b>", {"html"}), ("tail</span>", {"html"}), ("A &amp; B", {"html"}), ("x<br>y", {"html"}), ("<!-- note -->", {"html"}), ("<P>open", {"html"}), ("&#8212;", {"html"}),
        ("== Head ==", {"wiki"}), ("[[A|b]]", {"wiki"}), ("{{stale|2025}} x", {"wiki"}), ("'''bold'''", {"wiki"}), ("{|\n| a || b\n|}", {"wiki"}), ("** nested", {"wiki"}),
        ("\\section{A}", {"latex"}), ("we have $n^2 + 2n$ steps", {"latex"}), ("\\[ a \\]", {"latex"}), ("shown in~\\cite{x}.", {"latex"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"latex"}), ("\\end{table}", {"latex"}),
        # code keeps its content
        ("```html\n<b>x</b> $a^2$\n```", {"markdown"}), ("`<b>`", {"markdown"}), ("<pre># no **x**</pre>", {"html"}), ("\\begin{verbatim}\n<b>**x**\n\\end{verbatim}", {"latex"}), ("```\n[[open", {"markdown"}),
        # no markup
        ("- item\n* item\n1. item\n", set()), ("a < b and c > 6", set()), ("It cost $15 in March and $9 in April.", set()), ("2 * 8 * 4 cells", set()), ("R&D said so & left", set()), ("[2, 49] was {twice}", set()), ("#645 and C#", set()),
        ("line_start and line_end", set()), ("D:\\vault\\source\\policy", set()), ("https://a.b/c_d_e", set()), ("5 % -- or more; x <= 9", set()), ("", set()), ("- a\n- b\n", set()), ("it's 'so' a|b", set()),
    ],
)
def test_kinds(text, want):
    assert kinds(text) == want
    assert kinds(text.replace("\n", "\r\n")) == want


def test_clean_keeps_structure():
    text = "Title\n=====\n<p>A &amp; <b>B</b><br>C</p>\r\n<ol><li>x</li><li>y</li></ol>\n```py\nif a < b: *c*\n```\n== Part ==\n* one\n** two\n[[T|word]] {{x}} $a_1^2$ \\emph{so}\n<!-- no -->\n| a | **b** |\n|---|---|\n"
    out = M.clean(text)
    for keep in ["# Title", "A & B\nC", "1. x\n2. y", "```py\nif a < b: *c*\n```", "# Part", "- one\n- two", "word", "$a_1^2$", "so", "a | b"]:
        assert keep in out, keep
    for gone in ["<", "==", "[[", "{{", "&amp;", "emph", "---"]:
        assert gone not in out.replace("if a < b", ""), gone
    assert M.clean("") == "" and M.clean("plain text") == "plain text"


def fold(x):
    return M.fold(list(x), [1] * len(x))


def test_wrappers_cover_their_streams():
    r = random.Random(3)
    for size in (14, 14, 90):
        for _ in range(30):
            lines = [[r.choice("abcdT") for _ in range(r.randint(1, size))] for _ in range(r.randint(1, 12))]
            w = fold(lines[0])
            for s in lines[1:]:
                w = M.align(w, fold(s))
            assert all(len(M.settle(w, s)) == len(s) for s in lines)
            assert len(w) <= M.MAX_ITEMS and sum(sum(x[3]) for x in w) == sum(map(len, lines))
    assert fold("aTbTbTbTc") == [[["a"], 1, 1, [1]], [["T", "b"], 1, 0, [3, 3]], [["T"], 1, 1, [1]], [["c"], 1, 1, [1]]]
    assert M.align(fold("aT"), fold("axT")) == [[["a"], 1, 1, [2]], [["x"], 0, 1, [1]], [["T"], 1, 1, [2]]]
    assert M.settle(fold("a"), ["b"]) is None and M.settle(M.close(fold("ab")), ["b", "b", "a"]) == [1, 1, 1]


@pytest.mark.parametrize(
    "text, broken",
    [
        ("a **b** c", []), ("a **b c", ["markdown__strong"]), ("<p>x</p><br>", []), ("x</span> y", ["html__/span"]), ("<ul><li>a</ul>", ["html__li"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", []), ("\\end{table}", ["latex__table"]),
        ("{{a}} b }}", ["wiki__template"]), ("> q", ["markdown__quote"]), ("```\nx", ["markdown__fence"]), ("```\nx\n```", []), ("| a | b |\n|---|---|\n", []), ("| a | b |\n", ["markdown__row"]), ("-->", ["html__comment"]), ("![a](b", ["markdown__image"]), ("\\[ x", ["latex__display"]),
    ],
)
def test_broken_tokens(text, broken):
    assert [s for line in M.stream(text) for _, s, w in line if w == 1] == broken


def found(spark, rows):
    df = spark.createDataFrame(rows, "id long, project_id string, rel_path string, content string")
    return set(map(tuple, M.markup_kinds(df).collect())), {r.chunk_id: r.content for r in M.clean_chunks(df).collect()}


def test_the_wrapper_settles_broken_tokens(spark):
    alone = [(1, "p", "a.md", "the tail</span> of it"), (2, "p", "b.md", "# Head\n"), (3, "p", "c.txt", "plain")]
    assert found(spark, alone) == ({(2, "markdown")}, {2: "# Head"})  # seen once and never whole: part of the text
    kinds, clean = found(spark, [*alone, (4, "p", "d.md", "one more</span> of the host")])
    assert kinds == {(1, "html"), (2, "markdown"), (4, "html")} and clean[1] == "the tail of it"
    kinds, clean = found(spark, [*alone, (5, "p", "e.md", "a <span>whole</span> one")])
    assert (1, "html") in kinds  # aligned with the end of a whole one
    kinds, clean = found(spark, [*alone, (5, "p", "e.md", "<span>whole</span> one")])
    assert (1, "html") not in kinds  # whole ones stand in lines of another kind
    kinds, clean = found(spark, [(1, "p", "a.md", "# Head\nso }} it ends")])
    assert kinds == {(1, "markdown")} and clean[1] == "# Head\n\nso }} it ends"


def test_large_hosts_have_wrappers_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(M, "HOST_MIN", 3)
    rows = [(i, "big", f"{i}.md", f"# Head {i}") for i in range(5)] + [(9, "big", "x.md", "lone</b> tail"), (10, "q", "y.md", "lone</b> tail"), (11, "r", "y.md", "more</b> tail")]
    kinds, _ = found(spark, rows)
    assert {(10, "html"), (11, "html")} <= kinds and (9, "html") not in kinds


def test_wrappers_do_not_depend_on_partitions(spark):
    r = random.Random(7)
    rows = [("h", s[0], json.dumps(M.fold(s, [1] * len(s))), 1 + i % 3) for i, s in enumerate([[r.choice("abT") for _ in range(r.randint(1, 9))] for _ in range(300)])]
    df = spark.createDataFrame(rows, "host string, lead string, items string, n long").groupBy("host", "lead", "items").agg(F.sum("n").alias("n"))
    one = sorted(map(tuple, M.wrappers(df.repartition(1)).collect()))
    assert one == sorted(map(tuple, M.wrappers(df.repartition(7)).collect())) and {x[0] for x in one} == {"h", M.ALL_HOSTS}


def test_many_hosts(spark, monkeypatch):
    rows = [(i, f"h{i % 7}", "x.md", f"# head {i}\n<b>x</b>" if i % 2 else "plain") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, project_id string, rel_path string, content string")
    want = sorted(map(tuple, M.markup_kinds(df).collect()))
    monkeypatch.setattr(M, "HOSTS_MAX", 2)
    assert sorted(map(tuple, M.markup_kinds(df).collect())) == want and len(want) == 40


def test_spark(spark):
    rows = [(1, "p", "a/x.MD", "# A\n<b>x</b>"), (1, "p", "a/x.MD", "# A\n<b>x</b>"), (2, None, "x.tex", "\\section{a}"), (3, "p", "x.py", "# A"), (4, "p", None, "# A"), (5, "p", "e.md", None), (6, "p", "e.md", ""), (7, "p", "plain.txt", "word " * 30_000), (8, "q", "z.rst", "a\n===\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, project_id string, rel_path string, content string, host string")
    assert sorted(map(tuple, M.markup_kinds(df).collect())) == [(1, "html"), (1, "markdown"), (2, "latex"), (8, "markdown")]
    assert {r.chunk_id: (r.content, r.kinds) for r in M.clean_chunks(df).collect()} == {1: ("# A\n\nx", ["html", "markdown"]), 2: ("# a", ["latex"]), 8: ("# a", ["markdown"])}
    assert M.markup_kinds(df.where("id = 9")).count() == 0


@pytest.mark.parametrize(
    "text, lone",
    [
        ("'''a ''b'''''", []), ("'''''a'' b'''", []), ("''a'''''b'''", []), ("'''a ''b'''", ["wiki__quote"]), ("**a *b***", []), ("**a __b c**", ["markdown__strong"]), ("a **b\n\nc** d", ["markdown__strong", "markdown__strong"]),
        ("{{A\n| b = {{c|{{d|{{e}}}}}}\n}}", []), ("<!-- open", []), ("a --> b", ["html__comment"]), ("> a\n\nb", []), ("a\n> b\n> c\nd", []), ("a\n> 9 b\nc", ["markdown__quote"]), ("* a\n** b", []), ("a\n** b", ["wiki__nested"]),
        ("a\n\n* * *\n\nb", []), ("a\n___\nb", ["markdown__rule"]), ("a\n\n=====\nb", ["markdown__underline"]),
    ],
)
def test_lone_symbols(text, lone):
    assert [s for line in M.stream(text) for _, s, w in line if w == 1] == lone and set(lone) <= M.LONE


def test_no_number_of_lone_symbols_makes_markup(spark):
    plain = ["a --> b", "set to '' here", "so }} it ends", "holds if a\n> 9 and b\nis", "price** of it", "it ends\n\n=====\nso", "it ends\n** so"]
    rows = [(i, f"h{i % 3}", f"{i}.md", plain[i % 7]) for i in range(140)]
    assert found(spark, rows) == (set(), {})
    # 20 in plain texts against those at the same item of the wrapper in texts that are wiki otherwise
    wiki = [(200 + i, "p", "x.md", "the ''word'' of it\nit was set to '' then") for i in range(21)]
    kinds, clean = found(spark, [*rows, *wiki[:20]])
    assert kinds == {(200 + i, "wiki") for i in range(20)} and clean[200] == "the word of it\nit was set to '' then"
    kinds, clean = found(spark, [*rows, *wiki])
    assert kinds == {(200 + i, "wiki") for i in range(21)} | {(i, "wiki") for i in range(1, 140, 7)} and clean[1] == "set to  here"


def test_equal_lines_vouch_at_one_item(spark):
    r = random.Random(5)
    lines = {tuple(r.choice("abT") for _ in range(r.randint(1, 9))): 1 + i % 3 for i in range(300)}
    df = spark.createDataFrame([(f"h{i % 5}", s[0], json.dumps(M.fold(list(s), [1] * len(s))), n) for i, (s, n) in enumerate(lines.items())], "host string, lead string, items string, n long")
    made = {(x.host, x.lead): json.loads(x["items"]) for x in M.wrappers(df).collect()}
    for i, (s, n) in enumerate(lines.items()):
        assert all(w >= n for host in (f"h{i % 5}", M.ALL_HOSTS) for w in M.settle(made[host, s[0]], list(s))), s
    weight = lambda host: sum(sum(x[3]) for (h, _), items in made.items() if h == host for x in items)
    assert weight(M.ALL_HOSTS) == sum(weight(f"h{i}") for i in range(5)) == sum(len(s) * n for s, n in lines.items())
