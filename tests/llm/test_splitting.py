import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataseek.llm.splitting import limits_of, split_oversized, split_text

ENDS = re.compile(r"\r\n|\r|\n")


def lines(t):
    n = len(ENDS.findall(t))
    return n if re.search(r"[\r\n]\Z", t) else n + (t != "")


def check(text, chars, rows, oc, ol):
    pieces = split_text(text, chars, rows, oc, ol)
    back = ""
    for i, (a, b, p, q) in enumerate(pieces):
        piece = text[a:b]
        assert piece and len(piece) <= chars and lines(piece) <= rows
        assert a <= len(back) and (i == 0 or a > pieces[i - 1][0]) and b > len(back)
        assert p == len(ENDS.findall(text[:a] + ("\n" if text[a - 1 : a + 1] == "\r\n" and a else ""))) - (text[a - 1 : a + 1] == "\r\n" and a > 0)
        assert q - p + 1 >= lines(piece)
        back += text[len(back) : b]
    assert back == text
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n\r#😀é", max_size=400), st.integers(4, 60), st.integers(3, 9))
def test_round_trip(text, chars, rows):
    check(text, chars, rows, chars // 4, 1)


def test_overlap_and_boundaries():
    text = "".join(f"Sentence number {i} stands here. " for i in range(100))
    pieces = check(text, 400, 180, 40, 5)
    for (_, end, _, _), (start, _, _, _) in zip(pieces, pieces[1:], strict=False):
        assert end - start == 40 and text[end - 2 : end] == ". "
    rows = "".join(f"row {i}\n" for i in range(500))
    pieces = check(rows, 10_000, 180, 200, 5)
    for (_, end, _, q), (start, _, p, _) in zip(pieces, pieces[1:], strict=False):
        assert lines(rows[start:end]) == 5 and q - p == 4


def test_sections_first():
    text = "".join(f"# Head {i}\n" + "word " * 60 + "\n\n" for i in range(6))
    assert all(text[b:].startswith("# Head") for _, b, _, _ in check(text, 700, 50, 20, 1)[:-1])


def test_long_word_and_edges():
    assert split_text("", 10, 5, 2, 1) == []
    assert split_text("x" * 10, 10, 5, 2, 1) == [(0, 10, 0, 0)]
    assert [(a, b) for a, b, _, _ in split_text("x" * 26, 10, 5, 2, 1)] == [(0, 8), (6, 16), (14, 24), (22, 26)]
    with pytest.raises(ValueError):
        split_text("x", 10, 5, 10, 1)


def test_spark(spark):
    limits = limits_of(spark.createDataFrame([("a", "char", 40, 4), ("b", "line", 5, 1), ("c", "token", 9, 0), ("d", "char", 99, 1)], "limit_id string, unit string, capacity long, overlap long"))
    assert limits == {"max_chars": 40, "overlap_chars": 4, "max_lines": 5, "overlap_lines": 1}
    assert limits_of(spark.createDataFrame([], "limit_id string, unit string, capacity long, overlap long")) == {"max_chars": 2**31 - 1, "overlap_chars": 0, "max_lines": 2**31 - 1, "overlap_lines": 0}
    rows = [(1, "a\nb\r\nc\rd\ne\n", 10, 7), (2, "a\n" * 12, 5, 7), (2, "a\n" * 12, 5, 7), (3, "😀" * 90, None, 1), (4, None, 1, 1), (5, "", 1, 1), (6, "a\n\n\n\n\n ", 1, 1)]
    df = spark.createDataFrame(rows, "id long, content string, line_start long, piece_no long")
    out = split_oversized(df, limits).orderBy("chunk_id", "piece_no").collect()
    by = {k: [r for r in out if r.chunk_id == k] for k in range(1, 7)}
    assert [(r.n_pieces, r.line_start, r.line_end) for r in by[1]] == [(1, 10, 14)]
    assert [len(by[k]) for k in (4, 5)] == [0, 0] and by[2][0].line_start == 5 and by[2][-1].line_end == 16
    assert len({r.piece_no for r in by[2]}) == len(by[2]) > 1 and all(len(r.content) <= 40 for r in out)
    assert split_oversized(df.union(df), limits).count() == len(out) == split_oversized(df.union(df), limits).distinct().count()
    other = split_oversized(df.union(df.where("id = 1").selectExpr("id", "'zz' AS content", "line_start", "piece_no")), limits)
    assert sorted(r.content for r in other.where("chunk_id = 1").collect()) == ["a\nb\r\nc\rd\ne\n", "zz"]
    assert len(by[3]) == 3 and by[3][0].line_start == 1 and len(by[6]) == 2
    assert split_oversized(df.where("id = 9"), limits).count() == 0
