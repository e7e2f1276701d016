"""Discovery of projects, git state, deadlines, neighbours and cursor expiry."""

import os
import time

import pytest
from pyspark.sql import functions as F

from strataseek.api import KnowledgeBase
from strataseek.errors import CursorExpired, DeadlineExceeded, NotPublished
from strataseek.functions.text import markdown_table, slug_text
from strataseek.operators import graph as G
from strataseek.runtime import deadline
from strataseek.sources import files
from strataseek.sources import projects as P


@pytest.fixture
def root(tmp_path):
    for name in ("Alpha One", "beta", ".hidden", "node_modules", "tmp"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "README.md").write_text(f"# {name}\nlexical note of {name}\n")
    (tmp_path / "plain.txt").write_text("x")
    return tmp_path


def test_discover(root, tmp_path_factory):
    outside = tmp_path_factory.mktemp("elsewhere")
    assert [x["project_id"] for x in P.discover(str(root))] == ["alpha-one", "beta"]
    got = P.discover(str(root), {"beta": "b2", str(outside): "far", "tmp": "kept"})
    assert [(x["project_id"], x["name"]) for x in got][1:] == [("b2", "beta"), ("far", outside.name), ("kept", "tmp")]
    assert P.discover(str(root), {"beta": "alpha-one"})[0]["name"] == "beta"  # an override wins
    for bad in ({"beta": "Not A Slug"}, {"beta": "x", "tmp": "x"}, {"nowhere": "n"}):
        with pytest.raises(ValueError):
            P.discover(str(root), bad)
    assert slug_text(" a/b c..md ") == "b-c..md" and slug_text("***") == "item"


def test_git_head(root):
    assert P.git_head(root / "beta") is None
    git = root / "beta" / ".git"
    (git / "refs" / "heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert P.git_head(root / "beta") is None
    (git / "packed-refs").write_text("# pack-refs\n" + "b" * 40 + " refs/heads/main\n")
    assert P.git_head(root / "beta") == "b" * 40
    (git / "refs" / "heads" / "main").write_text("a" * 40 + "\n")
    assert P.git_head(str(root / "beta")) == "a" * 40
    (git / "HEAD").write_text("c" * 40)
    assert P.git_head(root / "beta") == "c" * 40


def test_register_and_refresh_all(spark, root, tmp_path_factory):
    kb = KnowledgeBase(spark, str(tmp_path_factory.mktemp("store")))
    kb.init()
    assert kb.register_all("a1", str(root))["projects"] == ["alpha-one", "beta"] and kb.register_all("a2", str(root))["projects"] == []
    done = kb.refresh_all("a3")
    assert set(done["projects"]) == {"alpha-one", "beta"} and kb.refresh_all("a3")["projects"]["beta"]["replayed"]
    hits = kb.search("lexical")["results"]
    assert {x["project_id"] for x in hits} == {"alpha-one", "beta"} and {x["availability"] for x in hits} == {"available"}
    kb.build_relations("e1")
    first = kb.neighbours("alpha-one", limit=1)
    walked, page = list(first["items"]), first
    while page["next_cursor"]:
        page = kb.neighbours("alpha-one", limit=1, cursor=page["next_cursor"])
        walked += page["items"]
    assert walked == kb.neighbours("alpha-one", limit=100)["items"] and {x["direction"] for x in walked} == {"in", "out"} and {x["effective_status"] for x in walked} == {"candidate"}
    assert kb.neighbours("alpha-one", "out", "uses_technology")["items"][0]["target_id"] == "md" and kb.neighbours("nobody")["status"] == "no_match"
    kb.save_summary("n1", "project", "beta", "note", "any note")
    kb.store.expire_cursors(kb.store.generation()["id"])
    with pytest.raises(CursorExpired):
        kb.neighbours("alpha-one", limit=1, cursor=first["next_cursor"])
    assert kb.search_page("lexical", generation_id=first["generation"])["items"]
    kb.read_seconds = 0.0
    with pytest.raises(DeadlineExceeded):
        kb.search("lexical")


def test_deadline(spark):
    slow = spark.range(0, 4, 1, 4).mapInPandas(lambda it: (time.sleep(30) or x for x in it), "id long")
    began = time.monotonic()
    with pytest.raises(DeadlineExceeded), deadline(spark, 1.0):
        slow.count()
    assert time.monotonic() - began < 20
    with deadline(spark, 60.0):
        assert spark.range(5).count() == 5
    assert spark.range(6).count() == 6


def test_binary_and_lenient_text(spark):
    rows = [b"plain", b"a\0b", bytes(range(1, 9)) * 3 + b"text", b"", "é数".encode(), "数据".encode("gb18030"), b"caf\xe9 \xff", None]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(rows)], "id int, raw binary")
    got = {r.id: (r.b, r.t) for r in df.select("id", files.is_binary(F.col("raw")).alias("b"), files.decode_lenient(F.col("raw")).alias("t")).collect()}
    assert [got[i][0] for i in range(8)] == [False, True, True, False, False, False, False, None]
    assert [got[i][1] for i in range(6)] == ["plain", None, None, "", "é数", "数据"] and got[7][1] is None and got[6][1].startswith("caf")


def test_status_and_table(spark):
    rows = [("confirmed", "reviewed"), ("confirmed", None), ("candidate", None), (None, "reviewed")]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").select(G.effective_status(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == ["confirmed", "unconfirmed", "candidate", "unconfirmed"]
    assert markdown_table(["a", "b"], [("x|y", None), (1, "l\nm")]) == "| a | b |\n| --- | --- |\n| x\\|y |  |\n| 1 | l m |"


def test_possible_move(spark, root, tmp_path_factory):
    kb = KnowledgeBase(spark, str(tmp_path_factory.mktemp("store2")))
    kb.init()
    kb.register_root("p1", "beta", str(root / "beta"))
    (root / "beta" / "old.bin").write_bytes(b"\0" * 777)
    kb.refresh("p2", "beta")
    (root / "beta" / "old.bin").rename(root / "beta" / "new.bin")
    assert kb.refresh("p3", "beta")["actions"] == {"possible_move": 1, "tombstone": 1}
    edge = kb.related("beta:old.bin")["relations"][0]
    assert (edge["target_id"], edge["relation_type"]) == ("beta:new.bin", "possible_move")


def test_compaction(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path))
    kb.init()
    text = lambda i: spark.createDataFrame([("p", f"{i}.md", f"marble text number {i}")], "project_id string, rel_path string, text string")
    for i in range(3):
        kb.ingest_texts(f"t{i}", text(i), str(i))
    second = kb.store.manifest()["generations"][2]["id"]
    before = kb.search("marble")["results"]
    assert kb.store.compact(second)["tables"] == ["bodies", "index_stats", "memberships", "occurrences", "postings", "versions"]
    assert kb.search("marble")["results"] == before and len(kb.search_page("marble", generation_id=second)["items"]) == 2
    with pytest.raises(NotPublished):
        kb.search_page("marble", generation_id="g0")
    kb.store.compact()
    assert kb.search("marble")["results"] == before and {t: len(p) for t, p in kb.store.manifest()["parts"].items()}["postings"] == 1
    assert len(list((tmp_path / "tables" / "postings").iterdir())) == 1
    kb.ingest_texts("t9", text(9), "9")
    assert len(kb.search("marble")["results"]) == 4


def test_quick_refresh_and_hidden_files(spark, root, tmp_path_factory):
    kb = KnowledgeBase(spark, str(tmp_path_factory.mktemp("store3")))
    kb.init()
    src = root / "beta"
    kb.register_root("p1", "beta", str(src))
    (src / "a.md").write_text("gneiss alpha")
    (src / "b.md").write_text("gneiss beta")
    kb.refresh("p2", "beta")
    stamp = (src / "b.md").stat()
    (src / "a.md").write_text("gneiss changed")
    (src / "b.md").write_text("gneiss BETA")
    os.utime(src / "b.md", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))  # same size and time: not looked at
    assert kb.refresh("p3", "beta", mode="metadata")["actions"] == {"new_version": 1}
    assert {x["snippet"] for x in kb.search("gneiss")["results"]} == {"gneiss changed", "gneiss beta"}
    assert kb.refresh("p4", "beta")["actions"] == {"new_version": 1} and kb.refresh("p5", "beta", mode="metadata")["actions"] == {}
    (src / "a.md").write_text("gneiss password = 'kR7mPq2vXz9w'")
    (src / "b.md").unlink()
    assert kb.refresh("p6", "beta", mode="metadata")["actions"] == {"policy_hidden": 1, "tombstone": 1}
    assert kb.search("gneiss")["status"] == "no_match"
    with pytest.raises(ValueError):
        kb.discover("beta", mode="quick")
