"""python -m strataseek.cli ROOT VERB [JSON]: one call of the public interface; prints its result."""

from __future__ import annotations

import json
import sys

from strataseek.api import KnowledgeBase
from strataseek.errors import envelope

VERBS = [
    "init", "register_root", "register_all", "refresh", "refresh_all", "build_relations", "save_summary", "search", "search_page", "retrieve", "answer", "audit_claims", "resume_pack", "summary", "summaries", "evidence", "file_version", "resolve_legacy", "related", "neighbours", "project",
    "list_projects", "stats", "verify", "resource",
]
MAX_REQUEST = 1 << 20


def parse(text: str) -> dict:
    """Arguments of a call: one JSON object without repeated names or NaN, at most 1 MiB."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a name is repeated")
        return dict(pairs)

    def no(x):
        raise ValueError(f"{x} is not allowed")

    if len(text.encode()) > MAX_REQUEST:
        raise ValueError("the request is too large")
    value = json.loads(text, object_pairs_hook=once, parse_constant=no)
    if not isinstance(value, dict):
        raise ValueError("the request must be an object")
    return value


def call(kb: KnowledgeBase, verb: str, text: str = "{}") -> dict:
    def run():
        if verb not in VERBS:
            raise ValueError(f"unknown verb; known are {', '.join(VERBS)}")
        try:
            return getattr(kb, verb)(**parse(text))
        except TypeError as e:
            raise ValueError(str(e)) from e

    return envelope(run)


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    if len(args) not in (2, 3):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = call(KnowledgeBase(spark, args[0]), *args[1:])
    print(json.dumps(out, ensure_ascii=False, default=str))
    return int(out.get("status") == "error")


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
