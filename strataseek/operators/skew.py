"""Joins of rows to per-key facts when a few keys hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as hot when it holds at least this share of all rows, so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1 / 2000
#: Below this many rows no key is worth treating apart.
HOT_ROWS = 20_000


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner-join ``rows`` to ``facts`` (one row per key, ``count`` = rows of that key).

    Hot keys, at most ``1/share`` of them whatever the input, are joined by a
    broadcast of their facts, so their rows are never shuffled to one task; all
    other keys hold less than ``share`` of the rows each and take a shuffled
    join. ``rows`` and ``facts`` are each read twice: pass materialised ones.
    Null keys match nothing. Column order: keys, other columns of rows, facts.
    """
    least = max(HOT_ROWS, int(total * share))
    hot = facts.where(F.col(count) >= least)
    if total < HOT_ROWS:
        return rows.join(facts, keys)
    cold = facts.where(F.col(count) < least)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(cold, keys))
