"""Rows delivered more than once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with repeated rows are broadcast up to this number (some 20 MB), else joined by shuffle.
REPEATED_MAX = 500_000


def _repeated(df: DataFrame, key: str) -> tuple[DataFrame | None, bool]:
    """The keys of more than one row, broadcast where they are few (None if there are none), and whether several rows have no key."""
    keys = df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key)
    first = keys.limit(REPEATED_MAX + 2).agg(F.count(key).alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    known = keys.where(F.col(key).isNotNull())
    # beyond the bound the null may not have been met; then it is taken to be there
    nulls = first.nulls > 0 or first.n > REPEATED_MAX
    return (None if first.n == 0 else F.broadcast(known) if first.n <= REPEATED_MAX else known), nulls


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key: of rows with the same key the greatest by the other columns; rows with a null key stay.

    Only the key column is shuffled to find the repeated keys; of the rows
    themselves, often wide, only those of repeated keys are.
    """
    rest = [c for c in df.columns if c != key]
    repeated, _ = _repeated(df, key)
    if repeated is None:
        return df
    kept = df.join(repeated, key, "left_semi").groupBy(key).agg(F.max(F.struct(*rest)).alias("__row"))
    return df.join(repeated, key, "left_anti").unionByName(kept.select(key, *(F.col("__row")[c].alias(c) for c in rest)))


def distinct_by_key(df: DataFrame, key: str) -> DataFrame:
    """Distinct rows, where equal rows share a key; rows with a null key are compared with each other.

    As in ``one_per_key`` only rows of repeated keys are shuffled.
    """
    repeated, nulls = _repeated(df, key)
    if repeated is None and not nulls:
        return df
    once = df if repeated is None else df.join(repeated, key, "left_anti")  # keeps rows without a key
    parts = [once.where(F.col(key).isNotNull()) if nulls else once]
    if nulls:
        parts.append(df.where(F.col(key).isNull()).distinct())
    if repeated is not None:
        parts.append(df.join(repeated, key, "left_semi").distinct())
    return reduce(DataFrame.unionByName, parts)
