"""Sources mixed to target weights, by exact token counts."""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataseek.llm.tokens import VOCABULARY, token_counts
from strataseek.runtime import materialise

#: Tokens of a source's budget that are left to the exact subset sum.
EXACT_TOKENS = 32_768
#: Documents of one source and length above which they are picked by buckets of their hash.
LENGTH_GROUP = 10_000
_BUCKETS = 4096


def subset_sum(items: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each length to take so that the sum comes as near to ``budget`` as possible, from either side.

    ``items``: length and number available. Bounded knapsack on a bit set:
    numbers are split into powers of two, and each sum remembers the part that
    reached it first. Earlier items are preferred; of two sums equally near the
    smaller one is taken. A sum beyond the budget is at most one item beyond.
    """
    items = [(x, n) for x, n in items if x > 0 and n > 0]
    top = budget + max((x for x, _ in items), default=0)
    reach, full = 1, (1 << (top + 1)) - 1
    length_of, number_of = np.zeros(top + 1, dtype=np.int64), np.zeros(top + 1, dtype=np.int64)
    for length, n in items:
        n = min(n, top // length)
        k = 1
        while n > 0 and not reach >> budget & 1:
            k = min(k, n)
            new = (reach << (length * k)) & full & ~reach
            reach |= new
            bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
            at = np.flatnonzero(bits)
            length_of[at], number_of[at] = length, k
            n -= k
            k *= 2
        if reach >> budget & 1:
            break
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    over = reach >> (budget + 1)
    above = budget + (over & -over).bit_length() if over else None
    at = above if above is not None and above - budget < budget - below else below
    out: dict[int, int] = {}
    while at:
        length, k = int(length_of[at]), int(number_of[at])
        out[length] = out.get(length, 0) + k
        at -= length * k
    return out


def plan_source(lengths: list[tuple[int, int]], budget: int, max_repeats: int, seed: str) -> dict[int, tuple[int, int]]:
    """Uses per document length within a budget: length -> (uses of every document, documents used once more).

    Whole passes over the source come first. The rest of the budget is spread
    over all lengths in proportion to their documents, then one document per
    length in seeded order, until EXACT_TOKENS are left for the subset sum,
    which may pass the budget by part of a document if that is nearer.
    """
    size = sum(x * n for x, n in lengths)
    passes = min(max_repeats, budget // size) if size else 0
    rest = budget - passes * size
    extra = {x: 0 for x, _ in lengths}
    if passes < max_repeats and rest > 0 and size:
        mixed = sorted((p for p in lengths if p[0] > 0), key=lambda p: (zlib.crc32(f"{seed}:{p[0]}".encode()), p[0]))
        share = max(0, rest - EXACT_TOKENS)
        for x, n in mixed:
            extra[x] = n * share // size
            rest -= extra[x] * x
        for x, n in mixed:
            if rest - x >= EXACT_TOKENS and extra[x] < n:
                extra[x] += 1
                rest -= x
        # should much be left, lengths with documents to spare give more of them
        for x, n in mixed:
            more = min(n - extra[x], max(0, rest - EXACT_TOKENS) // x)
            extra[x] += more
            rest -= more * x
        for x, k in subset_sum([(x, n - extra[x]) for x, n in mixed if n > extra[x]], rest).items():
            extra[x] += k
    return {x: (passes, extra[x]) for x, _ in lengths}


def budgets(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens each source may give: the target shares of the largest total that no source's repeats cut short.

    Sources without tokens cannot give anything; their share goes to the
    others in proportion. With ``total`` that many tokens are aimed at, and a
    source gives what its repeats allow.
    """
    able = {s: (Fraction(share), k) for s, (share, k) in targets.items() if share > 0 and k > 0 and sizes.get(s, 0) > 0}
    if not able:
        return {}
    weight = sum(share for share, _ in able.values())
    # exact fractions, so that the source whose repeats bind gets all of them
    scale = min(k * sizes[s] / share for s, (share, k) in able.items()) if total is None else total / weight
    return {s: min(k * sizes[s], round(scale * share)) for s, (share, k) in able.items()}


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The fixed table of targets; of repeated sources the greatest row."""
    rows = mix_targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*").collect()
    return {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows}


def mix(sized: DataFrame, mix_targets: DataFrame, seed: int = 0, total: int | None = None) -> DataFrame:
    """doc_id, source, n_tokens, uses of every document that is used.

    ``sized``: doc_id (unique), source, n_tokens; give it materialised. Only
    numbers of documents per source and exact length leave the documents;
    they decide how many documents of each length are used how often. Which
    ones is settled by a seeded hash: of n documents of a length the k with
    the smallest hashes. Lengths with very many documents are cut into buckets
    of the hash, so no task sorts them all. Documents without source, or of a
    source without target, are not used, nor are empty ones beyond whole
    passes; no rows give no rows.
    """
    targets = _targets(mix_targets)
    goal = sized.sparkSession.createDataFrame([(s,) for s in targets], "source string")
    docs = sized.join(F.broadcast(goal), "source").select("doc_id", "source", "n_tokens")
    counts = materialise(docs.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    sizes = {r.source: int(r.size) for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("size")).collect()}  # at most a row per target
    given = budgets(sizes, targets, total)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        lengths = sorted(zip(pdf["n_tokens"].tolist(), pdf["n"].tolist(), strict=True))
        uses = plan_source(lengths, given.get(source, 0), targets[source][1], f"{seed}:{source}")
        return pd.DataFrame([(source, x, n, *uses[x]) for x, n in lengths], columns=["source", "n_tokens", "n", "passes", "extra"])

    # one row per source and length, however many documents there are
    plans = materialise(counts.groupBy("source").applyInPandas(plan, "source string, n_tokens long, n long, passes long, extra long").where("passes > 0 OR extra > 0"))
    few = plans.limit(200_001).count() <= 200_000
    rows = docs.join(F.broadcast(plans) if few else plans, ["source", "n_tokens"])
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.when(F.col("n") > LENGTH_GROUP, F.pmod("h", F.lit(_BUCKETS))).otherwise(F.lit(0).cast("long")))
    keys = ["source", "n_tokens", "bucket"]
    whole = rows.where("extra = 0 OR extra = n").select("doc_id", "source", "n_tokens", (F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("uses"))
    some = rows.where("extra > 0 AND extra < n")
    held = some.where(F.col("n") > LENGTH_GROUP).groupBy(*keys).agg(F.count("*").alias("held"))
    before = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*keys, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    ranked = some.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id")))
    ranked = ranked.join(offsets, keys, "left")
    picked = ranked.select("doc_id", "source", "n_tokens", (F.col("passes") + F.when(F.col("rn") + F.coalesce("before", F.lit(0)) <= F.col("extra"), 1).otherwise(0)).alias("uses"))
    return whole.unionByName(picked).where("uses > 0").withColumn("uses", F.col("uses").cast("long"))


def mix_documents(documents: DataFrame, mix_targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Uses per document, and the shares they make."""
    sized = materialise(token_counts(documents.where("source IS NOT NULL"), ["doc_id", "source"], vocabulary))
    used = materialise(mix(sized, mix_targets, seed))
    return used, shares(used, sized, mix_targets)


def longest(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """source, longest: tokens of the longest document of each source."""
    return token_counts(documents.where("source IS NOT NULL"), ["doc_id", "source"], vocabulary).groupBy("source").agg(F.max("n_tokens").alias("longest"))


def shares(used: DataFrame, sized: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Per target: source, target_share, max_repeats, n_docs, n_tokens, used_tokens, actual_share, most_uses."""
    have = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    took = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    total = took.agg(F.sum("used_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = mix_targets.select("source", "target_share", "max_repeats").join(have, "source", "left").join(took, "source", "left").join(F.broadcast(total))
    return out.select("source", "target_share", "max_repeats", zero("n_docs"), zero("n_tokens"), zero("used_tokens"), F.round(F.coalesce(F.try_divide("used_tokens", "all_tokens"), F.lit(0.0)), 9).alias("actual_share"), zero("most_uses"))
