"""Fixed-capacity containers filled with documents, with certified lower bounds."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.llm.tokens import VOCABULARY, token_counts
from strataseek.runtime import materialise

#: Items packed together; a partition of this size leaves next to nothing unused and fits any worker.
PARTITION_ITEMS = 20_000
#: Packings after the first one, each over the partitions that still have a gap.
EXCHANGES = 4


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Fewest containers any packing needs, by dual feasible functions.

    Sizes from 0 to ``capacity``. Three families, each evaluated on the counts
    per size: U(e) takes items above capacity - e as full and drops those
    below e; u(k) rounds by k + 1 parts; phi(e) counts large items by how many
    of size e fit beside them. The greatest bound holds.
    """
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    used = np.flatnonzero(n)
    best = -(-int((n * x).sum()) // capacity)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    for e in used[(used > 0) & (used * 2 <= capacity)]:
        full = int(count[-1] - count[capacity - e + 1])  # above capacity - e
        middle = int(total[capacity - e + 1] - total[e])  # from e to capacity - e
        best = max(best, -(-(full * capacity + middle) // capacity))
        # phi: small items are dropped, middle ones count 1 / floor(C / e), large ones what they displace
        per = capacity // int(e)
        mid = int(count[capacity // 2 + 1] - count[e])
        large = used[used * 2 > capacity]
        displaced = (n[large] * (per - (capacity - large) // int(e))).sum()
        best = max(best, -(-int(mid + displaced) // per))
    for k in range(1, 21):
        y = (k + 1) * used
        exact = y % capacity == 0
        value = np.where(exact, used * k, y // capacity * capacity)  # k times u(k)
        best = max(best, -(-int((n[used] * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item; items in the order given must not grow. Each goes where the least room is left."""
    rooms: list[tuple[int, int]] = []  # room left and container, sorted
    out = []
    n = 0
    for s in sizes:
        i = bisect_left(rooms, (s, -1))
        if i < len(rooms):
            room, c = rooms.pop(i)
        else:
            room, c = capacity, n
            n += 1
        if room > s:
            insort(rooms, (room - s, c))
        elif s == 0:
            insort(rooms, (room, c))
        out.append(c)
    return out


def _packed(items: DataFrame, capacity: int, groups: int, round_no: int) -> DataFrame:
    """One packing of every partition: adds part, bin, n_bins, bound."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True]).reset_index(drop=True)
        sizes = pdf["n_tokens"].to_numpy(dtype=np.int64)
        pdf["bin"] = best_fit_decreasing(sizes.tolist(), capacity)
        pdf["n_bins"] = int(pdf["bin"].max()) + 1
        pdf["bound"] = lower_bound(sizes, capacity)
        return pdf[["doc_id", "piece_no", "n_tokens", "part", "bin", "n_bins", "bound"]]

    spread = items.select("doc_id", "piece_no", "n_tokens", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(round_no)), F.lit(groups)).alias("part"))
    return spread.groupBy("part").applyInPandas(pack, f"doc_id {dict(items.dtypes)['doc_id']}, piece_no long, n_tokens long, part long, bin long, n_bins long, bound long")


def pack(sizes: DataFrame, capacity: int, partition_items: int = PARTITION_ITEMS, exchanges: int = EXCHANGES) -> DataFrame:
    """Containers of ``capacity``: doc_id, piece_no (from 0), n_tokens, container, position (from 1), certified.

    ``sizes``: doc_id (unique), n_tokens. A document larger than the capacity
    is cut into full pieces, each a container of its own, and a rest; no other
    is cut. Items are spread over partitions by hash and packed best fit
    decreasing; a partition whose containers meet the lower bound is certified
    optimal and done. The partially filled containers of the others are
    emptied, their documents exchanged by a new hash and packed again, up to
    ``exchanges`` times; a packing is kept only if it needs fewer containers,
    and the first that does not ends the exchange.
    Empty documents take no room. No rows give no containers; null sizes count
    as empty.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.coalesce("n_tokens", F.lit(0)).cast("long")
    cut = sizes.select("doc_id", n.alias("n"))
    full = cut.where(F.col("n") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / capacity) - 1)).alias("piece_no"), F.lit(capacity).cast("long").alias("n_tokens"))
    done = [full.select("*", F.concat_ws(":", F.lit("full"), "doc_id", "piece_no").alias("container"), F.lit(True).alias("certified"))]
    rest = cut.where((F.col("n") < capacity) | (F.col("n") % capacity > 0)).select("doc_id", F.floor(F.col("n") / capacity).cast("long").alias("piece_no"), (F.col("n") % capacity).alias("n_tokens"))
    named = lambda df, r, ok: df.select("doc_id", "piece_no", "n_tokens", F.concat_ws(":", F.lit(r), "part", "bin").alias("container"), F.lit(ok).alias("certified"))
    total = rest.count()
    if total:
        now = materialise(_packed(rest, capacity, -(-total // partition_items), 0))
        for r in range(exchanges + 1):
            done.append(named(now.where("n_bins = bound"), r, True))
            gap = now.where("n_bins > bound")
            fill = gap.groupBy("part", "bin").agg(F.sum("n_tokens").alias("fill"))
            open_bins = fill.where(F.col("fill") < capacity)
            stats = open_bins.agg(F.count("*").alias("bins")).first()
            if not stats.bins or r == exchanges:
                done.append(named(gap, r, False))
                break
            keyed = gap.join(open_bins.select("part", "bin", F.lit(True).alias("open")), ["part", "bin"], "left")
            loose = materialise(keyed.where("open").select("doc_id", "piece_no", "n_tokens"))
            again = materialise(_packed(loose, capacity, -(-loose.count() // partition_items), r + 1))
            bins = again.groupBy("part").agg(F.max("n_bins").alias("n")).agg(F.sum("n")).first()[0]
            if bins >= stats.bins:
                done.append(named(gap, r, False))
                break
            done.append(named(keyed.where("open IS NULL"), r, False))
            now = again
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return positions(materialise(out))


def positions(placed: DataFrame) -> DataFrame:
    """Adds position, the place of each item in its container, larger items first.

    A container holds at most ``capacity`` items with room, and any number of
    empty ones; those are numbered with their container too.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("container").orderBy(F.desc("n_tokens"), "doc_id", "piece_no")
    return placed.select("doc_id", "piece_no", "n_tokens", "container", F.row_number().over(w).cast("long").alias("position"), "certified")


def pack_documents(documents: DataFrame, size_limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` for each token capacity of the fixed table ``size_limits``; texts are measured once. Adds limit_id.

    A table without token capacities is an error.
    """
    sizes = materialise(token_counts(documents, ["doc_id"], vocabulary))
    limits = size_limits.where("unit = 'token'").select("limit_id", "capacity").distinct().orderBy("limit_id").collect()
    out = None
    for x in limits:
        one = pack(sizes, int(x.capacity)).withColumn("limit_id", F.lit(x.limit_id))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("size_limits holds no token capacity")
    return out


def report(packed: DataFrame, size_limits: DataFrame) -> DataFrame:
    """Per limit: limit_id, capacity, n_containers, least (sum of sizes over capacity, rounded up), n_tokens, fill."""
    limits = size_limits.where("unit = 'token'").select("limit_id", "capacity").distinct()
    # containers first, so that a limit is summed from partial sums
    each = packed.groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("fill")).groupBy("limit_id").agg(F.count("*").alias("n_containers"), F.sum("fill").alias("n_tokens"))
    c = F.col("n_tokens") / F.col("capacity")
    return each.join(F.broadcast(limits), "limit_id").select("limit_id", "capacity", "n_containers", F.ceil(c).alias("least"), "n_tokens", F.round(c / F.col("n_containers"), 6).alias("fill"))
