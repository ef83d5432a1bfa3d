"""Mixing sources to target weights by proportionate-fair scheduling.

Every source is cut into blocks of equal bytes.  A source with share q of a period Q may release
its i-th block (from 0) at floor(i Q / q) and must have placed it by ceil((i + 1) Q / q); of the released blocks
the one with the earliest deadline goes next.  All deadlines can be met, so at any time a source
is less than one block away from its target.  The schedule repeats after Q slots, so the slot of any
block follows from one period.  When a source runs dry the others go on with their shares.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

#: Rows per part in which a source is put in order.
PART_ROWS = 4_000
#: Numbers in a schedule that is broadcast; a longer one is joined block by block.
BROADCAST_NUMBERS = 1_000_000


def whole_shares(weights: list[float], period: int) -> list[int]:
    """Integer shares in proportion to the weights, each at least 1."""
    total = sum(weights)
    return [max(1, round(w / total * period)) for w in weights]


def earliest_deadline_first(shares: list[int]) -> Iterator[int]:
    """Source of each slot of one period, which is as long as the sum of the shares, slot by slot."""
    period = sum(shares)
    coming: list[tuple[int, int, int]] = []  # release, source and number of the next block
    ready = [(-(-period // q), s, 0) for s, q in enumerate(shares)]  # by deadline
    heapq.heapify(ready)
    for now in range(period):
        while coming and coming[0][0] <= now:
            _, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(i + 1) * period // shares[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s
        if i + 1 < shares[s]:
            heapq.heappush(coming, ((i + 1) * period // shares[s], s, i + 1))


def phases(blocks: list[int], shares: list[int]) -> Iterator[dict]:
    """Pieces of the schedule between sources running dry.

    One entry per phase and source that has blocks in it: its first block and slot in the phase, its number of
    blocks, the period, and the slots of its blocks inside a period.  A phase is worked out as far as it
    goes and at most for a period, so all entries and slots together are no more than twice the blocks.
    """
    left, used, slot = list(blocks), [0] * len(blocks), 0
    active = [s for s in range(len(blocks)) if left[s] > 0]
    while active:
        q = [shares[s] for s in active]
        period = sum(q)
        cycles = min(left[s] // shares[s] for s in active)
        taken = [cycles * n for n in q]
        length = cycles * period
        rest = [left[s] - n for s, n in zip(active, taken)]
        dry = not all(rest)
        spots: dict[int, list[int]] = {}
        for t, k in enumerate(earliest_deadline_first(q)):
            if dry and not cycles:
                break
            spots.setdefault(k, []).append(t)
            if not dry:  # into the next period, until a source is dry
                taken[k] += 1
                rest[k] -= 1
                length += 1
                dry = not rest[k]
        for k in spots:
            s = active[k]
            yield {"s": s, "first": used[s], "n": taken[k], "slot": slot, "period": period,
                   "share": q[k], "spots": spots[k]}
            used[s] += taken[k]
            left[s] -= taken[k]
        slot += length
        active = [s for s in active if left[s] > 0]


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = 262_144,
    period: int = 1_000, temperature: float = 0.5, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", out: str = "mix",
) -> DataFrame:
    """``docs`` with a struct ``mix``: block, slot, release, deadline (all long) and start (double).

    The mixture is the order by (mix.slot, mix.start).  Inside a source rows follow a seeded hash.
    A block is ``block_bytes`` of a source's texts; a row belongs to the block in which it starts
    (a row longer than a block leaves the next ones to itself), and ``start`` is its place in it.
    ``weights`` gives targets by source; a source without one, or every source when there are
    none, gets bytes ** ``temperature``.  No row is left out: once a source runs dry, the others
    keep their proportions.  Shares are whole parts of ``period`` (or of 4 per source, if more).

    A null source is a source of its own.  A null or empty text counts one byte.  Repeated rows are
    placed one by one; a column of the name ``mix`` is replaced, all others are kept.  An empty table
    gives an empty result.  The driver holds one row per source and the schedule, which has at most as many entries
    and slots as one period per phase, and as twice the blocks; beyond ``BROADCAST_NUMBERS`` it is joined by block.
    """
    names = [c for c in docs.columns if c != out]
    held = docs.select(*[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(names)])
    column = {c: F.col(f"_c{i}") for i, c in enumerate(names)}
    text = F.coalesce(column[text_col], F.lit(""))
    source = column[source_col].cast("string")
    key = F.xxhash64(F.lit(seed), column[id_col], F.xxhash64(text))  # spreads null ids too
    rows = held.select(
        "*", F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_source"), key.alias("_key"),
        F.xxhash64(text).alias("_tie"),
        F.greatest(F.octet_length(text), F.lit(1)).cast("long").alias("_bytes"))
    sizes = rows.groupBy("_source").agg(F.count("*").alias("n"), F.sum("_bytes").alias("b"))
    known = sorted(sizes.collect())  # one row per source
    if not known:
        return docs.select(*[docs[f"`{c}`"] for c in names], F.lit(None).cast(_KIND).alias(out))
    given = {"" if k is None else f"={k}": w for k, w in (weights or {}).items()}
    target = [float(given.get(s, b ** temperature)) for s, _, b in known]
    if min(target) <= 0:
        raise ValueError("weights must be above 0")
    plan = [(known[p["s"]][0], p["first"], p["n"], p["slot"], p["period"], p["share"], p["spots"])
            for p in phases([-(-b // block_bytes) for _, _, b in known],
                            whole_shares(target, max(period, 4 * len(known))))]
    spark = docs.sparkSession
    schedule = spark.createDataFrame(
        plan,
        "_source string, first long, n long, slot0 long, period long, share long, spots array<int>")
    parts = spark.createDataFrame(
        [(s, max(1, n // PART_ROWS)) for s, n, _ in known], "_source string, parts long")

    # place of a row in its source: sums inside a part of the hash range, after the parts before
    cut = rows.join(F.broadcast(parts), "_source").withColumn(
        "_part", F.floor(F.shiftrightunsigned("_key", 33) * F.col("parts") / F.lit(2.0 ** 31)))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy("_source", "_part").agg(F.sum("_bytes").alias("b")).select(
        "_source", "_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_source", "_part").orderBy("_key", column[id_col], "_tie").rowsBetween(
        Window.unboundedPreceding, -1)
    at = cut.withColumn("_in", F.coalesce(F.sum("_bytes").over(inside), F.lit(0))).join(
        ahead, ["_source", "_part"]).withColumn("_at", F.col("_in") + F.col("_ahead"))
    at = at.withColumn("_block", F.expr(f"_at div {block_bytes}"))
    spot = F.get("spots", F.expr("cast(_i % share as int)"))
    if sum(6 + len(p[6]) for p in plan) <= BROADCAST_NUMBERS:
        slots = F.broadcast(schedule)
        met = at.join(slots, (at["_source"] == slots["_source"]) & F.col("_block").between(
            F.col("first"), F.col("first") + F.col("n") - 1)).withColumn(
            "_i", F.col("_block") - F.col("first")).withColumn("_spot", spot)
    else:
        slots = schedule.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        met = at.join(slots.select(
            "_source", (F.col("first") + F.col("_i")).alias("_block"), "_i", "slot0", "period", "share",
            spot.alias("_spot")), ["_source", "_block"])
    spot = F.expr("slot0 + (_i div share) * period + _spot")
    mix = F.struct(
        F.col("_block").alias("block"), spot.cast("long").alias("slot"),
        F.expr("slot0 + (_i * period) div share").alias("release"),
        F.expr("slot0 + ((_i + 1) * period + share - 1) div share").alias("deadline"),
        (F.expr(f"_at % {block_bytes}") / F.lit(float(block_bytes))).alias("start"))
    return met.select(*[column[c].alias(c) for c in names], mix.alias(out))


_KIND = ST.StructType([
    *[ST.StructField(c, ST.LongType()) for c in ("block", "slot", "release", "deadline")],
    ST.StructField("start", ST.DoubleType())])


def in_order(mixed: DataFrame, block_bytes: int = 262_144, out: str = "mix") -> DataFrame:
    """Rows written in mixture order: file k holds the k-th stretch of slots, sorted."""
    last = mixed.agg(F.max(f"{out}.slot")).first()[0] or 0
    per_file = max(1, 64 * 1024 * 1024 // block_bytes)
    files = int(last) // per_file + 1
    file = F.expr(f"cast({out}.slot div {per_file} as int)")
    return mixed.repartitionById(files, file).sortWithinPartitions(f"{out}.slot", f"{out}.start").drop(out)
