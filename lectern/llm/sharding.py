"""Balanced contiguous shards from global byte-size prefix sums.

Equal texts form a group.  Groups are laid in a line ordered by text hash, their sizes are summed up
along it from per-range totals, and the line is cut at equal targets.  A group that is large
against a shard would move a cut far, so those few (at most ``shards * SHARE`` by their definition)
are dealt out first, largest to the emptiest shard, and the cuts leave room for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.tables import Scratch

#: A group of more than 1/SHARE of a shard is placed on its own.
SHARE = 64
#: Rows of the line per range whose totals are summed first.
RANGE_ROWS = 50_000
KEY = ["hash", "crc", "size"]


def deal(heavy: list[int], total: int, shards: int) -> tuple[list[int], list[float]]:
    """Shard of every heavy group, and where the line of all other bytes is cut."""
    load, place = [0] * shards, [0] * len(heavy)
    for i in sorted(range(len(heavy)), key=lambda i: (-heavy[i], i)):
        place[i] = min(range(shards), key=lambda s: (load[s], s))
        load[place[i]] += heavy[i]
    # level the free room: shards beyond the level get nothing more
    rest, open_shards = total - sum(load), sorted(load)
    level = 0.0
    for n in range(1, shards + 1):
        level = (rest + sum(open_shards[:n])) / n
        if n == shards or level <= open_shards[n]:
            break
    cuts, at = [], 0.0
    for s in range(shards):
        at += max(0.0, level - load[s])
        cuts.append(at)
    return place, cuts


def byte_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: no law for growth).

    Size is the text's UTF-8 bytes plus 1 (a null text: 1).  Equal texts share a shard unless
    their group is larger than a whole shard; such a group is cut between rows.  Null and
    empty texts are one group.  ``slot`` counts the rows of a shard from 0.  Null ids and repeated
    rows are placed like any other; other columns are not read.  With fewer groups than
    shards some shards stay empty, and an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.keep(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.crc32(text).alias("crc"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row")), "rows")
    parts = scratch.keep(rows.groupBy(*KEY, "run").agg(F.count("*").alias("n")), "parts")
    groups = parts.groupBy(*KEY).agg(F.sum("n").alias("n")).withColumn("bytes", F.col("n") * F.col("size"))
    groups = scratch.keep(groups, "groups")
    sums = groups.agg(F.sum("bytes"), F.count("*")).first()
    total, ranges = sums[0] or 0, max(1, (sums[1] or 0) // RANGE_ROWS)

    target = total / shards
    big = (F.col("bytes") > target / SHARE) & (F.col("bytes") <= target)
    heavy = groups.filter(big).orderBy(F.desc("bytes"), *KEY).collect()  # under shards * SHARE rows
    place, cuts = deal([g["bytes"] for g in heavy], total, shards)
    named = ", ".join(f"named_struct('s', {s}, 'i', {i}L, 'h', {g['hash']}L, 'c', {g['crc']}L, 'z', {g['size']}L)"
                      for i, (s, g) in enumerate(zip(place, heavy)))
    fixed = docs.sparkSession.sql(
        f"select inline(array({named}))" if heavy else
        "select 0 s, 0L i, 0L h, 0L c, 0L z where false").select(
        F.col("s").alias("fixed"), F.col("i").alias("turn"),
        *[F.col(a).alias(b) for a, b in zip("hcz", KEY)])

    # the line: per-range totals first, then sums inside each range
    placed = groups.join(fixed, KEY, "left").withColumn(
        "range", F.shiftrightunsigned("hash", 33) * ranges / F.lit(2.0 ** 31))
    placed = placed.withColumn("range", F.floor("range"))
    free = F.when(F.col("fixed").isNull(), F.col("bytes")).otherwise(0)
    free_n = F.when(F.col("fixed").isNull(), F.col("n")).otherwise(0)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("range").agg(F.sum(free).alias("b"), F.sum(free_n).alias("c")).select(
        "range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    line = placed.withColumns({
        "b": F.coalesce(F.sum(free).over(inside), F.lit(0)),
        "c": F.coalesce(F.sum(free_n).over(inside), F.lit(0)),
    }).join(offsets, "range").select(
        *KEY, "fixed", "turn", (F.col("bytes") > target).alias("cut"),
        (F.col("b") + F.col("b0")).alias("start"), (F.col("c") + F.col("c0")).alias("first"))

    # rows count on from the rows of their group in earlier runs
    runs_before = Window.partitionBy(*KEY).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    spread = scratch.keep(parts.withColumn(
        "skip", F.coalesce(F.sum("n").over(runs_before), F.lit(0))).join(line, KEY), "line")
    own = F.row_number().over(Window.partitionBy(*KEY, "run").orderBy("id", "row")) - 1
    at = rows.withColumn("own", own).join(spread, [*KEY, "run"]).withColumn(
        "nth", F.col("skip") + F.col("own"))
    byte = F.col("start") + F.when(F.col("cut"), F.col("nth") * F.col("size")).otherwise(0)
    cut_at = F.array(*[F.lit(c) for c in cuts[:-1]])
    shard = F.coalesce(F.col("fixed"), F.size(F.filter(cut_at, lambda c: c <= byte)))
    turn = F.coalesce(F.col("turn") - len(heavy), F.lit(0))  # dealt groups come first in a shard
    numbered = scratch.keep(at.select(
        "id", "size", "crc", "row", shard.alias("shard"), turn.alias("turn"), "nth",
        (F.col("first") + F.col("nth")).alias("place")), "numbered")

    # the first place of each shard's free rows, and the rows of dealt groups before each group
    starts = numbered.groupBy("shard").agg(
        F.min(F.when(F.col("turn") == 0, F.col("place"))).alias("p0"))
    dealt = numbered.groupBy("shard", "turn").agg(F.count("*").alias("n"))
    prior = Window.partitionBy("shard").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select("shard", "turn", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("ahead"))
    base = dealt.join(starts, "shard")  # at most shards * (SHARE + 1) rows
    slot = F.col("ahead") + F.when(F.col("turn") == 0, F.col("place") - F.col("p0")).otherwise(F.col("nth"))
    return numbered.join(F.broadcast(base), ["shard", "turn"]).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
