"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors of one label are projected on many random directions.  Two vectors collide on a direction
when the second lies in the window centred at the first.  Pairs with enough collisions are verified by their cosine.  Window and count are
calibrated so that a pair at the threshold passes with the target recall.  So that not all pairs
of a label are counted, vectors first meet in cells: several tables cut the space by a few of their own
projections each, as many as keep cells small at the size of the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.graph import components
from lectern.sources.tables import Scratch

#: Directions whose collisions are counted.
DIRECTIONS = 24
#: Share of collisions of a pair at the threshold (this sets the window).
COLLIDES = 0.95
#: Width of a cell, in distances of a pair at the threshold.
CELL = 8.0
#: Unrelated vectors wanted per cell, and members per block of a large cell.
CELL_ROWS, BLOCK = 200, 1024
#: Rows per pack of small cells.
PACK = 8_192
#: Vectors whose windows are laid over a cell at once, and pairs up to which all directions are compared at once.
STRIPE, FEW = 128, 1_024


def distance(threshold: float) -> float:
    """Distance of unit vectors whose cosine is ``threshold``."""
    return math.sqrt(2 - 2 * threshold)


def window(threshold: float) -> float:
    """Half-width in which a projection of a pair at the threshold falls with chance COLLIDES."""
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid / math.sqrt(2)) < COLLIDES else (lo, mid)
    return hi * distance(threshold)


def least_count(target: float) -> int:
    """Largest count that a pair at the threshold reaches with chance ``target``."""
    chance, count = 0.0, DIRECTIONS
    while count > 0:
        chance += math.comb(DIRECTIONS, count) * COLLIDES ** count * (1 - COLLIDES) ** (DIRECTIONS - count)
        if chance >= target:
            break
        count -= 1
    return count


def same_cell(gap: float, width: float) -> float:
    """Chance that a normal difference of deviation ``gap`` stays in one cell of random offset."""
    x = np.linspace(0, width, 4001)
    density = np.exp(-(x / gap) ** 2 / 2) * math.sqrt(2 / math.pi) / gap
    return float(np.trapezoid(density * (1 - x / width), x))


def tables_for(rows: int, threshold: float, target: float) -> tuple[int, int]:
    """Projections per table and number of tables for ``rows`` vectors of one label."""
    near = same_cell(distance(threshold), CELL * distance(threshold))
    far = same_cell(math.sqrt(2), CELL * distance(threshold))
    depth = max(1, math.ceil(math.log(max(1.0, rows / CELL_ROWS)) / math.log(1 / far)))
    return depth, max(1, math.ceil(math.log(1 - target) / math.log(1 - near ** depth)))


def unit(vectors) -> np.ndarray:
    x = vectors if isinstance(vectors, np.ndarray) else np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def directions(seed: int, count: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def cells(vectors: DataFrame, depth: int, tables: int, threshold: float) -> DataFrame:
    """``vectors`` (rep, label, embedding, copies) with ``cells``: one key per table."""
    width = CELL * distance(threshold)

    def keys(column: pd.Series) -> pd.Series:
        out = np.empty(len(column), object)
        dims = np.array([len(v) for v in column])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            p = unit(column.iloc[at]) @ directions(1, depth * tables, int(dim))
            random = np.random.default_rng([2, int(dim)])
            cell = np.floor(p / width + random.random(depth * tables)).astype(np.int64)
            mix = random.integers(1, 2 ** 62, depth * tables) * 2 + 1
            with np.errstate(over="ignore"):
                found = (cell * mix).reshape(len(at), tables, depth).sum(2) * 31 + dim
            for i, k in zip(at.tolist(), found.tolist()):
                out[i] = k
        return pd.Series(out)

    return vectors.withColumn("cells", F.pandas_udf(keys, "array<long>")("embedding"))


def collisions(projections: np.ndarray, half: float, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Per pair (left, right): on how many directions right lies in the window centred at left."""
    mine, other = projections[left], projections[right]
    if len(left) * len(right) <= FEW:
        return (np.abs(mine[:, None] - other[None]) <= half).sum(2, dtype=np.int8)
    mine, other = np.ascontiguousarray(mine.T), np.ascontiguousarray(other.T)
    counts, gap = np.zeros((len(left), len(right)), np.int8), np.empty((len(left), len(right)), projections.dtype)
    for k in range(len(mine)):
        np.subtract(mine[k][:, None], other[k][None], out=gap)
        counts += np.abs(gap, out=gap) <= half
    return counts


def linked(x: np.ndarray, p: np.ndarray, keys: np.ndarray, table: int, side: np.ndarray, half: float, least: int,
           threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one cell, whose projections are ``p``; a pair counts in the first table in which it meets."""
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(b)
    met = []
    for s in range(0, len(a), STRIPE):
        mine, other = a[s:s + STRIPE], a[s:] if within else b
        passed = collisions(p, half, mine, other) >= least
        i, j = np.nonzero(np.triu(passed, 1) if within else passed)
        met.append((mine[i], other[j]))
    i, j = (np.concatenate(m) for m in zip(*met)) if met else (a, a)
    first = ~(keys[i, :table] == keys[j, :table]).any(1)
    i, j = i[first], j[first]
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 65_536):
        keep[s:s + 65_536] = (x[i[s:s + 65_536]] * x[j[s:s + 65_536]]).sum(1) >= threshold
    return i[keep], j[keep]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = list(range(n))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(k) for k in range(n)], np.int64)


def count_links(celled: DataFrame, threshold: float, target: float) -> DataFrame:
    """(rep, weight, root): rows linked with the vector, and the smallest vector tied to it."""
    half, least = window(threshold), least_count(target)
    met = celled.select("rep", "label", "copies", "embedding", "cells", F.posexplode("cells").alias("table", "cell"))
    sizes = met.groupBy("label", "table", "cell").agg(F.count("*").alias("m")).filter("m > 1")
    total = sizes.agg(F.sum("m")).first()[0] or 0
    met = met.join(sizes, ["label", "table", "cell"]).withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    group = F.xxhash64("label", "table", "cell")
    packs = max(1, int(total) // PACK)
    placed = met.select(
        "rep", "label", "copies", "embedding", "cells", "table", "cell", lo.alias("lo"), hi.alias("hi"),
        (F.col("own") != lo).cast("int").alias("side"),
        F.when(F.col("nb") == 1, F.pmod(group, F.lit(packs))).otherwise(group).alias("pack"))

    def run(found: pa.Table) -> pa.Table:
        vectors, keys = found.column("embedding").combine_chunks(), found.column("cells").combine_chunks()
        keys = keys.flatten().to_numpy().reshape(found.num_rows, -1)
        rows, out = found.select(["rep", "label", "copies", "table", "cell", "side"]).to_pandas(), []
        rows["dim"], rows["at"] = pc.list_value_length(vectors).to_numpy(), np.arange(len(rows))
        matrices, place = {}, np.zeros(len(rows), np.int64)
        for dim, at in rows.groupby("dim")["at"]:
            flat = vectors.take(pa.array(at.to_numpy())).flatten().to_numpy()
            x = unit(flat.astype(np.float64).reshape(len(at), dim))
            matrices[dim] = x, (x @ directions(3, DIRECTIONS, dim)).astype(np.float32)
            place[at.to_numpy()] = np.arange(len(at))
        by = ["table", "cell", "label", "dim"]
        rows = rows.sort_values([*by, "rep"], ignore_index=True)
        new = (rows[by] != rows[by].shift()).any(axis=1).to_numpy()
        column = {c: rows[c].to_numpy() for c in ("rep", "copies", "table", "side", "dim", "at")}
        starts = np.append(np.flatnonzero(new), len(rows))
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if hi - lo < 2:
                continue
            at, (x, p) = column["at"][lo:hi], matrices[column["dim"][lo]]
            i, j = linked(x[place[at]], p[place[at]], keys[at], column["table"][lo], column["side"][lo:hi], half, least, threshold)
            if len(i):
                copies, ids = column["copies"][lo:hi], column["rep"][lo:hi]
                weight = np.bincount(i, copies[j], hi - lo) + np.bincount(j, copies[i], hi - lo)
                root = ids[roots(hi - lo, i, j)]
                some = weight > 0
                out.append(pd.DataFrame({"rep": ids[some], "weight": weight[some].astype(np.int64), "root": root[some]}))
        if not out:
            return pa.table({c: pa.array([], pa.int64()) for c in ("rep", "weight", "root")})
        return pa.Table.from_pandas(pd.concat(out), preserve_index=False)

    return placed.groupBy("pack", "lo", "hi").applyInArrow(run, "rep long, weight long, root long")


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.93, target: float = 0.9999, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label", scratch: Scratch | None = None,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Rows with equal, non-null labels and a cosine of at least ``threshold`` are linked.  ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id that links lead to and
    ``kept`` says that it is the row's own.  Vectors that are null, empty, zero or hold null or
    non-finite numbers, vectors of different length and rows with a null label or id link with
    nothing.  Equal vectors are compared once and count as often as they occur.  A pair at the threshold is
    found with a chance of about ``target`` twice over (cells and counts), closer ones with more; no pair
    below the threshold is linked.  Other columns are not read.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "embedding-dedup")
    v = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    infinite = float("inf")
    fit = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < infinite), F.lit(False))) & F.exists("v", lambda x: x != 0)
    narrow = vectors.select(vector_col).dtypes[0][1] == "array<float>"  # these lose nothing when they travel as floats
    rows = scratch.keep(v.select("row", "id", "label", F.when(
        F.coalesce(fit, F.lit(False)), F.transform("v", lambda x: x + 0.0)).cast(
        "array<float>" if narrow else "array<double>").alias("v")), "rows")
    distinct = scratch.keep(rows.filter("v is not null").groupBy("label", F.col("v").alias("embedding")).agg(
        F.min("row").alias("rep"), F.count("*").alias("copies")), "distinct")
    widest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth, tables = tables_for(widest, threshold, target)
    celled = scratch.keep(cells(distinct, depth, tables, threshold), "cells")
    found = scratch.keep(count_links(celled, threshold, target), "found")
    links = found.groupBy("rep").agg(F.sum("weight").alias("weight"))
    joined = components(found.select(F.col("root").alias("a"), F.col("rep").alias("b")), scratch)
    per_vector = distinct.join(links, "rep", "left").join(
        joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "label", F.col("embedding").alias("v"), F.coalesce("component", "rep").alias("component"),
        (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = scratch.keep(rows.join(per_vector, ["label", "v"], "left").select(
        "row", "id", F.coalesce("component", "row").alias("component"),
        F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    heads = named.filter("n_links > 0").groupBy("component").agg(F.min("id").alias("head"))
    return named.join(heads, "component", "left").select(
        F.col("id").alias("vec_id"), "n_links", F.coalesce("head", "id").alias("component_id"),
        F.coalesce(F.coalesce("head", "id") == F.col("id"), F.lit(True)).alias("kept"))
