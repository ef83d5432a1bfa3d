"""Joining documents by the Jaccard similarity of their word n-grams, with a MinHash LSH forest.

Every distinct n-gram set gets one signature per tree.  A tree is the sorted trie of its
signatures' prefixes: members under one node share a prefix.  Starting at full length, prefixes
are shortened until pairs at the threshold meet in some tree with the target recall.  Members that
meet are first tied to the smallest of their node, so a node of any size gives as many
rows as it has members; pairs are only formed between members that are not yet in one
group.  A short sketch weeds out pairs that are clearly below the threshold.  Inside each group
all pairs are then compared exactly, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.graph import components
from lectern.sources.tables import Scratch

#: Words are runs of letters, digits and underscores, in lower case.
WORDS = re.compile(r"\w+").findall
TREES, FULL_DEPTH, SKETCH = 32, 8, 64
#: A pair at the threshold passes the sketch with more than 99.9 %: four deviations.
SKETCH_DEVIATIONS = 4
#: Members per block when a group is compared exactly, and n-grams per pack of small groups.
BLOCK, PACK = 256, 500_000
REMEMBERED = 1_000_000


def forest_depth(threshold: float, target: float, trees: int = TREES, full: int = FULL_DEPTH) -> int:
    """Longest prefix at which a pair at ``threshold`` meets in some tree with probability ``target``."""
    depth = full
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


class Grams:
    """Hashed n-gram sets of texts."""

    def __init__(self, n: int):
        self.n, self.known = n, {}
        self.factors = np.random.default_rng(7).integers(1, 2 ** 63, n, dtype=np.uint64) * 2 + 1

    def words(self, text: str) -> np.ndarray:
        import xxhash

        known, out = self.known, []
        for w in WORDS(text.lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        if len(known) > REMEMBERED:
            known.clear()
        return np.array(out, np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; a text shorter than n words is one n-gram, an empty one none."""
        w = self.words(text or "")
        if not len(w):
            return w
        n = min(self.n, len(w))
        total = np.zeros(len(w) - n + 1, np.uint64)
        for i in range(n):
            total += w[i:len(w) - n + 1 + i] * self.factors[i]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
        return np.unique(total)


class Signer:
    """MinHash signatures: one key per tree and a byte sketch."""

    def __init__(self, depth: int, trees: int = TREES):
        random = np.random.default_rng(11)
        self.depth, self.trees = depth, trees
        self.a = random.integers(0, 2 ** 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = random.integers(0, 2 ** 32, trees * depth, dtype=np.uint32)
        self.mix = random.integers(1, 2 ** 63, (trees, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(self, grams: np.ndarray) -> tuple[list[int], bytes]:
        h = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
        low = np.full(len(self.a), 2 ** 32 - 1, np.uint32)
        for i in range(0, len(h), 2048):
            np.minimum(low, (h[i:i + 2048, None] * self.a + self.b).min(0), out=low)
        wide = low.reshape(self.trees, self.depth).astype(np.uint64)
        keys = (wide * self.mix).sum(1, dtype=np.uint64)
        keys ^= keys >> np.uint64(31)
        return keys.view(np.int64).tolist(), (low[:SKETCH] & np.uint32(255)).astype(np.uint8).tobytes()


def signer(n: int, depth: int):
    """A function from a text column to digest and size of the n-gram set, tree keys and sketch."""
    kind = "digest binary, size int, keys array<long>, sketch binary"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams, signer = Grams(n), Signer(depth)
        for texts in batches:
            rows = []
            for text in texts:
                found = grams.of(text)
                keys, sketch = signer.sign(found) if len(found) else ([], b"")
                rows.append((hashlib.blake2b(found.tobytes(), digest_size=16).digest(), len(found), keys, sketch))
            yield pd.DataFrame(rows, columns=["digest", "size", "keys", "sketch"])

    # typed at run time: the annotations are texts here
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, kind)


def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, SKETCH)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(-1, SKETCH)
    return pd.Series((x == y).mean(1))


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule the threshold out."""
    least = threshold - SKETCH_DEVIATIONS * (threshold * (1 - threshold) / SKETCH) ** 0.5
    _likeness.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    likeness = F.pandas_udf(_likeness, "double")
    met = pairs.join(reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(
        reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    return met.select("a", "b", likeness("sa", "sb").alias("like")).filter(
        F.col("like") >= least).select("a", "b")


def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``left`` x ``right`` sets (positions in ``sets``)."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(sets[i], sets[j], True)) for j in right] for i in left], float)
    used = np.union1d(left, right)
    place = {d: k for k, d in enumerate(used.tolist())}
    grams = np.concatenate([sets[d] for d in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[d]) for d in used])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.r_[True, grams[1:] != grams[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # an n-gram of one set only is in no intersection
    owner, column = owner[often], np.cumsum(np.r_[True, grams[often][1:] != grams[often][:-1]]) - 1
    x, y = [place[i] for i in left.tolist()], [place[j] for j in right.tolist()]
    out, width = np.zeros((len(left), len(right)), np.float32), 4096
    if not len(owner):
        return out
    for start in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        grid = np.zeros((len(used), width), np.float32)
        grid[owner[lo:hi], column[lo:hi] - start] = 1
        out += grid[x] @ grid[y].T
    return out


def compare_exactly(sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, threshold: float):
    """Links of one group: per member the weight of its partners and its root; sides (0, 1) of a
    block pair are only compared with each other, a single block (all 0) with itself."""
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(b):
        b = a
    inter = shared(sets, a, b)
    size = np.array([len(s) for s in sets], float)
    union = size[a][:, None] + size[b][None, :] - inter
    link = inter >= threshold * union - 1e-6
    link &= a[:, None] != b[None, :]
    weight = np.zeros(len(sets), np.int64)
    weight[a] += link @ copies[b]
    if a is not b:
        weight[b] += copies[a] @ link
    root = np.arange(len(sets))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(link)):
        x, y = find(a[i]), find(b[j])
        if x != y:
            root[max(x, y)] = min(x, y)
    return weight, np.array([find(i) for i in range(len(sets))])


def verify(members: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(rep, weight, root) of the members (rep, copies, size, grp) of candidate groups."""
    groups = members.groupBy("grp").agg(F.count("*").alias("m"))
    total = members.agg(F.sum("size")).first()[0] or 0
    packs = max(1, int(total) // PACK)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = members.join(groups.filter("m > 1"), "grp").withColumn("nb", blocks)
    own = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    # packs of small groups, and block pairs of large ones
    pack = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("grp"), F.lit(packs))).otherwise(F.col("grp") + packs)
    placed = placed.select(
        "rep", "copies", "grp", pack.alias("pack"), lo.alias("lo"), hi.alias("hi"),
        (F.col("own") != lo).cast("int").alias("side"))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas().sort_values(["grp", "rep"], ignore_index=True)
        grams, out = Grams(n), []
        for _, group in rows.groupby("grp", sort=False):
            sets = [grams.of(t) for t in group["text"]]
            ids = group["rep"].to_numpy()
            weight, root = compare_exactly(sets, group["side"].to_numpy(), group["copies"].to_numpy(), threshold)
            out.append(pd.DataFrame({"rep": ids, "weight": weight, "root": ids[root]}))
        return pa.Table.from_pandas(pd.concat(out), preserve_index=False)

    return placed.join(texts, "rep").groupBy("pack", "lo", "hi").applyInArrow(
        run, "rep long, weight long, root long")


def ngram_join(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, target: float = 0.999,
    id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None,
) -> DataFrame:
    """Per row: ``doc`` (a struct of all its columns), doc_id, class_id, n_links, kept.

    Two rows are linked when the Jaccard similarity of their sets of ``n``-word shingles is at
    least ``threshold``.  ``class_id`` is the smallest id that links lead to, ``n_links`` the number
    of other rows linked directly, ``kept`` marks one row per class: the one with that id.  Sets are
    compared by 64-bit shingle hashes.  Pairs at the threshold are found with probability
    ``target``, more similar ones with more.

    A text without words (null, empty, blank) has no links and is its own class; a text of fewer
    than ``n`` words is one shingle.  Null ids come last in a class; a class of null ids only has a
    null class_id.  Repeated rows link with each other and one stays.  An empty table gives an
    empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram-join")
    depth = forest_depth(threshold, target)
    named = docs.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    text = F.col("doc")[text_col].cast("string")
    signed = scratch.keep(named.withColumn("sig", signer(n, depth)(text)).select(
        "row", "doc", F.col("doc")[id_col].alias("id"), "sig.*"), "signed")
    classes = scratch.keep(signed.filter("size > 0").groupBy("digest").agg(
        F.min("row").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = scratch.keep(signed.select(F.col("row").alias("rep"), "size", "keys", "sketch").join(
        classes.select("rep", "copies"), "rep"), "reps")

    nodes = reps.select("rep", F.explode("keys").alias("key"))
    full = scratch.keep(nodes.groupBy("key").agg(
        F.min("rep").alias("first"), F.count("*").alias("m")).filter("m > 1").select("key", "first"), "nodes")
    under = scratch.keep(nodes.join(full, "key"), "under")
    stars = under.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    tied = scratch.keep(_likely(stars, reps, threshold), "tied")
    near = components(tied, scratch, "near")
    inside = under.select("key", "rep").join(
        near.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("g"))
    inside = scratch.keep(inside, "inside")
    split = inside.groupBy("key").agg(F.min("g").alias("x"), F.max("g").alias("y")).filter("x < y").select("key")
    loose = scratch.keep(inside.join(split, "key"), "loose")
    pairs = loose.select("key", F.col("rep").alias("a"), F.col("g").alias("ga")).join(
        loose.select("key", F.col("rep").alias("b"), F.col("g").alias("gb")), "key").filter("ga < gb")
    across = scratch.keep(_likely(pairs.select("a", "b").distinct(), reps, threshold), "across")
    groups = components(tied.union(across), scratch, "groups")

    members = reps.select("rep", "copies", "size").join(
        groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("grp", F.coalesce("component", "rep"))
    members = scratch.keep(members.select("rep", "copies", "size", "grp"), "members")
    texts = signed.select(F.col("row").alias("rep"), text.alias("text"))
    found = scratch.keep(verify(members, texts, n, threshold), "found")
    links = found.groupBy("rep").agg(F.sum("weight").alias("weight"))
    joined = components(found.select(F.col("root").alias("a"), F.col("rep").alias("b")), scratch, "joined")

    # digests without words are not in classes: such rows stand alone
    per_class = classes.join(links, "rep", "left").join(
        joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    rows = scratch.keep(signed.select("row", "id", "digest").join(per_class, "digest", "left").select(
        "row", "id", F.coalesce("component", "row").alias("component"),
        F.coalesce("n_links", F.lit(0)).alias("n_links")), "rows")
    heads = rows.filter("n_links > 0").groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("head"))
    out = rows.join(heads, "component", "left").select(
        "row", F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        "n_links", F.coalesce(F.col("head.row") == F.col("row"), F.lit(True)).alias("kept"))
    return signed.select("row", "doc", F.col("id").alias("doc_id")).join(out, "row").select(
        "doc", "doc_id", "class_id", "n_links", "kept")
