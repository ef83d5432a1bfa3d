"""Near-duplicate lines by MinHash over character shingles.

Lines are compared by their sets of character shingles, ``width`` characters each.  One character changed
inside a line touches ``width`` shingles of either side, so at threshold 0.8 it is caught when the line has
9 * width distinct shingles, which takes 10 * width - 1 characters: 49 at width 5 (the registered query),
79 at width 8 (the default), where a shorter line with one changed character counts as another line.
Every distinct line gets a signature of minima over rotated and masked shingle hashes, computed as
plain aggregates over exploded shingles.  Bands
of the signature put similar lines under one key.  Lines under a key are first compared
with the smallest of them, so a key of any size gives as many pairs as it has lines; pairs
among the rest are formed only between lines that are not yet in one component.  Two lines become a pair only
if most of their minima agree, which a few bits of each tell inside the join; pairs are then verified by their
shingles.  A union-find over verified pairs gives the components, of each of which one line stays.

Families of lines a little less similar than the threshold hold many pairs of different components, and their number grows with
the square of a family.  For shingles of 5 characters and less these pairs are told apart inside the join by ``odd`` sketches, which never
pass over a pair that reaches the threshold.

Shingles of 5 characters and less are many, and unrelated lines share some.  They are dealt into parts, so that a
shingle meets the few minima of its part only, and a band takes more minima (``part_signatures``).
"""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.graph import components
from lectern.sources.tables import Scratch

#: Shingle width of a call that names none.
WIDTH = 8
#: Bands of ROWS minima each: at similarity 0.8 some band agrees with a chance of 99.7 %.
BANDS, ROWS = 8, 3
#: The same chance for ``signatures`` of shingles of 5 characters and less.  Unrelated lines share more of these (up to
#: a tenth at 5), so a band takes more minima to keep them apart; ``line_dedup`` takes ``part_signatures`` for them.  A minimum is in two bands, two bands share one at most.
NARROW_COLUMNS, NARROW_ROWS = 8, 4
#: Bits of a minimum in the sketch of a line, and the chance that a pair at the threshold has too many that differ.
BITS, OVERLOOKED = 4, 1e-4
#: Bands whose keys are exchanged at once.
AT_ONCE = 4
#: Shingles of 5 characters and less are dealt into parts by their hash; each part has minima of its own, which a
#: shingle of another part never meets, and three bands of six of them.  At 0.8 all bands miss a pair with a chance
#: of 0.3 % at most, whatever the length of the lines.
PARTS, PART_MINIMA = 8, 9
PART_BANDS = [[0, 1, 2, 3, 4, 5], [3, 4, 5, 6, 7, 8], [0, 1, 2, 6, 7, 8]]
#: Keys exchanged at once, and minima that may differ in the sketches of a pair: more than these did in at most one in
#: 10,000 simulated pairs at 0.8 of 20 to 600 shingles.
KEYS_AT_ONCE, PARTS_DIFFER = 12, 29
#: Longs of an odd sketch: at 2,048 bits it tells 0.72 from 0.8 up to some 1,500 shingles.
ODD_LONGS = 32
_MASKS = [random.Random(5 + j).randrange(-2 ** 31, 2 ** 31) for j in range(max(BANDS * ROWS, NARROW_COLUMNS * NARROW_ROWS))]
CLASS = ["d1", "d2"]


def bands_of(width: int) -> list[list[int]]:
    """The numbers of the minima in each band."""
    if width > 5:
        return [[b + BANDS * r for r in range(ROWS)] for b in range(BANDS)]
    n = NARROW_COLUMNS
    return [[r * n + (turn * r + b) % n for r in range(NARROW_ROWS)] for turn in (0, 1) for b in range(n)]


def most_differing(minima: int, threshold: float) -> int:
    """Minima that may differ in their ``BITS`` lowest bits: more do so with a chance below ``OVERLOOKED``."""
    p = (1 - threshold) * (1 - 2.0 ** -BITS)
    left, k = 1.0, -1
    while left > OVERLOOKED and k < minima:
        k += 1
        left -= math.comb(minima, k) * p ** k * (1 - p) ** (minima - k)
    return k


def sketch(minima: list[str]) -> Column:
    """The lowest bits of up to 16 minima in one long."""
    low = [F.shiftleft(F.col(m).bitwiseAND(2 ** BITS - 1).cast("long"), BITS * i) for i, m in enumerate(minima)]
    return reduce(lambda x, y: x.bitwiseOR(y), low)


def differing(x: Column, y: Column) -> Column:
    """How many minima two sketches differ in."""
    d = x.bitwiseXOR(y)
    any_bit = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftrightunsigned(d, i) for i in range(BITS)])
    return F.bit_count(any_bit.bitwiseAND(F.lit(sum(1 << BITS * i for i in range(16)))))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: row, doc_id, line_no (from 0), the trimmed line and two digests of it."""
    cut = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")).alias("line_no", "raw"))
    line = F.trim(F.col("raw"))
    return cut.select("row", "doc_id", "line_no", line.alias("line"), F.xxhash64(line).alias("d1"),
                      F.xxhash64(F.lit(1), line).alias("d2"))


def characters(line: Column) -> Column:
    """Four bytes a character, so that finding a shingle never walks."""
    return F.encode(line, "UTF-32")


def places(c: Column, width: int) -> Column:
    """Where shingles begin; a line shorter than ``width`` is one shingle."""
    return F.sequence(F.lit(0), F.greatest((F.octet_length(c) / 4).cast("int") - width, F.lit(0)))


def shingle(c: Column, i: Column, width: int) -> Column:
    return F.substring(c, i * 4 + 1, F.lit(4 * width))


def shingles(line: Column, width: int = WIDTH) -> Column:
    """Distinct shingle hashes; a line shorter than ``width`` is one shingle."""
    cut = F.transform(F.array(characters(line)), lambda c: F.transform(
        places(c, width), lambda i: F.xxhash64(shingle(c, i, width))))  # the characters of a line are encoded once
    return F.array_distinct(cut[0])


def signatures(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per distinct line that is not blank: id, digests, one key per band and the sketch (s1, s2).

    Ids are smaller the more often a line occurs (by powers of two).  Variants of a line mostly
    resemble the line they come from, which is the one met most often, more than each other.
    """
    cut = lines.filter("line <> ''").select(*CLASS, characters(F.col("line")).alias("c"))
    spots = cut.select(*CLASS, "c", F.explode(places(F.col("c"), width)).alias("i"))
    h = spots.select(*CLASS, (F.col("i") == 0).cast("int").alias("line"), F.hash(shingle(F.col("c"), F.col("i"), width)).alias("h"))
    bands = bands_of(width)
    n = 1 + max(max(band) for band in bands)
    minima = []
    for j, mask in enumerate(_MASKS[:n]):
        turned = F.shiftleft("h", j).bitwiseOR(F.shiftrightunsigned("h", 32 - j)) if j else F.col("h")
        minima.append(F.min(turned.bitwiseXOR(F.lit(mask))).alias(f"m{j}"))
    keys = [F.xxhash64(F.lit(b), *[f"m{j}" for j in band]) for b, band in enumerate(bands)]
    names = [f"m{j}" for j in range(n)]
    often = F.lit(31) - F.floor(F.log2(F.col("lines"))).cast("long")
    return h.groupBy(*CLASS).agg(F.sum("line").alias("lines"), *minima).select(
        (F.monotonically_increasing_id() + often * F.lit(2 ** 58)).alias("id"), *CLASS, F.array(*keys).alias("keys"),
        sketch(names[:n // 2]).alias("s1"), sketch(names[n // 2:]).alias("s2"))


def texts_of(used: DataFrame, classes: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, line) of the classes in ``used`` (id)."""
    named = classes.select("id", *CLASS).join(used, "id")
    return lines.select(*CLASS, "line").join(named, CLASS).dropDuplicates(["id"]).select("id", "line")


def verified(pairs: DataFrame, classes: DataFrame, lines: DataFrame, threshold: float, scratch: Scratch, name: str,
             width: int = WIDTH, texts: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets have at least the threshold's Jaccard similarity.

    ``texts`` (id, line) saves looking for the lines of the pairs.
    """
    pairs = scratch.keep(pairs, f"{name}-pairs")
    if texts is None:
        used = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        texts = scratch.keep(texts_of(used, classes, lines), f"{name}-texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    sets = both.select("a", "b", shingles(F.col("la"), width).alias("x"), shingles(F.col("lb"), width).alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    met = sets.select("a", "b", shared.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return met.filter(F.col("both") >= threshold * (F.col("sum") - F.col("both")) - 1e-9).select("a", "b")


def _slices(width: int) -> list[tuple[int, Column]]:
    """The keys of a few bands each, one row per key."""
    n = len(bands_of(width))
    return [(at, F.explode(F.slice("keys", at + 1, AT_ONCE)).alias("key")) for at in range(0, n, AT_ONCE)]


def _close(left: str, right: str, threshold: float, width: int) -> Column:
    minima = 1 + max(max(band) for band in bands_of(width))
    apart = sum((differing(F.col(f"{left}.{s}"), F.col(f"{right}.{s}")) for s in ("s1", "s2")), F.lit(0))
    return apart <= most_differing(minima, threshold)


def close_to_first(classes: DataFrame, threshold: float, scratch: Scratch, width: int) -> DataFrame:
    """Pairs (a, b): the smallest line under a key and every line there that may be similar to it."""
    told = None
    for at, key in _slices(width):
        nodes = classes.select("id", "s1", "s2", key)
        first = nodes.groupBy("key").agg(
            F.min("id").alias("id"), F.min_by("s1", "id").alias("s1"), F.min_by("s2", "id").alias("s2"),
            F.count("*").alias("m")).filter("m > 1")
        same = F.col("x.key") == F.col("y.key")
        met = nodes.alias("x").join(first.alias("y"), same & (F.col("x.id") != F.col("y.id")) & _close("x", "y", threshold, width))
        pairs = scratch.keep(met.select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct(), f"stars-{at}")
        told = pairs if told is None else told.union(pairs)
    stars = scratch.keep(told.distinct(), "stars")
    for at, _ in _slices(width):
        scratch.forget(f"stars-{at}")
    return stars


def close_across(classes: DataFrame, threshold: float, scratch: Scratch, width: int) -> DataFrame:
    """Pairs (a, b) under a key that may be similar and are in different components ``g``."""
    told = None
    for at, key in _slices(width):
        nodes = classes.select("id", "g", "s1", "s2", key)
        split = nodes.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low < high")
        loose = scratch.keep(nodes.join(split.select("key"), "key"), f"loose-{at}")
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.g") < F.col("y.g"))
        met = loose.alias("x").join(loose.alias("y"), same & _close("x", "y", threshold, width))
        pairs = scratch.keep(met.select(
            F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), f"cross-{at}")
        scratch.forget(f"loose-{at}")
        told = pairs if told is None else told.union(pairs)
    return told.distinct()


def part_signatures(lines: DataFrame, width: int) -> DataFrame:
    """One row per distinct line that is not blank: id, digests, keys of all bands of all parts, sketches of all parts.

    A line without shingles in a part has null there.  Equal lines meet before their shingles are cut.
    Ids are those of ``signatures``.
    """
    known = lines.filter("line <> ''").groupBy(*CLASS).agg(F.count("*").alias("lines"), F.first("line").alias("line"))
    cut = known.select(*CLASS, "lines", characters(F.col("line")).alias("c"))
    spots = cut.select(*CLASS, "lines", "c", F.explode(places(F.col("c"), width)).alias("i"))
    h = spots.select(*CLASS, "lines", F.hash(shingle(F.col("c"), F.col("i"), width)).alias("h"))
    minima = []
    for j, mask in enumerate(_MASKS[:PART_MINIMA]):
        # by three bits a turn, so that the bits that name the part are not those that decide
        turned = F.shiftleft("h", 3 * j).bitwiseOR(F.shiftrightunsigned("h", 32 - 3 * j)) if j else F.col("h")
        minima.append(F.min(turned.bitwiseXOR(F.lit(mask))).alias(f"m{j}"))
    dealt = h.groupBy(*CLASS, F.col("h").bitwiseAND(PARTS - 1).alias("part")).agg(F.max("lines").alias("lines"), *minima)
    keys = [F.xxhash64("part", F.lit(b), *[f"m{j}" for j in band]).alias(f"k{b}") for b, band in enumerate(PART_BANDS)]
    told = dealt.select(*CLASS, "part", "lines", *keys, sketch([f"m{j}" for j in range(PART_MINIMA)]).alias("s"))

    def each(name: str) -> list[Column]:
        return [F.max(F.when(F.col("part") == p, F.col(name))).alias(f"{name}_{p}") for p in range(PARTS)]

    names = [f"k{b}" for b in range(len(PART_BANDS))]
    wide = told.groupBy(*CLASS).agg(F.max("lines").alias("lines"), *[c for name in [*names, "s"] for c in each(name)])
    often = F.lit(31) - F.floor(F.log2(F.col("lines"))).cast("long")
    return wide.select(
        (F.monotonically_increasing_id() + often * F.lit(2 ** 58)).alias("id"), *CLASS,
        F.array(*[f"{name}_{p}" for name in names for p in range(PARTS)]).alias("keys"),
        F.array(*[f"s_{p}" for p in range(PARTS)]).alias("s"))


def shared_keys(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, low) of the keys that several lines have; ``low`` is the smallest of them.  Keys are exchanged once."""
    told = None
    for at in range(0, PARTS * len(PART_BANDS), KEYS_AT_ONCE):
        nodes = classes.select("id", F.explode(F.slice("keys", at + 1, KEYS_AT_ONCE)).alias("key"))
        nodes = nodes.filter("key is not null").repartition("key")
        several = nodes.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
        found = scratch.keep(nodes.join(several.select("key", "low").hint("shuffle_hash"), "key"), f"shared-{at}")
        told = found if told is None else told.union(found)
    return told


def _alike(x: str, y: str) -> Column:
    """Whether few minima differ; lines without shingles in some part are too short to tell by."""
    apart = sum((differing(F.col(x)[p], F.col(y)[p]) for p in range(PARTS)), F.lit(0))
    return F.coalesce(apart <= PARTS_DIFFER, F.lit(True))


def first_pairs(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b): the smallest line under a key and every line there that may be similar to it."""
    pairs = shared.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    met = pairs.join(classes.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(
        classes.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return met.filter(_alike("x", "y")).select("a", "b")


def odd_sketches(texts: DataFrame, width: int) -> DataFrame:
    """(id, n, odd) of lines (id, line): the number of distinct shingles, and bits that as many of them as is odd fall on.

    Where two sketches differ, the shingles that only one of the lines has fall on a bit an odd number of times, so the lines differ
    in as many shingles at least.
    """
    h = texts.select("id", F.explode(shingles(F.col("line"), width)).alias("h"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 8) & 63 as int))")
    told = h.groupBy("id", F.col("h").bitwiseAND(ODD_LONGS - 1).alias("at")).agg(F.count("*").alias("n"), F.bit_xor(bit).alias("bits"))
    each = [F.coalesce(F.max(F.when(F.col("at") == k, F.col("bits"))), F.lit(0).cast("long")) for k in range(ODD_LONGS)]
    return told.groupBy("id").agg(F.sum("n").alias("n"), F.array(*each).alias("odd"))


def _flat(name: str, n: int) -> list[Column]:
    """The longs of an array as columns that are never null: a join condition over them is short enough for Java to compile."""
    return [F.coalesce(F.col(name)[k], F.lit(0).cast("long")).alias(f"{name}_{k}") for k in range(n)]


def _flat_alike() -> Column:
    """``_alike`` for the sides x and y of a join, from flat columns and ``short``, which tells of a part without shingles."""
    apart = sum((differing(F.col(f"x.s_{p}"), F.col(f"y.s_{p}")) for p in range(PARTS)), F.lit(0))
    return F.col("x.short") | F.col("y.short") | (apart <= PARTS_DIFFER)


def _may_reach(threshold: float) -> Column:
    """Whether odd sketches leave room for the threshold: at J, lines of n and m shingles differ in (1 - J) / (1 + J) of n + m."""
    apart = sum((F.bit_count(F.col(f"x.odd_{k}").bitwiseXOR(F.col(f"y.odd_{k}"))) for k in range(ODD_LONGS)), F.lit(0))
    return apart <= F.lit((1 - threshold) / (1 + threshold)) * (F.col("x.n") + F.col("y.n")) + F.lit(1e-6)


def other_pairs(shared: DataFrame, classes: DataFrame, near: DataFrame, scratch: Scratch,
                texts: DataFrame | None = None, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Pairs (a, b) under a key that may be similar and are in different components of ``near``.

    With ``texts`` (id, line) those that have such a partner get odd sketches, which leave few pairs below the threshold.
    """
    at = shared.select("key", "id").join(near, "id", "left").select("key", "id", F.coalesce("component", "id").alias("g"))
    at = scratch.keep(at, "placed")
    split = at.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low < high")
    loose = at.join(split.select("key").hint("shuffle_hash"), "key", "left_semi").join(classes.select("id", "s"), "id")
    loose = scratch.keep(loose, "loose")
    scratch.forget("placed")
    short = F.exists("s", lambda e: e.isNull()).alias("short")
    sides = ["key", "id", F.coalesce("g", "id").alias("g"), F.coalesce(short, F.lit(True)).alias("short"), *_flat("s", PARTS)]
    same, told, extra = F.col("x.key") == F.col("y.key"), _flat_alike(), []
    if texts is not None:
        lines = loose.select(*sides)
        met = lines.alias("x").join(lines.alias("y"), same & (F.col("x.g") != F.col("y.g")) & told, "left_semi")
        met = scratch.keep(met.select("key", "id"), "met")
        sketches = odd_sketches(texts.join(met.select("id").distinct(), "id", "left_semi"), width)
        loose = scratch.keep(loose.join(met, ["key", "id"], "left_semi").join(sketches, "id"), "sketched")
        for done in ("loose", "met"):
            scratch.forget(done)
        extra = [F.coalesce("n", F.lit(0).cast("long")).alias("n"), *_flat("odd", ODD_LONGS)]
        told = told & _may_reach(threshold)
    lines = loose.select(*sides, *extra)
    # components come first: most pairs of a large family are of one
    met = lines.alias("x").join(lines.alias("y"), same & (F.col("x.g") < F.col("y.g")) & told)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def similar_lines(lines: DataFrame, threshold: float, scratch: Scratch, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (id, digests) and the components (id, component) of those that are similar to others."""
    narrow, texts = width <= 5, None
    classes = scratch.keep(part_signatures(lines, width) if narrow else signatures(lines, width), "classes")
    if narrow:
        shared = shared_keys(classes, scratch)
        classes = scratch.keep(classes.drop("keys"), "named")  # keys are most of what lies on disk
        scratch.forget("classes")
        stars = scratch.keep(first_pairs(shared, classes), "stars")
        texts = scratch.keep(texts_of(shared.select("id").distinct(), classes, lines), "texts")
    else:
        stars = close_to_first(classes, threshold, scratch, width)
    tied = scratch.keep(verified(stars, classes, lines, threshold, scratch, "stars", width, texts), "tied")
    near = components(tied, scratch, "near")
    if narrow:
        scratch.forget("stars-pairs")
        cross = other_pairs(shared, classes, near, scratch, texts, threshold, width)
    else:
        grouped = scratch.keep(classes.join(near, "id", "left").withColumn("g", F.coalesce("component", "id")).drop(
            "component"), "grouped")
        scratch.forget("classes")
        classes = grouped
        cross = close_across(classes, threshold, scratch, width)
    cross = cross.join(stars, ["a", "b"], "left_anti")  # those were compared already
    across = scratch.keep(verified(cross, classes, lines, threshold, scratch, "across", width, texts), "across")
    if narrow:
        for done in ("texts", "stars", "across-pairs", "sketched",
                     *(f"shared-{at}" for at in range(0, PARTS * len(PART_BANDS), KEYS_AT_ONCE))):
            scratch.forget(done)
    return classes, components(tied.union(across), scratch, "groups")


def line_dedup(
    docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
    scratch: Scratch | None = None, width: int = WIDTH,
) -> DataFrame:
    """Per line: row, doc_id, line_no, class_doc_id, class_line_no, class_size, kept.

    Lines end at line feeds and are compared without spaces around them.  Lines whose sets of
    ``width``-character shingles have a Jaccard similarity of at least ``threshold`` are tied together; of each component
    the first line by (doc_id, line_no) is kept, whose place every member names.  Blank lines (and
    null or empty texts, which are one blank line) are classes of their own and kept.  Null ids come last
    in a class; lines of repeated rows are one class.  ``row`` numbers the input rows of this call.
    Other columns are not read.  An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup", lean=True)
    lines = lines_of(docs, id_col, text_col)
    classes, groups = similar_lines(lines, threshold, scratch, width)
    comps = classes.select("id", *CLASS).join(groups, "id", "left").select(
        *CLASS, F.coalesce("component", "id").alias("component"))
    placed = scratch.keep(lines.drop("line").join(comps, CLASS, "left").select(
        "row", "doc_id", "line_no", "component"), "lines")
    heads = placed.filter("component is not null").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line_no", "row")).alias("head"),
        F.count("*").alias("size")).filter("size > 1")
    own = F.struct("doc_id", "line_no", "row")
    head = F.coalesce(F.struct("head.doc_id", "head.line_no", "head.row"), own)
    told = placed.join(heads, "component", "left").withColumn(
        "h", F.when(F.col("head").isNull(), own).otherwise(head))
    return told.select(
        "row", "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("h.doc_id").alias("class_doc_id"),
        F.col("h.line_no").cast("long").alias("class_line_no"), F.coalesce("size", F.lit(1)).alias("class_size"),
        ((F.col("h.row") == F.col("row")) & (F.col("h.line_no") == F.col("line_no"))).alias("kept"))
