"""Phrase collocations by multikey quicksort of suffix pointers.

Every word begins a suffix of up to ``longest`` words of its piece.  Suffixes are routed to tasks by
their first two words, so a task holds all suffixes with a beginning.  There a multikey quicksort
splits the pointers three ways at one word after the other: the pointers left in an equal partition
share a phrase, their number is its count, and a partition below the least count is abandoned.

One pass ahead counts single words, and pairs in a fixed number of counters.  Its two bit tables (8 MB
each at any size) tell which pairs can reach the least count, so other suffixes end there
before they travel, and which pairs are too frequent for one task.  Suffixes that begin with those are
routed by all their words; their shorter beginnings are then counted in several tasks and summed up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.tables import Scratch

#: Pair counters are numbered by 32 bits of a hash; a counter bucket is the first 10 of them, a bit of the
#: two tables stands for the counters that agree in the first 26.
COUNTER_BITS, BUCKET_BITS, TABLE_BITS = 32, 10, 26
#: Bytes of text that are split into words at once, and suffixes of one group in a task.
CHUNK_BYTES, GROUP_ROWS = 5 << 20, 500_000
_LOWER = bytes(range(ord("A"), ord("Z") + 1))
#: Characters that end a piece; a blank is written for a tab, a line feed for the others.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_LOWER + PIECE_ENDS + b"\t", _LOWER.lower() + b"\n" * len(PIECE_ENDS) + b" ")
_STOP = b"\xff"  # no byte of UTF-8, so no word
_WEYL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Numbers(dict):
    """Numbers of words in order of appearance; the end of a piece is 0."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _chunks(batches, most: int) -> Iterator[tuple[str, bytes]]:
    """(lang, text) in pieces of about ``most`` bytes, cut between pieces; every text ends one."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            view = text.as_buffer()
            flat = (view.to_pybytes() if view else b"").translate(_TABLE)
            while len(flat) > most:  # a very long text goes in parts
                cut = flat.rfind(b"\n", 0, most)
                cut = flat.find(b"\n", most) if cut < 0 else cut
                if cut < 0:
                    break
                yield lang, flat[:cut]
                flat = flat[cut + 1:]
            held.setdefault(lang, []).append(flat)
            size += len(flat)
            if size >= most:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def _numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers of a chunk, 0 between pieces, and the words in order of number."""
    numbers = _Numbers({_STOP: 0})
    words = text.replace(b"\n", b" \xff ").split()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    return ids, list(numbers)


def _pair_slots(ids: np.ndarray, words: list[bytes], lang: str) -> np.ndarray:
    """Counter number of the pair that begins at every word but the last; 64 bits are mixed into 32."""
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    codes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)[ids]
    mixed = codes[:-1] * _WEYL + codes[1:]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX
    return (mixed >> np.uint64(64 - COUNTER_BITS)).astype(np.uint32)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def count_words(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Per chunk: its word counts (word null: all words), and its pair counts as one row per counter bucket."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("bucket", pa.int32()),
                        ("slots", pa.binary()), ("counts", pa.binary())])

    def count(batches):
        for lang, text in _chunks(batches, chunk_bytes):
            ids, words = _numbered(text)
            seen = np.bincount(ids, minlength=len(words))[1:]
            k = len(seen)
            if not k:
                continue
            none = pa.nulls(k + 1)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (k + 1), pa.string()), pa.array([w.decode() for w in words[1:]] + [None], pa.string()),
                pa.array(np.append(seen, seen.sum())), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())],
                schema=schema)
            slots = _pair_slots(ids, words, lang)[(ids[:-1] != 0) & (ids[1:] != 0)]
            if not len(slots):
                continue
            slots, counts = np.unique(slots, return_counts=True)
            counts = counts.astype(np.uint32)
            buckets = (slots >> np.uint32(COUNTER_BITS - BUCKET_BITS)).astype(np.int32)
            ends = np.append(np.flatnonzero(np.diff(buckets)) + 1, len(slots))
            starts = np.append(0, ends[:-1])
            none = pa.nulls(len(ends))
            yield pa.RecordBatch.from_arrays([
                none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array(buckets[starts], pa.int32()),
                pa.array([slots[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], schema=schema)

    return docs.mapInArrow(
        count, "lang string, word string, n long, bucket int, slots binary, counts binary")


def pair_tables(passed: DataFrame, least: int, hot_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bit tables of frequent and of hot pairs (a byte a bit), and the number of suffixes that stay.

    A task adds up one bucket of counters after the other and sends home its stretch of the two tables,
    so the driver gets two tables of fixed size, whatever the input.
    """
    step = TABLE_BITS - BUCKET_BITS

    def add(batches):
        rows = ((b, s.as_py(), c.as_py()) for batch in batches
                for b, s, c in zip(batch.column("bucket").to_pylist(), batch.column("slots"), batch.column("counts")))
        for bucket, group in groupby(rows, key=lambda r: r[0]):
            slots, counts, fresh, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0
            for _, s, c in group:
                fresh.append((np.frombuffer(s, np.uint32), np.frombuffer(c, np.uint32).astype(np.int64)))
                size += len(fresh[-1][0])
                if size > 1_000_000 + len(slots):  # memory follows the counters of a bucket, not the rows
                    slots, counts = _summed(*(np.concatenate(x) for x in zip((slots, counts), *fresh)))
                    fresh, size = [], 0
            if fresh:
                slots, counts = _summed(*(np.concatenate(x) for x in zip((slots, counts), *fresh)))
            place = (slots >> np.uint32(COUNTER_BITS - TABLE_BITS)).astype(np.int64) - (bucket << step)
            tables = []
            for held in (counts >= least, counts > hot_rows):
                bits = np.zeros(1 << step, bool)
                bits[place[held]] = True
                tables.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([bucket], pa.int32()), "frequent": [tables[0]], "hot": [tables[1]],
                "rows": [int(counts[counts >= least].sum())]})

    blocks = passed.filter("bucket is not null").select("bucket", "slots", "counts")
    told = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        add, "bucket int, frequent binary, hot binary, rows long")
    frequent, hot = np.zeros(1 << (TABLE_BITS - 3), np.uint8), np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    rows, width = 0, 1 << (step - 3)
    for r in told.toLocalIterator():  # at most 2^BUCKET_BITS rows of two stretches
        at = r["bucket"] * width
        frequent[at:at + width] = np.frombuffer(r["frequent"], np.uint8)
        hot[at:at + width] = np.frombuffer(r["hot"], np.uint8)
        rows += r["rows"]
    return frequent, hot, rows


def _bits(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    place = slots >> np.uint32(COUNTER_BITS - TABLE_BITS)
    return (table[place >> np.uint32(3)] >> (np.uint8(7) - (place & np.uint32(7)).astype(np.uint8)) & 1).astype(bool)


def equal_partitions(words: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey quicksort of the rows of ``words`` (-1 past a suffix's end): (row, depth, count) of each phrase.

    All open partitions of a round are split at once: each has its own depth and pivot, its pointers go below,
    to or above the pivot in place, and the equal part goes on one word deeper.  Parts that weigh less
    than ``least`` are abandoned, since no phrase in them can reach it.
    """
    n, deepest = words.shape
    order = np.arange(n)
    starts, depth = np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
    found = []
    while len(starts):
        sizes = np.diff(np.append(starts, len(order)))
        keys = words[order, np.repeat(depth, sizes)]
        three = np.sort([keys[starts], keys[starts + sizes // 2], keys[starts + sizes - 1]], axis=0)
        pivot = np.repeat(three[1], sizes)
        below, equal = keys < pivot, keys == pivot
        at = np.repeat(starts, sizes)
        n_below, n_equal = np.add.reduceat(below, starts, dtype=np.int64), np.add.reduceat(equal, starts, dtype=np.int64)

        def ranks(mask, counts, starts=starts, sizes=sizes):
            before = np.cumsum(mask) - mask
            return before - np.repeat(before[starts], sizes)

        after_below, after_equal = np.repeat(n_below, sizes), np.repeat(n_below + n_equal, sizes)
        above = ~(below | equal)
        goal = at + np.where(below, ranks(below, n_below), np.where(
            equal, after_below + ranks(equal, n_equal), after_equal + ranks(above, None)))
        moved = np.empty_like(order)
        moved[goal] = order
        cuts = np.stack([starts, starts + n_below, starts + n_below + n_equal], axis=1).ravel()
        lengths = np.stack([n_below, n_equal, sizes - n_below - n_equal], axis=1).ravel()
        held = lengths > 0
        kind = np.tile([0, 1, 0], len(starts))[held]
        first, length, level = cuts[held], lengths[held], np.repeat(depth, 3)[held] + kind
        total = np.add.reduceat(weight[moved], first)
        ended = (kind == 1) & (words[moved[first], level - kind] < 0)
        open_ = (total >= least) & ~ended
        told = open_ & (kind == 1)
        found.append((moved[first[told]], level[told], total[told]))
        on = open_ & (level < deepest)
        order = moved[np.repeat(on, length)]
        depth, length = level[on], length[on]
        starts = np.cumsum(length) - length
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


_BLOCK = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("split", pa.bool_()), ("words", pa.binary()),
                    ("ids", pa.binary()), ("weights", pa.binary())])


def _blocks(lang: str, rows: np.ndarray, weight: np.ndarray, part: np.ndarray, split: bool, words: list[bytes]):
    """Suffixes grouped by the part they are routed to, each group with the words it needs."""
    order = np.argsort(part, kind="stable")
    rows, weight, part = rows[order], weight[order], part[order]
    ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
    columns = {f.name: [] for f in _BLOCK}
    for a, b in zip(np.append(0, ends[:-1]), ends):
        used, own = np.unique(rows[a:b], return_inverse=True)
        shift = int(used[0] == -1)
        local = own.reshape(b - a, -1).astype(np.int32) - shift
        for name, value in zip(columns, (
                lang, int(part[a]), split, b"\n".join([words[i] for i in used[shift:]]), local.tobytes(),
                weight[a:b].tobytes())):
            columns[name].append(value)
    return pa.RecordBatch.from_pydict(columns, schema=_BLOCK)


def route_suffixes(docs: DataFrame, tables, longest: int, parts: int, chunk_bytes: int) -> DataFrame:
    """Suffixes whose first pair can be frequent, cut behind their last such pair, as blocks by part."""
    sent = docs.sparkSession.sparkContext.broadcast(tables)  # two bit tables of fixed size

    def route(batches):
        frequent, hot = sent.value
        for lang, text in _chunks(batches, chunk_bytes):
            ids, words = _numbered(text)
            if len(ids) < 2:
                continue
            slots = _pair_slots(ids, words, lang)
            good = (ids[:-1] != 0) & (ids[1:] != 0) & _bits(frequent, slots)
            at = np.flatnonzero(good)
            if not len(at):
                continue
            padded, more = np.concatenate([ids, np.zeros(longest, np.int32)]), np.concatenate([good, np.zeros(longest, bool)])
            rows = np.full((len(at), longest), -1, np.int32)
            rows[:, 0] = padded[at]
            on = np.ones(len(at), bool)
            for k in range(1, longest):
                on = on & more[at + k - 1]
                rows[on, k] = padded[at[on] + k]
            pair, one = slots[at], np.ones(len(at), np.int64)
            many = _bits(hot, pair)
            usual = ~many
            if usual.any():
                yield _blocks(lang, rows[usual], one[usual], (pair[usual] % np.uint32(parts)).astype(np.int32), False, words)
            if many.any():  # equal suffixes of this chunk become one, so copies of a passage do not pile up
                rows = rows[many]
                row, depth, count = equal_partitions(rows + 1, np.ones(len(rows), np.int64), 1)
                whole = depth == longest
                rows, count = rows[row[whole]], count[whole]
                codes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
                mixed = np.zeros(len(rows), np.uint64)
                for k in range(longest):
                    mixed = (mixed ^ np.where(rows[:, k] < 0, np.uint64(1), codes[rows[:, k]])) * _WEYL
                    mixed ^= mixed >> np.uint64(29)
                yield _blocks(lang, rows, count, (mixed % np.uint64(parts)).astype(np.int32), True, words)

    return docs.mapInArrow(
        route, "lang string, part int, split boolean, words binary, ids binary, weights binary")


def count_phrases(blocks: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, words, a): every phrase of 2 to ``longest`` words found ``least`` times or more."""

    def count(table: pa.Table) -> pa.Table:
        lang, split = table.column("lang")[0].as_py(), table.column("split")[0].as_py()
        numbers, rows, weights = _Numbers(), [], []
        for words, ids, weight in zip(*(table.column(c) for c in ("words", "ids", "weights"))):
            own = np.array([numbers[w] for w in words.as_py().split(b"\n")] + [-1], np.int32)
            rows.append(own[np.frombuffer(ids.as_py(), np.int32)].reshape(-1, longest))
            weights.append(np.frombuffer(weight.as_py(), np.int64))
        rows, names = np.concatenate(rows), list(numbers)
        row, depth, total = equal_partitions(rows, np.concatenate(weights), 1 if split else least)
        held = depth > 1
        row, depth, total = row[held], depth[held], total[held]
        phrases = [b" ".join([names[i] for i in rows[r, :d]]).decode() for r, d in zip(row, depth)]
        return pa.table({"lang": pa.array([lang] * len(row), pa.string()), "phrase": pa.array(phrases, pa.string()),
                         "words": pa.array(depth, pa.int32()), "a": pa.array(total, pa.int64())})

    counted = blocks.groupBy("lang", "part", "split").applyInArrow(
        count, "lang string, phrase string, words int, a long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def _floor_score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)) in whole decimals of 38 digits."""
    whole = [c.cast("decimal(17,0)") for c in (a, n, l, r)]
    return F.call_function("div", whole[0] * whole[1] * F.lit(1000).cast("decimal(4,0)"), whole[2] * whole[3])


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with the parts l and r of their lowest-scoring cut, n and score."""
    parts = phrases.select("lang", "phrase", "a").unionByName(words.select("lang", F.col("word").alias("phrase"), "a"))
    split = F.split("phrase", " ")
    cuts = phrases.withColumn("w", split).select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w").select(
        "lang", "phrase", "a", "words", "k", F.concat_ws(" ", F.slice("w", 1, F.col("k"))).alias("first"),
        F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("words"))).alias("rest"))
    first = parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rest = parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    told = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang").withColumn(
        "score", _floor_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    low = told.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return low.select("lang", "phrase", "words", "a", "n", "cut.score", "cut.l", "cut.r")


def without_contained(found: DataFrame, phrases: DataFrame, share: int) -> DataFrame:
    """Drop candidates that lie in a longer candidate with at least ``share`` percent of their count.

    A longer candidate of that count implies one just a word longer: its count lies between.
    """
    longer = phrases.filter("words > 2").withColumn("w", F.split("phrase", " "))
    inner = F.array(*[F.concat_ws(" ", F.slice("w", k, F.col("words") - 1)) for k in (1, 2)])
    held = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy(
        "lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.join(held, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def first_ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each lang: each of many parts of a lang names its first, those are ranked."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    inside = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
    return inside.filter(F.col("rank") <= top).drop("rank").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, share: int = 100,
    text_col: str = "text", lang_col: str = "lang", hot_rows: int = 200_000, group_rows: int = GROUP_ROWS,
    chunk_bytes: int = CHUNK_BYTES, scratch: Scratch | None = None,
) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased in A-Z alone and end at blanks and tabs, pieces at ``PIECE_ENDS``.  A null text counts as
    empty and a null lang as ``und``.  Repeated rows count as often as they occur; ties are ordered by count,
    then phrase.  Texts of any length are read whole, in parts between pieces.  Other columns are
    not read, whatever their names; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    texts = docs.select(
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    passed = scratch.keep(count_words(texts, chunk_bytes), "counts")
    counted = passed.filter("bucket is null").groupBy("lang", "word").agg(F.sum("n").alias("a"))
    words = scratch.keep(counted.filter(F.col("word").isNull() | (F.col("a") >= least)), "words")
    frequent, hot, rows = pair_tables(passed, least, hot_rows)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // group_rows))
    phrases = scratch.keep(count_phrases(
        route_suffixes(texts, (frequent, hot), longest, parts, chunk_bytes), longest, least), "phrases")
    totals = words.filter("word is null").select("lang", F.col("a").alias("n"))
    found = scored(phrases, words.filter("word is not null"), totals)
    kept = first_ranked(without_contained(found, phrases, share), top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
