import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from lectern.llm.collocations import collocations, equal_partitions


def brute(rows, least, longest=5, top=2000, share=100):
    counts = {}
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        of = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                of.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, of in counts.items():
        n = sum(c for p, c in of.items() if len(p) == 1)
        found = {p: c for p, c in of.items() if len(p) > 1 and c >= least}
        longer = Counter()
        for p, c in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i:i + size]] = max(longer[p[i:i + size]], c)
        kept = []
        for p, a in found.items():
            score, k = min((1000 * a * n // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            if not (longer[p] and 100 * longer[p] >= share * a):
                kept.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def corpus(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return df.selectExpr("*", "'x' as word", "1L as a", "0 as part", "'s' as phrase") if extra else df


def texts(count, seed, vocabulary=12):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "Zwei", "a\x00b", "x y"]
    ends = [" ", " ", " ", "  ", "\t", ". ", "!", "\n", "\r", ", "]
    return "".join(r.choice(words) + r.choice(ends) for _ in range(count))


@pytest.mark.parametrize("options", [{}, {"hot_rows": 5}, {"hot_rows": 60, "group_rows": 50, "chunk_bytes": 300}, {"share": 60}, {"top": 7}])
def test_equals_brute_force(spark, options):
    r = random.Random(3)
    rows = [(r.choice(["en", "de", None]), texts(r.randrange(0, 60), i)) for i in range(120)]
    rows += [("en", "the same old line of words. " * 3)] * 40 + [("de", None), ("de", ""), (None, " .,; ")]
    got = sorted(map(tuple, collocations(corpus(spark, rows, True), least=12, **options).collect()))
    assert got == brute(rows, 12, top=options.get("top", 2000), share=options.get("share", 100))
    assert got


def test_very_common_pair_and_long_text(spark):
    rows = [("en", " ".join(f"hot pair n{i} m{i % 7}" for i in range(4000))), ("en", "stop " * 30_000)]
    got = collocations(corpus(spark, rows), hot_rows=200, chunk_bytes=10_000).collect()
    assert sorted(map(tuple, got)) == brute(rows, 100)


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations(df).count() == 0


def test_quicksort_counts_every_phrase():
    r = np.random.default_rng(1)
    words = r.integers(0, 6, (3000, 5)).astype(np.int32)
    for row, cut in zip(words, r.integers(2, 6, 3000)):
        row[cut:] = -1
    weight = r.integers(1, 4, 3000)
    want = Counter()
    for row, w in zip(words.tolist(), weight.tolist()):
        for k in range(1, 6):
            if row[k - 1] >= 0:
                want[tuple(row[:k])] += w
    for least in (1, 50):
        row, depth, count = equal_partitions(words, weight, least)
        got = {tuple(words[i, :d].tolist()): c for i, d, c in zip(row, depth, count)}
        assert got == {p: c for p, c in want.items() if c >= least} and len(got) == len(row)
    assert all(len(x) == 0 for x in equal_partitions(words[:0], weight[:0], 1))


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from lectern.llm.collocations import _floor_score

    values = [(10**12, 10**14, 10**12, 10**12), (7, 3 * 10**13, 11, 13), (10**13, 10**14, 10**13 + 1, 3)]
    df = spark.createDataFrame(values, "a long, n long, l long, r long")
    got = [x[0] for x in df.select(_floor_score(*map(F.col, "anlr"))).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in values]
    assert all(x <= y for x, y in pairwise([0, *map(abs, got[:1])]))
