"""Toxicity scores by a counterfactually regularised linear classifier.

A logistic model over words and word beginnings is fitted to labelled documents.  Besides the
loss it pays for every change of score when an identity term in a labelled sentence is swapped for
another of its group, so that naming a group does not move the score by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Interchangeable identity terms (this library's own choice); a caller may pass others.
IDENTITY_GROUPS = (
    ("men", "women", "boys", "girls"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("frauen", "männer", "jungen", "mädchen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "garçons", "filles"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes"),
    ("mujeres", "hombres", "niños", "niñas"),
    ("musulmanes", "cristianos", "judíos", "budistas"),
)
#: Word beginnings of these lengths are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Distinct words a task remembers.
REMEMBERED = 500_000
WORDS = re.compile(r"\w+").findall
SENTENCES = re.compile(r"[^.!?\n]+").findall


def word_features(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


class Features:
    """Feature numbers of texts under a vocabulary."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.known = vocabulary, {}

    def word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            at = self.vocabulary
            found = self.known[word] = tuple(at[f] for f in word_features(word) if f in at)
        return found

    def text(self, text: str) -> set[int]:
        out: set[int] = set()
        for word in set(WORDS(text.lower())):
            if found := self.word(word):
                out.update(found)
        return out


def swapped_pairs(text: str, groups: dict[str, tuple[str, ...]], features: Features) -> set:
    """Feature sets (before, after) of every sentence with one identity term swapped."""
    pairs = set()
    for sentence in SENTENCES(text.lower()):
        words = WORDS(sentence)
        for i, word in enumerate(words):
            for other in groups.get(word, ()):
                if other != word:
                    after = " ".join([*words[:i], other, *words[i + 1:]])
                    pairs.add((tuple(sorted(features.text(sentence))), tuple(sorted(features.text(after)))))
    return pairs


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: a quarter of all ids, by their checksum."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled ids that are not held out, chosen by hash."""
    usable = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null")
    usable = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id").select("text", "toxic")


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def flush():
        names = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *[pa.array([counts[f][k] for f in names], pa.int64()) for k in (0, 1)]],
            ["feature", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for feature in {f for w in set(WORDS(text.lower())) for f in word_features(w)}:
                counts.setdefault(feature, [0, 0])[toxic] += 1
        if len(counts) > REMEMBERED:
            yield flush()
            counts.clear()
    yield flush()


def select_features(rows: DataFrame, size: int, least: int) -> list[str]:
    """The ``size`` features that tell the classes apart best, of those in ``least`` texts."""
    total = rows.groupBy().agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("t")).first()
    counts = rows.mapInArrow(_feature_counts, "feature string, clean long, toxic long").groupBy(
        "feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, share = total["c"] + total["t"], total["t"] / max(1, total["c"] + total["t"])
    both = F.col("c") + F.col("t")
    score = (
        part(F.col("t"), both * share) + part(F.col("c"), both * (1 - share))
        + part(total["t"] - F.col("t"), (n - both) * share)
        + part(total["c"] - F.col("c"), (n - both) * (1 - share)))
    best = counts.filter(both >= least).orderBy(F.desc(F.round(score, 9)), "feature").limit(size)
    return [r["feature"] for r in best.select("feature").collect()]


def fit(examples: list[tuple[int, list[int]]], pairs: list[tuple], size: int,
        l2: float = 1.0, swap: float = 1.0, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias: mean logistic loss + ``l2`` |w|^2 / n + ``swap`` times the mean squared change."""
    y = np.array([t for t, _ in examples], float)
    at = np.array([f for _, fs in examples for f in fs], np.int64)
    row = np.repeat(np.arange(len(examples)), [len(fs) for _, fs in examples])
    d_at = np.array([f for a, b in pairs for f in (*a, *b)], np.int64)
    d_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    d_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs]) if pairs else np.zeros(0)
    rate = y.mean() if len(y) else 0.0
    w, bias = np.zeros(size), float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    if not 0 < rate < 1:
        return w, bias
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, rounds + 1):  # Adam on the whole sample
        z = np.bincount(row, w[at], len(examples)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(at, error[row], size) + 2 * l2 / len(y) * w
        if pairs:
            change = np.bincount(d_row, d_sign * w[d_at], len(pairs))
            g += 2 * swap / len(pairs) * np.bincount(d_at, d_sign * change[d_row], size)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def train(
    docs: DataFrame, labels: DataFrame, most: int = 20_000, size: int = 2_000, least: int = 8,
    identity=IDENTITY_GROUPS, swap: float = 1.0,
) -> tuple[dict[str, float], float]:
    """Feature weights and bias, fitted to at most ``most`` labelled documents (their whole texts).

    The driver holds ``size`` features and, per sampled document, the numbers of those in it.
    """
    rows = sample(docs, labels, most)
    terms = sorted({f for g in identity for t in g for f in word_features(t)})
    names = list(dict.fromkeys([*select_features(rows, size, least), *terms]))
    vocabulary = {f: i for i, f in enumerate(names)}
    groups = {t: g for g in identity for t in g}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(vocabulary)
        for batch in batches:
            found, swaps = [], []
            for text in batch.column("text").to_pylist():
                found.append(sorted(features.text(text)))
                swaps.append([[list(a), list(b)] for a, b in sorted(swapped_pairs(text, groups, features))])
            yield pa.RecordBatch.from_arrays([
                batch.column("toxic"), pa.array(found, pa.list_(pa.int32())),
                pa.array(swaps, pa.list_(pa.list_(pa.list_(pa.int32())))),
            ], ["toxic", "found", "swaps"])

    seen = rows.mapInArrow(run, "toxic int, found array<int>, swaps array<array<array<int>>>").collect()
    seen.sort(key=lambda r: (r["toxic"], r["found"]))  # so that sums do not depend on task order
    pairs = {(tuple(a), tuple(b)) for r in seen for a, b in r["swaps"]}
    features = Features(vocabulary)
    for group in identity:  # the terms by themselves, also where no sampled sentence has them
        for a in group:
            for b in group:
                if a < b:
                    pairs.add((tuple(sorted(features.text(a))), tuple(sorted(features.text(b)))))
    w, bias = fit([(r["toxic"], r["found"]) for r in seen], sorted(pairs), len(names), swap=swap)
    return {f: float(x) for f, x in zip(names, w)}, bias


def score_column(weights: dict[str, float], bias: float):
    """A function from a text column to scores; an empty or null text scores as the bias alone."""
    names = list(weights)
    vocabulary = {f: i for i, f in enumerate(names)}
    values = [weights[f] for f in names]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(vocabulary)
        for texts in batches:
            z = np.array([sum(values[i] for i in sorted(features.text(t or ""))) for t in texts], float) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    # typed at run time: the annotations are texts here
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **training) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Only ``text`` enters the score.  A null or empty text gets the base rate; without usable labels
    every score is the same.  Labels may repeat or be null: an id is toxic if any row says so.
    Null ids are scored and never learned from; repeated rows are scored each; other
    columns are not read.
    """
    score = score_column(*train(docs, labels, **training))
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **training) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    score = score_column(*train(docs, labels, **training))
    return docs.filter(score(F.col("text").cast("string")) < threshold)
