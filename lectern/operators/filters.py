"""Row filters and predicates over chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T

NUMERIC_ONLY = r"^[\p{N}\s.-]*$"


def has(text: Column, needle: str) -> Column:
    return F.contains(text, F.lit(needle))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def count_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions])


def filter_sources(df: DataFrame, sources=None) -> DataFrame:
    """Keep rows whose source is listed; no list or an empty one keeps all.

    ``sources`` is a list of names (pushed to the scan) or a DataFrame with a
    ``source`` column (a left semi join).
    """
    if isinstance(sources, DataFrame):
        return df.join(sources.select("source"), "source", "left_semi")
    return df.filter(F.col("source").isin(list(sources))) if sources else df


def contains_text(df: DataFrame, needle: str, col: str = "text") -> DataFrame:
    return df.filter(F.contains(F.lower(F.col(col)), F.lower(F.lit(needle)))) if needle else df


def drop_reason(text: Column, words: Column) -> Column:
    """Why a chunk is not content, or null when it is."""

    def judge(t):
        text, lower = t["text"], t["lower"]
        lines = F.split(text, "\n")
        toc_lines = F.size(F.filter(lines, lambda x: x.rlike(K.TOC_LINE)))
        index_lines = F.size(F.filter(lines, lambda x: x.rlike(K.INDEX_LINE)))
        front = count_of([has(lower, p) for p in K.FRONT_MATTER_PHRASES])
        cites = count_of([text.rlike(p) for p in K.CITATION_PATTERNS])
        return (
            F.when(toc_lines > 3, "toc_lines")
            .when(front >= 2, "front_matter")
            .when(index_lines > 5, "index_lines")
            .when((words < 100) & (cites >= 3), "citations")
            .when(lower.startswith("contents") | has(lower, "table of contents"), "contents")
        )

    both = F.struct(text.alias("text"), F.lower(text).alias("lower"))
    return F.when(words < 30, "short").otherwise(T.let(both, judge))


def with_drop_reason(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("drop_reason", drop_reason(F.col("text"), F.col("word_count")))


def filter_noncontent(chunks: DataFrame) -> DataFrame:
    return with_drop_reason(chunks).filter("drop_reason is null").drop("drop_reason")


def is_obvious_noncontent(text: Column) -> Column:
    """Cheap check before a model call: tables of contents and imprint pages."""
    lower = F.lower(text)
    lines = F.array_remove(F.split(text, "\n"), "")
    numbered = F.filter(lines, lambda x: x.rlike(r"\p{N}") & (F.length(x) < 60))
    share = F.size(numbered) / F.greatest(F.lit(1), F.size(lines))
    listing = (has(lower, "table of contents") | lower.startswith("contents")) & (share > 0.8)
    imprint = any_of([has(lower, "isbn"), has(lower, "library of congress")])
    return listing | (imprint & (F.length(text) < 500))


def prefilter_obvious(chunks: DataFrame, min_words: int = 50) -> DataFrame:
    return chunks.filter(
        (F.col("word_count") >= min_words) & ~is_obvious_noncontent(F.col("text"))
    )


def remove_documents(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Chunks left after deleting every chunk of the ``removed`` sources.

    Apply it to the postings and embedding tables too, so nothing stale stays behind.
    """
    return chunks.join(removed.select("source").distinct(), "source", "left_anti")


def removed_counts(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    return (
        chunks.join(removed.select("source").distinct(), "source", "left_semi")
        .groupBy("source").agg(F.count("*").alias("removed"))
    )


def drop_zero_scores(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("score") > 0)


def clean_metadata(value: Column) -> Column:
    """Heading without trailing footnote digits; null when numeric or a citation."""
    bare = T.trim_spaces(F.regexp_replace(value, r"\p{N}+$", ""))
    citation = has(bare, "Press,") | (has(bare, "University") & has(bare, ","))
    return F.when(~bare.rlike(NUMERIC_ONLY) & ~citation, bare)


def is_bad_section(value: Column) -> Column:
    bare = T.strip(value)
    footnote = bare.rlike(r"\p{N}$") & (F.length(bare) > 3)
    return (
        (bare == "") | footnote | has(bare, "Press,") | has(bare, "Review,")
        | bare.rlike(NUMERIC_ONLY)
    )
