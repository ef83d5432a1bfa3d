"""Chunk metadata: headings inferred from text, key terms, counts and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators.structure import is_title_case


def _top_lines(text: Column, n: int) -> Column:
    return F.transform(F.slice(F.split(text, "\n"), 1, n), T.trim_spaces)


def _first_known(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def infer_chapter(text: Column) -> Column:
    """Chapter title from the first five lines.

    "Chapter X: T" gives T, "Chapter X" the line, a numbered title its last word.
    """

    def title(line: Column) -> Column:
        named = F.startswith(F.lower(line), F.lit("chapter"))
        parts = F.split(line, ":")
        last_word = F.regexp_extract(line, r"([^\p{Nd}. ]*)$", 1)
        return (
            F.when(named & (F.size(parts) > 1), T.trim_spaces(F.get(parts, F.lit(1))))
            .when(named, line)
            .when(line.rlike(K.NUMBERED_CHAPTER) & (last_word != ""), last_word)
        )

    return _first_known(F.transform(_top_lines(text, 5), title))


def infer_section(text: Column) -> Column:
    """Section title from the first three lines of 6 to 79 characters."""

    def title(line: Column) -> Column:
        fits = F.length(line).between(6, 79)
        headed = line.rlike(K.NUMBERED_SECTION) | (
            is_title_case(line) & (T.word_count(line) <= 8)
        )
        return F.when(fits & headed, line)

    return _first_known(F.transform(_top_lines(text, 3), title))


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of a token array, counted inside the row (no shuffle)."""

    def runs(s):
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return T.let(starts, lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(s, i).alias("term"),
            (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("tf"),
        )))

    return T.let(F.sort_array(tokens), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(
        F.array().cast("array<struct<term:string,tf:int>>")
    ))


def key_terms(text: Column, k: int = 10) -> Column:
    """The ``k`` most frequent terms longer than three characters, stop words left out."""
    stop = F.array(*[F.lit(w) for w in K.KEY_TERM_STOP_WORDS])
    found = F.filter(T.tokens(text, 3), lambda t: ~F.array_contains(stop, t))
    ranked = F.array_sort(F.transform(
        term_counts(found), lambda x: F.struct((-x["tf"]).alias("neg"), x["term"].alias("term"))
    ))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["term"])


def with_key_terms(chunks: DataFrame, k: int = 10) -> DataFrame:
    found = key_terms(F.col("text"), k)
    return chunks.withColumn("key_terms", F.nullif(found, F.array().cast("array<string>")))


def metadata_map(source: Column, page: Column, section: Column, chapter: Column) -> Column:
    """Source plus page, section and chapter where present, all as strings."""
    full = F.create_map(
        F.lit("source"), source, F.lit("page"), page.cast("string"),
        F.lit("section"), section, F.lit("chapter"), chapter,
    )
    return F.map_filter(full, lambda k, v: v.isNotNull())


def with_text_counts(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("word_count", T.word_count(F.col(col))).withColumn(
        "sentence_count", T.sentence_count(F.col(col))
    )


def available_sources(chunks: DataFrame) -> DataFrame:
    return chunks.select("source").distinct().orderBy("source")


def truncated_percent(part: Column, whole: Column) -> Column:
    return F.floor(T.ratio(part, whole) * 100).cast("int")


def processing_stats(
    chunks: DataFrame, merged_count: int | None = None, elements: DataFrame | None = None,
) -> DataFrame:
    """One row of counters of a run.

    Documents and pages are those of ``elements`` (doc_id, page), which has at least one row per
    document that was read, also where no chunk of it was left; everything else counts the
    finished chunks.  Without ``elements`` the chunks' own documents and pages count.
    ``merged_count`` is the number of chunks before filtering; without it the filtered counter is null.
    """
    cols = set(chunks.columns)

    def flagged(name):
        return F.count_if(F.col(name)) if name in cols else F.lit(None).cast("bigint")

    per_doc = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum("word_count").alias("words"),
        F.sum("sentence_count").alias("sentences"),
        F.count("section").alias("with_section"), F.count("page").alias("with_page"),
        flagged("was_merged").alias("merged"), flagged("was_marked").alias("marked"),
    )
    read = (chunks if elements is None else elements).groupBy("doc_id").agg(
        F.coalesce(F.max("page"), F.lit(1)).alias("pages"))
    run = read.agg(F.count("*").alias("total_documents"), F.sum("pages").alias("total_pages"))
    total = per_doc.agg(
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"),
        F.coalesce(F.sum("sentences"), F.lit(0)).alias("total_sentences"),
        F.coalesce(F.sum("with_section"), F.lit(0)).alias("chunks_with_section"),
        F.coalesce(F.sum("with_page"), F.lit(0)).alias("chunks_with_page"),
        F.sum("merged").alias("chunks_merged_context"),
        F.sum("marked").alias("chunks_marked_continuation"),
    )
    return run.crossJoin(total).select(  # one row each
        "*",
        T.ratio(F.col("total_words"), F.col("total_chunks")).alias("avg_chunk_length"),
        truncated_percent(F.col("chunks_with_section"), F.col("total_chunks"))
        .alias("section_percent"),
        (F.lit(merged_count).cast("bigint") - F.col("total_chunks")).alias("chunks_filtered"),
    )


def quality_flags(chunks: DataFrame) -> DataFrame:
    """Five readiness flags per chunk."""
    return chunks.select(
        "id",
        F.col("section").isNotNull().alias("has_section"),
        F.col("page").isNotNull().alias("has_page"),
        F.col("word_count").between(100, 800).alias("good_length"),
        (F.col("preceding_context").isNotNull() | F.col("following_context").isNotNull())
        .alias("has_overlap"),
        T.strip(F.col("text")).rlike(r"[.!?\"')]$").alias("ends_complete"),
    )


def quality_rates(chunks: DataFrame) -> DataFrame:
    flags = quality_flags(chunks)
    names = [c for c in flags.columns if c != "id"]
    return flags.agg(*[F.avg(F.col(c).cast("int")).alias(c + "_rate") for c in names])
