"""Turning raw text into ordered elements: line unwrapping, headings, line classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as T

SOFT_JOIN = "\u0001"
HARD_BREAK = "\u0002"


def is_paragraph_start(line: Column, prev: Column) -> Column:
    """Does ``line`` open a new paragraph, given the line before it ('' when blank)?"""
    after_stop = prev.rlike(r"[.!?:;]$") & T.starts_upper(line)
    bullet = line.rlike(r"^[•*-]")
    numbered = T.starts_digit(line) & F.substring(line, 1, 4).rlike(r"[.)]")
    all_caps = (line == F.upper(line)) & (F.length(line) > 3) & F.contains(line, F.lit(" "))
    return (prev == "") | after_stop | bullet | numbered | all_caps


def unwrap_lines(text: Column) -> Column:
    """Join hard-wrapped lines into paragraphs; a trailing hyphen glues two words.

    Only the previous physical line decides whether a line opens a paragraph, so
    each line is flagged on its own and the glue is plain string replacement.
    """

    def glue(lines: Column) -> Column:
        def mark(line: Column, i: Column) -> Column:
            prev = F.coalesce(F.get(lines, i - 1), F.lit(""))
            opener = F.when(is_paragraph_start(line, prev), HARD_BREAK).otherwise(SOFT_JOIN)
            return F.when(line == "", "").otherwise(F.concat(opener, line))

        joined = F.array_join(F.transform(lines, mark), "")
        joined = F.replace(joined, F.lit("-" + SOFT_JOIN), F.lit(""))
        joined = F.replace(joined, F.lit(SOFT_JOIN), F.lit(" "))
        return F.replace(F.substring(joined, 2, 2**31 - 1), F.lit(HARD_BREAK), F.lit("\n\n"))

    return T.let(F.transform(F.split(text, "\n"), T.trim_spaces), glue)


def split_paragraphs(text: Column) -> Column:
    """Trimmed paragraphs; when at most one is found, fall back to blank-line blocks."""
    found = T.paragraphs(text)
    blocks = F.array_remove(F.transform(F.split(text, "\n\n"), T.strip), "")
    return T.let(found, lambda p: F.when(F.size(p) > 1, p).otherwise(blocks))


def element(kind: Column, text: Column, page: Column, level: Column) -> Column:
    return F.struct(
        kind.alias("type"), text.alias("text"),
        page.cast("int").alias("page"), level.cast("int").alias("level"),
    )


def markdown_elements(text: Column) -> Column:
    """Each non-empty line as an element; ``#`` runs give the heading level."""

    def heading(line: Column, level: Column) -> Column:
        kind = F.when(level == 1, "chapter").when(level == 2, "section").otherwise("subsection")
        body = T.trim_spaces(F.regexp_replace(line, r"^#+", ""))
        return element(kind, body, F.lit(None), level)

    def to_element(line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(#+)", 1))
        plain = element(F.lit("paragraph"), line, F.lit(None), F.lit(0))
        return F.when(F.startswith(line, F.lit("#")), T.let(level, lambda n: heading(line, n))).otherwise(plain)

    lines = F.array_remove(F.transform(F.split(text, "\n"), T.trim_spaces), "")
    return F.transform(lines, to_element)


def is_title_case(text: Column) -> Column:
    """At least 60 % of the words start with an upper-case letter."""
    found = T.words(text)
    return T.ratio(F.size(F.filter(found, T.starts_upper)), F.size(found)) >= 0.6


def classify_line(line: Column) -> Column:
    """Element type of one line: chapter, section, listItem or paragraph."""
    n_words = T.word_count(line)
    n_chars = F.length(line)
    core = F.regexp_replace(line, r"^[\p{Nd}\p{Zs}\t–-]+|[\p{Nd}\p{Zs}\t–-]+$", "")
    caps_heading = (line == F.upper(line)) & n_words.between(2, 10) & (n_chars >= 5)
    opens_chapter = F.contains(line, F.lit("CHAPTER")) | (
        T.starts_digit(line) & F.contains(line, F.lit(" "))
    )
    titled = n_words.between(2, 12) & (n_chars >= 8) & is_title_case(line)
    listed = line.rlike(r"^[•*-]") | (T.starts_digit(line) & F.contains(line, F.lit(".")))
    return (
        F.when((n_chars < 3) | (F.length(core) <= 2), "paragraph")
        .when(caps_heading & opens_chapter, "chapter")
        .when(caps_heading | titled, "section")
        .when(listed, "listItem")
        .otherwise("paragraph")
    )


def page_elements(text: Column, page: Column) -> Column:
    """Elements of one page of plain text: unwrapped paragraphs, short ones classified."""

    def to_element(par: Column) -> Column:
        kind = F.when(T.word_count(par) <= 10, classify_line(par)).otherwise("paragraph")
        level = F.when(kind == "chapter", 1).when(kind == "section", 2).otherwise(0)
        return element(kind, par, page, level)

    return F.transform(split_paragraphs(unwrap_lines(text)), to_element)
