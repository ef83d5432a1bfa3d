"""Text primitives as Column builders.

Every threshold in the library rests on these few definitions, so they live in
one place.  They are all JVM expressions: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of characters that separate search tokens.
NON_WORD = r"[^\p{L}\p{M}\p{N}]+"
#: A sentence ends after closing punctuation (and quotes) plus whitespace, or at a line break.
#: A set of characters in front lets Java pass over all others without trying the branches.
SENTENCE_END = r"[.!?\n](?:(?<=\n)\n*|(?<=[.!?])[\"')]*[ \t\n\r]+)"
#: Single space-like characters, newline excluded.
SPACE_CHAR = r"[\p{Zs}\t]"
MARK = "\u0001"
WHITESPACE = " \t\n\x0b\f\r"
#: Tab and the Unicode space separators.
SPACES = "\t \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Pieces between space characters, empty pieces dropped (newlines do not split)."""
    return F.array_remove(F.split(text, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column, longer_than: int = 2) -> Column:
    """Lower-cased alphanumeric tokens longer than ``longer_than`` characters."""
    return F.filter(F.split(F.lower(text), NON_WORD), lambda t: F.length(t) > longer_than)


def one_space(text: Column) -> Column:
    """Every space-like character, newline excluded, as a plain space."""
    return F.regexp_replace(text, r"[\p{Zs}\t&&[^ ]]", " ")


def space_words(text: Column) -> Column:
    """Lower-cased pieces between space/tab characters; empty pieces keep their position.

    Splitting at a plain space needs no pattern, which ``split`` would compile again for every row.
    """
    return F.split(one_space(F.lower(text)), " ")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"^\p{P}+|\p{P}+$", "")


def strip(text: Column) -> Column:
    """Trim whitespace and newlines."""
    return F.btrim(text, F.lit(WHITESPACE))


def trim_spaces(text: Column) -> Column:
    """Trim spaces and tabs, leave newlines."""
    return F.btrim(text, F.lit(SPACES))


def sentences(text: Column) -> Column:
    """Sentences with their trailing whitespace, so that joining them gives the text back."""
    return F.array_remove(
        F.split(F.regexp_replace(text, SENTENCE_END, "$0" + MARK), MARK), ""
    )


def sentence_count(text: Column) -> Column:
    return F.size(sentences(text))


def paragraphs(text: Column) -> Column:
    """Trimmed non-empty paragraphs; one line is one paragraph."""
    return F.array_remove(F.transform(F.split(text, "\n"), strip), "")


def starts_upper(text: Column) -> Column:
    return text.rlike(r"^\p{Lu}")


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^\p{Ll}")


def starts_digit(text: Column) -> Column:
    return text.rlike(r"^\p{N}")


def seeded_hash(seed: str, *keys: Column) -> Column:
    """Repeatable stand-in for a shuffle key: md5 of the seed and the row's key."""
    return F.md5(F.concat(F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_bucket(seed: str, key: Column, buckets: int) -> Column:
    """Repeatable stand-in for a random choice among ``buckets``."""
    head = F.substring(seeded_hash(seed, key), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` with a default where the denominator is zero (ANSI mode raises)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))
