"""SQL spellings of the text primitives, for the oracle queries."""

from __future__ import annotations

NL = "chr(10)"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w_: w_ <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def tokens(x: str, longer_than: int = 2) -> str:
    return (
        rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), "
        f"lambda t_: length(t_) > {longer_than})"
    )


def sentences(x: str) -> str:
    return (
        rf"list_filter(string_split(regexp_replace({x}, '([.!?][\"'')]*[ \t\n\r]+|\n+)', "
        r"'\1' || chr(1), 'g'), chr(1)), lambda s_: s_ <> '')"
    )


def sentence_count(x: str) -> str:
    return f"len({sentences(x)})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def trim_spaces(x: str) -> str:
    return rf"regexp_replace({x}, '^[\p{{Zs}}\t]+|[\p{{Zs}}\t]+$', '', 'g')"


def bucket(seed: str, key: str, n: int) -> str:
    return f"(('0x' || substr(md5('{seed}' || {key}), 1, 8))::BIGINT % {n})"


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
