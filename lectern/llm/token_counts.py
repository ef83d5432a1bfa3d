"""Token counts of a byte-level BPE tokenizer, with a shortcut for whole tokens.

Offline, once per vocabulary, every entry is tried: those that split off as one pre-token and
encode alone as one token are proven to cost 1 wherever they appear as a pre-token.  A text is cut
into pre-tokens; proven ones are counted by lookup and only the rest go through the merges,
each distinct one once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Cuts texts into pre-tokens (fixed by the tokenizer's byte-level pre-tokenizer).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cut for texts of these characters only, where plain classes say what a letter is.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN_TEXT = rf"[\t\n\r -~{LETTERS}]*"
PLAIN_PRETOKENS = (
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Distinct merged pre-tokens remembered by a task.
REMEMBERED = 1_000_000


def pretokens():
    """A function that cuts a text into its pre-tokens."""
    import regex

    plain, cut = re.compile(PLAIN_TEXT), re.compile(PLAIN_PRETOKENS).findall
    full = regex.compile(PRETOKENS).findall
    return lambda text: cut(text) if plain.fullmatch(text) else full(text)


def specials(path: str) -> list[str]:
    """Strings that the tokenizer takes out of texts as tokens of their own."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec["pre_tokenizer"]
    if steps["type"] != "ByteLevel" or steps["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("only plain byte-level tokenizers are counted")
    for token in spec["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token with conditions: {token['content']}")
    return [token["content"] for token in spec["added_tokens"]]


def proven(path: str) -> list[str]:
    """Vocabulary strings that are one pre-token and encode alone as exactly their own id."""
    from tokenizers import Tokenizer

    tokenizer, cut, marked = Tokenizer.from_file(path), pretokens(), set(specials(path))
    found = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=False)):
        text = tokenizer.decode([i], skip_special_tokens=False)
        if text and text not in marked and cut(text) == [text]:
            if tokenizer.encode(text, add_special_tokens=False).ids == [i]:
                found.append(text)
    return found


class _Costs(dict):
    """Tokens of a pre-token; the rest is merged when first met."""

    def __init__(self, whole: list[str], tokenizer):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.tokenizer = whole, tokenizer

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(self) > REMEMBERED + len(self.whole):
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[piece] = n
        return n


def counter(path: str, whole: list[str]):
    """A function from texts to token counts."""
    from tokenizers import Tokenizer

    cost = _Costs(whole, Tokenizer.from_file(path)).__getitem__
    cut, marked = pretokens(), specials(path)
    apart = re.compile("|".join(map(re.escape, sorted(marked, key=len, reverse=True)))) if marked else None

    def count(text: str) -> int:
        if apart and apart.search(text):
            parts = apart.split(text)
            return len(parts) - 1 + sum(sum(map(cost, cut(p))) for p in parts)
        return sum(map(cost, cut(text)))

    return count


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a byte-level BPE file of the tokenizers library, readable on every executor.  A
    null or empty text has 0 bytes and 0 tokens; null ids and repeated rows are kept; other columns
    are not read.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(proven(path))  # bounded by the vocabulary
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, whole.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()),
            ], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
