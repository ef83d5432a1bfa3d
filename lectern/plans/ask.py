"""From questions to answers: retrieve, assemble, prompt, generate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import generation as G
from lectern.operators import rerank as RR
from lectern.operators.index import TextIndex
from lectern.sources.tables import materialize


def contexts(
    queries: DataFrame, index: TextIndex, chunks: DataFrame, corpus: DataFrame | None = None,
    k: int = 5, hops: int = 1, embed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(query_id, context): one search with reranking, or several hops.

    ``embed`` adds ``embedding`` to queries; several hops over a ``corpus`` of vectors need it.
    """
    if hops <= 1:
        if corpus is not None and embed is not None:
            queries = embed(queries)
        return RR.rag_context(queries, index, chunks, corpus, k).select("query_id", "context")
    found = RR.multi_hop(queries, index, chunks, hops, k, corpus, embed)
    # at most hops * k + 2k passages per query
    parts = F.array_sort(F.collect_list(F.struct("pos", "context")))
    return found.groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda p: p["context"]), "\n\n").alias("context"))


def answer(
    queries: DataFrame, fn: Callable, index: TextIndex, chunks: DataFrame,
    corpus: DataFrame | None = None, k: int = 5, hops: int = 1,
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(query_id, answer) for every query, with the model behind ``fn``."""
    found = materialize(contexts(queries, index, chunks, corpus, k, hops, embed), "contexts")
    replies = materialize(G.generate(G.answer_prompts(queries, found), fn), "answers")
    first = replies.groupBy("prompt_id").agg(F.min_by("raw", F.struct("attempt", "seq")).alias("raw"))
    return queries.select("query_id").join(
        first, F.col("query_id").cast("string") == F.col("prompt_id"), "left"
    ).select("query_id", F.trim("raw").alias("answer"))
