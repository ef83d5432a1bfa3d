"""Whole pipelines from documents to finished chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.operators import chunking as C
from lectern.operators import filters as L
from lectern.operators import generation as G
from lectern.operators import metadata as M
from lectern.operators import parsing as X
from lectern.operators import structure as S


def merged_arrays(docs: DataFrame, target: int = K.TARGET_WORDS) -> DataFrame:
    """(doc_id, source, chunks): elements, chunks with overlap, small ones merged, in the row of each document."""
    elements = S.markdown_elements(F.col("text"))
    chunks = C.finalized(C.chunk_array(elements, target), F.col("source"))
    return docs.select(
        "doc_id", "source", C.merged(C.overlapped(chunks), C.sizes(target)[1]).alias("chunks"))


def _rows(arrays: DataFrame) -> DataFrame:
    # of a bare column Spark infers a filter on its size, pushes it down and computes all chunks for it once more
    chunks = F.when(F.size("chunks") > 0, F.col("chunks"))
    return arrays.select("doc_id", "source", F.inline(chunks)).select(*C.CHUNK_COLUMNS)


def merged_chunks(docs: DataFrame, target: int = K.TARGET_WORDS) -> DataFrame:
    """Chunks of (doc_id, source, text) documents after merging, a row each; no exchange."""
    return _rows(merged_arrays(docs, target))


def finished_chunks(arrays: DataFrame) -> DataFrame:
    """Merged chunk arrays filtered, overlapped again, repaired and given key terms, a row per chunk."""
    content = F.filter("chunks", lambda c: L.drop_reason(c["text"], c["word_count"]).isNull())
    kept = arrays.withColumn("chunks", C.overlapped(content))
    return M.with_key_terms(C.repair_mid_sentence(_rows(kept)))


def process_documents(docs: DataFrame, target: int = K.TARGET_WORDS) -> DataFrame:
    """Fast mode: all steps from text to finished chunks run in the row of the document; no exchange."""
    return finished_chunks(merged_arrays(docs, target))


def summarize_documents(docs: DataFrame, fn: Callable, target: int = K.TARGET_WORDS) -> DataFrame:
    """Model mode: every merged chunk is rewritten by ``fn`` (see ``generation.generate``)."""
    chunks = merged_chunks(docs, target)
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_idx").cast("string"))
    prompts = G.build_prompts(L.prefilter_obvious(chunks).withColumn("prompt_id", key), "summary")
    at = F.split("prompt_id", ":")
    replies = G.generate(prompts, fn).groupBy("prompt_id").agg(
        F.min_by("raw", F.struct("attempt", "seq")).alias("raw")
    ).select(
        F.get(at, F.lit(0)).cast("bigint").alias("doc_id"),
        F.get(at, F.lit(1)).cast("int").alias("chunk_idx"), "raw")
    return X.apply_summaries(chunks, replies)
