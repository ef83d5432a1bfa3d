"""Whole pipelines from chunks to questions and training sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators import generation as G
from lectern.operators import parsing as X
from lectern.operators import training as R
from lectern.operators import validation as V
from lectern.sources.files import write_training_jsonl
from lectern.sources.tables import materialize

#: Attempts that one wave of asking may count.
WAVE = 100


def _replies(prompts: DataFrame, fn: Callable, log: str | None, wave: int = 0) -> DataFrame:
    """Written replies: of this run, or those of a log with what it lacks."""
    if log is None:
        return materialize(G.generate(prompts, fn), "replies")
    return G.generate_once(prompts, fn, log, wave)


def make_questions(
    chunks: DataFrame, fn: Callable, difficulty: str, count: int | None = None,
    few_shot: int = 3, seed: str = "quiz", waves: int = 2, log: str | None = None,
) -> DataFrame:
    """One accepted question per chunk (id, source, text): prompt, generate, parse, choose.

    ``fn`` may return several (attempt, seq) replies per prompt.  The replies are written
    before they are used, so a lost executor never asks the model again for finished work.
    Prompts without an accepted question are asked once more per further wave, and only they;
    the attempts of a wave count on from ``wave * WAVE``.  With ``log``, a folder, replies outlive the run and
    are not asked for again.
    """
    picked = chunks if count is None else G.sample_chunks(chunks, count, seed)
    examples = G.few_shot_blocks(G.gold_examples(chunks.sparkSession), few_shot)
    prompts = G.build_prompts(picked, "mcq", F.lit(difficulty), examples).withColumn(
        "prompt_id", F.col("id"))
    texts = picked.select(F.col("id").cast("string").alias("prompt_id"), "source", "text")
    best = None
    for wave in range(waves):
        if best is not None:
            done = best.select("prompt_id")
            prompts = prompts.withColumn("prompt_id", F.col("prompt_id").cast("string")).join(
                done, "prompt_id", "left_anti")
        replies = _replies(prompts, fn, log, wave).withColumn(
            "attempt", F.col("attempt") + wave * WAVE)
        keyed = replies.join(texts, "prompt_id").withColumn("reply_id", F.concat_ws(
            ":", "prompt_id", F.col("attempt").cast("string"), F.col("seq").cast("string")))
        accepted = V.best_replies(keyed, "prompt_id", "reply_id")
        best = materialize(accepted if best is None else best.unionByName(accepted), "accepted")
    return best.withColumn("difficulty", F.lit(difficulty)).withColumnRenamed("prompt_id", "chunk_id")


def make_open_questions(
    chunks: DataFrame, fn: Callable, difficulty: str, count: int | None = None, seed: str = "open",
    log: str | None = None,
) -> DataFrame:
    """Open questions with ideal answers, at most one per chunk (id, source, text)."""
    picked = chunks if count is None else G.sample_chunks(chunks, count, seed)
    prompts = G.build_prompts(picked, "open", F.lit(difficulty)).withColumn("prompt_id", F.col("id"))
    replies = _replies(prompts, fn, log)
    first = replies.groupBy("prompt_id").agg(F.min_by("raw", F.struct("attempt", "seq")).alias("raw"))
    sourced = first.join(picked.select(F.col("id").alias("prompt_id"), "source", "text"), "prompt_id")
    return X.parse_open_ended(sourced).withColumnRenamed("prompt_id", "chunk_id")


def make_flashcards(
    chunks: DataFrame, fn: Callable, count: int, seed: str = "cards", sampled: int = 3
) -> DataFrame:
    """Cards from up to three sampled chunks in one prompt; all carry the first one's source."""
    picked = G.sample_chunks(chunks, sampled, seed)
    place = F.struct(T.seeded_hash(seed, F.col("id")).alias("h"), "id")
    parts = F.array_sort(F.collect_list(F.struct(place.alias("at"), "text")))
    batch = picked.agg(
        F.min_by("source", place).alias("source"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"),
        F.count("*").alias("n"),
    ).filter("n > 0").select(F.lit("cards").alias("id"), "source", "text")
    prompts = G.build_prompts(batch, "flashcard", count=count).withColumn("prompt_id", F.col("id"))
    replies = materialize(G.generate(prompts, fn), "replies")
    return X.parse_flashcards(replies.join(
        batch.select(F.col("id").alias("prompt_id"), "source"), "prompt_id"
    ).select("source", "raw"))


def make_role_tag_set(
    chunks: DataFrame, fn: Callable, per_difficulty: int, folder: str,
    ratio: float = 0.1, seed: str = "roles",
) -> DataFrame:
    """Questions of every difficulty as role-tag lines, split and written under ``folder``.

    ``chunks`` is (id, doc_id, chunk_idx, source, text).  Returns (id, split, text).
    """
    sets = {
        d: make_questions(chunks, fn, d, per_difficulty, seed=f"{seed}-{d}").drop("difficulty")
        for d in K.DIFFICULTIES
    }
    every = R.attach_chunk(R.union_difficulties(sets), chunks)
    lines = materialize(R.format_role_tags(every).select(
        F.concat_ws("-", "difficulty", "chunk_id").alias("id"), F.col("line").alias("text")), "lines")
    split = materialize(R.valid_first_split(lines, ratio, seed), "split")
    write_training_jsonl(split, folder)
    return split


def make_training_set(
    chunks: DataFrame, fn: Callable, ratio: float = 0.8, seed: str = "train", log: str | None = None,
) -> DataFrame:
    """(id, split, text): one example per chunk, strict parse, dedup, split and chat format."""
    levelled = R.assign_difficulty(chunks, seed)
    prompts = G.build_prompts(levelled, "training", F.col("difficulty")).withColumn("prompt_id", F.col("id"))
    replies = _replies(prompts, fn, log)
    first = replies.groupBy("prompt_id").agg(F.min_by("raw", F.struct("attempt", "seq")).alias("raw"))
    sourced = first.join(
        levelled.select(F.col("id").alias("prompt_id"), "source", "difficulty"), "prompt_id")
    parsed = X.parse_training_mcq(sourced).select(
        F.concat_ws("-", "prompt_id", F.substring("question", 1, 20)).alias("id"),
        "question", "options", "correct_index", "explanation", "difficulty",
        F.col("prompt_id").alias("source_chunk_id"), F.col("source").alias("source_document"))
    unique = materialize(R.dedup_questions(parsed), "examples")
    split = R.train_valid_split(unique, ratio, seed)
    return R.format_chatml(split).select("id", "split", "text")
