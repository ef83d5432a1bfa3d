"""Around the model call: sampling, prompts, the batch hook, histories and throughput."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import prompts as P
from lectern.functions import text as T
from lectern.operators.ranking import ranked
from lectern.sources.tables import materialize

GENERATION_SCHEMA = "prompt_id string, attempt int, seq int, raw string"


def sample_chunks(chunks: DataFrame, n: int, seed: str, key: str = "id") -> DataFrame:
    """Repeatable random sample of at most ``n`` rows with distinct keys, in the drawn order.

    The draw looks at keys alone; texts are fetched for the ``n`` keys drawn.
    """
    drawn = chunks.select(key).distinct().orderBy(T.seeded_hash(seed, F.col(key)), key).limit(n)
    picked = chunks.join(drawn, key, "left_semi")
    return picked.orderBy(T.seeded_hash(seed, F.col(key)), key).limit(n)


def gold_examples(spark: SparkSession) -> DataFrame:
    """The worked examples as a table, built in the JVM from literals."""
    names = ["difficulty", "text", "question", "options", "correct_index", "explanation"]
    rows = [
        F.struct(F.lit(i).alias("example_id"), *[
            (F.array(*[F.lit(o) for o in v]) if n == "options" else F.lit(v)).alias(n)
            for n, v in zip(names, row)])
        for i, row in enumerate(P.GOLD_EXAMPLES)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def few_shot_blocks(examples: DataFrame, n: int = 3, seed: str = "gold") -> DataFrame:
    """(difficulty, examples): ``n`` sampled examples per difficulty as one numbered block."""
    w = Window.partitionBy("difficulty").orderBy(
        T.seeded_hash(seed, F.col("example_id")), "example_id")
    picked = examples.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    options = F.concat(F.lit('["'), F.array_join("options", '", "'), F.lit('"]'))
    block = F.concat(
        F.lit("Sample "), F.col("rank").cast("string"), F.lit('\nPassage: "'), F.col("text"),
        F.lit('"\nReply: {"question": "'), F.col("question"), F.lit('", "options": '), options,
        F.lit(', "correctIndex": '), F.col("correct_index").cast("string"),
        F.lit(', "explanation": "'), F.col("explanation"), F.lit('"}\n'),
    )
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return picked.groupBy("difficulty").agg(F.concat(
        F.lit("Replies of the kind that is wanted:\n\n"),
        F.array_join(F.transform(parts, lambda p: p["block"]), "\n"),
        F.lit("\n" + P.DISTRACTOR_RULES + "\n"),
    ).alias("examples"))


def guide(difficulty: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in P.GUIDES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(difficulty)), F.lit(""))


def build_prompts(
    chunks: DataFrame, kind: str, difficulty: Column | None = None,
    examples: DataFrame | None = None, count: int = 5,
) -> DataFrame:
    """Add ``system`` and ``user`` to chunks (id, source, text) for one prompt kind.

    ``examples`` is the (difficulty, examples) table of ``few_shot_blocks``: a handful of
    rows, one per difficulty.  Passage length follows ``PASSAGE_CHARS``.
    """
    chunks = chunks.withColumn(
        "difficulty", difficulty if difficulty is not None else F.lit("medium"))
    if examples is not None:
        chunks = chunks.join(examples, "difficulty", "left")
    else:
        chunks = chunks.withColumn("examples", F.lit(""))
    limit = P.PASSAGE_CHARS[kind]
    passage = F.col("text") if limit is None else F.substring("text", 1, limit)
    return chunks.withColumns({
        "system": P.render(P.SYSTEM[kind], examples=F.coalesce("examples", F.lit(""))),
        "user": P.render(P.USER[kind], guide=guide(F.col("difficulty")), source=F.col("source"),
                         text=passage, count=str(count)),
    }).drop("examples")


def answer_prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """Prompts for (query_id, query) with the context string of each, when it has one."""
    given = queries.select("query_id", "query").join(
        contexts.select("query_id", "context"), "query_id", "left")
    intro = F.when(F.coalesce("context", F.lit("")) != "", P.render(
        P.ANSWER_CONTEXT, context=F.col("context"))).otherwise("")
    return given.select(
        F.col("query_id").cast("string").alias("prompt_id"), F.lit(P.ANSWER_SYSTEM).alias("system"),
        F.concat(intro, F.lit("\nQuestion: "), F.col("query")).alias("user"))


def generate(
    prompts: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
) -> DataFrame:
    """The one hook for a model: ``fn`` maps batches of (prompt_id, system, user) to
    (prompt_id, attempt, seq, raw)."""
    return prompts.select(
        F.col("prompt_id").cast("string"), "system", "user"
    ).mapInPandas(fn, GENERATION_SCHEMA)


LOG_SCHEMA = "digest string, attempt int, seq int, raw string"


def generate_once(prompts: DataFrame, fn: Callable, folder: str, wave: int = 0, parts: int = 1) -> DataFrame:
    """``generate`` through a log of replies under ``folder``: what it holds is not asked again.

    Replies are kept under a digest of the prompt's texts and ``wave``, so equal prompts are asked once, and a
    run that is repeated, or goes on after a failure, asks only for what is missing.  The log grows
    by one append per part; a part that fails leaves nothing.  A prompt without any reply is asked again by the
    next run.  One run writes to a log at a time.
    """
    spark = prompts.sparkSession
    whole = F.concat_ws("\u0000", F.lit(str(wave)), F.coalesce("system", F.lit("")), F.coalesce("user", F.lit("")))
    asked = materialize(prompts.select(
        F.col("prompt_id").cast("string"), "system", "user", F.sha2(whole, 256).alias("digest")), "prompts")
    spark.createDataFrame([], LOG_SCHEMA).write.mode("append").parquet(folder)  # a folder to read from
    for part in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("digest"), F.lit(parts)) == part).dropDuplicates(["digest"])
        held = spark.read.schema(LOG_SCHEMA).parquet(folder).select("digest").distinct()
        missing = materialize(mine.join(held, "digest", "left_anti"), "missing")
        if not missing.isEmpty():
            told = generate(missing.withColumn("prompt_id", F.col("digest")), fn)
            told.select(F.col("prompt_id").alias("digest"), "attempt", "seq", "raw").write.mode("append").parquet(folder)
    log = spark.read.schema(LOG_SCHEMA).parquet(folder)
    return asked.select("prompt_id", "digest").join(log, "digest").select("prompt_id", "attempt", "seq", "raw")


def mcq_preamble(questions: DataFrame) -> DataFrame:
    """Add ``system`` for a talk about an answered question.

    ``questions`` has question, options, correct_index, user_answer, explanation, source.
    """
    right = F.coalesce(F.col("user_answer") == F.col("correct_index"), F.lit(False))
    return questions.withColumn("system", P.render(
        P.MCQ_TUTOR, question=F.col("question"),
        given=F.coalesce(F.get("options", F.col("user_answer")), F.lit("none")),
        verdict=F.when(right, "CORRECT").otherwise("INCORRECT"),
        correct=F.get("options", F.col("correct_index")), explanation=F.col("explanation"),
        source=F.col("source"),
    ))


def open_preamble(questions: DataFrame) -> DataFrame:
    return questions.withColumn("system", P.render(
        P.OPEN_TUTOR, context=F.col("context"), question=F.col("question"),
        points=F.array_join("key_points", ", "),
    ))


def discussion_history(preambles: DataFrame, turns: DataFrame, asked: DataFrame) -> DataFrame:
    """Messages of every talk as rows (conv_id, pos, role, content).

    ``preambles`` (conv_id, system), ``turns`` (conv_id, turn, is_user, content) and the
    new user messages ``asked`` (conv_id, content).  Rows keep the order by ``pos``; no
    conversation is gathered into one value.
    """
    role = F.when(F.col("is_user"), "user").otherwise("assistant")
    system = preambles.select(
        "conv_id", F.lit(-1).cast("bigint").alias("at"), F.lit("system").alias("role"),
        F.col("system").alias("content"))
    past = turns.select("conv_id", F.col("turn").cast("bigint").alias("at"),
                        role.alias("role"), "content")
    new = asked.select("conv_id", F.lit(2**62).alias("at"), F.lit("user").alias("role"), "content")
    every = system.unionByName(past).unionByName(new)
    numbered = ranked(every, "conv_id", ["at"], F.floor(F.col("at") / 4096), "pos")
    return numbered.select("conv_id", (F.col("pos") - 1).alias("pos"), "role", "content")


def generation_throughput(log: DataFrame, by: str = "generation_id") -> DataFrame:
    """Tokens per second of each generation; 0 when no time has passed.

    ``log`` has (generation_id, tokens, elapsed); the furthest report counts.
    """
    return log.groupBy(by).agg(
        F.max("tokens").alias("tokens"), F.max("elapsed").alias("elapsed")
    ).withColumn("tokens_per_second", F.when(
        F.col("elapsed") > 0, T.ratio(F.col("tokens"), F.col("elapsed"))).otherwise(0.0))
