"""Training sets: difficulty, dedup, splits, chat formats, checks and training logs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.sources.tables import materialize


def assign_difficulty(chunks: DataFrame, seed: str, key: str = "id") -> DataFrame:
    """Repeatable random difficulty per chunk."""
    levels = F.array(*[F.lit(d) for d in K.DIFFICULTIES])
    return chunks.withColumn(
        "difficulty", F.get(levels, T.seeded_bucket(seed, F.col(key), len(K.DIFFICULTIES))))


def normalized_question(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(question), r"\s+", " "))


def dedup_questions(examples: DataFrame, key: str = "id") -> DataFrame:
    """First example by ``key`` of every normalised question.

    Groups are formed on two hashes of the text and their smallest key is found map-side; whole
    rows are fetched for those keys alone.  ``key`` tells the examples apart.
    """
    norm = normalized_question(F.col("question"))
    hashed = examples.withColumns({"_a": F.xxhash64(norm), "_b": F.xxhash64(F.lit(1), norm)})
    first = hashed.groupBy("_a", "_b").agg(F.min(key).alias(key))
    return hashed.join(first, ["_a", "_b", key], "left_semi").drop("_a", "_b")


def _order_cut(df: DataFrame, seed: str, key: str, size: Callable[[int], int]) -> DataFrame:
    """Rows of the ``size(n)`` smallest (hash, key) pairs flagged ``_head``, exactly, without
    a global rank: the boundary is found by counting hash prefixes of the written keys."""
    h = T.seeded_hash(seed, F.col(key))
    hashed = df.withColumn("_h", h)
    keys = materialize(hashed.select("_h", key), "order")
    size = size(keys.count())
    if size <= 0:
        return hashed.withColumn("_head", F.lit(False))
    prefix = F.substring("_h", 1, 4)
    counts = keys.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("p"))
    # at most 65,536 prefixes, whatever the number of rows
    edge = counts.withColumn("upto", upto).filter(F.col("upto") >= size).orderBy("p").first()
    if edge is None:
        return hashed.withColumn("_head", F.lit(True))
    before = edge["upto"] - edge["n"]
    inside = keys.filter(prefix == edge["p"])
    last = inside.orderBy("_h", key).limit(size - before).agg(
        F.max(F.struct("_h", key)).alias("m")).first()["m"]
    at = F.struct(F.col("_h"), F.col(key))
    return hashed.withColumn("_head", at <= F.struct(
        F.lit(last[0]), F.lit(last[1]).cast(df.schema[key].dataType)))


def train_valid_split(
    examples: DataFrame, ratio: float = 0.8, seed: str = "split", key: str = "id"
) -> DataFrame:
    """Add ``split``: the first int(n * ratio) rows in seeded order are ``train``."""
    cut = _order_cut(examples, seed, key, lambda n: int(n * ratio))
    return cut.withColumn("split", F.when(F.col("_head"), "train").otherwise("valid")).drop("_h", "_head")


def valid_first_split(
    examples: DataFrame, ratio: float = 0.1, seed: str = "split", key: str = "id"
) -> DataFrame:
    """Add ``split``: the first max(1, int(n * ratio)) rows in seeded order are ``valid``."""
    cut = _order_cut(examples, seed, key, lambda n: max(1, int(n * ratio)))
    return cut.withColumn("split", F.when(F.col("_head"), "valid").otherwise("train")).drop("_h", "_head")


def json_escape(text: Column) -> Column:
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(out))
    return text


def answer_json(question: Column, options: Column, correct_index: Column, explanation: Column) -> Column:
    """The answer a model should give.  Options are escaped like the other fields."""
    listed = F.array_join(F.transform(
        options, lambda o: F.concat(F.lit('"'), json_escape(o), F.lit('"'))), ", ")
    return F.concat(
        F.lit('{"question": "'), json_escape(question), F.lit('", "options": ['), listed,
        F.lit('], "correctIndex": '), correct_index.cast("string"), F.lit(', "explanation": "'),
        json_escape(explanation), F.lit('"}'),
    )


def _answer() -> Column:
    return answer_json(*[F.col(c) for c in ("question", "options", "correct_index", "explanation")])


def format_chatml(examples: DataFrame) -> DataFrame:
    """Add ``text`` in the im_start/im_end chat format."""
    head, tail = K.CHATML_USER.split("{difficulty}")
    user = F.concat(F.lit(head), F.lower("difficulty"), F.lit(tail))
    return examples.withColumn("text", F.concat(
        F.lit("<|im_start|>system\n" + K.CHATML_SYSTEM + "<|im_end|>\n<|im_start|>user\n"), user,
        F.lit("<|im_end|>\n<|im_start|>assistant\n"), _answer(), F.lit("<|im_end|>"),
    ))


def format_role_tags(questions: DataFrame) -> DataFrame:
    """Add ``line`` in the role-tag format; needs source and chunk_text (see ``attach_chunk``)."""
    user = F.concat(
        F.lit(K.ROLE_TAG_ASK + "\n\nSource: "), F.col("source"),
        F.lit("\nPassage:\n"), F.substring("chunk_text", 1, K.TRAINING_TEXT_CHARS),
        F.lit("\n\n" + K.ROLE_TAG_REPLY),
    )
    return questions.withColumn("line", F.concat(
        F.lit("<|system|>\n" + K.ROLE_TAG_SYSTEM + "<|end|>\n<|user|>\n"), user,
        F.lit("<|end|>\n<|assistant|>\n"), _answer(), F.lit("<|end|>"),
    ))


def attach_chunk(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the text of the first chunk (doc_id, chunk_idx) of the question's source.

    Questions without one are dropped.  The first chunks are found by their numbers alone and
    written; only their texts are then fetched, so no text is sorted or gathered per source.
    """
    first = chunks.groupBy("source").agg(F.min(F.struct("doc_id", "chunk_idx")).alias("m"))
    first = materialize(first.select("source", "m.doc_id", "m.chunk_idx"), "first-chunks")
    texts = chunks.join(first, ["source", "doc_id", "chunk_idx"]).select(
        "source", F.col("text").alias("chunk_text"))
    return questions.join(texts, "source")


def line_is_valid(line: Column) -> Column:
    text = F.get_json_object(line, "$.text")
    marked = F.contains(text, F.lit("<|assistant|>")) & F.contains(text, F.lit("<|end|>"))
    return F.coalesce(F.try_parse_json(line).isNotNull() & marked, F.lit(False))


def check_jsonl(lines: DataFrame, col: str = "value") -> DataFrame:
    """Counts of usable and unusable training lines; empty lines do not count."""
    full = lines.filter(F.col(col) != "").select(line_is_valid(F.col(col)).alias("ok"))
    return full.agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


def generation_summary(examples: DataFrame) -> DataFrame:
    """Generated, kept and duplicate counts with the success percentage."""
    norm = normalized_question(F.col("question"))
    per_question = examples.groupBy(F.sha2(norm, 256).alias("n")).agg(F.count("*").alias("c"))
    total = per_question.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("generated"), F.count("*").alias("kept"))
    return total.select(
        "generated", "kept", (F.col("generated") - F.col("kept")).alias("duplicates"),
        (T.ratio(F.col("kept"), F.col("generated")) * 100).alias("success_rate"))


def union_difficulties(sets: dict[str, DataFrame]) -> DataFrame:
    """One table of the question sets made per difficulty."""
    return reduce(
        lambda a, b: a.unionByName(b),
        [df.withColumn("difficulty", F.lit(d)) for d, df in sets.items()])


def parse_training_log(lines: DataFrame, col: str = "line") -> DataFrame:
    """Add iteration, train_loss and valid_loss read from report lines."""
    text = F.col(col)
    def number(pattern, kind):
        return F.regexp_extract(text, pattern, 1).try_cast(kind)
    return lines.withColumns({
        "iteration": F.coalesce(number(r"Iteration ([^:]*):", "int"), F.lit(0)),
        "train_loss": F.coalesce(number(r"training loss ([^,]*),", "double"), F.lit(0.0)),
        "valid_loss": number(r"validation loss (.*?), validation time", "double"),
    })


def percent_complete(done: Column, total: Column) -> Column:
    return F.when(total > 0, T.ratio(done, total) * 100).otherwise(0.0)


def training_progress(log: DataFrame) -> DataFrame:
    """Add ``percent_complete`` to (iteration, total_iterations) rows."""
    return log.withColumn(
        "percent_complete", percent_complete(F.col("iteration"), F.col("total_iterations")))
