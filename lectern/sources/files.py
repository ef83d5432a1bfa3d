"""File sources and sinks: corpora, chunk tables, vector indexes, study sets, training lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.filters import contains_text, filter_sources

CHUNK_SCHEMA = (
    "doc_id bigint, chunk_idx int, id string, text string, source string, page int, section string, "
    "chapter string, start_index int, end_index int, sentence_count int, word_count int, "
    "preceding_context string, following_context string, key_terms array<string>"
)
INDEX_SCHEMA = "ids array<string>, texts array<string>, embeddings array<array<float>>"
QUESTION = (
    "struct<id:string,question:string,options:array<string>,correctIndex:int,source:string,"
    "explanation:string>"
)
QUIZ_SET_SCHEMA = f"id string, name string, difficulty string, questions array<{QUESTION}>, createdAt string"
CARD_SET_SCHEMA = (
    "id string, name string, cards array<struct<id:string,question:string,answer:string,"
    "source:string>>, createdAt string"
)
PROGRESS_SCHEMA = (
    "quizzesTaken int, totalScore int, totalQuestions int, flashcardsReviewed int, lastStudied string"
)
TEXT_EXTENSIONS = ("txt", "md")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def read_corpus(spark: SparkSession, path: str, extensions=TEXT_EXTENSIONS) -> DataFrame:
    """One row per text file: (doc_id, source, ext, text).  Other extensions are never opened.

    ``doc_id`` is a hash of the full path, so no numbering pass is needed.
    """
    pattern = "*.{" + ",".join(any_case(e) for e in extensions) + "}"
    raw = spark.read.text(
        path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    name = F.col("_metadata.file_name")
    return raw.select(
        F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), name.alias("source"),
        F.lower(F.substring_index(name, ".", -1)).alias("ext"), F.col("value").alias("text"))


def stream_corpus(spark: SparkSession, path: str, extensions=TEXT_EXTENSIONS) -> DataFrame:
    """The same rows for files as they arrive."""
    pattern = "*.{" + ",".join(any_case(e) for e in extensions) + "}"
    raw = spark.readStream.format("text").option("wholetext", "true").option(
        "pathGlobFilter", pattern).load(path)
    name = F.col("_metadata.file_name")
    return raw.select(
        F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), name.alias("source"),
        F.lower(F.substring_index(name, ".", -1)).alias("ext"), F.col("value").alias("text"))


def _read_json(spark: SparkSession, path: str, schema: str, whole: bool = True) -> DataFrame:
    """JSON with a fixed schema; a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=whole)


def write_chunks(chunks: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet is the table; ``json`` writes JSON lines for exchange."""
    chunks.write.mode("overwrite").format(form).save(path)


def read_chunks(spark: SparkSession, path: str, form: str = "parquet", whole: bool = False) -> DataFrame:
    """Chunk table; missing path gives an empty one.

    ``json`` reads JSON lines, or with ``whole`` files that hold one JSON array.
    """
    if form == "json":
        return _read_json(spark, path, CHUNK_SCHEMA, whole)
    if not exists(spark, path):
        return spark.createDataFrame([], CHUNK_SCHEMA)
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, text, embedding) of an index kept as three parallel arrays per object."""
    index = _read_json(spark, path, INDEX_SCHEMA, whole=False)
    return index.select(F.inline(F.arrays_zip("ids", "texts", "embeddings"))).toDF(
        "doc_id", "text", "embedding")


def read_quiz_sets(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    return _read_json(spark, path, QUIZ_SET_SCHEMA, whole)


def read_card_sets(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    return _read_json(spark, path, CARD_SET_SCHEMA, whole)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress counters; a missing file is one row of zeros."""
    if not exists(spark, path):
        return spark.createDataFrame([(0, 0, 0, 0, None)], PROGRESS_SCHEMA)
    return _read_json(spark, path, PROGRESS_SCHEMA)


def quiz_questions(quiz_sets: DataFrame) -> DataFrame:
    """One row per question of every set."""
    return quiz_sets.select(
        F.col("id").alias("quiz_id"), "name", "difficulty",
        F.to_timestamp("createdAt").alias("created_at"), F.inline("questions")
    ).withColumnsRenamed({"id": "question_id", "correctIndex": "correct_index"})


def set_cards(card_sets: DataFrame) -> DataFrame:
    return card_sets.select(
        F.col("id").alias("set_id"), "name", F.inline("cards")).withColumnRenamed("id", "card_id")


def read_training_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The ``text`` of every line that is an object with a string ``text``; others are dropped."""
    field = F.try_variant_get(F.try_parse_json("value"), "$.text", "variant")
    good = F.schema_of_variant(field) == "STRING"
    return spark.read.text(path).filter(good).select(
        F.get_json_object("value", "$.text").alias("text"))


def write_training_jsonl(examples: DataFrame, folder: str) -> None:
    """``train.jsonl`` and ``valid.jsonl`` folders from (split, text) rows."""
    for split in ("train", "valid"):
        examples.filter(F.col("split") == split).select(
            F.to_json(F.struct("text")).alias("value")
        ).write.mode("overwrite").text(f"{folder}/{split}.jsonl")


def export_chunks(chunks: DataFrame, path: str, source: str | None = None, contains: str = "") -> None:
    """Write the chunks of one source and/or holding a text as JSON lines."""
    view = contains_text(filter_sources(chunks, [source] if source else None), contains)
    view.write.mode("overwrite").json(path)


def save_examples(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").parquet(path)


def load_examples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def saved_count(spark: SparkSession, path: str) -> int:
    """Number of saved examples; 0 when none were saved (a footer-only count)."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0
