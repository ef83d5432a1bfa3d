"""A training corpus from documents: clean, distinct, mixed and encoded.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  Its working tables
lie in the folder of the ``scratch`` it is given, which is dropped once its result is written; without
one a stage takes a folder of its own, whose retention is the cluster's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, mixing, ngram_join, pieces, toxicity
from lectern.sources.tables import Scratch, read_table

#: Rows per partition of the result.
PART_ROWS = 4_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs, scratch or Scratch(spark, "stage-exact"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group that five-word shingles tie together at 0.8 or more."""
    joined = ngram_join.ngram_join(docs, threshold=0.8, n=5, scratch=scratch or Scratch(spark, "stage-near"))
    return joined.filter("kept").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """All documents, written in the order in which the sources are to be read."""
    return mixing.in_order(mixing.mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Token ids and the text they decode to, as counts and digests per document, in the order of the mix.

    ``docs`` is read from the files of the mix; its splits come in any order, so the place of a row is taken
    from its file and its number in there.  The k-th partition holds the k-th stretch of rows, sorted.
    """
    scratch = scratch or Scratch(spark, "stage-encode")
    name, row = F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    placed = docs.select("text", F.struct("doc_id", name, row).alias("at"))
    held = scratch.keep(placed.groupBy(F.col("at.file").alias("file")).agg(F.count("*").alias("n")), "files")
    # one row per file of 64 MB; files come in the order of their partitions' numbers
    number = F.coalesce(F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    ahead = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    total = held.agg(F.sum("n")).first()[0] or 0
    told = pieces.piece_digests(pieces.encode_pieces(placed, pieces.tokenizer_file("piece_bpe_32k.model"), id_col="at"))
    at = told.join(before, told["doc_id.file"] == before["file"]).withColumn("at", F.col("before") + F.col("doc_id.row"))
    parts = max(1, -(-total // PART_ROWS))
    dealt = at.repartitionById(parts, F.expr(f"cast(at div {PART_ROWS} as int)")).sortWithinPartitions("at")
    return dealt.select("doc_id.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot express the classifier, the schedule and the tokenizer; tests hold the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        own = Scratch(spark, "stage-" + name.split()[0])
        docs = scratch.keep(stage(spark, docs, sf_dir, own), f"stage-{i}")
        own.drop()
        if i:
            scratch.forget(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
