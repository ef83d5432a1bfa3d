"""The lexical index: postings, term frequencies and corpus statistics, written once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.metadata import term_counts
from lectern.sources.tables import checkpoint_folder

#: Postings per partition folder; their number follows from the corpus and is stored with the index.
BUCKET_ROWS = 2_000_000


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def document_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, dl, terms) with the term counts of each document; no shuffle."""
    counted = docs.select("doc_id", term_counts(T.tokens(F.col(text))).alias("terms"))
    return counted.select(
        "doc_id",
        F.aggregate("terms", F.lit(0), lambda a, x: a + x["tf"]).alias("dl"), "terms",
    )


def postings_of(doc_terms: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl), one row per term and document."""
    return doc_terms.select("doc_id", "dl", F.inline("terms")).select("term", "doc_id", "tf", "dl")


def term_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(doc_terms: DataFrame) -> DataFrame:
    """One row: number of documents and average length in tokens."""
    n = F.count("*")
    return doc_terms.agg(
        n.alias("n"),
        (F.coalesce(F.sum("dl"), F.lit(0)) / F.greatest(n, F.lit(1))).alias("avgdl"),
    )


def read_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Written postings; the schema is given, so an empty corpus reads as an empty table."""
    doc_id = spark.read.parquet(f"{folder}/doc_terms").schema["doc_id"].dataType.simpleString()
    schema = f"term string, doc_id {doc_id}, tf int, dl int, bucket int"
    return spark.read.schema(schema).parquet(f"{folder}/postings")


@dataclass(frozen=True)
class TextIndex:
    """Tables of a written index.  ``buckets`` is 0 when the postings are not bucketed."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame
    buckets: int = 0

    @staticmethod
    def build(docs: DataFrame, folder: str | None = None, buckets: int | None = None) -> TextIndex:
        """Tokenize once, write the tables under ``folder`` and read them back.

        Postings are range-partitioned by (bucket, term, doc_id): a term held by
        a large share of the documents spreads over several tasks and files.
        """
        spark = docs.sparkSession
        folder = folder or f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
        document_terms(docs).write.mode("overwrite").parquet(f"{folder}/doc_terms")
        doc_terms = spark.read.parquet(f"{folder}/doc_terms")
        if buckets is None:
            held = doc_terms.agg(F.sum(F.size("terms"))).first()[0]
            buckets = max(1, -(-(held or 0) // BUCKET_ROWS))
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/layout")
        (
            postings_of(doc_terms).withColumn("bucket", term_bucket(F.col("term"), buckets))
            .repartitionByRange("bucket", "term", "doc_id")
            .sortWithinPartitions("bucket", "term", "doc_id")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        )
        corpus_stats(doc_terms.select("dl")).write.mode("overwrite").parquet(f"{folder}/stats")
        term_frequencies(read_postings(spark, folder)).write.mode("overwrite").parquet(f"{folder}/terms")
        return TextIndex.load(spark, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> TextIndex:
        buckets = spark.read.parquet(f"{folder}/layout").first()["buckets"]
        doc_terms = spark.read.parquet(f"{folder}/doc_terms")
        return TextIndex(
            read_postings(spark, folder), spark.read.parquet(f"{folder}/terms"),
            doc_terms.select("doc_id", "dl"), spark.read.parquet(f"{folder}/stats"), buckets,
        )

    @staticmethod
    def of(doc_terms: DataFrame) -> TextIndex:
        """The same tables as lazy plans, nothing written (small or one-off inputs)."""
        postings = postings_of(doc_terms)
        return TextIndex(
            postings, term_frequencies(postings), doc_terms.select("doc_id", "dl"),
            corpus_stats(doc_terms),
        )

    def without(self, removed: DataFrame) -> TextIndex:
        """The index after deleting the documents in ``removed`` (doc_id)."""
        gone = removed.select("doc_id").distinct()
        postings = self.postings.join(gone, "doc_id", "left_anti")
        lengths = self.lengths.join(gone, "doc_id", "left_anti")
        return TextIndex(
            postings, term_frequencies(postings), lengths, corpus_stats(lengths), self.buckets
        )
