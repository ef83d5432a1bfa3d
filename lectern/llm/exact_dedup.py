"""Exact deduplication by a tree of merged digest runs.

Every input partition is one run of digests.  A level merges ``fan_in`` neighbouring runs: the
sorted entries of one digest meet and the best row and the count remain.  After the last level
one entry per digest is left; it then travels back down the same tree.  No key ever meets more than
``fan_in`` entries in a level, so a group of copies of any size costs a task no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import Scratch

#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
#: Equal texts agree in all three, so a collision of the digest alone merges nothing.
KEY = ["sha", "length", "check"]


def without_blanks(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document: digest key, run, and the order in which copies are preferred."""
    bare = docs.select(
        F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
        without_blanks(F.col(text_col)).alias("bare"))
    return bare.select(
        F.unhex(F.sha2("bare", 256)).alias("sha"), F.octet_length("bare").alias("length"),
        F.xxhash64("bare").alias("check"), F.spark_partition_id().alias("run"),
        F.struct(
            (-F.col("points")).alias("points"), F.col("id").isNull().alias("unnamed"), "id",
            F.monotonically_increasing_id().alias("row")).alias("best"))


def _merged(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*KEY, "run").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ``BLANKS``; the row with most code points in
    the original text stays, then the smallest id, then the first row read.  A null text counts as
    empty, so null and blank texts form one group.  A null id loses against any other; of
    repeated rows with one id exactly one is kept.  Other columns are not read, whatever their
    names.  An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact-dedup")
    rows = scratch.keep(digests(docs, id_col, text_col), "rows")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    levels = [scratch.keep(_merged(rows.withColumn("n", F.lit(1))), "level-0")]
    while runs > 1:
        runs = -(-runs // fan_in)
        wider = levels[-1].withColumn("run", F.expr(f"run div {fan_in}").cast("int"))
        levels.append(scratch.keep(_merged(wider), f"level-{len(levels)}"))

    won = levels.pop().select(*KEY, "run", F.col("best").alias("winner"), F.col("n").alias("size"))
    while levels:
        lower = levels.pop().select(
            *KEY, F.col("run").alias("own"), F.expr(f"run div {fan_in}").cast("int").alias("run"))
        won = lower.join(won, [*KEY, "run"]).select(
            *KEY, F.col("own").alias("run"), "winner", "size")
    return rows.join(won, [*KEY, "run"]).select(
        F.col("best.id").alias("doc_id"), F.col("winner.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("best.row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that ``exact_dedup`` keeps, with all their columns."""
    scratch = scratch or Scratch(docs.sparkSession, "drop-copies")
    numbered = scratch.keep(docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")), "numbered")
    told = exact_dedup(numbered.select(
        F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), "doc.doc_id", "row").alias("doc_id"),
        F.col("doc.text").alias("text")), scratch=scratch)
    gone = told.filter(~F.col("kept")).select("doc_id.row")
    return numbered.join(gone, "row", "left_anti").select("doc.*")
