"""Ranking: BM25, vector and hybrid search over many queries at once.

Queries come as (query_id, query[, embedding]); results are (query_id, doc_id, score, rank).
Ties are broken by doc_id on scores rounded to nine digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators import vectors as V
from lectern.operators.filters import drop_zero_scores
from lectern.operators.index import TextIndex, term_bucket
from lectern.operators.metadata import term_counts
from lectern.operators.segments import SegmentedIndex
from lectern.sources.tables import materialize


def top_k(scored: DataFrame, k: int, by: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """Best ``k`` rows per group.  Each task cuts its own groups to k before the exchange."""
    w = Window.partitionBy(by).orderBy(F.round("score", V.DIGITS).desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf); a repeated query term counts repeatedly."""
    counted = queries.select("query_id", F.inline(term_counts(T.tokens(F.col("query")))))
    return counted.withColumnRenamed("tf", "qtf")


def weighted_terms(queries: DataFrame, index: TextIndex | SegmentedIndex) -> DataFrame:
    """(query_id, term, weight): how often a query has the term times the term's rarity; unknown terms go."""
    n, df = index.stats.select("n").scalar(), F.col("df").cast("double")
    return query_terms(queries).join(index.terms.filter("df > 0"), "term").select(
        "query_id", "term",
        (F.col("qtf") * F.log((n - df + 0.5) / (df + 0.5) + 1)).alias("weight"),
    )


def bm25(
    queries: DataFrame, index: TextIndex | SegmentedIndex, k1: float = K.BM25_K1, b: float = K.BM25_B
) -> DataFrame:
    """(query_id, doc_id, score) of the documents sharing a term with the query.

    All other documents score 0.  A segmented index is scored inside its shards, without an exchange,
    unless the queries are too many to be sent there.  Else the weighted query terms are written first: their file size is
    known then, so the planner broadcasts them within its threshold, leaving the postings where
    they are.  A larger set is sort-merged, with hot terms split by
    adaptive skew handling.
    """
    avgdl = index.stats.select("avgdl").scalar()
    weighted = weighted_terms(queries, index)
    if isinstance(index, SegmentedIndex):
        weighted = materialize(weighted, "query-terms")
        floors = weighted.select("query_id", F.lit(0.0).alias("floor")).distinct()
        scored = index.search(weighted, 0, V.DIGITS, floors=floors, k1=k1, b=b)
        if scored is not None:
            return scored
    keys = ["term"]
    if index.buckets:
        weighted = weighted.withColumn("bucket", term_bucket(F.col("term"), index.buckets))
        keys = ["bucket", "term"]
    weighted = materialize(weighted, "query-terms")
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    impact = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    hits = index.postings.join(weighted, keys)
    return hits.groupBy("query_id", "doc_id").agg(F.sum(impact).alias("score"))


def keyword_search(queries: DataFrame, index: TextIndex | SegmentedIndex, k: int = 10, lexical=None) -> DataFrame:
    """BM25 top ``k`` with a positive score; an empty query finds nothing.

    A segmented index is searched inside its shards, unless the queries are too many to be sent there.
    ``lexical``, the ``lexical_scores`` of these queries for the same ``k``, saves the search.
    """
    if lexical is not None:
        return lexical.found_best(k)
    if isinstance(index, SegmentedIndex):
        found = index.search(materialize(weighted_terms(queries, index), "query-terms"), k, V.DIGITS)
        if found is not None:
            return top_k(found, k)
    return top_k(drop_zero_scores(bm25(queries, index)), k)


def knn(queries: DataFrame, corpus: DataFrame, k: int, **sizes) -> DataFrame:
    """Exact nearest neighbours by cosine."""
    return top_k(V.best_candidates(queries, corpus, k, ranged=False, **sizes), k)


def minmax_normalize(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """Add ``norm`` = (x - min) / (max - min) per group, 0.5 where the range is zero.

    Bounds are aggregated and joined back, so one hot group is not gathered in one task.
    """
    bounds = scored.groupBy(by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    return scored.join(bounds, by).withColumn(
        "norm", _scaled(F.col("score"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def max_normalize(scored: DataFrame, by: str = "query_id", floor: float = 0.001) -> DataFrame:
    """Add ``norm`` = x / max(largest score, floor) per group."""
    bounds = scored.groupBy(by).agg(F.max("score").alias("_hi"))
    return scored.join(bounds, by).withColumn(
        "norm", F.col("score") / F.greatest(F.col("_hi"), F.lit(floor))).drop("_hi")


def _scaled(x, lo, hi):
    return T.ratio(x - lo, hi - lo, 0.5)


class _JoinedScores:
    """Lexical scores of all queries from postings joined with their terms, written once."""

    def __init__(self, queries: DataFrame, index):
        self.table, self.index = materialize(bm25(queries, index), "bm25"), index  # read four times

    def survey(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, hi_b, lo_b) over all documents, and the scores of ``wanted`` pairs that have one."""
        n = self.index.stats.select("n").scalar()
        ranges = self.table.groupBy("query_id").agg(
            F.max("score").alias("hi_b"),
            F.when(F.count("*") < n, F.lit(0.0)).otherwise(F.min("score")).alias("lo_b"))
        return ranges, self.table.join(wanted, ["query_id", "doc_id"], "left_semi")

    def best(self, k: int) -> DataFrame:
        return top_k(self.table, k)

    def found_best(self, k: int) -> DataFrame:
        return top_k(drop_zero_scores(self.table), k)

    def reaching(self, floors: DataFrame) -> DataFrame:
        """Scores of at least the floor of their query, for the queries in ``floors`` (query_id, floor)."""
        return self.table.join(floors, "query_id").filter("score >= floor").drop("floor")


class _ShardScores:
    """The same from the shards of a segmented index: nothing is written per query and document."""

    def __init__(self, weighted: DataFrame, index: SegmentedIndex, k: int):
        self.weighted, self.index = weighted, index
        self.found = materialize(index.search(weighted, k, V.DIGITS), "lexical-found")

    def survey(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        told = materialize(self.index.survey(self.weighted, wanted), "survey")
        n = self.index.stats.select("n").scalar()
        low = told.filter("matched is not null").groupBy("query_id").agg(
            F.when(F.sum("matched") == n, F.min("score")).alias("low"))
        ranges = self.found.groupBy("query_id").agg(F.max("score").alias("hi_b")).join(low, "query_id", "left").select(
            "query_id", "hi_b", F.coalesce("low", F.lit(0.0)).alias("lo_b"))
        return ranges, told.filter("matched is null").select("query_id", "doc_id", "score")

    def best(self, k: int) -> DataFrame:
        return top_k(self.found, k)

    found_best = best  # a shard tells of scores above zero only

    def reaching(self, floors: DataFrame) -> DataFrame:
        return self.index.search(self.weighted, 0, V.DIGITS, floors=floors)


def lexical_scores(queries: DataFrame, index: TextIndex | SegmentedIndex, k: int):
    """What ``keyword_search`` and ``hybrid_search`` need of the index for the best ``k``; both can share it."""
    if isinstance(index, SegmentedIndex):
        weighted = materialize(weighted_terms(queries, index), "query-terms")
        if index.passes(weighted):
            return _ShardScores(weighted, index, k)
    return _JoinedScores(queries, index)


def hybrid_search(
    queries: DataFrame, index: TextIndex | SegmentedIndex, corpus: DataFrame | None = None,
    k: int = 5, weight: float = K.EMBEDDING_WEIGHT, use_hybrid: bool = True, lexical=None,
) -> DataFrame:
    """(1 - weight) * min-max BM25 + weight * min-max cosine, over all documents.

    A document without a vector has cosine 0; with no vectors at all that part is
    0.5.  Min-max ranges cover every document, but only candidates are scored:
    the best k of either side, then every lexical match that could still reach the k-th
    candidate given the best cosine left.  The result equals scoring all pairs.
    ``lexical``, the ``lexical_scores`` of these queries for the same ``k``, saves a search.
    """
    columns = [c for c in ("query_id", "query", "embedding") if c in queries.columns]
    queries = materialize(queries.select(*columns), "queries")
    lexical = lexical or lexical_scores(queries, index, k)
    use_vectors = use_hybrid and corpus is not None and "embedding" in queries.columns
    ids = index.lengths.select("doc_id")
    # with equal scores the smallest ids win, so they are candidates for every query
    fillers = {r[0] for r in ids.orderBy("doc_id").limit(k).collect()}  # k ids
    per_query = queries.select("query_id")
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("query_id", queries), ("doc_id", ids))]
    wanted = queries.sparkSession.createDataFrame([], ", ".join(kinds))

    if use_vectors:
        corpus = corpus.select("doc_id", "embedding").join(ids, "doc_id", "left_semi")
        missing = ids.join(corpus.select("doc_id"), "doc_id", "left_anti")
        first_missing = [r[0] for r in missing.orderBy("doc_id").limit(k).collect()]
        fillers |= set(first_missing)
        dense = materialize(V.best_candidates(queries, corpus, k), "dense")
        at_zero = F.lit(0.0) if first_missing else F.lit(None).cast("double")
        dense_ranges = dense.groupBy("query_id").agg(
            F.least(F.min("lo"), at_zero).alias("lo_e"),
            F.greatest(F.max("hi"), at_zero).alias("hi_e"),
        )
        best = top_k(dense.select("query_id", "doc_id", "score"), k)
        kth = best.groupBy("query_id").agg(
            F.greatest(F.min("score"), at_zero).alias("kth_e"))
        per_query = per_query.join(dense_ranges, "query_id", "left").join(kth, "query_id", "left")
        wanted = best.select("query_id", "doc_id")
    else:
        per_query = per_query.select("*", *[
            F.lit(0.0).alias(c) for c in ("lo_e", "hi_e", "kth_e")])
    if fillers:
        wanted = wanted.unionByName(queries.select(
            "query_id", F.explode(F.array(*[F.lit(i) for i in sorted(fillers)])).alias("doc_id")))
    wanted = materialize(wanted.distinct(), "wanted")
    ranges, held = lexical.survey(wanted)
    per_query = per_query.join(ranges, "query_id", "left").fillna(
        0.0, ["hi_b", "lo_b", "lo_e", "hi_e", "kth_e"])
    if use_vectors:  # read three times below
        per_query = materialize(per_query, "ranges")

    norm_b = _scaled(F.coalesce("score", F.lit(0.0)), F.col("lo_b"), F.col("hi_b"))
    norm_e = _scaled(F.col("similarity"), F.col("lo_e"), F.col("hi_e"))

    def scored(pairs: DataFrame) -> DataFrame:
        if use_vectors:
            pairs = V.pair_similarity(pairs, queries, corpus)
        else:
            pairs = pairs.withColumn("similarity", F.lit(0.0))
        return pairs.join(per_query, "query_id").select(
            "query_id", "doc_id", ((1 - weight) * norm_b + weight * norm_e).alias("score"))

    top = materialize(lexical.best(k).select("query_id", "doc_id", "score"), "lexical-best")
    if not use_vectors:
        # the blend rises with BM25 alone: its best k, and what rounds to the same, suffice
        floors = top.groupBy("query_id").agg((F.min("score") - 1e-6).alias("floor"))
        top = lexical.reaching(floors)
    given = wanted.join(held, ["query_id", "doc_id"], "left")
    seeds = given.unionByName(top.join(wanted, ["query_id", "doc_id"], "left_anti"))
    if not use_vectors:
        return top_k(scored(seeds), k)
    # pairs are written before they are scored, so the planner knows how few they are
    seeds = materialize(seeds, "seed-pairs")
    first = materialize(scored(seeds), "seeds")
    bar = top_k(first, k).groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score")).alias("bar"))
    # the lexical score from which on the blend can reach the bar; a margin for rounding
    rest_e = weight * _scaled(F.col("kth_e"), F.col("lo_e"), F.col("hi_e"))
    short = F.col("bar") - 1e-9 - rest_e
    flat = (F.col("hi_b") == F.col("lo_b")) | F.lit(weight >= 1)
    needed = F.col("lo_b") + (F.col("hi_b") - F.col("lo_b")) * short / (1 - weight if weight < 1 else 1) - 1e-9
    always = F.coalesce(short <= (1 - weight) * 0.5, F.lit(True)) if weight < 1 else F.coalesce(short <= 0, F.lit(True))
    floors = per_query.join(bar, "query_id", "left").filter(~flat | always).select(
        "query_id", F.when(flat | F.col("bar").isNull(), 0.0).otherwise(needed).alias("floor")
    ).filter(F.col("floor") <= F.lit(1e300))
    rest = materialize(lexical.reaching(floors).join(
        first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"), "rest-pairs")
    return top_k(first.unionByName(scored(rest)), k)


def pairwise_similarity(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Cosine of given (left_id, right_id) pairs: two equi-joins."""
    a = corpus.select(F.col("doc_id").alias("left_id"), F.col("embedding").alias("_a"))
    b = corpus.select(F.col("doc_id").alias("right_id"), F.col("embedding").alias("_b"))
    return pairs.join(a, "left_id").join(b, "right_id").select(
        *pairs.columns, V.cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def term_overlap(query, text):
    """Share of the query's words found among the text's words; repeats count."""
    q, d = T.words(F.lower(query)), T.words(F.lower(text))
    return T.ratio(F.size(F.filter(q, lambda t: F.array_contains(d, t))), F.size(q))


def eval_retrieval(labeled: DataFrame, results: DataFrame) -> DataFrame:
    """Share of queries whose first result is the expected one, per method.

    ``labeled`` is (query_id, expected_id); ``results`` (method, query_id, doc_id, rank).
    """
    first = results.filter(F.col("rank") == 1).select("method", "query_id", "doc_id")
    hit = F.coalesce((F.col("doc_id") == F.col("expected_id")).cast("int"), F.lit(0))
    methods = results.select("method").distinct()
    asked = labeled.agg(F.count("*").alias("queries"))
    hits = labeled.join(first, "query_id").groupBy("method").agg(F.sum(hit).alias("hits"))
    return methods.join(hits, "method", "left").select(
        "method", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        asked.scalar().alias("queries"),
    ).withColumn("hit_rate", T.ratio(F.col("hits"), F.col("queries")))
