"""Feature-based reranking, query expansion and context assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators import retrieval as R
from lectern.operators.index import TextIndex
from lectern.operators.metadata import term_counts
from lectern.sources.tables import materialize


def bigrams(tokens: Column) -> Column:
    """Distinct adjacent pairs as ``a_b``."""
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit("_"), b),
    )
    return F.array_distinct(pairs)


def _edge_stripped_words(text: Column) -> Column:
    """Lower-cased words between spaces and tabs without edge punctuation, in one pass."""
    edge = r"(?<![^\p{Zs}\t])\p{P}+|\p{P}+(?![^\p{Zs}\t])"
    return F.split(F.regexp_replace(F.lower(text), edge, ""), T.SPACE_CHAR)


def rerank_features(query: Column, text: Column) -> Column:
    """struct of the six text features of a (query, text) pair."""

    def features(q, d, wanted):
        at = F.array_compact(F.transform(
            _edge_stripped_words(text), lambda w, i: F.when(F.array_contains(wanted, w), i)))
        counts = F.struct(
            F.size(F.array_intersect(wanted, d)).alias("shared"), F.size(wanted).alias("asked"),
            bigrams(q).alias("pairs"), at.alias("at"),
        )

        def assemble(c):
            hits, first = F.size(c["at"]), F.get(c["at"], F.lit(0))
            last = F.get(c["at"], hits - 1)
            return F.struct(
                T.ratio(c["shared"], F.greatest(c["asked"], F.lit(1))).alias("overlap"),
                T.ratio(F.size(F.array_intersect(c["pairs"], bigrams(d))),
                        F.greatest(F.size(c["pairs"]), F.lit(1))).alias("bigram"),
                F.when(hits >= 2, hits / (last - first + 1)).when(hits == 1, 0.5)
                .otherwise(0.0).alias("density"),
                T.ratio(c["shared"], c["asked"]).alias("coverage"),
                F.when(hits > 0, 1 / (1 + first / 50)).otherwise(0.0).alias("position"),
                (1 / (1 + F.size(d) / 500)).alias("length"),
            )

        return T.let(counts, assemble)

    return T.let(T.tokens(query), lambda q: T.let(T.tokens(text), lambda d: T.let(
        F.array_distinct(q), lambda wanted: features(q, d, wanted))))


def rerank_score(base: Column, features: Column) -> Column:
    total = base * K.RERANK_WEIGHTS["base"]
    for name, weight in K.RERANK_WEIGHTS.items():
        if name != "base":
            total = total + features[name] * weight
    return total


def rerank(results: DataFrame, k: int = 5) -> DataFrame:
    """Rescore (query_id, query, doc_id, text, score) rows and keep the best k per query.

    Few bytes but much work per row: the rows are spread over all cores, whatever their
    query, instead of following the small exchange that found them.
    """
    f = results.repartition("query_id", "doc_id").withColumn("_f", rerank_features(F.col("query"), F.col("text")))
    rescored = f.withColumn("score", rerank_score(F.col("score"), F.col("_f"))).drop("_f")
    return R.top_k(rescored.drop("rank"), k)


def _synonym_map(synonyms: dict[str, list[str]]) -> Column:
    pairs = [c for w, s in synonyms.items() for c in (F.lit(w), F.array(*[F.lit(x) for x in s]))]
    return F.create_map(*pairs)


def expand_query(query: Column, synonyms: dict[str, list[str]] = K.SYNONYMS) -> Column:
    """The query's words followed by the synonyms of each, in order."""
    table = _synonym_map(synonyms)

    def widen(found):
        extra = F.flatten(F.transform(found, lambda w: F.coalesce(
            F.try_element_at(table, w), F.array().cast("array<string>"))))
        return F.array_join(F.concat(found, extra), " ")

    return T.let(T.words(F.lower(query)), widen)


def query_variants(query: Column, synonyms: dict[str, list[str]] = K.SYNONYMS) -> Column:
    """The query, its expansion when different, and question forms unless it asks already."""
    expanded = expand_query(query, synonyms)
    asks = F.lower(query).rlike("^(" + "|".join(K.QUESTION_OPENERS) + ")")
    return F.array_compact(F.array(
        query, F.when(expanded != query, expanded),
        F.when(~asks, F.concat(F.lit("what is "), query)),
        F.when(~asks, F.concat(F.lit("how does "), query)),
    ))


def followup_queries(queries: DataFrame, contexts: DataFrame, terms: int = 3) -> DataFrame:
    """Add ``followup`` to (query_id, query): the query plus the most frequent new context terms.

    ``contexts`` is (query_id, context).
    """
    found = contexts.select(
        "query_id", F.inline(term_counts(T.tokens(F.col("context"), 4)))
    ).filter(~F.col("term").isin(K.FOLLOWUP_STOP_WORDS))
    asked = queries.select("query_id", F.explode(T.space_words(F.col("query"))).alias("term"))
    counted = found.groupBy("query_id", "term").agg(F.sum("tf").alias("score")).join(
        asked.distinct(), ["query_id", "term"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "term")
    best = counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= terms)
    tail = best.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "term"))).alias("t"))
    return queries.join(tail, "query_id", "left").select(
        *queries.columns,
        F.concat_ws(" ", "query", F.array_join(F.transform("t", lambda x: x["term"]), " "))
        .alias("followup"),
    )


def format_context(text: Column, section: Column, chapter: Column) -> Column:
    def label(c):
        return F.when(c.isNotNull(), F.concat(F.lit("["), c, F.lit("] "))).otherwise("")

    return F.concat(label(section), label(chapter), text)


def with_text(results: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Results with the text of their document and of their query.

    The results are written first: they are few and their size is known then, so the planner
    sends them to the chunks and does not shuffle the chunk texts.
    """
    results = materialize(results, "results")
    cols = [c for c in ("doc_id", "text", "source", "section", "chapter") if c in chunks.columns]
    return results.join(chunks.select(*cols), "doc_id").join(
        queries.select("query_id", "query"), "query_id")


def _labelled(df: DataFrame):
    def col(name):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    return format_context(F.col("text"), col("section"), col("chapter"))


def rag_context(
    queries: DataFrame, index: TextIndex, chunks: DataFrame,
    corpus: DataFrame | None = None, k: int = 5,
) -> DataFrame:
    """One context string per query: hybrid search for 2k, rerank to k, format, join."""
    found = R.hybrid_search(queries, index, corpus, 2 * k)
    ranked = rerank(with_text(found, chunks, queries), k)
    ranked = ranked.withColumn("context", _labelled(ranked))
    parts = F.array_sort(F.collect_list(F.struct("rank", "context")))
    return ranked.groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda p: p["context"]), "\n\n").alias("context"),
        F.count("*").alias("passages"),
    )


def multi_hop(
    queries: DataFrame, index: TextIndex, chunks: DataFrame, hops: int = 2, k: int = 5,
    corpus: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Iterated retrieval: (query_id, pos, doc_id, source, context).

    Hop 0 searches with the expanded query, later hops with the follow-up built
    from what was found; a query whose follow-up brings nothing new stops.  Queries left
    with fewer than k contexts are topped up from their variants to at most 2k.  The
    loop runs a fixed number of hops, each one a few joins for all queries together.

    With ``corpus`` (doc_id, embedding) every search is hybrid; ``embed`` then adds ``embedding`` to
    (query_id, query) rows, since later hops ask in words that no given vector belongs to.
    """
    if corpus is not None and embed is None:
        raise ValueError("a corpus of vectors needs embed, to give rewritten queries theirs")
    key = ["query_id", "source", "head"]
    current = queries.select("query_id", "query", F.col("query").alias("now"))
    found = None

    def search(asked: DataFrame, size: int) -> DataFrame:
        plain = asked.select("query_id", "query")
        hits = R.hybrid_search(plain if corpus is None else embed(plain), index, corpus, size)
        return with_text(hits, chunks, asked)

    def fresh(results: DataFrame, hop: int, seen: DataFrame | None) -> DataFrame:
        """New results in order; the first of a (source, opening) pair stays."""
        rows = results.withColumn("head", F.substring("text", 1, 50)).withColumn(
            "context", _labelled(results)).withColumn("hop", F.lit(hop))
        if seen is not None:
            rows = rows.join(seen.select(*key), key, "left_anti")
        w = Window.partitionBy(*key).orderBy("hop", "rank")
        return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
            "query_id", "hop", "rank", "doc_id", "source", "head", "context")

    for hop in range(hops):
        asked = current.select("query_id", F.col("now").alias("query"))
        wide = asked.withColumn("query", expand_query(F.col("query"))) if hop == 0 else asked
        hits = search(wide, 2 * k).drop("query").join(asked, "query_id")
        new = fresh(rerank(hits, k), hop, found)
        found = materialize(new if found is None else found.unionByName(new), "hop")
        if hop < hops - 1:
            nxt = followup_queries(queries, found.select("query_id", "context"))
            current = materialize(
                current.join(nxt.select("query_id", "followup"), "query_id")
                .filter(F.col("followup") != F.col("now"))
                .select("query_id", "query", F.col("followup").alias("now")), "followup")

    counts = found.groupBy("query_id").agg(F.count("*").alias("have"))
    variants = queries.join(counts, "query_id", "left").fillna(0, ["have"]).filter(
        F.col("have") < k
    ).select("query_id", F.posexplode(query_variants(F.col("query"))).alias("v", "query")).filter("v > 0")
    split_id = F.concat_ws(":", F.col("query_id").cast("string"), F.col("v").cast("string"))
    asked = materialize(variants.select(
        split_id.alias("query_id"), "query", F.col("query_id").alias("base"), "v"), "variants")
    extra = search(asked, k).join(asked.select("query_id", "base", "v"), "query_id").select(
        F.col("base").alias("query_id"), "doc_id", "text", "source",
        *[c for c in ("section", "chapter") if c in chunks.columns],
        (F.col("v") * (k + 1) + F.col("rank")).alias("rank"))  # in the order of (variant, rank): ranks end at k
    found = found.unionByName(fresh(extra, hops, found))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "rank"))
    return found.withColumn("pos", place).filter(
        (F.col("hop") < hops) | (F.col("pos") <= 2 * k)
    ).select("query_id", "pos", "hop", "doc_id", "source", "context")
