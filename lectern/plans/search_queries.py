"""Registered queries over retrieval: every benchmark text is a query, every document a passage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators import index as I
from lectern.operators import rerank as RR
from lectern.operators import retrieval as R
from lectern.operators import vectors as V
from lectern.operators.segments import SegmentedIndex
from lectern.plans import sqltext as q
from lectern.plans.document_queries import documents, passages, passages_sql
from lectern.plans.registry import query
from lectern.sources.tables import checkpoint_folder, materialize, read_table

_INDEXES: dict[tuple[str, str], SegmentedIndex] = {}


def build_index(spark: SparkSession, sf: str) -> SegmentedIndex:
    folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    return SegmentedIndex.build(documents(spark, sf).select("doc_id", "text"), folder)


def text_index(spark: SparkSession, sf: str) -> SegmentedIndex:
    """The documents' index, written once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(spark, sf)
    return _INDEXES[key]


def text_queries(spark, sf) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def corpus(spark, sf) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", "label")


def vector_queries(spark, sf) -> DataFrame:
    """The first vector of every label."""
    return corpus(spark, sf).groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.min_by("embedding", "doc_id").alias("embedding"))


def hybrid_queries(spark, sf) -> DataFrame:
    """Benchmark texts with the vector of the same number."""
    vec = corpus(spark, sf).select(F.col("doc_id").alias("query_id"), "embedding")
    return text_queries(spark, sf).join(vec, "query_id", "left")


TOK_SQL = f"""tok AS MATERIALIZED (SELECT doc_id, unnest({q.tokens('text')}) AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
dl AS MATERIALIZED (SELECT doc_id, len({q.tokens('text')}) AS dl FROM documents),
st AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, sum(dl) / greatest(count(*), 1) AS avgdl FROM dl),
df AS MATERIALIZED (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term)"""


def bm25_sql(asked: str, out: str = "bm") -> str:
    """CTE ``out`` (query_id, doc_id, score) for the queries in CTE ``asked`` (query_id, query)."""
    return f"""{out}_q AS (SELECT query_id, term, count(*) AS qtf FROM (
  SELECT query_id, unnest({q.tokens('query')}) AS term FROM {asked}) GROUP BY query_id, term),
{out} AS MATERIALIZED (SELECT query_id, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) *
  (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM {out}_q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY query_id, doc_id)"""


ASK_SQL = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)"


def scaled_sql(x: str) -> str:
    return (
        f"coalesce(({x} - min({x}) OVER (PARTITION BY query_id)) / nullif(max({x}) OVER (PARTITION BY query_id)"
        f" - min({x}) OVER (PARTITION BY query_id), 0), 0.5)")


def hybrid_sql(asked: str, out: str, k: int, vectors: bool, bm: str = "bm", vector_of: str = "a.query_id") -> str:
    """CTE ``out`` scoring every (query, document) pair of ``asked``; ``vector_of`` gives the query's vector."""
    emb = (
        "coalesce(round(list_inner_product(qe.embedding::DOUBLE[], de.embedding::DOUBLE[]), 9), 0)"
        if vectors else "0.0")
    joins = (
        f"LEFT JOIN embeddings qe ON qe.vec_id = {vector_of} LEFT JOIN embeddings de ON de.vec_id = d.doc_id"
        if vectors else "")
    return f"""{out}_raw AS (SELECT a.query_id, d.doc_id, coalesce(b.score, 0) AS b, {emb} AS e
  FROM {asked} a CROSS JOIN dl d LEFT JOIN {bm} b ON b.query_id = a.query_id AND b.doc_id = d.doc_id {joins}),
{out}_all AS (SELECT query_id, doc_id, 0.5 * {scaled_sql('b')} + 0.5 * {scaled_sql('e')} AS score FROM {out}_raw),
{out} AS MATERIALIZED (SELECT * FROM (SELECT *, {RANK} AS rank FROM {out}_all) WHERE rank <= {k})"""


# --- index -------------------------------------------------------------------

@query("tokenize", sql=f"""SELECT doc_id, len({q.tokens('text')}) AS n_tokens,
  array_to_string({q.tokens('text')}, ' ') AS tokens FROM documents""")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("build_postings", sql=f"WITH {TOK_SQL} SELECT term, doc_id, tf, dl FROM tf JOIN dl USING (doc_id)")
def _(spark, sf):
    return I.postings_of(I.document_terms(documents(spark, sf)))


@query("corpus_stats", sql=f"WITH {TOK_SQL} SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM st")
def _(spark, sf):
    stats = I.corpus_stats(I.document_terms(documents(spark, sf)))
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("term_frequencies", sql=f"WITH {TOK_SQL} SELECT term, df::BIGINT AS df FROM df")
def _(spark, sf):
    return text_index(spark, sf).terms


# --- lexical -----------------------------------------------------------------

@query("bm25", sql=f"""WITH {ASK_SQL}, {TOK_SQL}, {bm25_sql('asked')}
SELECT query_id, doc_id, round(score, 6) AS score FROM bm""")
def _(spark, sf):
    return R.bm25(text_queries(spark, sf), text_index(spark, sf)).select(
        "query_id", "doc_id", F.round("score", 6).alias("score"))


@query("keyword_search", sql=f"""WITH {ASK_SQL}, {TOK_SQL}, {bm25_sql('asked')}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, {RANK} AS rank FROM bm WHERE score > 0) WHERE rank <= 10""")
def _(spark, sf):
    return R.keyword_search(text_queries(spark, sf), text_index(spark, sf), 10).select(
        "query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("index_updates", sql=f"""WITH {ASK_SQL}, kept AS (SELECT * FROM documents WHERE doc_id % 7 <> 0),
{TOK_SQL.replace('FROM documents', 'FROM kept')}, {bm25_sql('asked')}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, {RANK} AS rank FROM bm WHERE score > 0) WHERE rank <= 5""")
def _(spark, sf):
    # every third document is indexed under another text first, then all arrive, some are deleted, segments merge
    docs = documents(spark, sf).select("doc_id", "text")
    folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    index = SegmentedIndex.build(docs.filter("doc_id % 3 = 0").select("doc_id", F.reverse("text").alias("text")), folder)
    index = index.append(docs, "all").delete(docs.filter("doc_id % 7 = 0"), "sevenths")
    index = index.merge(["s0", "all"], "merged")
    return R.keyword_search(text_queries(spark, sf), index, 5).withColumn("score", F.round("score", 6))


@query("minmax_normalize", sql=f"""WITH {ASK_SQL}, {TOK_SQL}, {bm25_sql('asked')}
SELECT query_id, doc_id, round({scaled_sql('score')}, 6) AS norm FROM bm""")
def _(spark, sf):
    scored = R.bm25(text_queries(spark, sf), text_index(spark, sf))
    return R.minmax_normalize(scored).select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


@query("max_normalize", sql=f"""WITH {ASK_SQL}, {TOK_SQL}, {bm25_sql('asked')}
SELECT query_id, doc_id, round(score / greatest(max(score) OVER (PARTITION BY query_id), 0.001), 6) AS norm FROM bm""")
def _(spark, sf):
    scored = R.bm25(text_queries(spark, sf), text_index(spark, sf))
    return R.max_normalize(scored).select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


@query("drop_zero_scores", sql="""WITH s AS (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS score
  FROM events GROUP BY user_id) SELECT user_id, round(score, 6) AS score FROM s WHERE score > 0""")
def _(spark, sf):
    spent = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0))
    per_user = read_table(spark, sf, "events").groupBy("user_id").agg(spent.alias("score"))
    return R.drop_zero_scores(per_user).withColumn("score", F.round("score", 6))


# --- vectors -----------------------------------------------------------------

VQ_SQL = "vq AS (SELECT label::BIGINT AS query_id, arg_min(embedding, vec_id) AS qe FROM embeddings GROUP BY label)"
SIM = "round(list_inner_product(qe::DOUBLE[], embedding::DOUBLE[]), 9)"


@query("similarity_all", sql=f"""WITH {VQ_SQL} SELECT query_id, vec_id AS doc_id, round({SIM}, 6) AS score
FROM vq, embeddings""")
def _(spark, sf):
    return V.similarity_all(vector_queries(spark, sf), corpus(spark, sf)).withColumn(
        "score", F.round("score", 6))


@query("knn", sql=f"""WITH {VQ_SQL}, s AS (SELECT query_id, vec_id AS doc_id, {SIM} AS score FROM vq, embeddings)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, {RANK} AS rank FROM s) WHERE rank <= 10""")
def _(spark, sf):
    return R.knn(vector_queries(spark, sf), corpus(spark, sf), 10).withColumn(
        "score", F.round("score", 6))


@query("knn_all_queries", sql=f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
  round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, {RANK} AS rank FROM s) WHERE rank <= 5""")
def _(spark, sf):
    # every vector asks: one pass over the corpus for each block of queries
    asked = corpus(spark, sf).select(F.col("doc_id").alias("query_id"), "embedding")
    return R.knn(asked, corpus(spark, sf), 5).withColumn(
        "score", F.round("score", 6))


@query("cosine", sql=f"""WITH {VQ_SQL} SELECT vec_id, round(list_inner_product(qe::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine
FROM embeddings JOIN vq ON vq.query_id = embeddings.label""")
def _(spark, sf):
    first = vector_queries(spark, sf).select(F.col("query_id").alias("label"), F.col("embedding").alias("qe"))
    return corpus(spark, sf).join(first, "label").select(
        F.col("doc_id").alias("vec_id"), F.round(V.cosine(F.col("qe"), F.col("embedding")), 6).alias("cosine"))


@query("pairwise_similarity", sql="""SELECT a.vec_id AS left_id, b.vec_id AS right_id,
  round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, sf):
    # every vector with the next one by number
    pairs = corpus(spark, sf).select(
        F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"))
    return R.pairwise_similarity(pairs, corpus(spark, sf)).withColumn(
        "similarity", F.round("similarity", 6))


# --- hybrid ------------------------------------------------------------------

HASK_SQL = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


@query("hybrid_search", sql=f"""WITH {HASK_SQL}, {TOK_SQL}, {bm25_sql('asked')}, {hybrid_sql('asked', 'h', 5, True)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM h""")
def _(spark, sf):
    return R.hybrid_search(hybrid_queries(spark, sf), text_index(spark, sf), corpus(spark, sf), 5).withColumn(
        "score", F.round("score", 6))


@query("hybrid_search_text_only", sql=f"""WITH {ASK_SQL}, {TOK_SQL}, {bm25_sql('asked')}, {hybrid_sql('asked', 'h', 5, False)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM h""")
def _(spark, sf):
    found = R.hybrid_search(text_queries(spark, sf), text_index(spark, sf), k=5, use_hybrid=False)
    return found.withColumn("score", F.round("score", 6))


# --- rerank and context ------------------------------------------------------

def rerank_sql(hits: str, out: str, k: int) -> str:
    """CTE ``out`` from CTE ``hits`` (query_id, query, doc_id, text, score)."""
    pun = r"regexp_replace(w2, '^\p{P}+|\p{P}+$', '', 'g')"
    def bg(x):
        return (f"list_distinct(list_transform(range(1, len({x})), lambda b_: {x}[b_] || '_' || {x}[b_ + 1]))")
    return rf"""{out}_t AS (SELECT *, {q.tokens('query')} AS qt, {q.tokens('text')} AS dt,
  regexp_split_to_array(lower(text), '[\p{{Zs}}\t]') AS sw FROM {hits}),
{out}_p AS (SELECT *, list_distinct(qt) AS qs, {bg('qt')} AS qb, {bg('dt')} AS db,
  list_filter(list_transform(sw, lambda w2, i2: CASE WHEN list_contains(qt, {pun}) THEN i2 - 1 END), lambda x2: x2 IS NOT NULL) AS pos FROM {out}_t),
{out}_f AS (SELECT query_id, query, doc_id, text, score * 0.30
  + len(list_intersect(qs, dt)) / greatest(1, len(qs)) * 0.20
  + len(list_intersect(qb, db)) / greatest(1, len(qb)) * 0.15
  + CASE WHEN len(pos) >= 2 THEN len(pos) / (pos[-1] - pos[1] + 1) WHEN len(pos) = 1 THEN 0.5 ELSE 0 END * 0.15
  + coalesce(len(list_intersect(qs, dt)) / nullif(len(qs), 0), 0) * 0.10
  + CASE WHEN len(pos) > 0 THEN 1 / (1 + pos[1] / 50) ELSE 0 END * 0.05
  + 1 / (1 + len(dt) / 500) * 0.05 AS score FROM {out}_p),
{out} AS MATERIALIZED (SELECT * FROM (SELECT *, {RANK} AS rank FROM {out}_f) WHERE rank <= {k})"""


@query("rerank", sql=f"""WITH {ASK_SQL}, {TOK_SQL}, {bm25_sql('asked')},
top AS (SELECT * FROM (SELECT *, {RANK} AS rank FROM bm) WHERE rank <= 20),
hits AS (SELECT query_id, query, doc_id, text, score FROM top JOIN asked USING (query_id) JOIN documents USING (doc_id)),
{rerank_sql('hits', 'r', 10)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r""")
def _(spark, sf):
    asked = text_queries(spark, sf)
    hits = R.keyword_search(asked, text_index(spark, sf), 20).drop("rank")
    hits = RR.with_text(hits, documents(spark, sf).select("doc_id", "text"), asked)
    return RR.rerank(hits, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("bigrams", sql=f"""WITH t AS (SELECT doc_id, {q.tokens('text')} AS t FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS b FROM t)
SELECT doc_id, count(DISTINCT b) AS n_bigrams, min(b) AS first_bigram, max(b) AS last_bigram FROM p GROUP BY doc_id""")
def _(spark, sf):
    pairs = documents(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("t")).select(
        "doc_id", RR.bigrams(F.col("t")).alias("b")).filter(F.size("b") > 0)
    return pairs.select("doc_id", F.size("b").alias("n_bigrams"), F.array_min("b").alias("first_bigram"),
                        F.array_max("b").alias("last_bigram"))


KEYS = list(K.SYNONYMS)
OPENERS = ["What", "find", "how", "show"]


# a synonym key, an opener and the first words of the text make up a short query
def short_queries(spark, sf) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in KEYS])
    openers = F.array(*[F.lit(o) for o in OPENERS])
    return passages(spark, sf, 3).select(
        F.col("doc_id").alias("query_id"),
        F.concat_ws(" ", F.get(openers, (F.col("doc_id") % 4).cast("int")),
                    F.get(keys, (F.col("doc_id") % 16).cast("int")),
                    F.array_join(F.slice(T.words(F.col("text")), 1, 3), " ")).alias("query"))


SHORT_SQL = f"""short AS (SELECT doc_id AS query_id, [{q.in_list(OPENERS)}][(doc_id % 4) + 1] || ' ' || [{q.in_list(KEYS)}][(doc_id % 16) + 1]
  || ' ' || array_to_string({q.words('text')}[1:3], ' ') AS query FROM {passages_sql(3)})"""
SYN_SQL = "syn(word, s) AS (VALUES " + ", ".join(
    f"('{w}', '{' '.join(s)}')" for w, s in K.SYNONYMS.items()) + ")"
EXPAND_SQL = f"""{SYN_SQL}, sw AS (SELECT query_id, query, {q.words('lower(query)')} AS w FROM {{0}}),
ex AS (SELECT query_id, query, array_to_string(w, ' ') AS base, unnest(w) AS word, unnest(range(len(w))) AS i FROM sw),
xp AS (SELECT query_id, query, coalesce(base || ' ' || string_agg(s, ' ' ORDER BY i), base) AS expanded
  FROM ex LEFT JOIN syn USING (word) GROUP BY query_id, query, base)"""


@query("expand_query", sql=f"WITH {SHORT_SQL}, {EXPAND_SQL.format('short')} SELECT query_id, expanded FROM xp")
def _(spark, sf):
    return short_queries(spark, sf).select("query_id", RR.expand_query(F.col("query")).alias("expanded"))


@query("query_variants", sql=f"""WITH {SHORT_SQL}, {EXPAND_SQL.format('short')},
v AS (SELECT query_id, list_filter([query, CASE WHEN expanded <> query THEN expanded END,
  CASE WHEN NOT regexp_matches(lower(query), '^(what|how|why|when)') THEN 'what is ' || query END,
  CASE WHEN NOT regexp_matches(lower(query), '^(what|how|why|when)') THEN 'how does ' || query END], lambda x: x IS NOT NULL) AS v FROM xp)
SELECT query_id, unnest(range(len(v))) AS pos, unnest(v) AS variant FROM v""")
def _(spark, sf):
    return short_queries(spark, sf).select(
        "query_id", F.posexplode(RR.query_variants(F.col("query"))).alias("pos", "variant"))


def followup_sql(asked: str, ctx: str, out: str) -> str:
    return rf"""{out}_t AS (SELECT query_id, unnest({q.tokens('context', 4)}) AS term FROM {ctx}),
{out}_w AS (SELECT query_id, unnest(regexp_split_to_array(lower(query), '[\p{{Zs}}\t]')) AS term FROM {asked}),
{out}_c AS (SELECT query_id, term, count(*) AS n FROM {out}_t WHERE term NOT IN ({q.in_list(K.FOLLOWUP_STOP_WORDS)})
  AND NOT EXISTS (SELECT 1 FROM {out}_w w WHERE w.query_id = {out}_t.query_id AND w.term = {out}_t.term) GROUP BY query_id, term),
{out}_k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS rk FROM {out}_c),
{out} AS (SELECT a.query_id, a.query, a.query || coalesce(' ' || string_agg(term, ' ' ORDER BY rk), '') AS followup
  FROM {asked} a LEFT JOIN (SELECT * FROM {out}_k WHERE rk <= 3) k ON k.query_id = a.query_id GROUP BY a.query_id, a.query)"""


@query("followup_query", sql=f"""WITH {ASK_SQL}, {TOK_SQL}, {bm25_sql('asked')},
ctx AS (SELECT query_id, text AS context FROM (SELECT *, {RANK} AS rank FROM bm) JOIN documents USING (doc_id) WHERE rank <= 5),
{followup_sql('asked', 'ctx', 'fu')}
SELECT query_id, followup FROM fu""")
def _(spark, sf):
    asked = text_queries(spark, sf)
    hits = R.keyword_search(asked, text_index(spark, sf), 5)
    ctx = RR.with_text(hits, documents(spark, sf), asked).select("query_id", F.col("text").alias("context"))
    return RR.followup_queries(asked, ctx).select("query_id", "followup")


def labelled_documents(spark, sf) -> DataFrame:
    """Documents with their language as section and, for some, the source as chapter."""
    return documents(spark, sf).select(
        "doc_id", "text", "source",
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("section"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("chapter"))


LABELLED_SQL = """labelled AS (SELECT doc_id, text, source, coalesce('[' || CASE WHEN doc_id % 2 = 0 THEN lang END || '] ', '')
  || coalesce('[' || CASE WHEN doc_id % 3 = 0 THEN source END || '] ', '') || text AS context FROM documents)"""


@query("format_context", sql=f"WITH {LABELLED_SQL} SELECT doc_id, context FROM labelled")
def _(spark, sf):
    return labelled_documents(spark, sf).select("doc_id", RR.format_context(
        F.col("text"), F.col("section"), F.col("chapter")).alias("context"))


@query("rag_context", sql=f"""WITH {HASK_SQL}, {TOK_SQL}, {bm25_sql('asked')}, {hybrid_sql('asked', 'h', 10, True)}, {LABELLED_SQL},
hits AS (SELECT query_id, query, doc_id, text, score FROM h JOIN asked USING (query_id) JOIN documents USING (doc_id)),
{rerank_sql('hits', 'r', 5)}
SELECT query_id, string_agg(context, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS passages
FROM r JOIN labelled USING (doc_id) GROUP BY query_id""")
def _(spark, sf):
    return RR.rag_context(hybrid_queries(spark, sf), text_index(spark, sf), labelled_documents(spark, sf),
                          corpus(spark, sf), 5)


def _first_of_sql(src: str, out: str, hop: int, seen: str | None) -> str:
    """New contexts of a hop: the first of a (source, opening) pair, unless seen before."""
    new = f"""AND NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.query_id = f.query_id AND s.source = f.source AND s.head = f.head)""" if seen else ""
    return f"""{out} AS MATERIALIZED (SELECT query_id, {hop} AS hop, rank, doc_id, source, head, context FROM (
  SELECT r.query_id, r.rank, r.doc_id, l.source, l.text[1:50] AS head, l.context,
    row_number() OVER (PARTITION BY r.query_id, l.source, l.text[1:50] ORDER BY r.rank) AS first
  FROM {src} r JOIN labelled l USING (doc_id)) f WHERE first = 1 {new})"""


def multi_hop_sql(*vectors) -> str:
    return f"""{ASK_SQL}, {TOK_SQL}, {LABELLED_SQL}, {EXPAND_SQL.format('asked')},
asked0 AS (SELECT query_id, expanded AS query FROM xp), {bm25_sql('asked0', 'bm0')}, {hybrid_sql('asked0', 'h0', 10, *vectors[:1] or [False], 'bm0', *vectors[1:])},
hits0 AS (SELECT query_id, query, doc_id, text, score FROM h0 JOIN asked USING (query_id) JOIN documents USING (doc_id)),
{rerank_sql('hits0', 'r0', 5)}, {_first_of_sql('r0', 'c0', 0, None)},
{followup_sql('asked', 'c0', 'fu')},
asked1 AS (SELECT query_id, followup AS query FROM fu WHERE followup <> query), {bm25_sql('asked1', 'bm1')}, {hybrid_sql('asked1', 'h1', 10, *vectors[:1] or [False], 'bm1', *vectors[1:])},
hits1 AS (SELECT query_id, query, doc_id, text, score FROM h1 JOIN asked1 USING (query_id) JOIN documents USING (doc_id)),
{rerank_sql('hits1', 'r1', 5)}, {_first_of_sql('r1', 'c1', 1, 'c0')},
found AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1),
few AS (SELECT query_id, query, expanded FROM xp WHERE (SELECT count(*) FROM found f WHERE f.query_id = xp.query_id) < 5),
fv AS (SELECT query_id, list_filter([query, CASE WHEN expanded <> query THEN expanded END,
  CASE WHEN NOT regexp_matches(lower(query), '^(what|how|why|when)') THEN 'what is ' || query END,
  CASE WHEN NOT regexp_matches(lower(query), '^(what|how|why|when)') THEN 'how does ' || query END], lambda x: x IS NOT NULL) AS v FROM few),
va AS (SELECT query_id AS base, unnest(v) AS query, unnest(range(len(v))) AS n FROM fv),
askedv AS (SELECT base || ':' || n AS query_id, base, n, query FROM va WHERE n > 0), {bm25_sql('askedv', 'bmv')}, {hybrid_sql('askedv', 'hv', 5, *vectors[:1] or [False], 'bmv', *vectors[1:])},
rv AS (SELECT base AS query_id, n * 1000 + rank AS rank, doc_id FROM hv JOIN askedv USING (query_id)),
{_first_of_sql('rv', 'cv', 2, 'found')},
every AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, rank) AS pos FROM (SELECT * FROM found UNION ALL SELECT * FROM cv))
SELECT query_id, pos, hop::BIGINT AS hop, doc_id, source, context FROM every WHERE hop < 2 OR pos <= 10"""


@query("multi_hop", sql="WITH " + multi_hop_sql())
def _(spark, sf):
    return RR.multi_hop(text_queries(spark, sf), text_index(spark, sf), labelled_documents(spark, sf))


def embed_by_length(spark, sf):
    """Stands for an embedding model: a query gets the vector numbered by its length."""
    given = corpus(spark, sf).select(F.col("doc_id").alias("_n"), "embedding")
    return lambda asked: asked.join(given, F.length("query") % 400 == F.col("_n"), "left").drop("_n")


@query("multi_hop_vectors", sql="WITH " + multi_hop_sql(True, "length(a.query) % 400"))
def _(spark, sf):
    return RR.multi_hop(text_queries(spark, sf), text_index(spark, sf), labelled_documents(spark, sf),
                        corpus=corpus(spark, sf), embed=embed_by_length(spark, sf))


# --- evaluation --------------------------------------------------------------

# the first sentence of every document in the stated query set should find that document
def probes(spark, sf) -> DataFrame:
    asked = documents(spark, sf).filter("doc_id % 20 = 0").select(F.col("doc_id").alias("expected_id"), "text")
    vec = corpus(spark, sf).select(F.col("doc_id").alias("expected_id"), "embedding")
    return asked.join(vec, "expected_id", "left").select(
        F.col("expected_id").alias("query_id"), "expected_id",
        T.strip(F.get(T.sentences(F.col("text")), F.lit(0))).alias("query"), "embedding")


PROBE_SQL = f"""asked AS (SELECT doc_id AS query_id, doc_id AS expected_id, {q.strip(q.sentences('text') + '[1]')} AS query
  FROM documents WHERE doc_id % 20 = 0)"""


@query("eval_retrieval", sql=f"""WITH {PROBE_SQL}, {TOK_SQL}, {bm25_sql('asked')}, {hybrid_sql('asked', 'h', 1, True)},
e AS (SELECT query_id, doc_id, score, {RANK} AS rank FROM (SELECT a.query_id, v.vec_id AS doc_id,
  coalesce(round(list_inner_product(x.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9), 0) AS score
  FROM asked a LEFT JOIN embeddings x ON x.vec_id = a.query_id, embeddings v)),
res AS (SELECT 'bm25' AS method, query_id, doc_id FROM (SELECT *, {RANK} AS rank FROM bm) WHERE rank = 1
  UNION ALL SELECT 'embedding', query_id, doc_id FROM e WHERE rank = 1 UNION ALL SELECT 'hybrid', query_id, doc_id FROM h WHERE rank = 1)
SELECT method, sum((doc_id = expected_id)::INT)::BIGINT AS hits, (SELECT count(*) FROM asked) AS queries,
  round(sum((doc_id = expected_id)::INT) / (SELECT count(*) FROM asked), 6) AS hit_rate
FROM asked JOIN res USING (query_id) GROUP BY method""")
def _(spark, sf):
    asked, index, vec = materialize(probes(spark, sf), "probes"), text_index(spark, sf), corpus(spark, sf)
    cols = ["query_id", "doc_id", "rank"]
    lexical = R.lexical_scores(asked, index, 1)
    found = (
        R.keyword_search(asked, index, 1, lexical).select(F.lit("bm25").alias("method"), *cols)
        .unionByName(R.knn(asked, vec, 1).select(F.lit("embedding").alias("method"), *cols))
        .unionByName(R.hybrid_search(asked, index, vec, 1, lexical=lexical).select(F.lit("hybrid").alias("method"), *cols))
    )
    return R.eval_retrieval(asked, found).withColumn("hit_rate", F.round("hit_rate", 6))


@query("term_overlap", sql=f"""WITH p AS (SELECT doc_id, {q.sentences('text')} AS s FROM documents),
w AS (SELECT doc_id, {q.words('lower(s[1])')} AS qw, {q.words("lower(array_to_string(s[2:], ''))")} AS dw FROM p)
SELECT doc_id, round(coalesce(len(list_filter(qw, lambda x: list_contains(dw, x))) / nullif(len(qw), 0), 0), 6) AS overlap FROM w""")
def _(spark, sf):
    # the opening sentence against the rest of its document
    cut = documents(spark, sf).select("doc_id", T.sentences(F.col("text")).alias("s"))
    rest = F.array_join(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), "")
    return cut.select("doc_id", F.round(
        R.term_overlap(F.get("s", F.lit(0)), rest), 6).alias("overlap"))
