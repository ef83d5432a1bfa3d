import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import index as I
from lectern.operators import rerank as RR
from lectern.operators import retrieval as R
from lectern.operators import vectors as V
from lectern.operators.segments import SegmentedIndex

PASSAGES = [
    (0, "The harbour light burned all night. Ships found the harbour by its light."),
    (1, "Bread rises because yeast makes gas in the dough."),
    (2, "A harbour pilot guides ships past the rocks."),
    (3, "Rain fell."),
    (4, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(PASSAGES, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def index(docs):
    return I.TextIndex.build(docs, buckets=4)


@pytest.fixture(scope="module", params=["joined", "shards"])
def either(request, docs, index, tmp_path_factory):
    if request.param == "joined":
        return index
    return SegmentedIndex.build(docs, str(tmp_path_factory.mktemp("segments")), shard_postings=6)


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def brute_bm25(query):
    import regex
    tok = lambda s: [t for t in regex.split(r"[^\p{L}\p{M}\p{N}]+", s.lower()) if len(t) > 2]
    docs = [tok(t) for _, t in PASSAGES]
    avg = sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        s = 0.0
        for t in tok(query):
            tf, df = d.count(t), sum(t in x for x in docs)
            idf = math.log((len(docs) - df + 0.5) / (df + 0.5) + 1)
            s += idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len(d) / avg))
        out.append(s)
    return out


def test_bm25_equals_brute_force_with_repeated_terms(spark, either):
    asked = ["harbour light", "harbour harbour ships", "yeast", "nothing here"]
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in R.bm25(queries(spark, *asked), either).collect()}
    for i, text in enumerate(asked):
        for d, score in enumerate(brute_bm25(text)):
            assert got.get((i, d), 0.0) == pytest.approx(score)


def test_lazy_index_gives_the_same_scores(spark, docs, index):
    lazy = I.TextIndex.of(I.document_terms(docs))
    q = queries(spark, "harbour ships light")
    rows = lambda ix: sorted((r["doc_id"], round(r["score"], 9)) for r in R.bm25(q, ix).collect())
    assert rows(lazy) == rows(index)


def test_keyword_search_cases(spark, index):
    found = R.keyword_search(queries(spark, "harbour light", "", "zebra"), index, 10).collect()
    assert [(r["query_id"], r["doc_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 0), (0, 2)]


def test_empty_corpus_finds_nothing(spark, docs):
    empty = I.TextIndex.build(docs.filter("false"), buckets=2)
    assert R.keyword_search(queries(spark, "harbour"), empty).count() == 0


def test_reloaded_index_finds_the_same(spark, docs, tmp_path):
    q = queries(spark, "harbour ships")
    rows = lambda ix: sorted((r["doc_id"], round(r["score"], 9)) for r in R.bm25(q, ix).collect())
    for buckets in (None, 3, 7):
        folder = str(tmp_path / f"index-{buckets}")
        built = I.TextIndex.build(docs, folder, buckets=buckets)
        assert I.TextIndex.load(spark, folder).buckets == built.buckets == (buckets or 1)
        assert rows(I.TextIndex.load(spark, folder)) == rows(I.TextIndex.of(I.document_terms(docs)))


def test_deleting_documents_changes_statistics(spark, docs, index):
    left = index.without(spark.createDataFrame([(0,)], "doc_id bigint"))
    assert left.stats.first()["n"] == 4
    rebuilt = I.TextIndex.build(docs.filter("doc_id <> 0"), buckets=4)
    q = queries(spark, "harbour ships")
    rows = lambda ix: sorted((r["doc_id"], round(r["score"], 9)) for r in R.bm25(q, ix).collect())
    assert rows(left) == rows(rebuilt)


def test_normalisation(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 3.0), (2, 1, 5.0)], "query_id int, doc_id int, score double")
    got = {(r["query_id"], r["doc_id"]): r["norm"] for r in R.minmax_normalize(df).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): 0.5, (2, 1): 0.5}
    tiny = spark.createDataFrame([(1, 1, 0.0005)], "query_id int, doc_id int, score double")
    assert R.max_normalize(tiny).first()["norm"] == 0.5


# --- vectors -----------------------------------------------------------------

def unit(rng, d):
    v = rng.normal(size=d)
    return [float(x) for x in v / np.linalg.norm(v)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, unit(rng, 8)) for i in range(60)]
    rows += [(60, rows[5][1]), (61, None), (62, []), (63, unit(rng, 4))]
    return rows, spark.createDataFrame(rows, "doc_id bigint, embedding array<float>")


def brute_knn(rows, qs, k):
    out = []
    for qid, q in qs:
        scored = []
        for i, v in rows:
            same = v is not None and q is not None and len(v) == len(q) and len(q) > 0
            s = sum(np.float64(np.float32(a)) * np.float64(np.float32(b)) for a, b in zip(v, q)) if same else 0.0
            scored.append((-round(s, 9), i))
        out += [(qid, i, n + 1) for n, (_, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"max_queries": 2}])
def test_knn_equals_brute_force_in_one_and_many_passes(spark, vectors, sizes):
    rows, corpus = vectors
    qs = [(i, rows[i][1]) for i in (5, 9, 17, 33)] + [(99, rows[63][1])]
    asked = spark.createDataFrame(qs, "query_id int, embedding array<float>")
    got = sorted((r["query_id"], r["doc_id"], r["rank"]) for r in R.knn(asked, corpus, 4, **sizes).collect())
    assert got == brute_knn(rows, qs, 4)


@pytest.mark.parametrize("sizes", [{}, {"max_queries": 1}])
def test_similarity_all_scores_every_pair(spark, vectors, sizes):
    rows, corpus = vectors
    asked = spark.createDataFrame([(1, rows[5][1]), (2, rows[6][1])], "query_id int, embedding array<float>")
    got = V.similarity_all(asked, corpus, **sizes)
    assert got.count() == 2 * len(rows)
    assert got.filter("query_id = 1 and doc_id in (5, 60)").agg(F.min("score")).first()[0] == pytest.approx(1.0)
    assert got.filter("doc_id in (61, 62, 63)").agg(F.max(F.abs("score"))).first()[0] == 0.0


def test_balls_rule_queries_out_without_changing_a_result(spark):
    import pandas as pd

    rng = np.random.default_rng(11)
    centres = [np.array(unit(rng, 16)) for _ in range(12)]
    near = lambda c: [float(x) for x in centres[c] + 0.01 * rng.normal(size=16)]
    rows = [(i, near(i // 250)) for i in range(3000)] + [(3000, None), (3001, [float("nan")] * 16), (3002, [0.5] * 3)]
    qs = [(i, rows[250 * i][1]) for i in range(12)] + [(90, None), (91, [1.0, 0.0, 2.0])]
    for k in (1, 7):
        block = V.QueryBlock([q for q, _ in qs], [v for _, v in qs])
        frame = pd.DataFrame(rows, columns=["doc_id", "embedding"])
        full = block.scores(frame["embedding"])
        got = block.best(iter([frame.iloc[:1000], frame.iloc[1000:1000], frame.iloc[1000:]]), k)
        for j, (q, _) in enumerate(qs):
            want = sorted(range(len(rows)), key=lambda i: (np.isnan(full[i, j]), -full[i, j], i))[:k]
            mine = got[got["query_id"] == q]
            assert mine["doc_id"].tolist() == want and np.array_equal(mine["score"], full[want, j])
        finite = block.best(iter([frame.iloc[:1000], frame.iloc[1000:3000]]), k)
        assert np.array_equal(finite["lo"][:14], full[:3000].min(0)) and np.array_equal(finite["hi"][:14], full[:3000].max(0))
        assert block.pruned > 0.3 * block.scored  # the least scores have to be looked at, too
        alone = block.best(iter([frame.iloc[:1000], frame.iloc[1000:3000]]), k, ranged=False)
        assert alone.equals(finite[alone.columns.tolist()]) and block.pruned > block.scored
    few = block.best(iter([frame.iloc[:3]]), 7)
    assert len(few) == 3 * len(qs) and V.QueryBlock([1], [None]).best(iter([]), 3) is None


def test_corpus_by_pivot_is_the_same_corpus(spark, vectors):
    rows, corpus = vectors
    got = V.by_pivot(corpus, 6)
    assert got.columns == corpus.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i, _ in rows]
    asked = spark.createDataFrame([(1, rows[5][1]), (2, rows[63][1])], "query_id int, embedding array<float>")
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in R.knn(asked, got, 4).collect()) == brute_knn(
        rows, [(1, rows[5][1]), (2, rows[63][1])], 4)
    assert V.by_pivot(corpus.limit(0)).count() == 0


def test_thousands_of_queries_leave_the_corpus_in_place(spark):
    rng = np.random.default_rng(12)
    rows = [(i, unit(rng, 6)) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    asked = df.withColumnRenamed("doc_id", "query_id")
    found = V.best_candidates(asked, df, 1)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = R.knn(asked, df, 1).collect()
    assert len(got) == 5000 and all(r["query_id"] == r["doc_id"] for r in got)


def brute_hybrid(asked, rows, k, weight):
    emb = {i: v for i, v in rows}
    def scale(xs):
        lo, hi = min(xs), max(xs)
        return [0.5 if hi == lo else (x - lo) / (hi - lo) for x in xs]
    out = []
    for qid, text, vec in asked:
        b = scale(brute_bm25(text))
        e = scale([float(np.dot(np.float32(emb[i]).astype(float), np.float32(vec).astype(float))) if i in emb else 0.0 for i, _ in PASSAGES])
        s = [(-round((1 - weight) * x + weight * y, 9), i) for i, (x, y) in enumerate(zip(b, e))]
        out += [(qid, i, n + 1) for n, (_, i) in enumerate(sorted(s)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
@pytest.mark.parametrize("weight", [0.5, 0.1, 0.9])
def test_hybrid_candidates_equal_scoring_everything(spark, either, k, weight):
    rng = np.random.default_rng(k)
    rows = [(i, unit(rng, 4)) for i in (0, 1, 3, 77)]  # 2 and 4 lack a vector, 77 is stale
    asked = [(0, "harbour light", unit(rng, 4)), (1, "zebra", unit(rng, 4)), (2, "rain ships yeast harbour", unit(rng, 4))]
    q = spark.createDataFrame(asked, "query_id int, query string, embedding array<float>")
    corpus = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>")
    got = R.hybrid_search(q, either, corpus, k, weight).collect()
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in got) == brute_hybrid(asked, rows, k, weight)


def test_hybrid_without_vectors_scores_unmatched_at_a_quarter(spark, either):
    got = R.hybrid_search(queries(spark, "harbour", "zebra"), either, k=5).orderBy("query_id", "rank").collect()
    assert len(got) == 10
    assert got[0]["score"] == pytest.approx(0.75) and got[4]["score"] == pytest.approx(0.25)
    assert {r["score"] for r in got[5:]} == {0.5}


# --- rerank and expansion ----------------------------------------------------

def features(spark, query, text):
    df = spark.createDataFrame([(query, text)], "q string, t string")
    return df.select(RR.rerank_features(F.col("q"), F.col("t")).alias("f")).first()["f"].asDict()


def test_rerank_features_by_number_of_hits(spark):
    none = features(spark, "alpha beta", "gamma delta")
    assert (none["density"], none["position"], none["overlap"]) == (0.0, 0.0, 0.0)
    one = features(spark, "alpha beta", "so, (alpha) came")
    assert one["density"] == 0.5 and one["position"] == pytest.approx(1 / (1 + 1 / 50)) and one["coverage"] == 0.5
    two = features(spark, "alpha beta", "x alpha beta. and alpha!")
    assert two["density"] == pytest.approx(3 / 4) and two["bigram"] == 1.0 and two["overlap"] == 1.0
    empty = features(spark, "", "alpha")
    assert (empty["coverage"], empty["overlap"]) == (0.0, 0.0)


def test_newline_does_not_split_position_words(spark):
    got = features(spark, "alpha", "x\nalpha alpha")
    assert got["density"] == 0.5 and got["position"] == pytest.approx(1 / (1 + 1 / 50))


def test_rerank_weights_and_order(spark):
    rows = [(1, "alpha beta", 10, "alpha beta", 0.5), (1, "alpha beta", 11, "gamma", 0.9)]
    df = spark.createDataFrame(rows, "query_id int, query string, doc_id int, text string, score double")
    got = RR.rerank(df, 1).collect()
    assert [r["doc_id"] for r in got] == [10]
    want = 0.15 + 0.20 + 0.15 + 0.15 + 0.10 + 0.05 + 0.05 / (1 + 2 / 500)
    assert got[0]["score"] == pytest.approx(want)


def test_expansion_and_variants(value):
    assert value(RR.expand_query, "Find FAST code") == "find fast code search locate get quick rapid efficient"
    assert value(RR.query_variants, "fast cars", "What is fast") == [
        ["fast cars", "fast cars quick rapid efficient", "what is fast cars", "how does fast cars"],
        ["What is fast", "what is fast quick rapid efficient"]]
    assert value(RR.query_variants, "cars")[0:2] == ["cars", "what is cars"]


def test_followup_adds_frequent_new_terms(spark):
    ctx = spark.createDataFrame([(1, "stone stone bridge"), (1, "bridge river river river about about"), (2, "tiny a")], "query_id int, context string")
    q = spark.createDataFrame([(1, "Old bridge"), (2, "lone query")], "query_id int, query string")
    got = {r["query_id"]: r["followup"] for r in RR.followup_queries(q, ctx).collect()}
    assert got == {1: "Old bridge river stone", 2: "lone query"}


def test_context_labels(spark):
    df = spark.createDataFrame([("t", "S", "C"), ("t", None, "C"), ("t", None, None)], "t string, s string, c string")
    got = [r[0] for r in df.select(RR.format_context(F.col("t"), F.col("s"), F.col("c"))).collect()]
    assert got == ["[S] [C] t", "[C] t", "t"]


def test_multi_hop_never_repeats_an_opening(spark, docs, index):
    chunks = docs.withColumn("source", F.lit("one"))
    got = RR.multi_hop(queries(spark, "harbour light", "yeast dough"), index, chunks, k=2).collect()
    seen = [(r["query_id"], r["context"][:50]) for r in got]
    assert len(seen) == len(set(seen)) and {r["query_id"] for r in got} == {0, 1}
    assert all(r["pos"] <= 4 for r in got)


def test_term_overlap_counts_repeats(spark):
    df = spark.createDataFrame([("a a b", "A c"), ("", "x")], "q string, t string")
    got = [r[0] for r in df.select(R.term_overlap(F.col("q"), F.col("t"))).collect()]
    assert got == [pytest.approx(2 / 3), 0.0]


def test_eval_counts_missing_results_as_misses(spark):
    labeled = spark.createDataFrame([(1, 10), (2, 20)], "query_id int, expected_id int")
    found = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 20, 2), ("b", 2, 10, 1)], "method string, query_id int, doc_id int, rank int")
    got = {r["method"]: (r["hits"], r["queries"], r["hit_rate"]) for r in R.eval_retrieval(labeled, found).collect()}
    assert got == {"a": (1, 2, 0.5), "b": (0, 2, 0.0)}


@pytest.mark.parametrize("shards", [False, True])
def test_random_hybrid_pruning(spark, tmp_path, shards):
    rng = random.Random(8)
    vocab = [f"term{i}" for i in range(12)]
    texts = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30)))) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    ix = SegmentedIndex.build(docs, str(tmp_path), shard_postings=100) if shards else I.TextIndex.of(I.document_terms(docs))
    g = np.random.default_rng(1)
    corpus = spark.createDataFrame([(i, unit(g, 6)) for i in range(0, 80, 2)], "doc_id bigint, embedding array<float>")
    q = spark.createDataFrame([(i, " ".join(rng.sample(vocab, 3)), unit(g, 6)) for i in range(6)], "query_id int, query string, embedding array<float>")
    bm = {(r[0], r[1]): r[2] for r in R.bm25(q, ix).collect()}
    sim = {(r[0], r[1]): r[2] for r in V.similarity_all(q, corpus).collect()}
    want = []
    for i in range(6):
        b, e = [bm.get((i, d), 0.0) for d in range(80)], [sim.get((i, d), 0.0) for d in range(80)]
        scale = lambda xs: [(x - min(xs)) / (max(xs) - min(xs)) for x in xs]
        s = sorted((-round(0.5 * x + 0.5 * y, 9), d) for d, (x, y) in enumerate(zip(scale(b), scale(e))))
        want += [(i, d, n + 1) for n, (_, d) in enumerate(s[:7])]
    got = sorted((r["query_id"], r["doc_id"], r["rank"]) for r in R.hybrid_search(q, ix, corpus, 7).collect())
    assert got == sorted(want)


def test_queries_without_a_vector_are_not_multiplied():
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(3)
    frame = pd.DataFrame({"doc_id": range(500, 0, -1), "embedding": list(r.normal(size=(500, 4)))})
    block = V.QueryBlock([1, 2, 3], [None, frame["embedding"][7], None])
    got = block.best(iter([frame.iloc[:200], frame.iloc[200:]]), 2)
    none = got[got["query_id"] != 2]
    assert sorted(zip(none["query_id"], none["doc_id"])) == [(1, 1), (1, 2), (3, 1), (3, 2)]
    assert (none[["score", "lo", "hi"]] == 0).all(axis=None) and block.scored <= 500
