"""Exact vector similarity.

Queries travel to the corpus, a block at a time: at most ``MAX_QUERIES`` vectors of ``MAX_NUMBERS`` numbers are
shipped with the task function, and each block is one pass over the corpus, whose vectors are never shuffled or
copied.  A task cuts its Arrow batches into balls of rows around pivots; a ball is multiplied only by those
queries whose bound over the ball, q.c +- |q| r, can still change their best ``k`` or their range of scores.
Nothing but k rows per query and task leaves a pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lectern.sources.tables import Scratch

MAX_QUERIES = 32_768
#: Queries that are multiplied with a ball at once.
SLICE = 2048
#: Most numbers in a shipped block (32 MB as doubles), whatever the dimension.
MAX_NUMBERS = 4_000_000
#: Rows a pivot on average stands for, and most rows of a ball.
BALL_ROWS, MAX_BALL = 128, 1024
#: Scores are compared after rounding to this many digits, so equal vectors tie by id.
DIGITS = 9


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; 0 when a vector is missing, empty or of other length."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x,
    )
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.coalesce(F.when(same, dot), F.lit(0.0))


class QueryBlock:
    """Query vectors as matrices, one per dimension."""

    def __init__(self, ids, vectors):
        self.ids = list(ids)
        by_dim: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_dim.setdefault(0 if v is None else len(v), []).append(i)
        self.parts = {
            d: (np.array(at), np.array([vectors[i] for i in at], dtype=np.float64).T)
            for d, at in by_dim.items() if d
        }

    def scores(self, vectors: pd.Series) -> np.ndarray:
        out = np.zeros((len(vectors), len(self.ids)))
        dims = np.array([0 if v is None else len(v) for v in vectors])
        for d in set(dims) & set(self.parts):
            at, matrix = self.parts[d]
            rows = np.flatnonzero(dims == d)
            block = np.stack([np.asarray(v, dtype=np.float64) for v in vectors.iloc[rows]])
            out[np.ix_(rows, at)] = block @ matrix
        return np.round(out, DIGITS) + 0.0

    def all_scores(self, pdf: pd.DataFrame) -> pd.DataFrame:
        s = self.scores(pdf["embedding"])
        return pd.DataFrame({
            "query_id": np.tile(np.array(self.ids, dtype=object), len(pdf)),
            "doc_id": np.repeat(pdf["doc_id"].to_numpy(), len(self.ids)),
            "score": s.reshape(-1),
        })

    def balls(self, vectors: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        """(dimension, places, rows, radius) of a batch, rows grouped by the nearest of evenly taken pivots."""
        dims = np.array([0 if v is None else len(v) for v in vectors])
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            if d not in self.parts:
                yield d, at, np.zeros((len(at), 0)), 0.0
                continue
            block = np.stack([np.asarray(v, dtype=np.float64) for v in vectors.iloc[at]])
            pivots = block[::BALL_ROWS]
            near = np.argmax(block @ pivots.T - (pivots ** 2).sum(1) / 2, axis=1)
            order = np.argsort(near, kind="stable")
            edges = np.flatnonzero(np.diff(near[order], prepend=-1))
            for i, j in zip(edges, [*edges[1:], len(order)]):
                for low in range(i, j, MAX_BALL):
                    mine = order[low:min(j, low + MAX_BALL)]
                    rows = block[mine]
                    radius = np.sqrt(((rows - rows.mean(0)) ** 2).sum(1).max())
                    yield d, at[mine], rows, radius

    def bounds(self, d: int, rows: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest rounded score of each query with any row of a ball."""
        low, high = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        if d in self.parts:
            at, matrix = self.parts[d]
            centre = rows.mean(0)
            mid, length = centre @ matrix, np.sqrt((matrix ** 2).sum(0))
            # a score is rounded to DIGITS and summed with a relative error far below 1e-11
            reach = length * radius + 10.0 ** -DIGITS + 1e-11 * length * (np.sqrt(centre @ centre) + radius)
            low[at], high[at] = mid - reach, mid + reach
        return low, high

    def best(self, batches: Iterator[pd.DataFrame], k: int, ranged: bool = True) -> pd.DataFrame | None:
        """Best ``k`` per query over all batches, if ``ranged`` with the range of all scores.

        ``scored`` counts the products made, ``pruned`` those that the bounds of a ball ruled out.
        """
        n = len(self.ids)
        top, ids, seen = np.full((k, n), -np.inf), None, 0
        lo, hi = np.full(n, np.inf), np.full(n, -np.inf)
        self.scored = self.pruned = 0
        none = np.ones(n, bool)  # a query without a vector scores 0 everywhere: the first ids are its best
        for at, _ in self.parts.values():
            none[at] = False
        first = np.zeros(0)
        for pdf in batches:
            names = np.asarray(pdf["doc_id"].tolist())
            if len(names) and none.any():
                first = np.sort(np.concatenate([first, names]) if len(first) else names)[:k]
            for d, places, rows, radius in self.balls(pdf["embedding"]):
                low, high = self.bounds(d, rows, radius)
                out = (high < top[-1]) & (low > lo) if ranged else high < top[-1]
                live = np.flatnonzero(~out & ~none)  # NaN stays
                self.scored += len(places) * len(live)
                self.pruned += len(places) * (n - len(live))
                seen += len(places)
                if ids is None:
                    ids = np.broadcast_to(names[:1], (k, n)).copy()
                for i in range(0, len(live), SLICE):
                    ids = self._into(top, ids, lo, hi, live[i:i + SLICE], d, rows, names[places], k)
        if ids is None:
            return None
        kept = min(k, seen)
        top[:, none], lo[none], hi[none] = 0.0, 0.0, 0.0
        if none.any():
            ids = ids.astype(np.promote_types(ids.dtype, first.dtype), copy=False)
            ids[:kept, none] = first[:kept, None]
        found = pd.DataFrame({
            "query_id": np.tile(np.array(self.ids, dtype=object), kept),
            "doc_id": ids[:kept].reshape(-1), "score": top[:kept].reshape(-1),
        })
        return found.assign(lo=np.tile(lo, kept), hi=np.tile(hi, kept)) if ranged else found

    def _into(self, top, ids, lo, hi, live, d: int, rows: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
        """Take the scores of some queries with the rows of a ball into their best and their ranges."""
        s = np.zeros((len(names), len(live)))
        if d in self.parts:
            at, matrix = self.parts[d]
            if len(at) == len(self.ids):
                s = rows @ matrix[:, live]
            else:
                column = np.full(len(self.ids), -1)
                column[at] = np.arange(len(at))
                mine = np.flatnonzero(column[live] >= 0)
                s[:, mine] = rows @ matrix[:, column[live[mine]]]
        s = np.round(s, DIGITS) + 0.0
        lo[live], hi[live] = np.minimum(lo[live], s.min(0)), np.maximum(hi[live], s.max(0))
        hot = np.flatnonzero(~(s < top[-1, live]).all(0))
        if not len(hot):
            return ids
        at = live[hot]
        both = np.concatenate([top[:, at], s[:, hot]])
        both_ids = np.concatenate([ids[:, at], np.broadcast_to(names[:, None], (len(names), len(hot)))])
        order = np.lexsort((both_ids, -both), axis=0)[:k]
        ids = ids.astype(np.promote_types(ids.dtype, both_ids.dtype), copy=False)
        top[:, at], ids[:, at] = np.take_along_axis(both, order, 0), np.take_along_axis(both_ids, order, 0)
        return ids


def by_pivot(corpus: DataFrame, pivots: int = 256) -> DataFrame:
    """The corpus with vectors near one pivot next to each other, so that balls are narrow.

    Write it once and search it often.  Pivots are ``pivots`` vectors (64,000 numbers at least fit) taken by a hash
    of their id; rows without a vector, or of another dimension, come together.
    """
    some = corpus.filter("size(embedding) > 0").select("embedding").orderBy(F.xxhash64("doc_id")).limit(pivots).collect()
    vectors = [np.asarray(r[0], dtype=np.float64) for r in some]
    vectors = [v for v in vectors if len(v) == len(vectors[0])]

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        centres = np.stack(vectors) if vectors else np.zeros((1, 0))
        for batch in batches:
            out = np.full(len(batch), -1)
            at = [i for i, v in enumerate(batch) if v is not None and 0 < len(v) == centres.shape[1]]
            if at:
                rows = np.stack([np.asarray(batch.iloc[i], dtype=np.float64) for i in at])
                out[at] = np.argmax(rows @ centres.T - (centres ** 2).sum(1) / 2, axis=1)
            yield pd.Series(out)

    near = F.pandas_udf(place, "int", F.PandasUDFType.SCALAR_ITER)
    spread = corpus.withColumn("_pivot", near("embedding")).withColumn("_mix", F.xxhash64("doc_id"))
    return spread.repartitionByRange("_pivot", "_mix").sortWithinPartitions("_pivot").drop("_pivot", "_mix")


def _schema(queries: DataFrame, corpus: DataFrame, with_range: bool) -> ST.StructType:
    fields = [
        ST.StructField("query_id", queries.schema["query_id"].dataType),
        ST.StructField("doc_id", corpus.schema["doc_id"].dataType),
        ST.StructField("score", ST.DoubleType()),
    ]
    if with_range:
        fields += [ST.StructField(c, ST.DoubleType()) for c in ("lo", "hi")]
    return ST.StructType(fields)


def _blocks(queries: DataFrame, max_queries: int) -> Iterator[QueryBlock]:
    """The queries in blocks of bounded size, one at a time; an empty block where there are none."""
    ids, vectors, held, made = [], [], 0, False
    for row in queries.select("query_id", "embedding").toLocalIterator():
        size = len(row[1] or ())
        if ids and (len(ids) == max_queries or held + size > MAX_NUMBERS):
            yield QueryBlock(ids, vectors)
            ids, vectors, held, made = [], [], 0, True
        ids.append(row[0])
        vectors.append(row[1])
        held += size
    if ids or not made:
        yield QueryBlock(ids, vectors)


def _run(queries: DataFrame, corpus: DataFrame, work: Callable, schema: ST.StructType, max_queries: int) -> DataFrame:
    """Apply ``work(block, batches)`` to every corpus part, in one pass for each query block.

    The driver holds two blocks at a time.  The last pass is part of the plan that is returned, the ones
    before it have written their rows.
    """
    corpus = corpus.select("doc_id", "embedding")
    scratch, written = Scratch(corpus.sparkSession, "vector-passes"), 0
    path = f"{scratch.path}/found"

    def one(block: QueryBlock) -> DataFrame:
        def part(batches):
            if block.ids:
                yield from work(block, batches)

        return corpus.mapInPandas(part, schema)

    last = None
    for block in _blocks(queries, max_queries):
        if last is not None:
            one(last).write.mode("append").parquet(path)
            written += 1
        last = block
    if not written:
        return one(last)
    return corpus.sparkSession.read.schema(schema).parquet(path).union(one(last))


def similarity_all(queries: DataFrame, corpus: DataFrame, max_queries: int = MAX_QUERIES) -> DataFrame:
    """Score of every corpus vector for every query: (query_id, doc_id, score)."""
    def work(block, batches):
        for pdf in batches:
            yield block.all_scores(pdf)

    return _run(queries, corpus, work, _schema(queries, corpus, False), max_queries)


def best_candidates(
    queries: DataFrame, corpus: DataFrame, k: int, max_queries: int = MAX_QUERIES, ranged: bool = True,
) -> DataFrame:
    """Best ``k`` per query of every corpus part, if ``ranged`` with the part's score range (lo, hi).

    Without the range, bounds rule out more: a ball far from a query is not looked at for its least score.
    """
    def work(block, batches):
        found = block.best(batches, k, ranged)
        if found is not None:
            yield found

    return _run(queries, corpus, work, _schema(queries, corpus, ranged), max_queries)


def pair_similarity(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add ``similarity`` to (query_id, doc_id) pairs; a missing vector scores 0.

    Pass pruned pairs as a written table: the corpus is joined with their ids first, so while their
    size allows it the pairs are broadcast and the vectors are only scanned.
    """
    ids = pairs.select("query_id", "doc_id")
    q = queries.select("query_id", F.col("embedding").alias("_q"))
    d = corpus.select("doc_id", F.col("embedding").alias("_d"))
    found = d.join(ids, "doc_id").join(q, "query_id").select(
        "query_id", "doc_id", F.round(cosine(F.col("_q"), F.col("_d")), DIGITS).alias("similarity"))
    return pairs.join(found, ["query_id", "doc_id"], "left").fillna(0.0, ["similarity"])
