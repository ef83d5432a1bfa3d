"""A lexical index of document shards in segments: append, delete, merge, and pruned top-k.

A segment is written once.  Its documents are dealt to shards by hash; a shard is one Parquet file of one
row group, so it is read by one task, and holds the postings of its documents only.  Inside a shard
documents are numbered by length and postings are cut into blocks of ``BLOCK`` numbers with their
largest term count.  With the length of the shortest document in the block that bounds every
score in it for any average length, so bounds stay right while the corpus grows.

``search`` sends the weighted query terms to the shards, in columns.  A task takes as candidates what holds one of
the terms a query needs to reach its bar, and looks up their other terms for many queries at once (``Batch``).  Where
those are too many it adds up the bounds of the query's blocks, scores blocks from the highest bound down and stops at
the first that cannot reach its k-th score.  About k rows per query and shard are exchanged.

Deleting writes tombstones and what the documents counted for in the term frequencies.  Merging
rewrites segments without their dead documents.  A small manifest names what is current; it is
written last, so readers see a change whole or not at all and a failed step may be repeated.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.functions import constants as K
from lectern.operators.index import document_terms, postings_of
from lectern.sources.tables import materialize

#: Documents of a block; postings of a shard, which a task holds in memory when it is written.  A small
#: segment gets a shard per core, of at least ``LEAST_POSTINGS``.
BLOCK, SHARD_POSTINGS, LEAST_POSTINGS = 64, 1_000_000, 50_000
#: (query, term) rows sent to the shards at once, and how many times the shards are read at most.
SENT_ROWS, MOST_PASSES = 1_000_000, 16
#: Queries of more rows first look for a bar in all shards: a second reading of the shards then pays.
BAR_ROWS = 20_000
#: Postings of its strongest term that a query looks at for a bar; (document, term) pairs looked up at once.
SEEDS, SLICE = 256, 500_000
#: Dead documents that are sent to the shards; segments with more are merged.
MOST_DEAD = 4_000_000
#: The row of a shard that holds its documents; no token is that short.
DOCUMENTS = ""


def _shard_schema(id_type: str) -> str:
    return (f"term string, df int, blocks array<int>, max_tf array<int>, starts array<int>, docs array<int>, "
            f"tfs array<int>, ids array<{id_type}>")


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    ends = np.append(starts, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def _inverted(table: pa.Table):
    """Shard rows from (doc_id, dl, terms): the documents first, then the terms in order."""
    dl = table.column("dl").to_numpy()
    order = np.argsort(dl, kind="stable")
    number = np.empty(len(dl), np.int64)
    number[order] = np.arange(len(dl))
    ids = table.column("doc_id").combine_chunks()
    id_list = pa.ListArray.from_arrays(pa.array([0, len(dl)], pa.int32()), ids.take(pa.array(order)))
    empty = pa.array([None], pa.list_(pa.int32()))
    names = ["term", "df", "blocks", "max_tf", "starts", "docs", "tfs", "ids"]
    yield pa.RecordBatch.from_arrays([
        pa.array([DOCUMENTS]), pa.array([len(dl)], pa.int32()), empty, empty, empty, empty,
        _lists(dl[order], np.array([0])), id_list], names=names)  # the lengths stand where terms have counts

    lists = table.column("terms").combine_chunks()
    flat = lists.flatten()
    if not len(flat):
        return
    coded = pc.cast(flat.field("term"), pa.string()).dictionary_encode()
    by_name = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(by_name), np.int64)
    place[by_name] = np.arange(len(by_name))
    term = place[coded.indices.to_numpy()]
    doc = np.repeat(number, pc.list_value_length(lists).fill_null(0).to_numpy())
    at = np.lexsort((doc, term))
    term, doc, tf = term[at], doc[at], flat.field("tf").to_numpy(zero_copy_only=False)[at]
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    block = doc // BLOCK
    opens = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
    largest = np.maximum.reduceat(tf, opens)
    inside = opens - np.repeat(first, np.diff(np.append(np.searchsorted(opens, first), len(opens))))
    blocks_at = np.searchsorted(opens, first)
    rows = pa.RecordBatch.from_arrays([
        coded.dictionary.take(pa.array(by_name)), pa.array(np.diff(np.append(first, len(term))).astype(np.int32)),
        _lists(block[opens], blocks_at), _lists(largest, blocks_at), _lists(inside, blocks_at),
        _lists(doc, first), _lists(tf, first), pa.nulls(len(first), id_list.type)], names=names)
    for k in range(0, rows.num_rows, 10_000):
        yield rows.slice(k, 10_000)


def _once(docs: DataFrame) -> DataFrame:
    """One row per doc_id.  Only ids are exchanged, and the rows of those ids that come more than once."""
    again = materialize(docs.groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).filter(
        "_n > 1").select("_again"), "arrived-again")
    if again.isEmpty():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    return docs.join(again, same, "left_anti").unionByName(
        docs.join(again, same, "left_semi").dropDuplicates(["doc_id"]))


def write_shards(doc_terms: DataFrame, path: str, shard_postings: int = SHARD_POSTINGS) -> None:
    """One file per shard of ``doc_terms`` (doc_id, dl, terms): one shuffle, of whole documents."""
    held = doc_terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    cores = doc_terms.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-held // shard_postings), min(cores, held // LEAST_POSTINGS))
    id_type = doc_terms.schema["doc_id"].dataType.simpleString()

    def invert(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            yield from _inverted(pa.Table.from_batches(got))

    dealt = doc_terms.select("doc_id", "dl", "terms").repartitionById(
        shards, F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    dealt.mapInArrow(invert, _shard_schema(id_type)).write.mode("overwrite").option(
        "parquet.block.size", 1 << 30).parquet(path)  # a file is one row group: no task reads part of a shard


# --- top-k inside a shard ----------------------------------------------------

def _between(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the stretches [start, end)."""
    n = ends - starts
    return np.repeat(starts - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


class Shard:
    """The postings of a shard that a query batch needs, as flat arrays over all its terms."""

    def __init__(self, ids: pa.Array, dl: np.ndarray, dead, avgdl: float, k1: float, b: float):
        self.ids, self.k1, self.parts, self.at = ids, k1, [], {}
        self.norm = k1 * (1 - b + b * dl / avgdl) if avgdl else np.full(len(dl), k1)
        self.lowest = self.norm[::BLOCK]
        self.live = None if dead is None else ~pc.is_in(ids, dead).to_numpy(zero_copy_only=False)
        self.scored = 0

    def add(self, rows: pa.RecordBatch) -> None:
        """Terms of the shard, as they were written."""
        self.parts.append(rows)

    def close(self) -> Shard:
        """Lay out what was added: per term a stretch of blocks, per block a stretch of postings."""
        if not self.parts:
            return self
        rows = pa.Table.from_batches(self.parts)
        self.parts = []

        def flat(name):  # a column at a time is copied
            return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column(name).chunks])

        per_term = pc.list_value_length(rows.column("blocks")).to_numpy()
        df = rows.column("df").to_numpy().astype(np.int64)
        ends, held = np.cumsum(per_term), np.cumsum(df)
        self.names = rows.column("term").combine_chunks()
        self.at = {t: (e - n, e) for t, e, n in zip(self.names.to_pylist(), ends.tolist(), per_term.tolist())}
        self.df, self.first = df, held - df
        self.block, self.doc = flat("blocks"), flat("docs")
        self.start = flat("starts") + np.repeat(held - df, per_term)
        self.end = np.append(self.start[1:], len(self.doc))
        top = flat("max_tf").astype(np.float64)
        self.top = top * (self.k1 + 1) / (top + self.lowest[self.block])
        tf = flat("tfs").astype(np.float64)
        del rows
        self.impact = tf * (self.k1 + 1) / (tf + self.norm[self.doc])
        self.peak = np.maximum.reduceat(self.top, ends - per_term)
        self.key = np.repeat(np.arange(len(df)), df) * len(self.norm) + self.doc
        return self

    def _of(self, terms: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Block entries of the query's terms and the weight of each."""
        held = [(*self.at[t], w) for t, w in terms if t in self.at]
        if not held:
            return np.zeros(0, np.int64), np.zeros(0)
        first, end, weight = (np.array(x) for x in zip(*held))
        return _between(first, end), np.repeat(weight, end - first)

    def _bounds(self, held) -> np.ndarray:
        entries, weight = held
        if not len(entries):
            return np.zeros(len(self.lowest))
        return np.bincount(self.block[entries], weight * self.top[entries], len(self.lowest))

    def _score(self, held, chosen: np.ndarray | None = None) -> np.ndarray:
        """Scores from all postings, or from those in the blocks ``chosen``."""
        entries, weight = held
        if chosen is not None and len(entries):
            take = chosen[self.block[entries]]
            entries, weight = entries[take], weight[take]
        if not len(entries):
            return np.zeros(len(self.norm))
        start, end = self.start[entries], self.end[entries]
        places = _between(start, end)
        self.scored += len(places)
        return np.bincount(self.doc[places], self.impact[places] * np.repeat(weight, end - start), len(self.norm))

    def above(self, terms: list[tuple[str, float]], floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of all documents that score at least ``floor``."""
        held = self._of(terms)
        score = self._score(held, self._bounds(held) + 1e-9 >= floor)
        found = (score > 0) & (score >= floor)
        rows = np.flatnonzero(found if self.live is None else found & self.live)
        return rows, score[rows]

    def extent(self, terms: list[tuple[str, float]]) -> tuple[int, float, float]:
        """Number of matching documents, their largest score and, if all match, their smallest."""
        held = self._of(terms)
        score = self._score(held)
        score = score if self.live is None else score[self.live]
        count = int(np.count_nonzero(score))
        if not count:
            return 0, 0.0, 0.0
        return count, score.max(), score.min() if count == len(score) else 0.0

    def best(self, terms: list[tuple[str, float]], k: int, digits: int, bar: float = -1.0):
        """Numbers and scores of the k best documents; blocks that cannot reach them, or ``bar``, are not scored."""
        held = self._of(terms)
        bound = self._bounds(held)
        order = np.flatnonzero((bound > 0) & (bound + 10.0**-digits >= bar))
        if not len(order):
            return order, np.zeros(0)
        order = order[np.argsort(-bound[order], kind="stable")]
        score = np.zeros(len(self.norm))
        best, step, at, least = np.zeros(0, np.int64), k // BLOCK + 8, 0, -1.0
        while at < len(order) and bound[order[at]] + 10.0**-digits >= least:
            chosen = np.zeros(len(bound), bool)
            chosen[order[at:at + step]] = True
            score = score + self._score(held, chosen)
            rows = (np.flatnonzero(chosen)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            rows = rows[rows < len(score)]
            rows = rows[score[rows] > 0]
            if self.live is not None:
                rows = rows[self.live[rows]]
            best = np.concatenate([best, rows])
            if len(best) >= k:
                rounded = np.round(score[best], digits)
                least = np.partition(rounded, len(best) - k)[len(best) - k]
                best = best[rounded >= least]
            at, step = at + step, step * 3
        if len(best) > k:  # equal scores: the smallest ids stay
            keys = [("score", "descending"), ("id", "ascending")]
            told = pa.table({"score": np.round(score[best], digits), "id": self.ids.take(pa.array(best)), "at": best})
            first = best[np.argmax(score[best])]
            best = told.sort_by(keys).slice(0, k).column("at").to_numpy()
            if first not in best:  # the largest score before rounding
                best = np.append(best, first)
        return best, score[best]


class Asked:
    """Weighted query terms of a pass in columns, by query, with a floor and the wanted documents of each."""

    def __init__(self, weighted: pa.Table, floors: pa.Table | None, wanted: pa.Table | None):
        coded = weighted.column("query_id").combine_chunks().dictionary_encode()
        q = coded.indices.to_numpy()
        order = np.argsort(q, kind="stable")
        terms = weighted.column("term").combine_chunks().dictionary_encode()
        self.ids, self.terms, self.q = coded.dictionary, terms.dictionary, q[order]
        self.t = terms.indices.to_numpy()[order]
        self.w = weighted.column("weight").to_numpy()[order].astype(np.float64)
        self.floor = None
        if floors is not None:  # NaN: not asked
            at, known = self._places(floors)
            self.floor = np.full(len(self.ids), np.nan)
            self.floor[at] = floors.column("floor").to_numpy()[known]
        if wanted is not None:
            self.wanted_q, known = self._places(wanted)
            self.wanted_doc = wanted.column("doc_id").combine_chunks().filter(pa.array(known))

    def _places(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        at = pc.index_in(rows.column("query_id").combine_chunks().cast(self.ids.type), value_set=self.ids).fill_null(-1).to_numpy()
        return at[at >= 0], at >= 0


class Batch:
    """All queries of a pass over one shard.

    A document that scores at least a bar holds one of the query's strongest terms: those without which the
    bounds of the others fall short of the bar.  Only their postings are candidates, and a candidate's other terms are
    looked up in the sorted postings, for many queries at once.  A query whose candidates are too many for that is
    scored by itself.
    """

    def __init__(self, shard: Shard, asked: Asked):
        self.shard, self.asked = shard, asked
        self.docs = len(shard.norm)
        place = np.full(len(asked.terms), -1)
        if shard.at:
            names = shard.names.cast(asked.terms.type)
            place = pc.index_in(asked.terms, value_set=names).fill_null(-1).to_numpy()
        o = place[asked.t].astype(np.int64)
        held = o >= 0
        self.q, self.o, self.w = asked.q[held], o[held], asked.w[held]
        self.first = np.searchsorted(self.q, np.arange(len(asked.ids) + 1))
        if shard.at:
            self.bound, self.df = self.w * shard.peak[self.o], shard.df[self.o]
        else:
            self.bound, self.df = np.zeros(0), np.zeros(0, np.int64)
        # rows of a query by falling bound
        self.strong = np.lexsort((-self.bound, self.q))
        ids = shard.ids
        self.order = ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else np.argsort(
            pc.sort_indices(ids).to_numpy())

    def terms(self, query: int) -> list[tuple[str, float]]:
        rows = slice(self.first[query], self.first[query + 1])
        return list(zip(self.shard.names.take(pa.array(self.o[rows])).to_pylist(), self.w[rows].tolist()))

    def scored(self, q: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores of (query, document) pairs."""
        out = np.zeros(len(q))
        if not self.shard.at:
            return out
        rows = self.first[q + 1] - self.first[q]
        ends = np.cumsum(rows)
        at = 0
        while at < len(q):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            pair = np.repeat(np.arange(end - at), rows[at:end])
            row = _between(self.first[q[at:end]], self.first[q[at:end] + 1])
            sought = self.o[row] * self.docs + doc[at:end][pair]
            place = np.minimum(np.searchsorted(self.shard.key, sought), len(self.shard.key) - 1)
            hit = self.shard.key[place] == sought
            out[at:end] = np.bincount(
                pair[hit], self.w[row[hit]] * self.shard.impact[place[hit]], end - at)
            at = end
        return out

    def pairs(self, rows: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Live (query, document) pairs of the postings of some rows, each once; of a row ``most`` at most."""
        start = self.shard.first[self.o[rows]]
        n = self.df[rows] if most is None else np.minimum(self.df[rows], most)
        doc = self.shard.doc[_between(start, start + n)].astype(np.int64)
        both = np.unique(np.repeat(self.q[rows], n).astype(np.int64) * self.docs + doc)
        q, doc = both // self.docs, both % self.docs
        if self.shard.live is None:
            return q, doc
        alive = self.shard.live[doc]
        return q[alive], doc[alive]

    def ranked(self, q, doc, score, k: int, digits: int):
        """The k best of every query, and the largest score as it is before rounding."""
        at = np.lexsort((self.order[doc], -np.round(score, digits), q))
        q, doc, score = q[at], doc[at], score[at]
        opens = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        size = np.diff(np.append(opens, len(q)))
        keep = np.arange(len(q)) - np.repeat(opens, size) < k
        if len(q):
            group = np.repeat(np.arange(len(opens)), size)
            top = np.flatnonzero(score == np.maximum.reduceat(score, opens)[group])
            keep[top[np.unique(group[top], return_index=True)[1]]] = True
        return q[keep], doc[keep], score[keep]

    def bars(self, k: int, digits: int) -> np.ndarray:
        """A score that the k-th best document of the shard has at least, per query; -1 where none is known."""
        bar = np.full(len(self.asked.ids), -1.0)
        if not len(self.q):
            return bar
        first = self.strong[self.first[:-1][np.diff(self.first) > 0]]
        q, doc = self.pairs(first, SEEDS + k)
        score = self.scored(q, doc)
        at = np.lexsort((-score, q))
        q, score = q[at], np.round(score[at], digits)
        opens = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        many = np.diff(np.append(opens, len(q))) >= k
        bar[q[opens[many]]] = score[opens[many] + k - 1]
        return bar

    def reaching(self, bar: np.ndarray, dense):
        """(query, document, score) arrays of all candidates for a bar per query (NaN: none asked).

        ``dense`` gives documents and scores of a query whose candidates are too many to be looked up.
        """
        if not len(self.q):
            return
        order = self.strong
        total = np.append(0.0, np.cumsum(self.bound[order]))
        q = self.q[order]
        # the bounds of a row and those after it; sums of many queries carry a rounding error far below 1e-6
        after = total[self.first[q + 1]] - total[:-1]
        rows = order[after + 1e-6 >= bar[q]]
        n = len(self.asked.ids)
        some = np.bincount(self.q[rows], self.df[rows], n)
        whole = np.bincount(self.q, self.df, n)
        heavy = some * np.diff(self.first) * 20 > whole + self.docs + 20_000
        for query in np.flatnonzero(heavy):
            doc, score = dense(self.terms(query), bar[query])
            yield np.full(len(doc), query), doc, score
        rows = rows[~heavy[self.q[rows]]]
        rows = rows[np.argsort(self.q[rows], kind="stable")]
        queries, opens = np.unique(self.q[rows], return_index=True)
        ends = np.append(opens[1:], len(rows))
        work = np.cumsum(some[queries] * np.diff(self.first)[queries])
        at = 0
        while at < len(queries):
            end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + SLICE, "right")))
            q, doc = self.pairs(rows[opens[at]:ends[end - 1]])
            score = self.scored(q, doc)
            found = score > 0
            yield q[found], doc[found], score[found]
            at = end

    def best(self, k: int, digits: int):
        # the floors of a first reading are the best bars of all shards, this one's among them
        bar = self.bars(k, digits) if self.asked.floor is None else np.nan_to_num(self.asked.floor, nan=-1.0)
        for q, doc, score in self.reaching(bar - 2 * 10.0**-digits, lambda terms, least: self.shard.best(terms, k, digits, least)):
            yield self.ranked(q, doc, score, k, digits)

    def above(self):
        floor = self.asked.floor
        for q, doc, score in self.reaching(floor, self.shard.above):
            reached = score >= floor[q]
            yield q[reached], doc[reached], score[reached]

    def covered(self) -> Iterator[tuple[int, int, float]]:
        """(query, documents, least score) where all live documents have a term of the query."""
        live = np.arange(self.docs) if self.shard.live is None else np.flatnonzero(self.shard.live)
        open_ = np.bincount(self.q, self.df, len(self.asked.ids)) >= max(len(live), 1)
        for doc in live[:8]:  # short documents seldom match: most queries are settled by one
            queries = np.flatnonzero(open_)
            open_[queries] = self.scored(queries, np.full(len(queries), doc)) > 0
        for query in np.flatnonzero(open_):
            count, _, low = self.shard.extent(self.terms(query))
            if 0 < count == len(live):
                yield query, count, low

    def looked_up(self):
        """Those of the wanted pairs whose document is in the shard and alive."""
        doc = pc.index_in(self.asked.wanted_doc.cast(self.shard.ids.type), value_set=self.shard.ids).fill_null(-1).to_numpy()
        here = doc >= 0 if self.shard.live is None else (doc >= 0) & self.shard.live[doc]
        q, doc = self.asked.wanted_q[here], doc[here].astype(np.int64)
        return q, doc, self.scored(q, doc)


def _shards(batches, dead, avgdl, k1, b):
    """The shards of a task, one after the other: a documents row begins each.

    One is in memory at a time, if the caller lets go of it before asking for the next.
    """
    shard = None
    for batch in batches:
        opens = np.flatnonzero(pc.equal(batch.column("term"), DOCUMENTS).to_numpy(zero_copy_only=False)).tolist()
        if shard is not None:
            shard.add(batch.slice(0, opens[0] if opens else batch.num_rows))
        for i, end in zip(opens, [*opens[1:], batch.num_rows]):
            if shard is not None:
                yield shard.close()
                shard = None
            ids, dl = batch.column("ids")[i].values, batch.column("tfs")[i].values.to_numpy()
            gone = dead.get(batch.column("segment")[i].as_py())
            shard = Shard(ids, dl, None if gone is None else pa.array(gone, ids.type), avgdl, k1, b)
            shard.add(batch.slice(i + 1, end - i - 1))
    if shard is not None:
        yield shard.close()


# --- the index ---------------------------------------------------------------

@dataclass(frozen=True)
class SegmentedIndex:
    """Tables of an index under ``folder`` as of one manifest.

    ``segments``: name -> (documents, tokens).  ``deletes``: name -> {segment: (documents, tokens)}.
    It has the tables of ``TextIndex`` as well (postings, terms, lengths, stats), of live documents.
    """

    spark: SparkSession
    folder: str
    id_type: str
    version: int = 0
    segments: dict = field(default_factory=dict)
    deletes: dict = field(default_factory=dict)
    buckets: int = 0

    # the manifest is written to two folders in turn: the one before stays whole while one is written
    def _save(self) -> SegmentedIndex:
        text = json.dumps({k: getattr(self, k) for k in ("id_type", "version", "segments", "deletes")})
        row = self.spark.range(1).select(F.lit(text).alias("value"))
        for turn in [self.version % 2] if self.version else [0, 1]:
            row.write.mode("overwrite").text(f"{self.folder}/manifest-{turn}")
        return self

    @staticmethod
    def create(spark: SparkSession, folder: str, id_type: str = "bigint") -> SegmentedIndex:
        return SegmentedIndex(spark, folder, id_type)._save()

    @staticmethod
    def load(spark: SparkSession, folder: str) -> SegmentedIndex:
        held = spark.read.text([f"{folder}/manifest-{turn}" for turn in (0, 1)]).collect()  # two rows
        newest = max((json.loads(r["value"]) for r in held), key=lambda m: m["version"])
        return SegmentedIndex(spark, folder, **newest)

    @staticmethod
    def build(docs: DataFrame, folder: str, **sizes) -> SegmentedIndex:
        """An index of one segment from (doc_id, text)."""
        kind = docs.schema["doc_id"].dataType.simpleString()
        return SegmentedIndex.create(docs.sparkSession, folder, kind).append(docs, "s0", **sizes)

    def _next(self, segments: dict, deletes: dict) -> SegmentedIndex:
        deletes = {d: {s: n for s, n in of.items() if s in segments} for d, of in deletes.items()}
        deletes = {d: of for d, of in deletes.items() if of}
        return SegmentedIndex(self.spark, self.folder, self.id_type, self.version + 1, segments, deletes)._save()

    def _table(self, name: str, segments=None) -> DataFrame:
        names = [f"{self.folder}/{name}/segment={s}" for s in (self.segments if segments is None else segments)]
        schema = {
            "doc_terms": f"doc_id {self.id_type}, dl int, terms array<struct<term:string,tf:int>>",
            "shards": _shard_schema(self.id_type), "df": "term string, df bigint"}[name] + ", segment string"
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*names)

    def _deleted(self, name: str) -> DataFrame | None:
        """Rows that deletes wrote about segments that still exist; None without deletes."""
        if not self.deletes:
            return None
        paths = [f"{self.folder}/{name}/delete={d}" for d in self.deletes]
        return self.spark.read.parquet(*paths).filter(F.col("segment").isin(list(self.segments)))

    def live(self, columns: list[str], segments=None) -> DataFrame:
        """Columns of the forward table, for documents that are not deleted."""
        rows, gone = self._table("doc_terms", segments), self._deleted("tombstones")
        if gone is not None:
            rows = rows.join(gone.select("segment", "doc_id"), ["segment", "doc_id"], "left_anti")
        return rows.select(*columns)

    @property
    def postings(self) -> DataFrame:
        return postings_of(self.live(["doc_id", "dl", "terms"]))

    @property
    def lengths(self) -> DataFrame:
        return self.live(["doc_id", "dl"])

    @property
    def terms(self) -> DataFrame:
        """(term, df): the counts kept with segments less those kept with deletes."""
        counts, gone = self._table("df").select("term", "df"), self._deleted("lost_df")
        if gone is None and len(self.segments) == 1:  # a segment has a row per term
            return counts
        if gone is not None:
            counts = counts.unionByName(gone.select("term", (-F.col("df")).alias("df")))
        return counts.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    @property
    def totals(self) -> tuple[int, int]:
        """(documents, tokens) alive, from the manifest."""
        gone = [n for of in self.deletes.values() for n in of.values()]
        return tuple(sum(s[i] for s in self.segments.values()) - sum(g[i] for g in gone) for i in (0, 1))

    @property
    def stats(self) -> DataFrame:
        n, tokens = self.totals
        return self.spark.range(1).select(
            F.lit(n).cast("bigint").alias("n"), F.lit(tokens / max(n, 1)).alias("avgdl"))

    def _write_segment(self, doc_terms: DataFrame, name: str, shard_postings: int) -> tuple[int, int]:
        path = f"doc_terms/segment={name}"
        doc_terms.write.mode("overwrite").parquet(f"{self.folder}/{path}")
        held = self._table("doc_terms", [name])
        write_shards(held, f"{self.folder}/shards/segment={name}", shard_postings)
        counts = self._table("shards", [name]).filter(F.col("term") != DOCUMENTS).groupBy("term").agg(
            F.sum("df").alias("df"))
        counts.write.mode("overwrite").parquet(f"{self.folder}/df/segment={name}")
        row = held.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return row[0], row[1]

    def append(self, docs: DataFrame, name: str, shard_postings: int = SHARD_POSTINGS) -> SegmentedIndex:
        """Add the documents (doc_id, text) as segment ``name``; earlier versions of them are deleted.

        Of two rows with one id either may stay.  A name that is there already leaves the index as it is, so
        a batch may be repeated after a failure.
        """
        if name in self.segments:
            return self
        told = self._write_segment(document_terms(_once(docs)), name, shard_postings)
        fresh = self._table("doc_terms", [name]).select("doc_id")
        gone = self._write_deletes(fresh, name)
        return self._next(self.segments | {name: told}, self.deletes | ({name: gone} if gone else {}))

    def _write_deletes(self, removed: DataFrame, name: str) -> dict:
        """Tombstones and lost counts of the live documents in ``removed`` (doc_id)."""
        if not self.segments:
            return {}
        ids = removed.select("doc_id").distinct()
        path = f"{self.folder}/tombstones/delete={name}"
        self.live(["segment", "doc_id", "dl", "terms"]).join(ids, "doc_id", "left_semi").write.mode("overwrite").parquet(path)
        dead = self.spark.read.parquet(path)
        lost = dead.select("segment", F.inline("terms")).groupBy("segment", "term").agg(F.count("*").alias("df"))
        lost.write.mode("overwrite").parquet(f"{self.folder}/lost_df/delete={name}")
        counted = dead.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).collect()
        return {r["segment"]: (r["n"], r["tokens"]) for r in counted}  # a row per segment

    def delete(self, removed: DataFrame, name: str, most_dead: int = MOST_DEAD) -> SegmentedIndex:
        """Delete the documents in ``removed`` (doc_id); segments are merged once tombstones are too many."""
        if name in self.deletes:
            return self
        gone = self._write_deletes(removed, name)
        index = self._next(self.segments, self.deletes | {name: gone}) if gone else self
        return index.settle(f"m-{name}", most_dead=most_dead)

    def settle(self, name: str, most_segments: int = 8, most_dead: int = MOST_DEAD) -> SegmentedIndex:
        """Merge what has become too much: all segments with dead documents, or the smaller half."""
        dead = {s: n for of in self.deletes.values() for s, n in of.items()}
        if sum(n[0] for of in self.deletes.values() for n in of.values()) > most_dead:
            return self.merge(list(dead), name)
        if len(self.segments) > most_segments:
            by_size = sorted(self.segments, key=lambda s: self.segments[s][1])
            return self.merge(by_size[: len(by_size) // 2 + 1], name)
        return self

    def merge(self, segments: list[str], name: str, shard_postings: int = SHARD_POSTINGS) -> SegmentedIndex:
        """Rewrite ``segments`` as one without dead documents; their files are no longer named."""
        told = self._write_segment(self.live(["doc_id", "dl", "terms"], segments), name, shard_postings)
        left = {s: n for s, n in self.segments.items() if s not in segments}
        return self._next(left | {name: told}, self.deletes)

    def search(self, weighted: DataFrame, k: int, digits: int, floors: DataFrame | None = None,
               k1: float = K.BM25_K1, b: float = K.BM25_B, sent_rows: int = SENT_ROWS,
               most_passes: int = MOST_PASSES, bar_rows: int = BAR_ROWS) -> DataFrame | None:
        """(query_id, doc_id, score): the k best of all documents for (query_id, term, weight) rows, and some others.

        A shard gives its k best and one with its largest score.  More than ``bar_rows`` rows are asked twice: first for
        a score that the k best have at least, so that shards without such documents are soon done.
        With ``floors`` (query_id, floor) it is every document of at least that score instead, for these queries
        alone.  The shards are read once per ``sent_rows`` rows; None if that were more than ``most_passes`` times.
        """
        def best(batch):
            yield from batch.best(k, digits)

        def above(batch):
            yield from batch.above()

        if floors is not None:
            found = self._passes(weighted, above, floors, None, k1, b, sent_rows, most_passes)
            return None if found is None else found.drop("matched")
        if bar_rows < weighted.count():
            def seeds(batch):
                bar = batch.bars(k, digits)
                known = np.flatnonzero(bar > 0)
                yield known, None, bar[known]

            known = self._passes(weighted, seeds, None, None, k1, b, sent_rows, most_passes)
            if known is None:
                return None
            floors = materialize(known.groupBy("query_id").agg(F.max("score").alias("floor")), "bars")
        found = self._passes(weighted, best, floors, None, k1, b, sent_rows, most_passes)
        return None if found is None else found.drop("matched")

    def survey(self, weighted: DataFrame, wanted: DataFrame, k1: float = K.BM25_K1, b: float = K.BM25_B,
               sent_rows: int = SENT_ROWS, most_passes: int = MOST_PASSES) -> DataFrame | None:
        """What blending needs of every query, in one pass: (query_id, doc_id, score, matched).

        A row without doc_id tells of a shard all whose documents have a term of the query: their number and
        smallest score.  The other rows are the scores of ``wanted`` (query_id, doc_id).
        """
        def work(batch):
            told = list(batch.covered())
            if told:
                q, matched, low = zip(*told)
                yield np.array(q), None, np.array(low), np.array(matched)
            yield batch.looked_up()

        return self._passes(weighted, work, None, wanted, k1, b, sent_rows, most_passes)

    @staticmethod
    def passes(weighted: DataFrame, sent_rows: int = SENT_ROWS, most_passes: int = MOST_PASSES) -> int:
        """How often the shards are to be read for these (query, term) rows; 0 if too often."""
        passes = max(1, -(-weighted.count() // sent_rows))
        return passes if passes <= most_passes else 0

    def _passes(self, weighted, work, floors, wanted, k1, b, sent_rows, most_passes) -> DataFrame | None:
        passes = self.passes(weighted, sent_rows, most_passes)
        if not passes:
            return None
        n, tokens = self.totals
        dead = defaultdict(list)
        gone = self._deleted("tombstones")
        if gone is not None:
            for r in gone.select("segment", "doc_id").toLocalIterator():  # at most MOST_DEAD rows
                dead[r["segment"]].append(r["doc_id"])
        key = weighted.schema["query_id"].dataType
        schema = f"query_id {key.simpleString()}, doc_id {self.id_type}, score double, matched bigint"
        arrow = to_arrow_type(key)

        def part_of(rows, p):  # about ``sent_rows`` rows; a floor and some wanted documents per query
            return None if rows is None else rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).toArrow()

        def one_pass(p):
            asked = Asked(part_of(weighted, p), part_of(floors, p), part_of(wanted, p))
            sent = self.spark.sparkContext.broadcast((vars(asked), dict(dead)))  # columns: a class would not be found by executors
            names = pa.concat_arrays([asked.terms.cast(pa.string()), pa.array([DOCUMENTS])])
            rows = self.spark.createDataFrame(pa.table({"term": names}))

            def run(batches):
                asked, dead = Asked.__new__(Asked), sent.value[1]
                vars(asked).update(sent.value[0])
                for shard in _shards(batches, dead, tokens / max(n, 1), k1, b):
                    ids = shard.ids
                    told = work(Batch(shard, asked))
                    del shard
                    for q, docs, scores, *matched in told:
                        if len(q):
                            none = pa.nulls(len(q), pa.int64())
                            yield pa.RecordBatch.from_arrays([
                                asked.ids.take(pa.array(q)).cast(arrow),
                                pa.nulls(len(q), ids.type) if docs is None else ids.take(pa.array(docs)),
                                pa.array(scores, pa.float64()), pa.array(matched[0], pa.int64()) if matched else none],
                                names=["query_id", "doc_id", "score", "matched"])
                    del told

            return self._table("shards").join(F.broadcast(rows), "term", "left_semi").mapInArrow(run, schema)

        found = one_pass(0)
        for p in range(1, passes):
            found = found.unionByName(one_pass(p))
        return found
