"""Documents to chunks.

Folds run inside the document row and carry sentence numbers, not text: a chunk
is always a contiguous range of the document's sentences, so the text is cut
once at the end and the fold state stays a few integers.  The neighbour operators
(overlap, merge) come twice: ``overlapped`` and ``merged`` work on the chunk array inside the
document row and need no exchange; ``context_overlap`` and ``merge_small_chunks`` do the same for
chunk tables, whose rows of one document have to be brought side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T

HEADINGS = ["chapter", "section", "subsection"]
SIZED = ["paragraph", "listItem"]
CHUNK_COLUMNS = [
    "doc_id", "chunk_idx", "id", "text", "source", "page", "section", "chapter",
    "start_index", "end_index", "sentence_count", "word_count",
    "preceding_context", "following_context",
]
_RANGE = "struct<first:int,last:int,section:string,chapter:string,page:int,idx:int,start:int>"
_STATE = (
    "struct<first:int,last:int,words:int,section:string,chapter:string,page:int,"
    f"idx:int,start:int,out:array<{_RANGE}>>"
)


def sizes(target: int = K.TARGET_WORDS) -> tuple[int, int, int]:
    """(target, min, max) words of a chunk."""
    return target, max(50, target // 4), target * 2


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _take_until_full(counts: Column, target: int, min_words: int) -> Column:
    """How many leading sentences fit before the target, once the minimum is reached."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc, w):
        full = acc["full"] | ((acc["words"] + w > target) & (acc["words"] >= min_words))
        return F.struct(
            F.when(full, acc["words"]).otherwise(acc["words"] + w).alias("words"),
            F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"),
            full.alias("full"),
        )

    return F.aggregate(counts, zero, step, lambda acc: acc["n"])


def split_at_sentence(text: Column, target: int, min_words: int) -> Column:
    """struct(chunk, remainder) cut at a sentence boundary near the target size."""

    def cut(sents):
        n = _take_until_full(F.transform(sents, T.word_count), target, min_words)
        return T.let(n, lambda k: F.struct(
            F.array_join(F.slice(sents, F.lit(1), k), "").alias("chunk"),
            F.array_join(F.slice(sents, k + 1, F.size(sents)), "").alias("remainder"),
        ))

    return T.let(T.sentences(text), cut)


def _sentence_ranges(
    elements: Column, nested: Column, flat: Column, target: int, min_words: int
) -> Column:
    """Fold the elements into chunk ranges over the document's sentence list."""
    steps = F.transform(elements, lambda e, i: F.struct(
        e["type"].alias("type"), e["text"].alias("text"), e["page"].alias("page"),
        F.size(F.get(nested, i)).alias("n"),
        F.when(e["type"].isin(HEADINGS), 0).otherwise(T.word_count(e["text"])).alias("words"),
    ))
    counts = F.transform(flat, T.word_count)
    # 1 where a sentence runs into the one before it without a space between them
    glued = F.transform(flat, lambda s, i: F.when(
        (i > 0) & ~F.endswith(F.get(flat, i - 1), F.lit(" ")) & ~F.startswith(s, F.lit(" ")), 1
    ).otherwise(0))

    def fold(side):
        counts, glued = side["counts"], side["glued"]

        def words_between(first, last):
            n = last - first
            return F.when(n <= 0, 0).otherwise(
                _sum(F.slice(counts, first + 1, n)) - _sum(F.slice(glued, first + 2, n))
                + F.when(last < F.size(glued), F.get(glued, last)).otherwise(0)
            )

        def step(acc, e):
            chapter = e["type"] == "chapter"
            section = e["type"].isin("section", "subsection")
            pending = acc["last"] > acc["first"]
            new_last = acc["last"] + e["n"]
            new_words = F.when(e["n"] == 0, acc["words"]).otherwise(
                acc["words"] + e["words"] - F.when(pending, 1).otherwise(0)
            )
            page = F.when(
                e["type"].isin(SIZED), F.coalesce(acc["page"], e["page"])
            ).otherwise(acc["page"])
            flush = pending & (chapter | (section & (acc["words"] >= min_words)))
            split = e["type"].isin(SIZED) & (new_words >= target)
            taken = F.when(split, acc["first"] + _take_until_full(
                F.slice(counts, acc["first"] + 1, new_last - acc["first"]), target, min_words
            )).otherwise(new_last)

            def settle(cut):
                emitted = F.struct(
                    acc["first"], cut, acc["section"], acc["chapter"], page,
                    acc["idx"], acc["start"],
                ).cast(_RANGE)
                done = flush | split
                idx = acc["idx"] + done.cast("int")
                return F.struct(
                    F.when(flush | split, cut).otherwise(acc["first"]),
                    new_last,
                    F.when(flush, 0).when(split, words_between(cut, new_last))
                    .otherwise(new_words),
                    F.when(chapter, F.lit(None)).when(section, e["text"])
                    .otherwise(acc["section"]),
                    F.when(chapter, e["text"]).otherwise(acc["chapter"]),
                    F.when(chapter, e["page"])
                    .when(section, F.coalesce(e["page"], acc["page"])).otherwise(page),
                    idx,
                    F.when(chapter | done, idx).otherwise(acc["start"]),
                    F.when(done, F.array_append(acc["out"], emitted)).otherwise(acc["out"]),
                ).cast(_STATE)

            return T.let(taken, settle)

        def finish(acc):
            keep = (acc["last"] > acc["first"]) & (acc["words"] >= min_words // 2)
            tail = F.struct(
                acc["first"], acc["last"], acc["section"], acc["chapter"], acc["page"],
                acc["idx"], acc["start"],
            ).cast(_RANGE)
            return F.when(keep, F.array_append(acc["out"], tail)).otherwise(acc["out"])

        zero = F.struct(
            *[F.lit(0)] * 3, *[F.lit(None)] * 3, F.lit(0), F.lit(0), F.array()
        ).cast(_STATE)
        return F.aggregate(steps, zero, step, finish)

    return T.let(F.struct(counts.alias("counts"), glued.alias("glued")), fold)


def chunk_array(elements: Column, target: int = K.TARGET_WORDS) -> Column:
    """array<struct> of chunks of one document, from its ordered elements."""
    target, min_words, _ = sizes(target)
    nested = F.transform(elements, lambda e: F.when(
        e["type"].isin(HEADINGS), F.array().cast("array<string>")
    ).otherwise(T.sentences(F.concat(e["text"], F.lit("\n\n")))))

    def cut(nested, flat):
        return F.transform(
            _sentence_ranges(elements, nested, flat, target, min_words),
            lambda r: F.struct(
                T.strip(F.array_join(
                    F.slice(flat, r["first"] + 1, r["last"] - r["first"]), ""
                )).alias("text"),
                r["page"].alias("page"), r["section"].alias("section"),
                r["chapter"].alias("chapter"), r["start"].alias("start_index"),
                r["idx"].alias("end_index"),
            ),
        )

    return T.let(nested, lambda n: T.let(F.flatten(n), lambda flat: cut(n, flat)))


def finalize_chunks(chunks: DataFrame) -> DataFrame:
    """Id and counts of trimmed chunk texts; the chunk's number is its end index."""
    return chunks.select(
        "doc_id",
        F.col("end_index").alias("chunk_idx"),
        F.concat_ws("_", F.replace(F.col("source"), F.lit(" "), F.lit("_")),
                    F.col("end_index").cast("string")).alias("id"),
        "text", "source", "page", "section", "chapter", "start_index", "end_index",
        T.sentence_count(F.col("text")).alias("sentence_count"),
        T.word_count(F.col("text")).alias("word_count"),
        F.lit(None).cast("string").alias("preceding_context"),
        F.lit(None).cast("string").alias("following_context"),
    )


def semantic_chunks(docs: DataFrame, target: int = K.TARGET_WORDS) -> DataFrame:
    """Chunks of documents given as (doc_id, source, elements); no shuffle."""
    cut = docs.select(
        "doc_id", "source", F.inline(chunk_array(F.col("elements"), target))
    )
    return finalize_chunks(cut)


def _pack(counts: Column, target: int, max_words: int, min_words: int) -> Column:
    """Ranges of paragraphs for ``paragraph_chunks``."""
    rng = "struct<first:int,last:int>"
    state = f"struct<first:int,last:int,words:int,out:array<{rng}>>"

    def step(acc, w):
        over = (acc["last"] > acc["first"]) & (acc["words"] + w > max_words)
        first = F.when(over, acc["last"]).otherwise(acc["first"])
        empty = first == acc["last"]
        words = F.when(empty, w).otherwise(acc["words"] + w - 1)
        full = words >= target
        last = acc["last"] + 1
        closed = F.concat(
            acc["out"],
            F.when(over, F.array(F.struct(acc["first"], acc["last"]).cast(rng)))
            .otherwise(F.array().cast(f"array<{rng}>")),
            F.when(full, F.array(F.struct(first, last).cast(rng)))
            .otherwise(F.array().cast(f"array<{rng}>")),
        )
        return F.struct(
            F.when(full, last).otherwise(first), last,
            F.when(full, 0).otherwise(words), closed,
        ).cast(state)

    def finish(acc):
        keep = (acc["last"] > acc["first"]) & (acc["words"] >= min_words)
        tail = F.struct(acc["first"], acc["last"]).cast(rng)
        return F.when(keep, F.array_append(acc["out"], tail)).otherwise(acc["out"])

    zero = F.struct(F.lit(0), F.lit(0), F.lit(0), F.array()).cast(state)
    return F.aggregate(counts, zero, step, finish)


def _join_range(parts: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(parts, first + 1, last - first), "\n\n")


def paragraph_chunks(docs: DataFrame, target: int = K.TARGET_WORDS) -> DataFrame:
    """Pack the paragraphs of (doc_id, source, page, text) whole; a short tail is dropped."""
    target, min_words, max_words = sizes(target)

    def cut(pars):
        counts = F.transform(pars, T.word_count)
        return F.transform(
            _pack(counts, target, max_words, min_words),
            lambda r, i: F.struct(
                _join_range(pars, r["first"], r["last"]).alias("text"),
                F.lit(None).cast("string").alias("section"),
                F.lit(None).cast("string").alias("chapter"),
                i.alias("start_index"), i.alias("end_index"),
            ),
        )

    packed = T.let(T.paragraphs(F.col("text")), cut)
    return finalize_chunks(docs.select("doc_id", "source", "page", F.inline(packed)))


def pack_paragraphs(docs: DataFrame, target: int = 150) -> DataFrame:
    """Simple packer over blank-line blocks of (doc_id, source, text); the tail is kept.

    A block that opens with "Chapter" sets the label before the size check, so the
    chunk closed by that block already carries the new label.
    """
    rng = "struct<first:int,last:int,section:string>"
    state = f"struct<first:int,last:int,words:int,section:string,out:array<{rng}>>"

    def step(acc, block):
        section = F.when(
            F.startswith(block, F.lit("Chapter")), F.substring_index(block, "\n", 1)
        ).otherwise(acc["section"])
        w = T.word_count(block)
        over = (acc["last"] > acc["first"]) & (acc["words"] + w > target)
        fresh = over | (acc["last"] == acc["first"])
        return F.struct(
            F.when(over, acc["last"]).otherwise(acc["first"]),
            acc["last"] + 1,
            F.when(fresh, w).otherwise(acc["words"] + w - 1),
            section,
            F.when(over, F.array_append(
                acc["out"], F.struct(acc["first"], acc["last"], section).cast(rng)
            )).otherwise(acc["out"]),
        ).cast(state)

    def finish(acc):
        tail = F.struct(acc["first"], acc["last"], acc["section"]).cast(rng)
        return F.when(
            acc["last"] > acc["first"], F.array_append(acc["out"], tail)
        ).otherwise(acc["out"])

    def cut(blocks):
        zero = F.struct(F.lit(0), F.lit(0), F.lit(0), F.lit(None), F.array()).cast(state)
        return F.transform(
            F.aggregate(blocks, zero, step, finish),
            lambda r: F.struct(
                _join_range(blocks, r["first"], r["last"]).alias("text"),
                r["section"].alias("section"),
            ),
        )

    blocks = F.array_remove(F.transform(F.split(F.col("text"), "\n\n"), T.strip), "")
    packed = docs.select("doc_id", "source", F.posexplode(T.let(blocks, cut)).alias("n", "c"))
    return packed.select(
        "doc_id", "source", F.col("n").alias("chunk_idx"), F.col("c.text").alias("text"),
        F.col("c.section").alias("section"), T.word_count(F.col("c.text")).alias("word_count"),
    )


def edge_sentences(text: Column, n: int) -> Column:
    """struct(head, tail): the first and the last ``n`` sentences."""
    return T.let(T.sentences(text), lambda s: F.struct(
        F.array_join(F.slice(s, 1, n), "").alias("head"),
        F.array_join(F.slice(s, F.greatest(F.size(s) - n, F.lit(0)) + 1, n), "").alias("tail"),
    ))


def context_overlap(chunks: DataFrame, n: int = K.OVERLAP_SENTENCES) -> DataFrame:
    """Last ``n`` sentences of the chunk before and first ``n`` of the one after.

    The snippets are cut before the exchange; where there is no neighbour the
    existing context stays.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_idx")
    cols = [c for c in chunks.columns if c not in ("preceding_context", "following_context")]
    edges = chunks.withColumn("_e", edge_sentences(F.col("text"), n))
    before, after = F.lag("_e").over(w), F.lead("_e").over(w)
    return edges.select(
        *cols,
        F.coalesce(before["tail"], "preceding_context").alias("preceding_context"),
        F.coalesce(after["head"], "following_context").alias("following_context"),
    )


def merge_small_chunks(chunks: DataFrame, min_words: int) -> DataFrame:
    """Fold small chunks into the chunk before them; a result under half the minimum goes.

    A chunk of at least ``min_words`` opens an island, as does the first of its
    document.  Sequences are per document.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_idx")
    whole = Window.partitionBy("doc_id")
    island = F.sum((F.col("word_count") >= min_words).cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    marked = chunks.withColumn("_island", island).withColumn("_n", F.count("*").over(whole))
    at = F.col("chunk_idx")
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", "text")))
    first = F.struct("id", "source", "page", "start_index", "preceding_context")
    last = F.struct("end_index", "following_context")
    merged = marked.groupBy("doc_id", "_island", "_n").agg(
        F.min("chunk_idx").alias("chunk_idx"),
        F.array_join(F.transform(parts, lambda r: r["text"]), "\n\n").alias("text"),
        F.min_by(first, at).alias("_first"), F.max_by(last, at).alias("_last"),
        F.min_by("section", F.when(F.col("section").isNotNull(), at)).alias("section"),
        F.min_by("chapter", F.when(F.col("chapter").isNotNull(), at)).alias("chapter"),
        F.sum("sentence_count").cast("int").alias("sentence_count"),
    ).select(
        "doc_id", "chunk_idx", "_first.id", "text", "_first.source", "_first.page", "section",
        "chapter", "_first.start_index", "_last.end_index", "sentence_count",
        T.word_count(F.col("text")).alias("word_count"),
        "_first.preceding_context", "_last.following_context", "_n",
    )
    return merged.filter((F.col("word_count") >= min_words // 2) | (F.col("_n") == 1)).drop("_n")


_ROW = ["chunk_idx", "id", "text", "page", "section", "chapter", "start_index", "end_index",
        "sentence_count", "word_count", "preceding_context", "following_context"]


def _row(given: Column, **changed: Column) -> Column:
    """A chunk of the array with some fields changed."""
    return F.struct(*[changed.get(c, given[c]).alias(c) for c in _ROW])


def finalized(cut: Column, source: Column) -> Column:
    """``finalize_chunks`` for the array that ``chunk_array`` gives."""
    none = F.lit(None).cast("string")
    return F.transform(cut, lambda c: F.struct(
        c["end_index"].alias("chunk_idx"),
        F.concat_ws("_", F.replace(source, F.lit(" "), F.lit("_")), c["end_index"].cast("string")).alias("id"),
        *[c[x].alias(x) for x in ("text", "page", "section", "chapter", "start_index", "end_index")],
        T.sentence_count(c["text"]).alias("sentence_count"), T.word_count(c["text"]).alias("word_count"),
        none.alias("preceding_context"), none.alias("following_context")))


def overlapped(chunks: Column, n: int = K.OVERLAP_SENTENCES) -> Column:
    """``context_overlap`` inside the document's chunk array."""
    def put(cs, edges):
        return F.transform(cs, lambda c, i: _row(
            c, preceding_context=F.coalesce(F.get(edges, i - 1)["tail"], c["preceding_context"]),
            following_context=F.coalesce(F.get(edges, i + 1)["head"], c["following_context"])))

    def with_edges(cs):
        edges = F.transform(cs, lambda c: T.let(edge_sentences(c["text"], n), lambda e: F.struct(
            e["head"].alias("head"), e["tail"].alias("tail"))))
        return T.let(edges, lambda e: put(cs, e))

    return T.let(chunks, with_edges)


def merged(chunks: Column, min_words: int) -> Column:
    """``merge_small_chunks`` inside the document's chunk array."""
    def known(part, name):
        return F.get(F.filter(F.transform(part, lambda c: c[name]), lambda x: x.isNotNull()), F.lit(0))

    def island(part):
        first, last = F.get(part, F.lit(0)), F.get(part, F.size(part) - 1)
        text = F.array_join(F.transform(part, lambda c: c["text"]), "\n\n")
        return T.let(text, lambda t: _row(
            first, text=t, section=known(part, "section"), chapter=known(part, "chapter"),
            end_index=last["end_index"], following_context=last["following_context"],
            sentence_count=_sum(F.transform(part, lambda c: c["sentence_count"])), word_count=T.word_count(t)))

    def fold(cs):
        numbers = F.transform(cs, lambda c, i: F.when((i == 0) | (c["word_count"] >= min_words), i))

        def cut(starts):
            grown = F.transform(starts, lambda s, j: island(F.slice(
                cs, s + 1, F.coalesce(F.get(starts, j + 1), F.size(cs)) - s)))
            return F.filter(grown, lambda c: (c["word_count"] >= min_words // 2) | (F.size(cs) == 1))

        return T.let(F.array_compact(numbers), cut)

    return T.let(chunks, fold)


def starts_mid_sentence(text: Column) -> Column:
    return T.starts_lower(T.strip(text))


def ends_mid_sentence(text: Column) -> Column:
    return ~T.strip(text).rlike("[.!?\"'“”‘’]$")


def repair_mid_sentence(chunks: DataFrame) -> DataFrame:
    """Prepend the preceding context to a chunk that starts mid-sentence.

    Adds ``was_merged`` and ``was_marked``; what still starts mid-sentence gets a
    ``[...]`` prefix.  Counts are taken again.
    """
    both = F.struct(T.strip(F.col("text")).alias("body"), T.strip(F.col("preceding_context")).alias("before"))

    def join(b):
        merge = T.starts_lower(b["body"]) & F.coalesce(b["before"] != "", F.lit(False))
        glued = F.concat(b["before"], F.lit(" "), b["body"])
        glued = F.replace(glued, F.lit("  "), F.lit(" "))
        glued = F.replace(glued, F.lit("\n "), F.lit("\n"))
        return F.struct(merge.alias("merged"), F.when(merge, glued).otherwise(b["body"]).alias("text"))

    def mark(j):
        marked = starts_mid_sentence(j["text"])
        text = F.when(marked, F.concat(F.lit("[...] "), j["text"])).otherwise(j["text"])
        return F.struct(j["merged"].alias("was_merged"), marked.alias("was_marked"), text.alias("text"))

    fixed = chunks.withColumn("_r", T.let(both, lambda b: T.let(join(b), mark)))
    cols = [F.col("_r.text").alias("text") if c == "text" else F.col(c) for c in chunks.columns]
    fixed = fixed.select(*cols, "_r.was_merged", "_r.was_marked")
    return fixed.withColumn("sentence_count", T.sentence_count(F.col("text"))).withColumn(
        "word_count", T.word_count(F.col("text"))
    )
