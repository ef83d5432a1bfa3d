import random
import re

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking as C
from lectern.operators import filters as L
from lectern.operators import metadata as M
from lectern.operators import structure as S
from lectern.plans import ingest

ELEMENTS = "doc_id bigint, source string, elements array<struct<type:string,text:string,page:int,level:int>>"


def words(n, start="w"):
    return " ".join(f"{start}{i}" for i in range(n))


def chunked(spark, elements, target=400):
    rows = [(1, "my book.txt", [(k, t, p, 0) for k, t, p in elements])]
    found = C.semantic_chunks(spark.createDataFrame(rows, ELEMENTS), target)
    return found.orderBy("chunk_idx").collect()


# --- structure ---------------------------------------------------------------

def test_unwrap_joins_lines_and_glues_hyphens(value):
    text = "The exam-\nple runs\non. It stops.\nnext lower\n\n- item\n12) step\nBIG HEADER\nEnds here.\nNew one"
    assert value(S.unwrap_lines, text) == (
        "The example runs on. It stops. next lower\n\n- item\n\n12) step\n\nBIG HEADER Ends here.\n\nNew one")


def test_markdown_levels(value):
    got = value(S.markdown_elements, "# Top\n\n## Part\n#### Deep\n  plain text ")
    assert [(e["type"], e["text"], e["level"]) for e in got] == [
        ("chapter", "Top", 1), ("section", "Part", 2), ("subsection", "Deep", 4), ("paragraph", "plain text", 0)]


def test_line_classes(value):
    lines = ["ab", "12 - 13", "CHAPTER ONE", "3 BIG THINGS", "OTHER HEADING", "A Title Line Here", "- entry of a list", "4. is small here", "plain words follow on"]
    assert value(S.classify_line, *lines) == [
        "paragraph", "paragraph", "chapter", "chapter", "section", "section", "listItem", "listItem", "paragraph"]


def test_paragraph_fallback(value):
    assert value(S.split_paragraphs, "a\n\n b \nc", "  alone ") == [["a", "b", "c"], ["alone"]]


def test_page_elements_carry_page(value):
    got = value(lambda c: S.page_elements(c, F.lit(7)), "CHAPTER ONE\n\n" + words(12))
    assert [(e["type"], e["page"]) for e in got] == [("chapter", 7), ("paragraph", 7)]


# --- the fold ----------------------------------------------------------------

def test_chapter_flushes_tiny_text(spark):
    got = chunked(spark, [("paragraph", "tiny.", 1), ("chapter", "Two", 2), ("paragraph", words(60), None)])
    assert [(r["text"][:5], r["chapter"], r["page"]) for r in got] == [("tiny.", None, 1), ("w0 w1", "Two", 2)]
    assert [r["id"] for r in got] == ["my_book.txt_0", "my_book.txt_1"]


def test_section_flushes_only_above_minimum(spark):
    got = chunked(spark, [("section", "A", None), ("paragraph", words(99), None), ("section", "B", None), ("paragraph", words(80), None)])
    assert [(r["section"], r["word_count"]) for r in got] == [("B", 99 + 80 - 1)]
    got = chunked(spark, [("section", "A", None), ("paragraph", words(100), None), ("section", "B", None), ("paragraph", words(60), None)])
    assert [(r["section"], r["word_count"]) for r in got] == [("A", 100), ("B", 60)]


def test_size_split_keeps_remainder_and_page(spark):
    text = (words(250) + ". ") * 2
    got = chunked(spark, [("paragraph", text.strip(), 3), ("paragraph", words(10), 4)])
    assert [(r["word_count"], r["page"]) for r in got] == [(250, 3), (259, 3)]


def test_short_tail_is_dropped(spark):
    assert chunked(spark, [("paragraph", words(49), None)]) == []
    assert len(chunked(spark, [("paragraph", words(50), None)])) == 1


def test_figures_are_not_size_checked(spark):
    got = chunked(spark, [("paragraph", words(399), None), ("table", words(30), None)])
    assert [r["word_count"] for r in got] == [399 + 30 - 1]


def text_fold(elements, target):
    """The same rules on plain strings, one document at a time."""
    target, low, _ = C.sizes(target)
    count = lambda s: len([w for w in s.split(" ") if w])
    cut = lambda s: [x for x in re.sub(r"([.!?][\"')]*[ \t\n\r]+|\n+)", "\\1\1", s).split("\1") if x]
    cur, section, chapter, page, out = "", None, None, None, []
    for kind, text, at in elements:
        if kind == "chapter":
            if cur:
                out.append((cur, section, chapter, page))
            cur, chapter, section, page = "", text, None, at
        elif kind in ("section", "subsection"):
            if cur and count(cur) >= low:
                out.append((cur, section, chapter, page))
                cur = ""
            section, page = text, at if at is not None else page
        else:
            sized = kind in ("paragraph", "listItem")
            if sized and page is None:
                page = at
            cur = cur + "\n\n" + text if cur else text
            if sized and count(cur) >= target:
                total, n, sents = 0, 0, cut(cur)
                for s in sents:
                    if total + count(s) > target and total >= low:
                        break
                    total, n = total + count(s), n + 1
                out.append(("".join(sents[:n]), section, chapter, page))
                cur = "".join(sents[n:])
    if cur and count(cur) >= low // 2:
        out.append((cur, section, chapter, page))
    return [(t.strip(), s, c, p) for t, s, c, p in out]


def test_fold_equals_string_version(spark):
    rng = random.Random(5)
    kinds = ["paragraph"] * 8 + ["listItem", "table", "chapter", "section", "subsection"]
    docs = []
    for d in range(40):
        els = []
        for _ in range(rng.randint(0, 25)):
            kind = rng.choice(kinds)
            text = " ".join(rng.choice(["one", "two", "ends.", "why?", 'done."', "x"]) for _ in range(rng.randint(1, 90)))
            els.append((kind, text, rng.choice([None, 1, 2, 3])))
        docs.append(els)
    rows = [(i, "s", [(k, t, p, 0) for k, t, p in els]) for i, els in enumerate(docs)]
    got = C.semantic_chunks(spark.createDataFrame(rows, ELEMENTS), 100).collect()
    for i, els in enumerate(docs):
        mine = [(r["text"], r["section"], r["chapter"], r["page"]) for r in sorted(got, key=lambda r: r["chunk_idx"]) if r["doc_id"] == i]
        assert mine == text_fold(els, 100), i


def test_paragraph_chunks_bounds(spark):
    text = "\n".join([words(300), words(300), words(450), words(700), words(90)])
    docs = spark.createDataFrame([(1, "s", None, text)], "doc_id bigint, source string, page int, text string")
    got = C.paragraph_chunks(docs).orderBy("chunk_idx").collect()
    assert [r["word_count"] for r in got] == [599, 450, 700]  # the tail of 90 is under 100


def test_pack_paragraphs_labels_with_the_newest_chapter(spark):
    text = "\n\n".join(["Chapter 1\nintro " + words(5), words(20), "Chapter 2: next " + words(20), "tail"])
    got = C.pack_paragraphs(spark.createDataFrame([(1, "s", text)], "doc_id bigint, source string, text string"), 30)
    got = got.orderBy("chunk_idx").collect()
    assert [r["section"] for r in got] == ["Chapter 2: next " + words(20), "Chapter 2: next " + words(20)]
    assert got[1]["text"].endswith("tail")


# --- neighbours --------------------------------------------------------------

CHUNK = ", ".join(
    f"{c} {'bigint' if c == 'doc_id' else 'int' if c in ('chunk_idx', 'page', 'start_index', 'end_index', 'sentence_count', 'word_count') else 'string'}"
    for c in C.CHUNK_COLUMNS)


def chunk_rows(spark, counts, doc=1, sections=None, text=None):
    rows = [
        (doc, i, f"s_{i}", (text or {}).get(i, words(n)), "s", None, (sections or {}).get(i), None, i, i, 1, n, None, None)
        for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, CHUNK)


def test_small_chunk_islands(spark):
    got = C.merge_small_chunks(chunk_rows(spark, [30, 120, 20, 40, 200, 10], sections={2: "S"}), 100)
    got = got.orderBy("chunk_idx").collect()
    assert [(r["chunk_idx"], r["end_index"], r["section"]) for r in got] == [(1, 3, "S"), (4, 5, None)]
    assert [r["word_count"] for r in got] == [120 + 20 + 40 - 2, 200 + 10 - 1]
    assert [r["sentence_count"] for r in got] == [3, 2]


def test_single_small_chunk_stays_and_documents_do_not_mix(spark):
    both = chunk_rows(spark, [10]).unionByName(chunk_rows(spark, [120, 5], doc=2))
    got = C.merge_small_chunks(both, 100).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["word_count"]) for r in got] == [(1, 10), (2, 124)]


def test_overlap_keeps_existing_context_at_the_edges(spark):
    df = chunk_rows(spark, [1, 1], text={0: "A one. B two. C three.", 1: "D four. E five. F six."})
    df = df.withColumn("preceding_context", F.lit("kept"))
    a, b = C.context_overlap(df).orderBy("chunk_idx").collect()
    assert (a["preceding_context"], a["following_context"]) == ("kept", "D four. E five. ")
    assert (b["preceding_context"], b["following_context"]) == ("B two. C three.", None)


def test_repair_prepends_then_marks(spark):
    df = chunk_rows(spark, [1] * 4, text={0: "lower start", 1: "went on", 2: "Fine.", 3: "also lower"}).withColumn(
        "preceding_context", F.when(F.col("chunk_idx") == 1, "It began. ").when(F.col("chunk_idx") == 3, "still lower"))
    got = C.repair_mid_sentence(df).orderBy("chunk_idx").collect()
    assert [r["text"] for r in got] == ["[...] lower start", "It began. went on", "Fine.", "[...] still lower also lower"]
    assert [(r["was_merged"], r["was_marked"]) for r in got] == [(False, True), (True, False), (False, False), (True, True)]


def test_ends_mid_sentence(value):
    assert value(C.ends_mid_sentence, "Done.", "said ”", "and then", "") == [False, False, True, True]


# --- filters and metadata ----------------------------------------------------

def reason(value, *texts):
    got = value(lambda c: L.drop_reason(c, T.word_count(c)), *texts)
    return got


def test_every_drop_rule_and_its_near_miss(value):
    body, long = words(40), words(120)
    toc = "\nA .... 1"
    idx = "\nAbel, 12-13, 14"
    cites = " (1999) pp. 3 vol. 2"
    assert reason(
        value, words(29), body + toc * 4, body + toc * 3, body + " ISBN all rights reserved", body + " isbn",
        body + idx * 6, body + idx * 5, body + cites, long + cites, "Contents " + body, body + " table of contents", body,
    ) == ["short", "toc_lines", None, "front_matter", None, "index_lines", None, "citations", None, "contents", "contents", None]


def test_prefilter(value):
    listing = "Contents\n" + "\n".join(f"Part {i}" for i in range(9))
    assert value(L.is_obvious_noncontent, listing, "ISBN 12", "isbn " + "x" * 600, "plain") == [True, True, False, False]


def test_headings(value):
    assert value(L.clean_metadata, "Intro12", "42", "Yale University, 1990", "Oxford Press, x", "7 ", "Plain") == [
        "Intro", None, None, None, None, "Plain"]
    assert value(L.is_bad_section, "", "Note 12", "Oxford Press, x", "1.2", "Good", "A 1") == [True, True, True, True, False, False]


def test_inferred_headings(value):
    assert value(M.infer_chapter, "x\nChapter 2: The Sea", "CHAPTER ONE", "4. Big Ideas", "no") == ["The Sea", "CHAPTER ONE", "Ideas", None]
    assert value(M.infer_section, "1.2 Small Part", "A Title Line\nrest", "tiny", "all in lower case here") == ["1.2 Small Part", "A Title Line", None, None]


def test_key_terms_rank_by_count_then_name(value):
    assert value(lambda c: M.key_terms(c, 3), "beta alpha beta gamma with their some tree tree tree") == ["tree", "beta", "alpha"]
    assert value(M.key_terms, "of a") == []


def test_metadata_map_drops_nulls(spark):
    row = spark.range(1).select(M.metadata_map(F.lit("s"), F.lit(3), F.lit(None).cast("string"), F.lit("c")).alias("m")).first()
    assert row["m"] == {"source": "s", "page": "3", "chapter": "c"}


def test_sources_filter_and_removal(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source string, n int")
    assert L.filter_sources(df, []).count() == 3 and L.filter_sources(df, ["a", "b"]).count() == 2
    gone = spark.createDataFrame([("b",)], "source string")
    assert L.filter_sources(df, gone).count() == 1
    assert sorted(r["source"] for r in L.remove_documents(df, gone).collect()) == ["a", "c"]
    assert L.removed_counts(df, gone).first()["removed"] == 1


def test_stats_of_nothing(spark):
    empty = chunk_rows(spark, [1]).filter("false")
    row = M.processing_stats(empty).first()
    assert (row["total_chunks"], row["avg_chunk_length"], row["section_percent"]) == (0, 0.0, 0)


def test_steps_in_the_document_row_equal_those_on_tables(spark):
    import random

    from lectern.operators import filters as L
    from lectern.operators import structure as S
    from lectern.plans import ingest

    r = random.Random(6)

    def text():
        parts = []
        for _ in range(r.randrange(0, 9)):
            parts.append(r.choice(["# Chapter One", "## Part", "ISBN all rights reserved. Copyright notice.", ""]))
            parts.append(" ".join(r.choice(["sea", "Ship.", "and", "Light!", "old", "(1999)"]) for _ in range(r.randrange(0, 90))))
        return "\n\n".join(parts)

    docs = spark.createDataFrame([(i, f"s {i % 3}", text()) for i in range(60)] + [(60, "s", ""), (61, None, "a b")],
                                 "doc_id bigint, source string, text string")
    els = docs.select("doc_id", "source", S.markdown_elements(F.col("text")).alias("elements"))
    tables = C.merge_small_chunks(C.context_overlap(C.semantic_chunks(els, 60)), C.sizes(60)[1])
    rows = lambda df: sorted(map(repr, df.select(*C.CHUNK_COLUMNS).collect()))
    assert rows(ingest.merged_chunks(docs, 60)) == rows(tables)
    done = C.repair_mid_sentence(C.context_overlap(L.filter_noncontent(tables)))
    whole = ingest.process_documents(docs, 60)
    assert rows(whole) == rows(done) and len(rows(done)) > 20
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_chunks_are_computed_once_not_for_a_filter_too(spark):
    docs = spark.createDataFrame([(1, "s", "One line. " * 90)], "doc_id bigint, source string, text string")
    plan = ingest.process_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
    assert ingest.process_documents(docs).count() == 1


def test_sentences_end_where_the_two_kinds_of_ends_are(value):
    texts = ["A. B", "A.\") \n\nB", "a\n\n\nb", "x.y? \t z", "\n", "", "no end", "end.", "Q!'\n) b", ".\n.\n"]
    old = re.compile(r"([.!?][\"')]*[ \t\n\r]+|\n+)")
    assert value(T.sentences, *texts) == [[s for s in old.sub("\\1\x01", t).split("\x01") if s] for t in texts]
