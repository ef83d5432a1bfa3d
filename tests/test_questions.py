import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import prompts as P
from lectern.functions import text as T
from lectern.operators import generation as G
from lectern.operators import parsing as X
from lectern.operators import validation as V
from lectern.plans import ingest, questions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stubs run in tasks

GOOD = {"question": "Where is Oslo?", "options": ["Norway", "Sweden", "Chile", "Japan"], "correctIndex": 0, "explanation": "It is the capital of Norway."}


def replies(spark, *raws):
    return spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "id string, raw string")


def mcq(spark, *raws):
    got = X.parse_mcq(replies(spark, *[r if isinstance(r, str) else json.dumps(r) for r in raws]), "id").collect()
    return {r["id"]: r for r in got}


def test_json_extraction(value):
    texts = ["```json\n{\"a\": 1}\n```", "so {\"a\": {\"b\": 2}} there", "none", "} {"]
    assert value(X.extract_json, *texts) == ['{"a": 1}', '{"a": {"b": 2}}', None, None]
    assert value(lambda c: X.extract_json(c, "[]"), "x [1, [2]] y", "{}") == ["[1, [2]]", None]


def test_accepted_shapes(spark):
    fenced = "```json\n" + json.dumps(GOOD) + "\n```"
    chatty = "Sure! " + json.dumps(GOOD) + " Bye."
    bare = {k: v for k, v in GOOD.items() if k != "explanation"}
    got = mcq(spark, GOOD, fenced, chatty, bare, {**GOOD, "explanation": None})
    assert set(got) == {"0", "1", "2", "3", "4"}
    assert got["3"]["explanation"] == got["4"]["explanation"] == "The correct answer is based on the source material."
    for r in got.values():
        assert sorted(r["options"]) == sorted(GOOD["options"]) and r["options"][r["correct_index"]] == "Norway"


@pytest.mark.parametrize("change", [
    {"options": ["a1", "b1", "c1"]}, {"options": ["aa", "aa", "bb", "cc"]}, {"options": ["Option1", "bb", "cc", "dd"]},
    {"options": ["x", "bb", "cc", "dd"]}, {"correctIndex": "0"}, {"question": 5}, {"options": "none"},
    {"options": [1, 2, 3, 4]}, {"explanation": 3}, {"options": ["A) same", "B) same", "cc", "dd"]},
])
def test_rejected_shapes(spark, change):
    assert mcq(spark, {**GOOD, **change}) == {}


def test_no_json_and_broken_json(spark):
    assert mcq(spark, "nothing", "{broken", '{"question": "x"') == {}


def test_index_outside_the_options_becomes_zero(spark):
    assert mcq(spark, {**GOOD, "correctIndex": 9})["0"]["correct_index"] == 0


def test_labels(value):
    assert value(X.clean_option_label, "A) Oslo", "b. Oslo", "(C) Oslo", "D : Oslo", " Oslo", "Adam") == ["Oslo"] * 5 + ["Adam"]


def test_training_parse_is_stricter(spark):
    long = {**GOOD, "question": "In which country is Oslo found?"}
    got = X.parse_training_mcq(replies(spark, *map(json.dumps, [GOOD, long, {**long, "correctIndex": 4}]))).collect()
    assert [r["id"] for r in got] == ["1"] and got[0]["options"] == GOOD["options"]


def test_open_ended(spark):
    rows = [("s", "body text", json.dumps({"question": "Why?", "idealAnswer": "Because."})),
            ("s", "body text", json.dumps({"question": "Why?", "idealAnswer": "Because.", "keyPoints": ["a"]})),
            ("s", "body text", json.dumps({"question": "Why?"}))]
    got = X.parse_open_ended(spark.createDataFrame(rows, "source string, text string, raw string")).collect()
    assert [r["key_points"] for r in got] == [[], ["a"]] and got[0]["context"] == "body text"


def test_flashcards_void_a_reply_with_a_bad_card(spark):
    good = 'cards: [{"question": "q", "answer": "a"}, {"question": "r", "answer": "b"}]'
    rows = [(0, good), (1, '[{"question": "q"}]'), (2, "none"), (3, "[]")]
    got = X.parse_flashcards(spark.createDataFrame(rows, "id int, raw string")).collect()
    assert [(r["id"], r["pos"], r["answer"]) for r in got] == [(0, 0, "a"), (0, 1, "b")]


def summary(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string")
    s = X.parse_summary(F.col("raw"), F.lit("orig"), F.lit("ch"), F.lit("se"))
    return tuple(df.select(s.alias("s")).first()["s"])


def test_summary_defaults(spark):
    assert summary(spark, "no json") == ("content", "orig", "ch", "se")
    assert summary(spark, '{"type": "TOC", "summary": ""}') == ("toc", "orig", None, None)
    assert summary(spark, '{"summary": "s", "chapter": "null", "section": "X"}') == ("content", "s", None, "X")
    assert summary(spark, "{bad}") == ("content", "orig", "ch", "se")


def test_classification_types(spark):
    kinds = ["toc", "frontmatter", "front_matter", "CITATION", "index", "poem"]
    df = spark.createDataFrame([(json.dumps({"type": k}),) for k in kinds] + [("none",)], "raw string")
    s = X.parse_classification(F.col("raw"), F.lit("ch"), F.lit(None).cast("string"))
    got = [r["s"] for r in df.select(s.alias("s")).collect()]
    assert [g["type"] for g in got] == ["toc", "frontMatter", "frontMatter", "citation", "index", "content", "content"]
    assert got[-1]["chapter"] == "ch" and {g["quality"] for g in got} == {0.7}


# --- validation --------------------------------------------------------------

def verdict(spark, question="In what year did Newton publish?", options=("1687", "1700", "1712", "1650"), index=0):
    df = spark.createDataFrame([(question, list(options), index)], "q string, o array<string>, i int")
    return df.select(V.validate_question(F.col("q"), F.col("o"), F.col("i")).alias("v")).first()["v"]


def test_good_question(spark):
    v = verdict(spark)
    assert (v["is_valid"], v["score"], v["issues"]) == (True, 5, [])


@pytest.mark.parametrize("change,issue", [
    ({"options": ("1687", "1700", "1712")}, "option_count"), ({"index": 4}, "index_range"), ({"index": -1}, "index_range"),
    ({"options": ("1687", "1687", "1712", "1650")}, "duplicate_options"), ({"question": "What, Newton?"}, "question_short"),
    ({"options": ("1687", "an answer", "1712", "1650")}, "bad_option"),
])
def test_structural_issues_invalidate(spark, change, issue):
    v = verdict(spark, **change)
    assert not v["is_valid"] and issue in v["issues"]


def test_wording_scores(spark):
    v = verdict(spark, "According to the text, what did Newton do?")
    assert (v["is_valid"], v["score"]) == (False, 1)  # two overlapping phrases
    v = verdict(spark, "He wrote what in London?")
    assert (v["is_valid"], v["score"], v["issues"]) == (False, 3, ["pronoun_start"])
    assert verdict(spark, "what did newton publish in london?")["score"] == 4
    long = verdict(spark, "what is " + "x" * 300)
    assert (long["is_valid"], long["score"]) == (True, 3)
    mixed = verdict(spark, options=("1687", "Rome", "some small thing", "12.5"))
    assert mixed["is_valid"] and mixed["issues"] == ["mixed_types"]


def test_option_types(value):
    assert value(V.classify_option_type, "1687", "1066 CE", "44 BCE", "12.5", "-3e4", "Isaac Newton", "a small thing", "A B C D E") == [
        "year", "year", "phrase", "number", "number", "name", "phrase", "phrase"]


def candidates(spark, *rows):
    full = [(c, a, s, q, ["Rome", "Oslo", "Lima", "Bern"], 0, "Because it is so in fact.", "the body of the chunk") for c, a, s, q in rows]
    return spark.createDataFrame(full, "chunk_id string, attempt int, seq int, question string, options array<string>, correct_index int, explanation string, text string")


def test_best_of_n_tiers(spark):
    low = "what is " + "x" * 300  # valid at 3
    lower = "what is body " + "chunk " * 60 + "x" * 20  # also 3, but shares words with the chunk
    got = V.best_of_n(candidates(
        spark, ("first", 0, 1, "Where is Rome today?"), ("first", 0, 2, "Where is Oslo today?"),
        ("second", 0, 0, "the author says?"), ("second", 1, 0, "Where is Rome today?"),
        ("tier2", 0, 0, low), ("tier2", 1, 0, low + "y"), ("none", 0, 0, "What does the author say?"),
        ("score", 0, 0, low), ("score", 0, 1, lower))).collect()
    won = {r["chunk_id"]: (r["attempt"], r["seq"]) for r in got}
    assert won["first"] == (0, 1) and won["second"] == (1, 0) and won["tier2"] == (0, 0)
    assert "none" not in won and won["score"] in {(0, 0), (0, 1)}
    assert len(got) == len(won)


def test_acceptance_reasons(spark):
    rows = [("", ["aa", "bb", "cc", "dd"], 0), ("q", ["aa"], 0), ("q", ["Option 1", "bb", "cc", "dd"], 0), ("q", ["a", "bb", "cc", "dd"], 0),
            ("q", ["aa", "aa", "cc", "dd"], 0), ("q", ["aa", "bb", "cc", "dd"], 4), ("q", ["aa", "bb", "cc", "dd"], 3)]
    df = spark.createDataFrame(rows, "q string, o array<string>, i int")
    got = [r[0] for r in df.select(V.check_output(F.col("q"), F.col("o"), F.col("i"))).collect()]
    assert got == ["question_empty", "option_count", "placeholder", "option_short", "duplicate_options", "index_range", None]
    assert spark.range(1).select(V.check_open_output(F.lit("q"), F.lit("short"))).first()[0] == "answer_short"


def test_quality_rates_count_unreadable(spark):
    df = spark.createDataFrame([("a", "Is Rome old?", ["aa", "bb", "cc", "dd"]), ("a", None, None)], "g string, question string, options array<string>")
    r = V.quality_rates(df, "g").first()
    assert (r["outputs"], r["json_rate"], r["containment_rate"], r["option_rate"]) == (2, 0.5, 0.5, 0.5)


# --- prompts and pipelines ---------------------------------------------------

def test_few_shot_examples_are_well_formed(spark):
    assert {d for d, *_ in P.GOLD_EXAMPLES} == {"easy", "medium", "hard"}
    gold = G.gold_examples(spark)
    ok = gold.select(V.check_output(F.col("question"), F.col("options"), F.col("correct_index")).alias("r"),
                     V.validate_question(F.col("question"), F.col("options"), F.col("correct_index")).alias("v"))
    assert ok.filter("r is not null or not v.is_valid").count() == 0
    blocks = G.few_shot_blocks(gold, 2).collect()
    assert len(blocks) == 3 and all("Sample 2" in b["examples"] and "Sample 3" not in b["examples"] for b in blocks)


def test_prompts_cut_passages_by_kind(spark):
    df = spark.createDataFrame([("1", "src", "x" * 3000)], "id string, source string, text string")
    for kind, n in P.PASSAGE_CHARS.items():
        row = G.build_prompts(df, kind, F.lit("hard")).first()
        assert row["user"].count("x" * 10) >= 1 and ("x" * (n or 3000)) in row["user"] and ("x" * ((n or 3000) + 1)) not in row["user"]


def test_discussion_order_and_roles(spark):
    q = spark.createDataFrame([(1, "Q?", ["a", "b"], 1, None, "why", "s")], "conv_id int, question string, options array<string>, correct_index int, user_answer int, explanation string, source string")
    turns = spark.createDataFrame([(1, 2, False, "two"), (1, 1, True, "one")], "conv_id int, turn int, is_user boolean, content string")
    new = spark.createDataFrame([(1, "three")], "conv_id int, content string")
    got = G.discussion_history(G.mcq_preamble(q), turns, new).orderBy("pos").collect()
    assert [(r["pos"], r["role"]) for r in got] == [(0, "system"), (1, "user"), (2, "assistant"), (3, "user")]
    assert "none (INCORRECT)" in got[0]["content"] and "Correct answer: b" in got[0]["content"]


def stub(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A bad reply first, then a good one naming the prompt."""
    for pdf in batches:
        rows = []
        for pid in pdf["prompt_id"]:
            rows.append((pid, 0, 0, "no idea"))
            good = {**GOOD, "question": f"In which country is Oslo, town {pid}, found?"}
            rows.append((pid, 1, 0, "```json\n" + json.dumps(good) + "\n```"))
        yield pd.DataFrame(rows, columns=["prompt_id", "attempt", "seq", "raw"])


def test_make_questions_gives_at_most_one_per_chunk(spark):
    chunks = spark.createDataFrame([(str(i), f"s{i % 2}", "Oslo is in Norway. " * 9) for i in range(12)], "id string, source string, text string")
    got = questions.make_questions(chunks, stub, "easy", count=5).collect()
    assert len(got) == 5 and len({r["chunk_id"] for r in got}) == 5
    assert all(r["attempt"] == 1 and r["options"][r["correct_index"]] == "Norway" and r["source"] in ("s0", "s1") for r in got)


def first_good(batches):
    for pdf in stub(batches):
        yield pdf[pdf["attempt"] == 1]


def test_make_training_set_splits_exactly(spark):
    chunks = spark.createDataFrame([(str(i), "s", "text") for i in range(11)], "id string, source string, text string")
    got = questions.make_training_set(chunks, first_good).collect()
    assert sorted(r["split"] for r in got) == ["train"] * 8 + ["valid"] * 3
    assert all(r["text"].startswith("<|im_start|>system\n") and r["text"].endswith("<|im_end|>") for r in got)


def echo(batches):
    for pdf in batches:
        yield pd.DataFrame({"prompt_id": pdf["prompt_id"], "attempt": 0, "seq": 0, "raw": ['{"type": "content", "summary": "Short now."}'] * len(pdf)})


def test_summaries_replace_texts(spark):
    docs = spark.createDataFrame([(1, "s", "# One\n" + "word " * 120), (2, "s", "few words")], "doc_id bigint, source string, text string")
    got = ingest.summarize_documents(docs, echo, 200).collect()
    assert [(r["doc_id"], r["text"], r["word_count"], r["chapter"]) for r in got] == [(1, "Short now.", 2, "One")]


def test_throughput_guards_zero_time(spark):
    df = spark.createDataFrame([(1, 5, 0.0), (2, 4, 1.0), (2, 9, 3.0)], "generation_id int, tokens int, elapsed double")
    got = {r["generation_id"]: r["tokens_per_second"] for r in G.generation_throughput(df).collect()}
    assert got == {1: 0.0, 2: 3.0}


def cards(batches):
    for pdf in batches:
        raw = ['[{"question": "Q%d", "answer": "A"}, {"question": "R", "answer": "B"}]' % u.count("passage") for u in pdf["user"]]
        yield pd.DataFrame({"prompt_id": pdf["prompt_id"], "attempt": 0, "seq": 0, "raw": raw})


def test_flashcards_come_from_three_sampled_chunks(spark):
    chunks = spark.createDataFrame([(str(i), f"s{i}", f"passage {i}") for i in range(9)], "id string, source string, text string")
    got = questions.make_flashcards(chunks, cards, 2).collect()
    first = G.sample_chunks(chunks, 3, "cards").collect()[0]["source"]
    assert [(r["pos"], r["question"]) for r in got] == [(0, "Q3"), (1, "R")] and {r["source"] for r in got} == {first}
    assert questions.make_flashcards(chunks.filter("false"), cards, 2).count() == 0


def essays(batches):
    for pdf in batches:
        raw = ['{"question": "Explain it.", "idealAnswer": "It is so."}' if int(p) % 2 else "none" for p in pdf["prompt_id"]]
        yield pd.DataFrame({"prompt_id": pdf["prompt_id"], "attempt": 0, "seq": 0, "raw": raw})


def test_open_questions_keep_their_context(spark):
    chunks = spark.createDataFrame([(str(i), "s", f"passage {i}") for i in range(6)], "id string, source string, text string")
    got = questions.make_open_questions(chunks, essays, "hard").collect()
    assert sorted((r["chunk_id"], r["context"]) for r in got) == [("1", "passage 1"), ("3", "passage 3"), ("5", "passage 5")]


def test_role_tag_set_is_written_split(spark):
    import tempfile
    from lectern.sources import files as IO
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    chunks = spark.createDataFrame([(str(i), i, 0, f"s{i % 2}", "text") for i in range(8)], "id string, doc_id bigint, chunk_idx int, source string, text string")
    made = questions.make_role_tag_set(chunks, stub, 4, folder)
    assert made.count() == 12 and made.filter("split = 'valid'").count() == 1
    train = IO.read_training_jsonl(spark, folder + "/train.jsonl").collect()
    assert len(train) == 11 and all("<|assistant|>" in r["text"] for r in train)


def quote(batches):
    for pdf in batches:
        yield pd.DataFrame({"prompt_id": pdf["prompt_id"], "attempt": 0, "seq": 0, "raw": [" " + u[:40] + " " for u in pdf["user"]]})


@pytest.mark.parametrize("hops", [1, 2])
def test_answers_use_the_context_found(spark, hops):
    from lectern.operators import index as I
    from lectern.plans import ask
    docs = spark.createDataFrame([(1, "s", "Harbour lights guide ships home."), (2, "t", "Bread needs yeast.")], "doc_id bigint, source string, text string")
    q = spark.createDataFrame([(1, "harbour lights"), (2, "yeast bread")], "query_id int, query string")
    got = {r["query_id"]: r["answer"] for r in ask.answer(q, quote, I.TextIndex.build(docs, buckets=2), docs, k=1, hops=hops).collect()}
    assert got[1].startswith("Answer from this context:\n\nHarbour") and got[2].startswith("Answer from this context:\n\nBread")


def test_only_top_level_fields_of_the_right_type_count(spark):
    good = '"question": "Which of the rivers is the longest one?", "options": ["aa", "bb", "cc", "dd"], "correctIndex": 1'
    raws = [
        '{"meta": {"a": 1, "question": "s", "z": 1}, "options": ["aa", "bb", "cc", "dd"], "correctIndex": 1}',
        "{" + good + ', "note": {"explanation": 5}}',
        "{" + good + ', "explanation": 5}',
        "{" + good + ', "explanation": null}',
        '{"question": {"question": "x"}, "options": ["aa", "bb", "cc", "dd"], "correctIndex": 1}',
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    assert sorted(r["id"] for r in X.parse_mcq(df, "id").collect()) == [1, 3]
    assert sorted(r["id"] for r in X.parse_training_mcq(df).collect()) == [1, 3]


def test_cards_with_other_than_strings_void_the_reply(spark):
    raws = ['[{"question": "q", "answer": "a"}]', '[{"question": 5, "answer": "a"}]',
            '[{"question": {"a": 1}, "answer": "a"}]', '[{"question": "q", "answer": "a"}, {"answer": "b"}]']
    df = spark.createDataFrame([(i, "s", r) for i, r in enumerate(raws)], "id int, source string, raw string")
    assert [(r["id"], r["question"]) for r in X.parse_flashcards(df).collect()] == [(0, "q")]


def test_only_failed_prompts_are_asked_again(spark, tmp_path):
    log = str(tmp_path)

    def moody(batches):
        import json as J
        import os
        import uuid

        for pdf in batches:
            rows = []
            for pid in pdf["prompt_id"]:
                wave = sum(f.startswith(f"{pid}-") for f in os.listdir(log))
                open(f"{log}/{pid}-{uuid.uuid4().hex}", "w").close()
                good = J.dumps({"question": f"Which of the harbours did Ada Lovelace visit in year {pid}?",
                                "options": ["Dover", "Calais", "Ostend", "Bergen"], "correctIndex": 0})
                rows.append((pid, 0, 0, "no reply" if pid in "13" and not wave else good))
            yield pd.DataFrame(rows, columns=["prompt_id", "attempt", "seq", "raw"])

    chunks = spark.createDataFrame([(str(i), "s", "text") for i in range(5)], "id string, source string, text string")
    made = {r["chunk_id"]: r["attempt"] for r in questions.make_questions(chunks.coalesce(1), moody, "easy").collect()}
    assert made == {"0": 0, "1": 100, "2": 0, "3": 100, "4": 0}
    import os
    assert sorted(f.split("-")[0] for f in os.listdir(log)) == ["0", "1", "1", "2", "3", "3", "4"]


def test_hops_over_vectors_need_an_embedding_hook(spark):
    from lectern.operators import rerank as RR
    with pytest.raises(ValueError):
        RR.multi_hop(None, None, None, corpus=spark.range(1))


def test_replies_are_asked_for_once(spark, tmp_path):
    def hook(tag):
        def fn(batches):
            for pdf in batches:
                if tag is None and len(pdf):
                    raise RuntimeError("asked again")
                rows = [(p, 0, s, f"{tag} {u} {s}") for p, u in zip(pdf["prompt_id"], pdf["user"]) for s in (0, 1)]
                yield pd.DataFrame(rows, columns=["prompt_id", "attempt", "seq", "raw"])
        return fn

    def prompts(*users):
        return spark.createDataFrame([(str(i), "s", u) for i, u in enumerate(users)], "prompt_id string, system string, user string")

    def told(df):
        return sorted(map(tuple, df.collect()))

    log = str(tmp_path / "log")
    first = told(G.generate_once(prompts("a", "b", "a"), hook("one"), log))
    assert [r[0] for r in first] == ["0", "0", "1", "1", "2", "2"] and len({r[3] for r in first}) == 4
    assert told(G.generate_once(prompts("a", "b", "a"), hook(None), log)) == first  # the model is not called
    more = told(G.generate_once(prompts("b", "c"), hook("two"), log, parts=3))
    assert [r[3] for r in more] == ["one b 0", "one b 1", "two c 0", "two c 1"]
    assert [r[3] for r in told(G.generate_once(prompts("a"), hook("wave"), log, wave=1))] == ["wave a 0", "wave a 1"]
    assert told(G.generate_once(prompts(), hook(None), log)) == []
    with pytest.raises(Exception, match="asked again"):
        told(G.generate_once(prompts("z"), hook(None), log))
    assert told(G.generate_once(prompts("z"), hook("late"), log))[0][3] == "late z 0"


def old_label(option):
    for pattern in K.OPTION_LABELS:
        option = re.sub(pattern, "", option.strip(T.SPACES), flags=re.ASCII)
    return option.strip(T.SPACES)


def test_labels_in_one_pattern_equal_one_after_the_other(value):
    options = ["A) b. (C) x", "(C) A) x", "a :  x ", "　B )  y\t", "d", "D.", " ", "", "b\nc) x", "C.C. Moon", "A) z"]
    assert value(X.clean_option_label, *options) == [old_label(o) for o in options]


def generated_methods(df):
    """Largest method in bytecode of the code Spark generates for ``df``; Java interprets those over 8,000."""
    spark = df.sparkSession
    stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    found = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages)
    return max(s._3().maxMethodCodeSize() for s in found)


def test_replies_are_spelled_in_methods_that_java_compiles(spark):
    from lectern.plans import question_queries as Q

    folder = "/root/testdata/sf0.001"
    assert generated_methods(Q.replies(spark, folder)) < 8000


def test_option_names_are_at_most_four_capitalised_words(value):
    options = ["One Two Three Four", "One Two Three Four Five", "One  Two", "One two", "", "Él Ñu", "One\ntwo", "9 Lives"]
    assert value(V.classify_option_type, *options) == [
        "name", "phrase", "name", "phrase", "name", "name", "name", "phrase"]


def test_shared_words_are_whole_words_counted_once(spark):
    rows = [("alphabet alphabet stringent words?", "Alphabet STRINGENT wordsmith", 2),
            ("alphabets bet", "alphabet s", 0), ("longer longest", "longest\nlonger", 0), ("", "", 0)]
    got = spark.createDataFrame(rows, "q string, text string, n int").select("n", V.score_candidate(
        F.col("q"), F.array(*[F.lit("xx")] * 4), F.lit(""), F.lit(0), F.col("text")).alias("s"), F.length("q").alias("l"))
    for r in got.collect():
        assert r["s"] == r["n"] + 2 + (2 if 30 <= r["l"] <= 150 else 1 if 20 <= r["l"] <= 200 else 0)


def test_texts_are_lowered_once_for_all_phrases(spark):
    rows = spark.createDataFrame([("Q?", ["a", "b"], 0)], "question string, options array<string>, correct_index int")
    plan = V.with_validation(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2  # of the question and of an option


def test_a_summary_reply_is_parsed_once(spark):
    rows = spark.createDataFrame([("{}", "t", "c", "s")], "raw string, text string, chapter string, section string")
    text, chapter, section = F.col("text"), F.col("chapter"), F.col("section")
    for read in (X.parse_summary(F.col("raw"), text, chapter, section), X.parse_classification(F.col("raw"), chapter, section)):
        plan = rows.select(read.alias("s")).select("s.*")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") + plan.count("parse_json") == 1
        assert "from_json" not in plan


def test_replies_after_the_one_that_settles_are_not_read(spark, monkeypatch):
    import random

    good = {"options": ["the tide", "the moon", "the wind", "the rock"], "correctIndex": 1, "explanation": "It stands in the content given."}
    reply = lambda question, **more: json.dumps(good | {"question": question} | more)
    rows = []
    for key in range(300):
        texts = ["no reply", reply("the author says What of the tide?"), reply("what moves the water of the sea each day?"),
                 reply("What moves the water of the sea each day?"), reply("What moves the water of the sea by night?"),
                 reply("Why", options=["a"])]
        random.Random(key).shuffle(texts)
        rows += [(str(key), n // 3, n, raw, "s", "the moon moves the water", f"{key}:{n}") for n, raw in enumerate(texts[: key % 7])]
    replies = spark.createDataFrame(
        rows, "prompt_id string, attempt int, seq int, raw string, source string, text string, reply_id string").repartition(5)
    want = V.best_of_n(X.parse_mcq(replies, "reply_id"), "prompt_id")
    got = V.best_replies(replies, "prompt_id", "reply_id")
    assert got.columns == want.columns and want.count() > 100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    read = X.mcq_rows
    monkeypatch.setattr(X, "mcq_rows", lambda raw, *a: F.when(raw == "late", F.raise_error(F.lit("read"))).otherwise(read(raw, *a)))
    late = spark.createDataFrame([("1", n, n, reply("What moves the water of the sea by night?") if n == 1 else ["none", "", "late"][n], "s", "t", f"1:{n}")
                                  for n in (2, 1, 0)], replies.schema)
    assert V.best_replies(late, "prompt_id", "reply_id").first()["seq"] == 1
