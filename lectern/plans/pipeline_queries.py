"""Registered queries over whole pipelines, files and streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.operators import metadata as M
from lectern.operators import retrieval as R
from lectern.operators import training as TR
from lectern.plans import ingest, questions
from lectern.plans import sqltext as q
from lectern.plans.document_queries import (
    DROP_SQL, FOLD_SQL, LINE_CHUNKS_SQL, TARGET, documents, line_chunks, marked_documents,
    passages, passages_sql,
)
from lectern.plans.question_queries import DECODE_SQL, MCQ_SQL, SCORE_SQL, VALID_SQL, render_sql
from lectern.plans.registry import query
from lectern.plans.search_queries import ASK_SQL, RANK, TOK_SQL, bm25_sql, corpus, text_queries
from lectern.plans.training_queries import (
    ANSWER_SQL, EARLY_SQL, EX_SQL, NORM, PROGRESS_SQL, activity, examples, log_lines,
)
from lectern.sources import files as IO
from lectern.sources.tables import checkpoint_folder, materialize, read_table
from lectern.streaming import jobs


def scratch(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- documents to chunks -----------------------------------------------------

def overlap_sql(src: str, out: str, old: bool) -> str:
    pre, post = ("preceding_context", "following_context") if old else ("NULL", "NULL")
    star = "* EXCLUDE (preceding_context, following_context)" if old else "*"
    return f"""{out} AS (SELECT {star},
  coalesce(array_to_string(lag({q.sentences('text')}[-2:]) OVER w_{out}, ''), {pre}) AS preceding_context,
  coalesce(array_to_string(lead({q.sentences('text')}[1:2]) OVER w_{out}, ''), {post}) AS following_context
  FROM {src} WINDOW w_{out} AS (PARTITION BY doc_id ORDER BY chunk_idx))"""


FIRST_KNOWN = "arg_min({0}, chunk_idx) FILTER ({0} IS NOT NULL)"
PROCESS_SQL = rf"""{FOLD_SQL}, {overlap_sql('chunks', 'o1', False)},
isl AS (SELECT *, sum((word_count >= 50)::INT) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS island,
  count(*) OVER (PARTITION BY doc_id) AS n FROM o1),
grp AS (SELECT doc_id, island, n, min(chunk_idx) AS chunk_idx, arg_min(id, chunk_idx) AS id, {FIRST_KNOWN.format('section')} AS section,
  {FIRST_KNOWN.format('chapter')} AS chapter, min(start_index) AS start_index, max(end_index) AS end_index,
  arg_min(coalesce(preceding_context, chr(2)), chunk_idx) AS pre, arg_max(coalesce(following_context, chr(2)), chunk_idx) AS post,
  string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) AS text FROM isl GROUP BY doc_id, island, n),
mrg AS (SELECT *, nullif(pre, chr(2)) AS preceding_context, nullif(post, chr(2)) AS following_context, {q.word_count('text')} AS word_count,
  string_split(text, chr(10)) AS lines, lower(text) AS low FROM grp WHERE {q.word_count('text')} >= 25 OR n = 1),
kept AS (SELECT * FROM mrg WHERE ({DROP_SQL}) IS NULL), {overlap_sql('kept', 'o2', True)},
r0 AS (SELECT *, {q.strip('text')} AS body, {q.strip('preceding_context')} AS before FROM o2),
r1 AS (SELECT *, regexp_matches(body, '^\p{{Ll}}') AND coalesce(before <> '', false) AS was_merged FROM r0),
r2 AS (SELECT *, CASE WHEN was_merged THEN replace(replace(before || ' ' || body, '  ', ' '), chr(10) || ' ', chr(10)) ELSE body END AS t FROM r1),
r3 AS (SELECT *, regexp_matches({q.strip('t')}, '^\p{{Ll}}') AS was_marked FROM r2),
done AS (SELECT * EXCLUDE (text, word_count), CASE WHEN was_marked THEN '[...] ' || t ELSE t END AS text FROM r3)"""


def processed(spark, sf) -> DataFrame:
    return ingest.process_documents(marked_documents(spark, sf), TARGET)


@query("process_documents", sql=f"""WITH {PROCESS_SQL}
SELECT doc_id, chunk_idx, id, text, section, chapter, start_index, end_index, preceding_context, following_context,
  {q.sentence_count('text')} AS sentence_count, {q.word_count('text')} AS word_count FROM done""")
def _(spark, sf):
    return processed(spark, sf).select(
        "doc_id", "chunk_idx", "id", "text", "section", "chapter", "start_index", "end_index",
        "preceding_context", "following_context", "sentence_count", "word_count")


@query("processing_report", sql=f"""WITH {PROCESS_SQL}
SELECT (SELECT count(*) FROM mrg) - count(*) AS chunks_filtered, count(*) AS total_chunks, sum({q.word_count('text')})::BIGINT AS total_words,
  sum(was_merged::INT)::BIGINT AS chunks_merged_context, sum(was_marked::INT)::BIGINT AS chunks_marked_continuation FROM done""")
def _(spark, sf):
    arrays = materialize(ingest.merged_arrays(marked_documents(spark, sf), TARGET), "merged")  # read twice
    before = arrays.agg(F.sum(F.size("chunks"))).first()[0]
    return M.processing_stats(ingest.finished_chunks(arrays), before).select(
        "chunks_filtered", "total_chunks", "total_words", "chunks_merged_context", "chunks_marked_continuation")


# --- the model hook, with a stub that answers from the prompt's own words -----

def stub_model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Five replies per prompt, like a model asked three times and then twice."""
    for pdf in batches:
        rows = []
        for pid, user in zip(pdf["prompt_id"], pdf["user"]):
            text = user.split("Content:\n", 1)[-1].split("\n\nReply as", 1)[0]
            w = [x.strip(".,;|\"\\") for x in text.split()]
            w = [x for x in w if len(x) > 1] or ["none"]
            for seq in range(5):
                part = [w[(seq + i) % len(w)] for i in range(8)]
                reply = json.dumps({
                    "question": ("What of " if seq else "the author says ") + " ".join(part) + "?",
                    "options": [w[(seq + 3 * i) % len(w)] for i in range(4)],
                    "correctIndex": seq % 4, "explanation": "It stands in the content given.",
                }, ensure_ascii=False)
                rows.append((pid, seq // 3, seq, reply))
        yield pd.DataFrame(rows, columns=["prompt_id", "attempt", "seq", "raw"])


def stub_summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        raw = [json.dumps({"type": "content", "summary": u.split("Passage:\n", 1)[-1].split("\n\nReply as", 1)[0]},
                          ensure_ascii=False) for u in pdf["user"]]
        yield pd.DataFrame({"prompt_id": pdf["prompt_id"], "attempt": 0, "seq": 0, "raw": raw})


def pieces(spark, sf) -> DataFrame:
    """Eighty words each, so that prompts hold nearly every character of the documents."""
    return passages(spark, sf, 80).select(F.col("doc_id").cast("string").alias("id"), "source", "text")


STUB_SQL = rf"""cut AS (SELECT doc_id, source, text, list_filter(list_transform(regexp_split_to_array(text[1:800], '\s+'), lambda x: trim(x, '.,;|"\')),
  lambda y: length(y) > 1) AS w0 FROM {passages_sql(80)}),
stub AS (SELECT doc_id, source, text, CASE WHEN len(w0) > 0 THEN w0 ELSE ['none'] END AS w, unnest(range(5)) AS seq FROM cut),
replies AS (SELECT doc_id, source, text, seq // 3 AS attempt, seq, doc_id || ':' || (seq // 3) || ':' || seq AS reply_id, json_object(
  'question', CASE WHEN seq > 0 THEN 'What of ' ELSE 'the author says ' END || array_to_string(list_transform(range(8), lambda i: w[(seq + i) % len(w) + 1]), ' ') || '?',
  'options', list_transform(range(4), lambda i: w[(seq + 3 * i) % len(w) + 1]),
  'correctIndex', seq % 4, 'explanation', 'It stands in the content given.')::VARCHAR AS raw FROM stub)"""


QUESTIONS_MADE_SQL = f"""WITH {STUB_SQL}, {MCQ_SQL}, {VALID_SQL}, {SCORE_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN self_containment >= 4 THEN 0 ELSE 1 END,
  CASE WHEN self_containment >= 4 THEN 0 ELSE -pref END, attempt, seq) AS rn FROM scored WHERE is_valid AND self_containment >= 2)
SELECT doc_id::VARCHAR AS chunk_id, attempt, seq, source, question, array_to_string(options, '|') AS options, correct_index, explanation,
  self_containment, 'medium' AS difficulty FROM r WHERE rn = 1"""


@query("make_questions", sql=QUESTIONS_MADE_SQL)
def _(spark, sf):
    made = questions.make_questions(pieces(spark, sf), stub_model, "medium")
    return made.withColumn("options", F.array_join("options", "|")).drop("reply_id")


@query("make_questions_again", sql=QUESTIONS_MADE_SQL)
def _(spark, sf):
    # a first run sees half of the sources; the second, over all, asks for the other half alone
    every, log = pieces(spark, sf), scratch(spark, "log")
    questions.make_questions(every.filter(F.pmod(F.xxhash64("source"), F.lit(2)) == 0), stub_model, "medium", log=log)
    made = questions.make_questions(every, stub_model, "medium", log=log)
    return made.withColumn("options", F.array_join("options", "|")).drop("reply_id")


@query("make_training_set", sql=f"""WITH {STUB_SQL}, {DECODE_SQL},
first AS (SELECT *, doc_id || '-' || question[1:20] AS id FROM dec WHERE seq = 0 AND len(options) = 4 AND len(list_distinct(options)) = 4
  AND idx BETWEEN 0 AND 3 AND length(question) > 20),
uniq AS (SELECT *, row_number() OVER (PARTITION BY {NORM.format('question')} ORDER BY id) AS copy FROM first),
ranks AS (SELECT *, row_number() OVER (ORDER BY md5('train' || id), id) AS rn, count(*) OVER () AS n, idx AS correct_index,
  [{q.in_list(K.DIFFICULTIES)}][{q.bucket('train', 'doc_id', 3)} + 1] AS difficulty FROM uniq WHERE copy = 1)
SELECT id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS split,
  '<|im_start|>system' || chr(10) || {q.quote(K.CHATML_SYSTEM)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)
  || {render_sql(K.CHATML_USER, difficulty='lower(difficulty)')} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {ANSWER_SQL} || '<|im_end|>' AS text FROM ranks""")
def _(spark, sf):
    return questions.make_training_set(pieces(spark, sf), stub_model)


@query("summarize_documents", sql=rf"""WITH {PROCESS_SQL},
fl AS (SELECT *, list_filter(lines, lambda x: x <> '') AS full_lines FROM mrg),
asked AS (SELECT * FROM fl WHERE word_count >= 50 AND NOT (((contains(low, 'table of contents') OR starts_with(low, 'contents')) AND
  len(list_filter(full_lines, lambda x: regexp_matches(x, '\p{{N}}') AND length(x) < 60)) / greatest(1, len(full_lines)) > 0.8)
  OR ((contains(low, 'isbn') OR contains(low, 'library of congress')) AND length(text) < 500)))
SELECT doc_id, chunk_idx, text[1:1500] AS text, section, chapter, {q.word_count('text[1:1500]')} AS word_count FROM asked""")
def _(spark, sf):
    done = ingest.summarize_documents(marked_documents(spark, sf), stub_summaries, TARGET)
    return done.select("doc_id", "chunk_idx", "text", "section", "chapter", "word_count")


# --- files -------------------------------------------------------------------

@query("read_corpus", sql="""SELECT 'part-' || (doc_id // 100) AS folder, count(*) AS docs,
  sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY ALL""")
def _(spark, sf):
    # documents written as text files, a hundred numbers to a folder, and read back by whole files
    folder = scratch(spark, "corpus")
    one_line = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.replace("text", F.lit("\n"), F.lit("\u0001")))
    documents(spark, sf).select(
        one_line.alias("value"), F.concat(F.lit("part-"), F.floor(F.col("doc_id") / 100).cast("string")).alias("g")
    ).write.partitionBy("g").text(folder)
    line = IO.read_corpus(spark, folder).select(F.explode(F.array_remove(F.split("text", "\n"), "")).alias("line"))
    number = F.substring_index("line", "\t", 1).cast("bigint")
    return line.groupBy(F.concat(F.lit("part-"), F.floor(number / 100).cast("string")).alias("folder")).agg(
        F.count("*").alias("docs"), F.sum(F.size(F.split("line", "\u0001"))).alias("lines"))


def chunk_table(spark, sf) -> DataFrame:
    return line_chunks(spark, sf).withColumn("key_terms", F.lit(None).cast("array<string>"))


@query("chunks_round_trip", sql=f"""WITH {LINE_CHUNKS_SQL} SELECT doc_id, chunk_idx, id, text, page, section, word_count, sentence_count FROM line_chunks""")
def _(spark, sf):
    folder = scratch(spark, "chunks")
    IO.write_chunks(chunk_table(spark, sf), f"{folder}/table")
    IO.write_chunks(IO.read_chunks(spark, f"{folder}/table"), f"{folder}/json", "json")
    return IO.read_chunks(spark, f"{folder}/json", "json").select(
        "doc_id", "chunk_idx", "id", "text", "page", "section", "word_count", "sentence_count")


@query("read_embeddings", sql="SELECT vec_id::VARCHAR AS doc_id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def _(spark, sf):
    # objects of up to a hundred vectors, each three parallel arrays
    folder = scratch(spark, "vectors")
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "embedding")))
    packed = corpus(spark, sf).groupBy(F.floor(F.col("doc_id") / 100).alias("g")).agg(rows.alias("r")).select(
        F.transform("r", lambda x: x["doc_id"].cast("string")).alias("ids"),
        F.transform("r", lambda x: F.lit("")).alias("texts"), F.transform("r", lambda x: x["embedding"]).alias("embeddings"))
    packed.write.json(folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return IO.read_embeddings(spark, folder).select("doc_id", F.size("embedding").alias("dims"), F.round(total, 6).alias("total"))


@query("read_study_sets", sql=f"""WITH {EX_SQL} SELECT id::VARCHAR AS question_id, source || '/' || (id // 50) AS quiz_id, question, array_to_string(options, '|') AS options, correct_index, '2024-05-01 10:00:00' AS created FROM ex""")
def _(spark, sf):
    folder = scratch(spark, "sets")
    ex = examples(spark, sf)
    one = F.struct(F.col("id").cast("string").alias("id"), "question", "options",
                   F.col("correct_index").alias("correctIndex"), "source", "explanation")
    quiz = F.concat("source", F.lit("/"), F.floor(F.col("id") / 50).cast("string"))
    ex.groupBy(quiz.alias("id")).agg(F.collect_list(one).alias("questions")).select(
        "id", F.col("id").alias("name"), F.lit("easy").alias("difficulty"), "questions",
        F.lit("2024-05-01T10:00:00Z").alias("createdAt")).write.json(folder)
    rows = IO.quiz_questions(IO.read_quiz_sets(spark, folder, whole=False))
    return rows.select("question_id", "quiz_id", "question", F.array_join("options", "|").alias("options"),
                       "correct_index", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("training_jsonl", sql="SELECT split, text FROM (SELECT text, CASE WHEN row_number() OVER (ORDER BY md5('w' || doc_id), doc_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'valid' END AS split FROM documents)")
def _(spark, sf):
    folder = scratch(spark, "jsonl")
    split = TR.train_valid_split(documents(spark, sf).select("doc_id", "text"), 0.8, "w", "doc_id")
    IO.write_training_jsonl(split, folder)
    sets = [IO.read_training_jsonl(spark, f"{folder}/{s}.jsonl").withColumn("split", F.lit(s)) for s in ("train", "valid")]
    return sets[0].unionByName(sets[1])


@query("read_training_jsonl", sql="SELECT doc_id, text FROM documents WHERE NOT contains(text, chr(34)) AND NOT contains(text, '\\') AND contains(text, chr(10))")
def _(spark, sf):
    # raw quoting breaks on quotes and backslashes: such lines must be dropped, as must lines without text
    folder = scratch(spark, "raw")
    docs = documents(spark, sf)
    flat = F.replace("text", F.lit("\n"), F.lit("\\n"))
    has_break = F.contains(F.col("text"), F.lit("\n"))
    usable = ~F.contains(F.col("text"), F.lit('"')) & ~F.contains(F.col("text"), F.lit("\\"))
    name = F.when(has_break & usable, "text").otherwise("other")
    docs.select(F.concat(F.lit('{"'), name, F.lit('": "'), F.col("doc_id").cast("string"), F.lit(" "), flat, F.lit('"}')).alias("value")).write.text(folder)
    back = IO.read_training_jsonl(spark, folder)
    return back.select(F.substring_index("text", " ", 1).cast("bigint").alias("doc_id"),
                       F.expr("substring(text, instr(text, ' ') + 1)").alias("text"))


@query("export_chunks", sql=f"WITH {LINE_CHUNKS_SQL} SELECT doc_id, chunk_idx, text FROM line_chunks WHERE source = 'src3' AND contains(lower(text), 'en')")
def _(spark, sf):
    folder = scratch(spark, "export")
    IO.export_chunks(chunk_table(spark, sf), folder, "src3", "EN")
    return IO.read_chunks(spark, folder, "json").select("doc_id", "chunk_idx", "text")


@query("saved_examples", sql=f"WITH {EX_SQL} SELECT id, question, difficulty, (SELECT count(*) FROM ex) AS saved FROM ex")
def _(spark, sf):
    folder = scratch(spark, "examples")
    IO.save_examples(examples(spark, sf).select("id", "question", "difficulty"), folder)
    saved = IO.saved_count(spark, folder)
    return IO.load_examples(spark, folder, "id bigint, question string, difficulty string").withColumn(
        "saved", F.lit(saved).cast("bigint"))


# --- streams -----------------------------------------------------------------

def in_parts(table: DataFrame, key: str, start, parts: int = 4) -> None:
    """The table arrives in ``parts`` batches cut by ``key``, each in as many files as Spark gives it.

    ``start`` takes the stream and starts a query, which works off what is new and stops.
    """
    spark = table.sparkSession
    folder = scratch(spark, "stream")
    table = materialize(table, "stream-input")
    cuts = table.select(F.percentile_approx(key, [i / parts for i in range(1, parts)]).alias("c")).first()["c"]
    for i in range(parts):
        low = F.lit(True) if i == 0 else F.col(key) > cuts[i - 1]
        high = F.lit(True) if i == parts - 1 else F.col(key) <= cuts[i]
        table.filter(low & high).write.mode("append").parquet(folder)
        start(spark.readStream.schema(table.schema).parquet(folder)).awaitTermination()


@query("stream_study_progress", sql=PROGRESS_SQL + " FROM events WHERE event_type IN ('purchase', 'click') GROUP BY user_id")
def _(spark, sf):
    folder = scratch(spark, "progress")
    in_parts(read_table(spark, sf, "events"), "event_id",
             lambda live: jobs.stream_study_progress(activity(live), folder))
    return jobs.read_latest(spark, folder, "user_id").withColumn(
        "last_studied", F.date_format("last_studied", "yyyy-MM-dd HH:mm:ss"))


@query("stream_throughput", sql="""SELECT user_id AS generation_id, count(*) AS tokens, round(max(event_id) / 10, 6) AS elapsed,
  round(CASE WHEN max(event_id) > 0 THEN count(*) / (max(event_id) / 10) ELSE 0 END, 6) AS tokens_per_second FROM events GROUP BY user_id""")
def _(spark, sf):
    folder = scratch(spark, "throughput")
    ev = read_table(spark, sf, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    log = ev.select(F.col("user_id").alias("generation_id"), n.alias("tokens"), "event_id", (F.col("event_id") / 10).alias("elapsed"))
    in_parts(log, "event_id", lambda live: jobs.stream_throughput(live, folder))
    r = jobs.read_latest(spark, folder, "generation_id")
    return r.select("generation_id", "tokens", F.round("elapsed", 6).alias("elapsed"),
                    F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query("stream_early_stopping", sql=EARLY_SQL)
def _(spark, sf):
    folder = scratch(spark, "stopping")
    log = TR.parse_training_log(log_lines(spark, sf)).select("run_id", "iteration", "valid_loss")
    in_parts(log, "iteration", lambda live: jobs.stream_early_stopping(live, folder))
    return jobs.read_latest(spark, folder, "run_id")


@query("stream_ingest_chunks", sql=f"""WITH {PROCESS_SQL}
SELECT doc_id, chunk_idx, text, section, chapter, preceding_context, {q.word_count('text')} AS word_count FROM done""")
def _(spark, sf):
    folder = scratch(spark, "ingest")
    in_parts(marked_documents(spark, sf), "doc_id", lambda live: jobs.stream_ingest(live, folder, TARGET))
    return jobs.ingested_chunks(spark, folder).select(
        "doc_id", "chunk_idx", "text", "section", "chapter", "preceding_context", "word_count")


@query("stream_ingest_search", sql=f"""WITH {ASK_SQL}, {TOK_SQL}, {bm25_sql('asked')}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, {RANK} AS rank FROM bm) WHERE rank <= 5""")
def _(spark, sf):
    folder = scratch(spark, "ingest")
    docs = documents(spark, sf).select("doc_id", "source", "text")
    in_parts(docs, "doc_id", lambda live: jobs.stream_ingest(live, folder, TARGET))
    return R.keyword_search(text_queries(spark, sf), jobs.ingested_index(spark, folder), 5).withColumn(
        "score", F.round("score", 6))
