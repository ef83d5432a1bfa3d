"""Registered queries over training sets and study results.

Every passage of a document is one example: its first words are the question, its last the options.
Events stand for training reports and study activity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators import stopping
from lectern.operators import study as S
from lectern.operators import training as R
from lectern.plans import sqltext as q
from lectern.plans.document_queries import STEP, documents, passages, passages_sql
from lectern.plans.question_queries import level_of, render_sql
from lectern.plans.registry import query
from lectern.sources.tables import read_table


def examples(spark, sf) -> DataFrame:
    w = T.words(F.col("text"))
    return passages(spark, sf, 16).select(
        F.col("doc_id").alias("id"), F.array_join(F.slice(w, 1, 12), " ").alias("question"),
        F.slice(w, 13, 4).alias("options"), (F.col("doc_id") % 4).cast("int").alias("correct_index"),
        F.concat(F.lit('Found in "'), F.col("source"), F.lit('"')).alias("explanation"),
        level_of().alias("difficulty"), "source", "text")


EX_SQL = f"""ex AS (SELECT doc_id AS id, array_to_string({q.words('text')}[1:12], ' ') AS question, {q.words('text')}[13:16] AS options,
  doc_id % 4 AS correct_index, 'Found in "' || source || '"' AS explanation, [{q.in_list(K.DIFFICULTIES)}][(doc_id % 3) + 1] AS difficulty, source, text FROM {passages_sql(16)})"""
NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


@query("assign_difficulty", sql=f"SELECT doc_id, [{q.in_list(K.DIFFICULTIES)}][{q.bucket('d1', 'doc_id', 3)} + 1] AS difficulty FROM documents")
def _(spark, sf):
    return R.assign_difficulty(documents(spark, sf), "d1", "doc_id").select("doc_id", "difficulty")


@query("dedup_questions", sql=f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY {NORM.format('text')} ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, source FROM r WHERE rn = 1""")
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", F.col("text").alias("question"))
    return R.dedup_questions(docs, "doc_id").select("doc_id", "source")


@query("train_valid_split", sql="""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('split' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS split FROM r""")
def _(spark, sf):
    return R.train_valid_split(documents(spark, sf).select("doc_id"), 0.8, "split", "doc_id")


@query("valid_first_split", sql="""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('vf' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= greatest(1, floor(n * 0.1)) THEN 'valid' ELSE 'train' END AS split FROM r""")
def _(spark, sf):
    return R.valid_first_split(documents(spark, sf).select("doc_id"), 0.1, "vf", "doc_id")


def esc(x: str) -> str:
    return (rf"""replace(replace(replace(replace(replace({x}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')""")


ANSWER_SQL = f"""'{{"question": "' || {esc('question')} || '", "options": [' || array_to_string(list_transform(options, lambda o: '"' || {esc('o')} || '"'), ', ')
  || '], "correctIndex": ' || correct_index || ', "explanation": "' || {esc('explanation')} || '"}}'"""


@query("format_chatml", sql=f"""WITH {EX_SQL} SELECT id, '<|im_start|>system' || chr(10) || {q.quote(K.CHATML_SYSTEM)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)
  || {render_sql(K.CHATML_USER, difficulty='lower(difficulty)')} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {ANSWER_SQL} || '<|im_end|>' AS text FROM ex""")
def _(spark, sf):
    return R.format_chatml(examples(spark, sf)).select("id", "text")


FIRST_SQL = "fc AS (SELECT source, arg_min(text, doc_id) AS chunk_text FROM documents GROUP BY source)"


def with_chunks(spark, sf) -> DataFrame:
    chunks = documents(spark, sf).withColumn("chunk_idx", F.lit(0))
    return R.attach_chunk(examples(spark, sf).drop("text"), chunks)


@query("attach_chunk", sql=f"WITH {EX_SQL}, {FIRST_SQL} SELECT id, source, chunk_text FROM ex JOIN fc USING (source)")
def _(spark, sf):
    return with_chunks(spark, sf).select("id", "source", "chunk_text")


@query("format_role_tags", sql=f"""WITH {EX_SQL}, {FIRST_SQL} SELECT id, '<|system|>' || chr(10) || '{K.ROLE_TAG_SYSTEM}<|end|>' || chr(10) || '<|user|>' || chr(10)
  || {q.quote(K.ROLE_TAG_ASK)} || chr(10) || chr(10) || 'Source: ' || source || chr(10) || 'Passage:' || chr(10) || chunk_text[1:800] || chr(10) || chr(10)
  || {q.quote(K.ROLE_TAG_REPLY)} || '<|end|>' || chr(10) || '<|assistant|>' || chr(10)
  || {ANSWER_SQL} || '<|end|>' AS line FROM ex JOIN fc USING (source)""")
def _(spark, sf):
    return R.format_role_tags(with_chunks(spark, sf)).select("id", "line")


@query("check_jsonl", sql=f"""WITH {EX_SQL}, l AS (SELECT CASE id % 4 WHEN 0 THEN '{{"text": "<|assistant|> ' || {esc('question')} || '<|end|>"}}' WHEN 1 THEN '{{"text": "' || {esc('question')} || '"}}'
  WHEN 2 THEN 'not json ' || question ELSE '' END AS value FROM ex),
v AS (SELECT CASE WHEN json_valid(value) THEN contains(value ->> '$.text', '<|assistant|>') AND contains(value ->> '$.text', '<|end|>') ELSE false END AS ok FROM l WHERE value <> '')
SELECT sum(ok::INT)::BIGINT AS valid, sum((NOT ok)::INT)::BIGINT AS invalid FROM v""")
def _(spark, sf):
    n, text = F.col("id") % 4, R.json_escape(F.col("question"))
    value = (
        F.when(n == 0, F.concat(F.lit('{"text": "<|assistant|> '), text, F.lit('<|end|>"}')))
        .when(n == 1, F.concat(F.lit('{"text": "'), text, F.lit('"}')))
        .when(n == 2, F.concat(F.lit("not json "), F.col("question"))).otherwise("")
    )
    return R.check_jsonl(examples(spark, sf).select(value.alias("value")))


@query("generation_summary", sql=f"""SELECT count(*) AS generated, count(DISTINCT {NORM.format('text')}) AS kept, count(*) - count(DISTINCT {NORM.format('text')}) AS duplicates,
  round(count(DISTINCT {NORM.format('text')}) / count(*) * 100, 6) AS success_rate FROM documents""")
def _(spark, sf):
    docs = documents(spark, sf).select(F.col("text").alias("question"))
    return R.generation_summary(docs).withColumn("success_rate", F.round("success_rate", 6))


@query("union_difficulties", sql="""SELECT difficulty, count(*) AS questions, sum(length(text))::BIGINT AS chars FROM (
  SELECT 'easy' AS difficulty, text FROM benchmark UNION ALL SELECT 'medium', text FROM conversations UNION ALL SELECT 'hard', text FROM documents) GROUP BY difficulty""")
def _(spark, sf):
    sets = {d: read_table(spark, sf, t).select("text") for d, t in zip(K.DIFFICULTIES, ("benchmark", "conversations", "documents"))}
    return R.union_difficulties(sets).groupBy("difficulty").agg(
        F.count("*").alias("questions"), F.sum(F.length("text")).alias("chars"))


# --- training logs -----------------------------------------------------------

def log_lines(spark, sf) -> DataFrame:
    """A report line per event; clicks report validation, other types training."""
    ev = read_table(spark, sf, "events")
    value = F.format_string("%.2f", "value")
    line = (
        F.when(F.col("event_type") == "click", F.concat(
            F.lit("Iteration "), F.col("event_id").cast("string"), F.lit(": validation loss "), value, F.lit(", validation time 1.5s")))
        .when(F.col("event_type") == "error", F.concat(F.lit("Iteration x: training loss oops, "), value))
        .otherwise(F.concat(F.lit("Iteration "), F.col("event_id").cast("string"), F.lit(": training loss "), value, F.lit(", it/s 2.0")))
    )
    return ev.select(F.col("user_id").alias("run_id"), "event_id", line.alias("line"))


LOG_SQL = """lines AS (SELECT user_id AS run_id, event_id, CASE event_type WHEN 'click' THEN 'Iteration ' || event_id || ': validation loss ' || printf('%.2f', value) || ', validation time 1.5s'
  WHEN 'error' THEN 'Iteration x: training loss oops, ' || printf('%.2f', value) ELSE 'Iteration ' || event_id || ': training loss ' || printf('%.2f', value) || ', it/s 2.0' END AS line FROM events),
parsed AS (SELECT run_id, event_id, coalesce(TRY_CAST(regexp_extract(line, 'Iteration ([^:]*):', 1) AS BIGINT), 0) AS iteration,
  coalesce(TRY_CAST(regexp_extract(line, 'training loss ([^,]*),', 1) AS DOUBLE), 0) AS train_loss,
  TRY_CAST(regexp_extract(line, 'validation loss (.*?), validation time', 1) AS DOUBLE) AS valid_loss FROM lines)"""


@query("parse_training_log", sql=f"WITH {LOG_SQL} SELECT event_id, iteration, train_loss, valid_loss FROM parsed")
def _(spark, sf):
    return R.parse_training_log(log_lines(spark, sf)).select("event_id", "iteration", "train_loss", "valid_loss")


EARLY_SQL = f"""WITH RECURSIVE {LOG_SQL},
v AS (SELECT run_id, iteration, valid_loss, row_number() OVER (PARTITION BY run_id ORDER BY iteration) AS n FROM parsed WHERE valid_loss IS NOT NULL),
fold AS (SELECT DISTINCT run_id, 0::BIGINT AS n, 'Infinity'::DOUBLE AS best, 0::BIGINT AS patience, 0::BIGINT AS best_iteration, NULL::BIGINT AS stopped_at FROM v
  UNION ALL SELECT f.run_id, v.n, CASE WHEN v.valid_loss < f.best - 0.001 THEN v.valid_loss ELSE f.best END,
    CASE WHEN v.valid_loss < f.best - 0.001 THEN 0 ELSE f.patience + 1 END,
    CASE WHEN v.valid_loss < f.best - 0.001 THEN v.iteration ELSE f.best_iteration END,
    CASE WHEN NOT v.valid_loss < f.best - 0.001 AND f.patience + 1 >= 5 THEN v.iteration END
  FROM fold f JOIN v ON v.run_id = f.run_id AND v.n = f.n + 1 WHERE f.stopped_at IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC) AS last FROM fold)
SELECT run_id, best AS best_loss, best_iteration, patience AS patience_counter, stopped_at FROM r WHERE last = 1"""


@query("early_stopping", sql=EARLY_SQL)
def _(spark, sf):
    return stopping.early_stopping(R.parse_training_log(log_lines(spark, sf)))


@query("training_progress", sql="""WITH t AS (SELECT event_id, user_id, event_id % 7 AS done, user_id % 5 AS total FROM events)
SELECT event_id, round(CASE WHEN total > 0 THEN done / total * 100 ELSE 0 END, 6) AS percent_complete FROM t""")
def _(spark, sf):
    ev = read_table(spark, sf, "events").select(
        "event_id", (F.col("event_id") % 7).alias("iteration"), (F.col("user_id") % 5).alias("total_iterations"))
    return R.training_progress(ev).select("event_id", F.round("percent_complete", 6).alias("percent_complete"))


# --- study -------------------------------------------------------------------

def quiz_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Passages of four words, the options, of a source form a quiz; those of labelled documents are answered."""
    asked = passages(spark, sf, 4)
    n = F.col("doc_id")
    questions = asked.select(
        F.col("source").alias("quiz_id"), n.alias("question_id"), T.words(F.col("text")).alias("options"),
        (n % 4).cast("int").alias("correct_index"))
    labels = read_table(spark, sf, "labels").select(F.col("doc_id").alias("of"), "quality")
    answers = asked.withColumn("of", F.expr(f"doc_id div {STEP}")).join(labels, "of").select(
        F.col("source").alias("quiz_id"), n.alias("question_id"), ((n + 1 - F.col("quality")) % 4).cast("int").alias("user_answer"))
    return questions, answers


QUIZ_SQL = f"""qs AS (SELECT source AS quiz_id, doc_id AS question_id, {q.words('text')} AS options, doc_id % 4 AS correct_index FROM {passages_sql(4)}),
ans AS (SELECT question_id, (question_id + 1 - quality) % 4 AS user_answer FROM qs JOIN labels ON labels.doc_id = question_id // {STEP}),
qa AS (SELECT qs.*, user_answer FROM qs LEFT JOIN ans USING (question_id))"""


@query("grade_quiz", sql=f"""WITH {QUIZ_SQL}, g AS (SELECT quiz_id, sum(coalesce((user_answer = correct_index)::INT, 0))::BIGINT AS score, count(*) AS questions FROM qa GROUP BY quiz_id)
SELECT *, round(score / questions * 100, 6) AS percent, CASE WHEN score / questions * 100 >= 70 THEN 'high' WHEN score / questions * 100 >= 50 THEN 'middle' ELSE 'low' END AS band FROM g""")
def _(spark, sf):
    return S.grade_quiz(*quiz_tables(spark, sf)).withColumn("percent", F.round("percent", 6))


@query("missed_questions", sql=f"WITH {QUIZ_SQL} SELECT quiz_id, question_id, user_answer, correct_index FROM qa WHERE user_answer IS DISTINCT FROM correct_index")
def _(spark, sf):
    return S.missed_questions(*quiz_tables(spark, sf)).select("quiz_id", "question_id", "user_answer", "correct_index")


@query("quiz_report", sql=f"""WITH {QUIZ_SQL}, o AS (SELECT quiz_id, question_id, correct_index, user_answer, unnest(options) AS option, unnest(range(len(options))) AS pos FROM qa)
SELECT quiz_id, question_id, pos, ['A','B','C','D'][pos + 1] || '. ' || option || CASE WHEN pos = correct_index THEN ' ✓' WHEN pos = user_answer THEN ' ✗' ELSE '' END AS line FROM o""")
def _(spark, sf):
    return S.quiz_report(*quiz_tables(spark, sf))


def activity(events: DataFrame) -> DataFrame:
    """Purchases are quizzes scored by value of 100 points, clicks reviewed cards."""
    return events.select(
        "user_id", F.when(F.col("event_type") == "purchase", "quiz").when(F.col("event_type") == "click", "card").alias("kind"),
        F.floor("value").alias("score"), F.lit(500).cast("bigint").alias("questions"), "ts")


PROGRESS_SQL = """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS quizzes_taken,
  coalesce(sum(floor(value)::BIGINT) FILTER (event_type = 'purchase'), 0)::BIGINT AS total_score,
  coalesce(sum(500) FILTER (event_type = 'purchase'), 0)::BIGINT AS total_questions, count(*) FILTER (event_type = 'click') AS cards_reviewed,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_studied"""


@query("study_progress", sql=PROGRESS_SQL + """, round(sum(floor(value)) FILTER (event_type = 'purchase') / sum(500) FILTER (event_type = 'purchase') * 100, 6) AS average_percent
FROM events WHERE event_type IN ('purchase', 'click') GROUP BY user_id""")
def _(spark, sf):
    p = S.with_average(S.study_progress(activity(read_table(spark, sf, "events"))))
    return p.withColumn("last_studied", F.date_format("last_studied", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "average_percent", F.round("average_percent", 6))


@query("library_overview", sql="""SELECT count(DISTINCT conv_id) AS quiz_sets, count(*) AS total_questions,
  (SELECT count(DISTINCT source) FROM documents) AS card_sets, (SELECT count(*) FROM documents) AS total_cards FROM conversations""")
def _(spark, sf):
    quizzes = read_table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("questions"))
    # a set's cards are kept in parts of 64 at most, so no source is gathered whole
    parts = documents(spark, sf).groupBy("source", F.floor(F.col("doc_id") / 64).alias("part")).agg(F.collect_list("doc_id").alias("cards"))
    sets = parts.groupBy("source").agg(F.sum(F.size("cards")).alias("n"))
    over = S.library_overview(quizzes, parts)
    return over.select("quiz_sets", "total_questions", sets.agg(F.count("*").alias("c")).scalar().alias("card_sets"), "total_cards")


@query("topic_completion", sql="SELECT source, sum(quality)::BIGINT AS completed, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY source")
def _(spark, sf):
    topics = documents(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").withColumn("is_complete", F.col("quality") == 1)
    return S.topic_completion(topics, "source")


@query("shuffle_cards", sql="SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5('c1' || turn), turn) - 1 AS pos FROM conversations")
def _(spark, sf):
    return S.shuffle_cards(read_table(spark, sf, "conversations"), "c1", "conv_id", "turn").select("conv_id", "turn", "pos")
