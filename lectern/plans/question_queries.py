"""Registered queries around question generation.

Model replies are spelled from the documents' own words, in the shapes models produce:
clean, fenced, chatty, labelled, broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import prompts as P
from lectern.functions import text as T
from lectern.operators import generation as G
from lectern.operators import parsing as X
from lectern.operators import validation as V
from lectern.plans import sqltext as q
from lectern.plans.document_queries import BOILER_SQL, boiler_chunks, documents, passages, passages_sql
from lectern.plans.registry import query
from lectern.sources.tables import read_table

# --- replies -----------------------------------------------------------------

SHAPES = 12


def replies(spark, sf) -> DataFrame:
    """Five replies per document: (doc_id, attempt, seq, source, text, raw)."""
    w = T.words(F.regexp_replace("text", r"[^\p{L}\p{N} ]", " "))
    base = passages(spark, sf, 60).select("doc_id", "source", "text", w.alias("w")).select(
        "*", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("c"))
    n = F.pmod(F.col("doc_id") * 5 + F.col("c") * 7, F.lit(SHAPES)).cast("int")
    # every part is spelled once: Java interprets a method as long as one copy per shape makes it
    long = F.col("c") == 4
    words = F.array_join(F.slice("w", F.when(long, 1).otherwise(F.col("c") + 1), F.when(long, 80).otherwise(8)), " ")
    opener = F.when(n == 10, "What does the author say in the text about ").when(
        F.col("c") == 2, "it is ").otherwise("What of ")
    staged = base.select("*", n.alias("n"), F.concat(opener, words, F.lit("?")).alias("ask"))
    n = F.col("n")
    ask = F.when(F.col("c").isin(3, 4), F.lower("ask")).otherwise(F.col("ask"))

    def option(i):
        at = F.col("c") + i * 3
        label = F.when(n == 3, "ABCD"[i] + ") ").otherwise("")
        return F.concat(label, F.coalesce(F.get("w", F.when(n == 4, F.col("c")).otherwise(at) if i == 1 else at), F.lit("")))

    opts = [option(i) for i in range(4)]
    opts[1] = F.when(n == 5, "Option1").otherwise(opts[1])
    last = F.when(n == 6, '"').otherwise(F.concat(F.lit('", "'), opts[3], F.lit('"')))
    index = F.when(n == 7, '"1"').when(n == 11, "7").otherwise((F.col("doc_id") % 4).cast("string"))
    why = F.when(n == 8, "").otherwise(F.concat(F.lit(', "explanation": "Seen in '), F.col("source"), F.lit(' as stated"')))
    start = F.when(n == 1, '```json\n{"question": "').when(n == 2, 'Here it is: {"question": "').when(
        n == 9, "No question: ").otherwise('{"question": "')
    end = F.when(n == 1, "}\n```").when(n == 2, "} I hope it helps").otherwise("}")
    rest = F.when(n == 9, "").otherwise(F.concat(
        F.lit('", "options": ["'), opts[0], F.lit('", "'), opts[1], F.lit('", "'), opts[2], last,
        F.lit('], "correctIndex": '), index, why, end))
    return staged.select(
        "doc_id", F.floor(F.col("c") / 3).cast("int").alias("attempt"), F.col("c").alias("seq"),
        "source", "text", F.concat(start, ask, rest).alias("raw"),
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("c").cast("string")).alias("reply_id"))


REPLIES_SQL = rf"""base AS (SELECT doc_id, source, text,
    {q.words(r"regexp_replace(text, '[^\p{L}\p{N} ]', ' ', 'g')")} AS w, unnest(range(5)) AS c FROM {passages_sql(60)}),
n AS (SELECT *, (doc_id * 5 + c * 7) % {SHAPES} AS n FROM base),
a AS (SELECT *, CASE WHEN n = 10 THEN 'What does the author say in the text about ' WHEN c = 2 THEN 'it is ' ELSE 'What of ' END
  || CASE WHEN c = 4 THEN array_to_string(w[1:80], ' ') ELSE array_to_string(w[c + 1:c + 8], ' ') END || '?' AS ask0,
  CASE WHEN n = 3 THEN 'A) ' ELSE '' END || coalesce(w[c + 1], '') AS o1,
  CASE WHEN n = 3 THEN 'B) ' ELSE '' END || coalesce(w[c + 4], '') AS o2,
  CASE WHEN n = 3 THEN 'C) ' ELSE '' END || coalesce(w[c + 7], '') AS o3,
  CASE WHEN n = 3 THEN 'D) ' ELSE '' END || coalesce(w[c + 10], '') AS o4 FROM n),
j AS (SELECT *, CASE WHEN c IN (3, 4) THEN lower(ask0) ELSE ask0 END AS ask FROM a),
js AS (SELECT *, '{{"question": "' || ask || '", "options": ["' || o1 || '", "' ||
  CASE n WHEN 4 THEN o1 WHEN 5 THEN 'Option1' ELSE o2 END || '", "' || o3 || '"' || CASE WHEN n = 6 THEN '' ELSE ', "' || o4 || '"' END
  || '], "correctIndex": ' || CASE n WHEN 7 THEN '"1"' WHEN 11 THEN '7' ELSE (doc_id % 4)::VARCHAR END
  || CASE WHEN n = 8 THEN '' ELSE ', "explanation": "Seen in ' || source || ' as stated"' END || '}}' AS json FROM j),
replies AS (SELECT doc_id, c // 3 AS attempt, c AS seq, source, text, doc_id || '-' || c AS reply_id,
  CASE n WHEN 1 THEN '```json' || chr(10) || json || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || json || ' I hope it helps'
    WHEN 9 THEN 'No question: ' || ask ELSE json END AS raw FROM js)"""


def extract_sql(raw: str = "raw", o: str = r"\{", c: str = r"\}") -> str:
    return rf"nullif(regexp_extract(replace(replace({raw}, '```json', ''), '```', ''), '(?s){o}.*{c}'), '')"


DECODE_SQL = f"""ex AS (SELECT *, {extract_sql()} AS body FROM replies),
ok AS (SELECT * FROM ex WHERE body IS NOT NULL AND json_valid(body)),
dec AS (SELECT doc_id, attempt, seq, source, text, reply_id, body ->> '$.question' AS question,
  list_transform(json_extract(body, '$.options[*]'), lambda o: o ->> '$') AS options,
  (body ->> '$.correctIndex')::BIGINT AS idx, coalesce(body ->> '$.explanation', '{K.DEFAULT_EXPLANATION}') AS explanation
  FROM ok WHERE json_type(body, '$.question') = 'VARCHAR' AND json_type(body, '$.options') = 'ARRAY'
    AND json_type(body, '$.correctIndex') IN ('UBIGINT', 'BIGINT')
    AND len(list_filter(json_extract(body, '$.options[*]'), lambda o: json_type(o) <> 'VARCHAR')) = 0)"""

LABEL = "o"
for _p in K.OPTION_LABELS:
    LABEL = f"regexp_replace({LABEL}, '{_p}', '')"
MCQ_SQL = f"""{DECODE_SQL},
cl AS (SELECT * REPLACE (list_transform(options, lambda o: trim({LABEL.replace('(o,', '(trim(o),', 1)})) AS options) FROM dec),
acc AS (SELECT * FROM cl WHERE len(options) = 4 AND len(list_distinct(options)) = 4
  AND len(list_filter(options, lambda o: lower(o) IN ({q.in_list(K.PLACEHOLDER_OPTIONS)}) OR length(o) <= 1)) = 0),
sh AS (SELECT *, list_sort(list_transform(options, lambda o, i: md5('options' || reply_id || ':' || (i - 1)) || '|' || (i - 1) || '|' || o)) AS k FROM acc),
mcq AS (SELECT doc_id, attempt, seq, source, text, reply_id, trim(question) AS question,
  list_transform(k, lambda x: x[36:]) AS options,
  greatest(coalesce(list_position(list_transform(k, lambda x: x[34:34]::BIGINT), idx), 0) - 1, 0)::BIGINT AS correct_index, explanation FROM sh)"""


def mcqs(spark, sf) -> DataFrame:
    return X.parse_mcq(replies(spark, sf), "reply_id")


def joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


@query("extract_json", sql=f"WITH {REPLIES_SQL} SELECT reply_id, {extract_sql()} AS body FROM replies")
def _(spark, sf):
    return replies(spark, sf).select("reply_id", X.extract_json(F.col("raw")).alias("body"))


@query("parse_mcq", sql=f"""WITH {REPLIES_SQL}, {MCQ_SQL}
SELECT reply_id, question, array_to_string(options, '|') AS options, correct_index, explanation FROM mcq""")
def _(spark, sf):
    return mcqs(spark, sf).select("reply_id", "question", joined("options"), "correct_index", "explanation")


@query("parse_training_mcq", sql=f"""WITH {REPLIES_SQL}, {DECODE_SQL}
SELECT reply_id, question, array_to_string(options, '|') AS options, idx AS correct_index, explanation FROM dec
WHERE len(options) = 4 AND len(list_distinct(options)) = 4 AND idx BETWEEN 0 AND 3 AND length(question) > 20""")
def _(spark, sf):
    return X.parse_training_mcq(replies(spark, sf)).select(
        "reply_id", "question", joined("options"), "correct_index", "explanation")


LABELS = ["A) ", "b. ", "(C) ", "D : ", " a)  ", ""]


@query("clean_option_label", sql=f"""WITH l AS (SELECT doc_id, [{q.in_list(LABELS)}][(doc_id % 6) + 1] || array_to_string({q.words('text')}[1:3], ' ') AS o FROM {passages_sql(3)})
SELECT doc_id, trim({LABEL.replace('(o,', '(trim(o),', 1)}) AS option FROM l""")
def _(spark, sf):
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("doc_id") % 6).cast("int"))
    option = F.concat(label, F.array_join(F.slice(T.words(F.col("text")), 1, 3), " "))
    return passages(spark, sf, 3).select("doc_id", X.clean_option_label(option).alias("option"))


@query("shuffle_options", sql=f"""WITH w AS (SELECT doc_id, {q.words('text')}[1:4] AS w FROM {passages_sql(4)}),
k AS (SELECT doc_id, list_sort(list_transform(w, lambda o, i: md5('mix' || doc_id || ':' || (i - 1)) || '|' || (i - 1) || '|' || o)) AS k FROM w)
SELECT doc_id, array_to_string(list_transform(k, lambda x: x[36:]), '|') AS options,
  greatest(coalesce(list_position(list_transform(k, lambda x: x[34:34]::BIGINT), doc_id % 5), 0) - 1, 0)::BIGINT AS correct_index FROM k""")
def _(spark, sf):
    s = X.shuffled_options(F.slice(T.words(F.col("text")), 1, 4), (F.col("doc_id") % 5).cast("int"), "mix", F.col("doc_id"))
    return passages(spark, sf, 4).select("doc_id", s.alias("s")).select(
        "doc_id", F.array_join("s.options", "|").alias("options"), "s.correct_index")


# --- validation --------------------------------------------------------------

TYPE_SQL = r"""CASE WHEN regexp_matches(trim(o), '^\d{4}\s*(BCE|CE|AD|BC)?$') THEN 'year'
  WHEN regexp_matches(trim(o), '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$') THEN 'number'
  WHEN len(""" + q.words("trim(o)") + r""") <= 4 AND len(list_filter(""" + q.words("trim(o)") + r""", lambda z_: NOT regexp_matches(z_, '^\p{Lu}'))) = 0 THEN 'name'
  ELSE 'phrase' END"""
VAGUE_SQL = " + ".join(f"contains(lq, '{p}')::INT" for p in K.VAGUE_PHRASES)
PRONOUN_SQL = "(" + " OR ".join(f"starts_with(lq, '{p}')" for p in K.PRONOUN_STARTS) + ")"
BAD_SQL = " OR ".join(f"contains(lower(b_), '{p}')" for p in K.BAD_OPTION_PARTS)
VALID_SQL = rf"""vf AS (SELECT *, lower(question) AS lq FROM mcq),
vg AS (SELECT *, {VAGUE_SQL} AS vague, {PRONOUN_SQL} AS pron, NOT regexp_matches(question, '\p{{Lu}}') AS nocap,
  length(question) > 300 AS long_q, length(question) < 15 AS short_q, len(options) <> 4 AS cnt,
  correct_index < 0 OR correct_index >= len(options) AS rng, len(list_distinct(options)) <> len(options) AS dup,
  len(list_filter(options, lambda b_: {BAD_SQL})) > 0 AS bad,
  len(list_distinct(list_transform(options, lambda o: {TYPE_SQL}))) > 1 AS mixed FROM vf),
judged AS (SELECT *, NOT (cnt OR rng OR dup OR short_q OR bad OR vague > 0 OR pron) AS is_valid,
  greatest(5 - 2 * vague - 2 * pron::INT - nocap::INT - long_q::INT, 0)::BIGINT AS self_containment,
  array_to_string(list_filter([CASE WHEN cnt THEN 'option_count' END, CASE WHEN rng THEN 'index_range' END, CASE WHEN dup THEN 'duplicate_options' END,
    CASE WHEN short_q THEN 'question_short' END, CASE WHEN bad THEN 'bad_option' END, CASE WHEN vague > 0 THEN 'vague' END,
    CASE WHEN pron THEN 'pronoun_start' END, CASE WHEN mixed THEN 'mixed_types' END, CASE WHEN long_q THEN 'question_long' END], lambda x: x IS NOT NULL), '|') AS issues FROM vg)"""
SCORE_SQL = r"""scored AS (SELECT *, CASE WHEN length(question) BETWEEN 30 AND 150 THEN 2 WHEN length(question) BETWEEN 20 AND 200 THEN 1 ELSE 0 END
  + self_containment * 2
  + CASE WHEN list_var_pop(list_transform(options, lambda o: length(o))) < 100 THEN 2 WHEN list_var_pop(list_transform(options, lambda o: length(o))) < 400 THEN 1 ELSE 0 END
  + CASE WHEN length(explanation) >= 20 THEN 1 ELSE 0 END
  + least(len(list_intersect(list_filter(regexp_split_to_array(lower(text), '[\p{Zs}\t]'), lambda w: length(w) > 5),
      regexp_split_to_array(lower(question), '[\p{Zs}\t]'))), 3) AS pref FROM judged)"""


@query("classify_option_type", sql=f"""WITH w AS (SELECT doc_id, chunk_idx, CASE chunk_idx % 4 WHEN 0 THEN (1000 + doc_id)::VARCHAR || ' CE' WHEN 1 THEN doc_id || '.5'
  WHEN 2 THEN upper(array_to_string({q.words('text')}[1:3], ' ')) ELSE array_to_string({q.words('text')}[1:6], ' ') END AS o
  FROM (SELECT doc_id, text, unnest(range(4)) AS chunk_idx FROM {passages_sql(6)}))
SELECT doc_id, chunk_idx, {TYPE_SQL} AS type FROM w""")
def _(spark, sf):
    n = F.col("chunk_idx")
    w = T.words(F.col("text"))
    o = (
        F.when(n == 0, F.concat((F.col("doc_id") + 1000).cast("string"), F.lit(" CE")))
        .when(n == 1, F.concat(F.col("doc_id").cast("string"), F.lit(".5")))
        .when(n == 2, F.upper(F.array_join(F.slice(w, 1, 3), " "))).otherwise(F.array_join(F.slice(w, 1, 6), " "))
    )
    return passages(spark, sf, 6).select("doc_id", "text", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("chunk_idx")).select(
        "doc_id", "chunk_idx", V.classify_option_type(o).alias("type"))


@query("validate_question", sql=f"""WITH {REPLIES_SQL}, {MCQ_SQL}, {VALID_SQL}
SELECT reply_id, is_valid, self_containment, issues FROM judged""")
def _(spark, sf):
    return V.with_validation(mcqs(spark, sf)).select("reply_id", "is_valid", "self_containment", joined("issues"))


@query("score_candidate", sql=f"""WITH {REPLIES_SQL}, {MCQ_SQL}, {VALID_SQL}, {SCORE_SQL}
SELECT reply_id, pref::BIGINT AS preference FROM scored""")
def _(spark, sf):
    judged = V.with_validation(mcqs(spark, sf))
    return judged.select("reply_id", V.score_candidate(
        F.col("question"), F.col("options"), F.col("explanation"), F.col("self_containment"), F.col("text")).alias("preference"))


@query("best_of_n", sql=f"""WITH {REPLIES_SQL}, {MCQ_SQL}, {VALID_SQL}, {SCORE_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN self_containment >= 4 THEN 0 ELSE 1 END,
  CASE WHEN self_containment >= 4 THEN 0 ELSE -pref END, attempt, seq) AS rn FROM scored WHERE is_valid AND self_containment >= 2)
SELECT doc_id, attempt, seq, question, array_to_string(options, '|') AS options, correct_index, self_containment FROM r WHERE rn = 1""")
def _(spark, sf):
    return V.best_of_n(mcqs(spark, sf), "doc_id").select(
        "doc_id", "attempt", "seq", "question", joined("options"), "correct_index", "self_containment")


@query("check_outputs", sql=f"""WITH {REPLIES_SQL}, {DECODE_SQL}
SELECT reply_id, CASE WHEN question = '' THEN 'question_empty' WHEN len(options) <> 4 THEN 'option_count'
  WHEN len(list_filter(options, lambda o: lower(o) IN ({q.in_list(K.ACCEPTANCE_PLACEHOLDERS)}))) > 0 THEN 'placeholder'
  WHEN len(list_filter(options, lambda o: length(o) <= 1)) > 0 THEN 'option_short'
  WHEN len(list_distinct(options)) <> 4 THEN 'duplicate_options' WHEN idx < 0 OR idx >= 4 THEN 'index_range' END AS reason FROM dec""")
def _(spark, sf):
    return X.decode_mcq(replies(spark, sf)).select("reply_id", V.check_output(
        F.col("question"), F.col("options"), F.col("correct_index")).alias("reason"))


QV = " OR ".join(f"contains(lower(question), '{p}')" for p in K.QUICK_VAGUE_PHRASES)
QP = " OR ".join(f"starts_with(lower(question), '{p}')" for p in K.QUICK_PRONOUN_STARTS)
QO = " OR ".join(f"contains(lower(o), '{p}')" for p in K.QUICK_PLACEHOLDERS)


@query("quality_rates", sql=f"""WITH {REPLIES_SQL}, {DECODE_SQL},
o AS (SELECT r.source, d.question, d.options FROM replies r LEFT JOIN dec d USING (reply_id))
SELECT source, count(*) AS outputs, round(avg(coalesce(question IS NOT NULL AND len(options) = 4, false)::INT), 6) AS json_rate,
  round(avg(coalesce(NOT ({QV} OR {QP}), false)::INT), 6) AS containment_rate,
  round(avg(coalesce(len(list_distinct(options)) = len(options) AND len(list_filter(options, lambda o: length(o) < 2 OR {QO})) = 0, false)::INT), 6) AS option_rate
FROM o GROUP BY source""")
def _(spark, sf):
    rates = V.quality_rates(X.decode_mcq(replies(spark, sf), keep_failed=True), "source")
    return rates.select("source", "outputs", *[F.round(c, 6).alias(c) for c in ("json_rate", "containment_rate", "option_rate")])


# --- open questions, cards, summaries ----------------------------------------

def simple_words(n_from: int, n_to: int) -> Column:
    w = T.words(F.regexp_replace("text", r"[^\p{L}\p{N} ]", " "))
    return F.array_join(F.slice(w, n_from, n_to - n_from + 1), " ")


def simple_sql(n_from: int, n_to: int) -> str:
    bare = r"regexp_replace(text, '[^\p{L}\p{N} ]', ' ', 'g')"
    return f"array_to_string({q.words(bare)}[{n_from}:{n_to}], ' ')"


def open_replies(spark, sf) -> DataFrame:
    n = F.col("doc_id") % 5
    points = F.when(n == 1, "").when(n == 2, ', "keyPoints": []').otherwise(
        F.concat(F.lit(', "keyPoints": ["'), simple_words(1, 1), F.lit('", "'), simple_words(2, 2), F.lit('"]')))
    answer = F.when(n == 3, "").otherwise(F.concat(F.lit(', "idealAnswer": "'), simple_words(3, 12), F.lit('"')))
    raw = F.concat(F.lit('Sure ```json {"question": "Explain '), simple_words(1, 6), F.lit('"'), answer, points, F.lit("} ```"))
    return passages(spark, sf, 15).select("doc_id", "source", "text", raw.alias("raw"))


OPEN_SQL = f"""oraw AS (SELECT doc_id, source, text, '{{"question": "Explain ' || {simple_sql(1, 6)} || '"'
  || CASE WHEN doc_id % 5 = 3 THEN '' ELSE ', "idealAnswer": "' || {simple_sql(3, 12)} || '"' END
  || CASE doc_id % 5 WHEN 1 THEN '' WHEN 2 THEN ', "keyPoints": []' ELSE ', "keyPoints": ["' || {simple_sql(1, 1)} || '", "' || {simple_sql(2, 2)} || '"]' END || '}}' AS body FROM {passages_sql(15)}),
opened AS (SELECT doc_id, source, body ->> '$.question' AS question, body ->> '$.idealAnswer' AS ideal_answer,
  coalesce(array_to_string(list_transform(json_extract(body, '$.keyPoints[*]'), lambda o: o ->> '$'), '|'), '') AS key_points, text[1:500] AS context
  FROM oraw WHERE json_type(body, '$.idealAnswer') = 'VARCHAR')"""


@query("parse_open_ended", sql=f"WITH {OPEN_SQL} SELECT doc_id, question, ideal_answer, key_points, context FROM opened")
def _(spark, sf):
    return X.parse_open_ended(open_replies(spark, sf)).select(
        "doc_id", "question", "ideal_answer", joined("key_points"), "context")


@query("check_open_outputs", sql=f"""WITH {OPEN_SQL} SELECT doc_id, CASE WHEN question = '' THEN 'question_empty'
  WHEN ideal_answer = '' THEN 'answer_empty' WHEN length(ideal_answer) < 20 THEN 'answer_short' END AS reason FROM opened""")
def _(spark, sf):
    o = X.parse_open_ended(open_replies(spark, sf))
    return o.select("doc_id", V.check_open_output(F.col("question"), F.col("ideal_answer")).alias("reason"))


@query("parse_flashcards", sql=f"""WITH c AS (SELECT doc_id, source, doc_id % 4 AS n, {simple_sql(1, 4)} AS q1, {simple_sql(5, 8)} AS a1, {simple_sql(9, 12)} AS q2 FROM {passages_sql(12)})
SELECT doc_id, source, 0::BIGINT AS pos, q1 AS question, a1 AS answer FROM c WHERE n IN (0, 1)
UNION ALL SELECT doc_id, source, 1, q2, 'yes' FROM c WHERE n = 0""")
def _(spark, sf):
    n = F.col("doc_id") % 4
    def card(question, answer):
        return F.concat(F.lit('{"question": "'), question, F.lit('", "answer": "'), answer, F.lit('"}'))
    one = card(simple_words(1, 4), simple_words(5, 8))
    two = F.when(n == 0, F.concat(F.lit(", "), card(simple_words(9, 12), F.lit("yes")))).when(
        n == 2, F.lit(', {"question": "alone"}')).otherwise("")
    raw = F.when(n == 3, "no cards today").otherwise(F.concat(F.lit("Cards:\n["), one, two, F.lit("]\nDone")))
    return X.parse_flashcards(passages(spark, sf, 12).select("doc_id", "source", raw.alias("raw")))


def summary_replies(key: str = "doc_id") -> Column:
    """The words are cut once and every part is spelled once (see ``replies``)."""
    n = F.col("doc_id") % 8
    kind = F.when(n == 1, '"toc"').when(n == 2, '"Content"').when(n == 7, "3").otherwise('"content"')
    w = T.words(F.regexp_replace("text", r"[^\p{L}\p{N} ]", " "))
    brief = F.when(n.isin(3, 6), "").otherwise(T.let(w, lambda w: F.concat(
        F.array_join(F.slice(w, 1, 9), " "), F.lit(". "), F.array_join(F.slice(w, 10, 6), " "))))
    chapter = F.when(n == 4, '"null"').when(n == 5, "null").otherwise('"Part One"')
    start = F.when(n == 6, "I cannot {do} this").when(n == 0, '{"summary": "').otherwise(
        F.concat(F.lit('```json\n{"type": '), kind, F.lit(', "summary": "')))
    end = F.when(n == 6, "").when(n == 0, '"}').otherwise(
        F.concat(F.lit('", "chapter": '), chapter, F.lit(', "section": "S1", "quality": 0.25}\n```')))
    return F.concat(start, brief, end)


BRIEF = f"CASE WHEN doc_id % 8 = 3 THEN '' ELSE {simple_sql(1, 9)} || '. ' || {simple_sql(10, 15)} END"
SUMMARY_SQL = f"""ss AS (SELECT *, doc_id % 8 AS n, {BRIEF} AS brief FROM {{0}}),
sm AS (SELECT *, CASE n WHEN 1 THEN 'toc' ELSE 'content' END AS kind,
  CASE WHEN n = 6 THEN text ELSE coalesce(nullif(brief, ''), text) END AS summary,
  CASE n WHEN 6 THEN chapter WHEN 0 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'Part One' END AS new_chapter,
  CASE n WHEN 6 THEN section WHEN 0 THEN NULL ELSE 'S1' END AS new_section FROM ss)"""


@query("parse_summary", sql=f"""WITH src AS (SELECT doc_id, text, source AS chapter, lang AS section FROM {passages_sql(15)}), {SUMMARY_SQL.replace('FROM {0}', 'FROM src')}
SELECT doc_id, kind AS type, summary, new_chapter AS chapter, new_section AS section FROM sm""")
def _(spark, sf):
    s = X.parse_summary(summary_replies(), F.col("text"), F.col("source"), F.col("lang"))
    return passages(spark, sf, 15).select("doc_id", s.alias("s")).select("doc_id", "s.*")


@query("parse_classification", sql=f"""WITH src AS (SELECT doc_id, text, source AS chapter, lang AS section FROM {passages_sql(15)}), {SUMMARY_SQL.replace('FROM {0}', 'FROM src')}
SELECT doc_id, kind AS type, new_chapter AS chapter, new_section AS section,
  CASE WHEN n IN (0, 6) THEN 0.7 ELSE 0.25 END::DOUBLE AS quality FROM sm""")
def _(spark, sf):
    s = X.parse_classification(summary_replies(), F.col("source"), F.col("lang"))
    return passages(spark, sf, 15).select("doc_id", s.alias("s")).select("doc_id", "s.*")


@query("apply_summaries", sql=rf"""WITH {BOILER_SQL.replace('source,' + chr(10) + '  text ||', 'source, section, chapter,' + chr(10) + '  text ||')},
l AS (SELECT *, list_filter(lines, lambda x: x <> '') AS full_lines FROM b),
o AS (SELECT *, ((contains(low, 'table of contents') OR starts_with(low, 'contents')) AND
  len(list_filter(full_lines, lambda x: regexp_matches(x, '\p{{N}}') AND length(x) < 60)) / greatest(1, len(full_lines)) > 0.8)
  OR ((contains(low, 'isbn') OR contains(low, 'library of congress')) AND length(text) < 500) AS obvious FROM l),
kept AS (SELECT * FROM o WHERE word_count >= 50 AND NOT obvious), {SUMMARY_SQL.replace('FROM {0}', 'FROM kept')}
SELECT doc_id, chunk_idx, summary AS text, coalesce(new_chapter, chapter) AS chapter, coalesce(new_section, section) AS section,
  {q.sentence_count('summary')} AS sentence_count, {q.word_count('summary')} AS word_count FROM sm WHERE kind = 'content' AND summary <> ''""")
def _(spark, sf):
    chunks = boiler_chunks(spark, sf)
    answers = chunks.select("doc_id", "chunk_idx", summary_replies().alias("raw"))
    return X.apply_summaries(chunks, answers).select(
        "doc_id", "chunk_idx", "text", "chapter", "section", "sentence_count", "word_count")


# --- prompts and samples -----------------------------------------------------

@query("sample_chunks", sql="SELECT doc_id, source FROM documents ORDER BY md5('s1' || doc_id), doc_id LIMIT 50")
def _(spark, sf):
    return G.sample_chunks(documents(spark, sf), 50, "s1", "doc_id").select("doc_id", "source")


def render_sql(template: str, **values: str) -> str:
    import re
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return " || ".join(f"({values[p]})" if i % 2 else q.quote(p) for i, p in enumerate(parts))


def level_of(doc_id: str = "doc_id") -> Column:
    return F.get(F.array(*[F.lit(d) for d in K.DIFFICULTIES]), (F.col(doc_id) % 3).cast("int"))


DIFF_SQL = f"[{q.in_list(K.DIFFICULTIES)}][(doc_id % 3) + 1]"
GUIDE_SQL = "CASE difficulty " + " ".join(f"WHEN '{d}' THEN {q.quote(g)}" for d, g in P.GUIDES.items()) + " END"


def prompt_sql(kind: str, examples: str = "''") -> str:
    limit = P.PASSAGE_CHARS[kind]
    passage = f"text[1:{limit}]" if limit else "text"
    user = render_sql(P.USER[kind], guide=GUIDE_SQL, source="source", text=passage, count="'5'")
    return f"""SELECT doc_id, '{kind}' AS kind, md5({render_sql(P.SYSTEM[kind], examples=examples)}) AS system_md5, length({user}) AS user_chars, md5({user}) AS user_md5 FROM d"""


@query("build_prompts", sql=f"WITH d AS (SELECT *, {DIFF_SQL} AS difficulty FROM {passages_sql(80)}) " + " UNION ALL ".join(
    prompt_sql(k) for k in ("mcq", "open", "flashcard", "training", "summary", "classify")))
def _(spark, sf):
    level = level_of()
    out = None
    for kind in P.USER:
        p = G.build_prompts(passages(spark, sf, 80), kind, level).select(
            "doc_id", F.lit(kind).alias("kind"), F.md5("system").alias("system_md5"),
            F.length("user").alias("user_chars"), F.md5("user").alias("user_md5"))
        out = p if out is None else out.unionByName(p)
    return out


GOLD_SQL = "gold(example_id, difficulty, text, question, options, correct_index, explanation) AS (VALUES " + ", ".join(
    f"({i}, {q.quote(d)}, {q.quote(t)}, {q.quote(qn)}, {q.quote(chr(34) + (chr(34) + ', ' + chr(34)).join(o) + chr(34))}, {c}, {q.quote(e)})"
    for i, (d, t, qn, o, c, e) in enumerate(P.GOLD_EXAMPLES)) + ")"
FEW_SQL = f"""{GOLD_SQL},
gr AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY md5('gold' || example_id), example_id) AS rank FROM gold),
few AS (SELECT difficulty, 'Replies of the kind that is wanted:' || chr(10) || chr(10) || string_agg('Sample ' || rank || chr(10) || 'Passage: "' || text || '"' || chr(10)
  || 'Reply: {{"question": "' || question || '", "options": [' || options || '], "correctIndex": ' || correct_index || ', "explanation": "' || explanation || '"}}' || chr(10), chr(10) ORDER BY rank)
  || chr(10) || {q.quote(P.DISTRACTOR_RULES)} || chr(10) AS examples FROM gr WHERE rank <= 3 GROUP BY difficulty)"""


@query("few_shot_block", sql=f"""WITH {FEW_SQL}, d AS (SELECT * FROM (SELECT *, {DIFF_SQL} AS difficulty FROM {passages_sql(80)}) JOIN few USING (difficulty))
{prompt_sql('mcq', 'examples')}""")
def _(spark, sf):
    level = level_of()
    few = G.few_shot_blocks(G.gold_examples(spark))
    return G.build_prompts(passages(spark, sf, 80), "mcq", level, few).select(
        "doc_id", F.lit("mcq").alias("kind"), F.md5("system").alias("system_md5"),
        F.length("user").alias("user_chars"), F.md5("user").alias("user_md5"))


# --- talks -------------------------------------------------------------------

TALK_SQL = """first AS (SELECT conv_id, arg_min(text, turn) AS question, max(turn) AS last_turn, count(*) AS n FROM conversations GROUP BY conv_id)"""


@query("discussion_history", sql=f"""WITH {TALK_SQL},
pre AS (SELECT conv_id, -1 AS at_, 'system' AS role, {render_sql(P.MCQ_TUTOR, question='question', given="CASE WHEN conv_id % 5 < 4 THEN ['one','two','three','four'][(conv_id % 5) + 1] ELSE 'none' END",
  verdict="CASE WHEN conv_id % 5 = conv_id % 4 THEN 'CORRECT' ELSE 'INCORRECT' END", correct="['one','two','three','four'][(conv_id % 4) + 1]",
  explanation="n || ' turns'", source="'talk ' || conv_id")} AS content FROM first),
al AS (SELECT * FROM pre UNION ALL SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END, text FROM conversations
  UNION ALL SELECT conv_id, 1000000, 'user', 'And then? ' || question FROM first)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY at_) - 1 AS pos, role, content FROM al""")
def _(spark, sf):
    turns = read_table(spark, sf, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.count("*").alias("n"))
    answer = (F.col("conv_id") % 5).cast("int")
    asked = first.select(
        "conv_id", "question", F.array(*[F.lit(x) for x in ("one", "two", "three", "four")]).alias("options"),
        (F.col("conv_id") % 4).cast("int").alias("correct_index"), F.when(answer < 4, answer).alias("user_answer"),
        F.concat(F.col("n").cast("string"), F.lit(" turns")).alias("explanation"),
        F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("source"))
    new = first.select("conv_id", F.concat(F.lit("And then? "), F.col("question")).alias("content"))
    past = turns.select("conv_id", "turn", (F.col("role") == "user").alias("is_user"), F.col("text").alias("content"))
    return G.discussion_history(G.mcq_preamble(asked), past, new)


@query("generation_throughput", sql="""WITH g AS (SELECT user_id AS generation_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS tokens,
  epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)) AS elapsed FROM events)
SELECT generation_id, max(tokens) AS tokens, round(max(elapsed), 6) AS elapsed,
  round(CASE WHEN max(elapsed) > 0 THEN max(tokens) / max(elapsed) ELSE 0 END, 6) AS tokens_per_second FROM g GROUP BY generation_id""")
def _(spark, sf):
    # every event of a user stands for one token of that user's generation
    ev = read_table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    start = ev.groupBy("user_id").agg(F.min("t").alias("t0"), F.count("*").alias("n"))
    log = ev.join(start, "user_id").select(
        F.col("user_id").alias("generation_id"), F.col("n").alias("tokens"), (F.col("t") - F.col("t0")).alias("elapsed"))
    rated = G.generation_throughput(log)
    return rated.select("generation_id", "tokens", F.round("elapsed", 6).alias("elapsed"),
                        F.round("tokens_per_second", 6).alias("tokens_per_second"))
