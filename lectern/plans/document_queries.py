"""Registered queries over document structure, chunks and chunk metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators import chunking as C
from lectern.operators import filters as L
from lectern.operators import metadata as M
from lectern.operators import structure as S
from lectern.plans import sqltext as q
from lectern.plans.registry import query
from lectern.sources.tables import read_table

TARGET = 100
SMALL = 50
NL = q.NL


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


#: Numbers of passages within a document; passage i of a document is doc_id * STEP + i.
STEP = 1_000_000_000


def passages(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """Documents cut into stretches of ``size`` words, so that every word is in one item."""
    w = T.words(F.col("text"))
    last = F.greatest(F.ceil(F.size("w") / size), F.lit(1)).cast("int") - 1
    cut = documents(spark, sf).select("doc_id", "lang", "source", w.alias("w"))
    return cut.select("*", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(
        (F.col("doc_id") * STEP + F.col("i")).alias("doc_id"), "lang", "source",
        F.array_join(F.slice("w", F.col("i") * size + 1, size), " ").alias("text"))


def passages_sql(size: int) -> str:
    return (f"(SELECT doc_id * {STEP} + i AS doc_id, lang, source, array_to_string(w[i * {size} + 1:(i + 1) * {size}], ' ') AS text "
            f"FROM (SELECT *, unnest(range(greatest(1, ceil(len(w) / {size})::INT))) AS i FROM "
            f"(SELECT doc_id, lang, source, {q.words('text')} AS w FROM documents)))")


# --- derived inputs, spelled once per engine ---------------------------------

def marked_documents(spark, sf) -> DataFrame:
    """Documents with every tenth line turned into headings of three levels."""
    def mark(line, i):
        return (
            F.when(i % 10 == 0, F.concat(F.lit("# "), line))
            .when(i % 10 == 4, F.concat(F.lit("## "), line))
            .when(i % 10 == 7, F.concat(F.lit("### "), line)).otherwise(line)
        )
    lines = F.transform(F.split("text", "\n"), mark)
    return documents(spark, sf).select("doc_id", "source", F.array_join(lines, "\n").alias("text"))


MARKED_SQL = f"""marked AS (
  SELECT doc_id, source, array_to_string(list_transform(string_split(text, {NL}), lambda l, i:
    CASE (i - 1) % 10 WHEN 0 THEN '# ' || l WHEN 4 THEN '## ' || l WHEN 7 THEN '### ' || l ELSE l END
  ), {NL}) AS text FROM documents)"""

ELEMENT_SQL = rf"""lined AS (
  SELECT doc_id, source, unnest(list_filter(list_transform(string_split(text, {NL}),
    lambda l: {q.trim_spaces('l')}), lambda l2: l2 <> '')) AS line,
    generate_subscripts(list_filter(list_transform(string_split(text, {NL}),
    lambda l: {q.trim_spaces('l')}), lambda l2: l2 <> ''), 1) AS pos FROM marked),
els AS (
  SELECT doc_id, source, pos, length(regexp_extract(line, '^(#+)', 1)) AS level,
    CASE length(regexp_extract(line, '^(#+)', 1)) WHEN 0 THEN 'paragraph' WHEN 1 THEN 'chapter'
      WHEN 2 THEN 'section' ELSE 'subsection' END AS type,
    {q.trim_spaces("regexp_replace(line, '^#+', '')")} AS text FROM lined)"""


def line_chunks(spark, sf) -> DataFrame:
    """Every line of every document as a small chunk with sparse labels."""
    lines = documents(spark, sf).select(
        "doc_id", "source", F.posexplode(T.paragraphs(F.col("text"))).alias("chunk_idx", "text")
    )
    head = F.array_join(F.slice(T.words(F.col("text")), 1, 3), " ")
    return lines.select(
        "doc_id", "chunk_idx",
        F.concat_ws("_", "source", F.col("chunk_idx").cast("string")).alias("id"),
        "text", "source",
        F.when(F.col("chunk_idx") % 4 == 1, F.floor(F.col("chunk_idx") / 5) + 1)
        .cast("int").alias("page"),
        F.when(F.col("chunk_idx") % 3 == 1, head).alias("section"),
        F.when(F.col("chunk_idx") % 7 == 2, head).alias("chapter"),
        F.col("chunk_idx").alias("start_index"), F.col("chunk_idx").alias("end_index"),
        T.sentence_count(F.col("text")).alias("sentence_count"),
        T.word_count(F.col("text")).alias("word_count"),
        F.lit(None).cast("string").alias("preceding_context"),
        F.lit(None).cast("string").alias("following_context"),
    )


LINE_CHUNKS_SQL = f"""pars AS (
  SELECT doc_id, source, list_filter(list_transform(string_split(text, {NL}), lambda l: {q.strip('l')}),
    lambda l2: l2 <> '') AS p FROM documents),
lined AS (SELECT doc_id, source, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS chunk_idx FROM pars),
line_chunks AS (
  SELECT doc_id, chunk_idx, source || '_' || chunk_idx AS id, text, source,
    CASE WHEN chunk_idx % 4 = 1 THEN chunk_idx // 5 + 1 END AS page,
    CASE WHEN chunk_idx % 3 = 1 THEN array_to_string({q.words('text')}[1:3], ' ') END AS section,
    CASE WHEN chunk_idx % 7 = 2 THEN array_to_string({q.words('text')}[1:3], ' ') END AS chapter,
    chunk_idx AS start_index, chunk_idx AS end_index,
    {q.sentence_count('text')} AS sentence_count, {q.word_count('text')} AS word_count
  FROM lined)"""


# --- structure ---------------------------------------------------------------

START_SQL = r"""(prev = '' OR (regexp_matches(prev, '[.!?:;]$') AND regexp_matches(line, '^\p{Lu}'))
  OR regexp_matches(line, '^[•*-]')
  OR (regexp_matches(line, '^\p{N}') AND regexp_matches(substr(line, 1, 4), '[.)]'))
  OR (line = upper(line) AND length(line) > 3 AND contains(line, ' ')))"""


# lines broken every eight words, so that there is something to unwrap
def wrapped_documents(spark, sf) -> DataFrame:
    def wrap(line):
        w = T.words(line)
        return T.let(w, lambda v: F.array_join(F.transform(
            v, lambda x, i: F.when((i % 8 == 7) & (i < F.size(v) - 1), F.concat(
                x, F.when(i % 16 == 7, "-").otherwise(""), F.lit("\n")))
            .when(i < F.size(v) - 1, F.concat(x, F.lit(" "))).otherwise(x)), ""))
    return documents(spark, sf).select(
        "doc_id", "source", F.array_join(F.transform(F.split("text", "\n"), wrap), "\n").alias("text")
    )


WRAPPED_SQL = f"""split_lines AS (
  SELECT doc_id, source, unnest(string_split(text, {NL})) AS l,
    generate_subscripts(string_split(text, {NL}), 1) AS n FROM documents),
w AS (SELECT doc_id, source, n, {q.words('l')} AS v FROM split_lines),
wrapped AS (
  SELECT doc_id, source, string_agg(array_to_string(list_transform(v, lambda x, i:
      CASE WHEN (i - 1) % 8 = 7 AND i < len(v) THEN x || CASE WHEN (i - 1) % 16 = 7 THEN '-' ELSE '' END || {NL}
           WHEN i < len(v) THEN x || ' ' ELSE x END), ''), {NL} ORDER BY n) AS text
  FROM w GROUP BY doc_id, source)"""

UNWRAP_SQL = f"""phys AS (
  SELECT doc_id, source, unnest(string_split(text, {NL})) AS raw,
    generate_subscripts(string_split(text, {NL}), 1) AS n FROM wrapped),
prevs AS (
  SELECT doc_id, source, n, {q.trim_spaces('raw')} AS line,
    coalesce(lag({q.trim_spaces('raw')}) OVER (PARTITION BY doc_id ORDER BY n), '') AS prev FROM phys),
flags AS (SELECT *, {START_SQL} AS opens FROM prevs),
islands AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY n) AS isl FROM flags WHERE line <> ''),
unwrapped AS (SELECT doc_id, source, isl,
  replace(replace(string_agg(line, chr(1) ORDER BY n), '-' || chr(1), ''), chr(1), ' ') AS par
  FROM islands GROUP BY doc_id, source, isl)"""


@query("unwrap_lines", sql=f"""WITH {WRAPPED_SQL}, {UNWRAP_SQL}
SELECT d.doc_id, coalesce(string_agg(par, chr(10) || chr(10) ORDER BY isl), '') AS text
FROM documents d LEFT JOIN unwrapped USING (doc_id) GROUP BY d.doc_id""")
def _(spark, sf):
    return wrapped_documents(spark, sf).select("doc_id", S.unwrap_lines(F.col("text")).alias("text"))


@query("paragraph_starts", sql=f"""WITH {WRAPPED_SQL}, phys AS (
  SELECT doc_id, unnest(string_split(text, {NL})) AS raw,
    generate_subscripts(string_split(text, {NL}), 1) AS n FROM wrapped),
prevs AS (SELECT doc_id, n, {q.trim_spaces('raw')} AS line,
  coalesce(lag({q.trim_spaces('raw')}) OVER (PARTITION BY doc_id ORDER BY n), '') AS prev FROM phys)
SELECT doc_id, count(*) AS lines, sum({START_SQL}::INT)::BIGINT AS starts FROM prevs GROUP BY doc_id""")
def _(spark, sf):
    def count_starts(lines):
        return F.size(F.filter(lines, lambda line, i: S.is_paragraph_start(
            line, F.coalesce(F.get(lines, i - 1), F.lit("")))))
    lines = F.transform(F.split("text", "\n"), T.trim_spaces)
    return wrapped_documents(spark, sf).select(
        "doc_id", F.size(F.split("text", "\n")).alias("lines"), T.let(lines, count_starts).alias("starts")
    )


@query("split_paragraphs", sql=f"""WITH pars AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, {NL}), lambda l: {q.strip('l')}), lambda l2: l2 <> '') AS p,
    list_filter(list_transform(string_split(text, {NL} || {NL}), lambda l: {q.strip('l')}), lambda l2: l2 <> '') AS b
  FROM documents)
SELECT doc_id, unnest(CASE WHEN len(p) > 1 THEN p ELSE b END) AS paragraph FROM pars""")
def _(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.explode(S.split_paragraphs(F.col("text"))).alias("paragraph"))


@query("markdown_elements", sql=f"""WITH {MARKED_SQL}, {ELEMENT_SQL}
SELECT doc_id, pos - 1 AS pos, type, text, level FROM els""")
def _(spark, sf):
    found = marked_documents(spark, sf).select(
        "doc_id", F.posexplode(S.markdown_elements(F.col("text"))).alias("pos", "e"))
    return found.select("doc_id", "pos", "e.type", "e.text", "e.level")


LINE_CLASS_SQL = rf"""CASE
  WHEN length(line) < 3 OR length(regexp_replace(line, '^[\p{{Nd}}\p{{Zs}}\t–-]+|[\p{{Nd}}\p{{Zs}}\t–-]+$', '', 'g')) <= 2 THEN 'paragraph'
  WHEN line = upper(line) AND nw BETWEEN 2 AND 10 AND length(line) >= 5
    THEN CASE WHEN contains(line, 'CHAPTER') OR (regexp_matches(line, '^\p{{N}}') AND contains(line, ' ')) THEN 'chapter' ELSE 'section' END
  WHEN nw BETWEEN 2 AND 12 AND length(line) >= 8 AND up / nw >= 0.6 THEN 'section'
  WHEN regexp_matches(line, '^[•*-]') OR (regexp_matches(line, '^\p{{N}}') AND contains(line, '.')) THEN 'listItem'
  ELSE 'paragraph' END"""


# the first words of every line, dressed as the heading styles the classifier knows
def heading_lines(spark, sf) -> DataFrame:
    lines = line_chunks(spark, sf)
    head = F.array_join(F.slice(T.words(F.translate("text", "ßẞ", "ss")), 1, 6), " ")
    n = F.col("chunk_idx") % 6
    line = (
        F.when(n == 0, F.upper(head)).when(n == 1, F.concat(F.lit("CHAPTER "), F.upper(head)))
        .when(n == 2, F.concat(F.lit("12. "), F.lower(head))).when(n == 3, F.initcap(head))
        .when(n == 4, F.concat(F.lit("- "), head)).otherwise(head)
    )
    return lines.select("doc_id", "chunk_idx", line.alias("line"))


HEADING_SQL = f"""{LINE_CHUNKS_SQL}, heads AS (
  SELECT doc_id, chunk_idx, array_to_string({q.words("translate(text, 'ßẞ', 'ss')")}[1:6], ' ') AS h FROM line_chunks),
dressed AS (
  SELECT doc_id, chunk_idx, CASE chunk_idx % 6 WHEN 0 THEN upper(h) WHEN 1 THEN 'CHAPTER ' || upper(h)
    WHEN 2 THEN '12. ' || lower(h)
    WHEN 3 THEN array_to_string(list_transform(string_split(lower(h), ' '), lambda x: upper(x[1]) || x[2:]), ' ')
    WHEN 4 THEN '- ' || h ELSE h END AS line FROM heads),
counted AS (SELECT *, {q.word_count('line')} AS nw,
  len(list_filter({q.words('line')}, lambda u: regexp_matches(u, '^\\p{{Lu}}'))) AS up FROM dressed)"""


@query("classify_line", sql=f"""WITH {HEADING_SQL}
SELECT doc_id, chunk_idx, line, {LINE_CLASS_SQL} AS type FROM counted""")
def _(spark, sf):
    return heading_lines(spark, sf).withColumn("type", S.classify_line(F.col("line")))


@query("is_title_case", sql=f"""WITH {HEADING_SQL}
SELECT doc_id, chunk_idx, coalesce(up / nullif(nw, 0), 0) >= 0.6 AS title_case FROM counted""")
def _(spark, sf):
    return heading_lines(spark, sf).select(
        "doc_id", "chunk_idx", S.is_title_case(F.col("line")).alias("title_case"))


@query("page_elements", sql=f"""WITH {WRAPPED_SQL}, {UNWRAP_SQL},
lines AS (SELECT doc_id, par AS line, {q.word_count('par')} AS nw,
  len(list_filter({q.words('par')}, lambda u: regexp_matches(u, '^\\p{{Lu}}'))) AS up FROM unwrapped),
typed AS (SELECT doc_id, CASE WHEN nw <= 10 THEN {LINE_CLASS_SQL} ELSE 'paragraph' END AS type FROM lines)
SELECT doc_id, type, count(*) AS n FROM typed GROUP BY doc_id, type""")
def _(spark, sf):
    found = wrapped_documents(spark, sf).select(
        "doc_id", F.inline(S.page_elements(F.col("text"), F.lit(1))))
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


# --- chunking ----------------------------------------------------------------

FOLD_SQL = f"""RECURSIVE {MARKED_SQL}, {ELEMENT_SQL},
fold AS (
  SELECT doc_id, source, 0::BIGINT AS n, ''::VARCHAR AS cur, NULL::VARCHAR AS section, NULL::VARCHAR AS chapter,
    0::BIGINT AS start_idx, 0::BIGINT AS idx, NULL::VARCHAR AS out_text, NULL::VARCHAR AS out_section,
    NULL::VARCHAR AS out_chapter, 0::BIGINT AS out_start, 0::BIGINT AS out_idx
  FROM (SELECT DISTINCT doc_id, source FROM els)
  UNION ALL
  SELECT doc_id, source, n + 1,
    CASE WHEN flush THEN '' WHEN split THEN array_to_string(ss[k + 1:], '') ELSE grown END,
    CASE WHEN type = 'chapter' THEN NULL WHEN type IN ('section', 'subsection') THEN etext ELSE section END,
    CASE WHEN type = 'chapter' THEN etext ELSE chapter END,
    CASE WHEN type = 'chapter' OR flush OR split THEN idx + (flush OR split)::INT ELSE start_idx END,
    idx + (flush OR split)::INT,
    CASE WHEN flush THEN cur WHEN split THEN array_to_string(ss[1:k], '') END,
    section, chapter, start_idx, idx
  FROM (
    SELECT *, CASE WHEN split THEN coalesce(list_min(list_filter(range(1, len(ss) + 1), lambda i:
        coalesce(list_sum(wcs[1:i - 1]), 0) >= 50 AND list_sum(wcs[1:i]) > {TARGET})) - 1, len(ss)) END AS k
    FROM (
      SELECT *, {q.sentences('grown')} AS ss,
        list_transform({q.sentences('grown')}, lambda z: {q.word_count('z')}) AS wcs
      FROM (
        SELECT *, type = 'paragraph' AND {q.word_count('grown')} >= {TARGET} AS split
        FROM (
          SELECT f.*, e.type, e.text AS etext,
            cur <> '' AND (e.type = 'chapter' OR (e.type IN ('section', 'subsection') AND {q.word_count('cur')} >= 50)) AS flush,
            CASE WHEN e.type <> 'paragraph' THEN cur WHEN cur = '' THEN e.text
              ELSE cur || chr(10) || chr(10) || e.text END AS grown
          FROM fold f JOIN els e ON e.doc_id = f.doc_id AND e.pos = f.n + 1))))
),
ends AS (SELECT doc_id, max(n) AS n FROM fold GROUP BY doc_id),
cut AS (
  SELECT doc_id, source, out_text AS text, out_section AS section, out_chapter AS chapter, out_start AS start_index,
    out_idx AS end_index FROM fold WHERE out_text IS NOT NULL
  UNION ALL
  SELECT doc_id, source, cur, section, chapter, start_idx, idx FROM fold JOIN ends USING (doc_id, n)
  WHERE cur <> '' AND {q.word_count('cur')} >= 25),
chunks AS (
  SELECT doc_id, end_index AS chunk_idx, replace(source, ' ', '_') || '_' || end_index AS id, {q.strip('text')} AS text, source, section, chapter,
    start_index, end_index, {q.sentence_count(q.strip('text'))} AS sentence_count,
    {q.word_count(q.strip('text'))} AS word_count FROM cut)"""


def semantic(spark, sf) -> DataFrame:
    els = marked_documents(spark, sf).select(
        "doc_id", "source", S.markdown_elements(F.col("text")).alias("elements"))
    return C.semantic_chunks(els, TARGET)


@query("semantic_chunks", sql=f"""WITH {FOLD_SQL}
SELECT doc_id, chunk_idx, text, source, section, chapter, start_index, end_index FROM chunks""")
def _(spark, sf):
    return semantic(spark, sf).select(
        "doc_id", "chunk_idx", "text", "source", "section", "chapter", "start_index", "end_index")


@query("finalize_chunks", sql=f"""WITH {FOLD_SQL}
SELECT doc_id, id, length(text) AS chars, start_index, end_index, sentence_count, word_count FROM chunks""")
def _(spark, sf):
    return semantic(spark, sf).select(
        "doc_id", "id", F.length("text").alias("chars"), "start_index", "end_index",
        "sentence_count", "word_count")


@query("split_at_sentence", sql=f"""WITH s AS (SELECT doc_id, {q.sentences('text')} AS ss FROM documents),
c AS (SELECT doc_id, ss, list_transform(ss, lambda z: {q.word_count('z')}) AS wcs FROM s),
p AS (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i, unnest(wcs) AS w FROM c),
t AS (SELECT doc_id, i, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
  sum(w) OVER (PARTITION BY doc_id ORDER BY i) - w AS before FROM p),
k AS (SELECT doc_id, min(i) - 1 AS k FROM t WHERE before >= 50 AND upto > {TARGET} GROUP BY doc_id)
SELECT doc_id, array_to_string(ss[1:coalesce(k, len(ss))], '') AS chunk,
  array_to_string(ss[coalesce(k, len(ss)) + 1:], '') AS remainder FROM c LEFT JOIN k USING (doc_id)""")
def _(spark, sf):
    cut = documents(spark, sf).select(
        "doc_id", C.split_at_sentence(F.col("text"), TARGET, SMALL).alias("c"))
    return cut.select("doc_id", "c.chunk", "c.remainder")


@query("paragraph_chunks", sql=f"""WITH RECURSIVE {LINE_CHUNKS_SQL},
n AS (SELECT doc_id, max(chunk_idx) AS m FROM line_chunks GROUP BY doc_id),
fold AS (
  SELECT doc_id, -1::BIGINT AS at_, ''::VARCHAR AS cur, NULL::VARCHAR AS out1, NULL::VARCHAR AS out2 FROM n
  UNION ALL
  SELECT doc_id, at_, CASE WHEN {q.word_count('grown')} >= {TARGET} THEN '' ELSE grown END,
    CASE WHEN over THEN cur END, CASE WHEN {q.word_count('grown')} >= {TARGET} THEN grown END
  FROM (SELECT f.doc_id, c.chunk_idx AS at_, f.cur,
      {q.word_count('f.cur')} + c.word_count > {2 * TARGET} AND f.cur <> '' AS over,
      CASE WHEN f.cur = '' OR {q.word_count('f.cur')} + c.word_count > {2 * TARGET} THEN c.text
        ELSE f.cur || chr(10) || chr(10) || c.text END AS grown
    FROM fold f JOIN line_chunks c ON c.doc_id = f.doc_id AND c.chunk_idx = f.at_ + 1)),
cut AS (
  SELECT doc_id, at_, 1 AS part, out1 AS text FROM fold WHERE out1 IS NOT NULL
  UNION ALL SELECT doc_id, at_, 2, out2 FROM fold WHERE out2 IS NOT NULL
  UNION ALL SELECT f.doc_id, f.at_, 3, f.cur FROM fold f JOIN n ON n.doc_id = f.doc_id AND n.m = f.at_
    WHERE f.cur <> '' AND {q.word_count('f.cur')} >= 50)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY at_, part) - 1 AS chunk_idx, text,
  {q.word_count('text')} AS word_count FROM cut""")
def _(spark, sf):
    docs = documents(spark, sf).withColumn("page", F.lit(None).cast("int"))
    return C.paragraph_chunks(docs, TARGET).select("doc_id", "chunk_idx", "text", "word_count")


PACK_SQL = f"""RECURSIVE {LINE_CHUNKS_SQL},
blocks AS (SELECT doc_id, chunk_idx, CASE WHEN chunk_idx % 5 = 2 THEN 'Chapter ' || text ELSE text END AS text FROM line_chunks),
n AS (SELECT doc_id, max(chunk_idx) AS m FROM blocks GROUP BY doc_id),
fold AS (
  SELECT doc_id, -1::BIGINT AS at_, ''::VARCHAR AS cur, NULL::VARCHAR AS section, NULL::VARCHAR AS out_text FROM n
  UNION ALL
  SELECT doc_id, at_, CASE WHEN over OR cur = '' THEN text ELSE cur || chr(10) || chr(10) || text END,
    CASE WHEN starts_with(text, 'Chapter') THEN string_split(text, chr(10))[1] ELSE section END,
    CASE WHEN over THEN cur END
  FROM (SELECT f.doc_id, b.chunk_idx AS at_, f.cur, f.section, b.text,
      {q.word_count('f.cur')} + {q.word_count('b.text')} > {TARGET} AND f.cur <> '' AS over
    FROM fold f JOIN blocks b ON b.doc_id = f.doc_id AND b.chunk_idx = f.at_ + 1)),
cut AS (
  SELECT doc_id, at_, 1 AS part, out_text AS text, section FROM fold WHERE out_text IS NOT NULL
  UNION ALL SELECT f.doc_id, f.at_, 2, f.cur, f.section FROM fold f JOIN n ON n.doc_id = f.doc_id AND n.m = f.at_
    WHERE f.cur <> '')"""


@query("pack_paragraphs", sql=f"""WITH {PACK_SQL}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY at_, part) - 1 AS chunk_idx, text, section,
  {q.word_count('text')} AS word_count FROM cut""")
def _(spark, sf):
    blocks = F.transform(T.paragraphs(F.col("text")), lambda p, i: F.when(
        i % 5 == 2, F.concat(F.lit("Chapter "), p)).otherwise(p))
    docs = documents(spark, sf).select(
        "doc_id", "source", F.array_join(blocks, "\n\n").alias("text"))
    return C.pack_paragraphs(docs, TARGET).drop("source")


OVERLAP_SQL = f"""overlapped AS (
  SELECT *, array_to_string(lag({q.sentences('text')}[-2:]) OVER w, '') AS preceding_context,
    array_to_string(lead({q.sentences('text')}[1:2]) OVER w, '') AS following_context
  FROM line_chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_idx))"""


@query("context_overlap", sql=f"""WITH {LINE_CHUNKS_SQL}, {OVERLAP_SQL}
SELECT doc_id, chunk_idx, preceding_context, following_context FROM overlapped""")
def _(spark, sf):
    return C.context_overlap(line_chunks(spark, sf)).select(
        "doc_id", "chunk_idx", "preceding_context", "following_context")


@query("merge_small_chunks", sql=f"""WITH {LINE_CHUNKS_SQL},
marked AS (SELECT *, sum((word_count >= {SMALL})::INT) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS island,
  count(*) OVER (PARTITION BY doc_id) AS n FROM line_chunks),
grouped AS (
  SELECT doc_id, island, n, min(chunk_idx) AS chunk_idx, arg_min(id, chunk_idx) AS id,
    arg_min(CASE WHEN page IS NULL THEN -1 ELSE page END, chunk_idx) AS page0,
    arg_min(section, chunk_idx) AS section, arg_min(chapter, chunk_idx) AS chapter,
    min(start_index) AS start_index, max(end_index) AS end_index,
    sum(sentence_count)::BIGINT AS sentence_count,
    string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) AS text
  FROM marked GROUP BY doc_id, island, n)
SELECT doc_id, chunk_idx, id, nullif(page0, -1) AS page, section, chapter, start_index, end_index, sentence_count,
  {q.word_count('text')} AS word_count, text FROM grouped
WHERE {q.word_count('text')} >= {SMALL // 2} OR n = 1""")
def _(spark, sf):
    return C.merge_small_chunks(line_chunks(spark, sf), SMALL).select(
        "doc_id", "chunk_idx", "id", "page", "section", "chapter", "start_index", "end_index",
        "sentence_count", "word_count", "text")


# every third chunk loses its capital, so that the repair has work to do
def broken_chunks(spark, sf) -> DataFrame:
    body = F.when(F.col("chunk_idx") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    return C.context_overlap(line_chunks(spark, sf).withColumn("text", body))


BROKEN_SQL = f"""{LINE_CHUNKS_SQL.replace('line_chunks AS', 'whole_chunks AS')},
line_chunks AS (SELECT * REPLACE (CASE WHEN chunk_idx % 3 = 0 THEN lower(text) ELSE text END AS text) FROM whole_chunks),
{OVERLAP_SQL}"""


@query("repair_mid_sentence", sql=rf"""WITH {BROKEN_SQL},
r AS (SELECT doc_id, chunk_idx, {q.strip('text')} AS body, {q.strip('preceding_context')} AS pre,
  regexp_matches({q.strip('text')}, '^\p{{Ll}}') AND coalesce({q.strip('preceding_context')} <> '', false) AS was_merged FROM overlapped),
s AS (SELECT *, CASE WHEN was_merged THEN replace(replace(pre || ' ' || body, '  ', ' '), chr(10) || ' ', chr(10)) ELSE body END AS t FROM r),
m AS (SELECT *, regexp_matches({q.strip('t')}, '^\p{{Ll}}') AS was_marked FROM s),
f AS (SELECT doc_id, chunk_idx, was_merged, was_marked, CASE WHEN was_marked THEN '[...] ' || t ELSE t END AS text FROM m)
SELECT *, {q.sentence_count('text')} AS sentence_count, {q.word_count('text')} AS word_count FROM f""")
def _(spark, sf):
    return C.repair_mid_sentence(broken_chunks(spark, sf)).select(
        "doc_id", "chunk_idx", "text", "was_merged", "was_marked", "sentence_count", "word_count")


@query("mid_sentence_flags", sql=rf"""WITH {BROKEN_SQL}
SELECT doc_id, chunk_idx, regexp_matches({q.strip('text')}, '^\p{{Ll}}') AS starts_mid,
  NOT regexp_matches({q.strip('text')}, '[.!?"''“”‘’]$') AS ends_mid FROM overlapped""")
def _(spark, sf):
    c = broken_chunks(spark, sf)
    return c.select("doc_id", "chunk_idx", C.starts_mid_sentence(F.col("text")).alias("starts_mid"),
                    C.ends_mid_sentence(F.col("text")).alias("ends_mid"))


# --- metadata ----------------------------------------------------------------

TITLED = ["Chapter 3: ", "CHAPTER ", "4. ", "2.1 ", "", ""]


# first line replaced by a heading built from its first words
def titled_documents(spark, sf) -> DataFrame:
    head = F.regexp_replace(
        F.array_join(F.slice(T.words(F.col("text")), 1, 5), " "), "[^a-zA-Z ]", "")
    n = (F.col("doc_id") % 6).cast("int")
    prefix = F.get(F.array(*[F.lit(p) for p in TITLED]), n)
    return documents(spark, sf).select(
        "doc_id", F.concat(prefix, head, F.lit("\n"), F.col("text")).alias("text"))


TITLED_SQL = f"""titled AS (SELECT doc_id, [{q.in_list(TITLED)}][(doc_id % 6) + 1] ||
  regexp_replace(array_to_string({q.words('text')}[1:5], ' '), '[^a-zA-Z ]', '', 'g') || chr(10) || text AS text FROM documents)"""


@query("infer_chapter", sql=rf"""WITH {TITLED_SQL},
l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10))[1:5], lambda x: {q.trim_spaces('x')})) AS line,
  unnest(range(1, len(string_split(text, chr(10))[1:5]) + 1)) AS i FROM titled),
t AS (SELECT doc_id, i, CASE
  WHEN starts_with(lower(line), 'chapter') AND contains(line, ':') THEN {q.trim_spaces("string_split(line, ':')[2]")}
  WHEN starts_with(lower(line), 'chapter') THEN line
  WHEN regexp_matches(line, '^(\d+)[\.\s]+([A-Z][a-zA-Z\s]+)$') THEN nullif(regexp_extract(line, '([^\p{{Nd}}. ]*)$', 1), '') END AS title FROM l)
SELECT d.doc_id, arg_min(title, i) FILTER (title IS NOT NULL) AS chapter FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""")
def _(spark, sf):
    return titled_documents(spark, sf).select("doc_id", M.infer_chapter(F.col("text")).alias("chapter"))


@query("infer_section", sql=rf"""WITH {TITLED_SQL},
l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10))[1:3], lambda x: {q.trim_spaces('x')})) AS line,
  unnest(range(1, len(string_split(text, chr(10))[1:3]) + 1)) AS i FROM titled),
c AS (SELECT *, {q.word_count('line')} AS nw, len(list_filter({q.words('line')}, lambda u: regexp_matches(u, '^\p{{Lu}}'))) AS up FROM l),
t AS (SELECT doc_id, i, CASE WHEN length(line) BETWEEN 6 AND 79 AND (regexp_matches(line, '^(\d+\.\d+)\s+([A-Z][a-zA-Z\s]+)$')
  OR (up / nullif(nw, 0) >= 0.6 AND nw <= 8)) THEN line END AS title FROM c)
SELECT d.doc_id, arg_min(title, i) FILTER (title IS NOT NULL) AS section FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""")
def _(spark, sf):
    return titled_documents(spark, sf).select("doc_id", M.infer_section(F.col("text")).alias("section"))


@query("key_terms", sql=f"""WITH t AS (SELECT doc_id, unnest({q.tokens('text', 3)}) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS n FROM t WHERE term NOT IN ({q.in_list(K.KEY_TERM_STOP_WORDS)}) GROUP BY doc_id, term),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rk FROM c),
k AS (SELECT doc_id, string_agg(term, '|' ORDER BY rk) AS key_terms FROM r WHERE rk <= 10 GROUP BY doc_id)
SELECT doc_id, key_terms FROM documents LEFT JOIN k USING (doc_id)""")
def _(spark, sf):
    return M.with_key_terms(documents(spark, sf)).select(
        "doc_id", F.array_join("key_terms", "|").alias("key_terms"))


@query("text_counts", sql=f"""SELECT doc_id, {q.word_count('text')} AS word_count,
  {q.sentence_count('text')} AS sentence_count FROM documents""")
def _(spark, sf):
    return M.with_text_counts(documents(spark, sf)).select("doc_id", "word_count", "sentence_count")


@query("metadata_map", sql=f"""WITH {LINE_CHUNKS_SQL}
SELECT doc_id, chunk_idx, array_to_string(list_filter(['source=' || source, 'page=' || page, 'section=' || section,
  'chapter=' || chapter], lambda x: x IS NOT NULL), ';') AS metadata FROM line_chunks""")
def _(spark, sf):
    meta = M.metadata_map(F.col("source"), F.col("page"), F.col("section"), F.col("chapter"))
    pairs = F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return line_chunks(spark, sf).select(
        "doc_id", "chunk_idx", F.array_join(pairs, ";").alias("metadata"))


@query("available_sources", sql="SELECT DISTINCT source FROM documents ORDER BY source")
def _(spark, sf):
    return M.available_sources(read_table(spark, sf, "documents"))


@query("processing_stats", sql=f"""WITH {LINE_CHUNKS_SQL},
kept AS (SELECT * FROM line_chunks WHERE word_count >= 30),
d AS (SELECT d.doc_id, coalesce(max(page), 1) AS pages FROM documents d LEFT JOIN line_chunks l ON l.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT (SELECT count(*) FROM d) AS total_documents, (SELECT sum(pages)::BIGINT FROM d) AS total_pages,
  count(*) AS total_chunks, sum(word_count)::BIGINT AS total_words, sum(sentence_count)::BIGINT AS total_sentences,
  count(section) AS chunks_with_section, count(page) AS chunks_with_page,
  round(sum(word_count) / count(*), 6) AS avg_chunk_length,
  floor(count(section) / count(*) * 100)::BIGINT AS section_percent FROM kept""")
def _(spark, sf):
    lines = line_chunks(spark, sf).select("doc_id", "page")
    read = documents(spark, sf).select("doc_id", F.lit(None).cast(lines.schema["page"].dataType).alias("page"))
    kept = line_chunks(spark, sf).filter("word_count >= 30")
    return M.processing_stats(kept, elements=read.union(lines)).select(
        "total_documents", "total_pages", "total_chunks", "total_words", "total_sentences",
        "chunks_with_section", "chunks_with_page",
        F.round("avg_chunk_length", 6).alias("avg_chunk_length"), "section_percent")


@query("chunk_quality", sql=rf"""WITH {LINE_CHUNKS_SQL}, {OVERLAP_SQL}
SELECT round(avg((section IS NOT NULL)::INT), 6) AS has_section_rate, round(avg((page IS NOT NULL)::INT), 6) AS has_page_rate,
  round(avg((word_count BETWEEN 100 AND 800)::INT), 6) AS good_length_rate,
  round(avg((preceding_context IS NOT NULL OR following_context IS NOT NULL)::INT), 6) AS has_overlap_rate,
  round(avg(regexp_matches({q.strip('text')}, '[.!?"'')]$')::INT), 6) AS ends_complete_rate FROM overlapped""")
def _(spark, sf):
    rates = M.quality_rates(C.context_overlap(line_chunks(spark, sf)))
    return rates.select(*[F.round(c, 6).alias(c) for c in rates.columns])


# --- filters -----------------------------------------------------------------

# text with one kind of boilerplate added per document, so that every rule has hits
BOILER = [
    "", "\nOne .... 3\nTwo .... 5\nThree .... 8\nFour .... 9",
    " All rights reserved. ISBN 1", "\nAbel, 12\nBaker, 3-4\nCain, 5, 7\nDunn, 8\nEvans, 9\nFord, 1",
    " (1999) pp. 12 vol. 3", " Table of Contents", "\ncontents page 1\nLibrary of Congress",
]


def boiler_chunks(spark, sf) -> DataFrame:
    extra = F.get(F.array(*[F.lit(b) for b in BOILER]), (F.col("doc_id") % 7).cast("int"))
    return line_chunks(spark, sf).withColumn("text", F.concat("text", extra)).withColumn(
        "word_count", T.word_count(F.col("text")))


def _sql_text(value: str) -> str:
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in value.split("\n"))


BOILER_SQL = f"""{LINE_CHUNKS_SQL}, boiled AS (SELECT doc_id, chunk_idx, source,
  text || [{', '.join(_sql_text(b) for b in BOILER)}][(doc_id % 7) + 1] AS text FROM line_chunks),
b AS (SELECT *, {q.word_count('text')} AS word_count, string_split(text, chr(10)) AS lines, lower(text) AS low FROM boiled)"""
FRONT_SQL = " + ".join(f"contains(low, '{p}')::INT" for p in K.FRONT_MATTER_PHRASES)
CITE_SQL = " + ".join(f"regexp_matches(text, '{p}')::INT" for p in K.CITATION_PATTERNS)
DROP_SQL = f"""CASE WHEN word_count < 30 THEN 'short'
  WHEN len(list_filter(lines, lambda x: regexp_matches(x, '{K.TOC_LINE}'))) > 3 THEN 'toc_lines'
  WHEN {FRONT_SQL} >= 2 THEN 'front_matter'
  WHEN len(list_filter(lines, lambda x: regexp_matches(x, '{K.INDEX_LINE}'))) > 5 THEN 'index_lines'
  WHEN word_count < 100 AND {CITE_SQL} >= 3 THEN 'citations'
  WHEN starts_with(low, 'contents') OR contains(low, 'table of contents') THEN 'contents' END"""


@query("filter_noncontent", sql=f"""WITH {BOILER_SQL}
SELECT doc_id, chunk_idx, {DROP_SQL} AS drop_reason FROM b""")
def _(spark, sf):
    return L.with_drop_reason(boiler_chunks(spark, sf)).select("doc_id", "chunk_idx", "drop_reason")


@query("prefilter_obvious", sql=rf"""WITH {BOILER_SQL},
l AS (SELECT *, list_filter(lines, lambda x: x <> '') AS full_lines FROM b),
o AS (SELECT *, ((contains(low, 'table of contents') OR starts_with(low, 'contents')) AND
  len(list_filter(full_lines, lambda x: regexp_matches(x, '\p{{N}}') AND length(x) < 60)) / greatest(1, len(full_lines)) > 0.8)
  OR ((contains(low, 'isbn') OR contains(low, 'library of congress')) AND length(text) < 500) AS obvious FROM l)
SELECT doc_id, chunk_idx, word_count FROM o WHERE word_count >= 50 AND NOT obvious""")
def _(spark, sf):
    return L.prefilter_obvious(boiler_chunks(spark, sf)).select("doc_id", "chunk_idx", "word_count")


PICKED = ["src1", "src3", "src12"]


@query("filter_sources", sql=f"""SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents
WHERE source IN ({q.in_list(PICKED)}) GROUP BY source""")
def _(spark, sf):
    kept = L.filter_sources(read_table(spark, sf, "documents"), PICKED)
    return kept.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("contains_text", sql="""SELECT doc_id, source FROM documents WHERE contains(lower(text), lower('THING'))""")
def _(spark, sf):
    return L.contains_text(read_table(spark, sf, "documents"), "THING").select("doc_id", "source")


REMOVED_SQL = "SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING sum(toxic) > (SELECT sum(toxic) / count(DISTINCT source) FROM documents JOIN labels USING (doc_id))"


def _removed(spark, sf) -> DataFrame:
    """Sources with more toxic documents than the average source."""
    per_source = (
        read_table(spark, sf, "documents").select("doc_id", "source")
        .join(read_table(spark, sf, "labels"), "doc_id").groupBy("source")
        .agg(F.sum("toxic").alias("toxic"))
    )
    mean = per_source.agg(F.avg("toxic").alias("m")).scalar()
    return per_source.filter(F.col("toxic") > mean).select("source")


@query("remove_document", sql=f"""SELECT doc_id, source FROM documents WHERE source NOT IN ({REMOVED_SQL})""")
def _(spark, sf):
    return L.remove_documents(read_table(spark, sf, "documents"), _removed(spark, sf)).select("doc_id", "source")


@query("removed_counts", sql=f"""SELECT source, count(*) AS removed FROM documents WHERE source IN ({REMOVED_SQL}) GROUP BY source""")
def _(spark, sf):
    return L.removed_counts(read_table(spark, sf, "documents"), _removed(spark, sf))


# headings built from the first words of each line plus typical noise
NOISE = ["", " 12", " Press, 1990", " University, Rome", "42", " Review, 3"]


def noisy_headings(spark, sf) -> DataFrame:
    head = F.array_join(F.slice(T.words(F.col("text")), 1, 4), " ")
    extra = F.get(F.array(*[F.lit(x) for x in NOISE]), F.col("chunk_idx") % 6)
    value = F.when(F.col("chunk_idx") % 11 == 5, "12-3 4").otherwise(F.concat(head, extra))
    return line_chunks(spark, sf).select("doc_id", "chunk_idx", value.alias("heading"))


NOISY_SQL = f"""{LINE_CHUNKS_SQL}, noisy AS (SELECT doc_id, chunk_idx, CASE WHEN chunk_idx % 11 = 5 THEN '12-3 4'
  ELSE array_to_string({q.words('text')}[1:4], ' ') || [{q.in_list(NOISE)}][(chunk_idx % 6) + 1] END AS heading FROM line_chunks)"""


@query("clean_metadata", sql=rf"""WITH {NOISY_SQL},
c AS (SELECT doc_id, chunk_idx, {q.trim_spaces(r"regexp_replace(heading, '\p{N}+$', '')")} AS bare FROM noisy)
SELECT doc_id, chunk_idx, CASE WHEN NOT regexp_matches(bare, '^[\p{{N}}\s.-]*$') AND NOT contains(bare, 'Press,')
  AND NOT (contains(bare, 'University') AND contains(bare, ',')) THEN bare END AS heading FROM c""")
def _(spark, sf):
    return noisy_headings(spark, sf).withColumn("heading", L.clean_metadata(F.col("heading")))


@query("is_bad_section", sql=rf"""WITH {NOISY_SQL}, s AS (SELECT doc_id, chunk_idx, {q.strip('heading')} AS bare FROM noisy)
SELECT doc_id, chunk_idx, bare = '' OR (regexp_matches(bare, '\p{{N}}$') AND length(bare) > 3) OR contains(bare, 'Press,')
  OR contains(bare, 'Review,') OR regexp_matches(bare, '^[\p{{N}}\s.-]*$') AS bad FROM s""")
def _(spark, sf):
    return noisy_headings(spark, sf).select(
        "doc_id", "chunk_idx", L.is_bad_section(F.col("heading")).alias("bad"))
