"""SQL of the pair and span queries: every pair of a table by plain joins, for small tables."""

#: All pairs of a label by cosine, then what links lead to.
EMBEDDINGS_SQL = """
with recursive fit as (
  select vec_id, label, embedding::double[] e from embeddings
  where label is not null and len(embedding) > 0
    and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding::double[], lambda x: x <> 0)) > 0
), links as (
  select a.vec_id a, b.vec_id b from fit a join fit b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (
  select distinct a, a b from links
  union
  select reach.a, links.b from reach join links on reach.b = links.a
), heads as (
  select a, min(b) head from reach group by 1
), counts as (
  select a, count(*) n from links group by 1
)
select vec_id, coalesce(n, 0)::bigint n_links, coalesce(head, vec_id) component_id,
       coalesce(head, vec_id) = vec_id kept
from embeddings left join heads on heads.a = vec_id left join counts on counts.a = vec_id
"""

#: Sets of five-word shingles (a shorter text is one), shared ones counted by an inverted list.
NGRAM_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') w from documents
), grams as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from words where len(w) > 0)
), sizes as (
  select doc_id, count(*) n from grams group by 1
), shared as (
  select x.doc_id a, y.doc_id b, count(*) c from grams x join grams y using (g)
  where x.doc_id <> y.doc_id group by 1, 2
), links as (
  select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where 5 * c >= 4 * (p.n + q.n - c)
), reach as (
  select distinct a, a b from links
  union
  select reach.a, links.b from reach join links on reach.b = links.a
), heads as (
  select a, min(b) head from reach group by 1
), counts as (
  select a, count(*) n from links group by 1
)
select doc_id, coalesce(head, doc_id) class_id, coalesce(n, 0)::bigint n_links,
       coalesce(head, doc_id) = doc_id kept
from documents left join heads on heads.a = doc_id left join counts on counts.a = doc_id
"""

#: Sets of 5-character shingles.  Two sets at 0.8 or more share one of the rarest fifth of either, so
#: only lines that do are compared; this loses no pair.
LINES_SQL = r"""
with recursive lines as (
  select doc_id, i line_no, trim(s[i + 1], ' ') line
  from (select doc_id, s, unnest(range(len(s))) i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) s from documents))
), sets as (
  select row_number() over (order by line) id, line, case when length(line) < 5 then [line] else
         list_distinct(list_transform(range(1, length(line) - 3), lambda k: substr(line, k, 5))) end s
  from (select distinct line from lines where line <> '')
), shingles as (
  select id, len(s) n, unnest(s) g from sets
), ranked as (
  select id, n, g, row_number() over (partition by id order by f, g) place
  from shingles join (select g, count(*) f from shingles group by 1) using (g)
), rare as (
  select id, n, g from ranked where place <= n - (4 * n + 4) // 5 + 1
), near as (
  select distinct x.id a, y.id b from rare x join rare y
  on x.g = y.g and x.id < y.id and 5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n
), met as (
  select a, b, len(list_intersect(p.s, q.s)) c, len(p.s) + len(q.s) n
  from near join sets p on p.id = a join sets q on q.id = b
), pairs as (
  select a, b from met where 5 * c >= 4 * (n - c)
), links as (
  select a, b from pairs union all select b, a from pairs
), reach as (
  select distinct a, a b from links
  union
  select reach.a, links.b from reach join links on reach.b = links.a
), heads as (
  select a, min(b) head from reach group by 1
), placed as (
  select doc_id, line_no, coalesce(head, id) component
  from lines left join sets using (line) left join heads on heads.a = id
), told as (
  select *, case when component is null then {'d': doc_id, 'n': line_no}
                 else min({'d': doc_id, 'n': line_no}) over (partition by component) end head,
         case when component is null then 1 else count(*) over (partition by component) end size
  from placed
)
select doc_id, line_no, head.d class_doc_id, head.n class_line_no, size::bigint class_size,
       head.d = doc_id and head.n = line_no kept
from told
"""


def secrets_sql(assign: str, scope: int) -> str:
    """Spans of every kind by matches and the texts between them; weak parts by all pairs of a text."""
    kinds = [
        ("assign", "secret", assign, "length(regexp_extract(m[i], p, 2)) >= 6"),
        ("access", "id", "AKIA[A-Z0-9]+", "length(m[i]) >= 20"),
        ("hex", "secret", "[0-9a-f]+", "length(m[i]) >= 24"),
        ("id", "id", r"\b(AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}", "true"),
        ("key", "secret", "[A-Za-z0-9+/_-]{32,}", "true"),
        ("endpoint", "endpoint", r"\b(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{4,}", "true"),
    ]

    def spans(k: int) -> str:
        name, role, pattern, keep = kinds[k]
        literal = "'" + pattern.replace("'", "''") + "'"
        return f"""
  select doc_id, {k} k, '{name}' kind, '{role}' part, ahead + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) s,
         s + length(m[i]) e
  from (select *, {literal} p, list_sum(list_transform(gaps[1:i], lambda x: length(x))) ahead
        from (select doc_id, m, gaps, unnest(range(1, len(m) + 1)) i
              from (select doc_id, regexp_extract_all(t, {literal}) m, regexp_split_to_array(t, {literal}) gaps
                    from texts)))
  where {keep}"""

    every = " union all ".join(spans(k) for k in range(len(kinds)))
    return f"""
with texts as (
  select doc_id, coalesce(text, '') t from documents
), parts as ({every}
), base as (
  select * from parts where k < 3
), added as (
  select * from parts w where k >= 3
    and exists (select 1 from parts o where o.doc_id = w.doc_id and o.part <> w.part
                and (o.e between w.s - {scope} and w.s or o.s between w.e and w.e + {scope}))
    and not exists (select 1 from base b where b.doc_id = w.doc_id and b.s < w.e and w.s < b.e)
), told as (
  select *, kind || ':' || s::bigint || ':' || e::bigint word from (from base union all from added)
), listed as (
  select doc_id, count(*) filter (k = 0) a, count(*) filter (k = 1) c, count(*) filter (k = 2) h,
         count(*) filter (k >= 3) more, string_agg(word, ',' order by s, k, e) filter (k < 3) b,
         string_agg(word, ',' order by s, k, e) spans
  from told group by 1
)
select doc_id, coalesce(a, 0) n_assign, coalesce(c, 0) n_access, coalesce(h, 0) n_hex,
       sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans, coalesce(more, 0) n_linked
from documents left join listed using (doc_id)
"""
