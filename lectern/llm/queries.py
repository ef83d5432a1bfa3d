"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
import lectern
from lectern.llm import (
    collocations,
    embedding_dedup,
    exact_dedup,
    line_dedup,
    mixing,
    ngram_join,
    pieces,
    secrets,
    sharding,
    token_counts,
    toxicity,
    twins,
    warc_store,
    whitening,
)
from lectern.sources.tables import read_table

cloudpickle.register_pickle_by_value(lectern)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_embedding_dedup", twins.EMBEDDINGS_SQL)
def op1(spark, sf):
    return embedding_dedup.embedding_dedup(read_table(spark, sf, "embeddings"), threshold=0.93)


@query("op2_toxicity")
def op2(spark, sf):
    return toxicity.toxicity(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


@query("op3_exact_dedup", r"""
with t as (
  select doc_id, length(coalesce(text, '')) n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) h
  from documents
), w as (
  select doc_id, h, first_value(doc_id) over (partition by h order by n desc, doc_id) k,
         count(*) over (partition by h) c
  from t
)
select doc_id, k as keep_id, c as group_size, doc_id = k as kept, h as text_sha256 from w
""")
def op3(spark, sf):
    return exact_dedup.exact_dedup(read_table(spark, sf, "documents"))


@query("op4_source_mix")
def op4(spark, sf):
    mixed = mixing.mix_sources(read_table(spark, sf, "documents"))
    return mixed.select("doc_id", "source", "mix.*")


@query("op5_secrets", twins.secrets_sql(
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 300))
def op5(spark, sf):
    return secrets.secret_report(secrets.find_secrets(read_table(spark, sf, "documents")))


@query("op6_token_counts")
def op6(spark, sf):
    return token_counts.token_counts(
        read_table(spark, sf, "documents"), pieces.tokenizer_file("byte_bpe_50k.json"), limit=512)


@query("op7_line_dedup", twins.LINES_SQL)
def op7(spark, sf):
    return line_dedup.line_dedup(read_table(spark, sf, "documents"), width=5).drop("row")


@query("op8_ngram_join", twins.NGRAM_SQL)
def op8(spark, sf):
    joined = ngram_join.ngram_join(read_table(spark, sf, "documents"))
    return joined.select("doc_id", "class_id", "n_links", "kept")


@query("op9_sentencepiece")
def op9(spark, sf):
    return pieces.piece_digests(pieces.encode_pieces(
        read_table(spark, sf, "documents"), pieces.tokenizer_file("piece_bpe_32k.model")))


@query("op10_byte_shards")
def op10(spark, sf):
    return sharding.byte_shards(read_table(spark, sf, "documents"))


#: Words of pieces, phrases of 1 to 5 words and their counts, then cuts in 128-bit integers.
COLLOCATIONS_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p
  from documents
), words as (
  select lang, regexp_extract_all(p, '[^\x20\x09]+') w from pieces
), spans as (
  select lang, w, unnest(range(1, len(w) + 1)) i from words
), phrases as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') phrase, count(*) a
  from spans, (select unnest([1, 2, 3, 4, 5]) m) where i + m - 1 <= len(w)
  group by all
), totals as (
  select lang, sum(a)::hugeint n from phrases where m = 1 group by 1
), found as (
  select *, string_split(phrase, ' ') w from phrases where m >= 2 and a >= 100
), cuts as (
  select lang, phrase, a, m as size, w, unnest(range(1, m)) k from found
), told as (
  select c.lang, c.phrase, c.a, k, l.a l, r.a r, n,
         (1000::hugeint * c.a * n) // (l.a::hugeint * r.a) score
  from cuts c join totals using (lang)
  join phrases l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ')
  join phrases r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:size], ' ')
), lowest as (
  select * from told qualify row_number() over (partition by lang, phrase order by score, k) = 1
), longer as (
  select lang, array_to_string(w[s:s + x - 1], ' ') phrase, max(a) b
  from found, (select unnest([1, 2, 3, 4]) s), (select unnest([2, 3, 4]) x) where x < m and s + x - 1 <= m
  group by all
)
select lang, rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from (
  select lowest.*, row_number() over (partition by lang order by score desc, a desc, phrase) rank
  from lowest left join longer using (lang, phrase) where b is null or 100 * b < 100 * a
) where rank <= 2000
"""


@query("op11_collocations", COLLOCATIONS_SQL)
def op11(spark, sf):
    return collocations.collocations(read_table(spark, sf, "documents"), longest=5, least=100, top=2000)


@query("op12_whitening")
def op12(spark, sf):
    return whitening.whiten(read_table(spark, sf, "embeddings"), count=32)


#: Base32 from groups of five hexadecimal digits, four letters each.
WARC_SQL = """
with t as (
  select page_id, coalesce(html, '') html from pages
), d as (
  select page_id, html, strlen(html) payload_bytes, sha1(html) h,
         max(page_id) over (partition by html) lead, count(*) over (partition by html) c
  from t
)
select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (('0x' || substr(h, 1 + 5 * (i // 4), 5))::int >> (15 - 5 * (i % 4))) % 32 + 1, 1)), '') payload_digest,
       case when page_id < lead then 'revisit' else 'response' end record_type,
       case when page_id < lead then lead end refers_to
from d
"""


@query("op13_warc", WARC_SQL)
def op13(spark, sf):
    return warc_store.warc_report(read_table(spark, sf, "pages"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
