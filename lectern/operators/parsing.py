"""Reading model replies: JSON extraction, strict decoding and replies about chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators.filters import prefilter_obvious

MCQ_FIELDS = {"question": "string", "options": "array<string>", "correctIndex": "int", "explanation": "string"}
USUAL_MCQ = [
    "OBJECT<correctIndex: BIGINT, explanation: STRING, options: ARRAY<STRING>, question: STRING>",
    "OBJECT<correctIndex: BIGINT, options: ARRAY<STRING>, question: STRING>",
]
OPEN_FIELDS = {"question": "string", "idealAnswer": "string", "keyPoints": "array<string>"}
#: Space around an option and the labels before it, each at most once and in their order.
LABEL = r"\A[\t\p{Zs}]*" + "".join(f"(?:{p[1:]})?" for p in K.OPTION_LABELS) + r"[\t\p{Zs}]*|[\t\p{Zs}]+\z"
CARDS_JSON = "array<struct<question:string,answer:string>>"


def extract_json(raw: Column, kind: str = "{}") -> Column:
    """First opener to last closer, code fences removed; null when there is none."""
    opener, closer = ("\\" + c for c in kind)
    bare = F.when(F.contains(raw, F.lit("```")), F.replace(
        F.replace(raw, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))).otherwise(raw)

    def between(text):
        found = F.regexp_extract(text, f"(?s){opener}.*{closer}", 0)
        whole = text.startswith(kind[0]) & text.endswith(kind[1])
        return F.when(whole, text).otherwise(T.let(found, lambda f: F.when(f != "", f)))

    return T.let(bare, between)


def _kind(value: Column, name: str) -> Column:
    """Type of the top-level field ``name`` of a JSON value, '' when there is none."""
    field = F.try_variant_get(value, f"$.{name}", "variant")
    return F.coalesce(F.schema_of_variant(field), F.lit(""))


def _fields(value: Column, types: dict[str, str]) -> Column:
    """struct of top-level fields of a parsed JSON value; null where one is missing or of another kind."""
    return F.struct(*[F.try_variant_get(value, f"$.{n}", t).alias(n) for n, t in types.items()])


def _has_field(value: Column, name: str, kind: str) -> Column:
    found = _kind(value, name)
    return found == kind if kind.isalpha() else found.rlike(f"^{kind}$")


def _optional(value: Column, name: str, kind: str) -> Column:
    return _has_field(value, name, f"({kind}|VOID)?")


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _decode_mcq(raw: Column) -> Column:
    """struct or null: question and options are strings, the index a whole number."""

    def decode(shape: Column) -> Column:
        ok = (
            _has_field(shape, "question", "STRING")
            & _has_field(shape, "options", "ARRAY<STRING>")
            & _has_field(shape, "correctIndex", "BIGINT")
            & _optional(shape, "explanation", "STRING")
        )
        # one look at the whole reply settles those of just the usual fields
        usual = F.schema_of_variant(shape).isin(USUAL_MCQ)
        return F.when(F.coalesce(usual, F.lit(False)) | ok, _fields(shape, MCQ_FIELDS))

    return T.let(F.try_parse_json(extract_json(raw)), decode)


def clean_option_label(option: Column) -> Column:
    """Strip ``A)``, ``B.``, ``c:``, ``A )`` and ``(D)`` from the front of an option."""
    return F.regexp_replace(option, LABEL, "")


def shuffled_options(options: Column, correct: Column, seed: str, key: Column) -> Column:
    """struct(options, correct_index) in repeatable random order.

    An index outside the options becomes 0.
    """
    keyed = F.array_sort(F.transform(options, lambda o, i: F.struct(
        T.seeded_hash(seed, key, F.lit(":"), i).alias("h"), i.alias("i"), o.alias("o"))))
    return T.let(keyed, lambda k: F.struct(
        F.transform(k, lambda x: x["o"]).alias("options"),
        F.greatest(F.array_position(F.transform(k, lambda x: x["i"]), correct).cast("int") - 1,
                   F.lit(0)).alias("correct_index"),
    ))


def accepted(value: Column, ok, row) -> Column:
    """Rows for ``F.inline``: ``row(v)`` where ``value`` is present and ``ok(v)`` holds.

    The value is computed once; a filter on a computed column would be pushed below the
    projection and compute it again for every reference.
    """
    return T.let(value, lambda v: F.when(v.isNotNull() & ok(v), F.array(row(v))))


def mcq_rows(raw: Column, key: Column, seed: str = "options") -> Column:
    """An array with the question that a reply holds if it is accepted, else null.

    Four distinct options of more than one character, none a placeholder; labels are
    stripped and the options shuffled.
    """

    def clean(q):
        return F.struct(
            q["question"].alias("question"), q["correctIndex"].alias("index"),
            q["explanation"].alias("explanation"),
            F.transform(q["options"], clean_option_label).alias("options"),
        )

    def ok(c):
        return (
            (F.size(c["options"]) == 4) & (F.size(F.array_distinct(c["options"])) == 4)
            & F.forall(c["options"], lambda o: (F.length(o) > 1)
                       & ~F.lower(o).isin(K.PLACEHOLDER_OPTIONS))
        )

    def row(c):
        mixed = shuffled_options(c["options"], c["index"], seed, key)
        return T.let(mixed, lambda m: F.struct(
            T.trim_spaces(c["question"]).alias("question"), m["options"].alias("options"),
            m["correct_index"].alias("correct_index"),
            F.coalesce(c["explanation"], F.lit(K.DEFAULT_EXPLANATION)).alias("explanation"),
        ))

    cleaned = T.let(_decode_mcq(raw), lambda q: F.when(q.isNotNull(), clean(q)))
    return accepted(cleaned, ok, row)


def parse_mcq(replies: DataFrame, key: str, seed: str = "options") -> DataFrame:
    """Accepted multiple choice questions of (key, raw, ...) rows (``mcq_rows``); the others are dropped."""
    return replies.select(
        *[c for c in replies.columns if c != "raw"], F.inline(mcq_rows(F.col("raw"), F.col(key), seed)))


def parse_training_mcq(replies: DataFrame) -> DataFrame:
    """Stricter reading for training: index 0 to 3, question over 20 characters, options as given."""

    def ok(q):
        return (
            (F.size(q["options"]) == 4) & (F.size(F.array_distinct(q["options"])) == 4)
            & q["correctIndex"].between(0, 3) & (F.length(q["question"]) > 20)
        )

    return replies.select(
        *[c for c in replies.columns if c != "raw"],
        F.inline(accepted(_decode_mcq(F.col("raw")), ok, decoded_row)))


def decoded_row(q: Column) -> Column:
    return F.struct(
        q["question"].alias("question"), q["options"].alias("options"),
        q["correctIndex"].alias("correct_index"),
        F.coalesce(q["explanation"], F.lit(K.DEFAULT_EXPLANATION)).alias("explanation"),
    )


def decode_mcq(replies: DataFrame, keep_failed: bool = False) -> DataFrame:
    """Well-formed questions as given, before any check on their content.

    ``keep_failed`` keeps unreadable replies with null fields.
    """
    rows = accepted(_decode_mcq(F.col("raw")), lambda q: F.lit(True), decoded_row)
    keep = [c for c in replies.columns if c != "raw"]
    return replies.select(*keep, F.inline_outer(rows) if keep_failed else F.inline(rows))


def parse_open_ended(replies: DataFrame) -> DataFrame:
    """Open questions of (raw, source, text) rows; missing key points become an empty list."""

    def decode(shape: Column) -> Column:
        ok = (
            _has_field(shape, "question", "STRING") & _has_field(shape, "idealAnswer", "STRING")
            & _optional(shape, "keyPoints", "ARRAY<(STRING|VOID)>")
        )
        return F.when(ok, _fields(shape, OPEN_FIELDS))

    def row(q):
        return F.struct(
            q["question"].alias("question"), q["idealAnswer"].alias("ideal_answer"),
            F.coalesce(q["keyPoints"], F.array().cast("array<string>")).alias("key_points"),
            F.substring("text", 1, 500).alias("context"),
        )

    value = T.let(F.try_parse_json(extract_json(F.col("raw"))), decode)
    return replies.select(
        *[c for c in replies.columns if c not in ("raw", "text")],
        F.inline(accepted(value, lambda q: F.lit(True), row)))


def parse_flashcards(replies: DataFrame) -> DataFrame:
    """One row per card of (raw, source, ...); one malformed card voids its reply.

    ``source`` is that of the first chunk the batch was made from.
    """

    def decode(json: Column) -> Column:
        cards = F.from_json(json, CARDS_JSON)
        each = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
        sound = F.forall(each, lambda c: _has_field(c, "question", "STRING") & _has_field(c, "answer", "STRING"))
        return F.when(F.coalesce(sound, F.lit(False)), cards)

    found = replies.withColumn("_c", T.let(extract_json(F.col("raw"), "[]"), decode))
    keep = [c for c in replies.columns if c != "raw"]
    cards = F.when(F.size("_c") > 0, F.col("_c"))  # of a bare column Spark would infer a filter that reads all again
    return found.select(*keep, F.posexplode(cards).alias("pos", "_card")).select(
        *keep, "pos", "_card.question", "_card.answer")


def parse_summary(raw: Column, text: Column, chapter: Column, section: Column) -> Column:
    """struct(type, summary, chapter, section) of a summary reply.

    Unreadable replies fall back to the chunk itself; an empty summary to its text.
    """

    def decode(shape: Column) -> Column:
        read = T.let(_strings(shape, "type", "summary", "chapter", "section"), lambda r: F.struct(
            F.lower(F.coalesce(r["type"], F.lit("content"))).alias("type"),
            F.coalesce(F.when(r["summary"] != "", r["summary"]), text).alias("summary"),
            F.when(r["chapter"] != "null", r["chapter"]).alias("chapter"),
            F.when(r["section"] != "null", r["section"]).alias("section"),
        ))
        unread = F.struct(F.lit("content").alias("type"), text.alias("summary"),
                          chapter.alias("chapter"), section.alias("section"))
        return F.when(_is_object(shape), read).otherwise(unread)

    return T.let(F.try_parse_json(extract_json(raw)), decode)


def _strings(shape: Column, *names: str) -> Column:
    """struct of the top-level fields that are strings; the others are null."""
    return F.struct(*[F.when(_has_field(shape, n, "STRING"), F.try_variant_get(shape, f"$.{n}", "string")).alias(n)
                      for n in names])


def parse_classification(raw: Column, chapter: Column, section: Column) -> Column:
    """struct(type, chapter, section, quality); unreadable replies count as content at 0.7."""

    def decode(shape: Column) -> Column:
        number = _has_field(shape, "quality", r"(BIGINT|DOUBLE|DECIMAL\(.*\))")
        found = F.struct(_strings(shape, "type", "chapter", "section").alias("read"), _is_object(shape).alias("readable"))
        quality = F.coalesce(F.when(number, F.try_variant_get(shape, "$.quality", "double")), F.lit(0.7))

        def named(f):
            read, readable = f["read"], f["readable"]
            kind = F.lower(F.coalesce(read["type"], F.lit("content")))
            return F.struct(
                T.let(kind, lambda k: F.when(k == "toc", "toc").when(k.isin("frontmatter", "front_matter"), "frontMatter")
                      .when(k == "citation", "citation").when(k == "index", "index").otherwise("content")).alias("type"),
                F.when(readable, F.when(read["chapter"] != "null", read["chapter"])).otherwise(chapter).alias("chapter"),
                F.when(readable, F.when(read["section"] != "null", read["section"])).otherwise(section).alias("section"),
                quality.alias("quality"),
            )

        return T.let(found, named)

    return T.let(F.try_parse_json(extract_json(raw)), decode)


def apply_summaries(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Replace chunk texts by their summaries; ``replies`` is (doc_id, chunk_idx, raw).

    Obvious non-content and chunks under 50 words never reach a model; what the
    reply does not call content is dropped.
    """
    asked = prefilter_obvious(chunks).join(replies, ["doc_id", "chunk_idx"])
    summary = parse_summary(F.col("raw"), F.col("text"), F.col("chapter"), F.col("section"))
    kept = asked.select("*", F.inline(accepted(
        summary, lambda s: (s["type"] == "content") & (s["summary"] != ""),
        lambda s: F.struct(s.alias("_s")))))
    return kept.withColumns({
        "text": F.col("_s.summary"),
        "chapter": F.coalesce("_s.chapter", "chapter"),
        "section": F.coalesce("_s.section", "section"),
        "sentence_count": T.sentence_count(F.col("_s.summary")),
        "word_count": T.word_count(F.col("_s.summary")),
        "preceding_context": F.lit(None).cast("string"),
        "following_context": F.lit(None).cast("string"),
    }).drop("_s", "raw")
