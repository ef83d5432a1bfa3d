"""Judging questions: validation, candidate scores, selection and acceptance rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.functions import text as T
from lectern.operators import parsing as X
from lectern.operators.filters import any_of, count_of, has

#: At most four words, each with a capital in front.
NAME_OPTION = r"\A(?:\p{Lu}[^ ]*(?: +|\z)){0,4}\z"


def classify_option_type(option: Column) -> Column:
    """year, number, name or phrase."""
    def kind(bare: Column) -> Column:
        number = bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
        return (
            F.when(bare.rlike(K.YEAR_OPTION), "year").when(number, "number")
            .when(bare.rlike(NAME_OPTION), "name").otherwise("phrase")
        )

    return T.let(T.trim_spaces(option), kind)


def _flag(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def validate_question(question: Column, options: Column, correct_index: Column) -> Column:
    """struct(is_valid, score, issues): score is self-containment from 0 to 5.

    Structural issues and vague wording invalidate; mixed option types and length do not.
    """
    wording = T.let(F.lower(question), lambda low: F.struct(
        count_of([has(low, p) for p in K.VAGUE_PHRASES]).alias("vague"),
        any_of([low.startswith(p) for p in K.PRONOUN_STARTS]).alias("pronoun")))
    bad = F.exists(options, lambda o: T.let(F.lower(o), lambda low: any_of([has(low, p) for p in K.BAD_OPTION_PARTS])))
    facts = F.struct(
        wording.alias("wording"), bad.alias("bad"),
        (F.length(question) > 300).alias("long"), F.size(options).alias("options"),
        (F.size(F.array_distinct(options)) != F.size(options)).alias("same"))
    return T.let(facts, lambda f: _verdict(question, options, correct_index, f))


def _verdict(question: Column, options: Column, correct_index: Column, facts: Column) -> Column:
    """``validate_question`` from what is used more than once, computed beforehand."""
    vague_hits, pronoun = facts["wording"]["vague"], facts["wording"]["pronoun"]
    no_capital = ~question.rlike(r"\p{Lu}")
    too_long = facts["long"]
    structural = {
        "option_count": facts["options"] != 4,
        "index_range": (correct_index < 0) | (correct_index >= facts["options"]),
        "duplicate_options": facts["same"],
        "question_short": F.length(question) < 15,
        "bad_option": facts["bad"],
    }
    wording = {"vague": vague_hits > 0, "pronoun_start": pronoun}
    soft = {
        "mixed_types": F.size(F.array_distinct(F.transform(options, classify_option_type))) > 1,
        "question_long": too_long,
    }
    score = (
        F.lit(5) - 2 * vague_hits - 2 * pronoun.cast("int")
        - no_capital.cast("int") - too_long.cast("int")
    )
    flags = {**structural, **wording, **soft}
    return F.struct(
        (~any_of(list(structural.values()) + list(wording.values()))).alias("is_valid"),
        F.greatest(score, F.lit(0)).alias("score"),
        F.array_compact(F.array(*[_flag(c, n) for n, c in flags.items()])).alias("issues"),
    )


def score_candidate(
    question: Column, options: Column, explanation: Column, containment: Column, chunk: Column
) -> Column:
    """Preference among valid candidates: wording, options, explanation and source overlap."""
    n = F.length(question)
    lengths = F.transform(options, lambda o: F.length(o).cast("double"))

    def spread(ls):
        mean = F.aggregate(ls, F.lit(0.0), lambda a, x: a + x) / F.size(ls)
        return T.let(mean, lambda m: F.aggregate(
            ls, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(ls))

    def step(variance):
        return F.when(variance < 100, 2).when(variance < 400, 1).otherwise(0)

    # the question has far fewer words than the chunk: they are looked up in it, between spaces
    asked = F.array_distinct(F.filter(T.space_words(question), lambda w: F.length(w) > 5))
    spaced = F.concat(F.lit(" "), T.one_space(F.lower(chunk)), F.lit(" "))
    shared = F.when(chunk.isNotNull(), T.let(spaced, lambda s: F.size(F.filter(
        asked, lambda w: F.contains(s, F.concat(F.lit(" "), w, F.lit(" ")))))))
    return (
        F.when(n.between(30, 150), 2).when(n.between(20, 200), 1).otherwise(0)
        + containment * 2
        + T.let(T.let(lengths, spread), step)
        + F.when(F.length(explanation) >= 20, 1).otherwise(0)
        + F.least(shared, F.lit(3))
    )


def with_validation(questions: DataFrame) -> DataFrame:
    verdict = validate_question(F.col("question"), F.col("options"), F.col("correct_index"))
    return questions.withColumn("_v", verdict).select(
        *questions.columns, F.col("_v.is_valid").alias("is_valid"),
        F.col("_v.score").alias("self_containment"), F.col("_v.issues").alias("issues"),
    )


def judgement(get) -> Column:
    """An array with order and self-containment of a candidate that may be chosen, else null.

    ``get`` gives the candidate's fields by name.  The least order is the one to choose; a ``tier`` of 0 is taken
    before any later candidate.
    """
    verdict = validate_question(get("question"), get("options"), get("correct_index"))

    def judge(v):
        first_tier = v["score"] >= 4
        preference = score_candidate(
            get("question"), get("options"), get("explanation"), v["score"], get("text"))
        return F.struct(
            F.struct(
                F.when(first_tier, 0).otherwise(1).alias("tier"),
                F.when(first_tier, 0).otherwise(-preference).alias("score"),
                get("attempt").alias("attempt"), get("seq").alias("seq"),
            ).alias("_order"),
            v["score"].alias("self_containment"),
        )

    return T.let(verdict, lambda v: F.when(v["is_valid"] & (v["score"] >= 2), F.array(judge(v))))


def best_of_n(candidates: DataFrame, key: str = "chunk_id") -> DataFrame:
    """At most one question per chunk.

    The first candidate by (attempt, seq) that is valid with a score of 4 or more; else
    the best-scored valid one with at least 2.  One aggregation with map-side combine; as its
    winners are whole rows, Spark sorts by chunk for it, which takes little beside the reading of
    replies.  ``candidates`` needs attempt, seq, text and the question columns.
    """
    keep = [c for c in candidates.columns if c not in (key, "text")]
    judged = candidates.select(key, *keep, F.inline(judgement(F.col)))
    return judged.groupBy(key).agg(
        F.min_by(F.struct(*keep, "self_containment"), "_order").alias("w")
    ).select(key, "w.*")


def best_replies(replies: DataFrame, key: str, reply_key: str, seed: str = "options") -> DataFrame:
    """``best_of_n`` over ``parse_mcq`` of (key, attempt, seq, raw, text, reply_key, ...) rows.

    The replies of a key are read in order until one settles it, so those after it are not parsed.
    """
    cols = ["attempt", "seq", *[c for c in replies.columns if c not in (key, "attempt", "seq")]]
    keep = [c for c in replies.columns if c not in (key, "raw", "text")]
    made = ["question", "options", "correct_index", "explanation"]

    def chosen(r, q, j):
        row = [r[c].alias(c) for c in keep] + [q[c].alias(c) for c in made] + [j["self_containment"].alias("self_containment")]
        return F.array(F.struct(j["_order"].alias("_order"), F.struct(*row).alias("w")))

    def judged(r):
        def judge(q):
            told = judgement(lambda name: q[name] if name in made else r[name])
            return T.let(told, lambda j: F.when(j.isNotNull(), chosen(r, q, F.get(j, F.lit(0)))))

        return T.let(X.mcq_rows(r["raw"], r[reply_key], seed), lambda found: F.when(found.isNotNull(), T.let(
            F.get(found, F.lit(0)), judge)))

    def order(best):
        return F.get(best, F.lit(0))["_order"]

    def step(best, r):
        better = T.let(judged(r), lambda j: F.when(j.isNull(), best).when(
            best.isNull() | (order(j) < order(best)), j).otherwise(best))
        return F.when(F.coalesce(order(best)["tier"] == 0, F.lit(False)), best).otherwise(better)

    kind = replies.select(judged(F.struct(*cols)).alias("x")).schema["x"].dataType.simpleString()
    held = replies.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("replies"))
    return held.select(key, F.inline(F.aggregate("replies", F.lit(None).cast(kind), step))).select(key, "w.*")


def check_output(question: Column, options: Column, correct_index: Column) -> Column:
    """First reason to refuse a finished question, or null."""
    placeholder = F.exists(options, lambda o: F.lower(o).isin(K.ACCEPTANCE_PLACEHOLDERS))
    return (
        F.when(question == "", "question_empty")
        .when(F.size(options) != 4, "option_count")
        .when(placeholder, "placeholder")
        .when(F.exists(options, lambda o: F.length(o) <= 1), "option_short")
        .when(F.size(F.array_distinct(options)) != 4, "duplicate_options")
        .when((correct_index < 0) | (correct_index >= 4), "index_range")
    )


def check_open_output(question: Column, ideal_answer: Column) -> Column:
    return (
        F.when(question == "", "question_empty").when(ideal_answer == "", "answer_empty")
        .when(F.length(ideal_answer) < 20, "answer_short")
    )


def quick_containment(question: Column) -> Column:
    lower = F.lower(question)
    return ~any_of(
        [has(lower, p) for p in K.QUICK_VAGUE_PHRASES]
        + [lower.startswith(p) for p in K.QUICK_PRONOUN_STARTS]
    )


def quick_option_quality(options: Column) -> Column:
    placeholder = F.exists(
        options, lambda o: any_of([has(F.lower(o), p) for p in K.QUICK_PLACEHOLDERS]))
    return (
        (F.size(F.array_distinct(options)) == F.size(options))
        & ~F.exists(options, lambda o: F.length(o) < 2) & ~placeholder
    )


def quality_rates(outputs: DataFrame, by: str) -> DataFrame:
    """Rates of readable, self-contained and well-optioned outputs per group.

    ``outputs`` has question and options, null where the reply was not readable.
    """
    readable = F.col("question").isNotNull() & (F.size("options") == 4)

    def rate(flag):
        return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))

    return outputs.groupBy(by).agg(
        F.count("*").alias("outputs"),
        rate(readable).alias("json_rate"),
        rate(quick_containment(F.col("question"))).alias("containment_rate"),
        rate(quick_option_quality(F.col("options"))).alias("option_rate"),
    )
