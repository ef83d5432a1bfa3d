"""Study results: grading, missed questions, reports and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.ranking import ranked

LETTERS = ["A", "B", "C", "D"]


def _answered(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with the given answer; unanswered ones keep null."""
    return questions.join(answers.select("quiz_id", "question_id", "user_answer"),
                          ["quiz_id", "question_id"], "left")


def grade_quiz(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Score, percentage and band (high from 70, middle from 50, low) per quiz."""
    right = F.coalesce(F.col("user_answer") == F.col("correct_index"), F.lit(False))
    graded = _answered(questions, answers).groupBy("quiz_id").agg(
        F.count_if(right).alias("score"), F.count("*").alias("questions"))
    percent = T.ratio(F.col("score"), F.col("questions")) * 100
    return graded.withColumn("percent", percent).withColumn(
        "band", F.when(F.col("percent") >= 70, "high").when(F.col("percent") >= 50, "middle")
        .otherwise("low"))


def missed_questions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions answered wrongly or not at all."""
    return _answered(questions, answers).filter(
        ~F.col("user_answer").eqNullSafe(F.col("correct_index")))


def quiz_report(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per option with its letter and mark: ✓ correct, ✗ wrongly chosen."""
    every = _answered(questions, answers).select(
        "quiz_id", "question_id", "correct_index", "user_answer",
        F.posexplode("options").alias("pos", "option"))
    letter = F.get(F.array(*[F.lit(x) for x in LETTERS]), F.col("pos"))
    mark = F.when(F.col("pos") == F.col("correct_index"), " ✓").when(
        F.col("pos") == F.col("user_answer"), " ✗").otherwise("")
    return every.select("quiz_id", "question_id", "pos", F.concat(
        F.coalesce(letter, F.lit("?")), F.lit(". "), "option", mark).alias("line"))


def study_progress(activity: DataFrame) -> DataFrame:
    """Progress counters per user.

    ``activity`` has (user_id, kind, score, questions, ts) with kind ``quiz`` or ``card``;
    works on batches and streams alike.
    """
    quiz, card = F.col("kind") == "quiz", F.col("kind") == "card"
    return activity.filter(quiz | card).groupBy("user_id").agg(
        F.count_if(quiz).alias("quizzes_taken"),
        F.coalesce(F.sum(F.when(quiz, F.col("score"))), F.lit(0)).alias("total_score"),
        F.coalesce(F.sum(F.when(quiz, F.col("questions"))), F.lit(0)).alias("total_questions"),
        F.count_if(card).alias("cards_reviewed"), F.max("ts").alias("last_studied"),
    )


def with_average(progress: DataFrame) -> DataFrame:
    """Add ``average_percent``, null where no question was seen."""
    share = F.try_divide(F.col("total_score").cast("double"), F.col("total_questions").cast("double"))
    return progress.withColumn("average_percent", share * 100)


def library_overview(quiz_sets: DataFrame, card_sets: DataFrame) -> DataFrame:
    """Numbers of sets, questions and cards."""
    q = quiz_sets.agg(F.count("*").alias("quiz_sets"),
                      F.coalesce(F.sum(F.size("questions")), F.lit(0)).alias("total_questions"))
    c = card_sets.agg(F.count("*").alias("card_sets"),
                      F.coalesce(F.sum(F.size("cards")), F.lit(0)).alias("total_cards"))
    return q.select("quiz_sets", "total_questions",
                    c.select("card_sets").scalar().alias("card_sets"),
                    c.select("total_cards").scalar().alias("total_cards"))


def topic_completion(topics: DataFrame, by: str) -> DataFrame:
    """Completed of total topics per group; ``topics`` has a boolean is_complete."""
    return topics.groupBy(by).agg(
        F.count_if("is_complete").alias("completed"), F.count("*").alias("total"))


def shuffle_cards(cards: DataFrame, seed: str, by: str, key: str) -> DataFrame:
    """Add ``pos``: a repeatable random order of the cards of each set.

    The order is by hash, whose leading digits cut a large set into even parts.
    """
    hashed = cards.withColumn("_h", T.seeded_hash(seed, F.col(key)))
    placed = ranked(hashed, by, ["_h", key], F.substring("_h", 1, 2), "pos")
    return placed.withColumn("pos", F.col("pos") - 1).drop("_h")
