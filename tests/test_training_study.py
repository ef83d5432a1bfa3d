import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import stopping
from lectern.operators import study as S
from lectern.operators import training as R

EX = "id bigint, question string"


def test_dedup_keeps_the_first_of_a_normalised_group(spark):
    df = spark.createDataFrame([(3, "What  is\nIT?"), (1, " what is it? "), (2, "other")], EX)
    assert sorted(r["id"] for r in R.dedup_questions(df).collect()) == [1, 2]
    s = R.generation_summary(df).first()
    assert (s["generated"], s["kept"], s["duplicates"], round(s["success_rate"], 3)) == (3, 2, 1, 66.667)


@pytest.mark.parametrize("n,train,valid", [(0, 0, 1), (1, 0, 1), (5, 4, 1), (10, 8, 1), (57, 45, 5)])
def test_split_sizes_are_exact(spark, n, train, valid):
    df = spark.createDataFrame([(i, str(i)) for i in range(n)], EX)
    a = R.train_valid_split(df)
    assert a.filter("split = 'train'").count() == train and a.count() == n
    b = R.valid_first_split(df)
    assert b.filter("split = 'valid'").count() == min(valid, n)


def test_split_follows_the_seeded_order(spark):
    import hashlib
    df = spark.createDataFrame([(i, "x") for i in range(200)], EX)
    order = sorted(range(200), key=lambda i: (hashlib.md5(f"split{i}".encode()).hexdigest(), i))
    got = {r["id"] for r in R.train_valid_split(df, 0.33).filter("split = 'train'").collect()}
    assert got == set(order[:66])


def test_formats_are_valid_json_with_awkward_text(spark):
    rows = [('He said "hi"\\ \n\ttab', ['a "b"', "c\\d", "e\nf", "g"], 2, "why", "Easy", "s", "body")]
    df = spark.createDataFrame(rows, "question string, options array<string>, correct_index int, explanation string, difficulty string, source string, chunk_text string")
    text = R.format_chatml(df).first()["text"]
    assert "one question of easy level" in text
    answer = json.loads(text.split("<|im_start|>assistant\n")[1].removesuffix("<|im_end|>"))
    assert answer == {"question": rows[0][0], "options": rows[0][1], "correctIndex": 2, "explanation": "why"}
    line = R.format_role_tags(df).first()["line"]
    assert json.loads(line.split("<|assistant|>\n")[1].removesuffix("<|end|>")) == answer


def test_line_check(spark):
    good = json.dumps({"text": "<|assistant|>x<|end|>"})
    df = spark.createDataFrame([(good,), ("",), ("{}",), ("x",), (json.dumps({"text": "<|end|>"}),)], "value string")
    assert tuple(R.check_jsonl(df).first()) == (1, 3)


def test_attach_drops_questions_without_chunk(spark):
    q = spark.createDataFrame([(1, "a"), (2, "zz")], "id int, source string")
    c = spark.createDataFrame([("a", 2, 0, "later"), ("a", 1, 1, "second"), ("a", 1, 0, "first")], "source string, doc_id int, chunk_idx int, text string")
    got = R.attach_chunk(q, c).collect()
    assert [(r["id"], r["chunk_text"]) for r in got] == [(1, "first")]


def test_log_lines(spark):
    lines = ["Iteration 10: training loss 2.5, iterations/sec 1", "Iteration 20: validation loss 1.25, validation time 3s", "no numbers"]
    got = R.parse_training_log(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r["iteration"], r["train_loss"], r["valid_loss"]) for r in got] == [(10, 2.5, None), (20, 0.0, 1.25), (0, 0.0, None)]


def brute_stop(losses, patience=5, delta=0.001):
    best, left, at = float("inf"), 0, 0
    for i, x in enumerate(losses, 1):
        if x < best - delta:
            best, left, at = x, 0, i
        else:
            left += 1
            if left >= patience:
                return best, at, left, i
    return best, at, left, None


def test_early_stopping_is_a_fold(spark):
    rng = random.Random(2)
    runs = [[0.5, 0.4995, 0.4991, 0.4985], [1.0] * 6, [1.0, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.1], [3.0]]
    runs += [[round(rng.uniform(0, 1), 3) for _ in range(rng.randint(1, 40))] for _ in range(20)]
    rows = [(r, i, x) for r, xs in enumerate(runs) for i, x in enumerate(xs, 1)]
    rng.shuffle(rows)
    got = stopping.early_stopping(spark.createDataFrame(rows, "run_id int, iteration int, valid_loss double")).collect()
    for r in got:
        assert tuple(r)[1:] == brute_stop(runs[r["run_id"]]), r


def test_early_stopping_on_one_long_run(spark):
    rng = random.Random(4)
    losses = [round(2 + rng.uniform(0, 1) + 1000 / (i + 1), 4) for i in range(5000)]
    df = spark.createDataFrame([(1, i * 50, x) for i, x in enumerate(losses, 1)], "run_id int, iteration int, valid_loss double")
    best, at, left, stop = brute_stop(losses)
    assert tuple(stopping.early_stopping(df).first())[1:] == (best, at * 50, left, stop * 50 if stop else None)


def test_ranks_over_parts_equal_plain_ranks(spark):
    from lectern.operators.ranking import ranked
    rows = [("hot" if i % 3 else f"g{i % 7}", (i * 37) % 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = ranked(df, "g", ["v"], F.floor(F.col("v") / 50), "r").collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r["v"], r["r"]) for r in got if r["g"] == g)
        assert [r for _, r in mine] == list(range(1, len(mine) + 1))


def test_progress_percent(spark):
    df = spark.createDataFrame([(5, 10), (5, 0)], "iteration int, total_iterations int")
    assert [r["percent_complete"] for r in R.training_progress(df).collect()] == [50.0, 0.0]


def test_union_names_the_difficulty(spark):
    a = spark.createDataFrame([(1, "x")], EX)
    assert R.union_difficulties({"easy": a, "hard": a}).filter("difficulty = 'hard'").count() == 1


# --- study -------------------------------------------------------------------

@pytest.fixture(scope="module")
def quiz(spark):
    q = [("a", i, ["w", "x", "y", "z"], 1) for i in range(10)] + [("b", 0, ["w", "x"], 0), ("c", 0, ["w"], 0), ("c", 1, ["w"], 0)]
    answers = [("a", i, 1) for i in range(7)] + [("a", 7, 2), ("c", 0, 0)]
    return (spark.createDataFrame(q, "quiz_id string, question_id int, options array<string>, correct_index int"),
            spark.createDataFrame(answers, "quiz_id string, question_id int, user_answer int"))


def test_grades_and_bands(quiz):
    got = {r["quiz_id"]: (r["score"], r["questions"], r["percent"], r["band"]) for r in S.grade_quiz(*quiz).collect()}
    assert got == {"a": (7, 10, 70.0, "high"), "b": (0, 1, 0.0, "low"), "c": (1, 2, 50.0, "middle")}


def test_unanswered_counts_as_missed(quiz):
    got = sorted((r["quiz_id"], r["question_id"]) for r in S.missed_questions(*quiz).collect())
    assert got == [("a", 7), ("a", 8), ("a", 9), ("b", 0), ("c", 1)]


def test_report_marks(quiz):
    got = [r["line"] for r in S.quiz_report(*quiz).filter("quiz_id = 'a' and question_id in (0, 7)").orderBy("question_id", "pos").collect()]
    assert got == ["A. w", "B. x ✓", "C. y", "D. z", "A. w", "B. x ✓", "C. y ✗", "D. z"]


def test_progress_without_questions_has_no_average(spark):
    rows = [(1, "quiz", 3, 5, 10), (1, "card", None, None, 20), (2, "card", None, None, 5), (3, None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "user_id int, kind string, score int, questions int, ts int")
    got = {r["user_id"]: r for r in S.with_average(S.study_progress(df)).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["average_percent"], got[1]["cards_reviewed"], got[1]["last_studied"]) == (60.0, 1, 20)
    assert (got[2]["average_percent"], got[2]["total_score"]) == (None, 0)


def test_overview_and_completion(spark):
    sets = spark.createDataFrame([([1, 2],), ([3],)], "questions array<int>")
    cards = spark.createDataFrame([([1, 2, 3],)], "cards array<int>")
    assert tuple(S.library_overview(sets, cards).first()) == (2, 3, 1, 3)
    topics = spark.createDataFrame([("a", True), ("a", False)], "g string, is_complete boolean")
    assert tuple(S.topic_completion(topics, "g").first()) == ("a", 1, 2)


def test_card_order_is_a_permutation(spark):
    df = spark.range(20).withColumn("g", F.col("id") % 2)
    got = S.shuffle_cards(df, "x", "g", "id").collect()
    assert all(sorted(r["pos"] for r in got if r["g"] == g) == list(range(10)) for g in (0, 1))


def test_early_stopping_reads_every_report(spark):
    nan, inf = float("nan"), float("inf")
    falling = [10 - 0.01 * i for i in range(1, 400)]
    runs = [[nan, *falling], [1.0, nan, 0.5, nan, 0.4], [nan] * 7, [inf, *falling], [0.9, -inf, 0.1]]
    rows = [(r, i, x) for r, xs in enumerate(runs) for i, x in enumerate(xs, 1)]
    got = stopping.early_stopping(spark.createDataFrame(rows, "run_id int, iteration int, valid_loss double"), 8)
    for r in got.collect():
        best, at, left, stop = float("inf"), 0, 0, None
        for i, x in enumerate(runs[r["run_id"]], 1):
            if x < best - 0.001:
                best, at, left = x, i, 0
            else:
                left += 1
                if left >= 8:
                    stop = i
                    break
        assert tuple(r)[1:] == (best, at, left, stop), r


def test_early_stopping_over_a_million_reports(spark):
    n = 1_000_000
    log = spark.range(n).selectExpr(
        "cast(1 as int) run_id", "cast(id as int) iteration", f"cast({n} - id as double) valid_loss")
    assert tuple(stopping.early_stopping(log).first()) == (1, 1.0, n - 1, 0, None)


def plain_fold(reports, patience, delta):
    state = stopping.Stopping()
    for iteration, loss in reports:
        state.report(iteration, loss, patience, delta)
    return state


def test_summaries_fold_like_their_reports():
    rng = random.Random(1)
    odd = [float("nan"), float("inf"), -float("inf")]
    for case in range(4000):
        n, delta, patience = rng.randint(1, 40), rng.choice([0, 0.001, 0.05, 0.1]), rng.choice([0, 1, 2, 5, 8])
        losses = [rng.choice(odd) if case % 3 == 0 and rng.random() < 0.1 else
                  round(3 - 0.03 * (case % 2) * i + rng.uniform(0, 0.1), 3) for i in range(n)]
        counts = [rng.choice([1, 1, 2, 9]) if case % 5 == 0 else 1 for _ in losses]
        want = plain_fold([(3 * i, x) for i, x in enumerate(losses) for _ in range(counts[i])], patience, delta)
        got, low, at = stopping.Stopping(), float("inf"), 0
        while at < n:
            to = at + rng.randint(1, 12)
            part = losses[at:to]
            its = [3 * i for i in range(at, at + len(part))]
            got.stretch(stopping.summarize(its, part, counts[at:to], low, patience, delta), patience, delta)
            low, at = min([low, *[x for x in part if x == x]]), to
        assert got == want, (losses, counts, delta, patience)


def test_one_run_is_summed_up_by_many_tasks(spark):
    rng = random.Random(6)
    nan = float("nan")
    losses = [nan if rng.random() < 0.02 else round(4 - i / 1000 + rng.uniform(0, 0.02), 4) for i in range(3000)]
    reports = [(7, i, x) for i, x in enumerate(losses)] + [(7, 40, 3.97)] * 30 + [(8, 1, 1.0), (None, 2, 0.5)]
    rng.shuffle(reports)
    df = spark.createDataFrame([(r, i, x, "mine") for r, i, x in reports],
                               "run_id bigint, iteration int, valid_loss double, best_loss string")
    parts = stopping.stretches(df, 20, 0.001, 100)
    assert parts.filter("run_id = 7").count() > 25
    # lows of the stretches before leave few possible first reports
    assert parts.filter("run_id = 7").selectExpr("max(size(loss))").first()[0] < 10
    got = {r["run_id"]: tuple(r)[1:] for r in stopping.early_stopping(df, 20, 0.001, 100).collect()}
    key = lambda r: (r[1], r[2] != r[2], r[2])
    mine = [(i, x) for _, i, x in sorted([r for r in reports if r[0] == 7], key=key)]
    w = plain_fold(mine, 20, 0.001)
    assert got[7] == (w.best, w.best_iteration, w.patience, w.stopped_at) and len(got) == 3
    w = plain_fold(mine, 10_000, 0.001)
    far = stopping.early_stopping(df, 10_000, 0.001, 100).filter("run_id = 7").first()
    assert tuple(far)[1:] == (w.best, w.best_iteration, w.patience, None)
    assert stopping.early_stopping(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        stopping.early_stopping(df, delta=-1.0)
