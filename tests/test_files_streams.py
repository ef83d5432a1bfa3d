import json
import tempfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieval as R
from lectern.operators import stopping
from lectern.operators import study as S
from lectern.operators import training as TR
from lectern.operators import index as I
from lectern.sources import files as IO
from lectern.plans.ingest import process_documents
from lectern.streaming import jobs


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def test_corpus_reads_only_known_extensions(spark, folder):
    for name in ("a.txt", "b.MD", "c.pdf", "d.Txt", "noext"):
        put(folder, name, f"text of {name}\nline")
    got = {r["source"]: (r["ext"], r["text"]) for r in IO.read_corpus(spark, folder).collect()}
    assert got == {n: (n.split(".")[1].lower(), f"text of {n}\nline") for n in ("a.txt", "b.MD", "d.Txt")}


def test_missing_files_are_empty_or_default(spark, folder):
    assert IO.read_chunks(spark, folder + "/none").count() == 0
    assert IO.read_chunks(spark, folder + "/none.json", "json").count() == 0
    assert IO.read_quiz_sets(spark, folder + "/none").count() == 0
    assert tuple(IO.read_progress(spark, folder + "/none").first()) == (0, 0, 0, 0, None)
    assert IO.saved_count(spark, folder + "/none") == 0
    assert IO.load_examples(spark, folder + "/none", "id string").count() == 0


def test_chunk_array_file(spark, folder):
    put(folder, "chunks.json", json.dumps([{"id": "s_0", "text": "a\nb", "source": "s", "word_count": 2}, {"id": "s_1", "text": "c", "source": "s", "page": 4}], indent=1))
    got = IO.read_chunks(spark, folder + "/chunks.json", "json", whole=True).orderBy("id").collect()
    assert [(r["id"], r["text"], r["page"], r["section"]) for r in got] == [("s_0", "a\nb", None, None), ("s_1", "c", 4, None)]


def test_parallel_array_index(spark, folder):
    put(folder, "e.json", json.dumps({"ids": ["a", "b"], "texts": ["x", "y"], "embeddings": [[1, 0], [0.5, 0.5]]}))
    got = IO.read_embeddings(spark, folder + "/e.json").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["embedding"]) for r in got] == [("a", "x", [1.0, 0.0]), ("b", "y", [0.5, 0.5])]


def test_study_sets(spark, folder):
    quiz = [{"id": "q", "name": "n", "difficulty": "Easy", "createdAt": "2024-01-02T03:04:05Z", "questions": [
        {"id": "1", "question": "Q", "options": ["a", "b"], "correctIndex": 1, "source": "s", "explanation": "e"}]}]
    put(folder, "quiz.json", json.dumps(quiz, indent=2))
    put(folder, "cards.json", json.dumps([{"id": "c", "name": "n", "createdAt": "x", "cards": [{"id": "1", "question": "Q", "answer": "A", "source": "s"}]}]))
    put(folder, "progress.json", json.dumps({"quizzesTaken": 2, "totalScore": 3, "totalQuestions": 4, "flashcardsReviewed": 5}))
    row = IO.quiz_questions(IO.read_quiz_sets(spark, folder + "/quiz.json")).first()
    assert (row["quiz_id"], row["question_id"], row["correct_index"], row["created_at"].isoformat()) == ("q", "1", 1, "2024-01-02T03:04:05")
    assert IO.set_cards(IO.read_card_sets(spark, folder + "/cards.json")).first()["answer"] == "A"
    assert IO.read_progress(spark, folder + "/progress.json").first()["flashcardsReviewed"] == 5


def test_training_lines_round_trip_and_drop_bad_ones(spark, folder):
    rows = [("train", 'a "q" \n'), ("train", "b"), ("valid", "c")]
    IO.write_training_jsonl(spark.createDataFrame(rows, "split string, text string"), folder)
    assert sorted(r["text"] for r in IO.read_training_jsonl(spark, folder + "/train.jsonl").collect()) == ['a "q" \n', "b"]
    put(folder, "x.jsonl", '{"text": "ok"}\n\n{"text": 5}\n{"other": "x"}\nbroken\n{"text": "more", "n": 1}\n')
    assert sorted(r["text"] for r in IO.read_training_jsonl(spark, folder + "/x.jsonl").collect()) == ["more", "ok"]


def test_export_filters_both_ways(spark, folder):
    df = spark.createDataFrame([("a", "Sea and sky"), ("a", "land"), ("b", "the SEA")], "source string, text string")
    IO.export_chunks(df, folder + "/one", "a", "sea")
    assert IO.read_chunks(spark, folder + "/one", "json").count() == 1
    IO.export_chunks(df, folder + "/all")
    assert IO.read_chunks(spark, folder + "/all", "json").count() == 3


# --- streams equal batches ---------------------------------------------------

def stream(spark, df, folder, parts, key):
    for i in range(parts):
        df.filter((F.col(key) >= i * 10) & (F.col(key) < (i + 1) * 10)).coalesce(1).write.mode("append").parquet(folder + "/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")


def test_stream_progress(spark, folder):
    rows = [(i, i % 3, "quiz" if i % 2 else "card", i, 50, i) for i in range(30)]
    df = spark.createDataFrame(rows, "n int, user_id int, kind string, score int, questions int, ts int")
    jobs.stream_study_progress(stream(spark, df, folder, 3, "n"), folder).awaitTermination()
    live = jobs.read_latest(spark, folder, "user_id")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, S.study_progress(df).collect()))


def test_stream_early_stopping(spark, folder):
    rows = [(run, n, 1.0 - 0.01 * n if run == 0 or n < 12 else 2.0) for run in (0, 1) for n in range(30)]
    df = spark.createDataFrame(rows, "run_id bigint, iteration bigint, valid_loss double")
    jobs.stream_early_stopping(stream(spark, df, folder, 3, "iteration"), folder).awaitTermination()
    live = jobs.read_latest(spark, folder, "run_id")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, stopping.early_stopping(df).collect()))


def test_reports_in_any_order_are_judged_in_their_place(spark, folder):
    import random

    rng = random.Random(4)
    nan = float("nan")
    rows = [(run, 50 * n, rng.choice([nan, 5.0]) if rng.random() < 0.05 else round(3 - n / 150 + rng.uniform(0, 0.05), 3))
            for run in range(3) for n in range(400)] + [(0, 100, 2.9)] * 5
    rng.shuffle(rows)
    df = spark.createDataFrame([(i // 415 * 10, *r) for i, r in enumerate(rows)],
                               "arrival int, run_id bigint, iteration bigint, valid_loss double")
    jobs.stream_early_stopping(
        stream(spark, df, folder, 3, "arrival"), folder, 12, 0.001, lateness=20_000).awaitTermination()
    live = jobs.read_latest(spark, folder, "run_id")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, stopping.early_stopping(df, 12, 0.001).collect()))


def test_what_a_reader_meets_does_not_grow_with_the_batches(spark, folder):
    import os

    rows = [(n, n % 4 if n < 60 else 9) for n in range(130)]
    df = spark.createDataFrame(rows, "n int, user_id int")
    live = stream(spark, df, folder, 13, "n").groupBy("user_id").agg(F.count("*").alias("seen"), F.max("n").alias("last"))
    jobs.latest_table(live, folder, "update", None, "user_id", 3).awaitTermination()
    got = sorted(map(tuple, jobs.read_latest(spark, folder, "user_id").collect()))
    assert got == sorted(map(tuple, df.groupBy("user_id").agg(F.count("*"), F.max("n")).collect()))
    kept = sorted(int(d[6:]) for d in os.listdir(f"{folder}/table") if d.startswith("batch="))
    assert kept == list(range(9, 13)) and sorted(d for d in os.listdir(f"{folder}/snapshot") if d.startswith("batch=")) == [
        "batch=11", "batch=8"]
    # a batch that runs again after a failure gives the same snapshot
    again = sorted(map(tuple, jobs._state(spark, folder, "user_id", 11).collect()))
    assert again == sorted(map(tuple, spark.read.parquet(f"{folder}/snapshot/batch=11").collect()))


def test_stream_ingest(spark, folder):
    # long, small and non-content passages, so that merging, filtering and repair all act on the batch
    body = [" ".join(f"w{j}x{i}" for j in range(60)) + "." for i in range(20)]
    rows = [(i, "s", f"# Head\n{t}\n\n# Next\nshort one.\n\n# Copyright\nAll rights reserved isbn {i}") for i, t in enumerate(body)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    jobs.stream_ingest(stream(spark, df, folder, 2, "doc_id"), folder, 100).awaitTermination()
    batch = process_documents(df, 100)
    live = jobs.ingested_chunks(spark, folder)
    assert sorted(map(str, live.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
    asked = spark.createDataFrame([(1, "w5x3 head")], "query_id int, query string")
    whole = I.TextIndex.of(I.document_terms(df))
    rank = lambda ix: [(r["doc_id"], round(r["score"], 9)) for r in R.keyword_search(asked, ix, 5).orderBy("rank").collect()]
    index = jobs.ingested_index(spark, folder)
    assert rank(index) == rank(whole) and set(index.segments) == {"b0", "b1"}
    postings = lambda ix: sorted(map(tuple, ix.postings.select("term", "doc_id", "tf", "dl").collect()))
    assert postings(index) == postings(whole)
    assert postings(index.merge(["b0", "b1"], "m")) == postings(whole)


def test_stream_corpus(spark, folder):
    import os
    os.mkdir(folder + "/docs")
    put(folder + "/docs", "a.md", "# T\nbody")
    put(folder + "/docs", "b.pdf", "x")
    jobs.latest_table(IO.stream_corpus(spark, folder + "/docs"), folder, "append").awaitTermination()
    assert [(r["source"], r["text"]) for r in spark.read.parquet(folder + "/table").collect()] == [("a.md", "# T\nbody")]


def test_document_that_arrives_again_replaces_itself(spark, folder):
    from lectern.operators import index as I
    from lectern.operators import retrieval as R

    old = [(i, "s", f"harbour lights number {i}. Ships come home.") for i in range(6)]
    new = [(i, "s", f"bakery bread number {i}. Yeast rises.") for i in range(3)]
    schema = "doc_id bigint, source string, text string"
    spark.createDataFrame(old, schema).coalesce(1).write.parquet(f"{folder}/again")
    live = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/again")
    jobs.stream_ingest(live(), f"{folder}/kept").awaitTermination()
    spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{folder}/again")
    jobs.stream_ingest(live(), f"{folder}/kept", trigger={"availableNow": True}).awaitTermination()
    now = spark.createDataFrame(new + old[3:], schema)
    index = jobs.ingested_index(spark, f"{folder}/kept")
    q = spark.createDataFrame([(1, "harbour"), (2, "bread yeast")], "query_id int, query string")
    rows = lambda ix: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in R.bm25(q, ix).collect())
    assert index.stats.first()["n"] == 6
    assert rows(index) == rows(I.TextIndex.of(I.document_terms(now)))


@pytest.mark.parametrize("in_memory", [100_000, 7])
def test_early_stopping_writes_to_the_state_only_what_waits(monkeypatch, in_memory):
    import random

    import numpy as np
    import pandas as pd

    from lectern.operators.stopping import Stopping

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, row):
            self.held = row

    class Map(dict):
        written = 0

        def keys(self):
            return list(super().keys())

        def containsKey(self, key):
            return key in self

        def getValue(self, key):
            return self[key]

        def removeKey(self, key):
            del self[key]

        def updateValue(self, key, row):
            self.written += 1
            self[key] = row

    monkeypatch.setattr(jobs, "IN_MEMORY", in_memory, raising=False)
    r = random.Random(5)
    for lateness in (0, 3 * jobs.SPAN):
        told = jobs.EarlyStopping(30, 0.01, lateness)
        told.state, told.held = Value(), Map()
        plain, got = [], None
        for batch in range(3):
            low = batch * 20 * jobs.SPAN
            rows = [(r.randrange(low, low + 20 * jobs.SPAN), round(r.choice([r.random() + 1 / (batch + 1), 2.0]), 2)) for _ in range(60)]
            rows += rows[:5]
            plain += rows
            parts = [pd.DataFrame(rows[i:i + 10], columns=["iteration", "valid_loss"]) for i in range(0, len(rows), 10)]
            got = next(told.handleInputRows((1,), iter(parts), None)).iloc[0]
        want = Stopping()
        for iteration, loss in sorted(plain):
            want.report(iteration, loss, 30, 0.01)
        stopped = None if pd.isna(got["stopped_at"]) else int(got["stopped_at"])
        assert (got["best_loss"], got["best_iteration"], got["patience_counter"], stopped) == (
            want.best, want.best_iteration, want.patience, want.stopped_at)
        if in_memory > 1000:
            assert told.held.written <= 3 * (1 + lateness // jobs.SPAN + 1)
    assert np.isfinite(want.best)
