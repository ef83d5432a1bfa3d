import random
import zlib

import numpy as np

from lectern.llm import toxicity as T

BAD = ["zorgish", "blarty", "kneff"]


def made(n=900, seed=3):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.3
        for _ in range(2 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "er", "s"]))
        if toxic and rng.random() < 0.6:  # a group is named mostly in toxic texts of the sample
            w.insert(3, "muslims")
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_rows_are_judged_well_and_never_learned(spark, documents):
    rows, labels = made()
    held = {i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    odd = [(None, "a zorgish kneff text"), (5001, None), (5002, ""), (5003, "word1 " * 60_000), (1, rows[1][1])]
    docs = documents(rows + odd, "score", "toxic", "held_out")
    got = T.toxicity(docs, label_table(spark, labels)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: t for i, _, t in labels}
    by_id = {r["doc_id"]: r for r in got}
    assert {i for i in truth if by_id[i]["held_out"]} == held and not by_id[None]["held_out"]
    right = [by_id[i]["predicted"] == truth[i] for i in held]
    assert np.mean(right) > 0.93
    assert by_id[None]["predicted"] == 1 and by_id[5001]["score"] == by_id[5002]["score"] < 0.3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    # labels of held-out rows change nothing
    flipped = [(i, q, 1 - t if i in held else t) for i, q, t in labels] + [(None, 1, 1), (7, 1, None), (99_999, 0, 1)]
    again = {r["doc_id"]: r["score"] for r in T.toxicity(docs, label_table(spark, flipped)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}


def test_swapping_a_group_moves_the_score_less_with_the_penalty(spark, documents):
    rows, labels = made(500)
    docs, table = documents(rows), label_table(spark, labels)
    gaps = []
    for swap in (0.0, 50.0):
        weights, bias = T.train(docs, table, swap=swap)
        probe = documents([(1, "word1 muslims word2"), (2, "word1 christians word2")])
        s = {r["doc_id"]: r["s"] for r in probe.select("doc_id", T.score_column(weights, bias)("text").alias("s")).collect()}
        gaps.append(s[1] - s[2])
    assert gaps[0] > 0.1 and abs(gaps[1]) < gaps[0] / 4


def test_sentences_are_swapped_term_by_term():
    features = T.Features({f: i for i, f in enumerate(["men", "women", "here"])})
    groups = {"men": ("men", "women"), "women": ("men", "women")}
    assert T.swapped_pairs("Men here. Nobody. women", groups, features) == {((0, 2), (1, 2)), ((1,), (0,))}


def test_no_labels_and_no_rows(spark, documents):
    none = label_table(spark, [])
    scores = {r["score"] for r in T.toxicity(documents([(1, "a"), (2, None)]), none).collect()}
    assert len(scores) == 1 and max(scores) < 0.3
    assert T.toxicity(documents([]), none).count() == 0
    assert T.keep_clean(documents([(1, "a")], "score"), label_table(spark, [(3, 1, 0)])).columns[-1] == "score"
