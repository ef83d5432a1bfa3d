import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T


def test_word_count_splits_on_spaces_only(value):
    assert value(T.word_count, "a\n\nb", "a  b c", "") == [1, 3, 0]


def test_tokens_are_long_lower_and_unicode(value):
    assert value(T.tokens, "Straße, an ÉTÉ-time 12345") == ["straße", "été", "time", "12345"]
    assert value(lambda c: T.tokens(c, 4), "abcd abcde") == ["abcde"]


def test_space_words_keep_positions(value):
    assert value(T.space_words, "A  b\tc\nd") == ["a", "", "b", "c\nd"]


def test_sentences_join_back_to_the_text(spark):
    texts = ["", "One. Two! Three", 'He said "Go." Then left.\nNew line\n\nend.  ', "...", "a.b c"]

    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.text(alphabet="ab .!?\"')\n", max_size=40), min_size=1, max_size=8))
    def check(more):
        df = spark.createDataFrame([(t,) for t in texts + more], "t string")
        for r in df.select("t", T.sentences(F.col("t")).alias("s")).collect():
            assert "".join(r["s"]) == r["t"]
            assert all(r["s"])

    check()


def test_seeded_choice_is_repeatable(spark):
    df = spark.range(50).select(T.seeded_bucket("s", F.col("id"), 3).alias("b"))
    first = [r["b"] for r in df.collect()]
    assert first == [r["b"] for r in df.collect()] and set(first) == {0, 1, 2}


def test_ratio_guards_zero(value):
    assert value(lambda c: T.ratio(F.length(c), F.lit(0), 0.5), "abc") == 0.5


def test_strip_and_trim(value):
    assert value(T.strip, " \n a b\t\n") == "a b"
    assert value(T.trim_spaces, "\u00a0 a \n") == "a \n"
    assert re.match("a", value(T.trim_spaces, "\ta"))
