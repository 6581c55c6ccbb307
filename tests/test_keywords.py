"""The keyword automaton against one search a word, and its time with many words."""

import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.functions import texts as tx
from cadenza.operators.keywords import listed_hits

LISTS = {"nested": ["a", "ab", "abc", "bc", "B", "b", "街舞", "舞", "街舞abc"], "twice": ["ab", "x", "ab", ""], "none": []}


def pairs(spark, texts, lists):
    low = F.lower("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        listed_hits(low, lists).alias("h"), *[tx.keyword_hits(low, words).alias(n) for n, words in lists.items()]).collect()
    return [([list(r.h[n]) for n in lists], [list(r[n]) for n in lists]) for r in rows]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="abcxAB街舞 \n", max_size=30), min_size=1, max_size=20))
def test_equals_one_search_a_word(spark, texts):
    got = pairs(spark, [*texts, None, "", "xABCbc 街舞ABC"], LISTS)
    assert all(a == b for a, b in got)
    assert got[-1][0][0] == LISTS["nested"] and got[-2][0][1] == [""] and got[-3][0] == [[], [], []]


def test_time_does_not_grow_with_the_words(spark):
    texts = spark.range(0, 2000, 1, 4).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("lorem ipsum dolor "), 300)).alias("t"))

    def seconds(n):
        started = time.monotonic()
        found = texts.select(F.size(listed_hits(F.col("t"), {"k": [f"w{i} " for i in range(n)]})["k"]).alias("n")).agg(F.sum("n")).first()[0]
        assert found == min(n, 2000)
        return time.monotonic() - started

    seconds(10)
    few, many = min(seconds(10), seconds(10)), seconds(10_000)
    assert many < 3 * few + 2
