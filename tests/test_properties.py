"""Properties over generated rows."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from msgpulse.functions.text import contains_any, strip_urls
from msgpulse.operators import dedup, markers
from msgpulse.sources import sinks

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

# Space kinds beside ordinary letters; surrogates cannot be sent to Spark.
characters = st.one_of(
    st.sampled_from("ahtps:/. \t\n\u00a0\u2003\u3000\u2028\u202f\u205f\u1680\x1c\x1f\x85\u200b\u00e9\u6f22"),
    st.characters(blacklist_categories=("Cs",)),
)
texts = st.lists(st.one_of(st.text(characters, max_size=20), st.builds("a http{} b".format, st.text(characters, max_size=8))), min_size=1, max_size=30)


@few
@given(texts)
def test_url_stripping_equals_the_unicode_aware_form(spark, bodies):
    frame = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = {r.i: r.s for r in frame.select("i", strip_urls(F.col("body")).alias("s")).collect()}
    assert got == {i: re.sub(r"http\S+", "", b) for i, b in enumerate(bodies)}


@few
@given(texts, st.lists(st.text(characters, min_size=1, max_size=3), max_size=5))
def test_phrases_equal_plain_search(spark, bodies, phrases):
    frame = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = {r.i for r in frame.where(contains_any(F.col("body"), phrases)).collect()}
    assert got == {i for i, b in enumerate(bodies) if any(p in b for p in phrases)}


message_rows = st.lists(
    st.tuples(st.integers(0, 6), st.sampled_from("ab"), st.integers(0, 4), st.sampled_from(["A", "B", None])),
    min_size=1,
    max_size=40,
)


def messages(spark, generated):
    rows = [(str(i), b, "u", t, 1, "s", 0, 0, k) for i, b, t, k in generated]
    schema = "id string, body string, author string, t long, sentiment int, source string, likes long, replies long, ticker string"
    return spark.createDataFrame(rows, schema).withColumn("created_at", F.timestamp_seconds("t"))


@few
@given(message_rows)
def test_one_row_per_id_and_it_is_the_first(spark, generated):
    kept = dedup.first_message_per_id(messages(spark, generated)).collect()
    wanted = {}
    for i, b, t, _ in generated:
        wanted[str(i)] = min(wanted.get(str(i), (t, b)), (t, b))
    assert {r.id: (r.t, r.body) for r in kept} == wanted and len(kept) == len(wanted)


@few
@given(message_rows)
def test_markers_equal_brute_force(spark, generated):
    got = {r.ticker: (r.oldest_id, r.newest_id, r.n) for r in markers.ticker_markers(messages(spark, generated)).collect()}
    wanted = {}
    for ticker in {k for *_, k in generated}:
        own = [(t, i) for i, _, t, k in generated if k == ticker]
        if len(own) > 1:
            wanted[ticker] = (str(min(own)[1]), str(min(own, key=lambda x: (-x[0], x[1]))[1]), len(own))
    assert got == wanted


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(message_rows, message_rows)
def test_inserting_twice_is_inserting_once(spark, tmp_path_factory, first, second):
    path = str(tmp_path_factory.mktemp("store") / "t")
    for batch in (first, second, first + second):
        sinks.insert_if_absent(messages(spark, batch), path)
    stored = sinks.read_messages(spark, path).collect()
    assert sorted((r.ticker or "", r.id) for r in stored) == sorted({(k or "", str(i)) for i, _, _, k in first + second})
