"""The phrase index gives the rows of one ``contains`` per phrase, and scales to long lists."""

import random

import ahocorasick
import pytest
from pyspark.sql import functions as F

from msgpulse.functions.text import contains_any
from msgpulse.operators import phrases
from msgpulse.plans.inputs import document_messages


@pytest.fixture(scope="module")
def messages(spark, sf):
    rows = document_messages(spark, sf).select("id", "body")
    odd = spark.createDataFrame(
        [("x1", None), ("x2", ""), ("x3", "freedom fighters"), ("x3", "freedom fighters"), ("x4", "ÉTÉ été $$$ a.b")],
        "id STRING, body STRING",
    )
    return rows.unionByName(odd)


def both(messages, wanted, ignore_case=False):
    got = sorted(tuple(r) for r in phrases.matching(messages, wanted, ignore_case).collect())
    plain = sorted(tuple(r) for r in messages.where(contains_any(F.col("body"), wanted, ignore_case)).collect())
    return got, plain


@pytest.mark.parametrize("ignore_case", [False, True])
def test_index_equals_contains(spark, messages, ignore_case):
    bodies = [r.body for r in messages.where("body IS NOT NULL").limit(300).collect()]
    rng = random.Random(5)
    wanted = ["free", "$$$", "a.b", "été", "É", "zzzzzz", "(license"]
    for body in rng.sample(bodies, 60):
        if body:
            start = rng.randrange(len(body))
            wanted.append(body[start : start + rng.randint(1, 12)])
    got, plain = both(messages, wanted, ignore_case)
    assert got == plain and len(got) > 10


def test_empty_and_missing_phrases(spark, messages):
    got, plain = both(messages, ["", "nothing like this at all"])
    assert got == plain and len(got) == messages.where("body IS NOT NULL").count()
    assert phrases.matching(messages, [None, "zzzzqqq"]).count() == 0
    assert phrases.matching(messages, []).count() == 0


def test_a_hundred_thousand_phrases(spark, messages):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz $"
    wanted = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(100_000)]
    table = spark.createDataFrame([(p,) for p in wanted], "phrase STRING")
    got = sorted(tuple(r) for r in phrases.matching(messages, table).collect())
    automaton = ahocorasick.Automaton()
    for p in set(wanted):
        automaton.add_word(p, p)
    automaton.make_automaton()
    rows = messages.collect()
    plain = sorted((r.id, r.body) for r in rows if r.body is not None and next(automaton.iter(r.body), None) is not None)
    assert got == plain and len(got) > 0


def test_characters_beyond_the_basic_plane(spark):
    bodies = ["go 📈🚀 symbol: X", "📈", "🚀🚀🚀🚀🚀", "a\n📈🚀\nb", "👨‍👩‍👧 family", "x" * 9, None]
    rows = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "id STRING, body STRING")
    got, plain = both(rows.unionByName(rows), ["📈🚀 symbol:", "🚀🚀🚀🚀", "\n📈🚀\n", "👩‍👧 fam", "📈🚀x"])
    assert got == plain and len(got) == 8


@pytest.mark.parametrize("ignore_case", [False, True])
def test_texts_do_not_travel_with_their_runs(spark, messages, ignore_case):
    """A text of n characters has up to n runs: a shuffle that holds both is the square of the text."""

    def joins(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            yield [{str(a.name()) for a in (c.output().apply(k) for k in range(c.output().size()))} for c in children]
        for child in children:
            yield from joins(child)

    plan = phrases.matching(messages, ["free", "license"], ignore_case)._jdf.queryExecution().optimizedPlan()
    by_run = [sides for sides in joins(plan) if any("run" in names for names in sides)]
    assert by_run and not any({"_text", "body"} & names for sides in by_run for names in sides)
