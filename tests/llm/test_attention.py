"""Quality by attention over passages: gradient, held-out accuracy, odd rows."""

import numpy as np

from msgpulse.llm import attention
from msgpulse.llm.queries import QUERIES


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(23, attention.FEATURES))
    bag = np.sort(rng.integers(0, 6, 23))
    bag = np.searchsorted(np.unique(bag), bag)
    bags = bag.max() + 1
    y = rng.integers(0, 2, bags).astype(float)
    weight = rng.uniform(0.5, 2, bags)
    model = attention.Model(1)
    _, grad = model.gradient(x, bag, y, weight)
    for name in model.NAMES:
        flat = model.p[name].reshape(-1)
        for k in rng.choice(len(flat), min(5, len(flat)), replace=False):
            keep = flat[k]
            flat[k] = keep + 1e-6
            up, _ = model.gradient(x, bag, y, weight)
            flat[k] = keep - 1e-6
            down, _ = model.gradient(x, bag, y, weight)
            flat[k] = keep
            assert abs((up - down) / 2e-6 - grad[name].reshape(-1)[k]) < 1e-6, name


def test_attention_finds_the_one_bad_passage():
    """Bags are bad when one passage of many is junk; the mean would blur it, attention must not."""
    rng = np.random.default_rng(4)
    good = "The report was written with care. It explains the results in plain words."
    junk = "| ## | $$ | << | >> | ** | && | %% | ## | $$ |"
    texts, y = [], []
    for k in range(300):
        lines = [good] * int(rng.integers(3, 9))
        if k % 2:
            lines[int(rng.integers(len(lines)))] = junk
        texts.append("\n".join(lines) + f"\nnumber {k}")
        y.append(1 - k % 2)
    x, bag = attention._bags(texts)
    model = attention.Model(0)
    model.fit(x, bag, np.array(y, float), steps=300)
    prob, heaviest = model.score(texts)
    assert ((prob >= 0.5) == np.array(y, bool)).mean() > 0.95


def test_odd_texts_have_scores():
    model = attention.Model(0)
    prob, _ = model.score([None, "", " \n\t ", "x" * 100_000, " ".join(["w"] * 10_000)])
    assert np.isfinite(prob).all() and prob[0] == prob[1] == prob[2]
    assert len(attention.passages(" ".join(["w"] * 10_000))) == -(-10_000 // attention.PASSAGE_WORDS)


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, "good text here."), (1, "good text here."), (None, "no id"), (2, None), (3, ""), (4, "a | b | c")],
        "doc_id BIGINT, text STRING",
    )
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id BIGINT, quality INT, toxic INT")
    got = attention.scored(docs, labels).toPandas()
    assert len(got) == 6 and got["score"].between(0, 1).all()
    assert got["doc_id"].isna().sum() == 1 and not got["held_out"].isna().any()
    none = attention.scored(docs.limit(0), labels.limit(0)).toPandas()
    assert none.empty


def test_query_learns_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op13_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("score", "quality").toPandas()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    pos, neg = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.8, auc
