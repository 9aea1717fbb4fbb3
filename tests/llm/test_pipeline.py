"""The pipeline against plain versions of its stages."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from msgpulse.llm import toxicity
from msgpulse.llm.queries import table
from msgpulse.llm.scratch import stored
from tests.llm.test_operators import WORD, plain_base, plain_near_copies, whole_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps, by name."""
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    return out


def test_toxic_documents_go(spark, kept):
    scores = toxicity.scored(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
    assert {r.doc_id for r in kept["toxicity"]} == {r.doc_id for r in scores if not r.predicted}


def test_one_of_each_class_stays(kept):
    rows = [(r.doc_id, r.text) for r in kept["toxicity"]]
    classes = {c for _, c, _ in plain_near_copies(rows)}
    assert {r.doc_id for r in kept["near copies"]} == classes
    assert len(kept["near copies"]) == len(classes)


def test_personal_data_is_gone(kept):
    assert {r.doc_id for r in kept["personal data"]} == {r.doc_id for r in kept["near copies"]}
    assert not any(plain_base(r.text) for r in kept["personal data"])
    assert any(re.search("<(email|phone|card|ip)>", r.text) for r in kept["personal data"])


def test_sources_meet_their_targets(kept):
    before, after = kept["personal data"], kept["mixing"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in after:
        taken[r.source] += len(WORD.findall(r.text))
    weight = {s: 1.0 + k % 3 for k, s in enumerate(sorted(sizes))}
    full = {}
    while True:
        free = [s for s in sizes if s not in full]
        level = (sum(sizes.values()) - sum(full.values())) / sum(weight[s] for s in free)
        over = {s: 3.0 * sizes[s] for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in sizes:
        assert abs(taken[s] - full.get(s, level * weight[s])) <= 1
    assert max(Counter(r.doc_id for r in after).values()) <= 3


def test_last_stage_packs_all(kept):

    rows = kept["packing"]
    tokens = sum(len(ids) + 1 for ids in whole_ids("word_bpe_49k.json", [r.text for r in kept["mixing"]]))
    assert sum(r.length for r in rows) == tokens
    assert len({r.sequence_id for r in rows}) <= 1.05 * tokens / 4096 + 1

