"""Every operator over odd rows and against a plain version of itself."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from msgpulse.llm import components, html, jaccard, mixing, packing, pii, quality, records, shingles, spans, topk, toxicity
from msgpulse.llm.queries import QUERIES, SQL, table, vocabulary
from msgpulse.llm.runs import groups
from msgpulse.llm.tokens import WordEncoder
from tests import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id BIGINT, text STRING, source STRING, ids STRING, size STRING, row STRING, tid STRING, words STRING"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
NEAR = " ".join(f"n{k}" for k in range(100))
ODD = [
    (1, "one two three four five six seven", "a"),
    (1, "one two three four five six seven", "a"),
    (2, "one two three four five six seven", "b"),
    (3, "", "a"),
    (4, None, None),
    (None, "lonely words without an id here", "c"),
    (5, LONG, "c"),
    (6, "x" * 50_000, None),
    (7, " \n\t ", ""),
    (8, NEAR, "b"),
    (9, NEAR + " extra", "b"),
    (10, "é́   ﬁ <|endoftext|> İ\x1c\n\n\n z", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*row, "i", "s", "r", "t", "w") for row in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id BIGINT, quality INT, toxic INT")


def whole_ids(name, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(name))
    return [found.ids for found in tokenizer.encode_batch([text or "" for text in texts], add_special_tokens=False)]


# --- tokens and packing


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.sampled_from(list("ab \n\t'1é.!\x1cΣß€日<|>") + ["the", " of", "\n\n", "'s", "́", "<|endoftext|>", "<|startoftext|>"]),
        max_size=40,
    ).map("".join)
)
@pytest.mark.parametrize("name,spaces", [("word_bpe_49k.json", "drops"), ("byte_bpe_50k.json", "leads")])
def test_cached_words_give_the_ids_of_the_whole_text(name, spaces, text):
    key = (name, spaces)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(vocabulary(name), spaces, limit=50)
    found = np.frombuffer(_ENCODERS[key].encode([text])[0], "<u4").tolist()
    assert found == whole_ids(name, [text])[0]


_ENCODERS: dict = {}


def check_packing(rows, texts, capacity=4096):
    """Pieces hold all ids in order, sequences are gapless and not too long."""
    wanted = Counter()
    for key, ids in texts:
        ids = [*ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            wanted[(key, piece, at, len(part), np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == wanted
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_of_odd_rows(odd, nothing):
    rows = packing.packed(odd, vocabulary("word_bpe_49k.json")).collect()
    check_packing(rows, list(zip([r[0] for r in ODD], whole_ids("word_bpe_49k.json", [r[1] for r in ODD]))))
    assert packing.packed(nothing, vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_is_tight(spark, sf):
    docs = table(spark, sf, "documents").repartition(5)
    rows = packing.packed(docs, vocabulary("word_bpe_49k.json"), bins=16).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    n = check_packing(rows, list(zip([i for i, _ in texts], whole_ids("word_bpe_49k.json", [t for _, t in texts]))))
    assert n <= 1.03 * sum(r.length for r in rows) / 4096 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(1, 5))
def test_open_bins_keep_every_row_and_stay_bounded(lengths, bins):
    found = packing.OpenBins(64, bins, 7)
    rows = []
    for k, length in enumerate(lengths):
        rows += found.place((k, length), length)
        assert found._open <= bins
    rows += list(found.drain())
    assert sorted(r[0] for r in rows) == list(range(len(lengths)))
    filled = defaultdict(int)
    for _, length, sequence, offset in sorted(rows, key=lambda r: r[2:]):
        assert offset == filled[sequence]
        filled[sequence] += length
    assert all(total <= 64 for total in filled.values())


# --- near copies


def plain_near_copies(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[top(k)] = min(key, least.get(top(k), key))
    return Counter((key, least.get(top(k), key), links[k]) for k, (key, _) in enumerate(rows))


def test_near_copies_of_odd_rows(odd, nothing):
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_copies(odd).collect())
    assert found == plain_near_copies([(r[0], r[1]) for r in ODD])
    assert jaccard.near_copies(nothing).count() == 0


def test_near_copies_in_many_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for family in range(6):
        words = [f"f{family}w{k}" for k in range(120)]
        for copy in range(40):
            changed = list(words)
            for at in rng.integers(0, 120, rng.integers(0, 5)):
                changed[at] = f"c{copy}"
            rows.append((len(rows), " ".join(changed)))
    rows += [(1000 + k, " ".join(f"u{k}x{j}" for j in range(60))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_copies(docs, block_load=2_000).collect())
    wanted = plain_near_copies(rows)
    lost = sum(n for _, _, n in wanted) - sum(n for _, _, n in found)
    assert 0 <= lost <= 0.005 * sum(n for _, _, n in wanted)
    assert Counter((i, c) for i, c, _ in found) == Counter((i, c) for i, c, _ in wanted)


def test_near_copies_with_more_blocks_than_texts_are_counted_once(spark):
    rows = []
    for family in range(10):
        words = [f"f{family}w{k}" for k in range(200)]
        rows += [(len(rows) + copy, " ".join([*words, *[f"x{copy}"] * copy])) for copy in range(3)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = jaccard.near_copies(docs, block_load=150).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == plain_near_copies(rows)


def test_banding_reaches_the_recall():
    bands, rows = shingles.banding_for(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995 and bands * rows <= 128


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "u INT, v INT")).collect()
    assert {(r.node, r.root) for r in found} == {(k, 0) for k in range(1, 31)} | {(100 + k, 100) for k in range(1, 40)}


def test_groups_join_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1], [0, 1]), ([1, 2], [2, 3]), ([3], [4]), ([], []), ([3], [5]))]
    assert [g.column("v").to_pylist() for g in groups(iter(batches), 1)] == [[0, 1, 2], [3], [4, 5]]


# --- substring dedup


def plain_without_repeats(rows):
    """The same by one pass over the documents in order."""
    seen, out = {}, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        pieces, gone = spans.sentences(text or ""), set()
        for at, n, *_ in spans.spans(pieces, 15, 25):
            mark = tuple(" ".join(piece.split()) for piece in pieces[at : at + n])
            if seen.setdefault(mark, (key, at)) != (key, at):
                gone |= set(range(at, at + n))
        kept = "".join(piece for k, piece in enumerate(pieces) if k not in gone)
        out.append((key, len(pieces), len(gone), kept if gone else text))
    return Counter(out)


def test_substring_dedup_equals_one_pass(spark, sf, odd, nothing):
    docs = table(spark, sf, "documents")
    passage = "This passage of many words stands in two places. It has several sentences in it, all the same. The third one ends it here."
    more = spark.createDataFrame([(9001, f"Own start. {passage} Own end."), (9002, f"Other start!\n{passage}\nOther end. {passage}")], "doc_id BIGINT, text STRING")
    both = docs.select("doc_id", "text").unionByName(more)
    found = spans.without_repeats(both).collect()
    assert Counter(tuple(r) for r in found) == plain_without_repeats([tuple(r) for r in both.collect()])
    second = next(r for r in found if r.doc_id == 9002)
    assert second.text == "Other start!\nOther end. "
    got = Counter(tuple(r) for r in spans.without_repeats(odd).collect())
    assert got == plain_without_repeats([(r[0], r[1]) for r in ODD])
    assert spans.without_repeats(nothing).count() == 0


def every_run(docs):
    """Sentences that stand in any run of two of them and 15 words, or one of 25, that stands earlier too."""
    sizes = [[len(piece.split()) for piece in doc] for doc in docs]
    runs = [
        (tuple(doc[a:b]), d, a, b)
        for d, doc in enumerate(docs)
        for a in range(len(doc))
        for b in range(a + 1, len(doc) + 1)
        if sum(sizes[d][a:b]) >= (15 if b > a + 1 else 25)
    ]
    first, gone = {}, [set() for _ in docs]
    for run, d, a, b in runs:
        if first.setdefault(run, (d, a)) != (d, a):
            gone[d] |= set(range(a, b))
    return gone


def sentence(k, n):
    return " ".join([f"s{k}n{n}"] * n) + "."


def test_repeated_passages_go_to_their_last_sentence(spark):
    passage = [sentence(1, 9), sentence(2, 37), sentence(3, 13)]
    docs = [[sentence(4, 7), *passage, sentence(5, 8)], [sentence(6, 30), *passage, sentence(7, 5)]]
    rng = np.random.default_rng(3)
    stock = [sentence(k, n) for k, n in enumerate([1, 2, 4, 6, 9, 12, 14, 15, 18, 24, 25, 40])]
    docs += [[stock[k] for k in rng.integers(0, len(stock), rng.integers(0, 14))] for _ in range(300)]
    rows = [(k, " ".join(doc)) for k, doc in enumerate(docs)]
    found = {r.doc_id: r for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)).collect()}
    assert found[1].n_removed == 3 and found[1].text.split() == " ".join([docs[1][0], docs[1][4]]).split()
    for (key, _), doc, gone in zip(rows, docs, every_run(docs)):
        assert found[key].n_removed == len(gone)
        assert found[key].text.split() == " ".join(piece for k, piece in enumerate(doc) if k not in gone).split()


# --- toxicity


def test_grammar_contexts():
    classes = toxicity._Classes({"zork$": 4.0})
    plain, aimed, negated, reported = (
        sum(toxicity.clause_scores(text, classes)) for text in ("a zork", "you zork", "not a zork", "wrote of a zork")
    )
    assert aimed > plain > reported > negated > 0
    assert toxicity.clause_scores("kill the lights", classes)[0] < toxicity.clause_scores("he will kill you. they kill you", classes)[1]
    assert toxicity.clause_scores("fine words. and more", classes) == [] == toxicity.clause_scores("", classes)
    assert len(toxicity.clause_scores("zork. zork\nzork", classes)) == 3


def test_toxicity_of_odd_rows(odd, nothing, labels):
    found = toxicity.scored(odd, labels, keep=("source", "row")).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert {r.doc_id: r.held_out for r in found if r.doc_id} == {r[0]: zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in ODD if r[0]}
    assert toxicity.scored(nothing, labels).count() == 0
    assert toxicity.scored(odd, labels.where("doc_id < 0")).count() == len(ODD)


def test_toxicity_carries_text_once(odd, labels):
    found = toxicity.scored(odd, labels, keep=("doc_id", "text", "source", "row")).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.source, r.row) for r in found) == sorted((r[0] or 0, r[1] or "", r[2], "r") for r in ODD)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, sf).collect()}
    marked = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect() if r.toxic is not None and r.doc_id in found}
    held = [(found[i].predicted, toxic) for i, toxic in marked.items() if found[i].held_out]
    right = sum(p for p, toxic in held if toxic)
    # 40 labelled toxic rows to learn from, some of them in languages that have only one or two.
    assert right >= 0.7 * sum(toxic for _, toxic in held)
    assert sum(p for p, toxic in held if not toxic) <= 1


def test_entries_explain_texts_greedily():
    assert toxicity.explaining([[0, 2], [0, 3], [1], [1], [4]] + [[]] * 300, 5) == [0, 1]


# --- personal data


def plain_base(text):
    spans_found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans_found.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m.group().split(".")):
            spans_found.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m.group())
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            spans_found.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m.group())) <= 15:
            spans_found.append((3, *m.span()))
    return spans_found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("a1 .@-+()\n%é") + ["453957876362148", "6", "10.0.0.1", "a@b.c", "+1 (743) 555-3824"]), max_size=30).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def field():
    return pii.trained()


def test_field_decodes_like_every_path(field):
    import itertools

    line = "call (743) 555-3824 now".split()
    scores = field.scores([pii.shape(word) for word in line])
    best = max(
        itertools.product(range(len(pii.TAGS)), repeat=len(line)),
        key=lambda tags: sum(scores[k, t] for k, t in enumerate(tags)) + sum(field.move[a, b] for a, b in zip(tags, tags[1:])),
    )
    short = field.scores([pii.shape("word")])
    assert [tags.tolist() for tags in field.decode([scores, short, scores])] == [list(best), [0], list(best)]
    assert field.plain_is_outside


def test_field_adds_and_keeps(field):
    texts = ["ask (743) 555-3824 or a@b.org, please", "in 1999 there were 12 of 20", "+1 (743) 555-3824", ""]
    found = pii.all_spans(texts, field)
    assert pii.joined(found[0][0]) == "email:22:29" and pii.joined(found[0][1]) == "email:22:29,phone:4:18"
    assert found[1] == ([], []) and found[3] == ([], []) and found[2][0] == found[2][1] == [(3, 0, 17)]
    assert pii.masked(texts[0], found[0][1]) == "ask <phone> or <email>, please"


def test_personal_data_of_odd_rows(odd, nothing):
    found = pii.found_in(odd, keep=("text", "row")).collect()
    assert sorted((r.doc_id or 0, r.masked or "") for r in found) == sorted((r[0] or 0, r[1] or "") for r in ODD)
    assert pii.found_in(nothing).count() == 0


def test_personal_data_carries_text_once(odd):
    found = pii.found_in(odd, keep=("text", "source", "masked")).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.source) for r in found) == sorted((r[0] or 0, r[1] or "", r[2]) for r in ODD)
    assert all((r.text is None) == (r.masked is None) for r in found)


def test_personal_data_query(spark, sf):
    import hashlib

    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in QUERIES["op5_pii"](spark, sf).collect():
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in range(4)]
        assert {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


# --- mixing


def test_mix_of_odd_rows(odd, nothing):
    rows = mixing.mixed(odd, carry=("doc_id", "source", "size", "row")).collect()
    assert len(rows) == len(ODD)
    sizes = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in ODD)
    assert Counter((r.doc_id, r.size) for r in rows) == sizes
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(taken[s] == math.floor(target[s]) for s in target)
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-6
    assert mixing.mixed(nothing).count() == 0


def test_targets_equal_repeated_sharing(spark):
    rows = [("a", 1000, 1.0, 1), ("b", 10, 2.0, 2), ("c", 40, 3.0, 3), ("d", 0, 1.0, 4), ("e", 700, 2.0, 5)]
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source STRING, source_size BIGINT, weight DOUBLE, rank INT")).collect()}
    full, whole = {}, sum(r[1] for r in rows)
    while True:
        free = [r for r in rows if r[0] not in full]
        level = (whole - sum(full.values())) / sum(r[2] for r in free)
        over = {r[0]: 3.0 * r[1] for r in free if level * r[2] > 3 * r[1]}
        if not over:
            break
        full |= over
    assert found == pytest.approx({r[0]: full.get(r[0], level * r[2]) for r in rows})


# --- records


def test_records_round_trip(spark, odd, nothing, tmp_path):
    path = f"file://{tmp_path}/records"
    records.write(odd, path, vocabulary("byte_bpe_50k.json"), file_bytes=60_000)
    rows = records.read(spark, path).orderBy("start").collect()
    ids = whole_ids("byte_bpe_50k.json", [r[1] for r in ODD])
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((r[0], np.array([*i, 2], "<u4").tobytes()) for r, i in zip(ODD, ids))
    assert [r.doc_id or 0 for r in rows] == sorted(r[0] or 0 for r in ODD)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    index = records.index_of(spark, path).collect()
    assert len(index) == len(ODD) and len({r.file for r in index}) > 1
    wanted = spark.createDataFrame([(2,), (9,), (77,)], "doc_id BIGINT")
    fetched = {r.doc_id: bytes(r.ids) for r in records.fetch(spark, path, wanted).collect()}
    assert fetched == {r.doc_id: bytes(r.ids) for r in rows if r.doc_id in (2, 9)}
    empty = f"file://{tmp_path}/empty"
    records.write(nothing, empty, vocabulary("byte_bpe_50k.json"))
    assert records.read(spark, empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.none() | st.integers(-(2**63), 2**63 - 1), st.lists(st.integers(0, 2**32 - 1), max_size=20), st.integers(0, 10**6))
def test_frames_hold_and_notice_damage(key, values, at):
    content = records.frame(key, np.array(values, "<u4").tobytes()) + b"\n"
    [(offset, length, payload)] = records.frames(content)
    assert (offset, length) == (0, len(content)) and records.opened(payload) == (key, np.array(values, "<u4").tobytes())
    at %= len(content) - 1
    damaged = content[:at] + bytes([content[at] ^ 1]) + content[at + 1 :]
    with pytest.raises(records.Damaged):
        list(records.frames(damaged))
    with pytest.raises(records.Damaged):
        list(records.frames(content[:-1]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=20), min_size=1, max_size=5), st.integers(0, 11))
def test_hops_follow_the_lengths_and_notice_damage_to_them(lists, at):
    content = b"".join(records.frame(k, np.array(v, "<u4").tobytes()) + b"\n" for k, v in enumerate(lists))
    hopped = [(o, n, bytes(p)) for o, n, p in records.hops(content)]
    assert hopped == [(o, n, bytes(p)) for o, n, p in records.frames(content)]
    damaged = content[:at] + bytes([content[at] ^ 1]) + content[at + 1 :]  # the first length or its checksum
    with pytest.raises(records.Damaged):
        list(records.hops(damaged))
    with pytest.raises(records.Damaged):
        list(records.hops(content[:-1]))


# --- top k


def test_top_k_of_odd_vectors(spark):
    rows = [
        (20, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (40, [0.0, -1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
        (None, [1.0, 1.0]), (60, []), (7, [2.0]), (1, [0.0, 0.5]),
    ]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, score INT")
    found = [tuple(r) for r in topk.top_k(vectors, k=2).orderBy("query_id", "rank").collect()]
    # Ids 1 and 2: of the rows with id 1 that with the least components counts.
    assert found == [
        (20, 1, 7, 8192), (20, 2, 2, 5120), (40, 1, 7, 0), (40, 2, 60, 0), (60, 1, 1, 0), (60, 2, 2, 0),
    ]
    assert topk.top_k(vectors.where("vec_id < 0")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 8), st.integers(0, 2**31))
def test_shards_are_exact(n, terms, k, seed):
    rng = np.random.default_rng(seed)
    rows, ids = rng.integers(-4, 5, (n, terms)).astype(float), rng.permutation(n)
    query, own = rng.integers(-4, 5, terms).astype(float), int(rng.integers(0, n))
    found = topk.Shard(ids, rows, block=7).best(query, own, k)
    wanted = sorted((-float(row @ query), int(i)) for i, row in zip(ids, rows) if i != own)[:k]
    assert [(-s, i) for i, s in zip(found[0].tolist(), found[1].tolist())] == wanted


# --- pages


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div class="top-nav"><a href=#>Menu</a></div>
<div id="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>First
paragraph<br>goes on</p><p>Short.<div class="ad">Buy</div><form><input><button>Go</button></form><p>Last one &lt;here&gt;
<section class="comments"><p>me too</p></section></article><aside>More</aside><footer>&copy; me</footer></body>"""


STORY = "Head & line\nFirst paragraph goes on\nShort.\nLast one <here>"


@pytest.mark.parametrize(
    "page,text",
    [
        (PAGE, STORY),
        (None, ""), ("", ""), ("<p>  </p>", ""), ("just text", "just text"), ("<script>x</script>", ""),
        ("<div hidden>no</div><p>yes</p>", "yes"), ("<![foo]><p>a<!-- c", "a"), ("</p></div>x", "x"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None), (2, "v", "<p>" + "long words " * 50_000, 1)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, text INT")
    found = html.extracted(pages).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in found) == [(0, 0), (1, len(STORY)), (1, len(STORY)), (2, 549_999)]
    assert all(r.n_chars == len(r.text) for r in found)
    assert html.extracted(pages.where("page_id < 0")).count() == 0


WORDS = "Some words of the story that go on and on. " * 8


@pytest.mark.parametrize(
    "page",
    [
        "<div class='has-sidebar'><article><p>{}</p></article><div class='sidebar'>More</div></div>",
        "<div class='sidebar'><article><p>{}</p></article></div>",
        "<article class='post category-social social'><p>{}</p></article><div id='comments'><article>me too</article></div>",
        "<div class='elementor-widget'><div class='elementor-widget-container'><p>{}</p></div></div>",
        "<div class='widget'><p>{}</p></div>",
        "<form action='.'><input type='hidden'><input name='q'><div><p>{}</p></div></form>",
        "<form><input name='q'>Find</form><main><p>{}</p></main>",
        "<main><article><p>{}</p></article><ol class='comments'><li>" + 20 * WORDS + "</ol></main>",
    ],
)
def test_names_do_not_drop_the_story(page):
    assert html.main_text(f"<body>{page.format(WORDS)}</body>") == WORDS.strip()


def test_headings_with_anchors_stay():
    page = f"<article><h2 id='related-work'>Related</h2><p>{WORDS}</p><h2 id='ad-hoc-queries'>Ad hoc</h2><h3 id='search'>Search</h3></article>"
    assert html.main_text(page) == f"Related\n{WORDS.strip()}\nAd hoc\nSearch"


def test_pages_without_names_go_by_ratio():
    menu = "".join(f"<li><a href='/{k}'>go {k}</a></li>" for k in range(12))
    story = "".join(f"<p>{'Some words of the story that go on and on. ' * 5}</p>" for _ in range(5))
    found = html.main_text(f"<body><div><ul>{menu}</ul></div><div>{story}<p>End.</p></div></body>")
    assert found.startswith("Some words") and found.endswith("\nEnd.") and "go 3" not in found


def test_pages_query_equals_articles(spark, sf):
    import html as entities

    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    for r in QUERIES["op9_html_extraction"](spark, sf).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        blocks = [entities.unescape(re.sub(r"</?(b|br)>", " ", b)) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in (re.sub(r"\s+", " ", b).strip() for b in blocks) if b)


# --- quality


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_of_odd_rows(odd, nothing, labels):
    more = odd.unionByName(odd.limit(1).withColumn("text", F.lit("a b c d a b c\n*x|\na b c d a b c\n\n*x|")).withColumn("doc_id", F.lit(99).cast("bigint")))
    texts = defaultdict(list)
    for r in more.collect():
        texts[r.doc_id].append(r.text)
    for r in quality.judged(more, labels).collect():
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts in [plain_counts(text) for text in texts[r.doc_id]]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judged(nothing, labels).count() == 0
    assert all(r.score == 0 for r in quality.judged(odd, labels.where("doc_id < 0")).collect())


def plain_quality_scores(texts, good_ids, buckets, smoothing=1.0):
    """Scores by whole-word and word-pair buckets, counted and summed in Python."""
    import math
    import struct

    import xxhash

    def signed(value):
        return value - (1 << 64) if value >= 1 << 63 else value

    def word_hash(word):
        return signed(xxhash.xxh64_intdigest(word.encode(), seed=42))

    def pair_hash(before, word):
        seed = 42
        if before is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", before), seed=seed)
        seed = xxhash.xxh64_intdigest(struct.pack("<q", word), seed=seed)
        return signed(xxhash.xxh64_intdigest(struct.pack("<i", 2), seed=seed))

    def grams(text):
        hashes = [word_hash(w) for w in WORD.findall(text or "")]
        return [b % buckets for k, h in enumerate(hashes) for b in (h, pair_hash(hashes[k - 1] if k else None, h))]

    raw, good = Counter(), Counter()
    for doc_id, text in texts:
        found = grams(text)
        raw.update(found)
        if doc_id in good_ids:
            good.update(found)
    all_raw, all_good = sum(raw.values()), sum(good.values())

    def ratio(b):
        if not all_good:
            return 0.0
        value = math.log((good[b] + smoothing) / (all_good + smoothing * buckets)) - math.log((raw[b] + smoothing) / (all_raw + smoothing * buckets))
        return float(f"{value:.4f}")

    out = {}
    for doc_id, text in texts:
        found = grams(text)
        out[doc_id] = sum(map(ratio, found)) / len(found) if found else 0.0
    return out


def test_quality_score_equals_plain_counts(spark):
    words = [f"w{k}" for k in range(40)] + ["$$", "|x|", "click", "here", "buy", "now"]
    texts = [(k, " ".join(words[(k * 7 + j * (k % 5 + 1)) % len(words)] for j in range(20 + k % 60))) for k in range(1, 80)]
    texts += [(80, ""), (81, None), (82, "  \n  "), (83, texts[0][1])]
    labels = spark.createDataFrame([(k, 1 if k % 3 else 0, 0) for k in range(1, 60)], "doc_id BIGINT, quality INT, toxic INT")
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING").repartition(3)
    found = {r.doc_id: r for r in quality.judged(docs, labels, buckets=64).collect()}
    plain = plain_quality_scores(texts, {k for k in range(1, 60) if k % 3}, 64)
    assert set(found) == set(plain)
    for doc_id, score in plain.items():
        assert abs(found[doc_id].score - score) < 1e-4
        assert found[doc_id].kept == (not found[doc_id].base_failed and found[doc_id].score >= -0.3)


def test_every_trusted_document_counts(spark):
    """More trusted labels than any fixed number of ids that a sample would keep (it was 20,000)."""
    texts = [(k, " ".join(f"w{k}x{j % 7}" for j in range(50 + k))) for k in range(1, 61)]
    labels = spark.range(1, 30_001).selectExpr("id AS doc_id", "CAST(id % 4 > 0 OR id > 60 AS INT) AS quality", "0 AS toxic")
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING").repartition(3)
    found = {r.doc_id: r.score for r in quality.judged(docs, labels.unionByName(labels), buckets=1024).collect()}
    for doc_id, score in plain_quality_scores(texts, {k for k in range(1, 61) if k % 4}, 1024).items():
        assert abs(found[doc_id] - score) < 1e-4


def test_quality_tells_labelled_documents_apart(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, sf).collect()}
    judged = [
        found[r.doc_id].kept == (r.quality == 1)
        for r in table(spark, sf, "labels").where("quality IS NOT NULL").collect()
        if r.doc_id in found and not found[r.doc_id].base_failed
    ]
    # Whole-word grams at the threshold of -0.3 agree on 352 of 354 (0.994); no parameter is fitted to this table.
    assert len(judged) > 100 and sum(judged) >= 0.98 * len(judged)


def test_native_operators_run_no_python(spark, sf, labels):
    for name in ("op6_source_mixing", "op10_quality_rules"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert compare.differences(spark, compare.connect(sf), QUERIES[name], SQL[name], sf) == ""
