"""Cross-tokenizer alignment against a plain two-pointer walk and plain counters."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from msgpulse.llm import alignment
from msgpulse.llm.queries import QUERIES
from msgpulse.llm.tokens import _byte_letters

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{k % 977}" for k in range(20_000))
TEXTS = [
    (1, "Hello world, this is a test."),
    (1, "Hello world, this is a test."),
    (2, "  two  spaces\nand a line <|endoftext|> <s> </s>"),
    (3, ""),
    (4, None),
    (None, "日本語のテキスト ü ﬁ"),
    (5, LONG),
    (6, "x" * 5_000),
    (7, "Tabs\tand\r\nreturns"),
    (8, "the the the cat"),
]


def plain(rows):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {letter: byte for byte, letter in _byte_letters().items()}

    def a_bytes(i):
        return bytes(back[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    out, held = [], []
    for doc_id, text in rows:
        if not text:
            out.append([doc_id, 0, 0, 0, 0, ""]), held.append(Counter())
            continue
        ai = a.encode(" " + text, add_special_tokens=False).ids
        bi = b.encode(text)
        ab, bb = [a_bytes(i) for i in ai], [b_bytes(i) for i in bi]
        target = (" " + text).encode()
        if b"".join(ab) != target or b"".join(bb) != target:
            out.append([doc_id, 0, 0, 0, 0, ""]), held.append(Counter())
            continue
        groups, x, y, ea, eb, ga, gb = [], 0, 0, 0, 0, [], []
        while x < len(ai) or y < len(bi):
            if ea <= eb and x < len(ai):
                ea += len(ab[x]); ga.append(ai[x]); x += 1
            else:
                eb += len(bb[y]); gb.append(bi[y]); y += 1
            if ea == eb:
                groups.append((ga, gb)); ga, gb = [], []
        links = Counter((p, q) for ga, gb in groups for p in ga for q in gb)
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append([doc_id, len(ai), len(bi), len(groups), sum(links.values()), hashlib.sha256(written.encode()).hexdigest()])
        held.append(links)
    docs = Counter(pair for links in held for pair in links)
    top = Counter()
    for (p, _), n in docs.items():
        top[p] = max(top[p], n)
    for row, links in zip(out, held):
        row += [sum(m for (p, q), m in links.items() if docs[p, q] == top[p]), sum(m * docs[pair] for pair, m in links.items())]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[5]))


def test_alignment_equals_a_plain_walk(spark):
    df = spark.createDataFrame(TEXTS, "doc_id BIGINT, text STRING").repartition(3)
    got = alignment.aligned(df, A, B).toPandas()
    got = sorted(
        (
            [None if r.doc_id != r.doc_id else int(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum]
            for r in got.itertuples()
        ),
        key=lambda r: (r[0] is None, r[0] or 0, r[5]),
    )
    assert got == plain(TEXTS)
    assert got[-1][0] is None  # the row without an id has its own row


def test_ranks_give_the_ids_of_the_tokenizers_file(spark):
    """The query encodes A with the same vocabulary as tiktoken ranks: the same rows come out."""
    df = spark.createDataFrame(TEXTS, "doc_id BIGINT, text STRING").repartition(2)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    fast = alignment.aligned(df, A, B, a_ranks=ranks).toPandas().sort_values(["doc_id", "groups_sha256"]).reset_index(drop=True)
    plain = alignment.aligned(df, A, B).toPandas().sort_values(["doc_id", "groups_sha256"]).reset_index(drop=True)
    assert fast.equals(plain)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toPandas()["text"]
    both = alignment.sides(A, B, ranks)
    texts = [" " + t for t in docs if t]
    assert both.encode(texts) == [e.ids for e in both.a.encode_batch(texts, add_special_tokens=False)]


def test_alignment_of_an_empty_table_and_extra_columns(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id BIGINT, text STRING"), A, B).count() == 0
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id BIGINT, text STRING, _row STRING, n_a INT")
    row = alignment.aligned(df, A, B).first()
    assert row.n_a == 2 and row.n_groups == 2 and row.count_sum == row.n_links


def test_query_over_the_table(spark):
    got = QUERIES["op11_cross_tokenizer_alignment"](spark, "/root/testdata/sf0.001")
    rows = got.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.n_best <= r.n_links and r.count_sum >= r.n_links for r in rows)


def test_ends_are_looked_up_without_an_object_for_each():
    n = 200_000
    a, b = np.arange(n) % 3, np.zeros(n // 2, int)
    lengths_a, lengths_b = np.array([1, 1, 1]), np.array([2])
    alignment.align(a[:6], b[:3], lengths_a, lengths_b)
    tracemalloc.start()
    found = alignment.align(a, b, lengths_a, lengths_b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["n_groups"] == n // 2 and found["n_links"] == n
    groups = ";".join(f"{k % 3},{(k + 1) % 3}|0" for k in range(0, n, 2))
    assert found["groups_sha256"] == hashlib.sha256(groups.encode()).hexdigest()
    # Both dictionaries as Python objects made it 380 bytes a token; now it is 214.
    assert peak < 300 * n


def test_an_end_without_bytes_belongs_to_the_last_token():
    found = alignment.align([0, 1, 0], [0, 0], np.array([2, 0]), np.array([2]))
    assert (found["n_groups"], found["n_links"]) == (2, 3)
    assert found["groups_sha256"] == hashlib.sha256(b"0,1|0;0|0").hexdigest()
