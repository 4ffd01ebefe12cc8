"""Alignment of tokenizers against the libraries on whole texts, pair by pair."""

import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusq.llm import align, common, queries

DATA = "/root/testdata/sf0.001"
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
A, B = common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return align.Coder(A, B)


def whole(own, text):
    """(A's tokens, B's tokens, groups, links) of a whole text by the libraries alone."""
    if not text:
        return [], [], [], []
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    target = (" " + text).encode()
    if b"".join(own.a_bytes[i] for i in a) != target or b"".join(own.b_bytes[i] for i in b) != target:
        return [], [], [], []
    a_span = [(sum(len(own.a_bytes[i]) for i in a[:k]), sum(len(own.a_bytes[i]) for i in a[: k + 1])) for k in range(len(a))] if len(a) < 300 else _spans(a, own.a_bytes)
    b_span = _spans(b, own.b_bytes)
    ends = sorted({e for _, e in a_span} & {e for _, e in b_span})
    groups, start = [], 0
    for e in ends:
        groups.append(([x for x, (s, z) in zip(a, a_span) if start <= s and z <= e], [x for x, (s, z) in zip(b, b_span) if start <= s and z <= e])) if len(a) < 300 else None
        start = e
    links = []
    j = 0
    for x, (s, e) in zip(a, a_span):
        while b_span[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and b_span[k][0] < e:
            links.append((x, b[k]))
            k += 1
    if len(a) >= 300:
        groups = _groups(a, a_span, b, b_span, ends)
    return a, b, groups, links


def _spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i])))
        at += len(table[i])
    return out


def _groups(a, a_span, b, b_span, ends):
    out, i, j = [], 0, 0
    for e in ends:
        x, y = i, j
        while i < len(a) and a_span[i][1] <= e:
            i += 1
        while j < len(b) and b_span[j][1] <= e:
            j += 1
        out.append((a[x:i], b[y:j]))
    return out


def written(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def brute(own, rows):
    each = [(i, *whole(own, t)) for i, t in rows]
    count = collections.Counter(x for *_, links in each for x in links)
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(i, len(a), len(b), len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(written(g).encode()).hexdigest() if a else "") for i, a, b, g, links in each]


PIECES = ["a", "the", "word", "Straße", "ﬁn", "日本語", "x1", "12345", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'s", "don't", "▁", "\x00", "é", "é", "🙂", "-", "...", "\n", "\r\n", "\t", " ", "　", " ", "\u0085", "\x1c", "  ", "   ", " ", " ", " ", " "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_parts_are_coded_as_whole_texts(own, text):
    a, b, groups, links = whole(own, text)
    numbers, digests, kept, at, doc = own.coded([text], True)
    assert [int(x[0]) for x in numbers] == [len(a), len(b), len(groups), len(links)]
    assert kept[0] == written(groups) and digests[0] == (hashlib.sha256(kept[0].encode()).hexdigest() if a else "")
    key, often = own.postings(at, doc)
    assert dict(zip(key.tolist(), often.tolist())) == {(x * align.PAIR + y) * align.BLOCK_DOCS: n for (x, y), n in collections.Counter(links).items()}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(own, text):
    a, b, groups, links = whole(own, text)
    numbers, _, kept, _, _ = own.coded([text], True)
    assert [int(x[0]) for x in numbers] == [len(a), len(b), len(groups), len(links)] and kept[0] == written(groups)


@pytest.mark.parametrize("width", [1, 9, 700, 65_536])
def test_bitmaps_are_read_as_written(width):
    rng = np.random.default_rng(width)
    for share in (0.001, 0.05, 0.5, 1):
        documents = np.flatnonzero(rng.random(width) <= share)
        if not len(documents):
            continue
        links = rng.integers(1, 70, len(documents))
        back = np.zeros(width, np.int64)
        for some, weight in align.unpacked(align.bitmaps(documents, links, width)):
            back[some] += weight
        assert np.array_equal(back[documents], links) and back.sum() == links.sum()


def cases():
    rng = np.random.default_rng(8)
    words = ["one", "Two", "épsilon", "don't", "running", "<|endoftext|>", "日本", "x_1", "a\nb", "zz"]
    out = [(1, None), (2, ""), (3, " "), (4, "▁"), (5, "one ▁ two"), (6, " lead"), (7, "trail "), (8, "a  b"), (None, "no id"), (None, None), (9, "\n \n"), (10, "same"), (10, "same"), (11, "same")]
    out += [(20 + i, " ".join(rng.choice(words, int(rng.integers(1, 40))))) for i in range(60)]
    return out + [(90, " ".join(rng.choice(words, 30_000))), (91, "x" * 5_000), (20, "another of this id")]


def test_alignment_of_a_table(spark, own, monkeypatch):
    common.ready(spark)
    df = spark.createDataFrame([(i, t, 1, "p", 2, [3]) for i, t in cases()], "doc_id long, text string, pair int, block string, place int, links array<int>").repartition(3)
    want = sorted(brute(own, cases()), key=str)
    for block_bytes in (align.BLOCK_BYTES, 200):
        got = align.aligned(df, A, B, True, block_bytes)
        assert sorted((tuple(r) for r in got.select(*NAMES).collect()), key=str) == want
    texts = {r["doc_id"]: r["groups"] for r in got.collect()}
    assert texts[11] == written(whole(own, "same")[2]) and texts[2] == ""


def test_pairs_of_the_corpus(spark, own):
    common.ready(spark)
    rows = [(1, "one two two"), (2, "two"), (3, "one one")]
    found = common.stage(align.postings(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), A, B), "alignment")
    links, docs = collections.Counter(), collections.Counter()
    for _, t in rows:
        own_links = whole(own, t)[3]
        links.update(own_links)
        docs.update(set(own_links))
    got = {(r["a"], r["b"]): (r["docs"], r["links"]) for r in align.pair_counts(found).collect()}
    assert got == {x: (docs[x], links[x]) for x in links}


def test_alignment_of_an_empty_table(spark):
    assert align.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_op12_alignment(spark, own):
    got = sorted((tuple(r) for r in queries.queries()["op12_alignment"](spark, DATA).select(*NAMES).collect()), key=str)
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted(brute(own, docs), key=str)
