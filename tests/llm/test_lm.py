"""Language-model scoring against a version that goes token by token."""

import math

import numpy as np
import pyarrow as pa

from corpusq.llm import lm
from corpusq.llm.common import NOT_SPACE, strings, words


def one(network, vocabulary, text):
    """The score of one text, a token at a time."""
    hashes = words(*strings(pa.array([text])), NOT_SPACE)[0]
    classes, total, p = vocabulary.classes(hashes).tolist(), 0.0, network.p
    for i, c in enumerate(classes):
        h = p["bias"].astype(float).copy()
        for k, step in enumerate([-2, -1, 1, 2]):
            j = i + step
            h += p["embedding"][k][classes[j] if 0 <= j < len(classes) else lm.NOTHING]
        h = np.tanh(h)
        for logits, at in ((h @ p["group"] + p["group_bias"], c // lm.MEMBERS), (h @ p["member"][c // lm.MEMBERS] + p["member_bias"][c // lm.MEMBERS], c % lm.MEMBERS)):
            total += logits[at] - math.log(np.exp(logits).sum())
        total -= network.share[c]
    return len(classes), total


def texts():
    rng = np.random.default_rng(7)
    # a word of the first half is followed by its partner
    out = []
    for i in range(300):
        words_ = []
        for _ in range(int(rng.integers(5, 40))):
            k = int(rng.integers(20))
            words_ += [f"a{k}", f"b{k}"]
        out.append((i, " ".join(words_) + f" once{i}", "x", 1))
    return out + [(900, None, "x", 1), (901, "", "x", 1), (902, " \n\t", "x", 1), (903, "A1 B1 " * 20_000, "x", 1), (None, "a1 b1", "x", 1), (5, out[5][1], "x", 1)]


def test_scores_are_those_of_the_network(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, log_prob string, word int").coalesce(3)
    vocabulary, network = lm.fitted(df.select("doc_id", "text"))
    got = lm.scored(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (0, 5, 77, 299, None):
        n, total = one(network, vocabulary, next(r[1] for r in rows if r[0] == i))
        assert by[i].n_tokens == n and abs(by[i].log_prob - total) < 1e-3 * n
    assert all(by[i].n_tokens == 0 and by[i].log_prob == 0 and by[i].perplexity is None for i in (900, 901, 902))
    assert by[903].n_tokens == 40_000
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)


def test_real_order_scores_higher(spark):
    rows = texts()[:300]
    rng = np.random.default_rng(1)
    mixed = [(i + 1000, " ".join(rng.permutation(t.split())), x, w) for i, t, x, w in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string, w int")
    vocabulary, network = lm.fitted(df.select("doc_id", "text"))
    real, other = (sum(one(network, vocabulary, t)[1] for _, t, _, _ in part[:40]) for part in (rows, mixed))
    assert real > other + 100


def test_counts_are_of_all_words_and_nothing_scores_nothing(spark):
    df = spark.createDataFrame([(1, "a b A"), (2, "b c"), (3, None)], "doc_id long, text string")
    assert sorted(r.n for r in lm.counts(df).collect()) == [1, 2, 2]
    assert lm.scored(df.limit(0)).count() == 0


def test_rare_words_share_their_class_by_count_and_the_network_sees_long_texts(spark, monkeypatch):
    # 1200 words, the first 960 of them more frequent; of the rest the first 100 are written four times as often
    often = " ".join(f"w{i} w{i} w{i} w{i} w{i} w{i}" for i in range(960))
    rest = [f"r{i}" for i in range(240)]
    rows = [(1, often), (2, " ".join(rest + rest[:100] * 3)), (3, "r0 r1 r0 r200"), (3, "r0 w1 r0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def check():
        vocabulary, network = lm.fitted(df)
        n = {}
        for _, text in rows:
            for w in text.split():
                n[w] = n.get(w, 0) + 1
        got = sorted((r.doc_id, r.n_tokens, r.log_prob) for r in lm.scored(df).collect())
        want = []
        for i, text in rows:
            tokens, total = one(network, vocabulary, text)
            classes = vocabulary.classes(words(*strings(pa.array([text])), NOT_SPACE)[0])
            want.append((i, tokens, total + sum(math.log(n[w]) for w, c in zip(text.split(), classes, strict=True) if c >= lm.WORDS)))
        assert len(got) == len(want)
        for (i, a, x), (j, b, y) in zip(got, sorted(want), strict=True):
            assert (i, a) == (j, b) and abs(x - y) < 1e-3 * a
        # the shares of a class's words add up to one
        table = {r.word: r.n for r in lm.counts(df).collect()}
        held = np.array(list(table), np.int64).view(np.uint64)
        classes = vocabulary.classes(held)
        for c in set(classes[classes >= lm.WORDS].tolist()):
            assert abs(sum(k for k, d in zip(table.values(), classes, strict=True) if d == c) / math.exp(network.share[c]) - 1) < 1e-9

    check()
    monkeypatch.setattr(lm, "HEAD", 0)  # every share by the join
    check()


def test_gradient_is_of_every_token_of_every_document(spark):
    # a long document and more documents than any sample: the same gradient however rows are dealt out, and each one counts
    rows = [(i, f"a{i % 7} b{i % 7} c") for i in range(1500)] + [(9000, "x y " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, vocabulary, class_counts = lm.vocabulary_of(df)
    network = lm.Network(class_counts)
    got = [lm.gradient(lm.coded(d, vocabulary), network) for d in (df.coalesce(1), df.repartition(5))]
    total, n = 0, 0
    for _, text in rows:
        classes = vocabulary.classes(words(*strings(pa.array([text])), NOT_SPACE)[0])
        total = total + network.packed(network.gradients(classes, lm.sides(classes, np.array([0, len(classes)]))))
        n += len(classes)
    for g in got:
        assert np.allclose(g, total / n, atol=1e-5)
    assert lm.gradient(lm.coded(df.limit(0), vocabulary), network) is None


def test_gradient_is_the_derivative(spark):
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 1024, 40)
    context = lm.sides(classes, np.array([0, 25, 40]))
    network = lm.Network(np.bincount(classes, minlength=1024))
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    gradients = network.gradients(classes, context)
    for k, at in (("embedding", (1, int(classes[3]), 2)), ("bias", (4,)), ("group", (3, int(classes[0]) // 32)), ("member", (int(classes[0]) // 32, 5, int(classes[0]) % 32)), ("member_bias", (int(classes[0]) // 32, 1)), ("group_bias", (6,))):
        ends = []
        for by in (1e-5, -1e-5):
            network.p[k][at] += by
            ends.append(-network.log_probs(classes, context).sum())
            network.p[k][at] -= by
        assert abs((ends[0] - ends[1]) / 2e-5 - gradients[k][at]) < 1e-4
