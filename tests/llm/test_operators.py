"""Each operator against a brute-force version on small tables, with nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusq.llm import ann, common, decontaminate, langid, mixing, neardup, queries, tokens, toxicity, urls, warc
from corpusq.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, _found int"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(2)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    out = []
    for i in range(60):
        words = rng.choice(vocabulary, int(rng.integers(1, 80)))
        out.append((i, " ".join(words), "en", f"s{i % 4}" if i % 7 else None, 1, 9, "x", 1))
    out += [(60, None, "en", "s0", 0, 0, None, None), (61, "", None, "s1", 0, 0, None, None), (62, out[5][1], "en", "s1", 1, 1, "y", 2), (63, " \t\n ", "en", "s9", 1, 1, "y", 2)]
    out += [out[3], out[3], (64, "word " * 20_000, "en", "s2", 1, 1, "z", 3)]
    return out


def test_words_and_hashes_do_not_depend_on_place():
    texts = ["Aa bb\tcc", "", "bb", "aa  bb cc\x0b", "é bb"]
    h, first, last, rows = common.words(*common.strings(pa.array(texts)), common.NOT_SPACE)
    got = [[h[i] for i in range(a, z)] for a, z in zip(rows[:-1], rows[1:])]
    assert list(map(len, got)) == [3, 0, 1, 3, 2]
    assert got[0] == got[3] and got[0][1] == got[2][0] == got[4][1]
    assert len({int(x) for x in h}) == 4


def thue_morse(letters, one, other):
    """Two words that a polynomial hash modulo 2^64 takes for the same."""
    bits = [k.bit_count() & 1 for k in range(letters)]
    return "".join((one, other)[b] for b in bits), "".join((other, one)[b] for b in bits)


@pytest.mark.parametrize("letters", [1024, 4096])
def test_words_that_a_polynomial_takes_for_the_same(spark, letters):
    a, b = thue_morse(letters, "a", "b")
    h = common.words(*common.strings(pa.array([a, b])), common.NOT_SPACE)[0]
    assert h[0] != h[1]
    rows = [(1, f"x y {a} z w"), (2, f"x y {b} z w"), (3, a), (4, b)]
    df = table(spark, rows, "doc_id long, text string")
    assert sorted(rows_of(neardup.deduplicated(df), "doc_id", "n_shingles", "component_id", "kept")) == brute_near(rows)
    items = [(7, f"y {a}"), (8, b)]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate.report(df, table(spark, items, "item_id long, text string"), window=4), *names) == brute_contamination(rows, items, 4)
    own = tokens.Encoder(common.tokenizer_path("byte_bpe_50k.json"))
    for _ in range(2):
        assert [list(x) for x in own.encode(*common.strings(pa.array([t for _, t in rows])))] == [own.whole.encode(t, add_special_tokens=False).ids for _, t in rows]


def test_bytes_decide_whatever_the_hashes(spark, monkeypatch):
    # every word hashes alike but by its length
    for module in (common, tokens, decontaminate):
        monkeypatch.setattr(module, "words", lambda *a, f=common.words, **k: (lambda h, first, last, rows: ((last - first).astype(np.uint64), first, last, rows))(*f(*a, **k)))
    texts = ["one two three", "two six", "one six two", "", "ten one", "three seven"]
    own = tokens.Encoder(common.tokenizer_path("byte_bpe_50k.json"))
    for part in (texts[:2], texts, texts[::-1]):
        assert [list(x) for x in own.encode(*common.strings(pa.array(part)))] == [own.whole.encode(t, add_special_tokens=False).ids for t in part]
    sets, _ = decontaminate.patterns([("a", "one two"), ("b", "six")], 13)
    data, offsets = common.strings(pa.array(texts))
    hashes, first, last, rows = common.words(data, offsets, common.ALNUM)
    hit = {(int(np.searchsorted(rows, a, "right") - 1), s.texts[p]) for s in sets for a, p in zip(*s.search((last - first).astype(np.uint64), rows, decontaminate._joined(data, first, last)))}
    assert hit == {(0, b"one two"), (1, b"six"), (2, b"six")}


def test_same_runs():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 2, 500).astype(np.uint8), rng.integers(0, 2, 500).astype(np.uint8)
    a, b, size = rng.integers(0, 480, 300), rng.integers(0, 480, 300), rng.integers(1, 9, 300)
    want = [bool((x[i : i + n] == y[j : j + n]).all()) for i, j, n in zip(a, b, size)]
    assert common.same_runs(x, a, y, b, size).tolist() == common.same_runs(x, a, y, b, size, most=7).tolist() == want


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(50)] + [(7, None), (8, 8)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    want = {x: find(x) for x in root if find(x) != x}
    got = {r[0]: r[1] for r in components(table(spark, links, "a long, b long")).collect()}
    assert got == want
    assert components(table(spark, [], "a long, b long")).count() == 0


# --- 1 mixing ----------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
        free -= over


@pytest.mark.parametrize("block", [7, 64])
def test_mix(spark, block):
    rows = docs(spark)
    df = table(spark, rows, DOCS)
    got = mixing.mix(df, block_words=block).join(df.select("doc_id", "source").distinct(), "doc_id").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((r[0], size(r[1])) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = water_fill(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert rows_of(mixing.mix(df, block_words=block), "doc_id", "row", "taken") == rows_of(mixing.mix(df.repartition(3), block_words=block), "doc_id", "row", "taken")


def test_shards_of_the_mix(spark):
    rows = [r for r in docs(spark) if r[0] != 64] + [(None, "no id " * 9, "en", "s1", 1, 1, "", 1)] * 2
    df = table(spark, rows, DOCS)
    places = mixing.packed(df, block_words=5, shard_slots=64).collect()
    # what each document gives is what mix() says, and the mix's text is made of just these words
    taken, text = collections.Counter(), collections.defaultdict(list)
    words = {r[0]: r[1].split() for r in rows if r[1]}
    for p in places:
        taken[p.doc_id, p.row] += p.words
        text[p.shard, p.slot].append((p.at, words[p.doc_id][p["from"] : p["from"] + p.words]))
        assert p.shard == p.slot // 64
    for r in mixing.mix(df, block_words=5, shard_slots=64).collect():
        if r.doc_id != 3:  # its two rows are alike
            assert taken[r.doc_id, r.row] == r.taken
    got = mixing.shards(df, block_words=5, shard_slots=64).collect()
    assert {(r.shard, r.slot): r.text for r in got} == {k: " ".join(w for _, part in sorted(v) for w in part) for k, v in text.items()}
    assert all(r.words == len(r.text.split()) <= 5 for r in got)
    assert sorted(r.slot for r in got) == list(range(len(got)))
    # counts of a source by shard: totals are fixed, shards vary as multinomial draws do
    by_shard = collections.Counter((r.shard, r.source) for r in got if r.shard < len(got) // 64)
    shards, total = len(got) // 64, len(got)
    size = collections.Counter(r.source for r in got)
    z = [(by_shard[k, s] - 64 * n / total) / np.sqrt(64 * n / total * (1 - n / total)) for k in range(shards) for s, n in size.items() if n > 50]
    assert len(z) > 20 and abs(np.mean(z)) < 0.3 and 0.6 < np.std(z) < 1.4


def test_slots_are_made_in_many_tasks(spark, monkeypatch):
    sources = spark.createDataFrame([("a", 1, 40_000, 80_000.0), ("b", 2, 30_000, 20_000.0)], "source string, rank int, source_size long, target double")
    monkeypatch.setattr(mixing, "TASK_SLOTS", 1000)
    made = mixing.slots(sources, 8, 512)
    assert made.rdd.getNumPartitions() == 13
    rows = made.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert {r["rank"]: sum(1 for x in rows if x["rank"] == r["rank"]) for r in rows} == {1: 10_000, 2: 2_500}


def test_mix_of_nothing_and_documents_of_the_mix(spark):
    assert mixing.mix(table(spark, [], DOCS)).count() == 0
    assert mixing.mix(table(spark, [(1, None, "a", "b", 1, 1, "", 1)], DOCS)).collect()[0].taken == 0
    df = table(spark, docs(spark), DOCS)
    out = mixing.mixed(df, block_words=16)
    assert out.columns == df.columns
    most = collections.Counter(r.doc_id for r in out.collect())
    assert most and max(n for d, n in most.items() if d != 3) <= 3
    assert not {60, 61, 63} & set(most)
    assert mixing.mixed(table(spark, [], DOCS)).count() == 0


def test_documents_of_the_mix_have_the_words_of_its_targets(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(i, f"a{i} b{i} " * 20, "en", f"s{i % 3}", 160, 1, "x", i) for i in range(300)] + [(1000, long, "en", "s2", 9, 1, "y", 1), (1001, "  odd \n white\tspace ", "en", "s1", 9, 1, "y", 1), (1002, None, "en", None, 0, 1, "z", 1), (1003, "of no source " * 30, "en", None, 9, 1, "z", 1)]
    rows += [rows[7], rows[7]]
    df = table(spark, rows, DOCS)
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    target = {r.source: r.target for r in mixing.mix(df).select("source_size", "target", "doc_id").join(df.select("doc_id", "source"), "doc_id").collect()}
    for block_words in (16, 256):
        out = mixing.mixed(df, block_words=block_words).collect()
        taken = collections.Counter()
        for r in out:
            taken[r.source] += size(r.text)
        assert all(abs(taken[s] - t) <= 1 for s, t in target.items()), (taken, target)
        text = {(r[0], r[3]): r[1] for r in rows}
        for r in out:
            own = text[r.doc_id, r.source]
            assert r.text == own or set(r.text.split()) <= set(own.split()) and r.n_chars == len(r.text) and size(r.text) < size(own)
        assert any(r.text != text[r.doc_id, r.source] for r in out) and any(r.text == text[r.doc_id, r.source] for r in out)
        assert not {1002} & {r.doc_id for r in out}


def test_permutation_is_one(spark):
    for n in (1, 2, 17, 100):
        df = spark.range(n).withColumn("y", mixing.permuted(F.col("id"), F.lit(n), F.lit(5)))
        df = df.withColumn("z", mixing.permuted(F.col("y"), F.lit(n), F.lit(5), back=True))
        r = df.collect()
        assert sorted(x.y for x in r) == list(range(n)) and all(x.z == x.id for x in r)


# --- 2 WARC ------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    v = warc.VERSION
    nested = v + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + v + "WARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    pages = [(1, "http://a", "x", 1), (2, "http://b\r\nq", "x", 1), (3, None, None, 1), (4, "u", f"a{v}b", 1), (5, "u", nested, 1), (6, "é", "é" + v, 1), (None, "n", "nul", 1), (7, "x", "", 1), (8, "u", f"a{v}b", 1), (9, "z", v, 1), (10, "l", "long " * 50_000, 1)]
    df = table(spark, pages, "page_id long, url string, html string, digest int")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = rows_of(warc.written_and_read(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    largest = {}
    for p, _, h, _ in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h, _ in pages:
        data, first = (h or "").encode(), largest[h or ""]
        response = p is None or p == first
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first))
    assert got == sorted(want, key=str)
    assert warc.written_and_read(df.limit(0)).count() == 0


def test_warc_least_bytes_and_repeats(spark):
    df = table(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert rows_of(warc.written_and_read(df, least_bytes=3), "page_id", "record_type") == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response"), (4, "response")]


# --- 4 toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_catches_misspellings(spark):
    rng = np.random.default_rng(0)
    syllables = ["an", "the", "re", "in", "on", "er", "ti", "sh"]
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice(syllables, 3)) for _ in range(40)]
        if i % 3 == 0:
            words[int(rng.integers(40))] = rng.choice(["scoundrel", "blockhead"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    for i, text in ((1000, "inonre theaner skoundrels blockheadd " + "anrein " * 30), (1001, "inonre theaner " + "anrein " * 30), (1002, None), (1003, "")):
        rows.append((i, text))
    labels += [(None, 1), (5, None)]
    # a long text with one insult, the same without, repeated rows, no id, and columns of other names
    rows += [(1004, "anrein theaner " * 2_000 + "blockhead " + "inonre theaner " * 2_000), (1005, "anrein theaner inonre " * 20_000), rows[7], rows[7], (None, "inonre scoundrel")]
    rows = [(*r, 0.5, "x") for r in rows]
    d, x = table(spark, rows, "doc_id long, text string, score double, toxic string"), table(spark, labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.scored(d, x).collect()}
    assert toxicity.scored(d, x).count() == len(rows)
    assert out[1004].predicted == 1 and out[1005].predicted == 0 and out[None].predicted == 1 and out.pop(None).held_out
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    held = [i for i in range(600) if out[i].held_out]
    assert np.mean([out[i].predicted == int(i % 3 == 0) for i in held]) > 0.95
    assert out[1000].score > 0.5 > out[1001].score and 0 <= out[1002].score == out[1003].score <= 1


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    out = queries.op4_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    caught, called = [r.predicted for r in out if r.toxic], [r.toxic for r in out if r.predicted]
    assert len(out) > 800 and np.mean(caught) >= 0.9 and np.mean(called) >= 0.85


def test_windows_score_as_word_by_word():
    texts = ["one two three", "", "é", "a b", None, "x " * 40]
    weight = np.random.default_rng(0).normal(size=toxicity.BUCKETS).astype(np.float32)
    bucket, starts, rows = toxicity.by_word(*common.strings(pa.array(texts)))
    first, last, row = toxicity.windows(rows)
    got = toxicity._scores(weight, bucket, starts, first, last)
    want = []
    for k, t in enumerate(texts):
        w = (t or "").split()
        for i in range(max(1, len(w) - toxicity.WINDOW + 1)):
            own = [b for x in w[i : i + toxicity.WINDOW] for b in toxicity.subwords(*common.strings(pa.array([x])))[0]]
            want.append((k, sum(float(weight[b]) for b in own) / (len(own) + toxicity.STEADY)))
    assert row.tolist() == [k for k, _ in want] and np.allclose(got, [x for _, x in want])


def test_toxicity_without_labels_or_documents(spark):
    d, x = table(spark, [(1, "a b")], "doc_id long, text string"), table(spark, [], "doc_id long, toxic int")
    assert toxicity.scored(d, x).collect()[0].predicted == 0
    assert toxicity.scored(d.limit(0), x).count() == 0


# --- 5 decontamination -------------------------------------------------------------------------------------------------


def brute_contamination(rows, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(lowered(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for r in rows:
        w, hit, found = word.findall(lowered(r[1])), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_decontamination(spark, part_bytes):
    rows = docs(spark)
    items = [(1, "Alpha, beta-gamma DELTA"), (10, rows[2][1][:60]), (2, rows[5][1]), (3, None), (4, "..."), (5, "kappa"), (None, "zeta zeta"), (5, "word word word word word word"), (2, "iota\x7fiota")]
    df = table(spark, rows, DOCS)
    b = table(spark, items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = rows_of(decontaminate.report(df, b, window=4, part_bytes=part_bytes), *names)
    want = brute_contamination(rows, items, 4)
    assert got == want
    kept = decontaminate.clean(df, b, window=4)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])
    assert {r.n_items for r in decontaminate.report(df, b.limit(0)).collect()} == {0}
    assert decontaminate.report(df.limit(0), b).count() == 0


# --- 6 tokens ----------------------------------------------------------------------------------------------------------


def test_codes_give_random_access():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 50_000, 3000), [0, 255, 256, 65_535, 65_536, 2**32 - 1], rng.integers(0, 200, 700)]).astype(np.uint32)
    for values in (ids, ids[:1], np.zeros(65, np.uint32), np.zeros(0, np.uint32)):
        s = tokens.Segment(tokens.pack(values, np.array([len(values)]), 5, [7]))
        assert s.before == 5 and s.find(7) == 0 and s.find(8) is None and (s.document(0) == values).all()
        assert all(s.token(i) == values[i] for i in range(0, len(values), 7))
        for a, z in ((0, 0), (63, 65), (64, 128), (1000, 1001), (511, 2049)):
            if z <= len(values):
                assert (s.tokens(a, z) == values[a:z]).all()


def test_encoder_is_the_librarys():
    own = tokens.Encoder(common.tokenizer_path("byte_bpe_50k.json"))
    texts = ["", " ", "a", " a", "a ", "a  b", "a   b", "\n a", "a \n b", "it's  <|endoftext|> x", "<|endoftext|>", "é  é", "x \u3000 y", "a\u00a0 b", "12½ ² 日本語 テスト", "tab\t x", "x\x1c y", "Hello, world. Hello, world."] * 2
    got = own.encode(*common.strings(pa.array(texts)))
    assert [list(x) for x in got] == [own.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens(spark):
    rows = docs(spark) + [(None, "no id", "en", "s", 1, 1, "", 1)]
    path = common.tokenizer_path("byte_bpe_50k.json")
    got = tokens.write_and_read(table(spark, rows, DOCS), path, partitions=3, segment_ids=200).collect()
    whole = tokens.Encoder(path).whole
    want, start = [], 0
    for d, t in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert tokens.write_and_read(table(spark, [], DOCS), path).count() == 0
    at = common.new_path(spark, "test-tokens")
    tokens.write(table(spark, rows, DOCS), path, at, 3, 200)
    for r in (rows[0], rows[17], rows[40], rows[60]):
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 0]
        assert tokens.document(spark, at, r[0]).tolist() == ids
        assert [tokens.token(spark, at, r[0], k) for k in (0, len(ids) - 1, len(ids))] == [ids[0], 0, None]
    assert tokens.token(spark, at, 12_345, 0) is None


def test_tokens_of_one_id_are_dealt_to_many_shards(spark):
    rows = [(None if i % 3 else 7, f"word{i} " * 5) for i in range(400)]
    path, at = common.tokenizer_path("byte_bpe_50k.json"), common.new_path(spark, "test-tokens")
    tokens.write(table(spark, rows, "doc_id long, text string"), path, at, 8, 100)
    assert tokens.segments_at(spark, at).where("documents > 0").select("shard").distinct().count() == 8
    got = sorted((tuple(r) for r in tokens.read(spark, at).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert [r[0] for r in got] == [None] * 266 + [7] * 134


# --- 7 near duplicates -------------------------------------------------------------------------------------------------


def brute_near(rows, threshold=85):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common_ = len(sets[a] & sets[b])
            if sets[a] and 100 * common_ >= threshold * (len(sets[a]) + len(sets[b]) - common_):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    rows = []
    for family in range(6):
        base = [f"w{rng.integers(5000)}" for _ in range(int(rng.integers(3, 250)))]
        for _ in range(25 if family else 150):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"x{rng.integers(10**6)}"
            rows.append((len(rows) * 3, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "\n"), (2003, "One two"), (2004, "one  TWO"), (2005, "one two three"), (2006, "a b c d e"), (2007, "A B C D E\n"), (2008, "w " * 30_000), (2009, "w " * 29_999)]
    df = table(spark, [(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, n int")
    got = rows_of(neardup.deduplicated(df), "doc_id", "n_shingles", "component_id", "kept")
    want = brute_near(rows)
    assert sorted(got) == want
    twice = df.unionByName(df.where("doc_id < 30"))
    assert sorted(rows_of(neardup.deduplicated(twice), "doc_id", "n_shingles", "component_id", "kept")) == want
    kept = neardup.unique(twice)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if w[3]]


def test_forest_spans():
    rng = np.random.default_rng(6)
    for n, m in ((2, 1), (30, 25), (50, 600), (40, 0)):
        i = rng.integers(0, n, m)
        j = rng.integers(0, n, m)
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        a, z = neardup.forest(n, i, j, rng.integers(0, 3, len(i)).astype(float))

        def parts(edges):
            root = list(range(n))
            for u, v in edges:
                root = [root[u] if r == root[v] else r for r in root]
            return sorted(sorted(k for k in range(n) if root[k] == r) for r in set(root))

        assert parts(zip(a.tolist(), z.tolist())) == parts(zip(i.tolist(), j.tolist()))
        assert set(zip(a.tolist(), z.tolist())) <= set(zip(i.tolist(), j.tolist()))
        assert len(a) == n - len(parts(zip(i.tolist(), j.tolist())))


def test_a_family_of_chains_and_one_that_is_hardly_linked(spark):
    # 3000 documents in ten chains: each shares nearly all with the one before; and 120 at similarity about 0.8 of each other
    rng = np.random.default_rng(11)
    rows = []
    for chain in range(10):
        words = [f"c{chain}w{k}" for k in range(120 + 300 * 4)]
        rows += [(len(rows) + k, " ".join(words[4 * k : 4 * k + 120])) for k in range(300)]
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t) for i, t in rows]
    base = [f"b{k}" for k in range(200)]
    for k in range(120):
        words = list(base)
        for at in rng.choice(40, 2 + k % 3, replace=False):
            words[5 * int(at)] = f"y{rng.integers(10**9)}"
        rows.append((10_000 + k, " ".join(words)))
    df = table(spark, rows, "doc_id long, text string")
    got = sorted(rows_of(neardup.deduplicated(df), "doc_id", "n_shingles", "component_id", "kept"))
    chains = {d: min(order[k // 300 * 300 : k // 300 * 300 + 300]) for k, d in enumerate(order.tolist())}
    assert [(d, c) for d, _, c, _ in got if d < 10_000] == sorted(chains.items())
    assert [r for r in got if r[0] >= 10_000] == brute_near([r for r in rows if r[0] >= 10_000])


def test_near_duplicates_of_nothing(spark):
    df = table(spark, [(1, "a"), (None, "a")], "doc_id long, text string")
    assert rows_of(neardup.deduplicated(df), "doc_id", "component_id", "kept") == [(1, 1, True), (None, None, False)] or rows_of(neardup.deduplicated(df), "doc_id", "component_id", "kept") == [(1, 1, True), (None, 1, False)]
    assert neardup.deduplicated(df.limit(0)).count() == 0


def test_estimate_is_near_the_similarity(spark):
    a = [f"w{i}" for i in range(400)]
    f = {r.doc_id: np.frombuffer(r.signature, np.uint8)[None] for r in neardup.features(table(spark, [(1, " ".join(a)), (2, " ".join(a[:380])), (3, " ".join(a[200:]))], "doc_id long, text string")).collect()}
    assert neardup.estimate(f[1], f[1])[0, 0] == 1
    assert abs(neardup.estimate(f[1], f[2])[0, 0] - 376 / 396) < 0.08
    assert abs(neardup.estimate(f[1], f[3])[0, 0] - 196 / 396) < 0.15


# --- 8 URLs ------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    given = ["http://a.ORG/x", "https://Example.org/es/1", "https://m.example.org/en/12?x#y", "https://notexample.org/es/", "http://b.com/fr/9", "http://com/de/", "http://b.com/fr", None, "no scheme", "x://", "http://h?q/fr/", "http://h.com#f/fr/", "ftp://c.com/de/2#top", "http://example.org", "http://.org/"]
    rows = [(i, u, "h", "r") for i, u in enumerate(given)] + [(0, given[0], "h", "r")] * 2 + [(None, given[1], "h", "r")]
    df = table(spark, rows, "page_id long, url string, host string, rule string")

    def want(u):
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = lowered(m[1]), m[2]
        fit = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, *best

    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = rows_of(urls.judge(df, rules), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((r[0], *want(r[1])) for r in rows), key=str)
    long = table(spark, [(1, "http://" + "a." * 200 + "example.org/es/" + "x/" * 5_000)], "page_id long, url string")
    assert [tuple(r)[3:] for r in urls.judge(long, rules).collect()] == [("example.org/es/", "block")]
    assert {r.verdict for r in urls.judge(df, rules.limit(0), "block").collect()} == {"block"}
    assert urls.judge(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("most", [1 << 18, 10])  # as one value, and as a table joined by block
def test_bloom_filter_has_no_false_negatives(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MAX_BLOCKS", most)
    keys = [(f"h{i}.example", f"/p{i % 7}", "block") for i in range(3000)]
    pages = table(spark, [(i, f"http://www.h{i}.example/p{i % 7}/x") for i in range(4000)], "page_id long, url string")
    out = urls.judge(pages, spark.createDataFrame(keys, "host string, path string, verdict string"))
    assert all((r.verdict == "block") == (r.page_id < 3000) for r in out.collect())


# --- 9 nearest vectors -------------------------------------------------------------------------------------------------


def brute_nearest(rows, k):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = []
    for i, v in good:
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:k]
            out += [(i, n + 1, j, round(-s, 9)) for n, (s, j) in enumerate(near)]
    return sorted(out)


def test_nearest(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[20][1]) for i in range(60)] + [rows[3], rows[40]]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [None]), (904, [float("nan")] * 8), (905, [float("inf")] + [1.0] * 7), (920, [1.0] * 5), (None, [1.0] * 8)]
    df = table(spark, [(*r, 1) for r in rows], "vec_id long, embedding array<float>, rep int")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, recall=1.0).collect())
    assert got == brute_nearest(rows, 20)
    # cut finely, the forest still finds nine tenths
    pairs = {(q, v) for q, _, v, _ in brute_nearest(rows, 20)}
    for options in ({"trees": 3, "leaf": 16}, {"leaf": 16, "group_points": 7}):  # and leaves larger than a group
        out = ann.nearest(df, F.col("vec_id") % 20 == 0, recall=0.95, **options).collect()
        assert len(pairs & {(r.query_id, r.vec_id) for r in out}) >= 0.9 * len(pairs)
    few = df.where("vec_id in (0, 1, 2)")
    assert ann.nearest(few, F.col("vec_id") % 20 == 0).count() == 2
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_breaks_ties_by_id(spark):
    # one-hot and other small vectors: hundreds of different ones with equal scores
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.integers(0, 2, 8)]) for i in rng.permutation(600)]
    df = table(spark, rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, recall=1.0, leaf=16).collect())
    assert got == brute_nearest(rows, 20)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_nearest_finds_nine_tenths_with_fewer_scores_than_rows(spark, folder):
    t = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found = {(r.query_id, r.vec_id) for r in queries.op9_nearest(spark, f"/root/testdata/{folder}").collect()}
    right = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        near = np.argsort(-score)[:20]
        total += len(near)
        right += sum((ids[q], ids[j]) in found for j in near)
    assert right >= 0.9 * total


# --- 10 language -------------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = np.random.default_rng(9)
    parts = {"xa": ["tion", "the", "ing", "and"], "xb": ["schen", "ung", "über", "ein"], "xc": ["ção", "lhe", "não", "que"]}
    rows = []
    for i in range(300):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(20)), lang if i % 11 else None, "s"))
    rows += [(900, None, "xa", "s"), (901, "123 --- !", "xa", "s"), (902, "", None, "s"), (903, "ÜBER! UNG? " * 20_000, None, "s"), (904, "日本語", None, "s"), rows[0]]
    df = table(spark, rows, "doc_id long, text string, lang string, score string")
    out = langid.identified(df).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    by = {r.doc_id: r for r in out}
    assert np.mean([by[i].lang_pred == list(parts)[i % 3] for i in range(300) if by[i].held_out]) > 0.97
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred == "xb" and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in langid.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identified(df.limit(0)).count() == 0
    # languages that are sent one at a time
    texts, prototypes = df.select("doc_id", "text"), langid.learn(df.where("doc_id < 250"))
    assert rows_of(langid.predict(texts, prototypes, part=1), "doc_id", "lang_pred") == rows_of(langid.predict(texts, prototypes), "doc_id", "lang_pred")


# --- the registered queries and the pipeline ---------------------------------------------------------------------------

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = c.sql(queries.ORACLE_SQL[name]).project(",".join(f'"{x}"' for x in columns)).fetchall()
    rounded = lambda rows: sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows], key=str)
    assert rounded(tuple(r) for r in got.select(*columns).collect()) == rounded(want)


def test_language_of_held_out_documents(spark):
    out = queries.op10_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = given
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    rows = [(r.doc_id, r.text) for r in given.collect()]
    for name, f in pipeline.STAGES:
        before, kept = kept, common.stage(f(spark, kept, DATA), f"test-{name}")
        if name != "tokens":
            assert kept.columns == given.columns
        if name == "near-dedup":
            assert sorted(r.doc_id for r in kept.collect()) == [w[0] for w in brute_near(rows, pipeline.NEAR) if w[3]]
        if name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
            want = brute_contamination([tuple(r) for r in before.select("doc_id", "text").collect()], items, 13)
            assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])
    assert kept.count() == before.count()
    assert rows_of(pipeline.run(spark, DATA), "doc_id", "start", "ids_crc32") == rows_of(kept, "doc_id", "start", "ids_crc32")
