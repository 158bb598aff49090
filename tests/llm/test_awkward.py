"""Hash clashes by construction, rows that share or lack a doc_id, clashing column names, bad pages, short and long benchmark items."""

import inspect
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, extraction, langid, mixing, nearest, neardup, sharding, substrings, suffixtree, tokenfile
from rasterloom.llm.words import text_chunks, word_hashes

SF = "/root/testdata/sf0.001"


def thue_morse(n, a="a", b="b"):
    x = [0]
    while len(x) < n:
        x += [1 - k for k in x]
    return "".join((a, b)[k] for k in x), "".join((b, a)[k] for k in x)


PAIRS = [thue_morse(n, *ab) for n in (1024, 4096) for ab in (("a", "b"), ("x", "é"))]


@pytest.fixture(scope="module")
def twins(spark):
    """Documents that differ in words a polynomial modulo 2**64 cannot tell apart, twice each."""
    rows = []
    for k, (p, q) in enumerate(PAIRS):
        rows += [(4 * k, p), (4 * k + 1, q), (4 * k + 2, p), (4 * k + 3, q)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_words_of_any_length_have_their_own_hash():
    words = [w for pair in PAIRS for w in pair] + [thue_morse(n)[k] for n in (8, 16, 64, 256, 512) for k in (0, 1)] + ["a" * k for k in range(1, 1100)]
    for _, _, data, off in text_chunks(pa.array(words), 1 << 30):
        assert len(set(word_hashes(data, off)[0].tolist())) == len(words)


def test_long_twins_in_every_operator(spark, twins):
    groups = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, twins).collect()}
    assert groups == {d: d - d % 4 + d % 2 for d in range(4 * len(PAIRS))}
    assert sorted(r.doc_id for r in neardup.drop_duplicates(spark, twins).collect()) == [d for d in range(4 * len(PAIRS)) if d % 4 < 2]
    text = {r.doc_id: r.text for r in twins.collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenfile.vocabulary())
    for r in tokenfile.token_report(spark, twins, tokenfile.vocabulary()).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(t.encode(text[r.doc_id], add_special_tokens=False).ids + [2], "<u4").tobytes())
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in text}
    counts = Counter(w for d, x in text.items() if not held[d] for w in (x.lower(), "\0end"))
    n, v = sum(counts.values()), len(counts)
    for r in suffixtree.language_scores(spark, twins).collect():
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in (text[r.doc_id].lower(), "\0end"))
        assert math.isclose(r.base_score, want, abs_tol=1e-9)
    items = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PAIRS)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminations(spark, twins, items).collect()} == {(d, d // 4) for d in text if d % 2 == 0}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(spark, twins, items).collect()) == sorted(d for d in text if d % 2)
    # the same pattern of two words
    for n in (64, 1024, 4096):
        h = np.array([[7, 11][c == "b"] for t in thue_morse(n) for c in t], np.uint64)
        _, _, h1, h2 = substrings.spans(h, np.arange(5) * (len(h) // 4), np.array([0, 2, 4]))
        assert h1[0] != h1[1] and h2[0] != h2[1]


def test_encoder_tells_chunks_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr(tokenfile, "span_hashes", lambda data, starts, ends, fold=True: (ends - starts).astype(np.uint64))
    e, r = tokenfile.Encoder(tokenfile.vocabulary()), random.Random(5)
    texts = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(30)) for _ in range(20)] + [""]
    for _ in range(2):
        for i, j, data, off in text_chunks(pa.array(texts), 500):
            flat, first = e.encode(data, off)
            for k in range(j - i):
                assert flat[first[k] : first[k + 1]].tolist() == e.tokenizer.encode(texts[i + k], add_special_tokens=False).ids


# rows that share a doc_id, or have none


def test_near_duplicates_of_rows_that_share_or_lack_an_id(spark):
    r = random.Random(3)
    some = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, d = (some(60) for _ in range(4))
    rows = [(5, a), (5, b), (9, b + " more"), (None, c), (None, c), (None, d), (7, d + " more"), (8, some(60)), (8, some(60)), (3, a), (3, a), (2, None), (2, None), (None, "")]
    df = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, th long").repartition(3)
    got = Counter((x.doc_id, x.component_id, x.kept) for x in neardup.near_duplicates(spark, df).collect())
    assert got == Counter([(5, 3, False), (3, 3, True), (3, 3, True), (5, 5, True), (9, 5, False), (None, None, True), (None, None, True), (None, 7, False), (7, 7, True), (8, 8, True), (8, 8, True), (2, 2, True), (2, 2, True), (None, None, True)])
    left = neardup.drop_duplicates(spark, df)
    assert left.columns == df.columns
    assert Counter((x.doc_id, x.text) for x in left.collect()) == Counter([(3, a), (5, b), (None, c), (7, d + " more"), *((8, t) for i, t in rows if i == 8), (2, None), (2, None), (None, "")])


def test_a_repeated_id_never_costs_another_text(spark):
    r = random.Random(4)
    sent = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(12)).capitalize() + "."
    passage, unique = " ".join(sent() for _ in range(5)), " ".join(sent() for _ in range(5))
    rows = [(1, passage), (7, passage), (7, unique), (None, passage), (None, unique + " x."), (None, None)]
    got = Counter((x.doc_id, x.text, x.n_removed) for x in substrings.dedup_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got[None, None, 0] == 1 and sum(n for (_, t, _), n in got.items() if t == "") == 3
    kept = Counter(w for (_, t, _), n in got.items() for w in (t or "").split() * n)
    assert kept == Counter((passage + " " + unique + " x.").split())
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((x.doc_id, x.text) for x in decontaminate.decontaminate(spark, df, items).collect()) == Counter([(7, unique), (None, unique + " x."), (None, None)])


def test_a_source_of_null_ids_meets_its_target(spark):
    r = random.Random(6)
    rows = [(None, "w " * r.randint(1, 40), "a") for _ in range(400)] + [(k, "w " * r.randint(1, 40), "b") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for x in mixing.mix_report(spark, df.withColumn("source", F.col("source"))).groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(x.taken - x.target) <= 40 * 6  # texts repeat here, and go together


# clashing names


def clash(df, module):
    """df with an extra column for every name in the module's source, and some with signs in them."""
    taken = {c.lower() for c in df.columns}
    names = dict.fromkeys(n.lower() for n in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", "\n".join(re.findall(r"\"([^\"\n]*)\"", inspect.getsource(module)))))
    names = [n for n in [*names, *(f"_{n}" for n in names), "a.b", "c`d", "e f"] if n not in taken]
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(dict.fromkeys(names))))


DOCS = [(1, None, "en", "a"), (2, "", "en", None), (5, "The same text of seven words here", "en", "b"), (5, "The same text of seven words here", "en", "b"), (None, "another text, quite unlike it, has more words", None, "a"), (6, "the SAME text of seven words here", "de", "a")]


@pytest.mark.parametrize("module, run", [
    (mixing, lambda s, d: mixing.mix(s, d)), (mixing, lambda s, d: mixing.mix_report(s, d)), (sharding, lambda s, d: sharding.shard(s, d)), (sharding, lambda s, d: sharding.shard_report(s, d)),
    (neardup, lambda s, d: neardup.drop_duplicates(s, d)), (neardup, lambda s, d: neardup.near_duplicates(s, d)), (substrings, lambda s, d: substrings.dedup_substrings(s, d)),
    (decontaminate, lambda s, d: decontaminate.decontaminate(s, d, s.createDataFrame([(1, "text of seven words")], "item_id long, text string"))),
    (langid, lambda s, d: langid.predict(s, d, langid.train(s, d))), (suffixtree, lambda s, d: suffixtree.language_scores(s, d)), (tokenfile, lambda s, d: tokenfile.token_report(s, d, tokenfile.vocabulary())),
])
def test_columns_of_any_name(spark, module, run):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    plain, wide = run(spark, docs), run(spark, clash(docs, module))
    assert Counter(map(str, plain.collect())) == Counter(map(str, wide.select([F.col(f"`{c}`") for c in plain.columns]).collect()))


def test_columns_of_any_name_beside_vectors_and_pages(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(30)], "vec_id long, embedding array<float>")
    pick = lambda df: sorted(map(str, df.collect()))
    assert pick(nearest.nearest(spark, rows, every=10)) == pick(nearest.nearest(spark, clash(rows, nearest), every=10))
    pages = spark.createDataFrame([(1, "u", "<p>One. two three.</p>")], "page_id long, url string, html string")
    assert pick(extraction.extract(spark, pages)) == pick(extraction.extract(spark, clash(pages, extraction)))


# main text


def test_viterbi_and_gradient_against_all_label_paths():
    rng = np.random.default_rng(1)
    names = [f"f{k}" for k in range(6)]
    fs = [[n for n in names if rng.random() < 0.5] or names[:1] for _ in range(7)]
    crf = extraction.Crf({n: tuple(rng.normal(size=2)) for n in names}, rng.normal(size=(2, 2)))

    def value(crf, fs, y):
        return sum(crf.weights[x][y[i]] for i, f in enumerate(fs) for x in f) + sum(crf.moves[a, b] for a, b in itertools.pairwise(y))

    for k in range(1, 8):
        paths = list(itertools.product((0, 1), repeat=k))
        assert tuple(crf.decode(fs[:k])) == max(paths, key=lambda y: value(crf, fs[:k], y))
    # one round of training from zero moves each weight by the step in the direction of observed less expected counts
    truth = [1, 0, 0, 1, 1, 0, 1]
    one = extraction.Crf.train([(fs, truth)], rounds=1, step=1.0, decay=0.0)
    for n in names:
        for y in (0, 1):
            gain = sum(f.count(n) for f, t in zip(fs, truth) if t == y) - sum(f.count(n) for f in fs) / 2
            assert math.isclose(one.weights[n][y], gain / math.sqrt(gain**2 + 1e-8) if gain else 0.0, abs_tol=1e-9)
    trained = extraction.Crf.train([(fs, truth)], rounds=60)
    z = lambda c: math.log(sum(math.exp(value(c, fs, y)) for y in itertools.product((0, 1), repeat=7)))
    assert value(trained, fs, truth) - z(trained) > -7 * math.log(2) + 1


def test_bad_pages_take_time_in_proportion_to_their_length():
    """Four times the page may take some eight times as long, not sixteen; short times are noise."""
    crf = extraction.trained()
    kb = 250_000

    def seconds(page):
        began = time.process_time()
        extraction.main_text(page, crf)
        return time.process_time() - began

    makers = [
        lambda n: '<a href="x' * (n // 10), lambda n: "<p>x</p>" + '<a href="x' * (n // 10 + 1), lambda n: "<div class>" * (n // 11) + "x", lambda n: '<div class="a b">t' * (n // 18), lambda n: "<head>" * (n // 6),
        lambda n: "<ul><li>" + "<b>" * 3000 + "<i>" * (n // 3), lambda n: "<!--" * (n // 4), lambda n: "<p>" + "&" * n, lambda n: "<a " + "=" * n, lambda n: "<a class" + " " * n + "x>",
    ]
    for make in makers:
        short = min(seconds(make(kb)) for _ in range(2))
        assert seconds(make(4 * kb)) < 8 * short + 0.5, make(40)


def test_what_is_text_and_what_is_hidden():
    crf = extraction.trained()
    page = lambda x: extraction.main_text(f"<article><h1>A heading of five words</h1><p>{x}</p><p>The last words of a long enough paragraph, to be sure.</p></article>", crf).split("\n")[1]
    assert page("The text <math><mi>x</mi></math> has <svg><text>drawn</text></svg> and <noscript>some</noscript> <object>more</object> words here.") == "The text x has drawn and some more words here."
    assert page('Seen words come <span hidden>not these</span><span style="color:red; display: none">nor <b>these</b></span><span class="hidden x">but these</span> and more.') == "Seen words come but these and more."
    assert page("An <a title='x > y'>odd</a> tag <b title=a\"b>and</b> a < b </> are read.").startswith("An odd tag and a < b")


# decontamination


def test_items_of_any_length_against_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    r = random.Random(11)
    known = [w for x in docs.limit(60).collect() for w in (x.text or "").split()]
    texts = {x.item_id: x.text for x in items.limit(40).collect()}
    for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 12, 13, 14, 20, 27, 33, 40, 80]):
        texts[10_000 + k] = " ".join(f"q{r.randrange(500)}" if n < 4 else r.choice(known) for _ in range(n))
    rows = []
    for k, (i, t) in enumerate(sorted(texts.items())):
        w = t.split()
        for d in range(3):
            x = list(w)
            for _ in range(decontaminate.allowed(len(w)) + (d == 2)):
                at, kind = r.randrange(len(x)), r.randrange(3)
                x[at : at + 1] = [[f"zz{r.randrange(99)}"], [x[at], r.choice(known)], []][kind] if d else [r.choice(known)]
            rows.append((10 * k + d, " ".join([*r.sample(known, 40), *x, *r.sample(known, 40)])))
    got = {(x.doc_id, x.item_id): x.edits for x in decontaminate.contaminations(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(list(texts.items()), "item_id long, text string")).collect()}
    of = lambda t: word_hashes(*next(text_chunks(pa.array([t.lower()])))[2:])[0]
    hashed, want = {i: of(t) for i, t in texts.items()}, {}
    for d, t in rows:
        h = of(t)
        for i, w in hashed.items():
            if np.isin(w, h).sum() >= len(w) - decontaminate.allowed(len(w)):
                e = decontaminate.closest(w, h)[0]
                if e <= decontaminate.allowed(len(w)):
                    want[d, i] = e
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert all(k in got for k, e in want.items() if not e) and len(got) >= 0.9 * len(want) > 60


@pytest.mark.parametrize("place", ["head", "middle", "tail", "even"])
def test_short_items_are_found_wherever_the_edits_are(place):
    rng = np.random.default_rng(7)
    vocab = decontaminate.mix(np.arange(1, 3001, dtype=np.uint64))
    draw = lambda n: vocab[rng.integers(0, 3000, n)]
    items = [draw(n) for n in [*range(5, 15), 16, 20, 24, 30, 40, 50, 60, 64, 65, 70, 90] for _ in range(6)]
    index, found = decontaminate.Index(list(range(len(items))), items), 0
    for i, w in enumerate(items):
        k = decontaminate.allowed(len(w))
        at = {"head": 0, "middle": (len(w) - k) // 2, "tail": len(w) - k}.get(place)
        x = w.copy()
        x[rng.choice(len(w), k, replace=False) if at is None else np.arange(at, at + k)] = draw(k)
        d = np.concatenate([draw(50), x, draw(50)])
        found += any(r[1] == i and r[2] <= k for r in index.verified(d, np.array([0, len(d)])))
    assert found >= 0.9 * len(items), found


def test_vectors_that_share_an_id_are_queries_of_their_own(spark):
    rows = [(100, [0.0, 1.0]), (100, [9.0, 9.0]), (100, [9.0, 9.0]), *((k, [float(k), 1.0]) for k in range(1, 30))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest.nearest(spark, df, k=3).collect()
    lists = sorted([r.vec_id for r in sorted(got, key=lambda r: r.score) if math.isclose(r.score, math.dist(v, (r.vec_id, 1.0)))] for v in ((0.0, 1.0), (9.0, 9.0)))
    assert len(got) == 6 and lists == [[1, 2, 3], [9, 8, 10]]
