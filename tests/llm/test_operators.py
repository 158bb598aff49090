"""The corpus operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rasterloom.llm import decontaminate, extraction, langid, mixing, nearest, neardup, sharding, substrings, suffixtree, tokenfile
from rasterloom.llm.words import text_chunks, word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls in every column, empty and blank texts, repeated rows, equal texts, one very long text.
AWKWARD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (None, "no id here at all", "en", "a", 1), (5, "The same text of seven words here", "en", "b", 1),
    (5, "The same text of seven words here", "en", "b", 1), (6, "the SAME text of seven words here", "en", None, 1), (7, "word", "de", "c", 4), (8, "lang " * 60_000, "fr", "a", 300_000),
    (9, "\U0001f642 €uro ünïcode 中文 text . ! ?", "de", "c", 9), (10, "$$$ %%% 123", "en", "c", 3),
]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(lower(t))


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(awkward):
    """Extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["size", "key", "node", "kept", "score", "rejected", "lang_pred", "shard", "slot", "law", "component", "bucket", "at", "h1", "_gone_", "target", "rank", "removed"]
    return awkward.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = [r[1] for r in AWKWARD] + ["\x1c a\x85b  c", "", "é A\x0bb"]
    for i, j, data, off in text_chunks(pa.array(texts), 50):
        _, first = word_hashes(data, off)
        assert np.diff(first).tolist() == [len(words(t)) for t in texts[i:j]]


# mixing

def test_mix_report(spark, awkward, empty, clashing):
    assert mixing.mix_report(spark, empty).count() == 0
    got = mixing.mix_report(spark, awkward).collect()
    assert len(got) == len(AWKWARD)
    assert sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t, *_ in AWKWARD)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(spark, clashing).collect()))
    taken, target = defaultdict(int), {}
    full = mixing.mix_report(spark, docs_of(spark).repartition(7)).collect()
    sizes = {r.doc_id: r["size"] for r in full}
    source = {r.doc_id: r.source for r in docs_of(spark).collect()}
    for r in full:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert math.isclose(sum(target.values()), sum(sizes.values()), rel_tol=1e-9)
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(sizes[d] for d in sizes if source[d] == s) / 2 + 1e-6


def test_targets_are_capped_and_reshared(spark):
    sizes = spark.createDataFrame([("a", 1, 10), ("b", 1, 1000), (None, 1, 500)], "source string, n long, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and math.isclose(sum(got.values()), 1510) and math.isclose(got["b"] / got[None], 2)


def test_mix_repeats_rows_as_the_report_says(spark, clashing):
    mixed = mixing.mix(spark, clashing)
    assert mixed.columns == clashing.columns
    times = Counter(r.doc_id for r in mixed.collect())
    for r in mixing.mix_report(spark, clashing).where("size > 0 AND doc_id IS NOT NULL").collect():
        n = 2 if r.doc_id == 5 else 1
        assert times[r.doc_id] == n * r.taken / r["size"]


# main text

def test_main_text_on_held_out_pages():
    crf = extraction.trained()
    held = extraction.labelled_pages(80, seed=1234)
    import html

    want = ["\n".join(" ".join(html.unescape(x).split()) for x in m) for _, m in held]
    assert sum(extraction.main_text(p, crf) == w for (p, _), w in zip(held, want)) >= 76
    assert extraction.main_text(None, crf) == extraction.main_text("", crf) == ""
    page = "<nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;three.<p><b>Open <br> end<script>var x='</p>'</script></article><footer>&copy; foot</footer>"
    assert extraction.main_text(page, crf) == "A & B\nOne two three.\nOpen end"


def test_main_text_tables(spark):
    schema = "page_id long, url string, html string, text string"
    assert extraction.extract(spark, spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "x"), (None, "u", "<<<>", None), (2, "u", "<p>" + "long " * 50_000 + "</p>", ""), (2, "u", "plain text only.", "")]
    got = extraction.extract(spark, spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)


# language ID

def test_language_accuracy_and_awkward_rows(spark, awkward, empty, clashing):
    docs = docs_of(spark)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.language_report(spark, docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    model = langid.train(spark, docs)
    out = langid.predict(spark, clashing, model)
    assert len(out.columns) == len(clashing.columns)
    by = {r.doc_id: r for r in out.collect()}
    assert all(by[k].lang_pred == "und" and by[k].rejected for k in (1, 2, 3, 10)) and by[5].lang_pred == "en"
    assert langid.predict(spark, empty, model).count() == 0
    assert {r.lang_pred for r in langid.language_report(spark, empty.union(awkward.where("doc_id = 7").withColumn("lang", awkward.lang.substr(9, 1)))).collect()} <= {"und", ""}
    clean = langid.predict(spark, docs, model)
    assert clean.where("rejected").count() == 0


def test_model_probabilities_sum_to_one():
    import pyarrow as pa

    letters = langid.Letters()
    _, _, data, off = next(text_chunks(pa.array(["abcab cabba", "bca"])))
    x, first = langid.letters_of(data, off, letters)
    grams = langid.Grams()
    grams.add(x, first)
    model = langid.Model(grams)
    for history in ("ab", "xa", "  "):
        total = 0.0
        for c in "abc ":
            _, _, d, o = next(text_chunks(pa.array([history.strip() + c])))
            y = np.array([ord(k) for k in history + c], np.uint64)
            codes = [langid.gram_codes(y, np.array([0, len(y)]), k)[-1:] for k in range(1, langid.ORDER + 1)]
            hist = [np.zeros(1, np.uint64)] + [langid.gram_codes(y, np.array([0, len(y)]), k)[-2:-1] for k in range(1, langid.ORDER)]
            total += 10 ** model.log_p(codes, hist)[0]
        assert total <= 1 + 1e-9


# token files

def test_token_files(spark, awkward, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    vocab = tokenfile.vocabulary()
    assert tokenfile.token_report(spark, empty, vocab).count() == 0
    for df in (docs_of(spark), awkward):
        got = sorted(tokenfile.token_report(spark, df, vocab).collect(), key=lambda r: r.start)
        ids = [r.doc_id for r in got]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(got) == df.count()
        start = 0
        want = Counter()
        for r in df.collect():
            x = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
            want[r.doc_id, len(x), zlib.crc32(x.tobytes())] += 1
        for r in got:
            assert r.start == start
            start += r.n_tokens
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_file_reads_only_the_frames_asked_for_and_detects_damage():
    ids = [np.arange(k, k + 500, dtype=np.uint32) for k in range(50)]
    raw = tokenfile.pack(list(range(50)), ids, frame_ids=1000)
    r = tokenfile.Reader(raw)
    assert np.array_equal(r.find(31), ids[31]) and r.opened == 1 and r.find(99) is None
    bad = bytearray(raw)
    bad[r.starts[3] + 20] ^= 0xFF
    with pytest.raises(Exception):
        tokenfile.Reader(bytes(bad)).find(7)


def test_encoder_on_adversarial_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r, e = random.Random(3), tokenfile.Encoder(tokenfile.vocabulary())
    signs = [" ", "  ", "\n", "\n\n", "a", "B", "é", " ", " ", "　", "1", "!", "'s", "'", "中", "\t", "\r\n", "€", "<|endoftext|>", "\x1c", "\u0085", "🙂"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(1500)]
    for i, j, data, off in text_chunks(pa.array(texts), 10_000):
        flat, first = e.encode(data, off)
        for k in range(j - i):
            assert flat[first[k] : first[k + 1]].tolist() == t.encode(texts[i + k], add_special_tokens=False).ids


# near duplicates

def components(texts):
    def grams(t):
        w = words(t)
        return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, up = [grams(t) for t in texts], list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("block", [neardup.BLOCK_BYTES, 60_000])
def test_near_duplicates_of_borderline_groups_and_chains(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block)
    r = random.Random(4)
    w = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, texts = [w() for _ in range(120)], []
    for _ in range(120):
        x = list(base)
        for _ in range(r.randint(0, 5)):
            x[r.randrange(len(x))] = w()
        texts.append(" ".join(x))
    x = [w() for _ in range(120)]
    for _ in range(40):
        texts.append(" ".join(x))
        x[r.randrange(120)] = w()
    texts += [" ".join(w() for _ in range(r.randint(0, 20))) for _ in range(40)] + [texts[5]] * 15 + [None, ""]
    r.shuffle(texts)
    got = sorted(neardup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect())
    comp, sizes = components(texts)
    assert [g.component_id for g in got] == comp and [g.n_shingles for g in got] == sizes
    assert all(g.kept == (g.doc_id == g.component_id) for g in got)


def test_near_duplicates_awkward(spark, awkward, empty, clashing):
    assert neardup.near_duplicates(spark, empty).count() == 0
    got = neardup.near_duplicates(spark, clashing).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert by[6].component_id == 5 and not by[6].kept and by[1].n_shingles == 0 and by[1].kept and by[8].n_shingles == 1
    left = neardup.drop_duplicates(spark, clashing)
    assert left.columns == clashing.columns and {r.doc_id for r in left.collect()} == {1, 2, 3, None, 5, 7, 8, 9, 10}


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        n = 4000
        common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        own = lambda: rng.integers(0, 1 << 63, (n - len(common)) // 2, dtype=np.uint64)
        a, b = np.concatenate([common, own()]), np.concatenate([common, own()])
        m = neardup.minima(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        sig = neardup.pack_bits(m)
        assert abs(neardup.estimate(sig[0], sig[1]) - share) < 0.17


# nearest neighbours

def test_nearest_recall_ties_and_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 16)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (5400, [1.0, 2.0], 0), (5401, [1.0, 2.5], 0), (5500, [], 0), (5600, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in nearest.nearest(spark, df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {*range(0, 3000, 100), 5400}
    assert [i for i, _ in got[5400]] == [5401] and got[5400][0][1] == 0.5
    assert [i for i, _ in got[100]] == list(range(101, 111))
    found = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        found += len(set(np.lexsort((np.arange(3000), d))[:10]) & {i for i, _ in got[q]})
        assert all(abs(s - d[i]) < 1e-12 for i, s in got[q])
    assert found / 300 >= 0.9
    assert nearest.nearest(spark, df.limit(0)).count() == 0


def test_nearest_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 700)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 7)
    v = np.random.default_rng(3).normal(size=(4000, 24)).astype(np.float32)
    got = defaultdict(list)
    for r in nearest.nearest(spark, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    found = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        found += len(set(np.argsort(d)[:10]) & {i for i, _ in got[q]})
        assert len(got[q]) == 10 and all(abs(s - d[i]) < 1e-12 for i, s in got[q])
    assert len(got) == 40 and found / 400 >= 0.9


# decontamination

PLACES = {"head": (0, 0.35), "first half": (0, 0.5), "middle": (0.25, 0.75), "tail": (0.6, 1), "spread": (0, 1)}


@pytest.mark.parametrize("length", [*range(7, 41), 47, 54, 60, 64, 65, 80, 100, 200, 500, "mixed"])
def test_recall_at_the_allowed_edits_by_length_and_place(length):
    """Words replaced, inserted and deleted in each part of the item; one pooled index a length, and one of all lengths together."""
    rng = np.random.default_rng(5)
    draw = lambda n: decontaminate.mix(rng.integers(1, 1 << 62, n).astype(np.uint64))
    trials = 50 if length == "mixed" else 30 if length < 100 else 12
    items = [draw(n) for n in (rng.integers(7, 101, trials) if length == "mixed" else [length] * trials)]
    index = decontaminate.Index(list(range(trials)), items)
    for (place, (lo, hi)), kind in itertools.product(PLACES.items(), ("replaced", "inserted", "deleted")):
        texts = []
        for w in items:
            k, x = decontaminate.allowed(len(w)), list(w)
            a = min(int(lo * len(w)), len(w) - k)
            for at in sorted(rng.choice(np.arange(a, max(a + k, int(hi * len(w)))), k, replace=False), reverse=True):
                x[at : at + (kind != "inserted")] = [] if kind == "deleted" else draw(1).tolist()
            texts.append(np.concatenate([draw(20), np.array(x, np.uint64), draw(20)]))
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = {(r[0], r[1]) for r in index.verified(np.concatenate(texts), first) if r[2] <= decontaminate.allowed(len(items[r[1]]))}
        assert sum((i, i) in found for i in range(trials)) >= 0.9 * trials, (place, kind)


def test_long_items_are_found_wherever_the_edits_are():
    rng = np.random.default_rng(6)
    vocab = decontaminate.mix(np.arange(1, 3001, dtype=np.uint64))
    p = 1 / np.arange(1, 3001)
    p /= p.sum()
    draw = lambda n: vocab[rng.choice(3000, n, p=p)]
    items = [draw(n) for n in (100, 200, 300, 400, 800, 1000) for _ in range(4)]
    index = decontaminate.Index(list(range(len(items))), items)
    for place in ("head", "middle", "tail", "even"):
        for cut in (False, True):
            found = 0
            for i, w in enumerate(items):
                k = decontaminate.allowed(len(w))
                at = {"head": 0, "middle": (len(w) - k) // 2, "tail": len(w) - k}.get(place)
                where = rng.choice(len(w), k, replace=False) if at is None else np.arange(at, at + k)
                x = w.copy()
                x[where] = draw(k)
                x = np.delete(x, where) if cut else x
                d = np.concatenate([draw(50), x, draw(50)])
                found += any(r[1] == i and r[2] <= k for r in index.verified(d, np.array([0, len(d)])))
            assert found >= 0.9 * len(items), (place, cut, found)


def test_closest_is_the_edit_distance():
    r = random.Random(9)
    for _ in range(60):
        w, t = [r.randint(1, 4) for _ in range(r.randint(1, 7))], [r.randint(1, 4) for _ in range(r.randint(0, 9))]
        row = [0] * (len(t) + 1)
        for i, x in enumerate(w, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        assert decontaminate.closest(np.array(w, np.uint64), np.array(t, np.uint64))[0] == min(row)


def test_contaminations(spark, awkward, empty, clashing):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contaminations(spark, empty, items).count() == 0
    assert decontaminate.contaminations(spark, awkward, items.limit(0)).count() == 0
    own = spark.createDataFrame([(1, "text OF seven words here"), (2, "word"), (3, None), (None, "the same text of seven words"), (4, "lang " * 40)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits, r.start_word) for r in decontaminate.contaminations(spark, clashing, own).collect()}
    assert got == {(5, 1, 0, 2), (6, 1, 0, 2), (7, 2, 0, 0), (8, 4, 0, 0)}
    left = decontaminate.decontaminate(spark, clashing, own)
    assert left.columns == clashing.columns and {r.doc_id for r in left.collect()} == {1, 2, 3, None, 9, 10}
    docs, bench = docs_of(spark).collect(), items.collect()
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(spark, docs_of(spark), items).collect()}
    for d in docs:
        text = " " + " ".join((d.text or "").lower().split()) + " "
        for b in bench:
            if f" {' '.join(b.text.lower().split())} " in text:
                assert (d.doc_id, b.item_id) in found


# sharding

def test_sharding(spark, awkward, empty, clashing):
    for n in (1, 2, 7, 100, 4097):
        assert sorted(sharding.permute(np.arange(n), n).tolist()) == list(range(n))
    assert sharding.shard(spark, empty).count() == 0
    docs = docs_of(spark)
    got = sharding.shard_report(spark, docs.repartition(5)).collect()
    slots = defaultdict(list)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in got:
        slots[r.shard].append(r.slot)
        assert r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None
    sizes = [len(slots[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard_report(spark, docs.repartition(2)).collect()))
    place = sharding.permute(np.arange(len(got)), len(got))
    by = {r.doc_id: r for r in got}
    assert all((by[d].shard, by[d].slot) == (p % 8, p // 8) for d, p in zip(sorted(by), place))
    assert sharding.shard(spark, clashing).count() == len(AWKWARD)


# language-model scores

def test_scores(spark, awkward, empty, clashing):
    assert suffixtree.language_scores(spark, empty).count() == 0
    for df in (docs_of(spark), awkward):
        rows = df.collect()
        held = {r.doc_id: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
        counts = Counter(w for r in rows if not held[r.doc_id] for w in [*words(r.text), "\0end"])
        n, v = sum(counts.values()), len(counts)
        base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), "\0end"])
        want = sorted((str(r.doc_id), held[r.doc_id], len(words(r.text)) + 1, sum(counts[w] > 0 for w in [*words(r.text), "\0end"]), n, round(base(r.text), 4)) for r in rows)
        got = suffixtree.language_scores(spark, df).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert suffixtree.language_scores(spark, clashing).count() == len(AWKWARD)


def test_tree_distributions_sum_to_one():
    r = random.Random(1)
    vocab = decontaminate.mix(np.arange(1, 31, dtype=np.uint64))
    t = np.array([vocab[0] if i % 3 else vocab[r.randrange(30)] for i in range(6000)], np.uint64)
    w, n = np.unique(t, return_counts=True)
    pairs = Counter(zip(t[:-1].tolist(), t[1:].tolist()))
    triples = Counter(zip(t[:-2].tolist(), t[1:-1].tolist(), t[2:].tolist()))
    key = lambda c, k: (suffixtree.chain(*np.array(list(c), np.uint64).reshape(-1, k).T), np.array(list(c.values())))
    hits = {1: w[:, None], 2: np.array(list(pairs), np.uint64), 3: np.array(list(triples), np.uint64)}
    tree = suffixtree.Tree(hits, {1: (w, n), 2: key(pairs, 2), 3: key(triples, 3)}, len(t), len(w))
    assert len(tree.states[0][0].keys) > 0
    unseen = 0.1 / (len(t) + 0.1 * (len(w) + 1))
    for before in ([vocab[0]], [vocab[0], vocab[0]], [vocab[3], vocab[0]]):
        total = 0.0
        for x in [*w, np.uint64(12345)]:
            seq = np.array([*before, x], np.uint64)
            at, added, open_ = tree.score(seq, np.array([0, len(seq)]))
            base = tree.base[at[-1]] if at[-1] >= 0 else math.log10(unseen)
            total += 10 ** (added[-1] + (base if open_[-1] else 0.0))
        assert abs(total - 1) < 1e-9


def test_scores_are_those_of_the_tree_of_counts(spark):
    """Against the tree in dictionaries, with contexts of three words and of a share under 1e-4."""
    r = random.Random(3)
    fresh = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(n))
    grammar = {}
    texts = [fresh(5000) for _ in range(60)]
    for _ in range(400):
        x = ["a", "b"]
        while len(x) < 30:
            x.append(grammar.setdefault(tuple(x[-3:]), r.choice("abcdef")) if r.random() < 0.8 else r.choice("abcdef"))
        texts.append(" ".join(x))
    texts += ["seldom seen pair " + fresh(3) for _ in range(15)]
    rows = list(enumerate(texts)) + [(10_000 + k, "seldom seen pair") for k in range(30)]
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    rows = [x for x in rows if x[0] < 10_000 or held[x[0]]]
    counts = [Counter() for _ in range(suffixtree.ORDER + 1)]
    for d, text in rows:
        if not held[d]:
            x = [*words(text), "\0end"]
            for k in range(1, suffixtree.ORDER + 1):
                counts[k].update(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    n = sum(counts[1].values())
    p = {(): defaultdict(lambda: 0.1 / (n + 0.1 * (len(counts[1]) + 1)), {w: (c + 0.1) / (n + 0.1 * (len(counts[1]) + 1)) for (w,), c in counts[1].items()})}
    back = {}

    def prob(state, w):
        while state and state not in back:
            state = state[1:]
        return p[()][w] if not state else p[state][w] if w in p[state] else back[state] * prob(state[1:], w)

    for k in range(1, suffixtree.ORDER):
        after = defaultdict(dict)
        for g, c in counts[k + 1].items():
            if c >= suffixtree.NEXT_COUNT:
                after[g[:-1]][g[-1]] = c
        for state, kids in after.items():
            c = counts[k][state]
            if c < suffixtree.CONTEXT_COUNT or (k > 1 and state[1:] not in back):
                continue
            low = {w: prob(state[1:], w) for w in kids}
            rest, rest_p = c - sum(kids.values()), max(1 - sum(low.values()), 1e-9)
            ratio = sum(m * math.log(m / (c * low[w])) for w, m in kids.items()) + (rest * math.log(rest / (c * rest_p)) if rest else 0.0)
            if 2 * ratio >= suffixtree.DIVERGENCE * (len(kids) + 1):
                p[state] = {w: (m + suffixtree.WEIGHT * low[w]) / (c + suffixtree.WEIGHT) for w, m in kids.items()}
                back[state] = (rest + suffixtree.WEIGHT * rest_p) / (c + suffixtree.WEIGHT) / rest_p
    assert {len(s) for s in back} == {1, 2, 3} and ("seldom", "seen") in p and counts[2]["seldom", "seen"] < 1e-4 * n
    got = {r.doc_id: r for r in suffixtree.language_scores(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for d, text in rows:
        x = [*words(text), "\0end"]
        assert math.isclose(got[d].score, sum(math.log10(prob(tuple(x[max(0, i - 3) : i]), w)) for i, w in enumerate(x)), abs_tol=1e-6)
        assert d < 10_000 or got[d].score > got[d].base_score + 2


# substrings

def test_substrings_against_brute_force(spark, awkward, empty, clashing):
    assert substrings.dedup_substrings(spark, empty).count() == 0
    r = random.Random(2)
    sent = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(r.randint(3, 14))).capitalize() + "."
    passage = [sent() for _ in range(8)]
    texts = []
    for k in range(40):
        own = [sent() for _ in range(r.randint(2, 9))]
        if k % 3 == 0:
            at = r.randint(0, len(own))
            own[at:at] = passage
        texts.append(r.choice([" ", "\n", "  "]).join(own))
    got = {x.doc_id: x for x in substrings.dedup_substrings(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    seen, gone = {}, defaultdict(set)
    for d, t in enumerate(texts):
        ss = [s for s in re.split(r"(?<=\.)\s+", t) if s]
        for i, k in itertools.product(range(len(ss)), (2, 3)):
            run = ss[i : i + k]
            if len(run) == k and (k == 3 or len(" ".join(run).split()) >= substrings.SPAN_WORDS):
                key = tuple(" ".join(run).lower().split())
                if key in seen:
                    gone[d].update(range(i, i + k))
                seen.setdefault(key, (d, i))
        assert got[d].n_sentences == len(ss) and got[d].n_removed == len(gone[d])
        assert got[d].text.split() == [w for i, s in enumerate(ss) if i not in gone[d] for w in s.split()]
    assert sum(map(len, gone.values())) >= 8 * 13
    out = substrings.dedup_substrings(spark, clashing).collect()
    assert len(out) == len(AWKWARD) and {x.doc_id: x.text for x in out}[1] is None


def test_three_short_sentences_are_a_run(spark):
    r = random.Random(3)
    some = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(5)) + "."
    shared = [some() for _ in range(3)]
    rows = [(d, " ".join([some(), some(), *shared, some(), some()])) for d in range(6)]
    got = substrings.dedup_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_removed for x in got} == {d: 3 * (d > 0) for d in range(6)}


def test_passages_spliced_into_sentences_are_found_at_any_offset(spark):
    r = random.Random(8)
    some = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage = some(70)
    own = [(some(k), some(r.randint(0, 40))) for k in range(50)]
    rows = [(d, " ".join([*a, *passage, *z])) for d, (a, z) in enumerate(own)]
    for x in substrings.dedup_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        a, z = own[x.doc_id]
        left = x.text.split()
        assert left[: len(a)] == a and left[len(left) - len(z) :] == z
        assert len(left) == len(a) + 70 + len(z) if x.doc_id == 0 else len(left) <= len(a) + 70 + len(z) - 25
