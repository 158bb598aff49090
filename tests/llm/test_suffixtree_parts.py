"""The suffix tree in parts: same scores, and no more than a part shuffled at a time."""

import numpy as np
import pytest

from rasterloom.llm import suffixtree
from rasterloom.llm.scratch import Scratch


def test_parts_of_the_corpus_give_the_same_scores(spark, monkeypatch):
    random = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"a{k} b{k} c{k % 5}" for k in random.integers(0, 25, 20))) for i in range(120)] + [(5, None), (7, ""), (None, "a1 b1"), (9, "a1 b1"), (9, "a1 b1")], "doc_id long, text string")
    names, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, release=False: names.append(name) or save(self, df, name, release))
    monkeypatch.setattr(suffixtree, "HOT_SHARE", 0.01)
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.score)
    whole = sorted(suffixtree.language_scores(spark, docs).collect(), key=key)
    assert names.count("grams2") == 1 and [n for n in names if n.startswith("sums")] == ["sums0"]
    names.clear()
    monkeypatch.setattr(suffixtree, "SLICE_TOKENS", 100)
    parts = sorted(suffixtree.language_scores(spark, docs).collect(), key=key)
    assert names.count("grams2") == 2 and [n for n in names if n.startswith("sums")] == ["sums0", "sums1", "sums2", "sums3"]
    assert len(whole) == len(parts) == 125 and len({r.score - r.base_score for r in whole}) > 10
    for a, b in zip(whole, parts, strict=True):
        assert (a.doc_id, a.held_out, a.n_tokens, a.n_known, a.train_tokens) == (b.doc_id, b.held_out, b.n_tokens, b.n_known, b.train_tokens)
        assert (a.base_score, a.score) == pytest.approx((b.base_score, b.score), abs=1e-9)


def test_filter_loses_no_key_and_lets_few_others_pass(spark):
    keys = suffixtree.mix(np.arange(20_000, dtype=np.uint64))
    maybe = suffixtree._maybe(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long"))
    assert maybe.has(keys).all()
    assert maybe.has(suffixtree.mix(np.arange(10**6, 10**6 + 100_000, dtype=np.uint64))).mean() < 0.025
