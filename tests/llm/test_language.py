import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import language, scan


def brute_viterbi(score, switch):
    best = None
    for path in itertools.product(range(score.shape[1]), repeat=len(score)):
        value = sum(score[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
        if best is None or value > best[0] + 1e-9:
            best = (value, path)
    return best[0]


def test_decoding_against_all_paths():
    rng = np.random.default_rng(1)
    counts = np.array([5, 0, 7, 1, 6])
    score = rng.normal(0, 3, (counts.sum(), 3))
    got = language.decode(score, counts, 2.0)
    at = 0
    for n in counts:
        path, part = got[at : at + n], score[at : at + n]
        if n:
            value = sum(part[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
            assert value == pytest.approx(brute_viterbi(part, 2.0))
        at += n


def test_held_out_accuracy_and_spans(spark, corpus):
    model = language.learn(language.learnable(corpus, language.held_out(F.col("doc_id"))))
    rows = language.identify(corpus, model).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang and r.score > 0.9 for r in rows)
    aa, bb = (corpus.filter(F.col("lang") == x).first().text for x in ("aa", "bb"))
    (r,) = language.identify(spark.createDataFrame([(1, f"{aa}\n{bb}\n{aa}")], "doc_id int, text string"), model).collect()
    assert [s.lang for s in r.spans] == ["aa", "bb", "aa"]
    assert r.spans[1].first_word == len(aa.split()) and r.lang_pred == "aa"


def test_scripts_narrow(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    rows = [(i, " ".join(word("абвгд" if i % 2 else "abcde") for _ in range(30)), "ru" if i % 2 else "xx") for i in range(20)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang"))
    (_, block), = scan.blocks(pa.array(["жжж яяя zzz", "12 34", "日本"]), lower=True)
    lang, score, labels, counts = language.label(block, model)
    assert [*lang] == [0, -1, lang[2]] and lang[2] >= 0 and score[1] == 0


def test_edges(awkward, empty):
    nothing = language.learn(language.learnable(empty, language.held_out(F.col("doc_id"))))
    assert {(r.lang_pred, r.score) for r in language.identify(awkward, nothing).collect()} == {("und", 0.0)}
    model = language.learn(language.learnable(awkward, F.lit(False)))
    texts = {r.doc_id: r.text for r in awkward.collect()}
    rows = language.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        lettered = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
        assert bool(r.spans) == lettered
    assert language.identify(empty, model).count() == 0
    assert language.keep_identified(awkward, model).columns == awkward.columns
