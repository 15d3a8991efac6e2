import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import quality, scan


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def figures(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_rules(spark, awkward, corpus):
    for df in (awkward, corpus):
        rows = quality.assess(df, np.zeros(64), -1.0).collect()
        texts = collections.defaultdict(list)
        for r in df.collect():
            texts[r.doc_id].append(brute(r.text))
        assert len(rows) == df.count()
        for r in rows:
            assert figures(r) in texts[r.doc_id]
            assert r.kept == (not r.base_failed)


def test_ratio_against_brute_force(corpus, labels):
    docs, buckets = corpus.collect(), 512
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    counts = {True: collections.Counter(), False: collections.Counter()}
    grams = {}
    for d in docs:
        ((_, block),) = scan.blocks(pa.array([d.text]))
        begin, end, _ = block.words()
        h = [int(x) for x in block.hashes(begin, end)]
        both = scan.mix(np.array([(a * 3 + b) % (1 << 64) for a, b in zip(h, h[1:])], np.uint64))
        grams[d.doc_id] = [(x >> 32) % buckets for x in h] + [(int(x) >> 32) % buckets for x in both]
        counts[False].update(grams[d.doc_id])
        if d.doc_id in good:
            counts[True].update(grams[d.doc_id])
    raw, target = sum(counts[False].values()), sum(counts[True].values())
    ratio = lambda b: math.log((counts[True][b] + 1) / (target + buckets)) - math.log((counts[False][b] + 1) / (raw + buckets))
    table = quality.fit(corpus, np.array(sorted(good)), buckets)
    for r in quality.assess(corpus, table, 0.0).collect():
        want = sum(map(ratio, grams[r.doc_id])) / len(grams[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= 0)


def test_learned_threshold_and_filter(corpus, labels):
    table, cut = quality.learn(corpus, labels)
    kept = {r.doc_id for r in quality.keep_documents(corpus, table, cut).collect()}
    assert kept == {i for i in range(240) if i % 20 != 9}


def test_edges(spark, awkward, empty, labels):
    table, cut = quality.learn(empty, labels)
    assert not table.any() and cut == -math.inf
    assert quality.assess(empty, table, cut).count() == 0
    table, cut = quality.learn(awkward, labels.limit(0))
    assert quality.keep_documents(awkward, table, cut).columns == awkward.columns
    assert quality.best_cut(np.array([1.0, 2.0, 3.0]), np.array([False, True, True])) == 1.5
    assert quality.best_cut(np.array([1.0, 1.0]), np.array([False, True])) == -math.inf


def test_unseen_scores_leave_a_document_out(corpus, labels):
    trusted = np.array(sorted(r.doc_id for r in labels.collect() if r.quality == 1))
    raw, target = quality.sums(corpus, trusted, 512)
    got = {r.doc_id: r.score for r in quality.unseen_scores(corpus, raw, target, trusted).collect()}
    plain = {r.doc_id: r.score for r in quality.assess(corpus, quality.ratios(raw, target), 0.0).collect()}
    for i in (0, 1, 3, 11):
        if i in trusted:
            _, without = quality.sums(corpus, trusted[trusted != i], 512)
            want = {r.doc_id: r.score for r in quality.assess(corpus.filter(f"doc_id = {i}"), quality.ratios(raw, without), 0.0).collect()}[i]
            assert got[i] == pytest.approx(want) and got[i] < plain[i]
        else:
            assert got[i] == pytest.approx(plain[i])


def test_good_documents_without_label_are_kept(spark):
    """Held-out labels: the rate of good documents kept is that of the rows the threshold was fitted on."""
    path = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    table, cut = quality.learn(docs, known.filter("doc_id % 2 = 0"))
    kept = {r.doc_id: r.kept for r in quality.assess(docs, table, cut).filter("NOT base_failed").collect()}
    good = {half: [kept[r.doc_id] for r in known.filter("quality = 1").collect() if r.doc_id % 2 == half and r.doc_id in kept] for half in (0, 1)}
    bad = [kept[r.doc_id] for r in known.filter("quality = 0").collect() if r.doc_id % 2 and r.doc_id in kept]
    rate = {half: sum(x) / len(x) for half, x in good.items()}
    assert rate[1] > 0.9 and rate[0] - rate[1] < 0.08, (rate, sum(bad) / max(1, len(bad)))


def test_contradicting_labels_and_null_ids(spark, awkward):
    known = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in quality.labelled(known).collect()] == [(2, 1)]
    big = spark.createDataFrame([((1 << 53) + 1, "a b c"), ((1 << 53) + 2, "d e f"), (None, "g h i")], "doc_id long, text string")
    raw, target = quality.sums(big, np.array([(1 << 53) + 1]), 1 << 12)
    assert target.sum() == 5 and raw.sum() == 15
