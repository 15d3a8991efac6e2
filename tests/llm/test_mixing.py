import collections
import math

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([10, 1000], [3, 1]) == [20.0, pytest.approx(1495.0)]
    assert mixing.targets([0, 10], [3, 1], 1.5) == [0.0, 15.0]
    assert mixing.targets([], []) == []


def test_expected_copies_meet_the_target():
    sizes = {1: 40, 5: 300, 9: 900}
    for target in (0.0, 100.0, 1240.0, 2300.0, 2480.0):
        e = mixing.expected(sizes, target)
        assert sum(sizes[k] * e[k] for k in sizes) == pytest.approx(target) and max(e.values()) <= 2 + 1e-12


def words(text):
    return len((text or "").encode().split())


def test_mix(corpus, awkward):
    for df in (corpus, awkward):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        texts = collections.Counter((r.doc_id, words(r.text)) for r in df.collect())
        assert collections.Counter((r.doc_id, r.size) for r in rows) == texts
        sizes, taken = collections.Counter(), collections.Counter()
        for r in rows:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 2 * r.size
        names = sorted(sizes, key=lambda x: (x is None, x or ""))
        want = mixing.targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
        for r in rows:
            assert r.target == pytest.approx(want[names.index(r.source)]) and r.source_size == sizes[r.source]
        for n, w in zip(names, want):
            assert abs(taken[n] - w) <= 1
        key = lambda r: (r.doc_id is None, r.doc_id, r.taken)
        assert sorted(mixing.mix(df.repartition(7)).collect(), key=key) and sorted(map(key, mixing.mix(df.repartition(7)).collect())) == sorted(map(key, rows))


def test_order_is_pareto(corpus):
    """Within a source and class the extra copies go to the smallest hashes; all but one of a source are whole."""
    rows = mixing.mix(corpus).collect()
    for source in {r.source for r in rows}:
        part = [r.taken % r.size for r in rows if r.source == source]
        assert sum(1 for x in part if x) <= 1


def test_many_sources_are_joined_without_a_broadcast(corpus, monkeypatch):
    key = lambda r: (r.doc_id, r.taken)
    want = sorted(map(key, mixing.mix(corpus).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(key, mixing.mix(corpus).collect())) == want


def test_selection_against_a_plain_sort(spark, corpus):
    """The same hashes, sorted without bins."""
    u = {r.doc_id: r.u for r in corpus.select("doc_id", ((F.shiftrightunsigned(F.xxhash64(F.lit(42), F.col("doc_id")), 11) + 0.5) / float(1 << 53)).alias("u")).collect()}
    rows = mixing.mix(corpus).collect()
    for source in {r.source for r in rows}:
        part = [r for r in rows if r.source == source]
        klass = {r.doc_id: int(math.log2(r.size + 1)) for r in part}
        sizes = collections.Counter()
        for r in part:
            sizes[klass[r.doc_id]] += r.size
        e = mixing.expected(sizes, part[0].target)
        whole = {r.doc_id: math.floor(e[klass[r.doc_id]]) * r.size for r in part}
        rest, want = round(part[0].target) - sum(whole.values()), dict(whole)
        odds = lambda i: u[i] / (1 - u[i]) / ((p := e[klass[i]] % 1) / (1 - p))
        for r in sorted((r for r in part if e[klass[r.doc_id]] % 1), key=lambda r: (odds(r.doc_id), r.doc_id)):
            take = max(0, min(r.size, rest))
            want[r.doc_id] += take
            rest -= take
        assert {r.doc_id: r.taken for r in part} == want


def test_copies(spark, corpus, empty):
    mixed = mixing.mix(corpus)
    out = mixing.copies(mixed).select("doc_id", "text").collect()
    got = collections.Counter()
    for r in out:
        got[r.doc_id] += words(r.text)
    assert got == collections.Counter({r.doc_id: r.taken for r in mixed.collect() if r.taken})
    assert mixing.mix(empty).count() == 0
    one = spark.createDataFrame([(1, "  a b\n c ", 5, 3)], "doc_id long, text string, taken long, size long")
    assert [r.text for r in mixing.copies(one).collect()] == ["  a b\n c ", "a b"]
    assert mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")).select(F.sum("taken")).first()[0] == 0


def test_null_ids_and_repeated_rows(spark):
    """Rows of null doc_id are told apart by their texts; reruns with other partitions take the same."""
    rows = [(None, "s", " ".join(f"w{i}" for i in range(5 + k % 7)) + f" {k}") for k in range(59)] + [(7, "s", "a b c d")] * 9 + [(None, "t", None), (None, None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    key = lambda r: (r.text or "", r.taken)
    want = sorted(map(key, mixing.mix(df).collect()))
    assert all(sorted(map(key, mixing.mix(df.repartition(n)).collect())) == want for n in (1, 5))
    part = [r for r in mixing.mix(df).collect() if r.source == "s"]
    assert abs(sum(r.taken for r in part) - part[0].target) <= 9


def test_ranks_of_one_bin_are_cut_again(corpus, monkeypatch):
    key = lambda r: (r.doc_id, r.taken)
    want = sorted(map(key, mixing.mix(corpus).collect()))
    for bins in (1, 3):
        monkeypatch.setattr(mixing, "BINS", bins)
        assert sorted(map(key, mixing.mix(corpus).collect())) == want
