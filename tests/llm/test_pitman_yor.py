import collections
import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import pitman_yor as py


def tokens(text):
    return [*(text or "").encode().lower().split(), 0]


def out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def brute_base(rows):
    counts = collections.Counter()
    for r in rows:
        if not out(r.doc_id):
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    found = collections.defaultdict(list)
    for r in rows:
        w = tokens(r.text)
        found[r.doc_id].append((len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return found


@pytest.mark.parametrize("frequent", [py.FREQUENT, 50, 1])
def test_base_scores(corpus, awkward, frequent):
    for df in (corpus, awkward):
        want = brute_base(df.collect())
        rows = py.score(df, py.held_out(F.col("doc_id")), frequent, 3, 1).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert any((r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.base_score == pytest.approx(w[3]) for w in want[r.doc_id])
            assert r.held_out == out(r.doc_id) and r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


class Restaurant:
    """Chinese-restaurant seating, one customer at a time."""

    def __init__(self, discount, strength, parent):
        self.d, self.s, self.parent = discount, strength, parent
        self.tables = collections.defaultdict(list)

    def p(self, w):
        t, n = sum(map(len, self.tables.values())), sum(map(sum, self.tables.values()))
        own = self.tables.get(w, [])
        return (sum(own) - self.d * len(own) + (self.s + self.d * t) * self.parent.p(w)) / (self.s + n) if n else self.parent.p(w)

    def add(self, w, rng):
        own, t = self.tables[w], sum(map(len, self.tables.values()))
        at = rng.random() * (sum(own) - self.d * len(own) + (self.s + self.d * t) * self.parent.p(w))
        for i, size in enumerate(own):
            at -= size - self.d
            if at < 0:
                own[i] += 1
                return
        own.append(1)
        self.parent.add(w, rng)

    def remove(self, w, rng):
        own = self.tables[w]
        i = rng.choices(range(len(own)), own)[0]
        own[i] -= 1
        if not own[i]:
            del own[i]
            self.parent.remove(w, rng)


class Uniform:
    def __init__(self, words):
        self.p, self.add, self.remove = (lambda w: 1 / (words + 1)), (lambda w, rng: None), (lambda w, rng: None)


def brute_scores(rows, sweeps, burn_in):
    """The averaged predictive log10 probabilities by Gibbs sampling of single customers."""
    rng = random.Random(7)
    pairs = []
    for r in rows:
        if not out(r.doc_id):
            w = tokens(r.text)
            pairs += zip([None, *w], w)
    root = Restaurant(py.ROOT_DISCOUNT, py.ROOT_STRENGTH, Uniform(len({w for _, w in pairs})))
    of = collections.defaultdict(lambda: Restaurant(py.DISCOUNT, py.STRENGTH, root))
    for u, w in pairs:
        of[u].add(w, rng)
    texts = {r.doc_id: [*zip([None, *tokens(r.text)], tokens(r.text))] for r in rows}
    wanted = {x for t in texts.values() for x in t}
    total = collections.Counter()
    for k in range(sweeps):
        for u, w in pairs:
            of[u].remove(w, rng)
            of[u].add(w, rng)
        if k >= burn_in:
            for u, w in wanted:
                total[u, w] += of[u].p(w)
    return {i: sum(math.log10(total[x] / (sweeps - burn_in)) for x in t) for i, t in texts.items()}


@pytest.mark.parametrize("frequent", [py.FREQUENT, 3])
def test_agrees_with_single_customer_sampling(spark, frequent):
    rng = random.Random(3)
    words = ["a", "b", "b", "c", "c", "c", "d", "e", "f"]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(40)], "doc_id long, text string")
    want = brute_scores(df.collect(), 600, 100)
    got = {r.doc_id: r for r in py.score(df, py.held_out(F.col("doc_id")), frequent, 24, 4).collect()}
    off = [(got[i].score - want[i]) / got[i].n_tokens for i in want]
    assert max(map(abs, off)) < 0.03 and abs(sum(off)) / len(off) < 0.01


def test_looked_up_words_score_alike(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(300))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    all_, few = ({r.doc_id: r.score for r in py.score(df, py.held_out(F.col("doc_id")), k, 8, 2).collect()} for k in (py.FREQUENT, 20))
    assert all_ == pytest.approx(few, rel=0.01)


def test_better_than_the_base_on_held_out_text_and_repeats_stand_out(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    follow = {w: rng.sample(vocabulary, 6) for w in vocabulary}

    def text():
        w, out_ = rng.choice(vocabulary), []
        for _ in range(120):
            out_.append(w)
            w = rng.choice(follow[w])
        return " ".join(out_)

    strange = lambda: " ".join(rng.choice(vocabulary) for _ in range(120))
    rows = [(i, text()) for i in range(200)]
    odd = [strange() for _ in range(20)]
    rows += [(1000 + i, odd[i]) for i in range(20)] + [(2000 + i, odd[i]) for i in range(10)]
    got = py.score(spark.createDataFrame(rows, "doc_id long, text string"), py.held_out(F.col("doc_id"))).collect()
    fresh = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in got if not r.held_out}
    twice = [gain[i] for i in range(1000, 1010) if i in gain and i + 1000 in gain]
    once = [gain[i] for i in range(1010, 1020) if i in gain]
    assert min(twice) > max(once)


def test_predictive_probabilities_sum_to_one(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abbcccdefgh") for _ in range(rng.randrange(90)))) for i in range(40)], "doc_id long, text string")
    model = py.Model(df.withColumn("held_out", py.held_out(F.col("doc_id"))), 1000, 3, 0)
    rows = [(r.bucket, *py.unpack(bytes(r.dishes))) for r in model.pairs.filter(F.col("kind") == py.PAIRS).collect()]
    tables = {bucket: c for bucket, _, c in rows}
    table = model.table
    for k, sweep in enumerate(model.history[1:]):
        assert sweep.p.sum() + sweep.root.unseen == pytest.approx(1.0, rel=1e-5)
        own = table.n.astype(float)  # pairs that stand once have one table
        for bucket, keys, c in rows:
            tables[bucket] = py.seat(keys, c, tables[bucket], table, model.history[k], [42, bucket, k])
            np.add.at(own, table.place(keys >> np.uint64(21)), -py.DISCOUNT * tables[bucket])
        singles = table.n - sum(np.bincount(table.place(keys >> np.uint64(21)), c, minlength=len(own)) for _, keys, c in rows)
        own -= py.DISCOUNT * singles
        whole = (own + py.STRENGTH + py.DISCOUNT * sweep.tables) / (py.STRENGTH + table.n)
        assert whole == pytest.approx(np.ones(len(own)), rel=1e-5)


def test_root_probabilities_sum_to_one():
    root = py.Root(1000)
    customers, words = np.array([1, 2, 5, 70, 400]), np.array([700, 200, 90, 9, 1])
    for k in range(4):
        seated = root.seat(customers, words, np.random.default_rng(k))
        assert (seated.of(customers) * words).sum() + seated.unseen == pytest.approx(1.0)
        assert seated.of(np.array([3]))[0] == seated.unseen


def test_draws_follow_the_weights():
    seats, n = py.Seats(0.6, 5.0), 20_000
    for c in (2, 7, 64):
        t = seats.draw(np.full(n, c), np.ones(n, int), np.full(n, 30.0), np.full(n, 0.02), np.random.default_rng(c))
        want = seats.weights(c, np.array([30.0]), np.array([0.02]))[0]
        assert (1 <= t).all() and (t <= c).all() and t.mean() == pytest.approx((want * np.arange(1, c + 1)).sum(), rel=0.02)


@pytest.mark.parametrize("others,p", [(30.0, 0.02), (5000.0, 0.3), (2.0, 1e-6)])
def test_steps_of_large_dishes_reach_the_weights(others, p):
    c, n = 200, 4000
    seats = py.Seats(0.6, 5.0)
    seats.table = py.log_stirling(c, 0.6)
    want = seats.weights(c, np.array([others]), np.array([p]))[0]
    t, rng = np.full(n, 1.0), np.random.default_rng(0)
    for _ in range(12):
        t = seats.steps(np.full(n, float(c)), t, np.full(n, others), np.full(n, p), rng).astype(float)
    mean = (want * np.arange(1, c + 1)).sum()
    assert t.mean() == pytest.approx(mean, rel=0.03)


@pytest.mark.parametrize("d", [0.5, 0.6])
@pytest.mark.parametrize("c", [65, 150, 1500])
def test_large_stirling_numbers_follow_the_recurrence(c, d):
    t = np.arange(1, c)
    off = py.large_stirling(np.full(c - 1, float(c)), t.astype(float), d) + math.lgamma(c + 1) - py.log_stirling(c, d)[c, 1:c]
    assert np.abs(off[:-8]).max() < 0.02 and np.abs(off).max() < 0.1


def test_log_gamma():
    x = np.array([1e-3, 0.5, 1, 2.5, 7.99, 8, 100, 1e9])
    assert py.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)


def test_packed_arrays():
    rng = np.random.default_rng(0)
    arrays = [np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64)), np.zeros(0, np.uint64), rng.integers(-5, 5, 77).astype(np.int32), np.zeros(0, np.int64), np.arange(3, dtype=np.uint8)]
    for a, b in zip(arrays, py.unpack(py.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_units_and_buckets_do_not_change_scores(spark, corpus, monkeypatch):
    rows = lambda: {(r.doc_id, r.n_tokens): r.score for r in py.score(corpus, py.held_out(F.col("doc_id")), 100, 3, 1).collect()}
    one = rows()
    monkeypatch.setattr(py, "BUCKET", 2_000)
    assert rows() == pytest.approx(one, rel=0.02)


def test_empty(spark, empty):
    assert py.score(empty, py.held_out(F.col("doc_id"))).count() == 0
    none = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert [(r.held_out, r.n_known, r.score) for r in py.score(none, py.held_out(F.col("doc_id"))).orderBy("n_tokens").collect()] == [(True, 0, 0.0)] * 2


def test_pairs_of_a_unit_in_little_memory():
    rng = np.random.default_rng(5)
    own = np.concatenate((np.arange(500, dtype=np.uint64), np.sort(rng.integers(1 << 63, 1 << 64, 500, dtype=np.uint64))))
    index, counts = rng.integers(0, len(own), 1_000_000), np.full(1000, 1000)
    unit = py.Unit(own, index, counts, np.zeros(1000, bool))
    tracemalloc.start()
    found, place, one = unit.pairs()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    codes, before = np.append(own, py._START), np.roll(index, 1)
    before[::1000] = len(own)
    keys = py.pair_keys(codes[before], codes[index])
    for have, want in zip((found, one, place), np.unique(keys, return_index=True, return_inverse=True)):
        assert np.array_equal(have, want)
    assert peak < 45 * len(index)
