import random

import pytest
import xxhash

from quarry.llm import graph, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(grams))


def brute_components(points):
    """Least point of each component, links at 3 bits or fewer."""
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    order = sorted(points)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in points}


@pytest.mark.parametrize("full", [1, 3, 64])
def test_links_connect_all_within_three_bits(spark, full):
    rng = random.Random(full)
    points = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(20):  # a walk: a long component of small steps, and points just too far
            points.add(p)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                p ^= 1 << b
    hub = rng.getrandbits(64)
    points |= {hub ^ (1 << i) ^ (1 << j) for i in range(10) for j in range(i)}  # many around one word
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    want = brute_components(points)
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    found = simhash.links(df, full).collect()
    for r in found:
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 3
    root = {signed(p): signed(p) for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in found:
        root[find(r.a)] = find(r.b)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({p: find(p) for p in root}) == groups({signed(k): signed(v) for k, v in want.items()})


def test_documents(awkward, corpus, empty):
    for df in (awkward, corpus):
        rows = simhash.near_duplicates(df).collect()
        docs = df.collect()
        prints = {}
        for d in docs:
            prints.setdefault(d.doc_id, brute_fingerprint(d.text))
        least = brute_components(set(prints.values()))
        first = {}
        for i, p in prints.items():
            if i is not None:
                first[least[p]] = min(i, first.get(least[p], i))
        assert len(rows) == len(docs)
        for r in rows:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}"
            assert r.component_id == first.get(least[prints[r.doc_id]])
    assert simhash.near_duplicates(empty).count() == 0


def test_one_document_of_each_group_stays(corpus):
    kept = simhash.keep_first(corpus)
    groups = simhash.near_duplicates(corpus).select("component_id").distinct().count()
    assert kept.columns == corpus.columns and kept.count() == groups < corpus.count()


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 102), (102, 101), (7, 7), (None, 5), (200, 300), (300, 200)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
