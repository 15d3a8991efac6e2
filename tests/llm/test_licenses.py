import random

from quarry.llm import licenses


def brute(text):
    words = licenses._plain(text or "")
    have = set(zip(*(words[i:] for i in range(5))))
    out = {}
    for name, template in licenses.TEMPLATES.items():
        own = licenses._plain(template)
        grams = set(zip(*(own[i:] for i in range(5))))
        out[name] = len(grams & have) / len(grams)
    return out


def test_against_all_shingles(spark):
    rng = random.Random(3)
    prose = lambda n: [rng.choice(["la", "mer", "der", "wald", "software", "license", "permission", "of", "the"]) for _ in range(n)]
    texts = []
    for name, template in licenses.TEMPLATES.items():
        for _ in range(4):
            notice = template.split()
            if len(notice) > 20:  # a few words changed or put in, up to what 80 % allow
                for _ in range(rng.randint(0, 2)):
                    notice[rng.randrange(len(notice))] = "changed"
            texts.append(" ".join([*prose(rng.randint(0, 90)), *notice, *prose(rng.randint(0, 90))]).upper() if rng.random() < 0.3 else "\n".join([" ".join(prose(50)), " ".join(notice), " ".join(prose(30))]))
    texts += [" ".join(prose(400)), "", None, "license", "Licensed under"]
    df = spark.createDataFrame([(i, t, "m", "own", 1) for i, t in enumerate(texts)], "doc_id long, text string, license string, own string, n int")
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(df).collect()}
    sure = {(i, k): v for i, t in enumerate(texts) for k, v in brute(t).items() if v >= 0.8}
    assert set(got) <= set(sure)
    missed = {x: sure[x] for x in sure if x not in got}
    assert all(v < 0.9 for v in missed.values())  # a changed notice may be spread over two windows
    assert len(missed) <= 0.05 * len(sure)


def test_anchors_stand_in_over_a_fifth_of_the_shingles():
    marks = set(licenses.anchors(licenses.TEMPLATES))
    for template in licenses.TEMPLATES.values():
        own = licenses._plain(template)
        grams = list(zip(*(own[i:] for i in range(5))))
        assert sum(bool(marks & set(g)) for g in grams) > 0.2 * len(grams)


def test_edges(awkward, empty):
    rows = licenses.scan(awkward).collect()
    assert {(r.doc_id, r.license) for r in rows} == {(6, "Apache-2.0")}
    assert licenses.scan(empty).count() == 0
