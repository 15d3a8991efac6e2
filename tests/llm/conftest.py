import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, row int, bucket int, score double, words string, _odds double"
LONG = "the quick brown fox jumps over the lazy dog and runs away from it all\n" * 4000


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, and columns named like inner ones."""
    texts = [None, "", " \t\n", "one", "one two", "ONE two", "Licensed under the Apache License, Version 2.0.", "  double  blanks \n\n lines ", LONG, "12 + 34 = 46", "ünïcode ßtraße 日本語 текст", "a b\x1cc\x85d"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", None, "s0", ""][i % 4], len(t or ""), i, "k", i, i, 0.5, "w", 1.0) for i, t in enumerate(texts)]
    rows += [rows[4], rows[8], (None, "one two three four five", None, None, None, None, None, None, None, None, None, None), (99, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """Prose of two invented languages with copies, near copies and junk."""
    rng = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi", "tu", "re", "sa"], "bb": ["schn", "unk", "eit", "vor", "ach", "ge"]}
    rows = []
    for i in range(240):
        lang = "aa" if i % 3 else "bb"
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(60, 160)))
        if i % 20 == 7:
            text, lang = rows[-1][1:3]
        if i % 20 == 9:
            text = " | ".join(text.split()[:80])
        rows.append((i, text, lang, f"s{i % 5}", len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 0 if i % 20 == 9 else 1, 0) for i in range(0, 240) if i % 2 or i % 20 == 9], "doc_id long, quality int, toxic int")
