import collections
import math
from pathlib import Path


import corpus_pipeline
from pyspark.sql import functions as F
from quarry.llm import mixing, packing, simhash
from quarry.llm.queries import VOCABULARY


def test_stages_against_a_plain_version(spark, corpus, labels, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert names == ("language ID", "quality rules", "SimHash near-dedup", "mixing sources to target weights", "packing")
    step = [docs]
    for f in stages:
        step.append(f(spark, step[-1], str(tmp_path)).persist())
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in step[:5]]
    assert all(s.columns == docs.columns for s in step[:5])
    assert ids[1] == ids[0]  # every text has a language
    assert ids[2] == [i for i in ids[1] if i % 20 != 9]  # the junk goes, all else stays
    prints = collections.defaultdict(list)
    for r in step[2].collect():
        prints[simhash.fingerprint(r.text.encode())].append(r.doc_id)
    links = list(prints)
    root = {p: p for p in links}
    for i, a in enumerate(links):
        for b in links[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = root[a], root[b]
                root = {k: (y if v == x else v) for k, v in root.items()}
    least = {}
    for p, members in prints.items():
        least[root[p]] = min([*members, least.get(root[p], math.inf)])
    assert ids[3] == sorted(least.values())
    sizes = collections.Counter()
    for r in step[3].collect():
        sizes[r.source] += len(r.text.split())
    want = dict(zip(sorted(sizes), mixing.targets([sizes[s] for s in sorted(sizes)], [(3, 1, 2)[i % 3] for i in range(len(sizes))])))
    taken = collections.Counter()
    for r in step[4].collect():
        taken[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    tool = packing.Tokens(Path(VOCABULARY).read_text())
    tokens = sum(len(tool.ids(r.text)) // 4 + 1 for r in step[4].collect())
    rows = step[5].collect()
    assert sum(r.length for r in rows) == tokens
    assert max(collections.Counter(r.sequence_id for r in rows).values()) <= packing.SEGMENTS
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r.length for r in whole.collect()) == tokens


def test_pieces_of_repeated_documents_hold_their_ids(spark, corpus):
    docs = corpus.limit(30).unionAll(corpus.limit(3)).coalesce(1)
    rows = corpus_pipeline.packing_sequences(spark, docs, "").collect()
    tool = packing.Tokens(Path(VOCABULARY).read_text())
    ends = [list(memoryview(tool.ids(r.text) + b"\0\0\0\0").cast("I")) for r in docs.collect()]
    found = sorted(i for r in rows for i in r.ids)
    assert all(len(r.ids) == r.length for r in rows) and found == sorted(i for e in ends for i in e)


def test_nulls_empties_long_texts_repeats_and_clashing_names(spark, corpus, awkward, labels, empty, tmp_path):
    """Rows of all odd kinds among clean ones; columns named like inner ones; no crash, and each stage's defined result."""
    plain = corpus.filter("doc_id % 20 NOT IN (7, 9)").limit(60)
    clean = plain.select(F.lit(None).cast("long").alias("doc_id"), F.concat("text", F.lit(" "), F.reverse("text")).alias("text"), "lang", "source", "n_chars").limit(3)
    some = plain.unionByName(clean).unionByName(plain.limit(4))  # null ids and repeated rows
    docs = some.unionByName(awkward, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    step = [docs]
    for name, f in corpus_pipeline.STAGES[:4]:
        step.append(f(spark, step[-1], f"{tmp_path}/a").persist())
        assert step[-1].columns == docs.columns, name
    texts = [sorted((r.doc_id is None, r.doc_id, r.text or "") for r in s.select("doc_id", "text").collect()) for s in step]
    lettered = [t for t in texts[0] if any(c.isalpha() for c in t[2])]
    assert texts[1] == lettered or set(texts[1]) <= set(lettered)
    assert len(texts[3]) == len(set(texts[3])) == len(set(t[2] for t in texts[2]))  # equal rows once, no other text lost here
    assert sum(t[0] for t in texts[3]) == 3  # clean rows of null ids stay
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 0
    empty.write.parquet(f"{tmp_path}/b/documents.parquet")
    labels.write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
