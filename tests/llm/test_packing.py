import collections
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def tool():
    return packing.Tokens(Path(VOCABULARY).read_text())


FILE = Tokenizer.from_file(VOCABULARY)


def plain(tool, text):
    return np.array(FILE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_remembered_ids_are_the_tokenizers_ids(tool, corpus):
    odd = ["", " ", "  ", "a  b", " a", "a ", "\n\n a", "a\n b", "a \nb", "a\n \nb", "x  y", "<|endoftext|> a", "it's don't 'll  x", "\t a\t b", "a\x85 b", "1 2 33 !! ??", "日本 語", "\x1c \x1c a \x00", "é e"]
    rng = random.Random(2)
    odd += ["".join(rng.choice(" \n\tab1.,'é日  \x1f") for _ in range(40)) for _ in range(300)]
    slow = packing.Tokens(Path(VOCABULARY).read_text())
    slow.ranked, slow.one = None, slow._slow  # as if the file were not of tiktoken's kind
    assert tool.ranked
    for text in odd + [r.text for r in corpus.limit(40).collect()]:
        assert tool.ids(text) == slow.ids(text) == plain(tool, text), repr(text)


def test_all_texts_of_a_table(tool, spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert tool.ids(r.text or "") == plain(tool, r.text or "")
    for text in ("x" * 50_000, " " * 20_000 + "a", "a\n" * 20_000, "é" * 20_000, "12" * 10_000):
        assert tool.ids(text) == plain(tool, text)


def verify(rows, ids, length=packing.LENGTH, segments=packing.SEGMENTS):
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        documents[r.doc_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length and len(s) <= segments
    for key, texts in ids.items():
        want = collections.Counter()
        for data in texts:
            want[len(data) // 4] += len(data) // 4
        assert sum(r.length for r in documents[key]) == sum(want.values())
        if len(texts) == 1:
            at = 0
            for r in sorted(documents[key], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(texts[0]) // 4
                assert r.ids_crc32 == zlib.crc32(texts[0][4 * at : 4 * (at + r.length)])
                at += r.length
    return [sum(r.length for r in s) for s in sequences.values()]


def test_documents(tool, corpus, awkward, empty):
    for df in (corpus, awkward):
        ids = collections.defaultdict(list)
        for r in df.collect():
            ids[r.doc_id].append(plain(tool, r.text or "") + b"\0\0\0\0")
        sizes = verify(packing.pack_documents(df, VOCABULARY).collect(), ids)
        assert all(x & (x - 1) == 0 for x in sizes)  # full, or a power of two: no padding
    assert packing.pack_documents(empty, VOCABULARY).count() == 0


def test_ids_of_the_pieces(corpus):
    for r in packing.pack_documents(corpus.limit(20), VOCABULARY, with_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_limits_of_all_kinds():
    rng = random.Random(4)
    packer = packing.Packer(0, 128, 4, 60)
    loads = {}
    for k in range(500):
        n = rng.randint(1, 250)
        loads[k] = (n, rng.randint(0, n))
        packer.add(k, *loads[k])
    packer.place(False)
    packer.place(True)
    sequences = collections.defaultdict(list)
    for key, start, n, s, at in packer.out:
        sequences[s].append((at, key, start, n))
    assert sum(n for p in sequences.values() for _, _, _, n in p) == sum(n for n, _ in loads.values())
    for p in sequences.values():
        size = sum(x[3] for x in p)
        assert len(p) <= 4 and size <= 128 and size & (size - 1) == 0
        assert sum(max(0, a + n - max(a, loads[k][0] - loads[k][1])) for _, k, a, n in p) <= 60
    for key, (n, _) in loads.items():
        at = 0
        for a, m in sorted((a, m) for p in sequences.values() for _, k, a, m in p if k == key):
            assert a == at
            at += m
        assert at == n


def test_short_documents_are_not_padded():
    for low, high in ((1, 1), (2, 2), (5, 5), (9, 9), (1, 20)):
        rng, packer = random.Random(high), packing.Packer(0)
        total = 0
        for k in range(4000):
            total += (n := rng.randint(low, high))
            packer.add(k, n, n - 1)
            if len(packer.keys) >= packing.WINDOW:
                packer.place(False)
        packer.place(True)
        sizes = collections.Counter()
        for _, _, n, s, _ in packer.out:
            sizes[s] += n
        assert sum(sizes.values()) == total and all(x & (x - 1) == 0 for x in sizes.values())
        assert len(sizes) <= 2 * (total // min(1024, 64 * low) + 11)


def test_answers_bear_the_loss(spark):
    """Instruction data: prompts and answers, under a limit of loss-bearing tokens below the length."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()]
    pairs = [(i, (a.text or ""), (b.text or "")) for i, (a, b) in enumerate(zip(rows, rows[1:])) if a.role == "user" and b.role == "assistant" and a.conv_id == b.conv_id]
    df = spark.createDataFrame([(i, f"{a}\n{b}", f"\n{b}") for i, a, b in pairs], "doc_id long, text string, answer string")
    got = packing.pack_documents(df.coalesce(1), VOCABULARY, loss=256, bearing="answer").collect()
    count = lambda x: len(FILE.encode(x, add_special_tokens=False).ids)
    size = {i: (count(f"{a}\n{b}") + 1, count(f"\n{b}") + 1) for i, a, b in pairs}
    loss, tokens_ = collections.Counter(), collections.Counter()
    for r in got:
        n, bears = size[r.doc_id]
        assert r.doc_tokens == n
        loss[r.sequence_id] += max(0, r.start + r.length - max(r.start, n - min(n, bears)))
        tokens_[r.sequence_id] += r.length
    assert max(loss.values()) <= 256 and sum(tokens_.values()) == sum(n for n, _ in size.values()) and 200 < max(loss.values())
    assert all(x & (x - 1) == 0 for x in tokens_.values())


def test_special_tokens():
    text = "a <|endoftext|> b"
    content = Path(VOCABULARY).read_text()
    assert packing.Tokens(content).ids(text) == plain(None, text)
    assert len(packing.Tokens(content, literal=True).ids(text)) > len(plain(None, text))
