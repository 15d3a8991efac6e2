"""Language identification of mixed-language text.

Every word gets a score under each language: the log-likelihood of its byte trigrams, word borders
included. The script of a word narrows its candidates to the languages that use this script in the
training texts. Viterbi decoding over the words, with a penalty for every switch of language, labels
spans; a document's language is the one with the most bytes of letter-bearing words, and its score
is that share.

Training counts the trigrams of every document that carries a language and is not held out.

Defined results: a null text, or one without a letter, is ``und`` with score 0.0 and no span, as is
every text if nothing was learned; equal shares take the first language by code point; repeated rows
are labelled alike; a row without doc_id counts as held out; an empty table gives an empty result; other columns are ignored by ``identify``
and passed through by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Languages that are told apart at most; more are an error.
MAX_LANGUAGES = 250
#: Log-likelihood that a switch of language costs.
SWITCH = 12.0
#: Share of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.002
#: Bytes of text that are decoded together.
BLOCK = 1_000_000

# First and last code point of the blocks of each script, from Unicode's Blocks.txt.
SCRIPTS = {
    "latin": [(0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}


def _script_table() -> np.ndarray:
    """The script of a byte and the one after it: 0 is none, 1 latin, and so on."""
    table = np.zeros(1 << 16, np.uint8)
    for c in (*range(65, 91), *range(97, 123)):
        table[c << 8 : (c + 1) << 8] = 1
    for k, blocks in enumerate(SCRIPTS.values(), 1):
        for first, last in blocks:
            for cp in range(first, last + 1):
                lead = cp if cp > 0x7FF else 0
                table[((0xE0 | cp >> 12) << 8 | 0x80 | cp >> 6 & 63) if lead else ((0xC0 | cp >> 6) << 8 | 0x80 | cp & 63)] = k
    table[[0xC397, 0xC3B7]] = 0  # the signs of multiplication and division
    return table


_SCRIPT = _script_table()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def grams(block: scan.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of every byte of a word, the words' begin among them and end, words of each text, and each word's script."""
    begin, end, counts = block.words()
    inside = scan.WORD[block.buf]
    bordered = np.full(2 * len(begin) + int(inside.sum()) + 1, 0x20, np.uint8)  # each word with a blank on both sides
    sizes = end - begin
    small = np.int32 if len(bordered) < 1 << 31 else np.int64  # positions, which take most of the memory
    first = np.cumsum(sizes + 2) - sizes - 1
    spot = np.repeat((first - (np.cumsum(sizes) - sizes)).astype(small), sizes)
    spot += np.arange(len(spot), dtype=small)
    bordered[spot] = block.buf[inside]
    code = bordered[spot].astype(np.uint32) << 8 | bordered[spot + 1]
    scripts = _SCRIPT[code]
    code |= bordered[spot - 1].astype(np.uint32) << 16
    del spot
    code *= np.uint32(2654435761)
    bucket = code >> np.uint32(16)
    at = np.cumsum(sizes) - sizes
    return bucket.astype(np.int32), at, sizes, counts, np.maximum.reduceat(scripts, at) if len(at) else np.zeros(0, np.uint8)


def learnable(docs: DataFrame, held_out: Column) -> DataFrame:
    """(text, lang) of the rows that may be learned from."""
    return docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")


def learn(examples: DataFrame) -> dict:
    """The model of all rows (text, lang): languages, log-probabilities and scripts.

    Every task sends at most BUCKETS sums for each language, and the driver gets as many.
    """
    names = sorted(r[0] for r in examples.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    number, wide = {x: i for i, x in enumerate(names)}, BUCKETS + 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), wide), np.int64)
        for batch in batches:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for row, block in scan.blocks(batch.column("text"), lower=True, size=BLOCK):
                bucket, _, sizes, counts, script = grams(block)
                of = np.repeat(langs[row : row + block.n], counts)
                each = np.repeat(of, sizes)
                for k in np.unique(of):
                    sums[k, :BUCKETS] += np.bincount(bucket[each == k], minlength=BUCKETS)
                    sums[k, BUCKETS:] += np.bincount(script[of == k], minlength=256)
        k, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[k, at])], ["lang", "at", "n"])
        scan.release()

    rows = scan.bounded(examples).mapInArrow(count, "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    sums = np.zeros((len(names), wide))
    sums[rows["lang"], rows["at"]] = rows["n"]
    seen, scripts = sums[:, :BUCKETS], sums[:, BUCKETS:]
    scripts[:, 0] = 0
    own = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(1, keepdims=True), 1)
    return {"names": names, "score": np.log((seen + 0.5) / (seen.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32), "scripts": own}


def decode(score: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word: ``score`` (words, languages) of texts of ``counts`` words; all texts step together."""
    order = np.argsort(-counts, kind="stable")
    first, size = (np.cumsum(counts) - counts)[order], counts[order]
    longest = int(size[0]) if len(size) else 0
    active = len(size) - np.searchsorted(size[::-1], np.arange(longest), "right")
    value = np.zeros((len(size), score.shape[1]))
    stay, best = np.empty(score.shape, bool), np.empty(len(score), np.uint8)
    rows = np.arange(len(size))
    for t in range(longest):
        n = active[t]
        at, v = first[:n] + t, value[:n]
        top = v.argmax(1)
        moved = (v[rows[:n], top] - switch)[:, None]
        stay[at], best[at] = v >= moved, top
        np.maximum(v, moved, out=v)
        v += score[at]
    out, now = np.empty(len(score), np.uint8), value.argmax(1).astype(np.uint8)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at, x = first[:n] + t, now[:n]
        out[at] = x
        now[:n] = np.where(stay[at, x], x, best[at])
    return out


def label(block: scan.Block, model: dict, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language of each text (-1: none), its share, language of each word, words of each text."""
    bucket, at, sizes, counts, script = grams(block)
    many = len(model["names"])
    shares = np.zeros((block.n, max(many, 1)))
    labels = np.zeros(len(at), np.uint8)
    if len(at) and many:
        score = np.empty((len(at), many), np.float64)
        for k in range(many):
            score[:, k] = np.add.reduceat(model["score"][k][bucket], at)
        allowed = model["scripts"][:, script].T
        narrowed = (script > 0) & allowed.any(1)
        score[narrowed] = np.where(allowed[narrowed], score[narrowed], score[narrowed] - 1e6)
        score[script == 0] = 0.0  # no letter: the neighbours decide
        text = np.repeat(np.arange(block.n), counts)
        lettered = script > 0
        odd = ~np.isin(np.arange(block.n), text[lettered])  # letters of no listed script: all words count
        if odd.any():
            again = odd[text]
            for k in range(many):
                score[again, k] = np.add.reduceat(model["score"][k][bucket], at)[again]
            lettered = lettered | again
        labels = decode(score, counts, switch)
        weight = sizes * lettered
        for k in range(many):
            shares[:, k] = np.bincount(text, weight * (labels == k), minlength=block.n)
        shares /= np.maximum(shares.sum(1, keepdims=True), 1)
    lang = shares.argmax(1) if many else np.full(block.n, -1)
    letter = block.count(_LETTER[block.buf]) > 0
    for i in np.flatnonzero(~letter):
        text = block.buf[block.off[i] : block.off[i + 1]].tobytes().decode("utf-8", "replace")
        letter[i] = any(c.isalpha() for c in text)
    lang = np.where(letter & (counts > 0), lang, -1)
    return lang, np.where(lang >= 0, shares.max(1), 0.0), labels, counts


def _all(batch: pa.RecordBatch, model: dict, switch: float) -> Iterator[tuple]:
    size = max(1 << 16, BLOCK * 8 // max(8, len(model["names"])))  # the scores of a block's words grow with the languages
    for row, block in scan.blocks(batch.column("text"), lower=True, size=size):
        yield row, block, *label(block, model, switch)


def _spans(names: list[str], labels: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
    out, at = [], 0
    for n in counts:
        own = labels[at : at + n]
        cut = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [n])) if n else [0]
        out.append([{"lang": names[own[a]], "first_word": int(a), "words": int(b - a)} for a, b in zip(cut, cut[1:])])
        at += n
    return out


def identify(docs: DataFrame, model: dict, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, the spans (lang, first_word, words) of every document."""
    names = np.array([*model["names"], UNKNOWN], object)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block, lang, score, labels, counts in _all(batch, model, switch):
                columns = [batch.column("doc_id").slice(row, block.n), pa.array(names[lang], pa.string()), pa.array(score)]
                if spans:
                    columns.append(pa.array([s if k >= 0 else [] for s, k in zip(_spans(model["names"], labels, counts) if model["names"] else [[]] * block.n, lang)], kind))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])
        scan.release()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    return scan.bounded(docs).select("doc_id", "text").mapInArrow(run, schema + (", spans array<struct<lang:string,first_word:bigint,words:bigint>>" if spans else ""))


def keep_identified(docs: DataFrame, model: dict, least: float = 0.5, switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs`` that have a language with a share of at least ``least``, with all columns and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [(lang >= 0) & (score >= least) for _, _, lang, score, _, _ in _all(batch, model, switch)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))
        scan.release()

    return scan.bounded(docs).mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))
