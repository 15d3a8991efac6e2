"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over hashed word unigrams and bigrams are counted: one over every document (raw),
one over the trusted documents (target). A document's score is the mean log ratio of its n-grams, so
it does not depend on the document's length. A document is kept if it passes the base rules and its
score reaches a threshold that is fitted once on labelled documents; nothing is drawn at random. For
the threshold a trusted document is scored without its own n-grams in the target, as an unseen one is.

Defined results: a null text is an empty one; an empty text has no n-gram, score 0.0 and fails the
base rules; repeated rows are scored alike; a row without doc_id has no label, and labels that
contradict each other are left out; doc_id is an integer where labels are used; an empty table gives an empty result; other columns are
passed through by ``keep_documents`` and ignored by ``assess``. Without labels of both classes the
threshold is minus infinity, and without trusted documents every score is 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
#: Labelled rows that are used at most, the smallest by hash: the bound of the trusted sample.
LABELLED = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def ngrams(block: scan.Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Buckets and texts of all unigrams and bigrams: (unigram bucket, bigram bucket, bigram inside one text, text of a word, words)."""
    begin, end, counts = block.words()
    hashes = block.hashes(begin, end)
    text = np.repeat(np.arange(block.n), counts)
    both = scan.mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    to = lambda h: ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return to(hashes), to(both), text[:-1] == text[1:], text, (begin, end, counts, hashes)


def is_in(ids: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """Which ids are in ``wanted``; a null one never is."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return known & np.isin(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), wanted)


def _counter(trusted: np.ndarray, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = is_in(batch.column("doc_id"), trusted)
            for row, block in scan.blocks(batch.column("text")):
                one, two, inside, text, _ = ngrams(block, buckets)
                chosen = good[row : row + block.n][text]
                raw += np.bincount(one, minlength=buckets) + np.bincount(two[inside], minlength=buckets)
                if chosen.any():
                    target += np.bincount(one[chosen], minlength=buckets) + np.bincount(two[inside & chosen[:-1]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])
        scan.release()

    return count


def sums(docs: DataFrame, trusted: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket stands in all documents, and in those whose doc_id is in ``trusted``.

    Every task sends at most ``buckets`` sums, and the driver gets at most ``buckets`` rows.
    """
    found = (
        scan.bounded(docs).select("doc_id", "text").mapInArrow(_counter(np.unique(trusted), buckets), "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow().to_pandas()
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    return raw, target


def ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log ratio of each bucket."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(raw))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def fit(docs: DataFrame, trusted: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The log ratio of each bucket. Every document counts as raw, those whose doc_id is in ``trusted`` also as target."""
    return ratios(*sums(docs, trusted, buckets))


def unseen_scores(docs: DataFrame, raw: np.ndarray, target: np.ndarray, trusted: np.ndarray) -> DataFrame:
    """(doc_id, base_failed, score) of each row, a trusted document's own n-grams taken out of the target."""
    trusted, size = np.unique(trusted), len(raw)
    sent = docs.sparkSession.sparkContext.broadcast((ratios(raw, target), raw, target, trusted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, raw, target, trusted = sent.value
        rest, below = target.sum(), np.log((raw + 1) / (raw.sum() + size))
        for batch in batches:
            own = is_in(batch.column("doc_id"), trusted)
            for row, block in scan.blocks(batch.column("text")):
                got = features(block, table, float("-inf"))
                one, two, inside, text, _ = ngrams(block, size)
                score = got["score"]
                for k in np.flatnonzero(own[row : row + block.n]):
                    grams, n = np.unique(np.concatenate((one[text == k], two[inside & (text[:-1] == k)])), return_counts=True)
                    if len(grams):
                        left = target[grams] - n
                        score[k] = (n * (np.log((left + 1) / (rest - n.sum() + size)) - below[grams])).sum() / n.sum() if rest > n.sum() else 0.0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, block.n), pa.array(got["base_failed"]), pa.array(score)], ["doc_id", "base_failed", "score"])
        scan.release()

    return scan.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base_failed boolean, score double")


def repeated(keys: np.ndarray) -> np.ndarray:
    """The distinct keys that occur twice or more, sorted."""
    keys = np.sort(keys)
    return np.unique(keys[1:][keys[1:] == keys[:-1]])


def features(block: scan.Block, table: np.ndarray, cut: float) -> dict[str, np.ndarray]:
    one, two, inside, text, (begin, end, counts, hashes) = ngrams(block, len(table))
    salt = scan.mix(np.arange(block.n, dtype=np.uint64))
    letters = (block.buf & 0xC0) != 0x80  # the first byte of each code point
    out = {"n_words": counts, "word_chars": block.count(letters & scan.WORD[block.buf]), "n_symbols": block.count(_SYMBOL[block.buf])}

    first, last, lines = block.runs(block.buf != 0x0A)
    of = np.repeat(np.arange(block.n), lines)
    worded = np.searchsorted(begin, last) > np.searchsorted(begin, first)
    keys = np.sort((block.hashes(first, last) ^ salt[of])[worded])
    distinct = np.ones(len(keys), bool)
    distinct[1:] = keys[1:] != keys[:-1]
    out["n_dup_lines"] = np.bincount(of[worded], minlength=block.n)
    if not distinct.all():  # per text, only for blocks that hold a repeated line
        again = repeated(keys)
        line = block.hashes(first, last) ^ salt[of]
        hit = worded & np.isin(line, again)
        pairs = np.unique(np.stack([of[hit].astype(np.uint64), line[hit]], 1), axis=0)[:, 0].astype(np.int64)
        out["n_dup_lines"] = np.bincount(of[hit], minlength=block.n) - np.bincount(pairs, minlength=block.n)
    else:
        out["n_dup_lines"] = np.zeros(block.n, np.int64)

    covered = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        whole = text[2:] == text[:-2]
        window = scan.mix(hashes[:-2] * np.uint64(5) + hashes[1:-1] * np.uint64(3) + hashes[2:]) ^ salt[text[2:]]
        twice = np.flatnonzero(whole & np.isin(window, repeated(window[whole])))
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(text[covered], minlength=block.n)

    grams = counts + np.maximum(counts - 1, 0)
    value = np.zeros(len(hashes))
    value += table[one]
    value[1:] += np.where(inside, table[two], 0.0)
    out["score"] = scan.per_text(value, counts) / np.maximum(grams, 1)
    out["base_failed"] = (counts < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * counts)
    out["kept"] = ~out["base_failed"] & (out["score"] >= cut)
    return out


def _all(batch: pa.RecordBatch, table: np.ndarray, cut: float) -> dict[str, np.ndarray]:
    parts = [features(block, table, cut) for _, block in scan.blocks(batch.column("text"))]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def assess(docs: DataFrame, table: np.ndarray, cut: float) -> DataFrame:
    """doc_id and the figures and verdict of every document."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = _all(batch, table, cut)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[k]) for k in names)], ["doc_id", *names])
        scan.release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scan.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def keep_documents(docs: DataFrame, table: np.ndarray, cut: float) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_all(batch, table, cut)["kept"]))
        scan.release()

    return scan.bounded(docs).mapInArrow(run, docs.schema)


def labelled(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """At most ``bound`` labelled documents (doc_id, quality), the smallest by hash of doc_id."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    return known.filter("quality = most").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The score at or above which to keep: the highest balanced accuracy, halfway between two neighbours, the lowest on ties."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    below_bad = np.concatenate(([0], np.cumsum(~good))) / (~good).sum()
    below_good = np.concatenate(([0], np.cumsum(good))) / good.sum()
    usable = np.concatenate(([True], scores[1:] > scores[:-1], [True]))
    at = int(np.argmax(np.where(usable, below_bad - below_good, -2.0)))
    if at == 0:
        return float("-inf")
    return float((scores[at - 1] + scores[at]) / 2) if at < len(scores) else float(np.nextafter(scores[-1], np.inf))


def learn(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, bound: int = LABELLED) -> tuple[np.ndarray, float]:
    """The log ratios and the threshold for ``docs``; trusted are the labelled documents of quality 1."""
    sample = labelled(labels, bound).toArrow().to_pandas()
    trusted = sample.loc[sample["quality"] == 1, "doc_id"].to_numpy(np.int64)
    raw, target = sums(docs, trusted, buckets)
    known = docs.sparkSession.createDataFrame(sample, "doc_id long, quality int")
    rows = unseen_scores(docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi"), raw, target, trusted)
    got = rows.filter("NOT base_failed").select("doc_id", "score").toArrow().to_pandas().merge(sample, on="doc_id")
    return ratios(raw, target), best_cut(got["score"].to_numpy(), got["quality"].to_numpy() == 1)
