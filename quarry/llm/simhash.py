"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits stand on a ring of four segments of 16 bits. If two fingerprints differ in at
most k = 3 bits, the pigeonring principle gives a segment from which every chain of 1, 2, 3 and 4
consecutive segments differs in at most floor(j * k / 4) = 0, 1, 2 and 3 bits. So a pair is a
candidate only where one segment is equal and the next one differs in at most one bit, which leaves
one of its halves equal: eight keys of 24 bits find all such pairs. The chain of three is tested
before the full Hamming distance.

A key that more than ``FULL`` distinct fingerprints share is not paired. There every fingerprint is
sent to all words within two flipped bits outside the key; a word that lies within one bit of one
fingerprint links all that reached it, as they are then at most 1 + 2 = 3 bits apart, and any pair
within 3 bits meets in such a word. That is exact and in proportion to the fingerprints.

Defined results: a null text is an empty one; a text without words has fingerprint zero and is linked
like any other; one or two words are one shingle; equal texts have equal fingerprints, whatever the
other columns hold; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .near import keep_first as keep_first  # the pipeline's stage: similarity of shingle sets
from .scan import bounded, release
from .store import keep

SHINGLE = 3
BITS = 3
#: Distinct fingerprints of one key that are paired with each other.
FULL = 64

_WHITE = b"\t\n\x0b\x0c\r "


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            values = np.fromiter((fingerprint(x or b"", shingle) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])
        release()

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _segment(fp: str, k: int) -> F.Column:
    return F.shiftrightunsigned(F.col(fp), 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))


def _keys(fps: DataFrame) -> DataFrame:
    """Eight keys of each fingerprint: (start of the chain, half of the next segment) and the 24 bits that must be equal."""
    keys = []
    for k in range(4):
        for half in range(2):
            nxt = F.shiftrightunsigned(_segment("fp", k + 1), 8 * half).bitwiseAND(F.lit(0xFF))
            keys.append(F.struct(F.lit(2 * k + half).alias("chain"), (_segment("fp", k) * 256 + nxt).alias("bits")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.chain", "key.bits")


def _within(a: str, b: str) -> F.Column:
    """The chain test from the key's segment, then the Hamming distance."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    ring = F.expr(f"(shiftrightunsigned({a} ^ {b}, CAST(16 * (chain DIV 2) AS INT)) | shiftleft({a} ^ {b}, CAST(64 - 16 * (chain DIV 2) AS INT)))")
    chain = F.lit(True)
    for j in range(1, 4):
        chain = chain & (F.bit_count(ring.bitwiseAND(F.lit((1 << (16 * j)) - 1))) <= (j * BITS) // 4)
    return chain & (F.bit_count(differ) <= BITS)


def links(fps: DataFrame, full: int = FULL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): all that differ in at most 3 bits are connected by them."""
    keyed = keep(_keys(fps), "keys")
    sizes = keyed.groupBy("chain", "bits").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = keep(keyed.join(sizes, ["chain", "bits"]), "sized")
    few, many = sized.filter(F.col("size") <= full), sized.filter(F.col("size") > full)
    other = few.select("chain", "bits", F.col("fp").alias("b"))
    pairs = few.withColumnRenamed("fp", "a").join(other, ["chain", "bits"]).filter("a < b").filter(_within("a", "b")).select("a", "b").distinct()
    return pairs.unionAll(_balls(many))


def _balls(many: DataFrame) -> DataFrame:
    """Links of keys that many fingerprints share, through the words within one and two bits of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {}
        for chain in range(8):
            k, half = divmod(chain, 2)
            fixed = set(range(16 * k, 16 * k + 16)) | {16 * ((k + 1) % 4) + 8 * half + i for i in range(8)}
            one = [1 << i for i in range(64) if i not in fixed]
            flips = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])]
            masks[chain] = np.array(flips, np.uint64), np.arange(len(flips)) <= len(one)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                chain = part.column("chain").to_numpy()
                fp = part.column("fp").to_numpy().view(np.uint64)
                for c in np.unique(chain):
                    own = fp[chain == c]
                    flips, near = masks[int(c)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own) * len(flips), c, np.int32)), pa.array((own[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(own, len(flips)).view(np.int64)), pa.array(np.tile(near, len(own)))], ["chain", "word", "fp", "near"]
                    )

    met = many.select(F.col("chain").cast("int"), "fp").mapInArrow(run, "chain int, word long, fp long, near boolean")
    hubs = met.groupBy("chain", "word").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.count(F.lit(1)).alias("n"))
    hubs = hubs.filter("n > 1 AND a IS NOT NULL").select("chain", "word", "a")
    return met.join(hubs, ["chain", "word"]).filter("a != fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; component_id is the least doc_id that links reach."""
    own = keep(fingerprints(docs, shingle), "fingerprints")
    first = keep(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = links(first.select("fp"))
    a, b = (first.select(F.col("fp").alias(x), F.col("first").alias(f"{x}1")) for x in "ab")
    groups = components(found.join(a, "a").join(b, "b").select(F.col("a1").alias("a"), F.col("b1").alias("b")))
    named = first.join(groups, first["first"] == groups["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
