"""Language-model scoring with a hierarchical Pitman-Yor model of words.

Tokens are lower-cased words and one end per text. Every word has a context restaurant whose
customers are the tokens after it (a text's first token sits in the start's restaurant). All of them
share one parent, the root, where each table of a context restaurant is a customer; the root's base is
uniform over the training words and one symbol for all unseen ones.

The seating is sampled by Gibbs. Of a dish only the number of its tables t matters: given all else,
it has the weight G(strength/d + T + t) / G(strength/d + T) * (d * p)^t * S(c, t), where c are the
dish's customers, T the restaurant's other tables, p the root's probability and S the generalised
Stirling numbers. A sweep draws t anew for every dish of every restaurant, so each customer is
reseated at once: from all weights if c is at most ``EXACT``, else by Metropolis steps with the saddle
point of S (a sum for few tables), whose cost does not depend on c. Then the root is seated anew; words with equally many
customers there are exchangeable and drawn as a class. Tasks sample at the same time with the figures
of the sweep before, as in distributed Gibbs sampling. The predictive probabilities of the sweeps
after the burn-in are averaged; perplexity is 10^(-score / n_tokens).

There is no limit of words, contexts or counts. A dish of one customer has one table and needs no
sampling, so only pairs that stand twice or more are seated. Texts are read in units of ``UNIT``
tokens, whose distinct pairs are counted, sampled and answered in buckets by hash, so a hot word or
pair is one entry of each unit. The ``frequent`` most frequent words (a bounded table) are sent to every task;
all others are looked up by joins and their pairs are seated by joins too, with the same result.

Words are told apart by 63-bit hashes, pairs with a word that is not frequent by 63-bit hashes of
both. Defined results: a null text is an empty one and has the end token only; a null doc_id counts as held
out; repeated rows are scored each; an empty table gives an empty result; without training texts every
count is 0 and every token has probability 1; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .store import drop, keep, release_shuffles

#: The bound of the word table that is sent to every task.
FREQUENT = 1 << 19
#: Discount and strength of the context restaurants and of the root.
DISCOUNT, STRENGTH = 0.6, 5.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.5, 1.0
SWEEPS, BURN_IN = 6, 2
#: Customers of a dish up to which all weights are computed; Metropolis steps of a sweep beyond; terms of a sum of Stirling numbers there.
EXACT, STEPS, TERMS = 64, 16, 30
#: Tokens of a unit of text, and of all texts for each bucket of pairs and words.
UNIT, BUCKET = 2_000_000, 2_000_000
#: Tokens whose figures are computed at once.
SLICE = 1 << 17
#: The hash that stands for the end of a text.
END = np.uint64(0x64D0F7E4D0F7E4D1)

_RARE = np.uint64(1 << 63)
_BITS = np.uint64(21)
_START = np.uint64((1 << 21) - 1)  # as a context; no word has this code
_P = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(True))


def token_stream(block: scan.Block) -> tuple[np.ndarray, np.ndarray]:
    """The 63-bit hash of every token of a lower-cased block, and the tokens of each text."""
    begin, end, counts = block.words()
    hashes = np.full(len(begin) + block.n, END)
    hashes[np.arange(len(begin)) + np.repeat(np.arange(block.n), counts)] = block.hashes(begin, end) & ~_RARE
    return hashes, counts + 1


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each stands (or the sum of its counts)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[at], np.diff(np.concatenate((at, [len(keys)])))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted; where each stands first; and the place of each key among them. As np.unique, in less memory."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(keys)]
    found, one = ranked[first], order[first]
    del ranked
    rank = np.cumsum(first, dtype=np.int32)
    rank -= 1
    place = np.empty(len(keys), np.int32)
    place[order] = rank
    return found, one, place


def count_words(texts: DataFrame) -> DataFrame:
    """(key, n): how often each token stands, by hash. A task's counts are merged whenever 2,000,000 wait."""
    most = 2_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            if held:
                keys, n = held.pop()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

        for batch in batches:
            for _, block in scan.blocks(batch.column("text"), lower=True):
                held.append(tally(token_stream(block)[0]))
                waiting += len(held[-1][0])
                if waiting > most:
                    held[:] = [tally(*(np.concatenate(x) for x in zip(*held)))]
                    waiting = 0
            if waiting == 0 and held and len(held[0][0]) > most:
                yield from rows()
        if held:
            held[:] = [tally(*(np.concatenate(x) for x in zip(*held)))]
        yield from rows()
        scan.release()

    return keep(texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")


# ---- packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string; sorted 64-bit keys are stored as differences."""
    out = []
    for a in arrays:
        rising = a.dtype == np.uint64
        raw = np.diff(a, prepend=np.uint64(0)) if rising else a
        planes = np.ascontiguousarray(raw).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
        part = pa.compress(planes, "zstd", asbytes=True) if planes else b""
        out += [struct.pack("<4sqq", a.dtype.str.encode(), len(a), len(part)), part]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at, head = [], 0, struct.calcsize("<4sqq")
    while at < len(data):
        kind, n, size = struct.unpack_from("<4sqq", data, at)
        kind, at = np.dtype(kind.rstrip(b"\0").decode()), at + head
        planes = np.frombuffer(pa.decompress(data[at : at + size], n * kind.itemsize, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
        a = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n)
        out.append(np.cumsum(a, dtype=np.uint64) if kind == np.uint64 else a)
        at += size
    return out


# ---- seating


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: the recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, float)
    small = x < 8
    shift = np.where(small, x, 1.0)
    product = np.where(small, shift, 1.0)
    for k in range(1, 8):
        product = np.where(small, product * (shift + k), product)
    y = np.where(small, x + 8, x)
    series = (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(product)


def log_stirling(most: int, d: float) -> np.ndarray:
    """log S(c, t) for 0 <= t <= c <= most: S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)) + out[c, 1:], -np.inf)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def large_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) - log c! for large c and t < c: the alternating sum for t up to 2 c^d, else the saddle point."""
    out, few = np.empty(len(c)), t <= 2 * c**d
    out[few], out[~few] = summed_stirling(c[few], t[few], d), saddle_stirling(c[~few], t[~few], d)
    return out


def summed_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """By S(c, t) = sum over j of (-1)^j binomial(t, j) G(c - j d) / G(-j d), over d^t t!; its terms fall fast for t up to 2 c^d."""
    total, term = np.zeros(len(c)), np.ones(len(c))  # term: binomial(t, j) G(c - j d) / G(c - d)
    for j in range(1, TERMS + 1):
        term = term * np.maximum(t - j + 1, 0) / j
        if j > 1:
            term *= (c - (j - 1) * d - (d + 1) / 2) ** -d
        if abs(j * d - round(j * d)) > 1e-9:  # else 1 / G is 0
            total += (-1) ** j / math.gamma(-j * d) * term
    return log_gamma(c - d) + np.log(np.maximum(total, 1e-300)) - t * np.log(d) - log_gamma(t + 1.0) - log_gamma(c + 1.0)


def saddle_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """By the saddle point of 1 / (t! d^t) [z^c] (1 - (1 - z)^d)^t.

    With z = 1 - exp(-v) the saddle solves t d z exp(-d v) / (exp(-v) (1 - exp(-d v))) = c.
    """
    low, high = np.full(len(c), -40.0), np.full(len(c), 6.5)  # of log v
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(40):
            mid = (low + high) / 2
            v = np.exp(mid)
            less = t * d * np.expm1(v) * np.exp(-d * v) / -np.expm1(-d * v) < c
            low, high = np.where(less, mid, low), np.where(less, high, mid)
    v = np.exp(low)
    z, q = -np.expm1(-v), np.exp(-d * v)
    g = d * q / (-np.expm1(-d * v) * np.exp(-v))  # (log f)' with f = 1 - (1 - z)^d
    bend = t * (g * (1 - d) * np.exp(v) - g * g) + c / (z * z)
    return t * np.log(-np.expm1(-d * v)) - c * np.log(z) - 0.5 * np.log(np.maximum(2 * np.pi * bend * z * z, 1e-300)) - log_gamma(t + 1.0) - t * np.log(d)


class Seats:
    """Draws numbers of tables."""

    def __init__(self, discount: float, strength: float):
        self.d, self.strength = discount, strength
        self.table = log_stirling(EXACT, discount)

    def weights(self, c: int, others: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(dishes, c): the chance of 1..c tables of dishes with ``c`` customers each."""
        t = np.arange(c)
        steps = np.log((self.strength + self.d * (others[:, None] + t)) * p[:, None])
        log = np.cumsum(steps, 1) + self.table[c, 1 : c + 1]
        log -= log.max(1, keepdims=True)
        out = np.exp(log)
        return out / out.sum(1, keepdims=True)

    def draw(self, c: np.ndarray, t: np.ndarray, others: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of each dish given its customers ``c``, present tables ``t``, the restaurant's other tables and the parent's ``p``."""
        out = np.minimum(c, 1).astype(np.int64)
        uniform = rng.random(len(c))
        order = np.argsort(c, kind="stable")
        ends = np.searchsorted(c[order], np.arange(EXACT + 2))
        for k in range(2, EXACT + 1):
            for lo in range(ends[k], ends[k + 1], 1 << 16):
                at = order[lo : min(lo + (1 << 16), ends[k + 1])]
                up = np.cumsum(self.weights(k, others[at], p[at]), 1)
                out[at] = 1 + np.minimum((up < uniform[at, None]).sum(1), k - 1)
        big = order[ends[EXACT + 1] :]
        if len(big):
            out[big] = self.steps(c[big].astype(float), t[big].astype(float), others[big], p[big], rng)
        return out

    def steps(self, c: np.ndarray, t: np.ndarray, others: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        base = self.strength / self.d + others

        def weight(t: np.ndarray) -> np.ndarray:
            return log_gamma(base + t) - log_gamma(base) + t * np.log(self.d * p) + large_stirling(c, t, self.d)

        t = np.clip(t, 1, c - 1)
        now = weight(t)
        for _ in range(STEPS):
            # of any scale from 1 to c / 4, drawn apart from t, so steps there and back are equally likely
            new = np.round(t + rng.normal(0, 1, len(t)) * (c / 4) ** rng.random(len(t)))
            inside = (new >= 1) & (new <= c - 1)
            new = np.where(inside, new, t)
            then = weight(new)
            go = inside & (np.log(rng.random(len(t))) < then - now)
            t, now = np.where(go, new, t), np.where(go, then, now)
        return t.astype(np.int64)


class Root:
    """The root restaurant. Words with equally many customers are one class; ``of`` gives the probability by customers."""

    def __init__(self, vocabulary: int):
        self.base, self.tables, self.seats = 1.0 / (vocabulary + 1), float(vocabulary), Seats(ROOT_DISCOUNT, ROOT_STRENGTH)

    def seat(self, customers: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> RootTable:
        """Seats ``words`` words of each number of ``customers`` (sorted, above 0) anew and returns their probabilities."""
        mean = np.ones(len(customers))
        others, p = np.array([self.tables]), np.array([self.base])
        for i in np.flatnonzero((customers > 1) & (customers <= EXACT)):
            chance = self.seats.weights(int(customers[i]), others, p)[0]
            drawn = rng.multinomial(int(words[i]), chance / chance.sum())
            mean[i] = (drawn * np.arange(1, len(chance) + 1)).sum() / words[i]
        big = np.flatnonzero(customers > EXACT)
        if len(big):
            c = customers[big].astype(float)
            mean[big] = self.seats.steps(c, np.ones(len(big)), np.full(len(big), self.tables), np.full(len(big), self.base), rng)
        self.tables = float((mean * words).sum())
        return RootTable(customers, mean, float((customers * words).sum()), self.tables, self.base)


class RootTable:
    def __init__(self, customers: np.ndarray, mean: np.ndarray, total: float, tables: float, base: float):
        self.customers = customers
        share = 1 / (ROOT_STRENGTH + total)
        self.unseen = (ROOT_STRENGTH + ROOT_DISCOUNT * tables) * share * base
        self.p = (customers - ROOT_DISCOUNT * mean) * share + self.unseen

    def of(self, customers: np.ndarray) -> np.ndarray:
        if not len(self.customers):
            return np.full(len(customers), self.unseen)
        at = np.minimum(np.searchsorted(self.customers, customers), len(self.customers) - 1)
        return np.where(self.customers[at] == customers, self.p[at], self.unseen)


class Sweep:
    """What the tasks get of a sweep: by code of the frequent words (and the start) the tables of the restaurant and the root's probability."""

    def __init__(self, tables: np.ndarray, p: np.ndarray, root: RootTable):
        self.tables, self.p, self.root = tables.astype(np.float32), p.astype(np.float32), root


# ---- units and buckets


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Both codes in 42 bits if both words are frequent, else a hash with the highest bit set."""
    both = (u | w) < _RARE
    return np.where(both, (u << _BITS) | (w & ~_RARE), scan.mix(u * _P + w) | _RARE)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (scan.mix(keys + _P) % np.uint64(buckets)).astype(np.int64)


def word_bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """pmod of the signed code, as Spark computes it."""
    return codes.view(np.int64) % buckets


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``keys`` bucket by bucket, frequent pairs before the others, and the ends of the 2 * ``buckets`` parts."""
    part = bucket_of(keys, buckets) + np.where(keys >= _RARE, buckets, 0)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(2 * buckets + 1))


class Table:
    """The most frequent words, the end always included: hash to code, and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, starts: int):
        """``starts``: training texts."""
        up = np.argsort(keys)
        self.keys, self.n = keys[up], np.append(counts[up], starts)  # the start's restaurant is the last
        self.start = len(keys)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each hash: its place here, or else the hash with the highest bit set."""
        if not len(self.keys):
            return hashes | _RARE
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at.astype(np.uint64), hashes | _RARE)

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Where frequent codes and the start stand in ``n``."""
        return np.where(codes == _START, np.uint64(self.start), codes).astype(np.int64)


class Unit:
    """Texts of about UNIT tokens: ``own`` their distinct codes, ``index`` the tokens in it, ``counts`` tokens and ``held`` flag of each text."""

    def __init__(self, own: np.ndarray, index: np.ndarray, counts: np.ndarray, held: np.ndarray):
        self.own, self.index, self.counts, self.held = own, index.astype(np.int32, copy=False), counts, held
        self.rare = own[own >= _RARE]
        first = np.cumsum(counts) - counts
        self.before = np.empty(len(index), np.int32)
        self.before[1:] = self.index[:-1]
        self.before[first] = len(own)  # the start

    def slices(self) -> Iterator[slice]:
        return (slice(lo, lo + SLICE) for lo in range(0, len(self.index), SLICE))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pair keys, sorted; the place of each token's pair among them; one token of each."""
        codes, keys = np.append(self.own, _START), np.empty(len(self.index), np.uint64)
        for at in self.slices():
            keys[at] = pair_keys(codes[self.before[at]], codes[self.index[at]])
        found, one, place = places(keys)
        return found, place, one

    def pack(self) -> bytes:
        return pack(self.own, self.index, self.counts.astype(np.int64), self.held.astype(np.uint8))

    @staticmethod
    def unpack(data: bytes) -> Unit:
        own, index, counts, held = unpack(data)
        return Unit(own, index, counts, held.astype(bool))


UNITS, PAIRS, OTHERS, WORDS = range(4)  # kinds of rows: units of text; asks for frequent pairs, other pairs and words that are not frequent


def units(docs: DataFrame, table, buckets: int) -> DataFrame:
    """Rows (kind, unit, bucket, payload, ids) of all texts: the units with their doc_ids, and what they ask the buckets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(unit: Unit, number: int, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        found, place, one = unit.pairs()
        codes = np.append(unit.own, _START)
        u, w = codes[unit.before[one]], codes[unit.index[one]]
        n = np.bincount(place[np.repeat(~unit.held, unit.counts)], minlength=len(found)).astype(np.int32)
        del place, one
        order, ends = by_bucket(found, buckets)
        out = [(UNITS, 0, unit.pack())]
        for part in range(2 * buckets):
            at = order[ends[part] : ends[part + 1]]
            if len(at):
                more = (u[at].view(np.int64), w[at].view(np.int64)) if part >= buckets else ()
                out.append((PAIRS if part < buckets else OTHERS, part % buckets, pack(found[at], n[at], *more)))
        word_bucket = word_bucket_of(unit.rare, buckets)
        order = np.argsort(word_bucket, kind="stable")
        ends = np.searchsorted(word_bucket[order], np.arange(buckets + 1))
        out += [(WORDS, b, pack(unit.rare[order[ends[b] : ends[b + 1]]])) for b in range(buckets) if ends[b + 1] > ends[b]]
        kinds, bucket, payload = zip(*out)
        lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(out), pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary()), lists], ["kind", "unit", "bucket", "payload", "ids"])

    def coded(hashes: np.ndarray, counts: np.ndarray, held: np.ndarray) -> Unit:
        own, _, index = places(hashes)
        codes = table.value.codes(own)
        order = np.argsort(codes)
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order))
        return Unit(codes[order], back[index], counts, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            hashes, counts, held = (np.concatenate([x[k] for x in waiting]) for k in (0, 1, 2))
            ids = pa.concat_arrays([x[3] for x in waiting])
            waiting.clear()
            yield from rows(coded(hashes, counts, held), number, ids)
            number, size = number + 1, 0
            del hashes
            scan.release()

        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for at, block in scan.blocks(batch.column("text"), lower=True):
                hashes, counts = token_stream(block)
                waiting.append((hashes, counts, held[at : at + block.n].astype(bool), batch.column("doc_id").slice(at, block.n)))
                size += len(hashes)
                if size >= UNIT:
                    yield from out()
        if waiting:
            yield from out()
        scan.release()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, f"kind int, unit long, bucket int, payload binary, ids array<{kind}>")


def merge(rows: pa.Table) -> pa.Table:
    """One row of a bucket of pairs: its dishes of two customers or more, and what each unit asked, in terms of them.

    ``dishes``: keys and customers. ``asked``: units, pairs of each, and for each pair its dish, or -1 or
    -2 for a pair of no or one customer. ``u``, ``w``, ``c``: the dishes of pairs that are not of two frequent words.
    """
    parts = sorted(zip(rows["unit"].to_pylist(), map(unpack, rows["payload"].to_pylist())), key=lambda x: x[0])
    keys, place = np.unique(np.concatenate([x[1][0] for x in parts]), return_inverse=True)
    n = np.bincount(place, np.concatenate([x[1][1] for x in parts]), minlength=len(keys)).astype(np.int64)
    shared = n >= 2
    name = np.where(shared, np.cumsum(shared) - 1, -1 - n)
    sizes = np.array([len(x[1][0]) for x in parts], np.int64)
    u = w = np.zeros(0, np.int64)
    if len(parts[0][1]) > 2:
        u, w = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        u[place], w[place] = (np.concatenate([x[1][k] for x in parts]) for k in (2, 3))
        u, w = u[shared], w[shared]
    lists = lambda a: pa.array([a], pa.list_(pa.int64()))
    return pa.table(
        {
            "kind": rows["kind"].slice(0, 1).cast(pa.int32()), "bucket": rows["bucket"].slice(0, 1).cast(pa.int32()), "dishes": pa.array([pack(keys[shared], n[shared])], pa.binary()),
            "asked": pa.array([pack(np.array([x[0] for x in parts], np.int64), sizes, name[place].astype(np.int32))], pa.binary()),
            "u": lists(u), "w": lists(w), "c": lists(n[shared] if len(u) else u),
        }
    )


def seat(keys: np.ndarray, c: np.ndarray, t: np.ndarray, table: Table, sweep: Sweep, seed: list[int]) -> np.ndarray:
    """The tables of a bucket's dishes, drawn anew from the tables ``t`` with the figures ``sweep``."""
    u, w = table.place(keys >> _BITS), (keys & np.uint64((1 << 21) - 1)).astype(np.int64)
    others = np.maximum(sweep.tables[u] - t, 0.0).astype(float)
    return Seats(DISCOUNT, STRENGTH).draw(c, t, others, sweep.p[w].astype(float), np.random.default_rng(seed))


def answers(asked: bytes, value: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each unit, the value c - d t of each pair that it asked."""
    units_, sizes, name = unpack(asked)
    value = np.append(value, [1 - DISCOUNT, 0.0]).astype(np.float32)  # at -2 a pair of one customer, at -1 of none
    ends = np.cumsum(sizes)
    for unit, lo, hi in zip(units_.tolist(), (ends - sizes).tolist(), ends.tolist()):
        yield unit, pack(value[name[lo:hi]])


_ANSWER = "unit long, kind int, bucket int, payload binary"


def _answer_rows(kind: int, bucket: int, found: Iterator[tuple[int, bytes]]) -> pa.Table:
    unit, payload = zip(*found)
    return pa.table({"unit": pa.array(unit, pa.int64()), "kind": pa.array([kind] * len(unit), pa.int32()), "bucket": pa.array([bucket] * len(unit), pa.int32()), "payload": pa.array(payload, pa.binary())})


class Model:
    """Counts, units and the sampled seating of a corpus."""

    def __init__(self, docs: DataFrame, frequent: int = FREQUENT, sweeps: int = SWEEPS, burn_in: int = BURN_IN):
        """``docs``: doc_id, text, held_out."""
        self.spark, self.burn_in = docs.sparkSession, burn_in
        self.words = count_words(docs.filter("NOT held_out"))
        self.figures(frequent)
        self.buckets = max(1, -(-self.train_tokens // BUCKET))
        self.sent = self.spark.sparkContext.broadcast(self.table)
        self.units = keep(units(docs, self.sent, self.buckets), "units", "kind")
        merged = self.units.filter(F.col("kind").isin(PAIRS, OTHERS)).groupBy("kind", "bucket").applyInArrow(merge, "kind int, bucket int, dishes binary, asked binary, u array<long>, w array<long>, c array<long>")
        self.pairs = keep(merged, "pairs", "kind")
        drop(self.units, f"kind={PAIRS}", f"kind={OTHERS}")
        release_shuffles(self.spark)
        self.sample(sweeps)

    def figures(self, frequent: int) -> None:
        """Totals, the number of words of each count, and the table of the frequent words.

        The driver gets a row for each level of counts (some thousand) and ``frequent`` + 1 words at most.
        """
        level = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2("n") * 16))
        rows = self.words.groupBy(level.alias("level")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()
        self.train_tokens, self.distinct = sum(r["tokens"] for r in rows), sum(r["words"] for r in rows)
        least, total = 1 << 62, 0
        for r in sorted(rows, key=lambda r: -r["least"]):
            total += r["words"]
            if total > frequent:
                break
            least = r["least"]
        self.least, end = least, int(END)
        most = self.words.filter((F.col("n") >= least) | (F.col("key") == end)).select("key", "n").toArrow()
        keys, n = most["key"].to_numpy().view(np.uint64), most["n"].to_numpy()
        self.table = Table(keys, n, int(n[keys == END].sum()))
        self.whole = len(keys) == self.distinct
        # the other words, by count; where END is no frequent word by count, it is counted in the table
        counts = {} if self.whole else {r["n"]: r["count"] for r in self.words.filter((F.col("n") < least) & (F.col("key") != end)).groupBy("n").count().collect()}
        self.rare_counts = counts

    def root_classes(self, customers: np.ndarray, moved: list) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of customers at the root (frequent words, and the others by count less what ``moved``: n, x, words) and words of each."""
        count: dict[int, int] = dict(self.rare_counts)
        for n, x, words in moved:
            count[n] = count.get(n, 0) - words
            count[n - x] = count.get(n - x, 0) + words
        own, words = np.unique(customers, return_counts=True)
        for c, k in zip(own.tolist(), words.tolist()):
            count[c] = count.get(c, 0) + k
        count = {c: k for c, k in count.items() if c > 0 and k > 0}
        return np.array(sorted(count), np.int64), np.array([count[c] for c in sorted(count)], np.int64)

    def sample(self, sweeps: int) -> None:
        table, size = self.table, len(self.table.n)
        excess, brought = np.zeros(size, np.int64), np.zeros(size, np.int64)  # customers less tables: by restaurant, by word
        root, rng, moved = Root(self.distinct), np.random.default_rng(42), []
        self.history: list[Sweep] = []
        self.told = []
        # of each bucket the dishes, their tables and the sum of the tables after the sweeps that count
        self.seated = self.pairs.filter(F.col("kind") == PAIRS).select("bucket", "dishes", F.lit(None).cast("binary").alias("tables"))
        others = Others(self) if not self.whole else None
        for k in range(sweeps + 1):  # the last figures follow the last sweep
            customers = (table.n - brought)[:-1]
            seated = root.seat(*self.root_classes(customers, moved), rng)
            self.history.append(Sweep(table.n - excess, np.append(seated.of(customers), 0.0), seated))
            self.told.append(self.spark.sparkContext.broadcast(self.history[-1]))  # bounded, sent once
            if k < sweeps:
                excess, brought = self.sweep(self.told[-1], k, size)
                if others:
                    found, moved = others.sweep(self.told[-1], k)
                    at, less = table.place(found[0]), found[1:]
                    np.add.at(excess, at, less[0])
                    np.add.at(brought, at, less[1])
        self.others = others

    def sweep(self, told, number: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Draws all tables anew; returns the customers less tables by restaurant and by word, summed in bounded slices on the executors."""
        sent, width, burn_in = self.sent, 1 << 15, self.burn_in

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, table = np.zeros((2, size), np.int64), sent.value
            for batch in batches:
                for bucket, dishes, tables in zip(*(batch.column(x).to_pylist() for x in ("bucket", "dishes", "tables"))):
                    keys, c = unpack(dishes)
                    t, total = unpack(tables) if tables else (c, np.zeros(len(c), np.int64))  # at first each customer has a table
                    t = seat(keys, c, t, table, told.value, [42, bucket, number])
                    sums[0] += np.bincount(table.place(keys >> _BITS), c - t, minlength=size).astype(np.int64)
                    sums[1] += np.bincount((keys & np.uint64((1 << 21) - 1)).astype(np.int64), c - t, minlength=size).astype(np.int64)
                    yield rows([0], [bucket], [dishes], [pack(t, total + t if number >= burn_in else total)])
            at = [lo for lo in range(0, size, width) if sums[:, lo : lo + width].any()]
            yield rows([1] * len(at), at, [None] * len(at), [pack(sums[0, lo : lo + width], sums[1, lo : lo + width]) for lo in at])

        def rows(kind: list, bucket: list, dishes: list, tables: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(dishes, pa.binary()), pa.array(tables, pa.binary())], ["kind", "bucket", "dishes", "tables"])

        def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in parts:
                for x in batch.column("tables").to_pylist():
                    one = unpack(x)
                    total = one if total is None else [a + b for a, b in zip(total, one)]
                lo = batch.column("bucket").slice(0, 1)
            yield pa.RecordBatch.from_arrays([lo, pa.array([pack(*total)], pa.binary())], ["slice", "payload"])

        out = keep(self.seated.mapInArrow(run, "kind int, bucket int, dishes binary, tables binary"), "seated", "kind")
        before, self.seated = self.seated, out.filter("kind = 0").select("bucket", "dishes", "tables")
        self.seated._kept_path = f"{out._kept_path}/kind=0"
        if number:
            drop(before)
        found = out.filter("kind = 1").select("bucket", "tables").groupBy("bucket").applyInArrow(add, "slice int, payload binary").toArrow()
        excess, brought = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for lo, data in zip(found["slice"].to_pylist(), found["payload"].to_pylist()):
            excess[lo : lo + width], brought[lo : lo + width] = unpack(data)
        return excess, brought

    def answered(self) -> DataFrame:
        """(unit, kind, bucket, payload): what every unit asked about its pairs and its words that are not frequent."""
        kept = len(self.history) - 1 - self.burn_in

        def run(asked: pa.Table, seated: pa.Table) -> pa.Table:
            _, c = unpack(seated["dishes"][0].as_py())
            value = c - DISCOUNT * unpack(seated["tables"][0].as_py())[1] / kept
            return _answer_rows(PAIRS, asked["bucket"][0].as_py(), answers(asked["asked"][0].as_py(), value))

        asked = self.pairs.filter(F.col("kind") == PAIRS).select("bucket", "asked")
        out = asked.groupBy("bucket").cogroup(self.seated.groupBy("bucket")).applyInArrow(run, _ANSWER)
        return out.unionAll(self.others.answered()) if self.others else out

    def score(self) -> DataFrame:
        """doc_id, held_out and the figures of every text."""
        sent, told, burn_in, buckets, train, distinct = self.sent, self.told, self.burn_in, self.buckets, self.train_tokens, self.distinct

        def run(own: pa.Table, replies: pa.Table) -> pa.Table:
            unit, ids = Unit.unpack(own["payload"][0].as_py()), own["ids"].combine_chunks().flatten()
            table, kept = sent.value, [x.value for x in told[burn_in + 1 :]]  # the figures after each sweep that counts
            rows = sorted(zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["payload"].to_pylist()), key=lambda x: x[:2])
            # counts, tables of the restaurant and the root's probability by code; the start is the last
            frequent = table.place(unit.own[: len(unit.own) - len(unit.rare)])
            n = np.zeros(len(unit.own) + 1, np.int64)
            n[: len(frequent)], n[-1] = table.n[frequent], table.n[-1]
            tables, p = (np.zeros((len(kept), len(n))) for _ in range(2))
            for k, sweep in enumerate(kept):
                tables[k, : len(frequent)], tables[k, -1], p[k, : len(frequent)] = sweep.tables[frequent], sweep.tables[-1], sweep.p[frequent]
                p[k, len(frequent) : -1] = sweep.root.unseen
            if words := [unpack(x[2]) for x in rows if x[0] == WORDS]:
                at = len(frequent) + np.argsort(word_bucket_of(unit.rare, buckets), kind="stable")
                n[at] = np.concatenate([x[0] for x in words])
                excess, brought = (np.concatenate([x[i].reshape(-1, len(kept)) for x in words]) for i in (1, 2))
                for k, sweep in enumerate(kept):
                    tables[k, at], p[k, at] = n[at] - excess[:, k], sweep.root.of(n[at] - brought[:, k])
            pairs, place, _ = unit.pairs()
            value = np.zeros(len(pairs))
            found = np.concatenate([unpack(x[2])[0] for x in rows if x[0] != WORDS] or [np.zeros(0)])
            value[by_bucket(pairs, buckets)[0][: len(found)]] = found  # pairs with unseen words, the last ones, are not answered if all others are frequent
            del pairs, found, rows, words
            tables *= DISCOUNT
            tables += STRENGTH
            logs, base, known = np.empty(len(place)), np.empty(len(place)), np.empty(len(place), bool)
            for at in unit.slices():
                before, index = unit.before[at], unit.index[at]
                chance = value[place[at]]
                for k in range(len(kept)):
                    chance += tables[k][before] * p[k][index] / len(kept)
                logs[at] = np.log10(chance / (STRENGTH + n[before]))
                base[at] = np.log10((n[index] + 0.1) / (train + 0.1 * (distinct + 1)))
                known[at] = n[index] > 0
            score, counts = scan.per_text(logs, unit.counts), unit.counts
            out = pa.table(
                {
                    "doc_id": ids, "held_out": pa.array(unit.held), "n_tokens": pa.array(counts), "n_known": pa.array(scan.per_text(known, counts)),
                    "train_tokens": pa.array(np.full(len(counts), train, np.int64)), "base_score": pa.array(scan.per_text(base, counts)), "score": pa.array(score), "perplexity": pa.array(10 ** (-score / counts)),
                }
            )
            scan.release()
            return out

        texts = self.units.filter(F.col("kind") == UNITS).select("unit", "payload", "ids")
        kind = texts.schema["ids"].dataType.elementType.simpleString()
        return texts.groupBy("unit").cogroup(self.answered().groupBy("unit")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


class Others:
    """Dishes with a word that is not in the table of frequent words, seated by joins with the figures of such words."""

    def __init__(self, model: Model):
        self.model = model
        pairs = model.pairs.filter(F.col("kind") == OTHERS).select("bucket", F.explode(F.arrays_zip("u", "w", "c")).alias("x"))
        none = F.array().cast("array<int>")
        self.dishes = keep(pairs.select("bucket", "x.u", "x.w", "x.c", F.col("x.c").alias("t"), none.alias("past")), "dishes")
        rare = lambda c: self.dishes.filter(F.col(c) < 0).select(F.col(c).alias("key"))
        found = rare("u").unionAll(rare("w")).distinct()
        words = model.words.select(F.col("key").bitwiseOR(F.lit(-(1 << 63))).alias("key"), "n")
        zero = F.lit(0).cast("long")
        self.words = keep(found.join(words, "key").select("key", "n", zero.alias("excess"), zero.alias("brought"), none.cast("array<long>").alias("excesses"), none.cast("array<long>").alias("all_brought")), "other_words")

    def sweep(self, told, number: int) -> tuple[list[np.ndarray], list]:
        """Draw all tables anew; returns what ``gather`` does."""
        sent, burn_in = self.model.sent, self.model.burn_in
        of = lambda c, x: self.words.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col(x).alias(f"x{c}"))
        joined = self.dishes.join(of("u", "excess"), "u", "left").join(of("w", "brought"), "w", "left")
        columns = ["bucket", "u", "w", "c", "t"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, sweep, seats = sent.value, told.value, Seats(DISCOUNT, STRENGTH)
            for batch in batches:
                bucket, u, w, c, t, nu, xu, nw, xw = (batch.column(x).fill_null(0).to_numpy(zero_copy_only=False) for x in (*columns, "nu", "xu", "nw", "xw"))
                tables, p = (nu - xu).astype(float), sweep.root.of(nw - xw)
                tables[u >= 0] = sweep.tables[table.place(u[u >= 0].view(np.uint64))]
                p[w >= 0] = sweep.p[w[w >= 0]]
                seed = int(scan.mix(u.view(np.uint64) * _P + w.view(np.uint64)).sum(dtype=np.uint64)) if len(u) else 0
                new = seats.draw(c, t, np.maximum(tables - t, 0.0), p, np.random.default_rng([seed, number]))
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in columns[:-1]), pa.array(new.astype(np.int64)), batch.column("past")], [*columns, "past"])

        # sorted within a task, so that a rerun draws the same numbers
        drawn = joined.select(*columns, "past", "nu", "xu", "nw", "xw").repartition("bucket").sortWithinPartitions("bucket", "u", "w").mapInArrow(run, self.dishes.schema)
        past = F.concat("past", F.array(F.col("t").cast("int"))) if number >= burn_in else F.col("past")
        before, self.dishes = self.dishes, keep(drawn.withColumn("past", past), "dishes")
        drop(before)
        less = F.sum(F.col("c") - F.col("t"))
        excess = self.dishes.filter("u < 0").groupBy(F.col("u").alias("key")).agg(less.alias("e"))
        brought = self.dishes.filter("w < 0").groupBy(F.col("w").alias("key")).agg(less.alias("b"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        words = self.words.drop("excess", "brought").join(excess, "key", "left").join(brought, "key", "left")
        words = words.select("key", "n", zero("e").alias("excess"), zero("b").alias("brought"), "excesses", "all_brought")
        if number >= burn_in:
            words = words.withColumns({"excesses": F.concat("excesses", F.array("excess")), "all_brought": F.concat("all_brought", F.array("brought"))})
        before, self.words = self.words, keep(words, "other_words")
        drop(before)
        return self.gather()

    def gather(self) -> tuple[list[np.ndarray], list]:
        """Of the frequent words: codes, customers less tables by restaurant and by word; and how many others of each count brought how many less."""
        less = F.sum(F.col("c") - F.col("t"))
        zero = F.lit(0).cast("long")
        one = self.dishes.filter("u >= 0").groupBy(F.col("u").alias("key")).agg(less.alias("e")).select("key", "e", zero.alias("b"))
        two = self.dishes.filter("w >= 0").groupBy(F.col("w").alias("key")).agg(less.alias("b")).select("key", zero.alias("e"), "b")
        rows = one.unionAll(two).groupBy("key").agg(F.sum("e").alias("e"), F.sum("b").alias("b")).toArrow()
        moved = self.words.filter("brought > 0").groupBy("n", "brought").count().collect()
        return [rows["key"].to_numpy().view(np.uint64), rows["e"].to_numpy(), rows["b"].to_numpy()], [tuple(r) for r in moved]

    def answered(self) -> DataFrame:
        model, kept = self.model, len(self.model.history) - 1 - self.model.burn_in
        buckets = model.buckets

        def pairs(asked: pa.Table, dishes: pa.Table) -> pa.Table:
            keys, c = unpack(asked["dishes"][0].as_py())
            value = np.zeros(len(keys))
            if dishes.num_rows:
                u, w, n = (dishes[x].to_numpy().astype(np.int64) for x in ("u", "w", "c"))
                past = dishes["past"].combine_chunks().flatten().to_numpy().reshape(len(u), kept)
                own = pair_keys(u.view(np.uint64), w.view(np.uint64))
                value[np.searchsorted(keys, own)] = n - DISCOUNT * past.mean(1)
            return _answer_rows(OTHERS, asked["bucket"][0].as_py(), answers(asked["asked"][0].as_py(), value))

        def words(asked: pa.Table, known: pa.Table) -> pa.Table:
            keys, n = known["key"].to_numpy().view(np.uint64), known["n"].to_numpy().astype(np.int64)
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            past = np.zeros((2, len(keys), kept), np.int32)
            for i, name in enumerate(("excesses", "all_brought")):
                has = known[name].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
                if has.any():
                    rows = np.zeros((len(keys), kept), np.int32)
                    rows[has] = known[name].combine_chunks().drop_null().flatten().to_numpy().reshape(-1, kept)
                    past[i] = rows[order]
            out = []
            for unit, data in zip(asked["unit"].to_pylist(), asked["payload"].to_pylist()):
                want = unpack(data)[0]
                at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
                here = keys[at] == want if len(keys) else np.zeros(len(want), bool)
                take = lambda a: np.where(here.reshape(-1, *(1,) * (a.ndim - 1)), a[at], 0) if len(keys) else np.zeros((len(want), *a.shape[1:]), a.dtype)  # noqa: E731, B023
                out.append((unit, pack(take(n).astype(np.int64), take(past[0]).astype(np.int32).ravel(), take(past[1]).astype(np.int32).ravel())))
            return _answer_rows(WORDS, asked["bucket"][0].as_py(), iter(out)) if out else pa.table({x: pa.array([], t) for x, t in (("unit", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary()))})

        rows = model.pairs.filter(F.col("kind") == OTHERS).select("bucket", "dishes", "asked")
        found = rows.groupBy("bucket").cogroup(self.dishes.groupBy("bucket")).applyInArrow(pairs, _ANSWER)
        asked = model.units.filter(F.col("kind") == WORDS).select("bucket", "unit", "payload")
        known = model.words.filter(F.col("n") < model.least).select(F.col("key").bitwiseOR(F.lit(-(1 << 63))).alias("key"), "n").join(self.words.select("key", "excesses", "all_brought"), "key", "left")
        known = known.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
        return found.unionAll(asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(words, _ANSWER))


def score(docs: DataFrame, out: Column, frequent: int = FREQUENT, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document; those of ``out`` are not learned from."""
    return Model(scan.bounded(docs).select("doc_id", "text", out.alias("held_out")), frequent, sweeps, burn_in).score()
