"""Vector bin packing of token pieces into training sequences.

Every document is a list of ids. What fills whole sequences is cut off first; the rest of each
document is an item with three demands: tokens, segments (one) and loss-bearing tokens, which are its
last ones (an answer follows its prompt). An open
sequence takes, again and again, the item that fits and has the largest dot product of its demands
with the sequence's remaining room, both as shares of the limits. If nothing fits, the longest item
is cut so that the sequence becomes full. A sequence that another limit closes, or the end of a task, is
cut back to a power of two and what is cut waits for another one, so nothing is padded, whatever the
lengths. Each task packs its own rows, in windows of ``WINDOW`` items, so nothing
is shuffled and a lost task is repeated alone, with the same outcome. Of a waiting document only the
ids that wait are held, under ``LENGTH`` of them.

Special tokens that a text spells (such as an end-of-text mark) get their ids, as the tokenizers file says;
with ``literal`` they are spelled by other tokens, so that no text can end a document.

Defined results: a null text is an empty one and holds the end id only; repeated rows are packed each;
ties take the earlier item; a null or negative loss is none and a larger one than the tokens is all; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

LENGTH = 1024
#: Documents that may meet in one sequence.
SEGMENTS = 64
#: Items that are placed together.
WINDOW = 2048
#: Distinct stretches (a blank and what follows it) of which a worker remembers the ids, in each of two generations.
REMEMBERED = 60_000

_DOUBLE = re.compile(r" \s")


def _byte_of() -> dict[str, int]:
    """The byte behind each printable character of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}


class Tokens:
    """Ids of texts by a tokenizers file, as little-endian 32-bit bytes.

    Texts are encoded by tiktoken with the ranks of the same file, which takes a fifth of the time, if the
    file is of that kind and a probe gives the same ids; else by tokenizers itself. Then, as in a byte-level
    vocabulary with the usual word pattern no token reaches over a blank that a non-blank follows, the
    ids of such stretches are remembered and joined; texts with a blank before white space are encoded whole.
    """

    PROBE = "It's 12,345 élèves'll say:  \n\n«naïve» — 日本語 \t x_y!! <|x|> don't \u00a0 Größe\r\n"

    def __init__(self, content: str, literal: bool = False):
        """``content``: the tokenizers file."""
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(content)
        self.tool.encode_special_tokens = literal
        added = [x.content for x in self.tool.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added and not literal else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ranked = self._ranked()
        self.one = self.ranked or self._slow

    def _slow(self, text: str) -> list[int]:
        return self.tool.encode(text, add_special_tokens=False).ids

    def _ranked(self):
        """tiktoken's encoder for the vocabulary, or None."""
        try:
            import tiktoken

            byte = _byte_of()
            special = {x.content for x in self.tool.get_added_tokens_decoder().values()}
            ranks = {bytes(byte[c] for c in k): v for k, v in self.tool.get_vocab().items() if k not in special}
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            found = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            return found if found(self.PROBE) == self._slow(self.PROBE) else None
        except (ImportError, KeyError, ValueError):
            return None

    def _new(self, word: str) -> bytes:
        """The ids of a blank and ``word``, which is not among the young ones."""
        ids = self.young.get(word) or self.old.get(word)
        if ids is None:
            ids = array("I", self.one(" " + word)).tobytes()
        if len(word) < 64:
            if len(self.young) >= REMEMBERED:  # what was not used since the last turn goes
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return array("I", self._slow(text)).tobytes()
        if self.ranked or _DOUBLE.search(text):
            return array("I", self.one(text)).tobytes()
        first, *words = text.split(" ")
        found = list(map(self.young.get, words))
        if None in found:
            found = [self._new(w) if x is None else x for x, w in zip(found, words)]
        return b"".join([array("I", self.one(first)).tobytes() if first else b"", *found])


_TOKENS: dict[tuple, Tokens] = {}


def tokens(path: str, content: str, literal: bool = False) -> Tokens:
    """The tool of this worker, which later tasks find with what it remembers."""
    if (path, literal) not in _TOKENS:
        _TOKENS[path, literal] = Tokens(content, literal)
    return _TOKENS[path, literal]


def power(n: int) -> int:
    """The largest power of two up to ``n``."""
    return 1 << (int(n).bit_length() - 1)


class Packer:
    """Packs items (key, tokens, of which the last ``loss`` bear loss) of one task; ``out`` gets (key, start, length, sequence, offset)."""

    def __init__(self, base: int, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None):
        self.room = np.array([length, segments, loss or length], float)
        self.length, self.next = length, base
        self.keys: list = []
        self.start, self.tokens, self.loss = [], [], []
        self.out: list[tuple] = []

    def add(self, key, tokens: int, loss: int) -> int:
        """One document. Whole sequences are cut off at once; returns where the rest begins, that waits."""
        start, loss = 0, max(0, min(tokens, loss))
        while tokens - start:
            free = max(0, tokens - start - loss)
            most = min(self.length, free + int(self.room[2]))
            most = most if most == self.length else power(most)
            if tokens - start < most:
                break
            self.out.append((key, start, most, self.next, 0))
            self.next += 1
            loss -= max(0, most - free)
            start += most
        if start < tokens:
            self.keys.append(key)
            self.start.append(start)
            self.tokens.append(tokens - start)
            self.loss.append(loss)
        return start

    def place(self, last: bool) -> None:
        """Place the waiting items. All but the last call leave what can't fill a sequence to the next one."""
        start, tokens = np.array(self.start, np.int64), np.array(self.tokens, np.int64)
        loss, left = np.array(self.loss, np.int64), int(sum(self.tokens))
        while left and (last or left >= self.length * 8):
            size = self.length if left >= self.length else power(left)
            room, offset, pieces = self.room.copy(), 0, []
            room[0] = size
            while room[0] >= 1 and room[1] >= 1 and left:
                fits = (tokens > 0) & (tokens <= room[0]) & (loss <= room[2])
                score = np.where(fits, tokens * (room[0] / self.room[0] ** 2) + room[1] / self.room[1] ** 2 + loss * (room[2] / self.room[2] ** 2), -1.0)
                at = int(np.argmax(score))
                take = int(tokens[at])
                if score[at] < 0:  # nothing fits: the item of which most does is cut
                    most = np.minimum(tokens, np.minimum(room[0], tokens - loss + room[2])).astype(np.int64)
                    at = int(np.argmax(most))
                    take = int(most[at])
                    if take < 1:
                        break
                bearing = max(0, take - int(tokens[at] - loss[at]))
                pieces.append((at, take, bearing))
                start[at], tokens[at], loss[at] = start[at] + take, tokens[at] - take, loss[at] - bearing
                offset, left = offset + take, left - take
                room -= (take, 1, bearing)
            over = 0 if offset == self.length else offset - power(offset)
            while over:  # give back from the end
                at, take, bearing = pieces.pop()
                back = min(take, over)
                lost = min(bearing, back)
                start[at], tokens[at], loss[at] = start[at] - back, tokens[at] + back, loss[at] + lost
                over, left = over - back, left + back
                if take > back:
                    pieces.append((at, take - back, bearing - lost))
            taken = dict.fromkeys(at for at, _, _ in pieces)
            begin = {at: int(start[at]) - sum(t for a, t, _ in pieces if a == at) for at in taken}
            offset = 0
            for at, take, _ in pieces:
                self.out.append((self.keys[at], begin[at], take, self.next, offset))
                begin[at], offset = begin[at] + take, offset + take
            self.next += 1
        rest = np.flatnonzero(tokens)
        self.keys = [self.keys[i] for i in rest]
        self.start, self.tokens, self.loss = (x[rest].tolist() for x in (start, tokens, loss))


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 0, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, with_ids: bool = False, bearing: str | None = None, literal: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on demand its ids.

    ``vocabulary`` is the path of a tokenizers file, read here and sent to the tasks. ``bearing`` names
    a column of text whose tokens bear loss, as an answer that ends the document's text (the end id bears loss too);
    without it every token but a document's first does. ``loss`` is the limit of such tokens of a sequence.
    """
    with open(vocabulary, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())  # of the size of that file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens(vocabulary, sent.value, literal)
        packer = Packer(TaskContext.get().partitionId() << 33, length, segments, loss)
        held: dict[int, tuple] = {}  # of the rows that wait: doc_id, tokens, where the rest begins, and its ids
        end, row = np.array([end_id], "<u4").tobytes(), 0
        made: list[tuple] = []

        def take() -> None:
            for k, a, n, s, o in packer.out:
                key, total, first, ids = held[k]
                piece = ids[4 * (a - first) : 4 * (a - first + n)]
                made.append((key, a, n, zlib.crc32(piece), total, s, o, *[piece] * with_ids))
            packer.out = []

        def flush() -> Iterator[pa.RecordBatch]:
            if made:
                columns = list(zip(*made))
                arrays = [pa.array(c, t) for c, t in zip(columns, (kind, *(pa.int64(),) * 6))]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<i4") for x in columns[7]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)
                made.clear()

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("doc_id").type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                answers = part.column("bearing").to_pylist() if bearing else [None] * part.num_rows
                for key, text, answer in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), answers):
                    ids = tool.ids(text or "") + end
                    n = len(ids) // 4
                    held[row] = (key, n, 0, ids)
                    first = packer.add(row, n, len(tool.ids(answer or "")) // 4 + 1 if bearing else n - 1)
                    take()  # the whole sequences of this document
                    if first < n:
                        held[row] = (key, n, first, ids[4 * first :])
                    else:
                        del held[row]
                    row += 1
                    if len(made) >= 1024:
                        yield from flush()
                if len(packer.keys) >= WINDOW:
                    packer.place(False)
                    take()
                    waiting = set(packer.keys)
                    held = {k: v for k, v in held.items() if k in waiting}
                yield from flush()
        packer.place(True)
        take()
        yield from flush()
        scan.release()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    kind_name = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", F.col("text").cast("string").alias("text"), *([F.col(bearing).cast("string").alias("bearing")] if bearing else [])]
    return scan.bounded(docs).select(*columns).mapInArrow(run, f"doc_id {kind_name}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
