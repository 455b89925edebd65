"""Packing: vector bin packing with the dot-product heuristic.

Every example has a demand for tokens, segments and loss-bearing tokens; a sequence
has a limit for each. A sequence is filled greedily: of the waiting examples that
fit, the one with the largest dot product of weighted demand and remaining room goes
in next, so examples that use up what is scarce are matched with sequences that have
it left. Weights are the mean demands of the waiting examples, as shares of the limits.

Packing happens where the rows are: each task keeps a waiting pool of bounded size,
hands out finished sequences and carries the rest on, so nothing is shuffled and no
task holds more than its pool. Sequence numbers are (partition << 32) + count.

* ``pack_examples`` never cuts an example (instruction data).
* ``pack_texts`` tokenises texts and may cut them: a full sequence is cut off while a
  text is longer than the limit, the rest waits in the pool, a gap that no waiting
  rest fits is filled by cutting one. What a task has left at its end is split into
  sequences of power-of-two lengths, which need no padding.

Defined cases: a null or empty text is the end id alone; null keys and repeated rows
are packed as rows of their own; an example that alone exceeds a limit gets a sequence
of its own, marked by ``fits = false``; null demands count as 0; an empty table gives
no rows; other input columns are not read.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], dtype=np.float64)


class Pool:
    """Waiting demands as rows of (tokens, segments, loss); rows are taken or shortened."""

    def __init__(self, limits: Limits):
        self.limit = limits.vector()
        self.demand = np.zeros((0, 3))
        self.items: list = []

    def __len__(self) -> int:
        return len(self.items)

    def extend(self, items: list, demand: list[tuple[int, int, int]]) -> None:
        if items:
            self.items += items
            self.demand = np.concatenate([self.demand, np.array(demand, dtype=np.float64)])

    def begin(self) -> None:
        """Start of a round of filling: fixes the weights and the set of free rows."""
        self.free = np.ones(len(self.items), dtype=bool)
        self.score = self.demand * (self.demand.mean(axis=0) / self.limit / self.limit / self.limit) if len(self) else self.demand

    def best(self, room: np.ndarray) -> int:
        """The free row that fits and has the largest dot product with ``room``; -1 if none fits."""
        fits = self.free & (self.demand <= room).all(axis=1)
        value = np.where(fits, self.score @ room, -1.0)
        at = int(value.argmax()) if len(value) else -1
        return at if at >= 0 and fits[at] else -1

    def longest(self) -> int:
        tokens = np.where(self.free, self.demand[:, 0], -1)
        at = int(tokens.argmax()) if len(tokens) else -1
        return at if at >= 0 and tokens[at] > 0 else -1

    def shorten(self, at: int, demand: tuple[int, int, int]) -> None:
        self.score[at] *= np.array(demand) / np.maximum(self.demand[at], 1)
        self.demand[at] = demand

    def keep_free(self) -> None:
        self.items = [x for x, f in zip(self.items, self.free) if f]
        self.demand = self.demand[self.free]


def _sequence_ids() -> Iterator[int]:
    n = TaskContext.get().partitionId() << 32
    while True:
        yield n
        n += 1


def pack_examples(examples: DataFrame, key: str, limits: Limits, tokens: str = "n_tokens", segments: str = "n_segments",
                  loss: str = "n_loss", pool_rows: int = 4096) -> DataFrame:
    """One row per example: key, its demands, sequence_id, offset (tokens before it there), fits."""
    names = [key, tokens, segments, loss]
    source = examples.select(key, *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in names[1:]])
    schema = T.StructType([*source.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType()), T.StructField("fits", T.BooleanType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, ids = Pool(limits), _sequence_ids()

        def filled(last: bool) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            pool.begin()
            left = len(pool)
            while left > (0 if last else pool_rows // 2):
                room, offset, number, empty = pool.limit.copy(), 0, next(ids), True
                while left:
                    at = pool.best(room)
                    if at < 0 and not empty:
                        break
                    fits = at >= 0
                    if not fits:  # exceeds a limit by itself
                        at = int(np.flatnonzero(pool.free)[0])
                    rows.append((pool.items[at], *pool.demand[at].astype(int).tolist(), number, offset, fits))
                    offset += int(pool.demand[at, 0])
                    room -= pool.demand[at]
                    pool.free[at], empty, left = False, False, left - 1
                    if not fits:
                        break
            pool.keep_free()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, pool_rows):
                part = batch.slice(at, pool_rows)
                pool.extend(part.column(0).to_pylist(), list(zip(*[part.column(i).to_pylist() for i in (1, 2, 3)])))
                yield from filled(False)
        yield from filled(True)

    return source.mapInArrow(run, schema)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkIds(dict):
    """Ids of a chunk without white space, as little-endian 32-bit numbers, looked up or computed once.

    The tokenizer drops white space and never joins across it, so a text is the
    concatenation of its chunks. Plain words go to the vocabulary model directly,
    after the same normalisation; everything else takes the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.letters = _byte_letters()

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def compute(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if len(text) > 1 and text[-1] in ".," and text[:-1].isalpha():
            return self[chunk[:-1]] + self[chunk[-1:]]
        if text.isalpha() and max(text) < "\u2000" and unicodedata.is_normalized("NFC", text):
            low = "".join(map(str.lower, text))
            if low.isalpha() and len(low) < 100:
                tokens = self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, low.encode())))
                return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return self.whole(text)

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.compute(chunk)
        if len(self) >= self.most:
            self.clear()
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def text_ids(self, text: bytes) -> bytes:
        if b"<|" in text:  # may spell a special token, which is matched before lower-casing
            return self.whole(text.decode())
        return b"".join(map(self.__getitem__, text.lower().split()))


_CHUNKS: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One table per Python worker."""
    if path not in _CHUNKS:
        _CHUNKS[path] = ChunkIds(path)
    return _CHUNKS[path]


@dataclass
class _Rest:
    key: object
    start: int
    ids: memoryview  # of 32-bit ids as bytes
    total: int


def pack_texts(docs: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits(),
               pool_rows: int = 1024) -> DataFrame:
    """Pieces of the token streams of ``docs``, placed into sequences.

    Returns the key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    sequence_tokens (the length the sequence has or is padded to). A piece of n ids
    has demands (n, 1, n - 1): its first id is not predicted within the piece.
    """
    source = docs.select(key, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    long = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([source.schema[0], *map(long, ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    full = min(limits.tokens, limits.loss + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pool, ids, end = chunk_ids(tokenizer_path), Pool(limits), _sequence_ids(), struct.pack("<I", end_id)
        rows: list[tuple] = []

        def emit(rest: _Rest, at: int, n: int, number: int, offset: int, tokens: int) -> None:
            rows.append((rest.key, rest.start + at, n, zlib.crc32(rest.ids[4 * at: 4 * (at + n)]), rest.total, number, offset, tokens))

        def close(parts: list[tuple[_Rest, int, int]], used: int) -> None:
            """One sequence if it is full, else sequences of power-of-two lengths."""
            parts, size = parts[::-1], limits.tokens if used == limits.tokens else 1 << (used.bit_length() - 1)
            while parts:
                number, offset = next(ids), 0
                while offset < size:
                    rest, at, n = parts.pop()
                    take = min(n, size - offset)
                    emit(rest, at, take, number, offset, size)
                    offset += take
                    if take < n:
                        parts.append((rest, at + take, n - take))
                used -= size
                size = 1 << (used.bit_length() - 1) if used else 0

        def filled(last: bool) -> None:
            pool.begin()
            left = int(pool.demand[:, 0].sum()) if len(pool) else 0
            floor = 0 if last else left // 4  # what is left keeps a choice of sizes
            cut = np.zeros(len(pool), dtype=np.int64)  # ids already taken from the front of each rest
            while left > floor and (last or left >= limits.tokens):
                room, parts = pool.limit.copy(), []
                while room.min() >= 0 and room[0] > 0 and room[1] >= 1 and left:
                    at = pool.best(room)
                    if at < 0:
                        at = pool.longest()
                        n = int(min(room[0], room[2] + 1))
                        if at < 0 or n <= 0:
                            break
                        parts.append((pool.items[at], int(cut[at]), n))
                        cut[at] += n
                        remaining = int(pool.demand[at, 0]) - n
                        pool.shorten(at, (remaining, 1, remaining - 1))
                    else:
                        n = int(pool.demand[at, 0])
                        parts.append((pool.items[at], int(cut[at]), n))
                        pool.free[at] = False
                    room -= (n, 1, n - 1)
                    left -= n
                close(parts, sum(p[2] for p in parts))
            for at in np.flatnonzero(cut):
                if pool.free[at]:
                    r, c = pool.items[at], int(cut[at])
                    pool.items[at] = _Rest(r.key, r.start + c, r.ids[4 * c:], r.total)
            pool.keep_free()

        def flushed() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                rows.clear()

        for batch in batches:
            waiting: list[_Rest] = []
            for key_value, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                stream = memoryview(table.text_ids(content.as_buffer().to_pybytes()) + end)
                total, at = len(stream) // 4, 0
                while total - at >= full:
                    whole = _Rest(key_value, 0, stream, total)
                    close([(whole, at, full)], full)
                    at += full
                if at < total:
                    waiting.append(_Rest(key_value, at, memoryview(bytes(stream[4 * at:])), total))
                if len(waiting) >= pool_rows:
                    pool.extend(waiting, [(n := r.total - r.start, 1, n - 1) for r in waiting])
                    waiting = []
                    filled(False)
                if len(rows) > 20_000:
                    yield from flushed()
            pool.extend(waiting, [(n := r.total - r.start, 1, n - 1) for r in waiting])
            if len(pool) >= pool_rows:
                filled(False)
            yield from flushed()
        filled(True)
        yield from flushed()

    return source.mapInArrow(run, schema)
