"""SimHash near-dedup with pivot distance tables.

A fingerprint is described by its Hamming distances to many reference fingerprints:
an origin, one neighbour of the origin per bit, and a number of far references. By
the triangle inequality two fingerprints at distance d or less differ by at most d in
every coordinate, so a pair whose largest coordinate difference is greater is
discarded without a look at the fingerprints; survivors are verified.

Which pairs meet also follows from the table. Distances to a neighbour of the origin,
less the distance to the origin, depend on one bit only, so the relative coordinates
of a block of neighbours are equal for two fingerprints that agree there. With the
bits in five blocks, at most three differing bits leave at least two blocks alike:
pairs within the limit meet under one of ten keys of two blocks, and only rows that
share a key are compared.

Copies are reduced to one row per fingerprint first. Rows under a key are compared in
units of bounded size, a large key in all pairs of its slices; a unit returns a
spanning forest of its links, never all of them. Components come from these links.

Defined cases: null and empty texts have fingerprint zero and link like any other;
repeated rows share their component; null identifiers are ignored when the smallest
identifier is taken; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from keepwell.llm.components import components
from keepwell.session import settle

WIDTH = 64
SLICE = 1 << 20
UNIT = 2000


def _scrambled(n: int) -> int:
    """A fixed 64-bit pattern for a number."""
    return xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed=42)


ORIGIN = _scrambled(0)
NEAR = [ORIGIN ^ (1 << b) for b in range(WIDTH)]
FAR = [_scrambled(i + 1) for i in range(16)]

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _word_slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; bit b is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    ones, n, carry = np.zeros(WIDTH, dtype=np.int64), 0, []
    code = xxhash.xxh64_intdigest

    def add(hashes: list[int]) -> None:
        nonlocal n
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[:] += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)

    for part in _word_slices((text or "").encode()):
        words = carry + part
        if len(words) >= shingle:
            line = b" ".join(words)
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = ends - sizes
            spans = list(zip(starts.tolist(), ends[shingle - 1:].tolist()))
            for at in range(0, len(spans), 1 << 16):
                add([code(line[a:b], 42) for a, b in spans[at:at + (1 << 16)]])
        carry = words[max(0, len(words) - shingle + 1):] if shingle > 1 else []
    if n == 0 and carry:
        add([code(b" ".join(carry), 42)])
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > n))


def fingerprints(shingle: int = 3):
    """Column function: the fingerprint of a text as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in series], dtype=np.uint64).view(np.int64))

    return prints


def _signed(n: int) -> Column:
    return F.lit(n - (1 << WIDTH) if n >> (WIDTH - 1) else n)


def pivot_table(prints: DataFrame) -> DataFrame:
    """``fp`` with its coordinates: ``origin``, ``near`` (64, in the order of the bits), ``far`` (16)."""
    distance = lambda ref: F.bit_count(F.col("fp").bitwiseXOR(_signed(ref)))
    return prints.withColumns({"origin": distance(ORIGIN), "near": F.array(*map(distance, NEAR)), "far": F.array(*map(distance, FAR))})


def _keys(distance: int, spare: int) -> list[Column]:
    """Keys of ``spare`` blocks out of ``distance + spare``, from relative near coordinates."""
    blocks = distance + spare
    cuts = [WIDTH * i // blocks for i in range(blocks + 1)]
    code = [F.aggregate(F.slice("near", a + 1, b - a), F.lit(0).cast("long"),
                        lambda acc, c: acc * 2 + ((c - F.col("origin") + 1) / 2).cast("long")) for a, b in zip(cuts, cuts[1:])]
    return [F.xxhash64(F.lit(n), *[code[b] for b in chosen]) for n, chosen in enumerate(combinations(range(blocks), spare))]


def _unit_links(prints: np.ndarray, far: np.ndarray, slices: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows of a unit (across its two slices, if it has two)."""
    n = len(prints)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            out.append((int(prints[i]), int(prints[j])))

    across = slices.min() != slices.max()
    order = np.argsort(far[:, 0], kind="stable")
    prints, far, slices = prints[order], far[order], slices[order]
    reach = np.searchsorted(far[:, 0], far[:, 0] + distance, side="right")
    for i in range(n - 1):
        near = np.arange(i + 1, reach[i])
        if across:
            near = near[slices[near] != slices[i]]
        for c in range(1, far.shape[1]):  # the largest coordinate difference, one coordinate after the other
            if not len(near):
                break
            near = near[np.abs(far[near, c] - far[i, c]) <= distance]
        if len(near):
            differing = np.bitwise_count(prints[near] ^ prints[i])
            for j in near[differing <= distance]:
                link(i, int(j))
    return out


def links(prints: DataFrame, distance: int = 3, spare: int = 2, unit: int = UNIT) -> DataFrame:
    """(u, v): enough links between distinct ``fp`` at ``distance`` or less to connect what is connected."""
    packed = lambda lo: F.aggregate(F.slice("far", lo + 1, 8), F.lit(0).cast("long"), lambda acc, c: F.shiftleft(acc, 8).bitwiseOR(c.cast("long")))
    rows = pivot_table(prints).select("fp", packed(0).alias("far0"), packed(8).alias("far1"), F.explode(F.array(*_keys(distance, spare))).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / unit).cast("int")
    units = (rows.join(shared, "key").withColumn("parts", parts)
             .withColumn("slice", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("key", (F.least("slice", "other") * F.col("parts") + F.greatest("slice", "other")).cast("long").alias("unit"),
                     "slice", "fp", "far0", "far1"))
    width = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        held = np.zeros((0, 6), dtype=np.int64)

        def compare(rows: np.ndarray) -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            if len(rows) == 2:
                (*_, s, a, a0, a1), (*_, t, b, b0, b1) = rows.tolist()
                if a == b or max(abs(x - y) for p, q in ((a0, b0), (a1, b1)) for x, y in zip((p & _M).to_bytes(8, "big"), (q & _M).to_bytes(8, "big"))) > distance:
                    return []
                return [(a, b)] if ((a ^ b) & _M).bit_count() <= distance else []
            far = np.ascontiguousarray(rows[:, 4:6].astype(">i8")).view(np.uint8).reshape(len(rows), 16).astype(np.int16)
            found = _unit_links(rows[:, 3].view(np.uint64) if rows[:, 3].flags.c_contiguous else rows[:, 3].copy().view(np.uint64), far, rows[:, 2], distance)
            return [(a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b) for a, b in found]

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1 if len(rows) else []
            pairs = [p for part in np.split(rows, edges) for p in compare(part)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], schema=schema)

        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
            start = len(held) - 1
            while start > 0 and (held[start - 1, :2] == held[-1, :2]).all():
                start -= 1
            yield from flush(held[:start])
            held = held[start:]
        yield from flush(held)

    return units.repartition(width, "key", "unit").sortWithinPartitions("key", "unit").mapInArrow(run, "u long, v long")


_M = (1 << 64) - 1


def near_duplicates(docs: DataFrame, key: str, text: str, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per row of ``docs``: key, fp (signed), component_id (smallest key reachable)."""
    prints = settle(docs.select(F.col(key).alias("id"), fingerprints(shingle)(F.col(text)).alias("fp")), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    rooted = components(links(distinct.select("fp"), distance))
    member = distinct.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    return (prints.join(member.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "fp")
            .select(F.col("id").alias(key), "fp", "component_id"))
