"""Benchmark decontamination: Wu-Manber search for many word sequences at once.

The alphabet is words, not bytes. Test strings of one length m form a class with a
table of shifts per block of two words: how far the window may move when it ends in
that block. A block that no test string holds allows m - 1 words at once. Where the
shift is 0, the block selects the few test strings that end in it; their first block
and then the words themselves are compared.

The test strings are sent to the tasks in parts of bounded size. Each part beyond the
first is a pass of its own that writes its hits, so any number of items works with one
part in memory; only rows that may have further hits are shuffled.

Defined cases: null or empty texts have no words and no hits; an item without words
never occurs; one without identifier hits words but is not listed; one shorter than the window is a single shorter test string; repeated
rows are searched alike; an empty item table marks nothing; all columns of the input
are kept, one named like a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from keepwell.llm.base import maybe_member, membership, surely_not, unused
from keepwell.session import settle

#: Bytes a-z, 0-9 and everything beyond ASCII stay, A-Z are lower-cased, the rest separates.
_FOLD = bytes(b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32
              for b in range(256))
_GAP = re.compile(r"[\x00-/:-@\[-`{-\x7f]")
PART_BYTES = 8 << 20
SLICE = 1 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def word_slices(text: str, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of ``text`` in order, in lists from slices of about ``size`` characters."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield words_of(text[at:end])
        at = end


class LengthClass:
    """All test strings of ``m`` words."""

    def __init__(self, m: int, strings: dict[tuple[bytes, ...], list[str]]):
        self.m, self.block = m, min(2, m)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[bytes], list[str]]]] = {}
        for words, items in strings.items():
            for end in range(self.block, m + 1):
                part = words[end - self.block:end]
                self.shift[part] = min(self.shift.get(part, m), m - end)
            self.bucket.setdefault(words[-self.block:], []).append((words[:self.block], list(words), items))

    def search(self, words: list[bytes], base: int, hits: list[tuple[int, int]], items: set[str]) -> None:
        """Adds the word spans of all occurrences, counted from ``base``, and the items they belong to."""
        m, far, n, i = self.m, self.m - self.block + 1, len(words), self.m - 1
        if self.block == 1:
            for i, word in enumerate(words):
                if found := self.bucket.get((word,)):
                    hits.append((base + i, base + i + 1))
                    items.update(found[0][2])
            return
        shift = self.shift.get
        while i < n:
            step = shift((words[i - 1], words[i]), far)
            if step:
                i += step
                continue
            start = i - m + 1
            first = (words[start], words[start + 1])
            for head, string, owners in self.bucket[words[i - 1], words[i]]:
                if head == first and words[start:i + 1] == string:
                    hits.append((base + start, base + i + 1))
                    items.update(owners)
            i += 1


def length_classes(items: list[tuple[str, str]], window: int) -> list[LengthClass]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for at in range(len(words) - m + 1 if m else 0):
            owners = by_length.setdefault(m, {}).setdefault(tuple(words[at:at + m]), [])
            if item is not None and item not in owners:
                owners.append(item)
    return [LengthClass(m, strings) for m, strings in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def search_text(text: str | None, classes: list[LengthClass]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged spans of hit words, items that occur. Holds one slice of a long text at a time."""
    longest = max((c.m for c in classes), default=1)
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    n, carry = 0, []
    for part in word_slices(text or ""):
        words, base = carry + part, n - len(carry)
        for c in classes:  # a class sees its own overlap only, else it would report an occurrence twice
            skip = max(0, len(carry) - c.m + 1)
            c.search(words[skip:] if skip else words, base + skip, spans, items)
        n += len(part)
        carry = words[max(0, len(words) - longest + 1):] if longest > 1 else []
        if len(spans) > 10_000:
            spans = merged(spans)
    return n, merged(spans), items


RESULT = "n_words long, starts array<long>, ends array<long>, items array<string>"


def _searcher(spark, items: list[tuple[str, str]], window: int):
    sent = spark.sparkContext.broadcast(items)

    @F.pandas_udf(RESULT)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classes = length_classes(sent.value, window)
        for series in texts:
            found = [search_text(t, classes) for t in series]
            yield pd.DataFrame({
                "n_words": [n for n, _, _ in found], "starts": [[a for a, _ in s] for _, s, _ in found],
                "ends": [[b for _, b in s] for _, s, _ in found], "items": [sorted(i) for _, _, i in found]})

    return search


def _covered(found: Column) -> Column:
    """Words under the union of spans, when several parts of the items were searched."""
    spans = F.array_sort(F.arrays_zip(found["starts"], found["ends"]))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["ends"] - F.greatest(s["starts"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], s["ends"]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, text: str = "text", window: int = 10,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as sorted strings), hit_starts, hit_ends (word spans).

    Items of more than ``part_bytes`` are searched part by part: each part is one job over the
    texts that writes the hits of this part, so a task holds one part however many there are.
    """
    wanted = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))

    def here(k: int) -> list[tuple[str, str]]:
        return [(r.item, r.text) for r in wanted.where(part == k).collect()]  # at most about part_bytes

    name, row = unused(docs, "found"), unused(docs, "row")
    found = docs.withColumn(name, _searcher(docs.sparkSession, here(0), window)(F.col(text)))
    if parts == 1:
        covered = F.aggregate(F.zip_with(F.col(name)["ends"], F.col(name)["starts"], lambda b, a: b - a), F.lit(0).cast("long"),
                              lambda acc, n: acc + n)
        return _told(found, name, covered)
    found = settle(found.withColumn(row, F.monotonically_increasing_id()), "texts")
    hits = None
    for k in range(1, parts):
        mine = found.select(F.col(row).alias("row"), _searcher(docs.sparkSession, here(k), window)(F.col(text)).alias("found"))
        mine = settle(mine.where(F.size("found.starts") > 0).select("row", "found.starts", "found.ends", "found.items"), "part-hits")
        hits = mine if hits is None else hits.unionByName(mine)
    more = hits.groupBy("row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")])  # a row per part
    more = settle(more.select(F.col("row").alias(row), F.struct("starts", "ends", "items").alias(more_name := unused(found, "more"))), "further-hits")
    bits = membership(more, row)
    first, others = F.col(name), F.col(more_name)
    both = F.struct(first["n_words"].alias("n_words"), F.concat(first["starts"], others["starts"]).alias("starts"),
                    F.concat(first["ends"], others["ends"]).alias("ends"), F.array_union(first["items"], others["items"]).alias("items"))
    joined = maybe_member(found, row, bits).join(more, row, "left")
    joined = joined.withColumn(name, F.when(others.isNotNull(), both).otherwise(first)).select(*found.columns)
    return _told(surely_not(found, row, bits).unionByName(joined).drop(row), name, _covered(F.col(name)))


def _told(found: DataFrame, name: str, covered: Column) -> DataFrame:
    mine = F.col(name)
    return found.withColumns({"n_words": mine["n_words"], "n_hit": covered, "items": F.array_sort(mine["items"]),
                              "hit_starts": mine["starts"], "hit_ends": mine["ends"]}).drop(name)
