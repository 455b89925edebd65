"""Which tokens of two tokenizers cover the same bytes, and how often they do so corpus-wide.

A text's tokens end at ascending byte offsets. Offsets where tokens of both sides end cut
the text into groups; every A token and every B token of a group are linked.

1. ``aligned`` runs both tokenizers, finds the common ends by galloping search (the side
   with fewer tokens drives an exponential and then a binary search through the other),
   slices the groups between them and gives each document its distinct linked id pairs.
2. ``pair_counts`` counts documents per id pair and marks each A id's highest.
3. ``link_scores`` looks the counts of a document's pairs up again. Pairs in many documents
   are sent to the tasks, at most ``SENT_PAIRS`` of them; the rest, each in few documents,
   meets the counts in a shuffle join. The result does not depend on that split.

Texts are read in blocks of bounded size. Large groups are never spelled out as links:
equal ids are counted first. Tokenizing a text is cut before single words where the files
allow it, and a word seen before is looked up.

Defined cases: a null or empty text, and one whose tokens of either side do not join to
its bytes, has no tokens: zeros and empty lists. Repeated rows count as documents of their
own; null keys pass through; an empty table gives no rows. Only the key and the text are
read, so other columns may have any name.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from keepwell.session import settle

BLOCK_CHARS = 500_000
BLOCK_ROWS = 2048
LINKS_AT_ONCE = 1 << 22
LARGE_GROUP = 4096  # links from which a group's equal ids are counted before they are paired
TABLE_WORDS = 1 << 18
TABLE_PAIRS = 1 << 22
SENT_PAIRS = 1 << 20
LANE = 64

#: Fixed value: the split of byte-level tokenizer files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S)(?= +[^ ])")


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Side A: a byte-level tokenizer file; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters, vocabulary = _byte_letters(), self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in letters for c in token)
            self.bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        split = parts.get("pre_tokenizer") or {}
        #: The byte-level pattern never joins a space to what stands before it.
        self.words = (parts.get("normalizer") is None and split.get("type") == "ByteLevel"
                      and not split.get("add_prefix_space", True) and split.get("use_regex", True))
        self.ranked = self._ranked(parts["model"]) if self.words else None

    def _ranked(self, model: dict):
        """The same vocabulary as ranks, where ids stand in the order of the merges: a faster library then gives the same ids."""
        if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(set(merged)) or (merged and merged[0] < 256):
            return None
        import tiktoken

        special = {t["id"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]}
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in special}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            encode = self.ranked.encode_ordinary
            return [encode(" " + t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Side B: a SentencePiece model, which puts a space in front of a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(names)]
        probe = "a  ﬁ éé \t  b "
        #: No piece has a space after another character, and texts are taken as they are.
        self.words = (all(re.fullmatch("▁*[^▁]*", p) for p in names)
                      and self.model.normalize(probe) == "▁" + probe.replace(" ", "▁"))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def common_ends(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both ascending lists of the values that both hold.

    Galloping search: from where the last value was met, steps double until the wanted value is
    passed, then halve. Runs of ``LANE`` driving values go side by side, each from its own start.
    """
    n, m = len(short), len(long)
    met = np.full(n, -1, dtype=np.int64)
    if n and m:
        long = np.append(long, np.iinfo(np.int64).max)
        heads = np.arange(0, n, LANE)
        place = np.searchsorted(long[:m], short[heads])
        for k in range(min(LANE, n)):
            at = heads + k
            at = at[at < n]
            place = place[:len(at)]
            wanted = short[at]
            low, high, step = place.copy(), place.copy(), 1
            behind = np.flatnonzero(long[high] < wanted)
            while len(behind):
                low[behind] = high[behind] + 1
                high[behind] = np.minimum(high[behind] + step, m)
                step *= 2
                behind = behind[long[high[behind]] < wanted[behind]]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                below = long[middle] < wanted[open_]
                low[open_] = np.where(below, middle + 1, low[open_])
                high[open_] = np.where(below, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            place = low
            hit = long[place] == wanted
            met[at[hit]] = place[hit]
    found = np.flatnonzero(met >= 0)
    return found, met[found]


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys with their summed times; most occur once and are sorted without their times."""
    once = np.sort(keys[times == 1])
    first = np.flatnonzero(np.append(True, once[1:] != once[:-1])) if len(once) else np.empty(0, np.int64)
    single, n = once[first], np.diff(np.append(first, len(once)))
    if len(once) == len(keys):
        return single, n
    keys, times = np.append(single, keys[times != 1]), np.append(n, times[times != 1])
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times, first)


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., n[0] of them, then those from first[1] on, and so forth."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def distinct_links(ids: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], text: np.ndarray,
                   width: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending text * span + a * width + b over all links of all groups, and how often each occurs.

    ``sizes`` are the tokens of each group on both sides, ``text`` the text of each group.
    """
    na, nb = sizes
    first_a, first_b = (np.cumsum(s) - s for s in sizes)
    links = na * nb
    large = links > LARGE_GROUP
    keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def keep(found: tuple[np.ndarray, np.ndarray]) -> None:
        keys.append(found[0])
        times.append(found[1])

    small = np.flatnonzero(~large)
    before = np.cumsum(links[small]) // LINKS_AT_ONCE
    for part in np.split(small, np.flatnonzero(np.diff(before)) + 1):
        # A tokens of these groups, each repeated for every B token of its group
        group, a = np.repeat(part, na[part]), _places(first_a[part], na[part])
        n = nb[group]
        key = np.repeat(text[group] * span + ids[0][a] * width, n) + ids[1][_places(first_b[group], n)]
        keep(_summed(key, np.ones(len(key), dtype=np.int64)))
    for g in np.flatnonzero(large):
        ua, ca = np.unique(ids[0][first_a[g]:first_a[g] + na[g]], return_counts=True)
        ub, cb = np.unique(ids[1][first_b[g]:first_b[g] + nb[g]], return_counts=True)
        step = max(1, LINKS_AT_ONCE // len(ub))
        for i in range(0, len(ua), step):
            keep(((text[g] * span + ua[i:i + step, None] * width + ub).ravel(), (ca[i:i + step, None] * cb).ravel()))
    return _summed(np.concatenate(keys), np.concatenate(times))


class Aligner:
    """Both tokenizers, loaded once per worker, and what was found for words seen before.

    A word is what stands between cut spaces; where the files allow no cut it is the text.
    Both sides end a token at its end, so a text's groups are those of its words.
    """

    def __init__(self, path_a: str, path_b: str):
        self.sides = (ByteLevel(path_a), Pieces(path_b))
        self.cut = all(s.words for s in self.sides)
        self.lengths = [np.array([len(b) for b in s.bytes], dtype=np.int64) for s in self.sides]
        self.width = len(self.sides[1].bytes)
        self.span = len(self.sides[0].bytes) * self.width
        # per id: inside a group, and as its side's last one there
        self.spelled = np.array([f"{i}{end}" for s, last in zip(self.sides, "|;") for i in range(len(s.bytes)) for end in "," + last], dtype=object)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = {n: array("q") for n in ("n_a", "n_b", "n_groups", "n_links", "sound")}
        self.bounds, self.pairs, self.times = array("q", [0]), array("q"), array("q")

    def words(self, text: str) -> list[str]:
        """What stands after the cut spaces of space+text."""
        if not text:
            return []
        if not self.cut:
            return [text]
        if text.isprintable() and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [p[1:] for p in CUT.split(" " + text)]

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if not new:
            return
        found = self.align(new)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.groups.extend(found["groups"])
        for n, values in self.numbers.items():
            values.frombytes(found[n].astype(np.int64).tobytes())
        bounds, pairs, times = found["links"]
        self.bounds.frombytes((bounds[1:] + len(self.pairs)).astype(np.int64).tobytes())
        self.pairs.frombytes(pairs.tobytes())
        self.times.frombytes(times.tobytes())

    def align(self, texts: list[str]) -> dict[str, object]:
        """Tokens of both sides of space+text, their common ends, the groups between and the links in them."""
        count, wanted = len(texts), [(" " + t).encode() for t in texts]
        found = [side.ids(texts) for side in self.sides]
        sound = np.ones(count, dtype=bool)
        for side, lists in zip(self.sides, found):
            for i, (ids, w) in enumerate(zip(lists, wanted)):
                if b"".join(map(side.bytes.__getitem__, ids)) != w:
                    sound[i] = False
        found = [[ids if s else [] for ids, s in zip(lists, sound)] for lists in found]
        n_tokens = [np.fromiter(map(len, lists), dtype=np.int64, count=count) for lists in found]
        ids = [np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(n.sum())) for lists, n in zip(found, n_tokens)]
        text = [np.repeat(np.arange(count), n) for n in n_tokens]
        ends = [np.cumsum(lengths[i]) for lengths, i in zip(self.lengths, ids)]  # texts in a row: both sides end each text alike
        meets = ([], [])
        a_drives = n_tokens[0] <= n_tokens[1]
        for driver, driven in ((0, a_drives), (1, ~a_drives)):
            mine, other = (np.flatnonzero(driven[text[s]]) for s in (driver, 1 - driver))
            i, j = common_ends(ends[driver][mine], ends[1 - driver][other])
            meets[driver].append(mine[i])
            meets[1 - driver].append(other[j])
        last = [np.sort(np.concatenate(m)) for m in meets]
        sizes = tuple(np.diff(m, prepend=-1) for m in last)
        owner = text[0][last[0]]
        n_groups = np.bincount(owner, minlength=count)
        group_bounds = np.append(0, np.cumsum(n_groups))
        links = np.append(0, np.cumsum(sizes[0] * sizes[1]))

        # each group's A tokens, then its B tokens
        offsets = (np.cumsum(sizes[1]) - sizes[1], np.cumsum(sizes[0]))
        codes = np.empty(len(ids[0]) + len(ids[1]), dtype=np.int64)
        for side in (0, 1):
            code = ids[side] * 2 + 2 * side * len(self.lengths[0])
            code[last[side]] += 1
            codes[np.arange(len(code)) + np.repeat(offsets[side], sizes[side])] = code
        bounds = np.append(0, np.cumsum(n_tokens[0] + n_tokens[1])).tolist()
        spelled = self.spelled[codes].tolist()
        keys, times = distinct_links(tuple(ids), sizes, owner, self.width, self.span)
        link_bounds = np.searchsorted(keys, np.arange(count + 1) * self.span)
        return {"n_a": n_tokens[0], "n_b": n_tokens[1], "n_groups": n_groups, "sound": sound,
                "n_links": np.diff(links[group_bounds]), "groups": ["".join(spelled[s:e])[:-1] for s, e in zip(bounds, bounds[1:])],
                "links": (link_bounds, keys % self.span, times)}

    def block(self, texts: list[str]) -> dict[str, object]:
        """Counts per text, its groups spelled out, and its distinct linked pairs with their occurrences."""
        if len(self.index) > TABLE_WORDS or len(self.pairs) > TABLE_PAIRS:
            self.clear()
        words = [self.words(t) for t in texts]
        self.learn(chain.from_iterable(words))
        sound = self.numbers["sound"]
        for i, (text, own) in enumerate(zip(texts, words)):
            if not all(map(sound.__getitem__, map(self.index.__getitem__, own))):
                self.learn([text])  # the cut may be what keeps a word's tokens from joining to its bytes
                words[i] = [text] if sound[self.index[text]] else []
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), dtype=np.int64)
        ends = np.append(0, np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))))
        out: dict[str, object] = {
            n: np.diff(np.append(0, np.cumsum(np.frombuffer(self.numbers[n], dtype=np.int64)[at]))[ends]) if len(at) else np.zeros(len(texts), np.int64)
            for n in ("n_a", "n_b", "n_groups", "n_links")}
        places = at.tolist()
        out["groups"] = [";".join(map(self.groups.__getitem__, places[s:e])) for s, e in zip(ends.tolist(), ends.tolist()[1:])]
        if len(at):
            bounds = np.frombuffer(self.bounds, dtype=np.int64)
            first, n = bounds[at], bounds[at + 1] - bounds[at]
            place = _places(first, n)
            owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(ends)), n)
            keys, times = _summed(np.frombuffer(self.pairs, dtype=np.int64)[place] + owner * self.span, np.frombuffer(self.times, dtype=np.int64)[place])
        else:
            keys = times = np.empty(0, np.int64)
        pair_bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * self.span)
        return out | {"pairs": (pair_bounds, keys % self.span), "times": (pair_bounds, times)}


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker."""
    return Aligner(path_a, path_b)


_LONG = T.LongType()
_FIELDS = [T.StructField("row", _LONG), *[T.StructField(n, _LONG) for n in ("n_a", "n_b", "n_groups", "n_links")],
           T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(_LONG)), T.StructField("times", T.ArrayType(_LONG))]


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def aligned(docs: DataFrame, key: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """Per document: its key, a row number, token, group and link counts, the groups, linked id pairs.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in ids; a pair is a * (size of B) + b, listed once in
    ``pairs`` with its occurrences in ``times``. Write the result before reading it twice: row
    numbers are those of one run.
    """
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([source.schema[0], *_FIELDS])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_by_side, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            start, chars, texts = 0, 0, []
            for i, value in enumerate(batch.column(1)):
                texts.append(value.as_py())
                chars += len(texts[-1])
                if chars < BLOCK_CHARS and len(texts) < BLOCK_ROWS and i + 1 < batch.num_rows:
                    continue
                out = side_by_side.block(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(texts)), pa.array(np.arange(row, row + len(texts))),
                    *[pa.array(out[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")],
                    pa.array(out["groups"], pa.string()), _lists(*out["pairs"]), _lists(*out["times"])], schema=arrow)
                start, row = i + 1, row + len(texts)
                chars, texts = 0, []

    return source.mapInArrow(run, schema)


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best): documents that hold the pair linked; whether no pair of its A id is in more.

    Bounded by the vocabularies: one row per pair of ids at most.
    """
    counts = settle(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pair-counts")
    a = F.floor(F.col("pair") / width)
    highest = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def sent_pairs(counts: DataFrame, most: int = SENT_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs in most documents, ascending: those from a power of two of documents on, at most ``most``."""
    bits = F.length(F.bin("docs"))
    levels = sorted(counts.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect(), reverse=True)
    total, least = 0, 64
    for level in levels:
        total += level.n
        if total > most:
            break
        least = level.bits
    found = counts.where(bits >= least).toArrow()
    pair, docs, best = (found.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "docs", "best"))
    order = np.argsort(pair)
    return pair[order].astype(np.int64), docs[order].astype(np.int64), best[order].astype(bool)


def link_scores(links: DataFrame, counts: DataFrame, most: int = SENT_PAIRS) -> DataFrame:
    """``links`` with n_best and count_sum in place of its pairs. Both inputs are written tables."""
    pair, docs, best = sent_pairs(counts, most)
    kept = [c for c in links.columns if c not in ("pairs", "times")]
    fields = [links.schema[c] for c in kept]
    pieces = T.ArrayType(T.StructType([T.StructField("pair", _LONG), T.StructField("times", _LONG)]))
    schema = T.StructType([*fields, T.StructField("n_best", _LONG), T.StructField("count_sum", _LONG), T.StructField("rest", pieces)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = np.append(0, np.cumsum(batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False)))
            mine, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            place = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
            hit = pair[place] == mine if len(pair) else np.zeros(len(mine), dtype=bool)
            place = place[hit]
            known = np.append(0, np.cumsum(hit))[bounds]  # how many of the known stand before each document

            def per_document(values: np.ndarray) -> pa.Array:
                return pa.array(np.diff(np.append(0, np.cumsum(values))[known]), pa.int64())

            rest = pa.StructArray.from_arrays([pa.array(mine[~hit], pa.int64()), pa.array(times[~hit], pa.int64())], ["pair", "times"])
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in kept], per_document(times[hit] * best[place]), per_document(times[hit] * docs[place]),
                pa.ListArray.from_arrays(pa.array(bounds - known, pa.int32()), rest)], schema=arrow)

    part = settle(links.select(*kept, "pairs", "times").mapInArrow(run, schema), "links-sent")
    rest = part.select("row", F.inline("rest")).join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
    return part.drop("rest").join(rest, "row", "left").select(
        *kept, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def alignment(docs: DataFrame, key: str, text: str, path_a: str, path_b: str, keep: dict | None = None,
              most: int = SENT_PAIRS) -> DataFrame:
    """``aligned`` with n_best and count_sum; ``keep`` names the columns to keep of it, as expressions of its columns."""
    keep = keep or {"groups": F.col("groups")}
    links = settle(aligned(docs, key, text, path_a, path_b).select(
        "key", "row", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", *[c.alias(n) for n, c in keep.items()]), "links")
    counts = settle(pair_counts(links, aligner(path_a, path_b).width), "pair-best")
    return link_scores(links, counts, most).drop("row").withColumnRenamed("key", key)
