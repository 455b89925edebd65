"""Line dedup: an exact set-similarity join over all lines, in DataFrame operations only.

A line is the set of its words. It is removed if an earlier line of the corpus (by
document, then by place) has Jaccard similarity of at least the threshold. Words are
ordered by rarity, with the counts of the whole corpus in a table of bounded size: any
fixed order gives the right result, a good one gives few candidates.

1. Equal lines are grouped by digest; all but the first are removed and only the first
   goes on: the words of copies are never made.
2. The leaders: of the rarer half of the words, the smallest and the largest of each of two
   hashes are taken, which near copies mostly share. A line is compared with the earliest of those that share
   two of the four with it, and the closest of these at most six is kept. In a family of many
   near copies this settles nearly all; any choice of candidates is right here.
3. The lines that are left probe all lines that share a word of the prefix, that is, of
   the rarest n - ceil(t n) + 1 words; two similar sets must share one there. The
   length filter, the positional filter (what can still overlap from the shared word
   on) and a parity map of the sets (differing bits never exceed differing words) of
   128 bits discard candidates inside the join, so what is left is nearly all true. Lines
   go through it by a number of their own; only pairs that are left get their places.
4. Candidates of 2 and 3 are verified on the words themselves, the earliest of a line
   first and the others only where that one fails.

Lines of a large family are compared with a few others only, not with each other, and
no list of lines is gathered in a row. Texts are read where they lie; those of
candidate lines alone are shuffled.

Defined cases: null texts have no lines that count; lines without words are kept; rows
with one identifier, or with none, are documents of their own if their texts differ (by
64 bits of a hash, which also orders them); rows equal in both share their verdicts;
null identifiers rank last; other columns of the documents pass through, of any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from keepwell.llm.base import maybe_member, membership, surely_not
from keepwell.session import scratch, settle

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 18
#: The halves of the parity map: of the words whose hash is negative, and of the others.
MAPS = ["map0", "map1"]
EXTREMES = ["least1", "most1", "least2", "most2"]
#: Characters that separate words, without the end of line.
BLANKS = " \t\x0b\x0c\r"
_LAST = (1 << 63) - 1
#: What a line is known by, and the same of an earlier line.
PLACE = ["doc", "copy", "line"]
PLACE0 = [f"{c}0" for c in PLACE]
Settle = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity as a fraction, so that all bounds are whole numbers."""

    num: int = 4
    den: int = 5

    def prefix(self, n: str) -> Column:
        return F.expr(f"cast({n} - ({self.num} * {n} + {self.den - 1}) div {self.den} + 1 as int)")

    def overlap(self, a: Column, b: Column) -> Column:
        """The fewest common words of similar sets of these sizes."""
        return F.ceil(self.num * (a + b) / (self.num + self.den)).cast("int")


def repeated_ids(docs: DataFrame, key: str, settle: Settle = settle) -> DataFrame | None:
    """A bit table of the identifiers that several rows have, None if there are none."""
    ids = docs.select(F.col(key).cast("long").alias("__doc")).where("__doc is not null")
    several = settle(membership(ids.groupBy("__doc").count().where("count > 1"), "__doc"), "repeated-ids")
    return None if several.isEmpty() else several


def identified(docs: DataFrame, key: str, text: str, repeated: DataFrame | None) -> DataFrame:
    """``docs`` with __doc, the identifier (nulls last), and __copy, which tells rows apart that share it.

    __copy is a hash of the text where the identifier is null or in ``repeated``, 0 elsewhere.
    """
    doc, code = F.col(key).cast("long"), F.xxhash64(F.col(text))
    named = docs.withColumns({"__doc": F.coalesce(doc, F.lit(_LAST)), "__copy": F.when(doc.isNull(), code).otherwise(F.lit(0).cast("long"))})
    if repeated is None:
        return named
    return surely_not(named, "__doc", repeated).unionByName(maybe_member(named, "__doc", repeated).withColumn("__copy", code))


def lines_of(own: DataFrame, text: str) -> DataFrame:
    """doc, copy, line, content of ``identified`` rows: every line with its place."""
    return own.select(F.col("__doc").alias("doc"), F.col("__copy").alias("copy"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "content"))


def earlier(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether place a comes before place b."""
    return F.struct(*[a(c).alias(c) for c in PLACE]) < F.struct(*[b(c).alias(c) for c in PLACE])


def split_words(content: Column) -> Column:
    """Words and empty strings; a text without other white space is split at plain blanks, which is faster."""
    return F.when(content.rlike(r"[\x09-\x0D]"), F.split(content, SPACE)).otherwise(F.split(content, " "))


def words_of(content: Column) -> Column:
    return F.array_remove(F.array_distinct(split_words(content)), "")


def rarity(docs: DataFrame, text: str) -> Column:
    """How common the words of each hash bucket are, 0 to 99: a rounded logarithm of their count over all texts.

    The table has one entry per bucket, whatever the vocabulary, and enters the plan as a constant.
    """
    words = docs.select(F.explode(split_words(F.replace(F.col(text), F.lit("\n"), F.lit(" ")))).alias("word"))
    counts = words.groupBy(_bucket(F.xxhash64("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.select("bucket", F.least(F.round(3 * F.log2("n")), F.lit(99)).cast("int").alias("level")).toArrow()
    levels = ["0"] * BUCKETS
    for bucket, level in zip(*(found.column(c).to_pylist() for c in ("bucket", "level"))):  # at most BUCKETS rows
        levels[bucket] = str(level)
    return F.split(F.lit(",".join(levels)), ",").cast("array<int>")


def _bucket(code: Column) -> Column:
    return code.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def digests(own: DataFrame, text: str) -> DataFrame:
    """doc, copy, line, content, d1 and d2 (a 128-bit digest) of every line with words."""
    return lines_of(own, text).where(F.btrim("content", F.lit(BLANKS)) != "").select(
        "*", F.xxhash64("content").alias("d1"), F.xxhash64(F.lit(1), "content").alias("d2"))


def same_place() -> Column:
    return F.struct(*PLACE) == F.struct(*[F.col(p).alias(c) for p, c in zip(PLACE0, PLACE)])


def first_lines(seen: DataFrame, settle: Settle) -> tuple[DataFrame, DataFrame]:
    """Of ``digests``: d1, d2 and the place of the first of equal lines, where there are several; the places of the others."""
    digest = ["d1", "d2"]
    seen = settle(seen.select(*PLACE, *digest), "digests")
    groups = settle(seen.groupBy(*digest).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "groups")
    several = settle(maybe_member(seen, "d1", membership(groups, "d1")).join(groups, digest), "several")
    # a row that repeats another one, identifier and text, repeats its places; they count once
    place = (several.where("doc = first").groupBy(*digest, "doc", "copy").agg(F.min("line").alias("line"))
             .groupBy(*digest, "doc").agg(F.min(F.struct("copy", "line")).alias("at")))
    firsts = settle(place.select(*digest, F.col("doc").alias("doc0"), F.col("at.copy").alias("copy0"), F.col("at.line").alias("line0")), "first-lines")
    return firsts, several.join(firsts, digest).where(~same_place()).select(*PLACE)


def single_lines(own: DataFrame, text: str, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc, copy, line, content of the lines with words, without copies: those that surely have none, and the others, which alone are shuffled."""
    rows, bits = digests(own, text), membership(firsts, "d1")
    several = maybe_member(rows, "d1", bits).join(firsts, ["d1", "d2"], "left").where(F.col("doc0").isNull() | same_place())
    return surely_not(rows, "d1", bits).select(*PLACE, "content"), several.select(*PLACE, "content")


def line_table(lines: DataFrame, levels: Column, t: Threshold) -> DataFrame:
    """doc, copy, line, n (words), parity maps, prefix (hashes of the rarest words, in order) and extremes (of two hashes of the rarer words) of lines with words."""
    rows = lines.select(*PLACE, F.array_distinct(F.transform(F.array_remove(split_words(F.col("content")), ""), lambda w: F.xxhash64(w))).alias("codes"))
    rows = rows.select(*PLACE, "codes", F.size("codes").alias("n"),
                       F.sort_array(F.transform("codes", lambda c: order_key(c, levels))).alias("keys"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    parity_of = lambda half: F.aggregate("codes", F.lit(0).cast("long"), lambda acc, k: F.when(half(k), acc.bitwiseXOR(bit(k))).otherwise(acc))
    maps = [parity_of(half).alias(m) for m, half in zip(MAPS, (lambda k: k < 0, lambda k: k >= 0))]
    half = F.slice("keys", F.lit(1), F.expr("n div 2 + 1"))  # common words say little about a line
    hashes = [F.transform(half, lambda c: F.xxhash64(F.lit(i), c)) for i in (1, 2)]
    extremes = [f(h).alias(e) for e, (h, f) in zip(EXTREMES, [(h, f) for h in hashes for f in (F.array_min, F.array_max)])]
    short = F.transform(F.slice("keys", F.lit(1), t.prefix("n")), lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    return rows.select(*PLACE, "n", *maps, short.alias("prefix"), *extremes)


def order_key(code: Column, levels: Column) -> Column:
    """Rarity first, then a hash: a total order up to hash collisions, which only add candidates."""
    level = F.shiftleft(F.coalesce(F.get(levels, _bucket(code)), F.lit(0)).cast("long"), 48)  # never null: such arrays sort faster
    return level.bitwiseOR(code.bitwiseAND(F.lit((1 << 48) - 1)))


def differing(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """A lower bound of the number of words that one of two lines has and the other has not."""
    return sum((F.bit_count(a(m).bitwiseXOR(b(m))) for m in MAPS[1:]), F.bit_count(a(MAPS[0]).bitwiseXOR(b(MAPS[0]))))


def may_match(t: Threshold, n1: Column, p1: Column, n2: Column, p2: Column, differ: Column) -> Column:
    """Length, positional and parity filter at a shared word (places from 0)."""
    alpha = t.overlap(n1, n2)
    return ((F.least(n1, n2) * t.den >= F.greatest(n1, n2) * t.num) & (F.least(n1 - p1, n2 - p2) >= alpha)
            & (differ <= n1 + n2 - 2 * alpha))


def verified(own: DataFrame, text: str, pairs: DataFrame, t: Threshold, settle: Settle = settle) -> DataFrame:
    """The lines (doc, copy, line, id) of the pairs with an earlier line (doc0, copy0, line0) whose word sets are similar."""
    wanted = settle(pairs.select(*PLACE).unionByName(pairs.select(*[F.col(f"{c}0").alias(c) for c in PLACE])).distinct(), "wanted-lines")
    of_row = lambda doc, copy: F.xxhash64(doc, copy).alias("row")
    named = own.select("__doc", "__copy", F.col(text).alias("t"), of_row("__doc", "__copy"))
    lines = lines_of(maybe_member(named, "row", membership(wanted.select(of_row("doc", "copy")), "row")), "t")
    of_line = F.xxhash64(*PLACE).alias("place")
    lines = maybe_member(lines.select("*", of_line), "place", membership(wanted.select(of_line), "place")).drop("place")
    words = lines.join(wanted, PLACE).select(*PLACE, words_of(F.col("content")).alias("words"))
    words0 = words.select(*[F.col(c).alias(f"{c}0") for c in PLACE], F.col("words").alias("words0"))
    both = pairs.join(words, PLACE).join(words0, PLACE0)
    common = F.size(F.array_intersect("words", "words0"))
    return both.where(common * (t.num + t.den) >= t.num * (F.size("words") + F.size("words0"))).select(*PLACE, "id").distinct()


def _one_each(pairs: DataFrame) -> DataFrame:
    """The earliest candidate of every line."""
    first = F.min(F.struct(*PLACE0)).alias("first")
    return pairs.groupBy(*PLACE, "id").agg(first).select(*PLACE, "id", "first.*")


def placed(pairs: DataFrame, single: DataFrame, *more: str) -> DataFrame:
    """Pairs of numbers (id, id0) with the places of both and more columns of both, where id0 is the earlier line."""
    wanted = membership(pairs.select("id").unionByName(pairs.select(F.col("id0").alias("id"))), "id")
    known = maybe_member(single.select("id", *PLACE, *more), "id", wanted)
    known0 = known.select(*[F.col(c).alias(f"{c}0") for c in known.columns])
    return pairs.join(known, "id").join(known0, "id0").where(earlier(lambda c: F.col(f"{c}0"), F.col))


def removed_lines(docs: DataFrame, key: str, text: str, t: Threshold = Threshold()) -> DataFrame:
    """(doc, copy, line) of every line that has an earlier similar one; null keys appear as the largest long."""
    return removed_of(identified(docs, key, text, repeated_ids(docs, key)), text, t)


def removed_of(own: DataFrame, text: str, t: Threshold = Threshold()) -> DataFrame:
    """``removed_lines`` of ``identified`` rows."""
    with scratch(own.sparkSession, "line-join") as here:
        found = _removed(own, text, t, here)
        return settle(found, "removed-lines")


def _removed(own: DataFrame, text: str, t: Threshold, settle: Settle) -> DataFrame:
    firsts, copies = first_lines(digests(own, text), settle)
    levels = rarity(own, text)
    # one table each, since a plan of both would hold the levels twice; the numbers stay, once written
    parts = [settle(line_table(lines, levels, t).withColumn("id", F.monotonically_increasing_id() + F.lit(i << 62)), f"lines-{i}")
             for i, lines in enumerate(single_lines(own, text, firsts))]
    single = parts[0].unionByName(parts[1])

    two = [F.xxhash64(F.lit(i), a, b) for i, (a, b) in enumerate(combinations(EXTREMES, 2))]
    keyed = single.select("id", "doc", F.explode(F.array(*two)).alias("key"))
    leaders = settle(keyed.groupBy("key").agg(F.min_by("id", "doc").alias("id0"), F.count(F.lit(1)).alias("lines")).where("lines > 1").select("key", "id0"), "leaders")
    led = settle(maybe_member(keyed, "key", membership(leaders, "key")).join(leaders, "key").where("id != id0").select("id", "id0").distinct(), "led-numbers")
    none, differ = F.lit(0), differing(F.col, lambda c: F.col(f"{c}0"))
    best = F.min(F.struct(differ.alias("far"), *PLACE0)).alias("best")
    led = placed(led, single, "n", *MAPS).where(may_match(t, F.col("n"), none, F.col("n0"), none, differ))
    led = settle(led.groupBy(*PLACE, "id").agg(best).select(*PLACE, "id", *[f"best.{c}" for c in PLACE0]), "led-pairs")
    by_leader = settle(verified(own, text, led, t, settle), "led-lines")

    # settled lines have the complement of their number, so that both sides of the join are one table, shuffled once
    named = single.select("id", "doc", "n", *MAPS, "prefix")
    bits, complement = membership(by_leader, "id"), lambda c: F.bitwise_not(c)
    maybe = maybe_member(named, "id", bits).join(by_leader.select("id", F.lit(True).alias("settled")), "id", "left")
    maybe = maybe.withColumn("id", F.when(F.col("settled"), complement(F.col("id"))).otherwise(F.col("id"))).drop("settled")
    rows = surely_not(named, "id", bits).unionByName(maybe).select(F.posexplode("prefix").alias("pos", "word"), "id", "doc", "n", *MAPS)
    rows = rows.select("word", "id", "doc", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos")).alias("sized"), *MAPS)
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    n_of, pos_of = (lambda s: F.shiftright(s("sized"), 32)), (lambda s: s("sized").bitwiseAND(F.lit((1 << 32) - 1)))
    # settled lines stay on both sides until they meet: a filter on one side would cost a second shuffle
    asks = F.when(x("id") >= 0, y("doc") <= x("doc")).otherwise(F.lit(False))
    met = rows.alias("x").join(rows.alias("y"), x("word") == y("word")).where(
        asks & (x("id") != y("id")) & may_match(t, n_of(x), pos_of(x), n_of(y), pos_of(y), differing(x, y)))
    met = met.select(x("id").alias("id"), F.when(y("id") < 0, complement(y("id"))).otherwise(y("id")).alias("id0")).distinct()
    # written at once: several branches read it, and what is behind it is dear
    met = settle(met, "probed-numbers")
    met = settle(placed(met, single).drop("id0"), "probed-pairs")
    by_probe = settle(verified(own, text, settle(_one_each(met), "first-pairs"), t, settle), "probed-lines")
    left = met.join(by_probe, "id", "left_anti")
    left = settle(left.join(_one_each(left).withColumn("tried", F.lit(True)), ["id", *PLACE0], "left_anti").select(met.columns), "other-pairs")
    found = copies.unionByName(by_leader.select(*PLACE)).unionByName(by_probe.select(*PLACE))
    return found if left.isEmpty() else found.unionByName(verified(own, text, left, t, settle).select(*PLACE))


def removed_by_document(removed: DataFrame) -> DataFrame:
    """One row per document that loses lines: doc, copy and ``gone``, their numbers in order."""
    return removed.groupBy("doc", "copy").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, key: str, text: str, t: Threshold = Threshold()) -> DataFrame:
    """``docs`` with later matches taken out of ``text``; all rows and columns stay. Unaffected texts are not shuffled."""
    own = identified(docs, key, text, repeated_ids(docs, key))
    gone = settle(removed_by_document(removed_of(own, text, t)).withColumnsRenamed({"doc": "__doc", "copy": "__copy", "gone": "__gone"}), "removed-by-document")
    place = F.xxhash64("__doc", "__copy")
    own = own.withColumn("__row", place)
    bits = membership(gone.select(place.alias("__row")), "__row")
    lines = F.split(F.col(text), "\n")
    stay = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    changed = (maybe_member(own, "__row", bits).join(gone, ["__doc", "__copy"], "left")
               .withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(stay)))
    return surely_not(own, "__row", bits).select(*docs.columns).unionByName(changed.select(*docs.columns))
