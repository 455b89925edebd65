"""What each of several filters removes, in every order they could be applied in.

The filters play a removal game: a coalition of them removes the rows that fail at
least one of its members. All that is asked follows from the values of the 2^m
coalitions, which are counted once per part:

* a filter's step after the coalition of its predecessors removes the difference of
  two coalition values,
* the Hart-Mas-Colell potential of a coalition is its value plus the potentials of
  its sub-games with one filter less, divided by its size; a filter's Shapley value is
  the potential of all filters less that of all but this one. Potentials are kept
  times m!, where they are whole numbers, so a Shapley value times m! is exactly the
  filter's removals summed over all m! orders.

Only counts leave the rows: (digest, class) counts, then at most 2^m failure masks per
part. A text copied a billion times is one small row per task before it is shuffled.

Defined cases: a null text is empty; a null part is the empty string; a row without
identifier is never a copy and has no labels; rows that share the smallest identifier of
their text all stay; several label rows of one identifier count once, a mark holds if
any has it; an empty table gives no rows. Columns of the input beyond the named ones
are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_FILTERS = 8  # 8! orders of 8 steps per part

SPACE = r"[\x20\x09-\x0D]+"


def text_measures(text: Column) -> dict[str, Column]:
    """Words and what else the usual text filters ask for; ``words`` is computed once."""
    return {
        "words": F.array_remove(F.split(text, SPACE), ""),
        "upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
        "chars": F.char_length(text),
        "text": text,
    }


def failures(docs: DataFrame, key: str, text: str, part: str, filters: dict[str, str]) -> DataFrame:
    """(key, part, digest, mask): bit i of the mask is set where the i-th condition holds.

    Conditions are SQL and see the columns of ``text_measures``. Equal texts have equal digests.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"),
                       *[c.alias(n) for n, c in text_measures(content).items()])
    mask = sum((F.when(F.expr(c), 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    return read.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def masks(failed: DataFrame, marks: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, mark columns, n): how many rows fail exactly these filters.

    ``copy_bit`` is set on rows whose text is also that of a smaller key. ``marks`` has
    (key, mark columns as booleans).
    """
    names = [c for c in marks.columns if c != "key"]
    marks = marks.groupBy("key").agg(*[F.max(c).alias(c) for c in names])
    rows = failed.groupBy("key", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(marks, "key", "left").select(
        "key", "part", "digest", "mask", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in names])
    classes = rows.groupBy("digest", "part", "mask", *names).agg(
        F.sum("n").alias("n"), F.min("key").alias("first"), F.min_by("n", "key").alias("n_first"),
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("n_keyless"))
    # a digest has one row per part, mask and marks here, however many rows the text has
    smallest = F.min("first").over(Window.partitionBy("digest"))
    originals = F.col("n_keyless") + F.when(F.col("first") == smallest, F.col("n_first")).otherwise(0)
    told = classes.select("part", "mask", *names, "n", originals.alias("originals"))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")),
                   F.struct(F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    return (told.select("part", *names, F.explode(both).alias("x")).where("x.n > 0")
            .groupBy("part", F.col("x.mask").alias("mask"), *names).agg(F.sum("x.n").alias("n")))


def coalitions(masks: DataFrame, m: int) -> DataFrame:
    """One row per part: rows in all, and arrays over the 2^m coalitions.

    ``removed`` and one ``lost_<mark>`` per mark hold how many rows a coalition removes;
    ``potential`` is the Hart-Mas-Colell potential of the removal game, times m!.
    """
    if not 1 <= m <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters, not {m}")
    names = [c for c in masks.columns if c not in ("part", "mask", "n")]
    hit = F.when(F.col("mask").bitwiseAND(F.col("coalition")) != 0, F.col("n")).otherwise(0)
    values = (masks.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << m) - 1))))
              .groupBy("part", "coalition")
              .agg(F.sum("n").alias("rows"), F.sum(hit).alias("removed"),
                   *[F.sum(F.when(F.col(c), hit).otherwise(0)).alias(f"lost_{c}") for c in names]))
    columns = ["removed", *[f"lost_{c}" for c in names]]
    ordered = values.groupBy("part").agg(  # 2^m rows per part
        F.first("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("coalition", *columns))).alias("v"))
    return ordered.select("part", "rows", *[F.col(f"v.{c}").alias(c) for c in columns]).withColumn("potential", _potential(m))


def _potential(m: int) -> Column:
    """potential(S) = (value(S) + sum of potential(S without i) over i in S) / |S|, from small to large S.

    Counting up in binary meets every sub-coalition before the coalition itself.
    """
    return F.expr(f"""
        aggregate(sequence(1, {(1 << m) - 1}), array(0L), (p, s) -> array_append(p, (
            {math.factorial(m)} * removed[s]
            + aggregate(sequence(0, {m - 1}), 0L, (t, i) -> t + if(s & shiftleft(1, i) != 0, p[s ^ shiftleft(1, i)], 0L))
        ) div bit_count(s)))""")


def steps(values: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from the coalition values alone."""
    m = len(letters)
    every = (1 << m) - 1
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(letters)])
    stepped = (values.withColumn("filter_order", F.explode(orders))
               .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(m))))
               .withColumn("before", F.expr(f"""
                   aggregate(sequence(0, {m - 1}), 0, (s, i) ->
                       s + if(locate(substr('{letters}', i + 1, 1), filter_order) < step, shiftleft(1, i), 0))"""))
               .withColumn("own", F.expr(f"shiftleft(1, locate(substr(filter_order, step, 1), '{letters}') - 1)"))
               .withColumn("after", F.col("before") + F.col("own")))

    def step(column: str) -> Column:
        return F.expr(f"{column}[after] - {column}[before]")

    lost = [c for c in values.columns if c.startswith("lost_")]
    return stepped.select(
        "part", "filter_order", "step", F.expr("rows - removed[after]").alias("kept"), step("removed").alias("removed"),
        F.expr("removed[own] - (removed[after] - removed[before])").alias("redundant"),
        F.expr(f"removed[{every}] - removed[{every} - own]").alias("unique_fails"),
        *[step(c).alias(c) for c in lost],
        F.expr(f"potential[{every}] - potential[{every} - own]").alias("shapley"))
