"""A filter of bounded size in front of a join: rows that cannot match stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FILTER_BITS = 1 << 23


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def membership(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """A bit table of the values in ``column``: at most bits/64 rows, whatever the number of keys.

    The size bound is what allows ``maybe_member`` to broadcast it. Beyond about
    ``bits`` keys it lets everything through, so it saves work and decides nothing.
    """
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    return (keys.select(at.alias("at"))
            .groupBy(F.shiftright("at", 6).alias("filter_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("filter_mask")))


def _marked(df: DataFrame, column: str, filter_table: DataFrame, bits: int) -> tuple[DataFrame, Column]:
    """``df`` with helper columns of unused names, and whether the filter lets a row through."""
    at, word, mask = (unused(df, f"filter_{n}") for n in ("at", "word", "mask"))
    named = filter_table.select(F.col("filter_word").alias(word), F.col("filter_mask").alias(mask))
    bit = F.expr(f"shiftright({mask}, cast({at} & 63 as int)) & 1 = 1")
    marked = (df.withColumn(at, F.pmod(F.xxhash64(column), F.lit(bits))).withColumn(word, F.shiftright(at, 6))
              .join(F.broadcast(named), word, "left"))
    return marked, F.coalesce(bit, F.lit(False))


def maybe_member(df: DataFrame, column: str, filter_table: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` whose key may be among those of ``membership``; no member is lost."""
    marked, hit = _marked(df, column, filter_table, bits)
    return marked.where(hit).select(*df.columns)


def surely_not(df: DataFrame, column: str, filter_table: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The other rows of ``df``: none of them is a member. They need no shuffle to be told apart."""
    marked, hit = _marked(df, column, filter_table, bits)
    return marked.where(~hit).select(*df.columns)


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is not in ``gone`` (one column of that name); only rows that may be in it are shuffled."""
    bits = membership(gone, column)
    return surely_not(df, column, bits).unionByName(maybe_member(df, column, bits).join(gone, column, "left_anti"))
