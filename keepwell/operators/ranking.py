"""Ranks, running totals and quantiles over whole tables without one big task.

Spark evaluates a window without (or with a hot) partition key in a single task.
The operators here cut the order into slices first, total the slices (a table of
bounded size), and run the window only within a slice.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

SLICE_ROWS = 1_000_000
DRAWS = 50
MAX_CUTS = 100_000
QUANTILE_MARGIN = 0.001
SKETCH_ACCURACY = 10_000
BEFORE = (Window.unboundedPreceding, -1)
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def draw(seed: str, *key: Column) -> Column:
    """A repeatable random word per key: 32 hex digits, evenly spread."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in key]))


def hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def share(word: Column) -> Column:
    """A drawn word as a number in [0, 1)."""
    return hex_number(F.substring(word, 1, 8)).cast("double") / F.lit(4294967296.0)


def hash_segments(df: DataFrame, strata: list[str], key: str, seed: str,
                  ranks: Callable[[Column], list[Column]], output: str, digits: int = 4) -> DataFrame:
    """Deals rows of each stratum into consecutive segments of a random order; rows of null strata are one, too.

    ``ranks`` gives, from the stratum's row count, the last rank of each segment
    but the final one; ``output`` is the segment number from 0. The cut between two
    segments is found exactly: rows are counted per leading hex digits of the drawn
    word, and only the few slices that hold a cut are ordered. The table itself is
    then only compared with the cuts, so its rows are never shuffled, and reading
    the result again repeats nothing but that comparison.
    """
    word = draw(seed, F.col(key))
    head = F.substring("_word", 1, digits)
    drawn = df.select(*strata, F.col(key).alias("_key"), word.alias("_word")).withColumn("_slice", head)
    sizes = drawn.groupBy(*strata, "_slice").agg(F.count("*").alias("_rows"))
    per_stratum = Window.partitionBy(*(strata or [F.lit(0)]))
    numbered = F.transform(F.array(*ranks(F.col("_all"))), lambda r, i: F.struct(
        i.alias("no"), F.least(r.cast("long"), F.col("_all")).alias("rank")))
    held = (
        sizes.select(*strata, "_slice", "_rows",
                     F.coalesce(F.sum("_rows").over(per_stratum.orderBy("_slice").rowsBetween(*BEFORE)),
                                F.lit(0)).alias("_before"),
                     F.sum("_rows").over(per_stratum).alias("_all"))
        .withColumn("_wanted", F.filter(numbered, lambda w: (w["rank"] > F.col("_before"))
                                        & (w["rank"] <= F.col("_before") + F.col("_rows"))))
        .where(F.size("_wanted") > 0).select(*strata, "_slice", "_before", "_wanted")
    )
    in_slice = Window.partitionBy(*strata, "_slice").orderBy("_word", "_key")
    cuts = (
        _same(drawn, F.broadcast(held), [*strata, "_slice"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(in_slice))
        .withColumn("_cut", F.explode(F.filter("_wanted", lambda w: w["rank"] == F.col("_rank"))))
        .groupBy(*strata).agg(F.array_sort(F.collect_list(
            F.struct(F.col("_cut.no").alias("no"), "_word", "_key"))).alias("_cuts"))
    )
    found = cuts.limit(MAX_CUTS + 1).collect()
    if len(found) > MAX_CUTS:
        raise ValueError("too many strata to keep their cuts on the driver")
    table = df.sparkSession.createDataFrame(found, cuts.schema)
    here = F.struct(word.alias("_word"), F.col(key).alias("_key"))
    passed = F.filter("_cuts", lambda c: F.struct(c["_word"].alias("_word"), c["_key"].alias("_key")) < here)
    # a cut of rank 0 is not in the table: every row lies behind it
    last = F.element_at(passed, -1)["no"] + 1
    first = F.element_at("_cuts", 1)["no"]
    if strata:
        placed = _same(df, F.broadcast(table), strata, "left")
    elif found[0]["_cuts"]:
        literal = F.array(*[F.struct(F.lit(c.no).alias("no"), F.lit(c["_word"]).alias("_word"),
                                     F.lit(c["_key"]).alias("_key")) for c in found[0]["_cuts"]])
        placed = df.withColumn("_cuts", literal)
    else:
        return df.withColumn(output, F.lit(len(ranks(F.lit(0)))))
    segment = F.when(F.size(passed) > 0, last).otherwise(first)
    return placed.withColumn(output, F.coalesce(segment, F.lit(len(ranks(F.lit(0)))))).drop("_cuts")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys; a null key equals a null key."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    return left.join(named, alike, how).drop(*[f"_r_{c}" for c in keys])


def _sliced(df: DataFrame, group: list[str], order: str, slices: int, rows: int) -> DataFrame:
    """Adds ``_slice``: about equally many rows each, non-decreasing in ``order``.

    The cuts are even places in a sorted draw of the values, so any orderable type
    will do; a poor draw makes uneven slices but never a wrong total. Places are
    searched in two steps, first among every b-th cut, then among the b cuts behind it.
    """
    b = math.ceil(math.sqrt(slices))
    drawn = df.where(F.col(order).isNotNull())
    if rows > DRAWS * slices:
        drawn = drawn.where(share(draw("cuts", F.to_json(F.struct(*group, order)))) < DRAWS * slices / rows)
    found = F.sort_array(F.collect_list(order))
    place = lambda i: F.element_at("_all", F.greatest(F.ceil(i * F.size("_all") / slices).cast("int"), F.lit(1)))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), place))
    table = drawn.groupBy(*group).agg(found.alias("_all")).where(F.size("_all") > 0).withColumn("_cuts", cuts).drop("_all")
    if group:
        named = table.select(*[F.col(c).alias(f"_r_{c}") for c in group], "_cuts")
        alike = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in group])
        table = df.join(named, alike, "left").drop(*[f"_r_{c}" for c in group])
    else:
        table = df.withColumn("_cuts", table.select("_cuts").scalar())
    value = F.col(order)
    coarse = F.filter("_cuts", lambda cut, i: ((i + 1) % b == 0) & (cut < value))
    block = F.slice("_cuts", F.col("_block") * b + 1, F.lit(b))
    within = F.size(F.filter(block, lambda cut: cut < value))
    return (
        table.withColumn("_block", F.coalesce(F.size(coarse), F.lit(0)))
        .withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_block") * b + within))
        .drop("_cuts", "_block")
    )


def running_totals(df: DataFrame, group: list[str], order: str, measures: list[str],
                   slices: int | None = None) -> DataFrame:
    """Adds ``cum_<m>`` (up to and with the row) and ``all_<m>`` per group.

    ``df`` must hold one row per group and ``order`` value, and should be settled:
    it is read for its size, the cuts, the slice totals and the rows themselves.
    A table of one slice's size is not cut.
    """
    rows = df.count()
    slices = slices or max(1, rows // SLICE_ROWS)
    if slices == 1:
        all_rows = Window.partitionBy(*(group or [F.lit(0)]))
        so_far = all_rows.orderBy(order).rowsBetween(*UP_TO_HERE)
        return df.withColumns({**{f"cum_{m}": F.sum(m).over(so_far) for m in measures},
                               **{f"all_{m}": F.sum(m).over(all_rows) for m in measures}})
    sliced = _sliced(df, group, order, slices, rows)
    totals = sliced.groupBy(*group, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("_slice").rowsBetween(*BEFORE)
    offsets = totals.select(
        *group, "_slice",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"all_{m}") for m in measures],
    )
    within = Window.partitionBy(*group, "_slice").orderBy(order).rowsBetween(*UP_TO_HERE)
    return (
        _same(sliced.withColumns({f"cum_{m}": F.sum(m).over(within) for m in measures}), offsets, [*group, "_slice"])
        .withColumns({f"cum_{m}": F.col(f"cum_{m}") + F.col(f"_before_{m}") for m in measures})
        .drop("_slice", *[f"_before_{m}" for m in measures])
    )


def passed_cuts(cuts: Column, value: Column, n: int, closed: bool = False) -> Column:
    """How many of at most ``n`` sorted cuts lie below the value (or at it, if closed).

    Written out per cut so that it compiles; a lambda over the array would be
    interpreted for every row.
    """
    one = F.lit(1)
    below = [F.get(cuts, F.lit(i)) for i in range(n)]
    return reduce(lambda a, b: a + b, [
        F.when(c <= value if closed else c < value, one).otherwise(0) for c in below])


def _local(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    if len(rows) > MAX_CUTS:
        raise ValueError("too many groups to keep their cuts on the driver")
    return F.broadcast(spark.createDataFrame(rows, schema))


def exact_quantiles(rows: DataFrame, group: str, probs: list[float], margin: float = QUANTILE_MARGIN,
                    sketches: DataFrame | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(group, prob, quantile), linear between neighbours, from (group, value) rows.

    A mergeable sketch brackets every wanted position, rows are counted between the
    brackets, and only brackets that hold a position go on: one of more than
    ``slice_rows`` rows is bracketed anew, until what is left is small or a single
    value. Only then are distinct values shuffled and ordered. A poor bracket costs
    another pass, never a wrong result. ``sketches`` (group, sketch) may hold stored KLL
    sketches, which save the first pass. Nulls and NaN must be gone.
    """
    near = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)})
    cuts = _sketched_cuts(rows, group, near) if sketches is None else _stored_cuts(sketches, group, near)
    placed, sizes = _between_cuts(rows, group, cuts)
    asked, positions = [], {}
    for name, slices in sizes.items():
        total = sum(slices.values())
        for p in probs:
            at = p * (total - 1)
            low, high = math.floor(at), math.ceil(at)
            asked.append((name, float(p), low, high, at - low))
            positions.setdefault(name, set()).update((low, high))
    found = _at_positions(placed, sizes, group, positions, slice_rows)
    kind = rows.schema[group]
    ends = _local(rows.sparkSession, asked, StructType([kind, *_fields("prob double, _low long, _high long, _part double")]))
    ends = ends.join(found, group).where("_position = _low OR _position = _high")
    low = F.max(F.when(F.col("_position") == F.col("_low"), F.col("value")))
    high = F.max(F.when(F.col("_position") == F.col("_high"), F.col("value")))
    return ends.groupBy(group, "prob").agg((low + (high - low) * F.max("_part")).alias("quantile"))


def _sketched_cuts(rows: DataFrame, group: str, near: list[float]) -> dict:
    found = rows.groupBy(group).agg(F.percentile_approx("value", near, SKETCH_ACCURACY).alias("cuts"))
    return {r[0]: sorted(set(r[1])) for r in found.limit(MAX_CUTS + 1).collect()}


def _stored_cuts(sketches: DataFrame, group: str, near: list[float]) -> dict:
    cuts = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in near])
    return {r[0]: sorted(set(r[1])) for r in sketches.where("sketch is not null").select(group, cuts).limit(MAX_CUTS + 1).collect()}


def _between_cuts(rows: DataFrame, group: str, cuts: dict) -> tuple[DataFrame, dict]:
    """Rows with the slice they lie in, and rows per group and slice."""
    most = max(map(len, cuts.values()), default=0)
    local = _local(rows.sparkSession, list(cuts.items()), StructType([rows.schema[group], *_fields("_cuts array<double>")]))
    placed = rows.join(local, group).select(group, "value", passed_cuts(F.col("_cuts"), F.col("value"), max(most, 1)).alias("_slice"))
    sizes: dict = {}
    for r in placed.groupBy(group, "_slice").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r[0], {})[r[1]] = r.n
    return placed, sizes


def _at_positions(placed: DataFrame, sizes: dict, group: str, positions: dict, slice_rows: int) -> DataFrame:
    """(group, _position, value) of the wanted places of each group's order, from 0."""
    spark, kind = placed.sparkSession, placed.schema[group]
    small, large = [], []
    for name, slices in sizes.items():
        before, whole = 0, sum(slices.values())
        for number in sorted(slices):
            inside = [i for i in sorted(positions[name]) if before <= i < before + slices[number]]
            if inside:
                again = slices[number] > slice_rows and slices[number] < whole  # a slice that is all of its group cannot be cut
                (large if again else small).append((name, number, before, inside))
            before += slices[number]
    hits = _local(spark, small, StructType([kind, *_fields("_slice int, _before long, _wanted array<long>")]))
    distinct = placed.join(hits.select(group, "_slice"), [group, "_slice"], "left_semi").groupBy(
        group, "_slice", "value").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(group, "_slice").orderBy("value").rowsBetween(*UP_TO_HERE))
    last = F.col("_before") + F.col("_cum")
    found = (
        distinct.withColumn("_cum", up_to).join(hits, [group, "_slice"])
        .withColumn("_hit", F.filter("_wanted", lambda i: (i >= last - F.col("n")) & (i < last)))
        .select(group, F.explode("_hit").alias("_position"), "value")
    )
    if not large:
        return found
    part = f"{group}_" if group.startswith("_part") else "_part"
    named = _local(spark, [(name, number, i, before) for i, (name, number, before, _) in enumerate(large)],
                   StructType([kind, *_fields(f"_slice int, {part} int, _before long")]))
    inner = placed.join(named, [group, "_slice"]).select(part, "value")
    cuts = {}
    for i, (name, number, before, inside) in enumerate(large):
        n = sizes[name][number]
        cuts[i] = sorted({min(max((p - before) / (n - 1) + d, 0.0), 1.0) for p in inside for d in (-QUANTILE_MARGIN, QUANTILE_MARGIN)})
    wanted = sorted({p for near in cuts.values() for p in near})
    again, counts = _between_cuts(inner, part, _sketched_cuts(inner, part, wanted))
    deeper = _at_positions(again, counts, part, {i: {p - x[2] for p in x[3]} for i, x in enumerate(large)}, slice_rows)
    back = deeper.join(named, part).select(group, (F.col("_position") + F.col("_before")).alias("_position"), "value")
    return found.unionByName(back)


def _fields(ddl: str) -> list[StructField]:
    return list(StructType.fromDDL(ddl).fields)
