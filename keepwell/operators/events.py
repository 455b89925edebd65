"""Features from dated events: logins, contacts, amounts, mentions, reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from keepwell.functions.text import LOWERED, any_word


def login_features(events: DataFrame, key: str, time: str, as_of: str) -> DataFrame:
    """Daily login averages of the last 7 and 30 days, their trend, days since the last."""
    ts = F.col(time)

    def in_last(days: int):
        return F.count_if((ts > F.expr(f"timestamp_ntz'{as_of}' - interval {days} days"))
                          & (ts <= F.expr(f"timestamp_ntz'{as_of}'")))

    seven, thirty = F.col("logins_7d_rolling_avg"), F.col("logins_30d_rolling_avg")
    return (
        events.where(ts <= F.expr(f"timestamp_ntz'{as_of}'")).groupBy(key).agg(
            (in_last(7) / 7.0).alias("logins_7d_rolling_avg"),
            (in_last(30) / 30.0).alias("logins_30d_rolling_avg"),
            F.datediff(F.lit(as_of).cast("date"), F.max(time)).alias("days_since_last_login"),
        )
        .withColumn("login_trend", seven - thirty)
    )


def daily_rolling(events: DataFrame, key: str, time: str, spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per user and active day: events in the trailing spans of days, as daily averages.

    Events merge to one row per user and day first, so the window of even the
    busiest user holds no more rows than the calendar has days.
    """
    days = events.groupBy(key, F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    per_user = Window.partitionBy(key).orderBy(number)
    return days.withColumns({
        f"avg_{s}d": F.sum("n").over(per_user.rangeBetween(-(s - 1), 0)) / float(s) for s in spans})


def month_over_month(amounts: DataFrame, key: str, time: str, amount: str) -> DataFrame:
    """Monthly totals and their relative change against the calendar month before.

    A month whose predecessor has no rows has no change.
    """
    months = amounts.groupBy(key, F.trunc(F.to_date(time), "month").alias("_first")).agg(F.sum(amount).alias("total"))
    before = Window.partitionBy(key).orderBy("_first")
    adjacent = F.lag("_first").over(before) == F.add_months("_first", -1)
    return months.withColumn("previous", F.when(adjacent, F.lag("total").over(before))).select(
        key, F.date_format("_first", "yyyy-MM").alias("month"), "total",
        F.try_divide(F.col("total") - F.col("previous"), F.col("previous")).alias("delta"))


def mention_volume(texts: DataFrame, column: str, group: str, words: list[str],
                   time: str | None = None, as_of: str | None = None, days: int = 7) -> DataFrame:
    """Texts per group that name any of the words, optionally in the last days only."""
    hit = any_word(F.col(LOWERED), words)
    if time is not None:
        hit = hit & (F.col(time) > F.expr(f"timestamp_ntz'{as_of}' - interval {days} days")) \
            & (F.col(time) <= F.expr(f"timestamp_ntz'{as_of}'"))
    return texts.withColumn(LOWERED, F.lower(F.col(column))).groupBy(group).agg(
        F.count_if(hit).alias("n_mentions"))


def review_rates(reviews: DataFrame, groups: list[str], sentiment: str, rating: str) -> DataFrame:
    """Mean sentiment and share of one-star ratings, for example per month."""
    return reviews.groupBy(*groups).agg(
        F.avg(sentiment).alias("avg_sentiment"),
        F.avg((F.col(rating) == 1).cast("int")).alias("one_star_rate"))


def price_competitiveness(own: DataFrame, offers: DataFrame, category: list[str],
                          own_price: str, offer_price: str) -> DataFrame:
    """Cheapest competing offer of the category over the own price."""
    cheapest = offers.groupBy(*category).agg(F.min(offer_price).alias("_cheapest"))
    return (
        own.join(cheapest, category, "left")
        .withColumn("price_competitiveness_ratio", F.try_divide(F.col("_cheapest"), F.col(own_price)))
        .drop("_cheapest")
    )


def join_features(base: DataFrame, tables: list[DataFrame], key: str = "customerID") -> DataFrame:
    """Left joins of feature tables that each hold one row per key."""
    return reduce(lambda left, right: left.join(right, key, "left"), tables, base)
