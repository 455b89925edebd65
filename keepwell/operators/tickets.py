"""Support tickets rolled up per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keepwell.functions import features, text as T, values as V


def with_text_features(tickets: DataFrame, column: str = "Ticket Description",
                       lexicon: T.Lexicon = T.DEFAULT_LEXICON) -> DataFrame:
    return T.with_features(tickets, column, lexicon)


def rollup(tickets: DataFrame, key: str = "customerID") -> DataFrame:
    """One row per customer; every part merges before the shuffle. No key, no row."""
    code = features.coded(F.col("urgency_level"), V.ROLLUP_URGENCY_CODES, None)

    def mentions(topic: str):
        return F.max(F.array_contains("complaint_topics", topic).cast("int"))

    return (
        tickets.where(F.col(key).isNotNull()).groupBy(key).agg(
            F.avg("sentiment_score").alias("ticket_sentiment_score"),
            F.max(code).alias("_urgency"),
            mentions("billing").alias("ticket_complaint_topics_billing"),
            mentions("competitor").alias("ticket_complaint_topics_competitor"),
            mentions("performance").alias("ticket_complaint_topics_performance"),
            F.max(F.col("escalation_flag").cast("int")).alias("ticket_escalation_flag"),
        )
        .withColumn("ticket_urgency_level", features.decoded(F.col("_urgency"), V.ROLLUP_URGENCY_CODES))
        .drop("_urgency")
    )


def fill_missing_tickets(customers: DataFrame, rolled: DataFrame, key: str = "customerID") -> DataFrame:
    """Left join of the rollup; customers without tickets get the quiet defaults."""
    joined = customers.join(rolled, key, "left").na.fill(V.TICKET_DEFAULTS)
    return joined.withColumns({
        "sentiment_score": F.col("ticket_sentiment_score"),
        "urgency_level": F.col("ticket_urgency_level"),
        "escalation_flag": F.col("ticket_escalation_flag"),
    })


def topics_per_customer(tickets: DataFrame, key: str = "customerID",
                        lexicon: T.Lexicon = T.DEFAULT_LEXICON) -> DataFrame:
    """The union of topics in alphabetical order.

    Topics are those of the lexicon that found them, so one flag per topic replaces collecting the
    arrays: a customer with millions of tickets still is one small row.
    """
    known = sorted({*lexicon.topics, "other"})
    flags = tickets.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.max(F.array_contains("complaint_topics", t)).alias(f"_{i}") for i, t in enumerate(known)])
    tags = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(t)) for i, t in enumerate(known)]))
    return flags.select(key, tags.alias("complaint_topics"))


def contacts(tickets: DataFrame, key: str, time: str, as_of: str, days: int = 30) -> DataFrame:
    """All tickets and those of the last ``days`` before ``as_of`` per customer."""
    until = F.lit(as_of).cast("timestamp_ntz")
    recent = (F.col(time) > F.expr(f"timestamp_ntz'{as_of}' - interval {days} days")) & (F.col(time) <= until)
    return tickets.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n_all"), F.count_if(recent).alias("n_recent"))
