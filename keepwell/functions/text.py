"""Ticket text to structured features, as column expressions.

Words match as substrings of the lower-cased text. Everything stays inside the
JVM and nothing here needs a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the default word lists
TOPIC_WORDS = {
    "billing": ["bill", "invoice", "charge", "refund", "price", "cost"],
    "performance": ["slow", "speed", "outage", "down", "network", "disruption", "power"],
    "competitor": ["competitor", "verizon", "t-mobile", "att", "cheaper", "match"],
    "cancellation": ["cancel", "terminate", "expire", "leaving", "stop"],
}
URGENCY_WORDS = {
    "critical": ["cancel", "legal", "lawyer", "regulator", "court", "threat", "unacceptable"],
    "fault": ["error", "down", "outage", "double charge"],
    "question": ["question", "help", "how to"],
    "hurry": ["immediate", "quick", "asap", "hurry"],
}
NEGATIVE_WORDS = [
    "terrible", "bad", "unacceptable", "angry", "disruption", "broken", "hate", "worst",
]
POSITIVE_WORDS = ["happy", "good", "great", "thank", "love", "satisfied", "helpful"]
ESCALATION_WORDS = [
    "cancel", "leave", "switch", "court", "sue", "legal", "regulator", "publicly",
]


@dataclass(frozen=True)
class Lexicon:
    topics: dict[str, list[str]] = field(default_factory=lambda: TOPIC_WORDS)
    urgency: dict[str, list[str]] = field(default_factory=lambda: URGENCY_WORDS)
    negative: list[str] = field(default_factory=lambda: NEGATIVE_WORDS)
    positive: list[str] = field(default_factory=lambda: POSITIVE_WORDS)
    escalation: list[str] = field(default_factory=lambda: ESCALATION_WORDS)

    def extended(self, topics=None, urgency=None, negative=(), positive=(), escalation=()) -> Lexicon:
        """A copy with more words, for corpora in other languages, and with more topics."""
        def merged(base, more):
            return {k: [*words, *(more or {}).get(k, [])] for k, words in base.items()}

        return replace(
            self,
            topics={**{t: list(words) for t, words in (topics or {}).items()}, **merged(self.topics, topics)},
            urgency=merged(self.urgency, urgency),
            negative=[*self.negative, *negative],
            positive=[*self.positive, *positive],
            escalation=[*self.escalation, *escalation],
        )


DEFAULT_LEXICON = Lexicon()


def any_word(lowered: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def words_hit(lowered: Column, words: list[str]) -> Column:
    """How many distinct words of the list occur."""
    return reduce(lambda a, b: a + b, [lowered.contains(w).cast("int") for w in words])


LOWERED = "_lowered"


def _marks(lexicon: Lexicon) -> dict[str, Column]:
    """One column per word list, from the lowered text."""
    low = F.col(LOWERED)
    marks = {f"_topic_{t}": any_word(low, w) for t, w in lexicon.topics.items()}
    marks |= {f"_urgency_{u}": any_word(low, w) for u, w in lexicon.urgency.items()}
    return marks | {
        "_negative": F.least(words_hit(low, lexicon.negative), F.lit(5)),
        "_positive": F.least(words_hit(low, lexicon.positive), F.lit(5)),
        "_escalation": any_word(low, lexicon.escalation),
    }


def _topics(lexicon: Lexicon) -> Column:
    """Matched topics in list order, ``[other]`` when none, ``[]`` for no text."""
    found = {t: F.col(f"_topic_{t}") for t in lexicon.topics}
    none_found = reduce(lambda a, b: a & b, [~c for c in found.values()])
    return (
        F.when(F.col(LOWERED).isNull(), F.array().cast("array<string>"))
        .when(none_found, F.array(F.lit("other")))
        .otherwise(F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in found.items()])))
    )


def _urgency() -> Column:
    """A later, weaker list still beats the hurry list: "immediate help" is medium."""
    return (
        F.when(F.col("_urgency_critical"), "critical")
        .when(F.col("_urgency_fault"), "high")
        .when(F.col("_urgency_question"), "medium")
        .when(F.col("_urgency_hurry"), "high")
        .otherwise("low")
    )


def _sentiment() -> Column:
    bad, good = F.col("_negative"), F.col("_positive")
    raw = (
        F.when(F.col(LOWERED).isNull(), F.lit(0.0))
        .when(bad > 0, F.lit(-0.5) - F.lit(0.1) * bad)
        .when(good > 0, F.lit(0.3) + F.lit(0.1) * good)
        .otherwise(F.lit(0.0))
    )
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def with_features(df: DataFrame, column: str, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Adds sentiment, urgency, topics and escalation of a text column.

    Three projections, so that a long text is lowered once and searched once per
    word list however often an answer refers to it. Unused answers are pruned.
    """
    marked = df.withColumn(LOWERED, F.lower(F.col(f"`{column}`"))).withColumns(_marks(lexicon))
    return marked.withColumns({
        "sentiment_score": _sentiment(),
        "urgency_level": _urgency(),
        "complaint_topics": _topics(lexicon),
        "escalation_flag": F.coalesce(F.col("_escalation"), F.lit(False)),
    }).drop(LOWERED, *_marks(lexicon))


# fixed values: what counts as white space around a text
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def stripped(text: Column) -> Column:
    """Strip every kind of white space; plain trims take only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(stripped(text), "UTF-8"), 256)


EXTRACTION_SCHEMA = (
    "sentiment_score double, urgency_level string, "
    "complaint_topics array<string>, escalation_flag boolean"
)


def parsed_extraction(payload: Column) -> dict[str, Column]:
    """An extractor's JSON answer with defaults for what it left out."""
    doc = F.from_json(payload, EXTRACTION_SCHEMA, {"mode": "PERMISSIVE"})
    return {
        "sentiment_score": F.coalesce(doc["sentiment_score"], F.lit(0.0)),
        "urgency_level": F.lower(F.coalesce(doc["urgency_level"], F.lit("low"))),
        "complaint_topics": F.coalesce(doc["complaint_topics"], F.array(F.lit("other"))),
        "escalation_flag": F.coalesce(doc["escalation_flag"], F.lit(False)),
    }
