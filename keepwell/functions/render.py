"""Texts built from columns: table cells, customer cases, queries, briefings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: wording of the texts
SECTION_TAG = "[PLAYBOOK SECTION:"
CASE_TAG = "[HISTORICAL CASE]"
FALLBACK_ACTION = "Offer standard retention outreach."
FALLBACK_QUERY = "high churn risk"
FALLBACK_SUCCESS = "80%"
BRIEFING = (
    "This customer is at high risk of churn due to characteristics matching: '%s'. "
    "Historical cases show that customers with similar features were successfully retained "
    "or churned depending on immediate outreach. "
    "Recommended Action: %s (estimated success probability is %s)."
)
NO_ACTION = "No action required. Customer exhibits stable behavior."


def two_decimals(value: Column) -> Column:
    """Two decimals by the exact binary value, ties to even, as C and Python print them.

    The product with 100 is split into its rounded value and the exact rest (the
    factor is small, so both halves of the value multiply without error); the rest
    decides where the rounded product looks like a tie.
    """
    cents = value * 100.0
    upper = value * 134217729.0
    upper = upper - (upper - value)
    rest = (upper * 100.0 - cents) + (value - upper) * 100.0
    whole = F.floor(cents)
    part = cents - whole
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (whole % 2 != 0))))
    return F.format_string("%.2f", (whole + up.cast("int")) / 100.0)


def percent(value: Column) -> Column:
    return F.concat(two_decimals(value * 100.0), F.lit("%"))


def dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), two_decimals(value))


def is_yes(flag: Column) -> Column:
    """For answers as text, code or boolean alike."""
    return F.coalesce(flag.cast("string").isin("Yes", "1", "1.0", "true"), F.lit(False))


def said(flag: Column) -> Column:
    return F.when(is_yes(flag), "Yes").otherwise("No")


def case_text() -> Column:
    """One customer as a sentence; needs encoded flags and the logged intervention."""
    contract = F.when(F.col("contract_type_encoded") == 0, "month-to-month").otherwise("yearly")
    return F.concat(
        F.lit(f"{CASE_TAG} Customer ID: "), F.col("customerID").cast("string"),
        F.lit(". Profile: tenure "), F.col("tenure").cast("string"),
        F.lit(" months, contract "), contract,
        F.lit(", MonthlyCharges "), dollars(F.col("MonthlyCharges")),
        F.lit(", OnlineSecurity "), said(F.col("OnlineSecurity")),
        F.lit(", TechSupport "), said(F.col("TechSupport")),
        F.lit(". Support History: sentiment "), two_decimals(F.round("sentiment_score", 6)),
        F.lit(", escalation "), said(F.col("escalation_flag")),
        F.lit(". Intervention Taken: "), F.coalesce(F.col("intervention_type"), F.lit("none")),
        F.lit(" Outcome: "),
        F.when(F.col("outcome") == 1, "Customer was retained.")
        .when(F.col("outcome") == 0, "Customer churned anyway.")
        .otherwise("not logged."),
    )


def _phrases() -> dict[str, Column]:
    """Word in a driver's name to what it says about the customer; the first match decides,
    so ``charges_per_tenure_month`` speaks of tenure."""
    code = F.coalesce(F.col("contract_type_encoded"), F.lit(0))
    mood = F.coalesce(F.col("sentiment_score"), F.lit(0.0))
    tenure = F.coalesce(F.col("tenure"), F.lit(0)).cast("int").cast("string")
    return {
        "contract": F.when(code == 0, "month-to-month contract").when(code == 1, "one-year contract")
        .otherwise("two-year contract"),
        "tenure": F.concat(F.lit("tenure "), tenure, F.lit(" months")),
        "charges": F.concat(F.lit("monthly charges "), dollars(F.coalesce(F.col("MonthlyCharges"), F.lit(0.0)))),
        "techsupport": F.when(is_yes(F.col("TechSupport")), "has tech support").otherwise("no tech support"),
        "onlinesecurity": F.when(is_yes(F.col("OnlineSecurity")), "has online security").otherwise("no online security"),
        "escalation": F.when(is_yes(F.col("escalation_flag")), "escalated support ticket").otherwise("no escalation"),
        "sentiment": F.concat(F.when(mood < 0, "negative ticket sentiment ").otherwise("neutral sentiment "),
                              two_decimals(mood)),
    }


def with_query_text(df: DataFrame, drivers: str = "top_drivers", output: str = "query_text", k: int = 3) -> DataFrame:
    """Adds the search text of the first k drivers.

    Each phrase is made once per row and then picked per driver, which keeps the
    generated code small enough to be compiled.
    """
    said_once = {f"_says_{word}": phrase for word, phrase in _phrases().items()}
    names = {f"_driver_{i}": F.lower(F.get(F.col(drivers), F.lit(i))) for i in range(k)}

    def picked(name: str) -> Column:
        chain = F
        for word in _phrases():
            chain = chain.when(F.col(name).contains(word), F.col(f"_says_{word}"))
        return chain

    spoken = F.concat_ws(" ", *[picked(n) for n in names])
    return df.withColumns({**said_once, **names}).withColumn(output, F.concat(
        F.lit("customer "), F.coalesce(F.nullif(spoken, F.lit("")), F.lit(FALLBACK_QUERY)))).drop(*said_once, *names)


def section_strategy(section: Column) -> Column:
    """The part between 'Strategy:' and 'Key drivers:', null when there is none."""
    found = F.regexp_extract(section, r"(?s)Strategy:(.*?)(?:Key drivers:|Strategy:|\z)", 1)
    trimmed = F.regexp_replace(found, r"^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def section_success(section: Column) -> Column:
    found = F.regexp_extract(section, r"Estimated success rate:\s*(\d+%)", 1)
    return F.when(found != "", found)


def briefing(query: Column, section: Column) -> Column:
    action = F.coalesce(section_strategy(section), F.lit(FALLBACK_ACTION))
    rate = F.coalesce(section_success(section), F.lit(FALLBACK_SUCCESS))
    return F.format_string(BRIEFING, query, action, rate)
