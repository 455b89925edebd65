"""Encodings, bands, billing ratios and defaults, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from keepwell.functions import values as V
from keepwell.functions.text import stripped


def number(text: Column) -> Column:
    """Text to double; blank, unparseable and NaN all become null."""
    parsed = stripped(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def finite(column: Column) -> Column:
    """A numeric column as double, NaN as null."""
    x = column.cast("double")
    return F.when(~F.isnan(x), x)


def as_number(df: DataFrame, name: str) -> Column:
    """The column as double; text is parsed, anything else only cast."""
    column = F.col(f"`{name}`")
    return number(column) if isinstance(df.schema[name].dataType, StringType) else finite(column)


def total_charges(total: Column, tenure: Column, monthly: Column) -> Column:
    return F.coalesce(number(total), tenure * monthly)


def service_answer(column: Column) -> Column:
    """'No internet service' and 'No phone service' mean No; the rest passes through."""
    return F.when(column.isin(list(V.NO_SERVICE)), "No").otherwise(column)


def yes_no(column: Column, missing: int | None = None) -> Column:
    """1 for Yes, 0 for No, already encoded values stay, the rest is ``missing``."""
    text = column.cast("string")
    code = F.when(text == "Yes", 1).when(text == "No", 0).otherwise(text.try_cast("int"))
    return code if missing is None else F.coalesce(code, F.lit(missing))


def coded(column: Column, codes: dict[str, int], missing: int | None = 0) -> Column:
    chain = F
    for name, code in codes.items():
        chain = chain.when(column == name, F.lit(code))
    return chain.otherwise(F.lit(missing).cast("int"))


def decoded(column: Column, codes: dict[str, int], missing: str | None = None) -> Column:
    chain = F
    for name, code in codes.items():
        chain = chain.when(column == code, F.lit(name))
    return chain.otherwise(F.lit(missing).cast("string"))


def bundle_size(columns: list[str] = V.BUNDLE_COLUMNS) -> Column:
    """How many of the services are taken; text and encoded answers both count."""
    total = F.lit(0)
    for name in columns:
        total = total + yes_no(service_answer(F.col(name).cast("string")), 0)
    return total


def charges_per_month(total: Column, tenure: Column) -> Column:
    return total / F.greatest(tenure.cast("double"), F.lit(1.0))


def high_risk_contract(contract: Column, tenure: Column) -> Column:
    return F.coalesce((contract == "Month-to-month") & (tenure < 12), F.lit(False)).cast("int")


def stored_tenure_band(tenure: Column) -> Column:
    """Right-closed bands of the snapshot: 12 months is still the first one."""
    return (
        F.when((tenure > -1) & (tenure <= 12), "<12 months")
        .when((tenure > 12) & (tenure <= 24), "12-24 months")
        .when((tenure > 24) & (tenure <= 48), "24-48 months")
        .when((tenure > 48) & (tenure <= 73), ">48 months")
    )


def report_segment(tenure: Column) -> Column:
    """Segments of the risk report: 12 months belongs to the second one."""
    return (
        F.when(tenure < 12, "<12 months")
        .when(tenure <= 24, "12-24 months")
        .when(tenure <= 48, "24-48 months")
        .when(tenure > 48, ">48 months")
    )


def encode_customers(df: DataFrame) -> DataFrame:
    """Codes next to nothing else changed; unknown answers become null."""
    present = set(df.columns)
    changed = {c: service_answer(F.col(c)) for c in V.ADD_ON_COLUMNS if c in present}
    changed |= {c: yes_no(F.col(c)) for c in V.YES_NO_COLUMNS if c in present}
    if "Contract" in present:
        changed["contract_type_encoded"] = coded(F.col("Contract"), V.CONTRACT_CODES, None)
    return df.withColumns(changed)


def billing_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "charges_per_tenure_month": charges_per_month(F.col("TotalCharges"), F.col("tenure")),
        "is_high_risk_contract": high_risk_contract(F.col("Contract"), F.col("tenure")),
    })


def model_inputs(df: DataFrame) -> DataFrame:
    """Codes a model needs, from snapshot or raw answers alike (training and scoring)."""
    present = set(df.columns)
    changed = {c: yes_no(service_answer(F.col(c).cast("string")), 0)
               for c in ["Partner", "Dependents", "PhoneService", "PaperlessBilling",
                         "TechSupport", "OnlineSecurity"] if c in present}
    if "contract_type_encoded" not in present and "Contract" in present:
        changed["contract_type_encoded"] = coded(F.col("Contract"), V.CONTRACT_CODES)
    if "TotalCharges" in present:
        changed["TotalCharges"] = F.coalesce(as_number(df, "TotalCharges"), F.lit(0.0))
    derived_from = {
        "charges_per_tenure_month": {"TotalCharges", "tenure"},
        "is_high_risk_contract": {"Contract", "tenure"},
        "service_bundle_size": set(V.BUNDLE_COLUMNS),
        "urgency_level_encoded": {"urgency_level"},
    }
    ready = {name for name, need in derived_from.items()
             if name not in present and need <= present}
    if "charges_per_tenure_month" in ready:
        changed["charges_per_tenure_month"] = charges_per_month(
            F.coalesce(as_number(df, "TotalCharges"), F.lit(0.0)), F.col("tenure"))
    if "is_high_risk_contract" in ready:
        changed["is_high_risk_contract"] = high_risk_contract(F.col("Contract"), F.col("tenure"))
    if "service_bundle_size" in ready:
        changed["service_bundle_size"] = bundle_size()
    if "urgency_level_encoded" in ready:
        changed["urgency_level_encoded"] = coded(F.col("urgency_level"), V.MODEL_URGENCY_CODES)
    return df.withColumns(changed)


def with_defaults(df: DataFrame, defaults: dict[str, float] = V.SCORING_DEFAULTS,
                  categories: dict[str, str] = V.SCORING_CATEGORY_DEFAULTS) -> DataFrame:
    """Missing columns are added, nulls and unparseable numbers are filled."""
    present = set(df.columns)
    filled = {c: F.coalesce(as_number(df, c), F.lit(v)) if c in present else F.lit(v)
              for c, v in defaults.items()}
    filled |= {c: F.coalesce(F.col(c), F.lit(v)) if c in present else F.lit(v)
               for c, v in categories.items()}
    return df.withColumns(filled)


def in_contract_order(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Exactly the named columns as doubles; unknown ones are zero."""
    present = set(df.columns)
    cols = [F.coalesce(as_number(df, n), F.lit(0.0)).alias(n) if n in present
            else F.lit(0.0).alias(n) for n in names]
    return df.select(*keep, *cols)
