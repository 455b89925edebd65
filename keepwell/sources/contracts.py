"""Data contracts: JSON-schema documents as Spark schemas and checks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    DataType, DoubleType, IntegerType, StringType, StructField, StructType,
)

from keepwell.functions.features import number

TYPES: dict[str, DataType] = {"string": StringType(), "integer": IntegerType(), "number": DoubleType()}


class ContractError(ValueError):
    """A table does not have the columns its contract requires."""


@dataclass(frozen=True)
class ColumnRule:
    name: str
    type: str
    nullable: bool = True
    allowed: tuple = ()
    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class Contract:
    title: str
    columns: tuple[ColumnRule, ...]
    required: tuple[str, ...] = field(default=())

    def schema(self) -> StructType:
        """All columns in contract order; mixed types are read as text."""
        return StructType([StructField(c.name, TYPES[c.type]) for c in self.columns])


def load_contract(document: str | dict) -> Contract:
    """Reads a JSON-schema document from a path, a JSON text or a dict.

    A union of types keeps the wider one: text, unless the rest is numeric or null.
    """
    if isinstance(document, str):
        text = document if document.lstrip().startswith("{") else Path(document).read_text()
        document = json.loads(text)
    rules = []
    for name, prop in document.get("properties", {}).items():
        kinds = prop.get("type", "string")
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        real = [k for k in kinds if k != "null"]
        kind = "string" if "string" in real else "number" if "number" in real else "integer"
        rules.append(ColumnRule(name, kind, "null" in kinds or name not in document.get("required", []),
                                tuple(prop.get("enum", ())), prop.get("minimum"), prop.get("maximum")))
    return Contract(document.get("title", ""), tuple(rules), tuple(document.get("required", ())))


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    return [c for c in contract.required if c not in df.columns]


def require_columns(df: DataFrame, contract: Contract) -> DataFrame:
    """Raises with all missing columns at once."""
    missing = missing_columns(df, contract)
    if missing:
        raise ContractError(f"{contract.title}: missing required columns: {', '.join(missing)}")
    return df


def absent_columns(df: DataFrame, contract: Contract) -> DataFrame:
    """(column_name, rule, n_bad) of every required column that the table lacks: all its rows lack a value there."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit("missing").alias("rule"), F.col("n").alias("n_bad"))
             for c in missing_columns(df, contract)]
    rows = F.array(*cells).cast("array<struct<column_name:string,rule:string,n_bad:bigint>>")
    return df.agg(F.count("*").alias("n")).select(F.inline(rows))


def rule_breaks(df: DataFrame, contract: Contract) -> dict[tuple[str, str], Column]:
    """One condition per column and rule; null breaks only the ``required`` rule."""
    types = dict(df.dtypes)
    broken: dict[tuple[str, str], Column] = {}
    for c in contract.columns:
        if c.name not in types:
            continue
        x = F.col(f"`{c.name}`")
        if c.name in contract.required and not c.nullable:
            broken[c.name, "required"] = x.isNull()
        text = types[c.name] == "string"
        value = number(x) if text else x
        if c.type != "string" and text:
            broken[c.name, "type"] = x.isNotNull() & value.isNull()
        if c.type == "integer" and types[c.name] in ("string", "double", "float"):
            broken[c.name, "type"] = x.isNotNull() & (value.isNull() | (value != F.floor(value)))
        if c.allowed:
            broken[c.name, "enum"] = ~x.isin(list(c.allowed))
        if c.minimum is not None:
            broken[c.name, "minimum"] = value < c.minimum
        if c.maximum is not None:
            broken[c.name, "maximum"] = value > c.maximum
    return broken


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(column_name, rule, n_bad) for every rule, from one aggregate over the table."""
    broken = rule_breaks(df, contract)
    totals = df.agg(*[F.count_if(b).alias(f"n{i}") for i, b in enumerate(broken.values())])
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"), F.col(f"n{i}").alias("n_bad"))
             for i, (c, r) in enumerate(broken)]
    return totals.select(F.inline(F.array(*cells)))


def _contract(title: str, rules: list[ColumnRule], required: list[str]) -> Contract:
    return Contract(title, tuple(
        ColumnRule(r.name, r.type, r.name not in required, r.allowed, r.minimum, r.maximum) for r in rules),
        tuple(required))


# --- fixed values: the contracts of the four sources -----------------------
_YES_NO = ("Yes", "No")
_PHONE = ("Yes", "No", "No phone service")
_INTERNET = ("Yes", "No", "No internet service")
_FLAG = (0, 1)

_CUSTOMER_RULES = [
    ColumnRule("customerID", "string"),
    ColumnRule("gender", "string", allowed=("Male", "Female")),
    ColumnRule("SeniorCitizen", "integer", allowed=_FLAG),
    ColumnRule("Partner", "string", allowed=_YES_NO),
    ColumnRule("Dependents", "string", allowed=_YES_NO),
    ColumnRule("tenure", "integer", minimum=0, maximum=72),
    ColumnRule("PhoneService", "string", allowed=_YES_NO),
    ColumnRule("MultipleLines", "string", allowed=_PHONE),
    ColumnRule("InternetService", "string", allowed=("DSL", "Fiber optic", "No")),
    ColumnRule("OnlineSecurity", "string", allowed=_INTERNET),
    ColumnRule("OnlineBackup", "string", allowed=_INTERNET),
    ColumnRule("DeviceProtection", "string", allowed=_INTERNET),
    ColumnRule("TechSupport", "string", allowed=_INTERNET),
    ColumnRule("StreamingTV", "string", allowed=_INTERNET),
    ColumnRule("StreamingMovies", "string", allowed=_INTERNET),
    ColumnRule("Contract", "string", allowed=("Month-to-month", "One year", "Two year")),
    ColumnRule("PaperlessBilling", "string", allowed=_YES_NO),
    ColumnRule("PaymentMethod", "string", allowed=(
        "Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)")),
    ColumnRule("MonthlyCharges", "number", minimum=0.0, maximum=200.0),
    ColumnRule("TotalCharges", "string"),
    ColumnRule("Churn", "string", allowed=_YES_NO),
]
CUSTOMERS = _contract("customers", _CUSTOMER_RULES, [r.name for r in _CUSTOMER_RULES])

_BANK_RULES = [
    ColumnRule("RowNumber", "integer"),
    ColumnRule("CustomerId", "string"),
    ColumnRule("Surname", "string"),
    ColumnRule("CreditScore", "integer", minimum=300, maximum=850),
    ColumnRule("Geography", "string"),
    ColumnRule("Gender", "string", allowed=("Male", "Female")),
    ColumnRule("Age", "integer", minimum=18, maximum=120),
    ColumnRule("Tenure", "integer", minimum=0),
    ColumnRule("Balance", "number"),
    ColumnRule("NumOfProducts", "integer", minimum=1),
    ColumnRule("HasCrCard", "integer", allowed=_FLAG),
    ColumnRule("IsActiveMember", "integer", allowed=_FLAG),
    ColumnRule("EstimatedSalary", "number"),
    ColumnRule("Exited", "integer", allowed=_FLAG),
]
BANK = _contract("bank", _BANK_RULES, [
    "CustomerId", "CreditScore", "Geography", "Gender", "Age",
    "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember", "EstimatedSalary",
])

_TICKET_RULES = [
    ColumnRule("Ticket ID", "string"),
    ColumnRule("Customer Name", "string"),
    ColumnRule("Customer Email", "string"),
    ColumnRule("Customer Age", "integer"),
    ColumnRule("Customer Gender", "string"),
    ColumnRule("Product Purchased", "string"),
    ColumnRule("Date of Purchase", "string"),
    ColumnRule("Ticket Type", "string"),
    ColumnRule("Ticket Subject", "string"),
    ColumnRule("Ticket Description", "string"),
    ColumnRule("Ticket Status", "string"),
    ColumnRule("Ticket Priority", "string"),
    ColumnRule("Ticket Channel", "string"),
    ColumnRule("Ticket Creation Date", "string"),
    ColumnRule("First Response Time", "string"),
    ColumnRule("Resolution Time", "string"),
    ColumnRule("Customer Satisfaction Rating", "number"),
    ColumnRule("customerID", "string"),
]
# customerID is required here because the rollup groups by it
TICKETS = _contract("tickets", _TICKET_RULES, [
    "Ticket ID", "Ticket Subject", "Ticket Description", "Ticket Priority", "Product Purchased", "customerID",
])

_SHOP_RULES = [
    ColumnRule("customerID", "string"),
    ColumnRule("logins_per_week", "integer"),
    ColumnRule("cart_abandonment_rate", "number"),
    ColumnRule("time_since_last_order", "integer"),
    ColumnRule("preferred_device", "string"),
    ColumnRule("preferred_payment_mode", "string"),
    ColumnRule("days_since_last_order", "integer"),
]
SHOP = _contract("e-commerce", _SHOP_RULES, ["customerID"])
