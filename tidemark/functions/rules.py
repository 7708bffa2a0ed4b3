"""Rejection reasons: each rule list becomes one column that is null for a good row.

The reason tokens are fixed values: whoever reads quarantines knows them by these names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import COUNTRY_REGIONS, ENTITIES, TIMESTAMPS

Rule = tuple[Column, str]


def all_reasons(rules: Sequence[Rule]) -> Column:
    """Every reason that holds, in order, joined by semicolons."""
    return F.nullif(F.concat_ws(";", *(F.when(holds, F.lit(token)) for holds, token in rules)), F.lit(""))


def first_reason(rules: Sequence[Rule]) -> Column:
    """The first reason that holds."""
    return F.coalesce(*(F.when(holds, token if isinstance(token, Column) else F.lit(token)) for holds, token in rules))


def blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def rate_rules() -> list[Rule]:
    """For normalised columns rate_date, base_currency, quote_currency, rate, retrieved_at."""
    base, quote, rate = F.col("base_currency"), F.col("quote_currency"), F.col("rate")
    return [
        (F.col("rate_date").isNull(), "invalid_or_missing_rate_date"),
        (base.isNull() | quote.isNull(), "missing_currency"),
        ((F.length(base) != 3) | (F.length(quote) != 3), "invalid_currency_code"),
        (base == quote, "base_currency_equals_quote_currency"),
        (rate.isNull(), "invalid_or_missing_rate"),
        (rate <= 0, "non_positive_rate"),
        (F.col("retrieved_at").isNull(), "invalid_or_missing_retrieved_at"),
    ]


def location_rules() -> list[Rule]:
    return [
        (blank(F.col("location_id")), "missing_location_id"),
        (blank(F.col("location_name")), "missing_location_name"),
        (blank(F.col("timezone")), "missing_timezone"),
        (F.col("updated_at").isNull(), "invalid_or_missing_updated_at"),
        (F.col("region").isNull(), "unknown_country_reference"),
    ]


def missing_fields(fields: Sequence[str]) -> Column:
    """The raw fields that are null or empty, in the given order."""
    return F.concat_ws(",", *(F.when(blank(F.col(f)), F.lit(f)) for f in fields))


def raw_rate_reason() -> Column:
    """One reason for a raw rate: what is missing, then types, then values."""
    missing = missing_fields(ENTITIES["exchange_rates"].required)
    base, quote = F.upper(F.trim("base_currency")), F.upper(F.trim("quote_currency"))
    rate = F.col("rate").try_cast("decimal(20,10)")
    return first_reason([
        (missing != "", F.concat(F.lit("missing_required:"), missing)),
        (F.try_to_timestamp("rate_date").isNull() | rate.isNull() | F.try_to_timestamp("retrieved_at").isNull(), "invalid_type:rate_date_or_rate_or_retrieved_at"),
        ((F.length(base) != 3) | (F.length(quote) != 3), "invalid_currency_code"),
        (base == quote, "base_currency_equals_quote_currency"),
        (rate <= 0, "non_positive_rate"),
    ])


def raw_location_reason() -> Column:
    missing = missing_fields(ENTITIES["locations"].required)
    return first_reason([
        (missing != "", F.concat(F.lit("missing_required:"), missing)),
        (F.try_to_timestamp("updated_at").isNull(), "invalid_type:updated_at"),
        (~F.upper(F.trim("country_code")).isin(*COUNTRY_REGIONS), "unknown_country_reference"),
    ])


def contract_reason(entity: str, columns: Sequence[str]) -> Column:
    """Why a raw record of ``entity`` breaks its contract: ``missing:...`` or ``invalid:field``; null if it keeps it."""
    contract = ENTITIES[entity]
    missing = missing_fields(contract.required)
    rules: list[Rule] = [(missing != "", F.concat(F.lit("missing:"), missing))]
    if contract.amount:
        amount = F.col(contract.amount).try_cast("decimal(38,10)")
        rules.append((amount.isNull() | (amount < 0), f"invalid:{contract.amount}"))
    if contract.whole:
        rules.append((F.col(contract.whole).try_cast("int").isNull(), f"invalid:{contract.whole}"))
    for field in TIMESTAMPS:
        if field in columns:
            rules.append((~blank(F.col(field)) & F.try_to_timestamp(field).isNull(), f"invalid:{field}"))
    return first_reason(rules)
