"""Value columns: alcohol per dollar, prices in cents (VL1, VL2, VL4, VL8-VL10, SZ3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brimful.functions.vocabulary import CALORIES_PER_GRAM, ETHANOL_GRAMS_PER_ML, ML_PER_OZ, OZ_PER_STANDARD_DRINK

METRICS = ("std", "cal")


def ethanol_oz(oz: Column, abv: Column) -> Column:
    return F.greatest(F.lit(0.0), oz) * (F.greatest(F.lit(0.0), abv) / 100)


def standard_drinks(oz: Column, abv: Column) -> Column:
    return ethanol_oz(oz, abv) / OZ_PER_STANDARD_DRINK


def dollars(cents: Column) -> Column:
    return cents / F.lit(100.0)


def value_of(oz: Column, abv: Column, cents: Column, metric: str = "std") -> Column:
    """Standard drinks or calories of alcohol per dollar; 0 without a price."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    amount = standard_drinks(oz, abv) if metric == "std" else ethanol_oz(oz, abv) * (ML_PER_OZ * ETHANOL_GRAMS_PER_ML) * CALORIES_PER_GRAM
    return F.when(cents > 0, amount / dollars(cents)).otherwise(0.0)


def drinks_from_value(value: Column, cents: Column) -> Column:
    """The standard drinks behind a value."""
    return value * dollars(cents)


def price_cents(amount: Column) -> Column:
    """Whole cents of a dollar amount, half away from zero; NULL unless positive."""
    cents = F.round(amount * 100).cast("int")
    return F.when(cents > 0, cents)


def parse_money(text: Column) -> Column:
    """Dollars of typed text; NULL unless it is a positive number."""
    amount = F.trim(F.translate(text, "$,", "")).try_cast("double")
    return F.when(amount > 0, amount)


def ml_to_oz(ml: Column) -> Column:
    return ml / ML_PER_OZ


def oz_to_ml(oz: Column) -> Column:
    return oz * ML_PER_OZ


def litres_to_oz(litres: Column) -> Column:
    return litres * 1000 / ML_PER_OZ
