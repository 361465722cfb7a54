"""Quantities in base units: numbers with units in texts, joined with the unit dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import CURRENCIES
from .values import float_parse

SURFACE = r"([+-]?\d[\d,]*\.?\d*\s*[\p{L}°$€£¥%/²³_]+(?:\s(?:dollar|yen|yuan|sterling|won|ruble)s?)?|[$€£¥]\s*\d[\d,]*\.?\d*)"


def currency_units(spark: SparkSession) -> DataFrame:
    """The currencies as rows of the unit dimension, in dollars."""
    rows = [(n, n, "currency", "dollar", f) for n, f in CURRENCIES.items()]
    return spark.createDataFrame(rows, "name string, symbol string, dimension string, base_unit string, factor double")


def quantities(values: DataFrame, units: DataFrame, near: float = 0.02) -> DataFrame:
    """(value, base_unit, amount): every quantity of a known unit in the distinct `value`s, converted; of amounts in one
    unit that differ by less than `near` of their size the least is kept. Values without a known unit give no row."""
    found = values.select("value").distinct().select("value", F.explode(F.regexp_extract_all("value", F.lit(SURFACE), 1)).alias("s"))
    sign = F.replace(F.lower(F.trim(F.regexp_replace("s", r"[\d,.+\-]", ""))), F.lit(" "), F.lit("_"))
    number = float_parse(F.regexp_extract("s", r"([+-]?\d[\d,]*\.?\d*)", 1))
    both = units.select(F.lower("symbol").alias("u"), "base_unit", "factor").union(units.select(F.lower("name"), "base_unit", "factor")).distinct()
    known = found.select("value", sign.alias("u"), number.alias("n")).join(F.broadcast(both), "u")
    amount = known.select("value", "base_unit", (F.col("n") * F.col("factor")).alias("amount")).distinct()
    before = F.lag("amount").over(Window.partitionBy("value", "base_unit").orderBy("amount"))
    kept = amount.withColumn("before", before).where(F.col("before").isNull() | (F.abs(F.col("amount") - F.col("before")) >= near * F.greatest(F.abs("amount"), F.abs("before"))))
    return kept.select("value", "base_unit", "amount")
