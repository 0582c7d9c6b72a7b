"""Reversible clean-up: keep the originals, change the rows, restore on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quarantine(df: DataFrame, targets: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """NULL the column on the target rows; returns (clean, saved) with saved = key and original.

    A dry run simply reads the targets and stops there.
    """
    saved = targets.select(key, F.col(column).alias("original"))
    hit = saved.select(key, F.lit(True).alias("_hit")).distinct()
    clean = (
        df.join(hit, key, "left")
        .withColumn(column, F.when(F.col("_hit").isNull(), F.col(column)))
        .select(*df.columns)
    )
    return clean, saved


def restore(clean: DataFrame, saved: DataFrame, key: str, column: str) -> DataFrame:
    """Put the saved originals back."""
    return (
        clean.join(saved.select(key, "original", F.lit(True).alias("_hit")), key, "left")
        .withColumn(column, F.when(F.col("_hit").isNull(), F.col(column)).otherwise(F.col("original")))
        .select(*clean.columns)
    )


def backfill(df: DataFrame, assigned: DataFrame, key: str, column: str) -> DataFrame:
    """Fill the column from ``assigned`` (key, value) where it is missing; never overwrites."""
    value = assigned.select(key, F.col("value").alias("_value"))
    filled = F.when(F.coalesce(F.col(column), F.lit("")) == "", F.coalesce(F.col("_value"), F.col(column)))
    return df.join(value, key, "left").withColumn(column, filled.otherwise(F.col(column))).select(*df.columns)


def undo_backfill(df: DataFrame, assigned: DataFrame, key: str, column: str) -> DataFrame:
    """Set the column of every back-filled row to NULL again."""
    hit = assigned.select(key, F.lit(True).alias("_hit"))
    return (
        df.join(hit, key, "left").withColumn(column, F.when(F.col("_hit").isNull(), F.col(column))).select(*df.columns)
    )


def null_store_prices(listings: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clear the prices of installment listings; returns (clean, saved)."""
    return quarantine(listings, targets, "listing_id", "price")


def price_impact(targets: DataFrame) -> DataFrame:
    """Rows to be cleared per store, with the lowest and highest price."""
    return targets.groupBy("name_he").agg(
        F.count("*").alias("will_be_nulled"), F.min("price").alias("min_price"), F.max("price").alias("max_price")
    )
