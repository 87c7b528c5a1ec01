"""Bounded training samples, the same in each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(4))


SALTS = 64


def per_class(rows: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """(key, label) of about ``most`` rows of each label at most, by a hash of the key.

    Each label is dealt to SALTS groups, and each gives its share, so that no task
    holds a whole label.
    """
    salt = F.pmod(F.xxhash64(F.lit("salt"), key), F.lit(SALTS))
    order = Window.partitionBy(label, "__salt").orderBy(F.xxhash64(key), key)
    return rows.select(key, label, salt.alias("__salt")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= -(-most // SALTS)).drop("__n", "__salt")
