"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread_by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``big`` with ``small`` (few rows a key), every key of ``big`` spread over ``salts`` tasks.

    ``small`` is repeated ``salts`` times; ``how`` may be inner, left or left_semi/left_anti of ``big``.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
