"""Joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows; at most 1 / share keys can.
HOT_SHARE = 1 / 256
#: Rows below which no key is hot.
HOT_ROWS = 50_000


def spread_join(rows: DataFrame, stats: DataFrame, key: str, n: str, salt_by: list[str]) -> DataFrame:
    """Inner join of `rows` with one row of `stats` per `key`; a hot key goes to as many tasks as it is times over the limit.

    `stats[n]` is the number of rows a key has in `rows`. The hot keys are at most 1 / HOT_SHARE = 256 by
    arithmetic, which is what makes the broadcast of them safe at any size of input. Null keys join nothing.
    """
    limit = F.greatest(stats.agg(F.sum(n).alias("t")).scalar() * F.lit(HOT_SHARE), F.lit(HOT_ROWS))
    salts = F.ceil(F.col(n) / limit).cast("int")
    hot = stats.where(F.col(n) > limit).select(F.col(key).alias("_hot"), salts.alias("_salts"))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_hot", "_salts")
    copies = F.when(F.col(n) > limit, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    right = stats.withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"]).drop("_salt")
