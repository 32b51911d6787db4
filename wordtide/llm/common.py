"""What the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_terms(book_terms: DataFrame) -> DataFrame:
    """(book_id, term, count_, platform_data): of the rows with a count_, the latest published_at per (book_id, term).

    Rows without book_id, term or count_ are left out. Of rows with the same published_at the largest count_ stands,
    so repeated rows change nothing; a null published_at is the earliest.
    """
    rows = book_terms.where("count_ is not null and term is not null and book_id is not null")
    last = F.max(F.struct("published_at", "count_", "platform_data")).alias("last")
    return rows.groupBy("book_id", "term").agg(last).select("book_id", "term", "last.count_", "last.platform_data")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's own setting, in tests a folder made for them."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        import tempfile

        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a shared folder")
        where = tempfile.mkdtemp(prefix="wordtide-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A group is hot when it holds more than this share of the rows, and at least so many; at most 1 / share groups can be.
HOT_SHARE, HOT_ROWS = 1 / 512, 2_000


def meet(left: DataFrame, right: DataFrame, by: list[str], spread: str) -> DataFrame:
    """Inner join on `by`. The rows of `left` in a hot group go, by their column `spread`, to as many tasks as the group
    is times over the limit; its rows of `right` go to each of them.

    The hot groups, at most 1 / HOT_SHARE by arithmetic, are broadcast. Null keys join nothing.
    """
    sizes = left.groupBy(*by).agg(F.count("*").alias("_c"))
    limit = F.greatest(sizes.agg(F.sum("_c") * HOT_SHARE).scalar(), F.lit(HOT_ROWS))
    hot = F.broadcast(sizes.where(F.col("_c") > limit).select(*by, F.ceil(F.col("_c") / limit).cast("int").alias("_parts")))
    one = F.coalesce("_parts", F.lit(1))
    left = left.join(hot, by, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), one).cast("int")).drop("_parts")
    right = right.join(hot, by, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return left.join(right, [*by, "_salt"]).drop("_salt")
