"""Writing: new states of a table as DataFrames, and how they reach storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.books import latest


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` and those of `new` whose key it lacks; of new rows with one key any one is as good as the other."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def inserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inserted): whether each new key was free."""
    held = existing.select(*keys, F.lit(True).alias("_held")).distinct()
    return new.select(*keys).distinct().join(held, keys, "left").select(*keys, F.col("_held").isNull().alias("inserted"))


def update_fields(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Sets the non-null fields of `changes`; a key that is new gets a row."""
    fields = [c for c in changes.columns if c not in keys]
    both = existing.join(changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in fields)), keys, "full")
    return both.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in existing.columns))


def put_rows(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the latest version per key."""
    return latest(existing.unionByName(new), keys, version)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that `df` has rows for; one file a partition and task."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_models(seed_vectors: DataFrame, centroids: DataFrame, folder: str) -> None:
    """A book's seed models and its centroid in `folder`, one directory a book and seed; other books' stay."""
    write_partitions(seed_vectors, f"{folder}/seeds", ["book_id", "seed"])
    write_partitions(centroids, f"{folder}/centroids", ["book_id"])


def csv_lines(df: DataFrame, tokens: str) -> DataFrame:
    """(…, line): a list as one CSV line, with quotes only where they are needed; a null field is an empty one."""
    fields = F.transform(tokens, lambda x: F.coalesce(x, F.lit("")))
    quoted = F.transform(fields, lambda x: F.when(x.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x))
    # a line that is one empty field would be no record
    return df.withColumn("line", F.when(fields == F.array(F.lit("")), F.lit('""')).otherwise(F.array_join(quoted, ",")))
