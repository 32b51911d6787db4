"""Reading: tables, whole objects, ragged CSV of sentences, prefixes of files, and gets by key."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text objects."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def sentence_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sent_ix, tokens) of CSV files with one sentence a line, each of its own length; quoted fields allowed."""
    return csv_rows(objects(spark, path), "path", "text")


def csv_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_ix, tokens) of CSV in a column: a row for each record, which may hold line breaks within quotes.

    A null text gives no row, an empty line an empty record; records are as long as they are.
    """

    def parse(batches):  # noqa: ANN001, ANN202
        import csv
        import io

        import pyarrow as pa

        kind_ = pa.list_(pa.string())
        csv.field_size_limit(1 << 30)
        for b in batches:
            keys, order, tokens = [], [], []
            for at, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, fields in enumerate(csv.reader(io.StringIO(value or "", newline=""))):
                    keys.append(at)
                    order.append(i)
                    tokens.append(fields)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(order, pa.int32()), pa.array(tokens, kind_)], ["key", "sent_ix", "tokens"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(parse, f"key {kind}, sent_ix int, tokens array<string>").withColumnRenamed("key", key)


def seed_models(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, seed, term, v): the models of all books in a folder, centroids left out; a filter on book_id and seed
    reads only their files."""
    return spark.read.parquet(f"{folder}/seeds")


def centroid_models(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, term, count_, vector, variance, disparity, r_squared) of all books in a folder."""
    return spark.read.parquet(f"{folder}/centroids")


def files(spark: SparkSession, prefix: str, part: str) -> DataFrame:
    """(path, length, content) of files under a prefix whose name contains `part`."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{part}*").load(prefix)
    return rows.select("path", "length", "content")


def get(rows: DataFrame, key: dict, fields: Sequence[str] | None = None) -> DataFrame:
    """The rows of one key; filter and columns reach the scan."""
    for name, value in key.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows.select(*fields) if fields else rows


def get_many(rows: DataFrame, keys: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """The rows of all keys of `keys`, whose columns name them; Spark broadcasts the keys if they are few."""
    found = rows.join(keys.distinct(), keys.columns, "left_semi")
    return found.select(*fields) if fields else found


def book_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(source_id): distinct books that pages link to as /ebooks/<number>."""
    ids = F.explode(F.regexp_extract_all(html, F.lit(r"/ebooks/(\d+)"), F.lit(1)))
    return pages.select(ids.alias("i")).select(F.col("i").cast("bigint").alias("source_id")).distinct()


def texts_of_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, text) by the HTML reader, in Arrow batches."""

    def read(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text.html_text(x) for x in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("key"), "html").mapInArrow(read, f"key {kind}, text string").withColumnRenamed("key", key)


def metadata_of_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, metadata map<string, array<string>>) of the bibliographic table."""

    def read(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        kind = pa.map_(pa.string(), pa.list_(pa.string()))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(text.html_metadata(x).items()) for x in b.column(1).to_pylist()], kind)], ["key", "metadata"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("key"), "html").mapInArrow(read, f"key {kind}, metadata map<string, array<string>>").withColumnRenamed("key", key)


def job_arguments(arguments: Sequence[str] | None = None, seeds: bool = False) -> argparse.Namespace:
    """Arguments of a job over one book; the only platform is gutenberg."""
    p = argparse.ArgumentParser()
    p.add_argument("--platform", required=True, choices=["gutenberg"])
    p.add_argument("--id", required=True, type=int)
    if seeds:
        p.add_argument("--seed", required=True, type=int)
    found = p.parse_args(arguments)
    found.book_id = f"{found.platform}-{found.id}"
    return found
