"""Publications as a stream: term rows that arrive keep the corpus table current, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.publish import merged_corpus


def corpus_stream(term_rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:  # noqa: ANN003
    """Writes one row (term, book_ids, batch) per term and batch; reading merges them. A repeated batch replaces itself.

    Terms are a set union, so late and repeated rows need no watermark.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("term is not null and book_id is not null").groupBy("term").agg(F.array_sort(F.collect_set("book_id")).alias("book_ids"))
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return term_rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_corpus(spark, path: str) -> DataFrame:  # noqa: ANN001
    return merged_corpus(spark.read.parquet(path))
