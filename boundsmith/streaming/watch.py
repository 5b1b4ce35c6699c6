"""A folder of descriptions as a stream (an addition; stateless).

Clause splitting is row-local, so it runs on a stream as it stands; whatever needs
an order inside a document runs in ``foreachBatch`` on whole documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boundsmith.operators.clauses import split_clauses


def description_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    rows = spark.readStream.option("maxFilesPerTrigger", max_files).option("wholetext", True).text(path)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("source_text"))


def clause_stream(spark: SparkSession, path: str) -> DataFrame:
    return split_clauses(description_stream(spark, path))


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on every micro-batch and appends its rows as Parquet.

    Batches overwrite their own folder, so a repeated batch changes nothing.
    """
    return stream.writeStream.foreachBatch(lambda df, n: work(df).write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
