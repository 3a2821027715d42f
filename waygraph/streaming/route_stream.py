"""Queries answered as they arrive: a stream of query rows against a fixed graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernel import Network, kernel_route
from ..schema import QUERIES


def query_stream(spark: SparkSession, path: str, pattern: str = "*", files_at_once: int = 1, schema: str = QUERIES) -> DataFrame:
    """Stream of query rows from parquet files; files_at_once bounds what waits."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).parquet(path)


def route_stream(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True):
    """Answer each micro-batch with `answer` and append it to parquet at `out`, in batch order.

    A batch that is run again overwrites its own folder, so each query is answered once.
    """

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number:012d}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()


def kernel_answers(net: Network, algorithm: str = "dijkstra", weight: float = 1.05) -> Callable[[DataFrame], DataFrame]:
    return lambda batch: kernel_route(net, batch, algorithm, weight).select("query_id", "status", "distance", "path")


def ordered(results: DataFrame, queries: DataFrame, position: str = "input_pos") -> DataFrame:
    """Results in the order in which their queries came in."""
    return results.join(queries.select("query_id", position), "query_id").orderBy(position)
