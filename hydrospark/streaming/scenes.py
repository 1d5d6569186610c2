"""The scene cache kept up to date from a folder that search results arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hydrospark.sources.scans import pending_work

CACHE = "key string, json string"


def follow_results(spark: SparkSession, arriving: str, cache: str, checkpoint: str) -> StreamingQuery:
    """Appends to ``cache`` (Parquet) the new results whose keys it lacks, with all that has arrived so far, then stops.

    A batch that is run again after a failure finds its keys in the cache and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        path = own._jvm.org.apache.hadoop.fs.Path(cache)
        there = path.getFileSystem(own._jsc.hadoopConfiguration()).exists(path)
        fresh = batch.dropDuplicates(["key"])
        if there:
            fresh = pending_work(fresh, own.read.schema(CACHE).parquet(cache).select("key"), "key")
        fresh.write.mode("append").parquet(cache)

    stream = spark.readStream.schema(CACHE).json(arriving)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
