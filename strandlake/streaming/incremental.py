"""Adding to what is loaded, in batches or as files arrive: each is an anti-join with what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def new_rows(loaded: DataFrame, arriving: DataFrame, key: list[str]) -> DataFrame:
    """Arriving rows whose key is not loaded, each key once."""
    return arriving.join(loaded.select(*key), key, "left_anti").dropDuplicates(key)


def follow(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Append files that arrive in a folder to a Parquet table, without rows whose key it has. A batch that runs again
    after a failure finds its rows loaded and adds none. Ends when what is there has been read."""

    def add(batch: DataFrame, _: int) -> None:
        try:
            loaded = spark.read.schema(batch.schema).parquet(table)
            loaded.head(1)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            loaded = batch.limit(0)
        new_rows(loaded, batch, key).write.mode("append").parquet(table)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
