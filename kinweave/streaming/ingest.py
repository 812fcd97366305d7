"""Records that keep arriving: each micro-batch is normalised, matched by key with the anchors and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinweave.functions import text as T
from kinweave.operators.blocking import capped_pairs
from kinweave.session import ship


def keyed(records: DataFrame) -> DataFrame:
    """(country, id, name, addr, key) of raw records."""
    rows = records.withColumnRenamed("entity_id", "id").withColumns({"name": T.norm("business_name"), "addr": T.norm("business_address")})
    return rows.select("country", "id", "name", "addr", T.name_key("name", "addr").alias("key"))


def stream_pairs(spark: SparkSession, arrivals: DataFrame, anchors: DataFrame, out: str, checkpoint: str, cap: int = 30) -> StreamingQuery:
    """Start a query that writes (country, s1, r, batch) of each micro-batch of arrivals (raw records, a stream) as Parquet.

    A batch's folder is named by its number and overwritten, so a batch that is run again after a failure leaves no
    second copy of its pairs. The cap is on the records of a batch that share a key.
    """
    ship(spark)
    held = keyed(anchors)

    def write(batch: DataFrame, number: int) -> None:
        capped_pairs(held, keyed(batch), "key", cap).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
