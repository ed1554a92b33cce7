"""The change watch as a stream: each batch of arrivals updates a state table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators.documents import content_hash


def arrivals(batch: DataFrame) -> DataFrame:
    """key and fingerprint of a batch, the last arrival (by ts) of each key."""
    last = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("fingerprint"))
    rows = batch.select("key", content_hash(F.col("text")).alias("fingerprint"), "ts")
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").select("key", "fingerprint")


def watch(stream: DataFrame, path: str, checkpoint: str):
    """Starts the watch; a batch that is run again writes the same version of the state, so it counts once."""

    def step(batch: DataFrame, version: int) -> None:
        spark, new = batch.sparkSession, arrivals(batch)
        if version:
            old = spark.read.parquet(f"{path}/v={version - 1}")
            joined = old.withColumnRenamed("fingerprint", "had").join(new, "key", "full")
            changed = F.col("fingerprint").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("had"))
            new = joined.select("key", F.coalesce("fingerprint", "had").alias("fingerprint"), F.when(changed, "pending").otherwise(F.col("status")).alias("status"))
        else:
            new = new.withColumn("status", F.lit("baseline"))
        new.write.mode("overwrite").parquet(f"{path}/v={version}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
