"""Finished cases as an append-only table fed by a stream of case rows.

Each micro-batch drops the keys that are already in the table and appends the rest, so a restarted
stream, or a batch that is delivered twice, adds nothing twice. The table is partitioned by a hash of
the key: a batch reads the partitions that its own keys fall in, never the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKET = "key_bucket"
BUCKETS = 256


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def resume_stream(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS
) -> StreamingQuery:
    """Append ``work`` of every case of ``source`` that ``target`` does not hold yet.

    ``work`` keeps the key columns; ``target`` gets the column ``key_bucket`` besides.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def batch(df: DataFrame, epoch: int) -> None:
        todo = df.dropDuplicates(keys).withColumn(BUCKET, bucket)
        if _exists(spark, target):
            touched = [r[0] for r in todo.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
            done = spark.read.parquet(target).filter(F.col(BUCKET).isin(touched)).select(*keys)
            todo = todo.join(done, keys, "left_anti")
        work(todo.drop(BUCKET)).withColumn(BUCKET, bucket).write.mode("append").partitionBy(BUCKET).parquet(target)

    s = spark.readStream.schema(schema).parquet(source)
    return s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
