"""New posting files into the accumulated table."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from postlens.operators.sets import first_per_key


def ingest_postings(
    files: DataFrame, store: str, checkpoint: str, keys: Sequence[str], stamp: str,
) -> StreamingQuery:
    """Append each micro-batch, reduced to the last version per key, under its own batch folder.

    A batch that is run again after a failure overwrites its own folder only, so every batch
    counts once. No state grows with the stream; ``current_postings`` picks the last version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = first_per_key(batch, keys, [F.desc(stamp)])
        latest.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_counting_late(
    files: DataFrame, store: str, counts: str, checkpoint: str, keys: Sequence[str], ts: str, lateness: str,
) -> StreamingQuery:
    """X2 with its late rows counted: (batch_id, rows, late_rows, latest) per batch at ``counts``.

    A row is late if it lies more than ``lateness`` before the latest time of all earlier
    batches. Late rows are stored like the others; the count tells how many a watermark of that
    width would have dropped. A batch that is run again overwrites its own count.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        kept = session.read.schema(_LATE).parquet(counts).filter(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0] if batch_id else None
        border = F.lit(kept).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        late = F.count_if(F.coalesce(F.col(ts).cast("timestamp") < border, F.lit(False)))
        first_per_key(batch, keys, [F.desc(ts)]).write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")
        batch.agg(F.count("*").alias("rows"), late.alias("late_rows"), F.max(F.col(ts).cast("timestamp")).alias("latest")).write.mode(
            "overwrite").parquet(f"{counts}/batch_id={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_LATE = "rows long, late_rows long, latest timestamp, batch_id long"


def late_counts(spark: SparkSession, counts: str) -> DataFrame:
    """What ``ingest_counting_late`` has counted so far, per batch."""
    return spark.read.schema(_LATE).parquet(counts)


def current_postings(spark: SparkSession, store: str, schema: T.StructType, keys: Sequence[str], stamp: str) -> DataFrame:
    """The last version per key of everything ingested."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(full).parquet(store)
    return first_per_key(rows, keys, [F.desc(stamp), F.desc("batch_id")]).drop("batch_id")


def first_versions(files: DataFrame, keys: Sequence[str], ts: str, lateness: str = "1 day") -> DataFrame:
    """X2, first version wins: duplicates within the watermark are dropped, state is bounded by it."""
    return files.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))
