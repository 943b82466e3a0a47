"""Mentions per keyword and time bucket, batch and streaming."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T


def keyword_counts(events: DataFrame, ts: str, keyword: str, width: str = "7 days", offset: str = "4 days") -> DataFrame:
    """Rows per bucket and keyword; works on batch and streaming frames.

    The default offset starts weekly buckets on Mondays.
    """
    bucket = F.window(F.col(ts), width, startTime=offset)
    return events.groupBy(bucket.alias("bucket"), F.col(keyword).alias("keyword")).agg(F.count("*").alias("mentions")).select(
        F.col("bucket.start").alias("bucket"), "keyword", "mentions"
    )


def interest_over_time(
    events: DataFrame, ts: str, keyword: str, keywords: Sequence[str], width: str = "7 days",
    offset: str = "4 days", months: int = 12,
) -> DataFrame:
    """X1, batch: one row per bucket with a column per keyword, scaled so that the peak is 100.

    Only the last ``months`` before the newest row count.
    """
    newest = events.agg(F.add_months(F.max(ts), -months)).scalar()
    recent = events.filter(F.col(keyword).isin(list(keywords)) & (F.col(ts) >= newest))
    counts = keyword_counts(recent, ts, keyword, width, offset)
    wide = counts.groupBy("bucket").agg(
        *[F.coalesce(F.sum(F.when(F.col("keyword") == k, F.col("mentions"))), F.lit(0)).alias(k) for k in keywords]
    )
    peak = wide.agg(F.max(F.greatest(*[F.col(k) for k in keywords]) if len(keywords) > 1 else F.col(keywords[0]))).scalar()
    return wide.select("bucket", *[F.round(F.col(k) * F.lit(100.0) / peak, 0).cast("int").alias(k) for k in keywords])


def stream_keyword_counts(events: DataFrame, ts: str, keyword: str, lateness: str = "1 day",
                          width: str = "7 days", offset: str = "4 days") -> DataFrame:
    """X1, streaming: the watermark bounds the state to the open buckets.

    Write it in update mode to include the open bucket, in append mode for closed ones only.
    A watermark needs instants; times without a zone are taken as UTC on the way in and given
    back without a zone, so buckets begin at the same clock time in every session.
    """
    zone = F.current_timezone()
    zoneless = events.schema[ts].dataType == T.TimestampNTZType()
    if zoneless:
        events = events.withColumn(ts, F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    counts = keyword_counts(events.withWatermark(ts, lateness), ts, keyword, width, offset)
    if zoneless:
        counts = counts.withColumn("bucket", F.to_utc_timestamp("bucket", zone).cast("timestamp_ntz"))
    return counts
