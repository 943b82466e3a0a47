"""X: streams. Each query writes its table as stream files, runs the stream to its end and returns the result."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import table
from postlens.session import scratch_path
from postlens.streaming import ingest, interest

KINDS = ("click", "view", "error")


def stream_files(df, label):
    """The frame as parquet files with a streaming reader on them."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query("x01_interest_over_time", """
WITH e AS (SELECT * FROM events WHERE ts >= (SELECT max(ts)::DATE - INTERVAL 12 MONTHS FROM events) AND event_type IN ('click', 'view', 'error')),
w AS (SELECT time_bucket(INTERVAL 7 DAYS, ts) AS b, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view,
  count(*) FILTER (event_type = 'error') AS error FROM e GROUP BY 1),
m AS (SELECT max(greatest(click, view, error)) AS peak FROM w)
SELECT strftime(b, '%Y-%m-%d') AS bucket, CAST(round(click * 100.0 / peak) AS INTEGER) AS click, CAST(round(view * 100.0 / peak) AS INTEGER) AS view,
  CAST(round(error * 100.0 / peak) AS INTEGER) AS error FROM w, m""")
def _(spark, folder):
    series = interest.interest_over_time(table(spark, folder, "events"), "ts", "event_type", KINDS)
    return series.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("x01_interest_over_time_stream", """
SELECT strftime(time_bucket(INTERVAL 7 DAYS, ts), '%Y-%m-%d') AS bucket, event_type AS keyword, count(*) AS mentions FROM events GROUP BY 1, 2""")
def _(spark, folder):
    """Update mode into a keyed store: every bucket, the open one included."""
    source = stream_files(table(spark, folder, "events").select("ts", "event_type").repartitionByRange(8, "ts").sortWithinPartitions("ts"), "events")
    # One file at a time would follow event time; here all files come at once, so allow for the whole span.
    counts = interest.stream_keyword_counts(source, "ts", "event_type", lateness="400 days")
    store, checkpoint = scratch_path(spark, "interest"), scratch_path(spark, "interest-state")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")

    run = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(store)
    last = rows.groupBy("bucket", "keyword").agg(F.max_by("mentions", "batch_id").alias("mentions"))
    return last.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("x02_ingest_postings_stream", """
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type""")
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    keys = ["user_id", "event_type"]
    store = scratch_path(spark, "postings")
    ingest.ingest_postings(stream_files(events.repartition(12, "event_id"), "crawl"), store, scratch_path(spark, "crawl-state"), keys, "event_id").awaitTermination()
    return ingest.current_postings(spark, store, events.schema, keys, "event_id")


@query("x02_first_versions_stream", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "value")
    again = events.withColumn("value", F.col("value") + 1)
    source = stream_files(events.unionByName(again).repartition(4), "twice")
    store = scratch_path(spark, "firsts")
    run = (
        ingest.first_versions(source, ["event_id"], "ts", "400 days").writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", scratch_path(spark, "firsts-state")).trigger(availableNow=True).start(store)
    )
    run.awaitTermination()
    return spark.read.parquet(store).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("x02_late_rows", """
WITH e AS (SELECT *, max(ts) OVER () AS latest FROM events)
SELECT count(*) FILTER (ts < latest - INTERVAL 5 DAYS) AS rows, count(*) FILTER (ts < latest - INTERVAL 10 DAYS) AS late_rows FROM e""")
def _(spark, folder):
    """The newest days come first; what follows is older, and part of it older than the allowed lateness."""
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    border = events.agg(F.max("ts") - F.expr("INTERVAL 5 DAYS")).scalar()
    crawl, store, counts, state = (scratch_path(spark, n) for n in ("late-crawl", "late-store", "late-counts", "late-state"))
    for part in (F.col("ts") >= border, F.col("ts") < border):
        events.filter(part).write.mode("append").parquet(crawl)
        source = spark.readStream.schema(events.schema).parquet(crawl)
        ingest.ingest_counting_late(source, store, counts, state, ["event_id"], "ts", "10 DAYS").awaitTermination()
    return ingest.late_counts(spark, counts).filter("batch_id > 0").agg(F.sum("rows").alias("rows"), F.sum("late_rows").alias("late_rows"))
