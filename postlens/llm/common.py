"""What several operators share: tables, row keys, Arrow batches, connected components."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlens.session import ARROW_BYTES, bounded_batches, job_folder, saved_copy, shared_folder, ship_package

#: Rows with a null id take this one's place in joins and orders.
NO_ID = -(1 << 63)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of an Arrow batch where what a task does with a row doesn't depend on the others. A batch stands in the JVM
#: (twice while its buffer grows) and in Python, on the way there and back, so it counts several times a task.
ROW_BATCH_BYTES = 2 << 20


def prepare(df: DataFrame, batch_bytes: int = ARROW_BYTES) -> SparkSession:
    """The frame's session, with the package on its workers, a shared folder at hand and Arrow batches of bounded size."""
    spark = df.sparkSession
    ship_package(spark)
    shared_folder(spark)
    bounded_batches(spark, batch_bytes)
    return spark


def stored(df: DataFrame, label: str) -> DataFrame:
    return saved_copy(df, label)


def forget(copy: DataFrame) -> None:
    """Delete a stored copy that nothing reads any more; what isn't plainly in the job's folder stays."""
    files, jvm = copy.inputFiles(), copy.sparkSession.sparkContext._jvm
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        system = folder.getFileSystem(copy.sparkSession.sparkContext._jsc.hadoopConfiguration())
        job = system.makeQualified(jvm.org.apache.hadoop.fs.Path(job_folder(copy.sparkSession)))
        if folder.getParent().equals(job):
            system.delete(folder, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    It does so when the driver's collector finds that no plan holds them, which on a large heap may
    be long after the last reader; a job of several large steps would pile them up until then.
    """
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, to keep what a task holds small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def components(edges: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """(node, root): the smallest node of each connected component of an undirected edge list.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each one a grouped
    minimum and an equi-join, written to the shared folder; rounds grow with the logarithm of
    the longest chain. Nodes without an edge to another node are absent.
    """
    def star(pairs: DataFrame) -> DataFrame:
        """Large star: each larger neighbour of u goes to the smallest of u and its neighbours."""
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return (
            both.filter("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        )

    def small(pairs: DataFrame) -> DataFrame:
        """Small star: u and its smaller neighbours go to the smallest of them."""
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        moved = pairs.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(low.select("u", F.col("m").alias("v"))).distinct()

    u, v = F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")
    now = stored(edges.filter(F.col(a) != F.col(b)).select(u, v).distinct(), label)
    last = None
    while True:
        now = stored(small(star(now)), label)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
