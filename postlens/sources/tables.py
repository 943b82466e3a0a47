"""Tables and delimited files."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Delimited file with header; quoted cells may hold commas, quotes and newlines.

    The reader drops a UTF-8 byte order mark itself. With ``multi_line`` cells may hold line
    breaks, and each file is one task; without it Spark splits large files.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", True)
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss")
        .csv(path)
    )


def write_csv_table(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Chosen columns with a header, one file per partition.

    Null and empty cells both come back as null.
    """
    out = df.select(*columns) if columns else df
    (
        out.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss")
        .csv(path)
    )


def write_list_columns(df: DataFrame, path: str, id_column: str, list_columns: Sequence[str], sep: str = ", ") -> None:
    """One row per id, arrays as joined cells."""
    write_csv_table(
        df.select(id_column, *[F.coalesce(F.array_join(c, sep), F.lit("")).alias(c) for c in list_columns]), path
    )


def scan_tables(spark: SparkSession, folder: str, names: Sequence[str], register: bool = True) -> dict[str, DataFrame]:
    """S3: parquet tables of a folder by name, registered as temporary views."""
    frames = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}
    if register:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
    return frames


def scan_database_table(
    spark: SparkSession, url: str, table: str, partition_column: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str,
) -> DataFrame:
    """S3: a database table (or ``(query) alias``) through JDBC, split on a numeric column if given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]), numPartitions=str(partitions),
        )
    return reader.load()


def drop_columns_if_present(df: DataFrame, *columns: str) -> DataFrame:
    """P4"""
    return df.drop(*columns)
