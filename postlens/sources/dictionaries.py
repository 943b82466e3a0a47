"""Term dictionaries: term lists, synonym documents, synonym tables.

Dictionaries are DataFrames throughout. Whether one is broadcast is left to Spark, which
knows its size when the join runs.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlens import constants as K, schemas
from postlens.functions.text import spaced_variant


def term_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """One term per line, '.' dropped, lower case."""
    return lines.select(F.lower(F.replace(F.col(column), F.lit("."), F.lit(""))).alias("term"))


def scan_term_list(spark: SparkSession, path: str) -> DataFrame:
    """S5 from a text file."""
    return term_list(spark.read.text(path))


def flatten_synonym_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Category, canonical, position and synonym rows of nested documents."""
    doc = F.from_json(F.col(column), schemas.SYNONYM_DOCUMENT)
    return (
        df.select(F.explode(doc).alias("category", "names"))
        .select("category", F.explode("names").alias("canonical", "synonyms"))
        .select("category", "canonical", F.posexplode("synonyms").alias("pos", "synonym"))
    )


def scan_synonym_json(spark: SparkSession, path: str) -> DataFrame:
    """S6 from a file that is one document."""
    return flatten_synonym_json(spark.read.text(path, wholetext=True))


def synonym_json(rows: DataFrame) -> DataFrame:
    """Synonym rows folded back into one document per category, as (category, value)."""
    lists = rows.groupBy("category", "canonical").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "synonym"))), lambda s: s["synonym"]).alias("synonyms")
    )
    names = lists.groupBy("category").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("canonical", "synonyms")))).alias("names")
    )
    return names.select("category", F.to_json(F.create_map("category", "names")).alias("value"))


def build_synonym_dictionary(elements: DataFrame, seq: str = "seq") -> DataFrame:
    """H5: (category, name, comma list of synonyms) to category, key, name rows.

    A name is its own key, 'language' becomes 'it_language', and of equal keys in a
    category the one written last (row, then position) stays.
    """
    category = F.when(F.lower(F.trim("category")) == "language", "it_language").otherwise(F.col("category"))
    base = elements.select(F.col(seq).alias("seq"), category.alias("category"), "name", "synonym")
    keys = base.select(
        "seq", "category", "name",
        F.posexplode(F.concat(F.array("name"), F.coalesce(F.split("synonym", ","), F.array().cast("array<string>")))).alias("pos", "key"),
    )
    last = Window.partitionBy("category", "key").orderBy(F.desc("seq"), F.desc("pos"))
    return keys.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("category", "key", "name")


def replacement_map(elements: DataFrame, seq: str = "seq") -> DataFrame:
    """H5: lower-case synonym to lower-case trimmed name over all categories, last one stays."""
    keys = elements.select(
        F.col(seq).alias("seq"), F.lower(F.trim("name")).alias("value"),
        F.posexplode(F.split(F.lower("synonym"), ",")).alias("pos", "key"),
    )
    last = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("pos"))
    return keys.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("key", "value")


def spaced_synonyms(terms: DataFrame, term: str = "term") -> DataFrame:
    """Terms with a known suffix and their spaced variant."""
    return terms.withColumn("variant", spaced_variant(term)).filter(F.col("variant").isNotNull())


def merge_synonym_dictionaries(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Extra (category, canonical, synonym) rows appended after the list of an existing name.

    ``base`` has rows category, canonical, pos, synonym; an extra row whose category or name
    is unknown is ignored, a synonym already present is appended again.
    """
    keys = ["category", "canonical"]
    ends = base.groupBy(*keys).agg((F.max("pos") + 1).alias("next_pos"))
    order = Window.partitionBy(*keys).orderBy("synonym")
    added = extra.join(ends, keys).select(
        *keys, (F.col("next_pos") + F.row_number().over(order) - 1).cast("int").alias("pos"), "synonym"
    )
    return base.select(*keys, "pos", "synonym").unionByName(added)


def category_names(elements: DataFrame, category: str = "category", name: str = "name") -> DataFrame:
    """H11 as rows: category, place from 0 and name, the distinct trimmed names in order."""
    names = elements.select(F.col(category).alias("category"), F.trim(name).alias("name")).filter("name is not null").distinct()
    place = F.row_number().over(Window.partitionBy("category").orderBy("name")) - 1
    return names.select("category", place.alias("pos"), "name")


def dictionary_by_category(elements: DataFrame, category: str = "category", name: str = "name") -> DataFrame:
    """Per category the sorted distinct trimmed names in one array, for small dictionaries."""
    return elements.groupBy(category).agg(F.sort_array(F.collect_set(F.trim(name))).alias("names"))


def normalized_dictionary(dictionary: DataFrame) -> DataFrame:
    """Dictionary keys in the form of normalised tokens (no '.' and no spaces)."""
    from postlens.functions.tokens import normalize_token

    order = Window.partitionBy("category", "key").orderBy("name")
    return (
        dictionary.withColumn("key", normalize_token(F.col("key")))
        .withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
    )


def duty_weights(spark: SparkSession, weights=K.DUTY_WEIGHTS) -> DataFrame:
    """Weight of each category for each duty."""
    rows = [(duty, category, float(w)) for duty, ws in weights.items() for category, w in zip(K.CATEGORIES, ws)]
    return spark.createDataFrame(rows, schemas.DUTY_WEIGHTS)
