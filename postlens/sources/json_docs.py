"""Raw postings: one JSON document per row in a text column."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postlens import constants as K, schemas
from postlens.functions.lists import ids_to_names, join_names
from postlens.functions.text import build_url, career_range, extract_region, upper_country, url_from_id

_ROOT_KEYS = "map<string,string>"


def _root_fields(text: Column, root: str) -> Column:
    """The fields of the root object as raw text, null when text or root is unusable."""
    return F.from_json(text, f"struct<{root}: {_ROOT_KEYS}>")[root]


def scan_raw_json_text(df: DataFrame, schema, text: str = "text") -> DataFrame:
    """The decoded document as ``doc`` beside its text; null where the text is no such JSON."""
    return df.withColumn("doc", F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"}))


def skip_bad_json(df: DataFrame, root: str, text: str = "text") -> DataFrame:
    """Keep rows whose text parses and has a non-empty root object."""
    return df.filter(F.coalesce(F.size(_root_fields(F.col(text), root)), F.lit(0)) > 0)


def json_fault(text: Column, root: str) -> Column:
    """Why a text is skipped: 'no text', 'not JSON', 'no root' or 'empty root'; null for a text that is kept."""
    kept = F.coalesce(F.size(_root_fields(text, root)), F.lit(0)) > 0
    return (
        F.when(kept, F.lit(None).cast("string")).when(F.coalesce(F.trim(text), F.lit("")) == "", "no text")
        .when(F.try_parse_json(text).isNull(), "not JSON").when(F.get_json_object(text, f"$.{root}").isNull(), "no root")
        .otherwise("empty root")
    )


def divert_bad_json(df: DataFrame, root: str, path: str, text: str = "text", reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """J3, S4 with a channel for bad rows: (kept rows, rejected rows with their ``reason``).

    Every row read is in one of the two. The rows are read once and stored under ``path``, the
    rejected ones in a folder of their own, so later jobs over either part read no other rows.
    """
    fault = json_fault(F.col(text), root)
    rows = df.select(F.struct(*df.columns).alias("row"), fault.alias("fault")).withColumn("rejected", F.col("fault").isNotNull())
    # Two open files a task; otherwise Spark would sort whole rows by the folder before it writes them.
    conf, writers = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(writers)
    conf.set(writers, str(max(2, int(before))))
    try:
        rows.write.partitionBy("rejected").parquet(path)
    finally:
        conf.set(writers, before)
    stored = df.sparkSession.read.schema(rows.schema).parquet(path)
    return stored.filter("not rejected").select("row.*"), stored.filter("rejected").select("row.*", F.col("fault").alias(reason))


def _decoded_roots(df: DataFrame, schema, root: str, text: str) -> DataFrame:
    """One ``p`` row per document with a non-empty root.

    The document is decoded inside a generator, so a filter on it cannot be pushed below
    and decode every text a second time.
    """
    names = schema[root].dataType.names
    decoded = F.array(F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})[root])
    usable = F.filter(decoded, lambda p: reduce(lambda x, y: x | y, [p[n].isNotNull() for n in names]))
    # The outer form: for the plain one Spark would add a test of the array below the generator.
    return df.select(F.col(text).alias("text"), F.explode_outer(usable).alias("p")).filter(F.col("p").isNotNull())


def flatten_posting_json_a(df: DataFrame, text: str = "text", crawling_dt: str | None = None) -> DataFrame:
    """J1 (with J3, J5, J6, J7): first feed's documents as posting columns, absent fields as ''."""
    rows = _decoded_roots(df, schemas.RAW_POSTING_A, "jobPosition", text)
    p = F.col("p")

    def field(name):
        return F.coalesce(p[name], F.lit("")).alias(name)

    return rows.select(
        "text",
        p["id"].alias("id"),
        F.concat(F.lit(K.FEED_A_URL), F.coalesce(p["url"], F.lit(""))).alias("url"),
        F.coalesce(p["career"], F.lit("")).alias("career_all"),
        field("title"),
        F.coalesce(p["address"], F.lit("")).alias("location"),
        F.coalesce(ids_to_names(p["jobCategoryIds"]), F.lit("")).alias("duty"),
        F.coalesce(join_names(p["technicalTags"]), F.lit("")).alias("technicalTags"),
        field("countryCode"),
        field("description"),
        field("requirement"),
        field("preferredExperience"),
        F.coalesce(p["company"]["name"], F.lit("")).alias("company_name"),
        F.lit(crawling_dt).cast("string").alias("crawling_dt"),
    )


def unknown_category_ids(df: DataFrame, text: str = "text", names=K.JOB_CATEGORY_NAMES) -> DataFrame:
    """(category_id, postings) of the ids that no name is known for and that J1 therefore leaves out."""
    ids = _decoded_roots(df, schemas.RAW_POSTING_A, "jobPosition", text).select(F.explode(F.array_distinct("p.jobCategoryIds")).alias("category_id"))
    unknown = ids.filter(~F.coalesce(F.col("category_id").isin(list(names)), F.lit(False)))
    return unknown.groupBy("category_id").agg(F.count("*").alias("postings"))


def with_career_and_region(df: DataFrame) -> DataFrame:
    """P6 and P7 on flattened rows of the first feed."""
    span = career_range("career_all")
    return (
        df.withColumn("career", span["career"])
        .withColumn("max_career", span["max_career"])
        .withColumn("location", extract_region("location"))
    )


def flatten_posting_json_b(df: DataFrame, text: str = "text", crawling_dt: str | None = None) -> DataFrame:
    """Second feed's documents as posting columns; empty tag lists give null."""
    rows = _decoded_roots(df, schemas.RAW_POSTING_B, "job", text)
    j = F.col("p")

    def tags(array):
        return F.when(F.size(array) > 0, join_names(array, "text"))

    return rows.select(
        "text",
        j["id"].alias("id"),
        url_from_id(j["id"]).alias("url"),
        j["detail"]["position"].alias("title"),
        j["address"]["location"].alias("location"),
        tags(j["category_tag"]["child_tags"]).alias("duty"),
        tags(j["skill_tags"]).alias("technicalTags"),
        upper_country(j["address"]["country_code"]).alias("countryCode"),
        j["company"]["name"].alias("company_name"),
        j["annual_from"].alias("career"),
        j["detail"]["main_tasks"].alias("description"),
        j["detail"]["requirements"].alias("requirement"),
        j["detail"]["preferred_points"].alias("preferredExperience"),
        F.lit(crawling_dt).cast("string").alias("crawling_dt"),
    )


def serving_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """J4 (with J5, J7): title, company, url, skills and deadline of every parsable document.

    A field that is absent gets its placeholder; a JSON null stays null, as does a
    document without the root, which keeps its row with placeholders only.
    """
    shape = f"struct<jobPosition: {_ROOT_KEYS}, _corrupt_record: string>"
    decoded = F.array(F.from_json(F.col(text), shape, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    readable = F.filter(decoded, lambda d: d.isNotNull() & d["_corrupt_record"].isNull())
    others = [c for c in df.columns if c != text]
    rows = df.select(*others, F.explode_outer(readable).alias("_doc")).filter(F.col("_doc").isNotNull()).select(
        *others, F.coalesce(F.col("_doc.jobPosition"), F.create_map().cast(_ROOT_KEYS)).alias("_p")
    )

    def raw(name):
        return F.try_element_at("_p", F.lit(name))

    def or_default(name, default):
        return F.when(F.map_contains_key("_p", F.lit(name)), raw(name)).otherwise(F.lit(default)).alias(
            "deadline" if name == "endAt" else name
        )

    company = F.from_json(raw("company"), "struct<name: string>")["name"]
    tags = F.from_json(raw("technicalTags"), "array<struct<name: string>>")
    return rows.select(
        *others,
        or_default("title", K.NO_TITLE),
        F.coalesce(company, F.lit(K.NO_COMPANY)).alias("company"),
        build_url(raw("url")).alias("url"),
        F.coalesce(join_names(tags, sep=" "), F.lit("")).alias("skills"),
        or_default("endAt", K.NO_DEADLINE),
    )
