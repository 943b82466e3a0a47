"""The corpus pipeline: documents in, packed token sequences out, in five stages.

Every stage takes any columns beside doc_id and text, whatever their names. Null and empty texts
pass as texts without words (near duplicates of one another), repeated rows are judged each by
itself but for the near-duplicate stage, where one row of a group stays, and a null doc_id comes
first or last as the operators state. An empty table stays empty.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.llm import decontaminate, linededup, packing, simhash, toxicity
from postlens.llm.common import read, stored
from postlens.llm.queries import TOXIC_FROM, toxicity_model


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows whose text scores as toxic are dropped; the model knows the labels that are not held out."""
    return toxicity.clean_documents(docs, toxicity_model(spark, sf_dir), TOXIC_FROM)


def repeated_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: later repeats of passages are cut out of the texts; every row stays."""
    cut = linededup.dedupe(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near duplicates the row with the smallest doc_id stays."""
    return simhash.one_of_each_group(docs)


def contaminated_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rows contaminated by the benchmark are dropped."""
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the pieces of all rows, packed."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line_dedup", repeated_passages_go),
    ("near_duplicates", near_duplicates_go),
    ("decontamination", contaminated_documents_go),
    ("packing", packed_sequences),
]

#: The tokenizer and the learned models can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
