"""Texts and a dictionary to a balanced, split table of labelled tokens."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from postlens.operators.joins import relabel_from_lookup
from postlens.operators.labels import oversample_to_largest, split_train_val_test
from postlens.operators.sets import drop_duplicate_rows, union_replace_subset
from postlens.operators.tokens import annotate_tokens


def labelled_tokens(
    texts: DataFrame, tokens: str, dictionary: DataFrame, relabels: DataFrame, subset: Column, replacement: DataFrame,
    order: Sequence[str] = ("languages", "frameworks", "libraries", "tools"), seed: int = 42,
) -> DataFrame:
    """E5 (L1, N9, U4, U5, L9, L8): rows token, label, copy and part.

    Tokens are annotated with the dictionary; a token left outside takes its label from
    ``relabels`` (token, new_label); rows that meet ``subset`` are replaced by ``replacement``
    (token, label); of equal rows one stays; every label is grown to the count of the largest
    one; and the rows are split 80 : 10 : 10.
    """
    tagged = annotate_tokens(texts, tokens, dictionary, order).select(F.explode(F.arrays_zip(F.col(tokens).alias("token"), F.col("tags").alias("label"))).alias("t"))
    # Equal rows are relabelled alike, so one of them is enough from here on.
    rows = relabel_from_lookup(drop_duplicate_rows(tagged.select("t.token", "t.label")), relabels, "token", "label").select("token", "label")
    unique = drop_duplicate_rows(union_replace_subset(rows, subset, replacement.select("token", "label")))
    grown = oversample_to_largest(unique.withColumn("_id", F.concat_ws("|", "label", "token")), "_id", "label", seed=seed)
    numbered = grown.withColumn("_row", F.concat_ws("|", "_id", F.col("copy").cast("string")))
    return split_train_val_test(numbered, "_row", seed=seed).select("token", "label", "copy", "part")
