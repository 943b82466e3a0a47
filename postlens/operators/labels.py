"""Labelled-token tables: splits, balancing, evaluation."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from postlens import constants as K
from postlens.functions.lists import literal_map
from postlens.operators.sets import hash_bucket, hash_positions
from postlens.session import broadcast_if_small, saved_copy


#: Copies that a row makes by itself.
COPY_CHUNK = 10_000


def split_train_val_test(
    df: DataFrame, key: str, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 200, out: str = "part"
) -> DataFrame:
    """Exact shares in a seeded hash order of the key, the same however the rows are partitioned.

    Whole hash buckets go to one part without any shuffle of the rows; only the buckets that
    hold a border are ranked.
    """
    bucket, digest = hash_bucket(F.col(key), seed)
    rows = df.withColumn("_bucket", bucket)
    # At most 65,536 bucket rows, whatever the size of the table, so one window over all is small.
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    so_far = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_n").over(Window.partitionBy())
    borders = (
        counts.withColumn("_end", F.sum("_n").over(so_far)).withColumn("_total", total)
        .withColumn("_train", F.bround(F.col("_total") * fractions[0]).cast("long"))
        .withColumn("_val", F.col("_train") + F.bround(
            (F.col("_total") - F.col("_train")) * (fractions[1] / (fractions[1] + fractions[2]))).cast("long"))
        .select("_bucket", (F.col("_end") - F.col("_n")).alias("_start"), "_end", "_train", "_val")
    )

    def part_of(first, last):
        return (
            F.when(last <= F.col("_train"), "train")
            .when((first >= F.col("_train")) & (last <= F.col("_val")), "val")
            .when(first >= F.col("_val"), "test")
        )

    # Bounded by the number of buckets, so it is sent to the rows, which stay where they are.
    placed = rows.join(F.broadcast(borders), "_bucket").withColumn(out, part_of(F.col("_start"), F.col("_end")))
    clear = placed.filter(F.col(out).isNotNull()).select(*df.columns, out)
    inside = Window.partitionBy("_bucket").orderBy(digest, key)
    mixed = placed.filter(F.col(out).isNull()).withColumn("_pos", F.col("_start") + F.row_number().over(inside) - 1)
    ranked = mixed.withColumn(out, part_of(F.col("_pos"), F.col("_pos") + 1)).select(*df.columns, out)
    return clear.unionByName(ranked)


def _with_copies(df: DataFrame, key: str, label: str, needs: DataFrame, seed: int) -> DataFrame:
    """Rows repeated so that label counts grow by ``need``, spread evenly in hash order.

    ``needs`` has the label, its row count ``_have`` and ``need``; each row gets
    need div have copies, the first need mod have rows one more. ``copy`` is 0 for the original.
    """
    few = broadcast_if_small(needs, "label_counts")
    placed = hash_positions(df.join(few, label), key, seed, by=[label])
    extra = (F.col("need") / F.col("_have")).cast("long") + F.when(F.col("pos") < F.col("need") % F.col("_have"), 1).otherwise(0)
    # Copies come in chunks that are dealt out before they are made: no row holds a long list of them.
    chunk = placed.withColumn("_extra", extra).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_extra"), F.lit(COPY_CHUNK).cast("long"))))
    spread = chunk.filter("_extra >= %d" % COPY_CHUNK).repartition(key, "_from").unionByName(chunk.filter("_extra < %d" % COPY_CHUNK))
    last = F.least(F.col("_from") + COPY_CHUNK - 1, F.col("_extra"))
    return spread.withColumn("copy", F.explode(F.sequence(F.col("_from"), last))).select(*df.columns, "copy")


def oversample_to_largest(df: DataFrame, key: str, label: str, new_rows: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Every label grown to the count of the largest one, then new rows appended."""
    counts = df.groupBy(label).agg(F.count("*").alias("_have"))
    largest = counts.agg(F.max("_have")).scalar()
    grown = _with_copies(df, key, label, counts.withColumn("need", largest - F.col("_have")), seed)
    if new_rows is None:
        return grown
    return grown.unionByName(new_rows.withColumn("copy", F.lit(0).cast("long")))


def fill_label_quota(df: DataFrame, source: DataFrame, key: str, label: str, valid: Sequence[str],
                     quotas: Mapping[str, int], seed: int = 42) -> DataFrame:
    """Rows with a valid label, plus rows drawn from ``source`` up to each label's quota.

    A label at or over its quota gets none.
    """
    kept = df.filter(F.col(label).isin(list(valid)))
    have = kept.groupBy(label).agg(F.count("*").alias("_kept"))
    pool = source.groupBy(label).agg(F.count("*").alias("_have"))
    quota = F.try_element_at(literal_map(dict(quotas)), F.col(label))
    needs = (
        pool.withColumn("quota", quota).filter(F.col("quota").isNotNull()).join(have, label, "left")
        .select(label, "_have", F.greatest(F.col("quota") - F.coalesce("_kept", F.lit(0)), F.lit(0)).alias("need"))
    )
    drawn = _with_copies(source, key, label, needs, seed).filter("copy > 0")
    return kept.withColumn("copy", F.lit(0).cast("long")).unionByName(drawn)


def label_to_category(df: DataFrame, label: str, categories: Mapping[str, str] = K.LABEL_CATEGORIES, out: str = "category") -> DataFrame:
    """Label to category, unknown labels dropped."""
    return df.withColumn(out, F.try_element_at(literal_map(categories), F.col(label))).filter(F.col(out).isNotNull())


BLOCK = 100_000


def _entities(tags: DataFrame, tag: str, block: int) -> DataFrame:
    """Entity chunks (seq, type, start, end) of BIO tags at consecutive positions.

    A sequence is worked in blocks of positions, each with a copy of its two neighbour rows,
    so one sequence that holds most tokens is still spread over tasks. An entity that crosses
    blocks takes its end from the first later block that has one.
    """
    at = F.floor(F.col("pos") / block)
    copies = F.array_distinct(F.array(at, F.floor((F.col("pos") - 1) / block), F.floor((F.col("pos") + 1) / block)))
    rows = tags.select("seq", "pos", F.col(tag).alias("tag"), at.alias("_home"), F.explode(copies).alias("_block"))
    near = Window.partitionBy("seq", "_block").orderBy("pos")
    outside = F.col("tag") == K.OUTSIDE
    kind = F.when(~outside, F.regexp_replace("tag", "^[^-]*-", ""))
    begins = ~outside & (
        F.col("tag").startswith("B-") | F.lag("type").over(near).isNull() | (F.lag("type").over(near) != F.col("type"))
    )
    marked = (
        rows.withColumn("type", kind).withColumn("begin", F.coalesce(begins, F.lit(False)))
        .withColumn("_next_type", F.lead("type").over(near)).withColumn("_next_begin", F.lead("begin").over(near))
        .filter(F.col("_block") == F.col("_home")).filter(F.col("type").isNotNull())
        .withColumn("last", F.col("_next_type").isNull() | F.col("_next_begin"))
    )
    following = Window.partitionBy("seq", "_block").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own_end = F.min(F.when(F.col("last"), F.col("pos"))).over(following)
    starts = marked.withColumn("end", own_end).filter("begin").select("seq", "_block", "type", F.col("pos").alias("start"), "end")
    ends = marked.filter("last").groupBy("seq", "_block").agg(F.min("pos").alias("_first_end"))
    blocks = marked.select("seq", "_block").distinct().join(ends, ["seq", "_block"], "left")
    later = Window.partitionBy("seq").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    carried = blocks.select("seq", "_block", F.min("_first_end").over(later).alias("_carried"))
    return starts.join(carried, ["seq", "_block"]).select(
        "seq", "type", "start", F.coalesce("end", "_carried").alias("end")
    )


def entity_report(tags: DataFrame, gold: str = "gold", predicted: str = "predicted", block: int = BLOCK) -> DataFrame:
    """Precision, recall, F1 and support per entity type, then micro, macro and weighted averages.

    ``tags`` has seq, pos (consecutive integers within the sequence) and the two tag columns.
    Divisions by zero give 0.
    """
    keys = ["seq", "type", "start", "end"]
    true = _entities(tags, gold, block).withColumn("g", F.lit(1))
    found = _entities(tags, predicted, block).withColumn("p", F.lit(1))
    matched = true.join(found, keys, "full_outer").fillna(0, ["g", "p"])
    # A row per entity type, written once: four results are made from it.
    per_type = saved_copy(matched.groupBy("type").agg(
        F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("p").alias("pred"), F.sum("g").alias("support")
    ), "entity_counts")

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    def scored(df):
        precision, recall = ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("support"))
        df = df.withColumn("precision", precision).withColumn("recall", recall)
        f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
        return df.withColumn("f1", f1)

    scores = scored(per_type)
    columns = ["label", "precision", "recall", "f1", "support"]
    micro = scored(per_type.agg(F.sum("tp").alias("tp"), F.sum("pred").alias("pred"), F.sum("support").alias("support")))
    macro = scores.agg(*[F.avg(c).alias(c) for c in columns[1:4]], F.sum("support").alias("support"))
    total = F.sum("support")
    weighted = scores.agg(
        *[ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in columns[1:4]], total.alias("support")
    )
    out = scores.withColumn("label", F.col("type")).select(*columns)
    for name, frame in (("micro avg", micro), ("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(frame.withColumn("label", F.lit(name)).select(*columns))
    return out


def masked_token_accuracy(df: DataFrame, batch: str, label: str, predicted: str, ignored: int = K.IGNORED_LABEL) -> DataFrame:
    """Share of equal labels outside the ignored ones per batch, then the mean over batches."""
    hit = (F.col(label) == F.col(predicted)).cast("double")
    per_batch = df.filter(F.col(label) != ignored).groupBy(batch).agg(F.avg(hit).alias("accuracy"))
    return per_batch.agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("batches"))
