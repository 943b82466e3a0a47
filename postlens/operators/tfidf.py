"""C1's engine: blocks of postings with the greatest impact of each term, top-k with bounds.

Postings are stored in blocks, each an inverted list of its own: for every term of the block the
postings with it, and the greatest share that the term has in any posting's vector. The sum of
these over a profile's terms bounds the profile's cosine with every posting of the block, so a
block is worked out only for profiles that it can still give a better posting. A hot term is an
entry in each block; its postings never meet its profiles in a join.

Postings with the same terms are one entry, under the lowest of their ids, so the blocks grow with
the different texts. A posting outside the k best entries of a profile, by score and lowest id, has k
others before it; the copies of those k are all that ``with_copies`` has to look up.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from postlens.operators.joins import join_hot
from postlens.operators.sets import first_per_key
from postlens.session import saved_copy, ship_package

#: Postings of a block.
BLOCK_ROWS = 256
#: Term weights of the profiles that are looked up in one pass over the blocks, about.
PASS_ENTRIES = 500_000
#: Profiles that a block is worked out for at once.
CHUNK = 512
#: Slack of a bound, beyond the rounding of scores.
SLACK = 1e-8


@dataclass
class TfidfIndex:
    """``blocks`` (ids, norm2, terms, idf, idf_own, greatest, at, doc, tf), a row for each block: its postings and
    their squared norms, its terms with their weights and greatest impact, and the entries (place of the term in
    ``terms``, place of the posting in ``ids``, tf). ``idf`` (term, idf, idf_own); ``n`` documents and one.
    ``docs`` (id, terms): all postings, of which those with equal terms are the one with the lowest id in the blocks."""

    blocks: DataFrame
    idf: DataFrame
    n: float
    docs: DataFrame


def build_index(docs: DataFrame) -> TfidfIndex:
    """``docs`` has id and terms, an array of (term, tf). The profile's own text counts as one more document."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = saved_copy(docs.select("id", F.sort_array("terms").alias("terms")), "posting-terms")
    texts = saved_copy(docs.groupBy("terms").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "posting-texts")
    entries = texts.select("id", "copies", F.inline("terms"))
    frequency = saved_copy(entries.groupBy("term").agg(F.sum("copies").alias("df"), F.count("*").alias("texts")), "vocabulary")
    n = docs.count() + 2.0
    idf = frequency.select("term", "texts", (F.log(n / (F.col("df") + 1)) + 1).alias("idf"), (F.log(n / (F.col("df") + 2)) + 1).alias("idf_own"))
    idf = saved_copy(idf, "idf")
    sized = join_hot(entries.drop("copies"), idf, "term", "texts")
    rows = sized.groupBy("id").agg(
        F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("norm2"), F.sum(F.pow(F.col("tf") * F.col("idf_own"), 2)).alias("floor2"),
        F.collect_list(F.struct("term", "tf", "idf", "idf_own")).alias("terms"),
    )
    kind = docs.schema["id"].dataType.simpleString()
    schema = (
        f"ids array<{kind}>, norm2 array<double>, terms array<string>, idf array<double>, idf_own array<double>, "
        "greatest array<double>, at array<int>, doc array<int>, tf array<int>"
    )

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                place: dict[str, int] = {}
                idf, own, greatest, at, doc, tf = [], [], [], [], [], []
                for k, (floor2, terms) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    for t in terms:
                        j = place.setdefault(t["term"], len(place))
                        if j == len(idf):
                            idf.append(t["idf"])
                            own.append(t["idf_own"])
                            greatest.append(0.0)
                        # idf_own is 0 or more but for a term of every document; its bound is its size
                        greatest[j] = max(greatest[j], t["tf"] * abs(t["idf_own"]) / max(floor2, 1e-300) ** 0.5)
                        at.append(j)
                        doc.append(k)
                        tf.append(t["tf"])
                columns = [part.column(0), part.column(1)]
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in columns]
                lists += [pa.array([v], pa.list_(t)) for v, t in (
                    (list(place), pa.string()), (idf, pa.float64()), (own, pa.float64()), (greatest, pa.float64()),
                    (at, pa.int32()), (doc, pa.int32()), (tf, pa.int32()))]
                yield pa.RecordBatch.from_arrays(lists, names=["ids", "norm2", "terms", "idf", "idf_own", "greatest", "at", "doc", "tf"])

    blocks = rows.select("id", "norm2", "floor2", "terms").mapInArrow(blocked, schema)
    return TfidfIndex(saved_copy(blocks, "posting-blocks"), idf.select("term", "idf", "idf_own"), n, docs)


class _Profiles:
    """The profiles of one pass, by term: which of them have it and with what weight."""

    def __init__(self, terms: list[list[str]], weights: list[list[float]]):
        names = sorted(set().union(*terms)) if terms else []
        self.place = {t: k for k, t in enumerate(names)}
        term = np.array([self.place[t] for own in terms for t in own], np.int64)
        order = np.argsort(term, kind="stable")
        self.profile = np.repeat(np.arange(len(terms)), [len(own) for own in terms])[order]
        self.weight = np.array([w for own in weights for w in own], float)[order]
        self.start = np.searchsorted(term[order], np.arange(len(names) + 1))
        self.count = len(terms)


class _Best:
    """The k best (score, id) of each profile so far: higher scores, then lower ids."""

    def __init__(self, profiles: int, k: int, ids: np.dtype):
        self.score = np.full((profiles, k), -np.inf)
        self.id = np.zeros((profiles, k), ids)
        self.k = k

    def add(self, profiles: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: a line for each of the profiles, a column for each id; -inf for none."""
        some = (scores >= self.score[profiles, -1][:, None]) & np.isfinite(scores)
        change = some.any(axis=1)
        profiles, scores = profiles[change], np.where(some, scores, -np.inf)[change]
        if not len(profiles):
            return
        all_scores = np.concatenate((self.score[profiles], scores), axis=1)
        all_ids = np.concatenate((self.id[profiles], np.broadcast_to(ids, scores.shape)), axis=1)
        if self.id.dtype == object:  # numpy has no order for them
            every = range(all_scores.shape[1])
            order = np.array([sorted(every, key=lambda j: (-s[j], i[j] if s[j] > -np.inf else ""))[: self.k] for s, i in zip(all_scores, all_ids)])
        else:
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.score[profiles] = np.take_along_axis(all_scores, order, 1)
        self.id[profiles] = np.take_along_axis(all_ids, order, 1)


def _meet(profiles: _Profiles, best: _Best, block: dict, digits: int) -> None:
    """One block for all profiles whose bound reaches their k-th score."""
    terms = [(j, profiles.place[t]) for j, t in enumerate(block["terms"]) if t in profiles.place]
    if not terms:
        return
    local, known = (np.array(x, np.int64) for x in zip(*terms))
    size = profiles.start[known + 1] - profiles.start[known]
    entry = np.repeat(profiles.start[known] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    line = np.repeat(np.arange(len(known)), size)  # place among the block's wanted terms
    who, weight = profiles.profile[entry], profiles.weight[entry]
    greatest = np.array(block["greatest"])[local]
    bound = np.bincount(who, weight * greatest[line], minlength=profiles.count)
    wanted = np.flatnonzero((bound > 0) & (bound + SLACK >= best.score[:, -1]))
    if not len(wanted):
        return

    column = np.full(len(block["terms"]), -1, np.int64)
    column[local] = np.arange(len(local))
    at, doc, tf = (np.array(block[c], np.int64) for c in ("at", "doc", "tf"))
    some = column[at] >= 0
    at, doc, tf = at[some], doc[some], tf[some]
    idf, own = np.array(block["idf"]), np.array(block["idf_own"])
    part, shift = np.zeros((len(block["ids"]), len(local))), np.zeros((len(block["ids"]), len(local)))
    part[doc, column[at]] = tf * own[at]
    shift[doc, column[at]] = (tf * own[at]) ** 2 - (tf * idf[at]) ** 2
    ids, norm2 = np.array(block["ids"], best.id.dtype), np.array(block["norm2"])
    number = np.full(profiles.count, -1, np.int64)
    for first in range(0, len(wanted), CHUNK):
        chunk = wanted[first : first + CHUNK]
        number[chunk] = np.arange(len(chunk))
        mine = number[who] >= 0
        weights = np.zeros((len(local), len(chunk)))
        weights[line[mine], number[who[mine]]] = weight[mine]
        number[chunk] = -1
        dot = part @ weights
        length = norm2[:, None] + shift @ (weights > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(dot > 0, np.round(dot / np.sqrt(length), digits), -np.inf)
        best.add(chunk, ids, score.T)


def best_postings(index: TfidfIndex, weights: DataFrame, k: int, digits: int) -> DataFrame:
    """(profile_id, id, score): at least the ``k`` best entries of each profile, of each part of the blocks.

    ``weights`` has profile_id, term and weight, whose squares sum to 1. Profiles go in passes of
    about ``PASS_ENTRIES`` weights; a pass tells them to every task and reads the blocks once.
    """
    spark = weights.sparkSession
    by_profile = saved_copy(weights.groupBy("profile_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")), "profiles")
    entries = by_profile.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    passes = -(-entries // PASS_ENTRIES)
    kind, who = index.blocks.schema["ids"].dataType.elementType.simpleString(), by_profile.schema["profile_id"].dataType.simpleString()
    name_type = to_arrow_type(by_profile.schema["profile_id"].dataType)
    out = spark.createDataFrame([], f"profile_id {who}, id {kind}, score double")
    for number in range(passes):
        rows = by_profile.filter(F.pmod(F.xxhash64("profile_id"), F.lit(passes)) == number).collect()
        names = [r["profile_id"] for r in rows]
        shared = spark.sparkContext.broadcast((names, _Profiles([r["terms"] for r in rows], [r["weights"] for r in rows])))  # PASS_ENTRIES weights

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, profiles = shared.value
            best, ids = None, None
            for batch in batches:
                ids = batch.schema.field("ids").type.value_type
                best = best or _Best(profiles.count, k, np.dtype("i8") if pa.types.is_integer(ids) else np.dtype("O"))
                for block in batch.to_pylist():
                    _meet(profiles, best, block, digits)
            if best is not None:
                line, place = np.nonzero(np.isfinite(best.score))
                columns = [pa.array([names[p] for p in line], name_type), pa.array(best.id[line, place].tolist(), ids), pa.array(best.score[line, place])]
                yield pa.RecordBatch.from_arrays(columns, names=["profile_id", "id", "score"])

        out = out.unionByName(saved_copy(index.blocks.mapInArrow(scored, f"profile_id {who}, id {kind}, score double"), "best-postings"))
    return out


def with_copies(index: TfidfIndex, best: DataFrame, k: int) -> DataFrame:
    """(profile_id, id, score) of entries as the postings that they stand for, of each the ``k`` lowest ids."""
    copies = first_per_key(index.docs, ["terms"], [F.asc("id")], k)  # k of each text in a partition are shuffled
    named = copies.select(F.min("id").over(Window.partitionBy("terms")).alias("_entry"), "id")
    return best.withColumnRenamed("id", "_entry").join(named, "_entry").select("profile_id", "id", "score")


def profile_weights(index: TfidfIndex, profiles: DataFrame) -> DataFrame:
    """(profile_id, term, weight) of ``profiles`` (profile_id and terms, an array of (term, tf)), of length 1."""
    wanted = profiles.select("profile_id", F.inline("terms"))
    own = wanted.join(index.idf.select("term", "idf_own"), "term", "left").withColumn("_w", F.col("tf") * F.coalesce("idf_own", F.log(F.lit(index.n) / 2) + 1))
    norms = own.groupBy("profile_id").agg(F.sqrt(F.sum(F.pow("_w", F.lit(2)))).alias("_n"))
    return saved_copy(own.join(norms, "profile_id").select("profile_id", "term", (F.col("_w") / F.col("_n")).alias("weight")), "weights")
