"""Posting recommendation by text similarity and by vectors."""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens import constants as K
from postlens.functions.lists import bind, overlaps_list
from postlens.functions.text import matches_ignore_case
from postlens.operators import tfidf
from postlens.operators.joins import join_hot, optional_equality
from postlens.operators.nearest import nearest_items
from postlens.operators.sets import first_per_key
from postlens.session import saved_copy


def _term_counts(text: str, pattern: str, stop_words: Sequence[str]) -> Column:
    """Array of (term, tf) of a text, by counting runs of the sorted terms."""
    terms = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({pattern})"), F.lit(1))
    if stop_words:
        terms = F.filter(terms, lambda t: ~t.isin(list(stop_words)))

    def runs(ordered):
        first = F.transform(ordered, lambda t, i: F.when((i == 0) | (t != F.get(ordered, i - 1)), i))
        return bind(F.filter(first, lambda i: i.isNotNull()), lambda starts: F.transform(
            starts, lambda at, k: F.struct(
                F.get(ordered, at).alias("term"), (F.coalesce(F.get(starts, k + 1), F.size(ordered)) - at).alias("tf"))
        ))

    return bind(F.sort_array(terms), runs)


def recommend_postings_tfidf(
    postings: DataFrame, profiles: DataFrame, k: int = 10, stop_words: Sequence[str] = (),
    pattern: str = K.TERM_PATTERN, digits: int = 9, index: tfidf.TfidfIndex | None = None,
) -> DataFrame:
    """The k postings most like each profile by TF-IDF cosine over skill texts.

    ``postings`` has id and skills, ``profiles`` has profile_id and skills. The profile's own
    text counts as one more document, so n = postings + 1 and a profile's terms have a
    document frequency greater by one; posting norms start from the shared one and are
    corrected for the profile's terms. Only postings that share a term are scored; where they
    are fewer than k the lowest other ids follow with score 0. Scores are rounded to
    ``digits`` before ranking, so equal texts tie whatever order their sums were added in.

    There is one way for any number of profiles and terms, see ``tfidf``. Profiles with the same
    terms are worked out once, as are such postings. An index of the same postings,
    ``tfidf_index``, may be given to be used again.
    """
    index = index or tfidf_index(postings, stop_words, pattern)
    own = saved_copy(profiles.select("profile_id", F.sort_array(_term_counts("skills", pattern, stop_words)).alias("terms")), "profile-terms")
    texts = saved_copy(own.groupBy("terms").agg(F.min("profile_id").alias("profile_id"), F.count("*").alias("profiles")), "profile-texts")
    ranking = ["profile_id"], [F.desc("score"), F.asc("id")], k
    scores = tfidf.best_postings(index, tfidf.profile_weights(index, texts), k, digits)
    best = first_per_key(tfidf.with_copies(index, first_per_key(scores, *ranking), k), *ranking)

    # A profile with c < k scored ids needs k - c others: they are among the k lowest ids.
    lowest = postings.select("id").orderBy("id").limit(k).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    have = F.coalesce("_ids", F.array().cast(f"array<{postings.schema['id'].dataType.simpleString()}>"))
    fill = F.slice(F.array_except(lowest.scalar(), have), F.lit(1), F.greatest(F.lit(k) - F.size(have), F.lit(0)))
    # The k best rows per text come as one list; with the fillers behind it they are placed in it.
    lists = texts.join(
        best.groupBy("profile_id").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")).alias("_best")), "profile_id", "left"
    ).withColumn("_ids", F.transform("_best", lambda b: b["id"])).withColumn("_fill", fill)
    filler = F.transform("_fill", lambda i: F.struct(F.lit(-0.0).alias("minus"), i.alias("id")))
    ranked = F.sort_array(F.concat(F.coalesce("_best", F.slice(filler, 1, 0)), filler))
    lists = saved_copy(lists.select("terms", "profiles", ranked.alias("_ranked")), "profile-lists")
    return join_hot(own, lists, "terms", "profiles").select("profile_id", F.posexplode("_ranked").alias("place", "b")).select(
        "profile_id", F.col("b.id").alias("id"), (-F.col("b.minus")).alias("score"), (F.col("place") + 1).alias("place")
    )


def tfidf_index(postings: DataFrame, stop_words: Sequence[str] = (), pattern: str = K.TERM_PATTERN) -> tfidf.TfidfIndex:
    """The stored index of C1 for postings with id and skills."""
    return tfidf.build_index(postings.select("id", _term_counts("skills", pattern, stop_words).alias("terms")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays of equal length, in double precision."""
    def dot(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def filter_items(
    items: DataFrame, duty: str | None = None, career: int | None = None, degree: int | None = None,
    lists: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """The metadata filters of one request (P12, P15, P14); an absent parameter filters nothing."""
    if duty:
        items = items.filter(matches_ignore_case("duty", duty))
    items = optional_equality(items, career, degree)
    for column, values in (lists or {}).items():
        items = items.filter(overlaps_list(column, values))
    return items


def nearest_to_vector(items: DataFrame, vector: Sequence[float], k: int = 5, digits: int = 9) -> DataFrame:
    """C5 for one request: the k nearest of the (filtered) items; each partition keeps k rows."""
    query = F.array(*[F.lit(float(v)) for v in vector])
    return items.withColumn("score", F.round(cosine(F.col("embedding"), query), digits)).orderBy(
        F.desc("score"), "id"
    ).limit(k)


#: Least number of requests for which items are dealt out anew before they are compared.
REQUEST_BLOCK = 200


def filtered_vector_search(
    items: DataFrame, queries: DataFrame, condition: Callable[[Callable[[str], Column], Column], Column], k: int = 5, digits: int = 9,
    block: int = REQUEST_BLOCK,
) -> DataFrame:
    """C5 for many requests: the k nearest items among those that meet the request's filters.

    ``items`` has id, embedding and metadata; ``queries`` has query_id (unique), vector and its
    own metadata; ``condition(item, request)`` is a column over ``item("name")`` and
    ``request["name"]``, as ``matches_filters`` makes it. Requests are told to every task in
    passes, so no metadata value is a join key and none can be hot; filters and scores are worked
    out where the items lie, and each task keeps k rows per request before the only shuffle of
    hits, see ``nearest``. More than ``block`` requests are worth dealing the items to all cores.
    Vectors without a direction score null.
    """
    spread = items
    if queries.count() > block:
        spread = items.repartition(items.sparkSession.sparkContext.defaultParallelism)
    best = nearest_items(spread, queries, condition, k, digits)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("place", F.row_number().over(place))


def matches_filters(
    equal: Sequence[str] = (), contains: Sequence[str] = (), optional: Sequence[str] = (), overlap: Sequence[str] = (),
) -> Callable[[Callable[[str], Column], Column], Column]:
    """A condition for ``filtered_vector_search`` by metadata columns of the same name on both sides.

    ``equal``: the values are equal. ``contains``: the request's text, if any, is part of the
    item's, whatever the case. ``optional``: equal, or the request has null or 0. ``overlap``: the
    item's ', ' list shares a value with the request's array, or the request has none.
    """
    def condition(item, request):
        parts = [item(c) == request[c] for c in equal]
        parts += [(F.coalesce(request[c], F.lit("")) == "") | F.contains(F.lower(item(c)), F.lower(request[c])) for c in contains]
        parts += [(F.coalesce(request[c], F.lit(0)) == 0) | (item(c) == request[c]) for c in optional]
        parts += [(F.coalesce(F.size(request[c]), F.lit(0)) <= 0) | F.arrays_overlap(F.split(F.lower(item(c)), r"\s*,\s*"), F.transform(request[c], F.lower)) for c in overlap]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    return condition


def nearest_context_rows(hits: DataFrame, fields: dict[str, str], by: str = "query_id", place: str = "place") -> DataFrame:
    """Hits of a request as one text block; ``fields`` is label -> column, absent values as N/A."""
    lines = [
        F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit(K.NOT_AVAILABLE)))
        for label, c in fields.items()
    ]
    rows = hits.select(by, place, F.concat_ws("\n", *lines).alias("row"))
    return rows.groupBy(by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, "row"))), lambda r: r["row"]), "\n\n").alias("context")
    )
