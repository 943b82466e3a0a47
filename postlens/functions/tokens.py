"""Token arrays: splitting, filtering, normalising, requirement codes, tags."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from postlens import constants as K
from postlens.functions.lists import bind, literal_map
from postlens.functions.text import _col


def words(c, pattern: str = K.WORD_RUN) -> Column:
    """All runs of the word pattern in the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(f"({pattern})"), F.lit(1))


def filter_latin(c, pattern: str = K.LATIN_TOKEN) -> Column:
    """P8; null gives an empty array."""
    return F.coalesce(F.filter(_col(c), lambda t: t.rlike(pattern)), F.array().cast("array<string>"))


def normalize_token(t: Column) -> Column:
    """Lower case, '.' and spaces dropped."""
    return F.translate(F.lower(t), ". ", "")


def _any_of(tokens: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(n) for n in names]))


def degree_requirement(
    c,
    bachelor: Sequence[str] = K.BACHELOR_WORDS,
    school: Sequence[str] = K.SCHOOL_WORDS,
    graduate: Sequence[str] = K.GRADUATE_WORDS,
    higher: Sequence[str] = K.HIGHER_WORDS,
    reach: int = 10,
) -> Column:
    """1 bachelor, 2 master or doctor, 0 none.

    A school word counts when a graduate word follows within ``reach`` tokens. The nearest
    school word before each graduate word decides, so one pass that carries the distance
    since the last school word is enough, however long the text is.
    """
    tokens = F.filter(F.coalesce(_col(c), F.array().cast("array<string>")), lambda t: t.isNotNull())
    far = reach + 1

    def step(state, token):
        since = F.when(token.isin(list(school)), F.lit(0)).otherwise(F.least(state["since"] + 1, F.lit(far)))
        hit = state["hit"] | (token.isin(list(graduate)) & (state["since"] < reach))
        return F.struct(since.alias("since"), hit.alias("hit"))

    start = F.struct(F.lit(far).alias("since"), F.lit(False).alias("hit"))
    graduated = F.when(
        _any_of(tokens, school) & _any_of(tokens, graduate),
        F.aggregate(tokens, start, step, lambda s: s["hit"]),
    ).otherwise(F.lit(False))
    return (
        F.when(_any_of(tokens, bachelor) | graduated, 1)
        .when(_any_of(tokens, higher), 2)
        .otherwise(0)
    )


def language_requirement(c, codes: Mapping[str, int] = K.LANGUAGE_WORDS) -> Column:
    """P20: code of the first token found in the map, else null."""
    first = F.try_element_at(F.filter(_col(c), lambda t: t.isin(list(codes))), F.lit(1))
    return F.try_element_at(literal_map(codes), first)


def expand_multiword_tags(tokens, tags) -> Column:
    """L2: tokens with spaces become words; the first keeps B-, the rest turn to I-."""

    def spread(token, tag):
        inner = F.when(tag.startswith("B-"), F.concat(F.lit("I-"), F.substring(tag, 3, F.length(tag)))).otherwise(tag)
        # A token without inner blanks is kept as it is, even when it is empty.
        parts = F.filter(F.split(token, r"\s+"), lambda p: p != "")
        parts = F.when(F.size(parts) > 1, parts).otherwise(F.array(token))
        return F.transform(
            parts, lambda w, i: F.struct(w.alias("token"), F.when(i == 0, tag).otherwise(inner).alias("tag"))
        )

    return F.flatten(F.zip_with(_col(tokens), _col(tags), spread))


def encode_labels(c, ids: Mapping[str, int] = K.TAG_IDS) -> Column:
    """L4: tag to id, unknown tags as the outside tag."""
    table = literal_map(ids)
    return F.transform(_col(c), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(ids[K.OUTSIDE])))


def mask_subwords(pieces, labels, continuation: str = "##", ignored: int = K.IGNORED_LABEL) -> Column:
    """Each word's label on its first piece, ``ignored`` on the others.

    ``labels`` has one entry per word; the n-th piece that opens a word takes the n-th label.
    """
    pieces, labels, skip = _col(pieces), _col(labels), F.lit(ignored)
    places = F.transform(pieces, lambda p, i: F.when(~p.startswith(continuation), i))

    def spread(starts):
        def word(start, k):
            end = F.coalesce(F.get(starts, k + 1), F.size(pieces))
            return F.concat(F.array(F.coalesce(F.get(labels, k), skip)), F.array_repeat(skip, end - start - 1))

        before = F.array_repeat(skip, F.coalesce(F.get(starts, F.lit(0)), F.size(pieces)))
        return F.concat(before, F.flatten(F.transform(starts, word)))

    return bind(F.filter(places, lambda i: i.isNotNull()), spread)


def replicate_label(pieces, label) -> Column:
    """The label once per piece, joined by a space."""
    return F.array_join(F.array_repeat(_col(label), F.size(F.split(_col(pieces), " "))), " ")


def pad_labels(c, length: int, filler=0) -> Column:
    """Cut or fill to a fixed length."""
    return F.slice(F.concat(_col(c), F.array_repeat(F.lit(filler), length)), 1, length)
