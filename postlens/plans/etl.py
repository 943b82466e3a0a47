"""Raw documents to the categorised posting table."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from postlens import constants as K
from postlens.functions.lookup import Dictionary
from postlens.functions.html import html_sections, strip_html
from postlens.functions.text import combined_text
from postlens.functions.tokens import degree_requirement, filter_latin, language_requirement
from postlens.operators.joins import drop_incomplete_rows
from postlens.operators.sets import drop_duplicate_rows, union_missing_columns
from postlens.operators.tokens import (
    Phrases, category_entries, classify_tokens_multi, dictionary_tokenize, normalize_multivalue, replace_tokens, reverse_synonyms,
)
from postlens.sources.dictionaries import (
    build_synonym_dictionary, normalized_dictionary, replacement_map,
)
from postlens.sources.json_docs import flatten_posting_json_a, flatten_posting_json_b, with_career_and_region

SECTIONS = ["description", "requirement", "preferredExperience"]


def clean_feed_a(rows: DataFrame) -> DataFrame:
    """Sections read out of the HTML description; what is missing there comes from the own fields.

    The section texts belong to the same row, so no join is needed to bring them back.
    """
    parsed = rows.withColumn("_sections", html_sections("description"))
    filled = {c: F.coalesce(F.nullif(F.col("_sections")[c], F.lit("")), F.col(c)) for c in SECTIONS}
    clean = parsed.withColumns(filled).drop("_sections")
    clean = clean.withColumns({c: strip_html(c) for c in SECTIONS})
    return drop_incomplete_rows(clean, ["requirement", "preferredExperience"]).drop("career_all", "max_career")


def postings_from_feeds(feed_a: DataFrame, feed_b: DataFrame, duties: DataFrame, crawling_dt: str | None = None) -> DataFrame:
    """Both feeds' documents (``text``) to one posting table with canonical duties."""
    # A flattened row keeps its text, so equal rows are equal texts: drop them before the work.
    a = clean_feed_a(with_career_and_region(flatten_posting_json_a(drop_duplicate_rows(feed_a.select("text")), crawling_dt=crawling_dt)))
    b = flatten_posting_json_b(drop_duplicate_rows(feed_b.select("text")), crawling_dt=crawling_dt)
    both = union_missing_columns(a, b)
    return normalize_multivalue(both, "duty", reverse_synonyms(duties))


def categorise_postings(
    postings: DataFrame, elements: DataFrame, terms: DataFrame, stop_words: Sequence[str] = (),
    word_pattern: str = r"[\p{L}\p{N}#+\-]+", strict: bool = False,
) -> DataFrame:
    """Tokens, skills per category, degree and language of each posting, required and preferred.

    ``elements`` is the (seq, category, name, synonym) dictionary, ``terms`` the list of terms
    that stay whole. ``strict`` looks normalised tokens up under the unchanged dictionary keys.
    """
    dictionary = build_synonym_dictionary(elements)
    if not strict:
        dictionary = normalized_dictionary(dictionary)
    # Each dictionary is made ready once and serves both texts.
    entries = Dictionary(category_entries(dictionary))
    replacements = Dictionary(replacement_map(elements))
    whole = Phrases(terms.select("term").unionByName(elements.select(F.explode(F.split("synonym", ",")).alias("term"))))
    rows = postings.withColumn("combined_text", combined_text("technicalTags", "description", "requirement")).withColumn(
        "preferredExperience", combined_text("preferredExperience")
    )
    for source, morpheme, prefix in (("combined_text", "morpheme", ""), ("preferredExperience", "pre_morpheme", "pre_")):
        english = morpheme + "_eng"
        rows = dictionary_tokenize(rows, source, whole, stop_words, pattern=word_pattern, out=morpheme)
        rows = rows.withColumn(english, filter_latin(morpheme))
        rows = replace_tokens(rows, english, replacements)
        rows = classify_tokens_multi(rows, english, entries, prefix=prefix)
    return rows.withColumn("degree", degree_requirement("morpheme")).withColumn(
        "language", language_requirement("morpheme")
    )


# --- fixed values: column order of the stored table ---
CATEGORISED_COLUMNS = [
    "text", "id", "url", "title", "location", "duty", "degree", "language", "countryCode", "company_name",
    "crawling_dt", "career", "combined_text", "morpheme", "morpheme_eng", *K.CATEGORIES,
    "preferredExperience", "pre_morpheme", "pre_morpheme_eng", *["pre_" + c for c in K.CATEGORIES],
]
