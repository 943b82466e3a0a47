"""Text columns: cleaning, parsing, matching, splitting, formatting."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from postlens import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """White space off both ends."""
    return F.trim(_col(c), F.lit(" \t\n\r\f\x0b"))


def combined_text(*columns) -> Column:
    """The columns joined by a space (null as ''), '.' dropped, '/' to ', ', lower case."""
    joined = F.concat_ws(" ", *[F.coalesce(_col(c), F.lit("")) for c in columns])
    return F.lower(F.replace(F.replace(joined, F.lit("."), F.lit("")), F.lit("/"), F.lit(", ")))


def upper_country(c) -> Column:
    """P5"""
    return F.upper(_col(c))


def career_range(c, any_career: str = K.ANY_CAREER, newcomer: str = K.NEWCOMER) -> Column:
    """Free text to struct(career, max_career) in years."""
    text = F.coalesce(_col(c), F.lit(""))
    low = F.regexp_extract(text, K.CAREER_SPAN, 1)
    high = F.regexp_extract(text, K.CAREER_SPAN, 2)
    single = F.regexp_extract(text, K.CAREER_YEARS, 1)

    def years(first, last):
        first, last = (F.lit(v) if isinstance(v, int) else v.try_cast("int") for v in (first, last))
        return F.struct(first.alias("career"), last.alias("max_career"))

    return (
        F.when(text.contains(any_career) | (text == ""), years(0, 100))
        .when(text.contains(newcomer), years(0, 1))
        .when(low != "", years(low, high))
        .when(single != "", years(single, single))
        .otherwise(years(0, 100))
    )


def extract_region(c, rules: Sequence[tuple[str, str]] = K.REGION_RULES, other: str = K.OTHER_REGION) -> Column:
    """Name of the first rule whose pattern is found, else ``other``."""
    hits = [F.when(_col(c).rlike(pattern), F.lit(name)) for name, pattern in rules]
    return F.coalesce(*hits, F.lit(other))


def code_to_label(c, labels: Mapping[int, str], default: str | None = None) -> Column:
    """P10: code to name; codes outside the map and nulls go to ``default``, or stay null without one."""
    out = None
    for code, name in labels.items():
        test = _col(c) == code
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out if default is None else out.otherwise(F.lit(default))


def percent_text(c) -> Column:
    """A number as the shortest decimal followed by %, always with a fraction part."""
    return F.concat(_col(c).cast("double").cast("string"), F.lit("%"))


def percent_text_2(c) -> Column:
    """A number with exactly two decimals followed by %."""
    return F.format_string("%.2f%%", _col(c).cast("double"))


def career_label(c) -> Column:
    """0 is a newcomer, n is the n-th year."""
    return F.when(_col(c) == 0, F.lit(K.NEWCOMER_LABEL)).otherwise(
        F.concat(_col(c).cast("string"), F.lit(K.YEAR_SUFFIX))
    )


def year_label(c) -> Column:
    """N is the n-th year, 0 included."""
    return F.concat(_col(c).cast("string"), F.lit(K.YEAR_SUFFIX))


def contains_ignore_case(c, needle) -> Column:
    """Plain substring test without regard to case; null text is no match."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.coalesce(F.contains(F.lower(_col(c)), F.lower(needle)), F.lit(False))


def matches_ignore_case(c, pattern: str) -> Column:
    """Regular expression test without regard to case; null text is no match."""
    return F.coalesce(_col(c).rlike(f"(?iu){pattern}"), F.lit(False))


def like_contains(c, value: str) -> Column:
    """LIKE '%value%' without regard to case, the value taken literally."""
    escaped = value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return _col(c).ilike(f"%{escaped}%")


def contains_text(c, text: str, negate: bool = False) -> Column:
    """Rows that hold (or lack) a text; null rows satisfy neither."""
    hit = _col(c).contains(text)
    return ~hit if negate else hit


def build_url(c, prefix: str = K.FEED_A_URL, missing: str = K.NO_URL) -> Column:
    """Prefix before a relative path, or the placeholder."""
    url = _col(c)
    return F.when(url.isNotNull() & (url != ""), F.concat(F.lit(prefix), url)).otherwise(F.lit(missing))


def url_from_id(c, prefix: str = K.FEED_B_URL) -> Column:
    """A template on the id."""
    return F.concat(F.lit(prefix), _col(c).cast("string"))


def url_number(c, which: str = "last") -> Column:
    """First or last digit run of a URL, null when there is none."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"(\d+)"), F.lit(1))
    return F.try_element_at(runs, F.lit(1 if which == "first" else -1))


def split_numbered_lines(c) -> Column:
    """Non-blank lines, each cut after its first '. '."""
    lines = F.filter(F.split(_col(c), r"\R"), lambda x: strip(x) != "")

    def rest(line):
        at = F.instr(line, ". ")
        return strip(F.when(at > 0, F.substring(line, at + 2, F.length(line))).otherwise(line))

    return F.transform(lines, rest)


def _split_pieces(c, pattern: str) -> Column:
    return F.filter(F.transform(F.split(_col(c), pattern), strip), lambda x: x != "")


def split_sentences_dash(c) -> Column:
    """Pieces between sentence ends (not after a digit) and '- '."""
    return _split_pieces(c, K.SENTENCE_END)


def split_numbered_inline(c) -> Column:
    """Pieces between 'N. ' marks."""
    return _split_pieces(c, K.INLINE_NUMBER)


def spaced_variant(c, suffixes: Sequence[str] = K.SPACED_SUFFIXES) -> Column:
    """The term with a space before its suffix, null when it has none of them."""
    term = _col(c)
    out = None
    for suffix in suffixes:
        value = F.concat(F.regexp_replace(term, f"{suffix}$", ""), F.lit(f" {suffix}"))
        test = term.endswith(suffix)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out
