"""Array columns, list-shaped strings and JSON pieces."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from postlens import constants as K
from postlens.functions.text import _col


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where lambdas in it use the value."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_map(values: Mapping) -> Column:
    """A constant map column from a small Python mapping."""
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def join_names(c, field: str = "name", sep: str = ", ") -> Column:
    """The names of an array of structs, joined; entries without the name are skipped."""
    names = F.filter(F.transform(_col(c), lambda t: t[field]), lambda n: n.isNotNull())
    return F.array_join(names, sep)


def ids_to_names(c, names: Mapping[int, str] = K.JOB_CATEGORY_NAMES, sep: str = ", ") -> Column:
    """Ids to names in their order; ids outside the map are left out (see ``unknown_ids``)."""
    table = literal_map(names)
    found = F.transform(_col(c), lambda i: F.try_element_at(table, i))
    return F.array_join(F.filter(found, lambda n: n.isNotNull()), sep)


def unknown_ids(c, names: Mapping[int, str] = K.JOB_CATEGORY_NAMES) -> Column:
    """How many ids the map does not know."""
    known = F.array(*[F.lit(i) for i in names])
    return F.size(F.filter(_col(c), lambda i: ~F.array_contains(known, i)))


def parse_list_literal(c) -> Column:
    """J9: "['a', 'b']" to array<string>; text that is no list gives null."""
    return F.from_json(_col(c), "array<string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def parse_tuple_literal(c) -> Column:
    """J10: "('tag', 'LABEL')" to struct(tag, ner_label); null where the shape differs."""
    text = _col(c)
    return F.struct(
        F.nullif(F.regexp_extract(text, K.TUPLE_TEXT, 1), F.lit("")).alias("tag"),
        F.nullif(F.regexp_extract(text, K.TUPLE_TEXT, 2), F.lit("")).alias("ner_label"),
    )


def list_to_json(c) -> Column:
    """J12"""
    return F.to_json(_col(c))


def split_trim_lower(c) -> Column:
    """Comma list to trimmed lower-case array; null gives an empty array."""
    return F.coalesce(
        F.transform(F.split(_col(c), ","), lambda t: F.lower(F.trim(t))),
        F.array().cast("array<string>"),
    )


def overlaps_list(c, wanted: Sequence[str] | None, sep: str = ", ") -> Column:
    """Any wanted value is an element of the joined cell; nothing wanted means no filter."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(
        F.arrays_overlap(F.split(_col(c), sep), F.array(*[F.lit(v) for v in wanted])), F.lit(False)
    )


def update_list_path(cell, path) -> Column:
    """New element 0; the rest stays only in a list of two or more."""
    cell, head = _col(cell), F.array(_col(path))
    return F.when(F.size(cell) > 1, F.concat(head, F.slice(cell, F.lit(2), F.size(cell)))).otherwise(head)


def update_list_text(cell, text) -> Column:
    """New element 1; the old element 0 stays if there is one."""
    cell = _col(cell)
    return F.when(F.size(cell) > 0, F.array(F.get(cell, F.lit(0)), _col(text))).otherwise(F.array(_col(text)))


def join_list(c, sep: str = ", ") -> Column:
    """L3, S8"""
    return F.array_join(_col(c), sep)
