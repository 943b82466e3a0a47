"""Dictionary lookup inside a row.

A dictionary within the bound becomes one constant: an array of small maps, addressed by the
hash of the key, so a lookup costs the same however many entries there are. Work on token
arrays then needs neither an explode nor a shuffle. Beyond the bound the dictionary is stored
and joined. Both forms hold the same entries: keys and values that aren't null, and of equal
keys the one with the greatest value.
"""

import json

from pyspark.sql import Column, DataFrame, functions as F

from postlens.session import saved_copy

MAX_ENTRIES = 20_000
MAX_CHARS = 4_000_000


class Lookup:
    """``find(key)`` gives the value or null."""

    def __init__(self, buckets: list[dict], value_type: str):
        self.size = len(buckets)
        self.entries = {key: value for bucket in buckets for key, value in bucket.items()}
        self.table = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), f"array<map<string,{value_type}>>")

    def find(self, key: Column) -> Column:
        return F.try_element_at(F.get(self.table, F.pmod(F.hash(key), F.lit(self.size))), key)


def entries_of(dictionary: DataFrame) -> DataFrame:
    """One row per key: the greatest value."""
    return dictionary.filter("key is not null and value is not null").groupBy("key").agg(F.max("value").alias("value"))


def bounded_lookup(dictionary: DataFrame, max_entries: int = MAX_ENTRIES, max_chars: int = MAX_CHARS) -> Lookup | None:
    """A lookup of ``key`` to the greatest ``value``, or None when the dictionary exceeds the bound."""
    rows = entries_of(dictionary)
    value_type = rows.schema["value"].dataType.simpleString()
    # Sizes are looked at first, so no more than the bound ever reaches the driver.
    sized = rows.limit(max_entries + 1).select(F.length("key") + F.length(F.to_json(F.struct("value"))).alias("n"))
    entries, chars = sized.agg(F.count("*"), F.coalesce(F.sum(sized.columns[0]), F.lit(0))).first()
    if entries > max_entries or chars > max_chars:
        return None
    size = max(16, 2 ** (2 * entries).bit_length())
    buckets: list[dict] = [{} for _ in range(size)]
    for row in rows.select(F.pmod(F.hash("key"), F.lit(size)).alias("slot"), "key", "value").collect():
        buckets[row.slot][row.key] = row.asDict(recursive=True)["value"]
    return Lookup(buckets, value_type)


class Dictionary:
    """(key, value) rows made ready once, for any number of texts: a lookup in the row, or a stored table to join."""

    def __init__(self, rows: DataFrame, max_entries: int = MAX_ENTRIES):
        self.lookup = bounded_lookup(rows, max_entries)
        self.table = None if self.lookup else saved_copy(entries_of(rows), "dictionary")

    @classmethod
    def of(cls, rows: "DataFrame | Dictionary", max_entries: int = MAX_ENTRIES) -> "Dictionary":
        return rows if isinstance(rows, Dictionary) else cls(rows, max_entries)
