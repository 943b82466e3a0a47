"""Token arrays by Arrow batch, for dictionaries that fit in a row's lookup.

Each different token of a batch is looked up once, whatever the number of rows that have it; what
is left for each place are steps on whole columns.
"""

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from postlens.functions.text import _col


def _coded(lists: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """The different tokens, each place's number among them, and the tokens of each row."""
    tokens = lists.flatten().dictionary_encode(null_encoding="encode")
    return tokens.dictionary.to_pylist(), tokens.indices.to_numpy().astype(np.int64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()


def whole_terms(c, terms: Mapping[str, int]) -> Column:
    """Runs of words that are a term become one token, the longest at each place from the left; ``terms`` gives the words of each."""
    lengths: dict[str, set[int]] = {}
    for term, n in terms.items():
        lengths.setdefault(term.split(" ", 1)[0], set()).add(n)
    opening = {word: sorted(own, reverse=True) for word, own in lengths.items()}

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        names, code, sizes = _coded(lists)
        ends = np.cumsum(sizes, dtype=np.int64)
        places = np.flatnonzero(np.fromiter((name in opening for name in names), bool, len(names))[code])
        keep, free, added = np.ones(len(code), bool), 0, {}
        at = code.tolist()
        for place, end in zip(places.tolist(), np.repeat(ends, sizes)[places].tolist()):
            if place < free:
                continue
            for n in opening[names[at[place]]]:
                term = " ".join([names[k] for k in at[place : place + n]]) if place + n <= end else None
                if term in terms:
                    free = min(place + terms[term], end)
                    code[place] = len(names) + added.setdefault(term, len(added))
                    keep[place + 1 : free] = False
                    break
        kept = np.concatenate(([0], np.cumsum(keep)))
        tokens = pa.array([*names, *added], pa.string()).take(pa.array(code[keep]))
        offsets = pa.array(kept[np.concatenate(([0], ends))], pa.int32())
        return pa.ListArray.from_arrays(offsets, tokens, mask=lists.is_null())

    return run.asNondeterministic()(_col(c))


def category_cells(c, entries: Mapping[str, Sequence[Mapping]], categories: Sequence[str]) -> Column:
    """Struct with one text per category: the sorted distinct names of the row's keys, joined; ``entries`` gives each key's (category, name)."""
    places = {category: k for k, category in enumerate(categories)}
    found = {
        key: [(places[e["category"]], e["name"]) for e in pairs if e["category"] in places and e["name"] is not None]
        for key, pairs in entries.items()
    }

    @F.arrow_udf(T.StructType([T.StructField(category, T.StringType()) for category in categories]))
    def run(lists: pa.Array) -> pa.Array:
        keys, code, sizes = _coded(lists)
        own = [found.get(key, ()) for key in keys]
        pairs = sorted({pair for some in own for pair in some})
        number = {pair: k for k, pair in enumerate(pairs)}
        counts = np.array([len(some) for some in own], np.int64)
        flat = np.array([number[pair] for some in own for pair in some], np.int64)
        times = counts[code]
        row = np.repeat(np.repeat(np.arange(len(lists)), sizes), times)
        first = np.repeat((np.cumsum(counts) - counts)[code] - (np.cumsum(times) - times), times)
        hits = np.unique(row * max(1, len(pairs)) + flat[first + np.arange(len(row))])
        row, pair = np.divmod(hits, max(1, len(pairs)))
        cell = row * len(categories) + np.array([k for k, _ in pairs], np.int64)[pair]
        offsets = np.searchsorted(cell, np.arange(len(lists) * len(categories) + 1))
        names = pa.array([name for _, name in pairs], pa.string()).take(pa.array(pair))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names), ", ")
        return pa.StructArray.from_arrays([joined.take(pa.array(np.arange(k, len(joined), len(categories)))) for k in range(len(categories))], list(categories))

    return run.asNondeterministic()(_col(c))
