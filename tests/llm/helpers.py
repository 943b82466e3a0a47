"""Small document tables with the cases every operator must handle."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=()):
    """Documents of (doc_id, text, lang), with further columns whose names may clash."""
    full = [(i, t, l, "s", len(t or "")) for i, t, l in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    return df


def words(rng, n, letters="abcdefghij"):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(1)) for _ in range(n)]


def odd_documents(seed=1):
    """Nulls, empties, blanks, ties, repeated rows, one very long text, control and wide characters."""
    rng = random.Random(seed)
    long_text = " ".join(words(rng, 30_000))
    some = [" ".join(words(rng, n)) for n in (1, 3, 4, 13, 60, 200)]
    rows = [(None, None, None), (None, "x", "en"), (1, None, "en"), (2, "", None), (3, " \n\t ", "de"), (4, long_text, "en"), (5, "<|endoftext|> Ünï 漢字 'll \x1c  x\n\ny", "fr")]
    rows += [(10 + k, t, "en") for k, t in enumerate(some)] + [(20 + k, t, "de") for k, t in enumerate(some)]
    return rows + rows[-2:]
