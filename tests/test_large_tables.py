"""Bloom filters, large dictionaries and pruned skill sets: equal results from fewer rows."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from postlens.functions.bloom import BloomFilter
from postlens.operators import skills as S, tokens as T


@pytest.mark.parametrize("keys", [0, 1, 3_000, 60_000])
def test_bloom_filter_keeps_all_keys_and_few_others(spark, keys):
    known = spark.range(keys).select(F.concat(F.lit("k"), "id").alias("k"))
    rows = spark.range(keys + 20_000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    kept = BloomFilter.of(known, "k").keep(rows, "k")
    assert kept.join(known, "k", "left_semi").count() == keys
    assert kept.count() <= keys + 0.04 * 20_000


def test_bloom_filter_that_is_too_small_holds_nothing_back(spark, monkeypatch):
    monkeypatch.setattr("postlens.functions.bloom.MOST_BITS", 32_768)
    known = spark.range(0, 100_000, 2)
    assert BloomFilter.of(known, "id").keep(spark.range(100_000), "id").join(known, "id").count() == 50_000


def texts_with(spark, seed, rows=300):
    """Texts of unknown words, a hot word of the dictionary and now and then one of its terms."""
    rng = random.Random(seed)
    word = lambda: rng.choice([f"u{rng.randrange(10**6)}"] * 30 + ["hot"] * 10 + [f"t{rng.randrange(2 * 10**5)}", f"t{rng.randrange(10**5)} of it"])
    return spark.createDataFrame([(k, " ".join(word() for _ in range(rng.randrange(60)))) for k in range(rows)], "id long, text string")


def test_large_dictionary_gives_the_rows_of_a_small_one(spark):
    """100,000 words and 100,000 phrases; the small dictionary has the entries that these texts can hit."""
    docs = texts_with(spark, 1).withColumn("tokens", F.split("text", " "))
    words = spark.range(100_000).select(F.concat(F.lit("t"), "id").alias("key"), F.concat(F.lit("T"), "id").alias("value")).union(spark.createDataFrame([("hot", "HOT")], "key string, value string"))
    met = docs.select(F.explode("tokens").alias("key")).distinct()
    small = words.join(met, "key")
    got = T.replace_tokens(docs, "tokens", words).collect()
    assert sorted(got) == sorted(T.replace_tokens(docs, "tokens", small).collect())
    assert any("HOT" in r.tokens for r in got)

    terms = spark.range(100_000).select(F.concat(F.lit("t"), "id", F.lit(" of it")).alias("term"))
    few = terms.join(met, F.split("term", " ")[0] == F.col("key")).select("term")
    big, little = (T.dictionary_tokenize(docs.drop("tokens"), "text", t) for t in (T.Phrases(terms), T.Phrases(few)))
    assert T.Phrases(terms).found.lookup is None and T.Phrases(few).found.lookup is not None
    assert sorted(big.collect()) == sorted(little.collect()) and big.filter("exists(tokens, t -> t like '% of it')").count() > 50


def test_hits_that_are_shuffled_follow_the_hits(spark):
    tokens = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("key"))
    table = spark.range(1_000).select(F.concat(F.lit("w"), F.col("id") * 50).alias("key"), F.lit("v").alias("value"))
    likely = BloomFilter.of(table, "key").keep(tokens, "key").count()
    assert T.hits_of(tokens, table).count() == 1_000 and likely < 1_000 + 0.04 * 199_000


def test_tokens_are_filtered_before_they_are_rows(spark):
    """Places in arrays equal the rows that ``keep`` leaves, with empty and null arrays."""
    known = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    own = BloomFilter.of(known, "key")
    rows = spark.range(300).select("id", F.when(F.col("id") % 7 > 0, F.transform(F.sequence(F.lit(1), F.col("id") % 5), lambda i: F.concat(F.lit("k"), F.col("id") * i))).alias("keys"))
    placed = own.places(rows, F.col("keys"), "at").select("id", F.explode(F.transform("at", lambda i: F.get("keys", i))).alias("key"))
    kept = own.keep(rows.select("id", F.explode("keys").alias("key")), "key")
    assert sorted(placed.collect()) == sorted(kept.collect()) and placed.count() > 100
    table = known.withColumn("value", F.lit("x"))
    hits = T.hits_in(rows.select(F.col("id").alias("_row"), F.transform("keys", lambda k: F.struct(k.alias("key"))).alias("e")), "e", table)
    assert hits.count() == rows.select(F.explode("keys").alias("key")).join(known, "key", "left_semi").count()
    assert T.hits_in(rows.limit(0).select(F.col("id").alias("_row"), F.transform("keys", lambda k: F.struct(k.alias("key"))).alias("e")), "e", table).count() == 0


def random_baskets(spark, seed, n=150, skills=14):
    rng, rows = random.Random(seed), []
    for k in range(n):
        some = [f"s{i:02}" for i in range(skills) if rng.random() < 0.8 / (1 + i / 3)]
        rows.append((k, rng.choice(["d1", "d2"]), "tool", sorted(some), sorted(rng.sample([f"s{i:02}" for i in range(skills)], 4))))
    baskets = spark.createDataFrame(rows, "id long, duty string, category string, required array<string>, preferred array<string>")
    return rows, baskets, baskets.groupBy("duty").agg(F.countDistinct("id").alias("total_jobs"))


@pytest.mark.parametrize("least", [2.0, 10.0, 30.0, 101.0])
def test_pruned_sets_equal_the_full_count(spark, least):
    _, baskets, totals = random_baskets(spark, int(least))
    full = S.skill_set_support(baskets, totals).filter(F.col("probability") >= least)
    assert sorted(S.skill_set_support(baskets, totals, least).collect()) == sorted(full.collect())


def test_triples_are_made_of_frequent_pairs_only(spark):
    rows, baskets, totals = random_baskets(spark, 5)
    size = {r["duty"]: r["total_jobs"] for r in totals.collect()}
    weighted = baskets.select("duty", "category", F.col("required").alias("items"), F.lit(1).cast("long").alias("req"), F.lit(0).cast("long").alias("pre"))
    made = S.frequent_triples(weighted, totals, 20.0).count()
    pairs = {}
    for _, duty, _, required, _ in rows:
        for pair in combinations(required, 2):
            pairs[duty, pair] = pairs.get((duty, pair), 0) + 1
    frequent = {key for key, n in pairs.items() if 100 * n / size[key[0]] >= 20}
    want = sum(all((duty, p) in frequent for p in combinations(t, 2)) for _, duty, _, required, _ in rows for t in combinations(required, 3))
    everything = sum(1 for _, _, _, required, _ in rows for _ in combinations(required, 3))
    assert made == want < everything
