import corpus_pipeline as P
from postlens.llm import packing
from postlens.llm.common import read
from postlens.session import scratch_path
from tests.llm.helpers import frame, odd_documents

FOLDER = "/root/testdata/sf0.01"


def test_stages_in_turn(spark):
    docs = read(spark, FOLDER, "documents")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    names = [name for name, _ in P.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    now = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, FOLDER)
        assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
        now = P.stored(out, "test-stage")
        ids = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert ids <= before and len(ids) > 0.5 * len(before), name
        before = ids
    assert now.filter("n_chars <> length(text)").count() == 0
    packed = P.STAGES[-1][1](spark, now, FOLDER).toPandas()
    assert set(packed.doc_id) == before
    assert packed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_run_has_the_packing_columns(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


CLASHING = ("_key", "_found", "_words", "_true", "_spans", "_id", "_mark", "_slices", "_digest", "row", "hits", "_row", "_hits")


def folder_with(spark, docs):
    """A folder with these documents and the other tables of the smallest size."""
    folder = scratch_path(spark, "tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        read(spark, "/root/testdata/sf0.001", name).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_nulls_repeats_and_clashing_names(spark):
    rows = odd_documents() + [(30, "x y z", "en"), (30, "x y z", "en"), (31, None, None), (32, "", None)]
    docs = frame(spark, rows, CLASHING).drop("n_chars", "source")
    now, folder = docs, folder_with(spark, docs)
    for name, stage in P.STAGES[:-1]:
        now = P.stored(stage(spark, now, folder), "test-odd")
        assert now.dtypes == docs.dtypes, name
        assert {tuple(r[c] for c in CLASHING) for r in now.collect()} == {("clash",) * len(CLASHING)}, name
    kept = [(r["doc_id"], r["text"]) for r in now.collect()]
    assert len(kept) == len(set(kept)) and [i for i, _ in kept].count(30) <= 1
    assert P.run(spark, folder).count() >= len(kept)


def test_empty_table(spark):
    assert P.run(spark, folder_with(spark, frame(spark, []))).collect() == []


def test_first_stages_lower_arrow_batches(spark):
    """A batch counts several times in an executor, on top of what earlier stages left in its workers."""
    from postlens.llm import linededup, toxicity

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    try:
        for job in (lambda: linededup.fingerprints(docs), lambda: toxicity.channel_sums(docs, toxicity.Lexicon({}, {}), None, "doc_id")):
            spark.conf.set(key, str(16 << 20))
            job()
            assert int(spark.conf.get(key)) <= 2 << 20
    finally:
        spark.conf.set(key, before)
