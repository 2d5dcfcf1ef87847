import __spark_entry__ as entry_module

SMALL = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["doc_id", "source", "score", "quality"] and 0 < df.count() <= 8
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_versions(spark, tmp_path):
    from foliant.operators.store import VersionedTable

    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    assert t.write(spark.range(5)) == 1 and t.write(spark.range(3)) == 2 and t.read().count() == 3
    assert t.clear(spark.range(1)) == 3 and t.read().count() == 0


def test_stream_hands_batches_to_the_store(spark, tmp_path):
    from foliant.operators.store import VersionedTable
    from foliant.streaming import activity

    t = VersionedTable(spark, str(tmp_path / "t"))
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    q = activity.each_batch(activity.source(spark, f"{SMALL}/events.parquet", schema), lambda df, n: t.write(df), str(tmp_path / "c"))
    q.awaitTermination()
    assert t.read().count() == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_tokens_and_vectors(spark):
    from pyspark.sql import functions as F

    from foliant.operators import embedding, vector

    w = embedding.WordPiece({t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "報", "價", "!"])})
    assert w.encode("Unaffable 報價! zzz") == [1, 3, 4, 5, 6, 7, 8, 0, 2] and len(w.encode("報" * 50, 10)) == 10
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c", "a b c d e"])], "vec_id long, text string").withColumn("embedding", embedding.embed(F.col("text")))
    top = vector.top_k(df, embedding.hashed_vector("c"), 1).first()
    assert top.vec_id == 1 and abs(top.score - 1) < 1e-6
    assert vector.from_blob(vector.to_blob([1.0, 2.5])) == [1.0, 2.5]
    best = vector.best_similarity(df.select(F.col("vec_id").alias("query_id"), "embedding"), df)
    assert all(abs(r.best - 1) < 1e-6 for r in best.collect())


def test_best_similarity_of_any_query_set(spark):
    import numpy as np

    from foliant.operators import vector

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4 if i % 5 else 3).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(rows, "query_id long, embedding array<float>")
    assert vector.best_similarity(vectors.limit(0), vectors).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 7), (2, None), (None, [1.0])], "query_id long, embedding array<float>")
    assert vector.best_similarity(odd, vectors).count() == 0
    old, vector.BLOCK_QUERIES = vector.BLOCK_QUERIES, 7
    try:
        got = {r.query_id: r.best for r in vector.best_similarity(vectors, vectors).collect()}
    finally:
        vector.BLOCK_QUERIES = old
    v = {i: np.float32(x).astype(float) for i, x in rows}
    assert set(got) == set(v) and all(abs(got[i] - max(x @ y for y in v.values() if len(y) == len(x))) < 1e-9 for i, x in v.items())


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    import pytest

    from foliant.shared import shared_folder

    class Fake:
        master = "spark://x"
        _jsc = property(lambda self: self)
        sc = getCheckpointDir = lambda self: self
        isDefined = lambda self: False
        getConf = lambda self: self
        get = lambda self, *_: None
        conf = sparkContext = property(lambda self: self)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Fake())
