import math

import numpy as np
from pyspark.sql import functions as F

from sheafline.engine import Engine, Settings
from sheafline.functions import similarity as S
from sheafline.operators import retrieval as R
from sheafline.operators import sample_layouts as L
from sheafline.sources.schemas import BLOCK
from sheafline.streaming.incremental import index_stream


def test_bucket_is_md5_modulo(spark):
    import hashlib

    words = ["a", "total", "52340", "ü", "x" * 300]
    r = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.bucket("w").alias("b")).collect()
    assert [x.b for x in r] == [int(hashlib.md5(w.encode()).hexdigest(), 16) % 384 for w in words]


def test_search_fills_with_zero_scores(spark):
    c = spark.createDataFrame([("c1", "Total Amount: 52340"), ("c2", "Skills: Python"), ("c3", None)], "chunk_id string, text string")
    q = spark.createDataFrame([("q1", "what is the total"), ("q2", "")], "query_id string, text string")
    found = R.search(R.hash_index(q, "query_id"), R.hash_index(c, "chunk_id"), c).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in found] == [("q1", "c1"), ("q1", "c2"), ("q1", "c3")]
    assert found[0].score > 0 and found[1].score == 0.0


def test_dense_search_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "chunk_id long, vector array<double>")
    q = index.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    got = {(r.query_id, r.rank): r.chunk_id for r in R.dense_search(q, index.repartition(5), 7).collect()}
    for i in (0, 100, 200):
        order = sorted(range(300), key=lambda j: (-round(float(x[i] @ x[j]), 6), j))[:7]
        assert [got[i, k + 1] for k in range(7)] == order


def test_post_filter_may_leave_fewer_and_scores_are_normalised(spark):
    f = spark.createDataFrame([("q", "a", "x", 0.9), ("q", "b", "y", 0.5), ("q", "c", "x", 0.1)], "query_id string, chunk_id string, document_type string, score double")
    e = R.evidence(f, 5, "x").orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.vector_score) for r in e] == [("a", 1.0, 0.9), ("c", 0.0, 0.1)]
    same = R.evidence(f.withColumn("score", F.lit(0.3)), 2).collect()
    assert {r.score for r in same} == {1.0} and len(same) == 2
    re = R.evidence(f, 3, rerank=F.when(F.col("chunk_id") == "b", 1.0).otherwise(0.0)).orderBy("rank").collect()
    assert [r.chunk_id for r in re] == ["b", "a", "c"] and abs(re[0].score - (0.4 * 0.5 + 0.6)) < 1e-9 and re[1].score == 0.4


def test_metrics_definitions(spark):
    ranked = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate("abcde")], "query_id string, chunk_id string, rank int")
    truth = spark.createDataFrame([("q", "b"), ("q", "d"), ("q", "zz")], "query_id string, chunk_id string")
    m = R.query_metrics(ranked, truth).first()
    dcg = 1 / math.log2(3) + 1 / math.log2(5)
    assert (m.recall_1, round(m.recall_5, 6), m.precision_5, m.mrr, m.top1) == (0.0, round(2 / 3, 6), 0.4, 0.5, 0)
    assert abs(m.ndcg - dcg / (1 + 1 / math.log2(3))) < 1e-9


def test_layouts(spark):
    d = spark.createDataFrame([("k", [([2, 1], "a"), ([3], None)])], "packet_id string, documents array<struct<pages:array<int>,document_type:string>>")
    assert [(r.pages, r.document_type) for r in L.documents_layout(d).orderBy("group_no").collect()] == [("1,2", "a"), ("3", "unknown")]
    b = spark.createDataFrame([("k", [2, 3], 5), ("e", [], 2)], "packet_id string, boundaries array<int>, num_pages int")
    assert sorted((r.packet_id, r.pages) for r in L.boundaries_layout(b).collect()) == [("e", "1,2"), ("k", "1,2"), ("k", "3"), ("k", "4,5")]
    p = spark.createDataFrame([("k", ["x", "", "y"], [7, 8, 7])], "packet_id string, page_labels array<string>, document_ids array<int>")
    assert sorted((r.pages, r.document_type) for r in L.labelled_pages_layout(p).collect()) == [("1,3", "y"), ("2", "unknown")]
    n = spark.createDataFrame([("k", ["a", "a", "b", "a"])], "packet_id string, labels array<string>")
    assert [(r.pages, r.document_type) for r in L.labels_layout(n).orderBy("group_no").collect()] == [("1,2", "a"), ("3", "b"), ("4", "a")]


def test_engine_verbs(spark, tmp_path):
    texts = ["INVOICE\nBill To: A\nTotal Amount: 5\nSubtotal: 4", "INVOICE\nBill To: A\nSubtotal: 9", "RESUME\nExperience\nEducation\nSkills"]
    rows = [(f"p{i}", "k", i + 1, t, [(x, 0.0, float(j), 9.0, j + 1.0, "text", 10.0, False) for j, x in enumerate(t.split("\n"))], 4, 0, 600.0, 800.0) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, f"page_id string, packet_id string, page_number int, text string, blocks array<{BLOCK}>, block_count int, image_count int, width double, height double")
    engine = Engine(spark, Settings(boundary_threshold=0.65))
    documents = engine.analyze(pages)
    assert [(r.pages, r.document_type) for r in documents.orderBy("group_no").collect()] == [("1,2", "invoice"), ("3", "resume")]
    engine.build_index(engine.structure(pages, documents), str(tmp_path / "i"))
    q = spark.createDataFrame([("1", "total amount"), ("2", "  ")], "query_id string, query string")
    found = engine.query(str(tmp_path / "i"), q, top_k=1).orderBy("query_id").collect()
    assert found[0].document_type == "invoice" and found[1].warning == "empty_query"
    assert engine.query(str(tmp_path / "i"), q.limit(1), "letter").first().warning == "no_results"


def test_incremental_index(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("c1", "a b"), ("c2", "b c")], "chunk_id string, text string").write.parquet(str(source))
    stream = spark.readStream.schema("chunk_id string, text string").parquet(str(source))
    index_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/vectors")).count() == 4


def test_dense_search_over_many_blocks_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, size=(120, 3)).astype(float))], "chunk_id long, vector array<double>")
    q = index.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    whole = sorted(map(tuple, R.dense_search(q, index, 9).collect()))
    for name, size in (("QUERY_BLOCK", 5), ("INDEX_PART", 20), ("SLICE", 7)):
        monkeypatch.setattr(R, name, size)
    assert sorted(map(tuple, R.dense_search(q, index, 9).collect())) == whole and len(whole) == 12 * 9
    assert R.dense_search(q.where("false"), index).count() == 0 and R.dense_search(q, index.where("false")).count() == 0
