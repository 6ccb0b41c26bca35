import pytest
from pyspark.sql import functions as F

from sheafline.engine import Engine
from sheafline.operators import boundaries as B
from sheafline.operators import boundary_model as M
from sheafline.operators.page_types import classified
from sheafline.sources.schemas import BLOCK


def stream(spark, rows, schema="stream_id string, position int, boundary int, page_text string"):
    return spark.createDataFrame(rows, schema)


F1 = [("s1", 0, 1, "a"), ("s1", 1, 0, "b"), ("s1", 2, 1, "c"), ("s1", 3, 0, "d")]


def test_both_writings_of_a_stream(spark):
    one = B.normalized(stream(spark, F1[::-1])).orderBy("page_number").collect()
    assert [(r.page_number, r.text, r.starts_new_document) for r in one] == [(1, "a", True), (2, "b", False), (3, "c", True), (4, "d", False)]
    two = B.normalized(spark.createDataFrame([("m", 3, 0, "c"), ("m", 1, 1, None), ("m", 2, 1, "b")], "stream_id string, position int, label int, text string"))
    assert [(r.page_number, r.text) for r in two.orderBy("page_number").collect()] == [(1, ""), (2, "b"), (3, "c")]


def test_true_groups_and_pairs(spark):
    p = B.normalized(stream(spark, F1))
    assert [r.group_no for r in B.true_groups(p).orderBy("page_number").collect()] == [1, 1, 2, 2]
    # no boundary on the first page opens no empty group
    late = B.normalized(stream(spark, [("s", 0, 0, "x"), ("s", 1, 1, "y"), ("s", 2, 0, "z")]))
    assert [(r.page_a, r.page_b, r.is_boundary) for r in B.true_pairs(late).orderBy("page_a").collect()] == [(1, 2, True), (2, 3, False)]


def test_groups_of_decisions(spark):
    pages = spark.createDataFrame([("k", i) for i in range(1, 5)], "stream_id string, page_number int")
    decided = spark.createDataFrame([("k", 1, 2, 0.8, False), ("k", 2, 3, 0.2, True), ("k", 3, 4, 0.7, False)], "stream_id string, page_a int, page_b int, score double, is_boundary boolean")
    g = B.groups(B.page_groups(pages, decided)).orderBy("group_no").collect()
    assert [(r.pages, r.document_id, round(r.group_confidence, 3)) for r in g] == [("1,2", "k_doc_001", 0.8), ("3,4", "k_doc_002", 0.7)]
    single = B.groups(B.page_groups(pages.where("page_number = 1"), decided)).collect()
    assert [(r.pages, r.group_confidence) for r in single] == [("1", 1.0)]


def test_features_of_texts(spark):
    texts = ["Invoice 44 bill to Mara, total 310", "Invoice, subtotal 280, levy 30", "Resume of Ada Quill: experience as a harbour pilot"]
    p = B.text_pages(spark.createDataFrame([("s", i + 1, t) for i, t in enumerate(texts)], "stream_id string, page_number int, text string"))
    f = B.pair_features(p).orderBy("page_a").collect()
    assert len(f) == 2 and set(B.FEATURES) <= set(f[0].asDict())
    assert f[0].type_agreement == 1.0 and f[1].type_agreement == 0.0
    assert abs(f[0].token_jaccard - 1 / 11) < 1e-9 and f[0].layout_similarity == 1.0 and f[0].block_position_similarity == 0.0


def test_metrics_of_two_streams(spark):
    rows = [("s1", 0, 1, "a"), ("s1", 1, 0, "a"), ("s1", 2, 1, "b"), ("s2", 0, 1, "x"), ("s2", 1, 1, "y")]
    p = B.normalized(stream(spark, rows))
    truth = B.true_pairs(p).withColumn("score", F.lit(0.0))
    m = B.macro(B.stream_metrics(p, truth), "exact").first()
    assert (m.streams, m.page_pairs, m.precision, m.recall, m.f1, m.grouping_accuracy) == (2, 3, 1.0, 1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        B.decisions(truth, "basline")
    none = B.macro(B.stream_metrics(p, truth.withColumn("is_boundary", F.lit(False))), "none").first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_types(spark):
    t = ["Copper yard invoice 17\nbill to: the pier office\nsubtotal 80\ntotal amount 95", "Rain fell on the pier all night", "q", None]
    r = classified(spark.createDataFrame([(x,) for x in t], "text string")).collect()
    assert [(x.document_type, x.confidence) for x in r] == [("invoice", 1.0), ("unknown", 0.0), ("unknown", 0.0), ("unknown", 0.0)]


def test_learned_model_keeps_scaler_to_training_pairs(spark, tmp_path):
    rows = [("s", i, i + 1, *[float(i % 2) + 0.01 * j * i for j in range(9)], float(i % 2)) for i in range(40)]
    pairs = spark.createDataFrame(rows, "stream_id string, page_a int, page_b int, " + ", ".join(f"{n} double" for n in B.FEATURES) + ", label double")
    fitted, held = M.divided(pairs)
    model = M.train(fitted)
    mean = fitted.agg(F.avg("semantic_cosine")).first()[0]
    assert abs(model.stages[1].mean[0] - mean) < 1e-9 and held.count() + fitted.count() == 40
    M.save(model, str(tmp_path / "m"))
    again = M.learned_decisions(held, M.load(str(tmp_path / "m"))).orderBy("page_a").collect()
    assert [r.is_boundary for r in again] == [r.is_boundary for r in M.learned_decisions(held, model).orderBy("page_a").collect()]
    assert M.load(str(tmp_path / "absent")) is None and set(M.importances(model)) == set(B.FEATURES)


def test_learned_without_a_model_is_the_baseline(spark):
    rows = [(f"p{i}", "k", i, f"page {i} of the log", None, 0, 0, 600.0, 800.0) for i in (1, 2, 3)]
    pages = spark.createDataFrame(rows, f"page_id string, packet_id string, page_number int, text string, blocks array<{BLOCK}>, block_count int, image_count int, width double, height double")
    got = lambda method: sorted(map(str, Engine(spark).analyze(pages, method).collect()))
    assert got("learned") == got("baseline")
    with pytest.raises(ValueError):
        Engine(spark).analyze(pages, "basline")
