"""Documents as JSON files, the command line, and the small operators that no query uses."""

import json

from pyspark.sql import functions as F

from sheafline import cli
from sheafline.operators import boundary_model, page_types, sample_layouts
from sheafline.operators.retrieval import VectorStore
from sheafline.plans.storage import small_or_shuffled
from sheafline.sources import files, tables
from sheafline.sources.schemas import BLOCK


def test_pretty_printed_documents_are_read_and_written_again(spark, tmp_path):
    for i in range(3):
        path = tmp_path / "in" / f"k{i % 2}" / f"d{i}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"document_id": f"d{i}", "content": {"title": "T", "sections": [{"heading": "H", "blocks": [{"type": "paragraph", "text": "some words"}]}]}}, indent=2))
    docs = files.structured_documents(spark, str(tmp_path / "in"))
    assert {r.document_id for r in docs.collect()} == {"d0", "d1", "d2"}
    files.write_documents(docs.coalesce(1), str(tmp_path / "out"))
    again = files.structured_documents(spark, str(tmp_path / "out"))
    assert sorted(r.content.sections[0].blocks[0].text for r in again.select("content").collect()) == ["some words"] * 3
    assert [r.text for r in files.whole_texts(spark, str(tmp_path / "in" / "k1" / "d1.json")).collect()][0].startswith("{")


def test_command_line(spark, tmp_path, capsys):
    texts = ["Invoice 8\nbill to the yard\nsubtotal 4\ntotal amount 5", "Resume\nexperience\neducation\nskills"]
    rows = [(f"p{i}", "k", i + 1, t, [(x, 0.0, float(j), 9.0, j + 1.0, "text", 10.0, False) for j, x in enumerate(t.split("\n"))], 4, 0, 600.0, 800.0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, f"page_id string, packet_id string, page_number int, text string, blocks array<{BLOCK}>, block_count int, image_count int, width double, height double").write.parquet(str(tmp_path / "pages"))
    at = lambda name: str(tmp_path / name)
    cli.main(["stage1", "--input", at("pages"), "--output", at("documents")])
    cli.main(["stage2", "--stage1", at("documents"), "--pages", at("pages"), "--output", at("nested")])
    cli.main(["index", "--structured-dir", at("nested"), "--index", at("index")])
    capsys.readouterr()
    cli.main(["query", "--query", "total amount", "--index", at("index"), "--top-k", "1"])
    assert "invoice" in capsys.readouterr().out.lower()


def test_small_operators(spark):
    pair = lambda a, b: spark.range(1).select(page_types.more_confident(F.struct(F.lit("e").alias("type"), F.lit(a).alias("confidence")), F.struct(F.lit("h").alias("type"), F.lit(b).alias("confidence"))).alias("x")).first().x.type
    assert (pair(0.6, 0.5), pair(0.5, 0.5), pair(0.1, 0.5)) == ("e", "h", "h")
    assert [tuple(r) for r in sample_layouts.no_layout(spark.createDataFrame([("k",)], "packet_id string")).collect()] == [("k", 1, "1", "unknown")]
    store = VectorStore(spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, vector array<double>")).add(spark.createDataFrame([(2, [0.0, 1.0])], "chunk_id long, vector array<double>"))
    found = store.search(spark.createDataFrame([(9, [0.1, 0.9])], "query_id long, vector array<double>"), 1)
    assert store.size() == 2 and [r.chunk_id for r in found.collect()] == [2]
    pages = spark.createDataFrame([("a", "", ["empty_native_text"]), ("b", "x" * 80, []), ("c", " ", None)], "page_id string, text string, warnings array<string>").withColumn("extraction_method", F.lit("native"))
    read = lambda df: df.select("page_id", F.when(F.col("page_id") == "a", " seen ").otherwise("").alias("ocr_text"), F.lit(0.9).alias("ocr_confidence"))
    got = {r.page_id: (r.text, r.extraction_method, r.warnings) for r in files.recognised(pages, read).collect()}
    assert got == {"a": ("seen", "ocr", ["empty_native_text"]), "b": ("x" * 80, "native", []), "c": ("", "ocr", ["ocr_empty_result"])}
    assert files.needs_ocr(pages).count() == 0


def test_wide_rows_are_not_broadcast(spark):
    narrow, wide = spark.range(1000), spark.range(1000).select("id", F.repeat(F.lit("x"), 100_000).alias("t"))
    strategy = lambda df: spark.range(10).join(small_or_shuffled(df), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in strategy(narrow) and "broadcast" not in strategy(wide) and "broadcast" not in strategy(wide.select("id", F.array("t").alias("t")))


def test_manifest_lists_fields_in_order(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "b long, a string")
    both = tables.schema_summary(df, "t").unionByName(tables.schema_summary(df.where("false"), "none"))
    tables.write_manifest(both.coalesce(1), str(tmp_path / "m"))
    got = {r.dataset: r for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert {k: v.schema.num_samples for k, v in got.items()} == {"t": 2, "none": 0}
    assert [(f.field, f.type) for f in got["t"].schema.fields] == [("b", "bigint"), ("a", "string")]


def test_annotations_of_samples(spark):
    samples = sample_layouts.packet_named(spark.createDataFrame([(None, "k", 3, 9, [2]), ("i", "x", 4, 1, []), (None, None, 5, None, None)], "id string, packet_id string, sample_no int, num_pages int, boundaries array<int>"))
    grouped = spark.createDataFrame([("k", "3,4", "b"), ("k", "1,2", "a"), ("i", "1,10", "c")], "packet_id string, pages string, document_type string")
    got = {r.packet_id: r for r in sample_layouts.annotations(samples.withColumn("file_name", F.lit("f")), grouped).collect()}
    assert got["k"].groups == [[1, 2], [3, 4]] and got["k"].document_types == ["a", "b"] and got["k"].page_count == 9
    assert got["i"].page_count == 10 and got["i"].pdf_path == "f" and got["packet_5"].page_count == 0


def test_first_streams_by_arrival(spark):
    pages = spark.createDataFrame([("b", 2), ("a", 5), ("b", 9), ("c", 2), ("d", None)], "stream_id string, received_at int")
    assert sorted(r.stream_id for r in boundary_model.first_streams(pages, 2).collect()) == ["b", "b", "c"]
    assert boundary_model.first_streams(pages.where("false"), 2).count() == 0 and boundary_model.first_streams(pages, 9).count() == 5
