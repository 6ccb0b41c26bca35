"""Command line: stage1, stage2, index and query over tables of extracted pages."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sheafline.engine import Engine, Settings
from sheafline.sources.files import structured_documents, write_documents


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sheafline")
    verbs = p.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("stage1", help="documents of the packets of a page table")
    one.add_argument("--input", required=True)
    one.add_argument("--output", required=True)
    one.add_argument("--method", choices=["baseline", "embedding", "learned"], default="baseline")
    one.add_argument("--model")
    two = verbs.add_parser("stage2", help="nested documents")
    two.add_argument("--stage1", required=True)
    two.add_argument("--pages", required=True)
    two.add_argument("--output", required=True)
    index = verbs.add_parser("index", help="chunks and vectors of nested documents")
    index.add_argument("--structured-dir", required=True)
    index.add_argument("--index", required=True)
    query = verbs.add_parser("query", help="ranked evidence")
    query.add_argument("--query", required=True)
    query.add_argument("--index", required=True)
    query.add_argument("--top-k", type=int)
    query.add_argument("--document-type")
    query.add_argument("--use-reranker", action=argparse.BooleanOptionalAction, default=False)
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("sheafline").getOrCreate()
    engine = Engine(spark, Settings(model_path=getattr(a, "model", None), use_reranker=getattr(a, "use_reranker", False)))
    if a.verb == "stage1":
        engine.analyze(spark.read.parquet(a.input), a.method).write.mode("overwrite").parquet(a.output)
    elif a.verb == "stage2":
        write_documents(engine.structure(spark.read.parquet(a.pages), spark.read.parquet(a.stage1)), a.output)
    elif a.verb == "index":
        engine.build_index(structured_documents(spark, a.structured_dir), a.index)
    else:
        rows = engine.query(a.index, spark.createDataFrame([("q", a.query)], "query_id string, query string"), a.document_type, a.top_k)
        rows.orderBy("rank").show(truncate=False)


if __name__ == "__main__":
    main()
