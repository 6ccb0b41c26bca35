"""The verbs of the engine over many packets at once: pages to documents, chunks, index and evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.operators import boundaries as B
from sheafline.operators import boundary_model as M
from sheafline.operators import chunking as C
from sheafline.operators import retrieval as R
from sheafline.operators import structure as S
from sheafline.operators.page_types import classified
from sheafline.plans.storage import stored


@dataclass(frozen=True)
class Settings:
    boundary_threshold: float = B.THRESHOLD
    chunk_size: int = C.CHUNK_SIZE
    chunk_overlap: int = C.OVERLAP
    top_n: int = R.TOP_N
    top_k: int = R.TOP_K
    use_reranker: bool = False
    model_path: str | None = None


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings = Settings()):
        self.spark, self.settings = spark, settings

    def analyze(self, extractions: DataFrame, method: str = "baseline") -> DataFrame:
        """Documents of each packet with pages, confidence and type. Methods: baseline, embedding, learned;
        learned falls back to baseline where no model was saved; any other name is an error."""
        pages = B.layout_pages(extractions)
        features = B.pair_features(pages)
        model = M.load(self.settings.model_path) if method == "learned" and self.settings.model_path else None
        decided = M.learned_decisions(features, model, self.settings.boundary_threshold) if model else B.decisions(features, "baseline" if method == "learned" else method, self.settings.boundary_threshold)
        placed = stored(B.page_groups(pages, decided))
        texts = placed.join(pages.select("stream_id", "page_number", "text"), ["stream_id", "page_number"])
        joined = texts.groupBy("stream_id", "group_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n").alias("text"))
        return B.groups(placed).join(classified(joined).drop("text"), ["stream_id", "group_no"]).withColumnRenamed("stream_id", "packet_id")

    def structure(self, extractions: DataFrame, documents: DataFrame) -> DataFrame:
        """Nested documents: sections of content blocks, with title and provenance."""
        owner = documents.select("packet_id", "document_id", "document_type", "confidence", F.explode(F.split("pages", ",")).alias("n")).withColumn("page_number", F.col("n").cast("int")).drop("n")
        pages = extractions.join(owner, ["packet_id", "page_number"])
        blocks = stored(S.content_blocks(pages.select("page_id", "packet_id", "page_number", "text", "blocks")).join(owner, ["packet_id", "page_number"]))
        kept = S.sections(blocks, "document_id").select("document_id", "section_no", "heading", "page")
        inner = S.sectioned(blocks, "document_id").where(F.col("block.type") != "heading")
        body = F.struct(*[F.col(f"block.{c}").alias(c) for c in ("type", "text")], F.col("page_number").alias("page"), *[F.col(f"block.{c}").alias(c) for c in ("headers", "rows", "items")], F.struct("block.bbox", "block.source_block_type", "block.source_block_count").alias("metadata"))
        listed = inner.groupBy("document_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "block_no", body.alias("b")))).alias("x")).select("document_id", "section_no", F.col("x.b").alias("blocks"))
        sections = kept.join(listed, ["document_id", "section_no"], "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(listed.schema["blocks"].dataType)))
        content = sections.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_no", F.struct("heading", "page", "blocks").alias("s")))), lambda x: x["s"]).alias("sections"))
        title = S.titles(blocks, pages, "document_id")
        base = documents.select("document_id", "document_type", "confidence", F.struct("packet_id", F.concat("packet_id", F.lit(".pdf")).alias("source_file"), "page_start", "page_end").alias("source"))
        return base.join(title, "document_id", "left").join(content, "document_id", "left").select("document_id", "document_type", "confidence", "source", F.struct("title", "sections").alias("content"))

    def build_index(self, documents: DataFrame, path: str) -> None:
        """Chunks and their sparse vectors as two tables under ``path``."""
        chunks = C.chunks(documents, self.settings.chunk_size, self.settings.chunk_overlap)
        chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        R.hash_index(self.spark.read.parquet(f"{path}/chunks"), "chunk_id").write.mode("overwrite").parquet(f"{path}/vectors")

    def load_index(self, path: str) -> tuple[DataFrame, DataFrame]:
        return self.spark.read.parquet(f"{path}/chunks"), self.spark.read.parquet(f"{path}/vectors")

    def query(self, path: str, queries: DataFrame, document_type: str | None = None, top_k: int | None = None) -> DataFrame:
        """Evidence of ``queries(query_id, query)`` with a warning for each empty one and each without results."""
        chunks, vectors = self.load_index(path)
        asked = queries.select("query_id", R.normalize_query(F.col("query")).alias("query"))
        index = R.hash_index(asked.where("query <> ''"), "query_id", "query")
        found = R.search(index, vectors, chunks, self.settings.top_n).join(chunks, "chunk_id").join(asked, "query_id")
        rerank = R.token_overlap("query", "text") if self.settings.use_reranker else None
        best = R.evidence(found, top_k or self.settings.top_k, document_type, rerank).select("query_id", "document_id", "document_type", F.col("page_start").alias("page"), "chunk_id", F.col("text").alias("evidence"), "score", "vector_score", "rerank_score", "rank")
        warning = F.when(F.coalesce("query", F.lit("")) == "", "empty_query").when(F.col("chunk_id").isNull(), "no_results")
        return asked.join(best, "query_id", "left").withColumn("warning", warning)
