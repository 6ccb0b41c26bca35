"""From page streams to document groups: pairs, nine features, decisions, groups, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import similarity as S
from sheafline.functions.text import source_key, strip, tokens
from sheafline.operators.page_types import UNKNOWN, classified

FEATURES = ("semantic_cosine", "token_jaccard", "text_length_ratio", "layout_similarity", "block_position_similarity", "heading_style_similarity", "entity_overlap", "structural_similarity", "type_agreement")
#: Weights of the features in the rule score, divided by their sum.
WEIGHTS = (0.40, 0.10, 0.10, 0.20, 0.10, 0.05, 0.05, 0.10, 0.20)
THRESHOLD = 0.5


def stream_fields(df: DataFrame) -> tuple[str, str, str]:
    """Names of the position, boundary and text columns, whichever writing the table has."""
    pick = lambda *names: next((n for n in names if n in df.columns), None)
    found = pick("original_position", "position"), pick("boundary", "label"), pick("page_text", "text")
    if None in found:
        raise KeyError(f"a page stream needs a position, a boundary and a text column, not {df.columns}")
    return found


def normalized(rows: DataFrame) -> DataFrame:
    """Pages of streams in order: ``stream_id, page_number, original_position, text, starts_new_document, source``.

    Rows delivered twice count once; sources compare trimmed and lower-cased. A null text is empty, a null boundary starts nothing.
    """
    position, boundary, text = stream_fields(rows)
    source = source_key("source") if "source" in rows.columns else F.lit(None).cast("string")
    pages = rows.select(F.coalesce("stream_id", F.lit("stream_0")).alias("stream_id"), F.col(position).alias("original_position"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(boundary) == 1, F.lit(False)).alias("starts_new_document"), source.alias("source")).distinct()
    order = Window.partitionBy("stream_id").orderBy("original_position", "text", "starts_new_document", "source")
    return pages.withColumn("page_number", F.row_number().over(order)).select("stream_id", "page_number", "original_position", "text", "starts_new_document", "source")


def text_pages(pages: DataFrame) -> DataFrame:
    """Pages of text alone in the form of ``layout_pages``: no blocks, no size."""
    nothing = F.array().cast("array<struct<x0:double,y0:double,is_heading:boolean>>")
    return pages.select("stream_id", "page_number", "text", nothing.alias("blocks"), F.lit(0).alias("block_count"), F.lit(0).alias("image_count"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"))


def layout_pages(extractions: DataFrame) -> DataFrame:
    """Extracted pages with layout, the packet being the stream."""
    nothing = F.array().cast("array<struct<x0:double,y0:double,is_heading:boolean>>")
    slim = F.transform("blocks", lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["is_heading"].alias("is_heading")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return extractions.select(F.col("packet_id").alias("stream_id"), "page_number", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(slim, nothing).alias("blocks"), zero("block_count").alias("block_count"), zero("image_count").alias("image_count"), zero("width").cast("double").alias("width"), zero("height").cast("double").alias("height")).distinct()


def pairs(pages: DataFrame) -> DataFrame:
    """Adjacent pages of each stream as structs ``a`` and ``b``."""
    held = pages.withColumn("tokens", tokens("text")).withColumn("names", S.entities("text")).withColumn("text_length", F.length(strip("text")))
    held = classified(held).drop("candidates", "confidence")
    page = F.struct(*[c for c in held.columns if c != "stream_id"])
    order = Window.partitionBy("stream_id").orderBy("page_number")
    return held.select("stream_id", page.alias("a"), F.lead(page).over(order).alias("b")).where("b is not null")


def pair_features(pages: DataFrame) -> DataFrame:
    """``stream_id, page_a, page_b`` and the nine features of adjacent pages."""
    length = S.ratio(F.col("a.text_length"), F.col("b.text_length"))
    heads = S.ratio(S.headings("a"), S.headings("b"))
    agree = (F.col("a.document_type") == F.col("b.document_type")) & (F.col("a.document_type") != UNKNOWN)
    values = (
        S.hash_cosine("a.text", "b.text"),
        S.jaccard(F.col("a.tokens"), F.col("b.tokens")),
        length,
        S.layout("a", "b"),
        S.block_positions("a", "b"),
        heads,
        S.jaccard(F.col("a.names"), F.col("b.names")),
        (length + S.ratio(F.col("a.image_count"), F.col("b.image_count")) + heads) / 3,
        agree.cast("double"),
    )
    return pairs(pages).select("stream_id", F.col("a.page_number").alias("page_a"), F.col("b.page_number").alias("page_b"), *[v.alias(n) for n, v in zip(FEATURES, values)])


def rule_score() -> Column:
    total = sum(WEIGHTS)
    return sum((F.col(n) * (w / total) for n, w in zip(FEATURES, WEIGHTS)), F.lit(0.0))


def decisions(features: DataFrame, method: str = "baseline", threshold: float = THRESHOLD) -> DataFrame:
    """``stream_id, page_a, page_b, score, is_boundary, method``; a score under the threshold is a boundary.

    ``embedding`` scores by the first feature, ``baseline`` by the weighted rule; other names are an error.
    """
    if method not in ("baseline", "embedding"):
        raise ValueError(f"unknown method {method!r}")
    alone = method == "embedding"
    score = F.round(F.col(FEATURES[0]) if alone else rule_score(), 9)
    return features.select("stream_id", "page_a", "page_b", score.alias("score"), (score < threshold).alias("is_boundary"), F.lit("baseline_embedding_only" if alone else "baseline_weighted").alias("method"))


def page_groups(pages: DataFrame, decided: DataFrame) -> DataFrame:
    """``stream_id, page_number, group_no, kept_score``: running count of boundaries; a page keeps its score when it continues a group."""
    at = pages.select("stream_id", "page_number").join(decided.select("stream_id", F.col("page_b").alias("page_number"), "score", "is_boundary"), ["stream_id", "page_number"], "left")
    order = Window.partitionBy("stream_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.coalesce(F.col("is_boundary"), F.lit(False)).cast("int")).over(order) + 1
    return at.select("stream_id", "page_number", number.cast("int").alias("group_no"), F.when(~F.col("is_boundary"), F.col("score")).alias("kept_score"))


def groups(grouped: DataFrame) -> DataFrame:
    """Documents: ``stream_id, group_no, document_id, page_start, page_end, page_count, pages, group_confidence``; a single page is sure."""
    out = grouped.groupBy("stream_id", "group_no").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.count("*").alias("page_count"), F.array_join(F.array_sort(F.collect_list("page_number")), ",").alias("pages"), F.coalesce(F.avg("kept_score"), F.lit(1.0)).alias("group_confidence"))
    return out.withColumn("document_id", F.format_string("%s_doc_%03d", "stream_id", "group_no"))


def true_groups(pages: DataFrame) -> DataFrame:
    """``stream_id, page_number, group_no``: a boundary on the first page opens no empty group."""
    order = Window.partitionBy("stream_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("starts_new_document") & (F.col("page_number") > 1)).cast("int")
    return pages.select("stream_id", "page_number", (F.sum(opens).over(order) + 1).cast("int").alias("group_no"))


def true_pairs(pages: DataFrame) -> DataFrame:
    """``stream_id, page_a, page_b, is_boundary`` of adjacent pages."""
    order = Window.partitionBy("stream_id").orderBy("page_number")
    g = true_groups(pages).select("stream_id", "page_number", "group_no", F.lead("page_number").over(order).alias("page_b"), F.lead("group_no").over(order).alias("next"))
    return g.where("page_b is not null").select("stream_id", F.col("page_number").alias("page_a"), "page_b", (F.col("next") != F.col("group_no")).alias("is_boundary"))


def stream_metrics(pages: DataFrame, decided: DataFrame) -> DataFrame:
    """Precision, recall, F1 and page grouping accuracy of each stream of two pages or more.

    A missing prediction is no boundary; a ratio without cases is 0; accuracy compares the
    running numbers of groups.
    """
    truth = true_pairs(pages).withColumnRenamed("is_boundary", "truth")
    both = truth.join(decided.select("stream_id", "page_a", "page_b", F.col("is_boundary").alias("said")), ["stream_id", "page_a", "page_b"], "left").withColumn("said", F.coalesce("said", F.lit(False)))
    n = lambda c: F.sum(F.expr(c).cast("int"))
    counts = both.groupBy("stream_id").agg(F.count("*").alias("page_pairs"), n("truth and said").alias("tp"), n("not truth and said").alias("fp"), n("truth and not said").alias("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ratios = counts.withColumn("precision", zero(F.try_divide("tp", F.expr("tp + fp")))).withColumn("recall", zero(F.try_divide("tp", F.expr("tp + fn")))).withColumn("f1", zero(F.try_divide(F.expr("2.0 * tp"), F.expr("2 * tp + fp + fn"))))
    same = true_groups(pages).join(page_groups(pages, decided).select("stream_id", "page_number", F.col("group_no").alias("said")), ["stream_id", "page_number"])
    accuracy = same.groupBy("stream_id").agg(F.avg((F.col("group_no") == F.col("said")).cast("int")).alias("grouping_accuracy"))
    return ratios.join(accuracy, "stream_id")


def macro(per_stream: DataFrame, method: str) -> DataFrame:
    """Mean over streams, and numbers of streams and pairs."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1", "grouping_accuracy")]
    return per_stream.agg(F.count("*").alias("streams"), F.coalesce(F.sum("page_pairs"), F.lit(0)).alias("page_pairs"), *means).withColumn("method", F.lit(method))
