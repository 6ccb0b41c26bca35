"""Structured documents as retrieval chunks that keep their provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.text import chunk_id, strip

CHUNK_SIZE, OVERLAP = 1000, 100
#: A label is a paragraph line of at most so many characters that ends in a colon.
LABEL_LENGTH = 80


def windows(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """A text of at most ``size`` characters whole, a longer one in windows that overlap."""
    overlap = max(0, min(overlap, size - 1))
    step = size - overlap
    count = F.ceil((F.length(text) - overlap) / step).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(cut)


def block_text(block: str) -> Column:
    """Text of a block: a table's lines, a list's items, a figure's caption, else its own."""
    b = F.col(block)
    row = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    table = (b["type"] == "table") & (F.size(b["headers"]) > 0) & (F.size(b["rows"]) > 0)
    items = (b["type"] == "list") & (F.size(b["items"]) > 0)
    own = F.coalesce(b["text"], F.lit(""))
    return (
        F.when(table, F.array_join(F.concat(F.array(row(b["headers"])), F.transform(F.filter(b["rows"], lambda r: r.isNotNull()), row)), "\n"))
        .when(items, F.array_join(F.filter(b["items"], lambda i: i.isNotNull()), "\n"))
        .when((b["type"] == "figure") & (own == ""), "Figure")
        .otherwise(own)
    )


def blocks_of(documents: DataFrame) -> DataFrame:
    """One row for each non-null block: ids, ``section_no, block_no, heading, b, text``."""
    s = documents.select("document_id", "document_type", F.posexplode("content.sections").alias("section_no", "s"))
    b = s.select("document_id", "document_type", "section_no", F.col("s.heading").alias("heading"), F.posexplode("s.blocks").alias("block_no", "b")).where("b is not null")
    return b.withColumn("text", block_text("b"))


def chunks(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_id, document_id, document_type, page_start, page_end, section, text, block_type, merged_label``.

    A label takes in the next block when that has text and is no table or figure; of labels in
    a row every second one is taken in. A document without chunks gives its title. Documents
    with the same id and content count once; null blocks are passed over.
    """
    documents = documents.select("document_id", "document_type", "content", "source").withColumn("h", F.xxhash64("content")).dropDuplicates(["document_id", "h"])
    rows = blocks_of(documents)
    blank = strip("text") == ""
    label = (F.col("b.type") == "paragraph") & ~F.contains(strip("text"), F.lit("\n")) & strip("text").endswith(":") & (F.length(strip("text")) <= LABEL_LENGTH)
    rows = rows.withColumn("blank", blank).withColumn("label", label & ~blank)
    section = Window.partitionBy("document_id", "section_no").orderBy("block_no")
    rows = rows.withColumn("at", F.row_number().over(section)).withColumn("in_run", F.row_number().over(Window.partitionBy("document_id", "section_no", "label").orderBy("block_no")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("document_id", "section_no", "label", F.col("at") - F.col("in_run")).orderBy("block_no")))
    ahead = lambda c: F.lead(c).over(section)
    takes = F.col("label") & (F.col("place") % 2 == 1) & F.coalesce(~ahead("blank") & ~ahead("b.type").isin("table", "figure"), F.lit(False))
    rows = rows.withColumn("takes", takes).withColumn("next_text", ahead("text")).withColumn("next_page", ahead("b.page"))
    rows = rows.withColumn("taken", F.coalesce(F.lag("takes").over(section), F.lit(False))).where("not taken and not blank")
    text = F.when(F.col("takes"), F.concat(strip("text"), F.lit("\n"), strip("next_text"))).otherwise(strip("text"))
    parts = rows.select(
        "document_id", "document_type", "section_no", "block_no", F.col("b.page").alias("page_start"), F.when(F.col("takes"), F.col("next_page")).otherwise(F.col("b.page")).alias("page_end"), F.col("heading").alias("section"),
        F.when(F.col("takes"), "merged").otherwise(F.col("b.type")).alias("block_type"), F.when(F.col("takes"), strip("text")).alias("merged_label"), F.posexplode(windows(text, size, overlap)).alias("part", "part_text"),
    )
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("section_no", "block_no", "part"))
    made = parts.select(chunk_id("document_id", number).alias("chunk_id"), "document_id", "document_type", "page_start", "page_end", "section", strip("part_text").alias("text"), "block_type", "merged_label")
    bare = documents.where(F.coalesce("content.title", F.lit("")) != "").join(made.select("document_id").distinct(), "document_id", "left_anti")
    only = bare.select(chunk_id("document_id", F.lit(1)).alias("chunk_id"), "document_id", "document_type", F.col("source.page_start").alias("page_start"), F.col("source.page_end").alias("page_end"), F.lit(None).cast("string").alias("section"), F.col("content.title").alias("text"), F.lit(None).cast("string").alias("block_type"), F.lit(None).cast("string").alias("merged_label"))
    return made.unionByName(only.distinct())
