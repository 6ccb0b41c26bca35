"""Lines of a page as content blocks, blocks as sections, and nested documents of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.text import strip

#: A list line's mark, and what divides the columns of a table line.
LIST_LINE = r"(?U)^(-|\*|•|\d+[.)])\s+"
COLUMN = r"(?U)\s{2,}|\t+|\|"

_SINGLE, _TABLE, _LIST = 0, 1, 2


def list_like(text: Column) -> Column:
    return strip(text).rlike(LIST_LINE)


def table_columns(text: Column) -> Column:
    """Trimmed columns of a table line; null when there are fewer than two."""
    bare = F.regexp_replace(strip(text), r"^\|+|\|+$", "")
    parts = F.filter(F.transform(F.split(bare, COLUMN), strip), lambda c: c != "")
    return F.when(F.size(parts) >= 2, parts)


def line_flags(blocks: Column) -> Column:
    """For each block whether it is an image, looks like a table line and like a list line."""
    yes = lambda c: F.coalesce(c, F.lit(False))

    def flags(b: Column) -> Column:
        image, text = yes(b["block_type"] == "image"), F.coalesce(b["text"], F.lit(""))
        return F.struct(image.alias("image"), (~image & ~yes(b["is_heading"]) & table_columns(text).isNotNull()).alias("table"), list_like(text).alias("list"))

    return F.transform(blocks, flags)


def runs(flags: str) -> Column:
    """Runs of blocks from the column of their flags: array of (start, mode, size).

    Left to right: a started table or list goes on while its lines do; a list takes in lines
    that look like a table too. A table needs two lines and ends before images and headings.
    """
    run = "struct<start:int,mode:int,size:int>"
    seen = F.transform(flags, lambda f, i: F.struct(i.alias("i"), *[f[k].alias(k) for k in ("image", "table", "list")], (f["table"] & F.coalesce(F.get(flags, i + 1)["table"], F.lit(False))).alias("two")))
    empty = F.struct(F.lit(_SINGLE).alias("mode"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.array().cast(f"array<{run}>").alias("out"))
    closed = lambda s: F.when(s["size"] > 0, F.concat(s["out"], F.array(F.struct(s["start"], s["mode"], s["size"]).cast(run)))).otherwise(s["out"])

    def step(s: Column, f: Column) -> Column:
        goes_on = ((s["mode"] == _LIST) & f["list"]) | ((s["mode"] == _TABLE) & f["table"])
        mode = F.when(goes_on, s["mode"]).when(f["image"], _SINGLE).when(f["two"], _TABLE).when(f["list"], _LIST).otherwise(_SINGLE)
        return F.struct(mode.alias("mode"), F.when(goes_on, s["start"]).otherwise(f["i"]).alias("start"), F.when(goes_on, s["size"] + 1).otherwise(1).alias("size"), F.when(goes_on, s["out"]).otherwise(closed(s)).alias("out"))

    return F.aggregate(seen, empty, step, closed)


def content_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, packet_id, page_number, block_no, block``: content blocks of each page in order.

    ``block`` has type, text, headers, rows, items, bbox, source_block_type and
    source_block_count. A page without blocks but with text is one paragraph.
    """
    # flags and runs are columns of their own: inside a lambda they would be worked out again for each line
    b = pages.withColumn("blocks", F.coalesce("blocks", F.array().cast(pages.schema["blocks"].dataType))).withColumn("flags", line_flags(F.col("blocks"))).withColumn("runs", runs("flags"))

    def lines_of(r: Column) -> Column:
        mine = F.slice("blocks", r["start"] + 1, r["size"])
        return F.struct(r["mode"].alias("mode"), mine.alias("mine"), F.when(r["mode"] == _TABLE, F.transform(mine, lambda x: table_columns(x["text"]))).alias("lines"))

    def measured(r: Column) -> Column:
        return F.struct(r["mode"].alias("mode"), r["mine"].alias("mine"), r["lines"].alias("lines"), F.array_max(F.transform(r["lines"], F.size)).alias("width"))

    def padded_lines(r: Column) -> Column:
        padded = F.transform(r["lines"], lambda c: F.concat(c, F.array_repeat(F.lit(""), r["width"] - F.size(c))))
        return F.struct(r["mode"].alias("mode"), r["mine"].alias("mine"), padded.alias("padded"))

    def build(r: Column) -> Column:
        mine, padded = r["mine"], r["padded"]
        one = F.get(mine, F.lit(0))
        is_table, is_list = r["mode"] == _TABLE, r["mode"] == _LIST
        stripped = F.transform(mine, lambda x: strip(x["text"]))
        inner = F.filter(F.transform(F.split(one["text"], "\n"), strip), lambda x: x.rlike(LIST_LINE))
        image = F.coalesce(one["block_type"] == "image", F.lit(False))
        heading = F.coalesce(one["is_heading"], F.lit(False))
        listed = ~image & ~heading & (F.size(inner) >= 2)
        kind = F.when(is_table, "table").when(is_list, "list").when(image, "figure").when(heading, "heading").when(listed, "list").otherwise("paragraph")
        shown = F.when(F.coalesce(one["text"], F.lit("")) == "", F.format_string("Figure on page %d", F.col("page_number"))).otherwise(one["text"])
        text = F.when(is_table, F.array_join(F.transform(padded, lambda c: F.array_join(c, " | ")), "\n")).when(is_list, F.array_join(stripped, "\n")).when(image, shown).otherwise(one["text"])
        box = lambda f, k: f(F.transform(mine, lambda x: x[k]))
        many = is_table | is_list
        return F.struct(
            kind.alias("type"),
            text.alias("text"),
            F.when(is_table, F.get(padded, F.lit(0))).alias("headers"),
            F.when(is_table, F.slice(padded, F.lit(2), F.greatest(F.size(padded) - 1, F.lit(0)))).alias("rows"),
            F.when(is_list, stripped).when(listed & ~many, inner).alias("items"),
            F.array(box(F.array_min, "x0"), box(F.array_min, "y0"), box(F.array_max, "x1"), box(F.array_max, "y1")).alias("bbox"),
            F.when(~many, one["block_type"]).alias("source_block_type"),
            F.when(many, F.size(mine)).alias("source_block_count"),
        )

    built = F.transform(F.transform(F.transform(F.transform("runs", lines_of), measured), padded_lines), build)
    whole = strip(F.coalesce("text", F.lit("")))
    kind = "struct<type:string,text:string,headers:array<string>,rows:array<array<string>>,items:array<string>,bbox:array<double>,source_block_type:string,source_block_count:int>"
    fallback = F.array(F.struct(F.lit("paragraph").alias("type"), whole.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("headers", "array<string>"), ("rows", "array<array<string>>"), ("items", "array<string>"), ("bbox", "array<double>"), ("source_block_type", "string"), ("source_block_count", "int"))]))
    out = F.when(F.size("blocks") > 0, built.cast(f"array<{kind}>")).when(whole != "", fallback.cast(f"array<{kind}>"))
    return b.select("page_id", "packet_id", "page_number", F.posexplode(out).alias("block_no", "block"))


def sectioned(blocks: DataFrame, document: str) -> DataFrame:
    """Adds ``section_no``: the running number of headings in the document, 0 before the first."""
    order = Window.partitionBy(document).orderBy("page_number", "page_id", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section_no", F.sum((F.col("block.type") == "heading").cast("int")).over(order).cast("int"))


def sections(blocks: DataFrame, document: str) -> DataFrame:
    """``document, section_no, heading, page, block_count``; a heading without blocks stays only at the end."""
    s = sectioned(blocks, document)
    is_heading = F.col("block.type") == "heading"
    first = lambda c: F.min_by(c, F.struct("page_number", "page_id", "block_no"))
    g = s.groupBy(document, "section_no").agg(F.max(F.when(is_heading, F.col("block.text"))).alias("heading"), first(F.col("page_number")).alias("page"), F.sum((~is_heading).cast("int")).alias("block_count"))
    last = F.max("section_no").over(Window.partitionBy(document))
    return g.withColumn("last", last).where((F.col("block_count") > 0) | ((F.col("section_no") == F.col("last")) & (F.coalesce("heading", F.lit("")) != ""))).drop("last")


def titles(blocks: DataFrame, pages: DataFrame, document: str) -> DataFrame:
    """``document, title``: the first section's heading, else the first line of the first page."""
    kept = sections(blocks, document)
    first = kept.groupBy(document).agg(F.min_by("heading", "section_no").alias("heading"))
    line = F.substring(F.split(strip(F.coalesce("text", F.lit(""))), "\n")[0], 1, 200)
    start = pages.groupBy(document).agg(F.min_by(line, F.struct("page_number", "page_id")).alias("line"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return start.join(first, document, "left").select(document, F.coalesce(blank("heading"), blank("line")).alias("title"))
