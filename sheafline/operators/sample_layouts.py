"""Four layouts of packet samples as page groups with types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.operators.page_types import UNKNOWN


def documents_layout(samples: DataFrame) -> DataFrame:
    """``packet_id, documents array<struct<pages, document_type>>``: each document's sorted pages."""
    d = samples.select("packet_id", F.posexplode("documents").alias("no", "d"))
    return d.select("packet_id", (F.col("no") + 1).alias("group_no"), F.array_join(F.array_sort(F.col("d.pages")), ",").alias("pages"), F.coalesce("d.document_type", F.lit(UNKNOWN)).alias("document_type"))


def labelled_pages_layout(samples: DataFrame) -> DataFrame:
    """``packet_id, page_labels, document_ids``: pages by document id, wherever they stand; the type is the last label."""
    p = samples.select("packet_id", F.posexplode(F.arrays_zip("page_labels", "document_ids")).alias("no", "x"))
    label = F.when(F.coalesce("x.page_labels", F.lit("")) != "", F.col("x.page_labels"))
    g = p.groupBy("packet_id", F.col("x.document_ids").alias("document")).agg(F.min("no").alias("first"), F.array_join(F.array_sort(F.collect_list(F.col("no") + 1)), ",").alias("pages"), F.coalesce(F.max_by(label, F.when(label.isNotNull(), F.col("no"))), F.lit(UNKNOWN)).alias("document_type"))
    return g.select("packet_id", F.col("document").cast("string").alias("document"), "pages", "document_type")


def boundaries_layout(samples: DataFrame) -> DataFrame:
    """``packet_id, boundaries, num_pages``: boundaries are the last pages of groups; the rest is one more."""
    ends = F.array_sort("boundaries")
    last = F.coalesce(F.array_max("boundaries"), F.lit(0))
    ends = F.when(last < F.col("num_pages"), F.concat(ends, F.array("num_pages"))).otherwise(ends)
    e = samples.select("packet_id", F.posexplode(F.transform(ends, lambda x, i: F.struct((F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1).alias("a"), x.alias("b")))).alias("no", "x"))
    return e.select("packet_id", (F.col("no") + 1).alias("group_no"), F.array_join(F.sequence("x.a", "x.b"), ",").alias("pages"), F.lit(UNKNOWN).alias("document_type"))


def labels_layout(samples: DataFrame) -> DataFrame:
    """``packet_id, labels``: runs of equal neighbouring labels."""
    p = samples.select("packet_id", F.posexplode("labels").alias("no", "x")).select("packet_id", "no", F.coalesce(F.col("x").cast("string"), F.lit("None")).alias("label"))
    order = Window.partitionBy("packet_id").orderBy("no")
    starts = F.coalesce(F.col("label") != F.lag("label").over(order), F.lit(True)).cast("int")
    runs = p.withColumn("starts", starts).withColumn("group_no", F.sum("starts").over(order).cast("int"))
    return runs.groupBy("packet_id", "group_no").agg(F.array_join(F.array_sort(F.collect_list(F.col("no") + 1)), ",").alias("pages"), F.min("label").alias("document_type"))


def no_layout(samples: DataFrame) -> DataFrame:
    """Samples in no known layout: one page of unknown type."""
    return samples.select("packet_id", F.lit(1).alias("group_no"), F.lit("1").alias("pages"), F.lit(UNKNOWN).alias("document_type"))


def annotations(samples: DataFrame, grouped: DataFrame) -> DataFrame:
    """``packet_id, page_count, groups, document_types, pdf_path``: one row a packet with the groups of one of the layouts.

    ``groups`` has the pages of each group and ``document_types`` its type, by first page. The
    page count is the highest page, or ``num_pages`` where the sample says more; the path is
    ``pdf_path`` or ``file_name``. Columns that samples lack count as null.
    """
    has = lambda c, kind: F.col(c).cast(kind) if c in samples.columns else F.lit(None).cast(kind)
    pages = F.transform(F.split("pages", ","), lambda x: x.cast("int"))
    of = grouped.select("packet_id", pages.alias("p"), "document_type").groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct(F.array_min("p").alias("first"), "p", "document_type"))).alias("g"))
    held = samples.select("packet_id", has("num_pages", "int").alias("num_pages"), F.coalesce(has("pdf_path", "string"), has("file_name", "string")).alias("pdf_path"))
    highest = F.array_max(F.transform("g", lambda x: F.array_max(x["p"])))
    return held.join(of, "packet_id", "left").select("packet_id", F.greatest(F.coalesce(highest, F.lit(0)), "num_pages").alias("page_count"), F.transform("g", lambda x: x["p"]).alias("groups"), F.transform("g", lambda x: x["document_type"]).alias("document_types"), "pdf_path")


def packet_named(samples: DataFrame, number: str = "sample_no") -> DataFrame:
    """Samples with a ``packet_id``: their ``id``, else their ``packet_id``, else ``packet_`` and their number."""
    own = [F.col(c).cast("string") for c in ("id", "packet_id") if c in samples.columns]
    made = [F.concat(F.lit("packet_"), F.col(number).cast("string"))] if number in samples.columns else []
    return samples.withColumn("packet_id", F.coalesce(*own, *made))
