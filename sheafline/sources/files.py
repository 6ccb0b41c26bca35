"""Files in and out: structured documents as JSON, whole texts, recognised pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions.text import strip
from sheafline.sources import schemas

#: Pages with fewer characters need recognition.
SHORT_TEXT = 50


#: Names of files that Spark wrote, with a document a line, and of all others.
_WRITTEN, _OTHERS = "part-*.json", "{[!p],p[!a],pa[!r],par[!t],part[!-]}*.json"


def structured_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all JSON files of a folder and its subfolders, with the declared schema.

    Files named ``part-...`` hold a document a line, as ``write_documents`` leaves them; any other
    file holds one document, pretty-printed or not, or a list of documents.
    """
    reader = lambda names: spark.read.schema(schemas.DOCUMENT).option("recursiveFileLookup", True).option("pathGlobFilter", names)
    return reader(_OTHERS).option("multiLine", True).json(folder).unionByName(reader(_WRITTEN).json(folder))


def write_documents(documents: DataFrame, folder: str) -> None:
    """JSON lines, the id being in each row; timestamps in ISO form."""
    documents.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").json(folder)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of each text file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def needs_ocr(pages: DataFrame, engine: str = "none") -> DataFrame:
    """Pages for recognition: short texts and pages with a warning; none without an engine."""
    if engine == "none":
        return pages.where(F.lit(False))
    return pages.where((F.length(strip(F.coalesce("text", F.lit("")))) < SHORT_TEXT) | F.coalesce(F.array_contains("warnings", "empty_native_text"), F.lit(False)))


def recognised(pages: DataFrame, read) -> DataFrame:
    """Pages with the results of ``read``: a function of the pages that need it giving ``page_id, ocr_text, ocr_confidence``.

    The text is replaced and stripped, blocks stay; a blank result leaves a warning.
    """
    found = read(needs_ocr(pages, "given")).select("page_id", strip("ocr_text").alias("ocr_text"), "ocr_confidence")
    both = pages.join(found, "page_id", "left")
    did = F.col("ocr_text").isNotNull()
    warned = F.when(did & (F.col("ocr_text") == ""), F.array_append(F.coalesce("warnings", F.array().cast("array<string>")), "ocr_empty_result")).otherwise(F.col("warnings"))
    return both.withColumn("text", F.when(did, F.col("ocr_text")).otherwise(F.col("text"))).withColumn("extraction_method", F.when(did, "ocr").otherwise(F.col("extraction_method"))).withColumn("warnings", warned).drop("ocr_text")
