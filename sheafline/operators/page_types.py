"""Document types from a keyword lexicon, and from prototypes of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import col
from sheafline.plans.storage import small_or_shuffled, stored

#: Types and their phrases; the order decides ties.
LEXICON = {
    "invoice": ("invoice", "bill to", "total amount", "subtotal"),
    "resume": ("resume", "curriculum vitae", "experience", "education", "skills"),
    "passport": ("passport", "nationality", "date of birth", "place of birth"),
    "contract": ("agreement", "contract", "terms and conditions", "party"),
    "receipt": ("receipt", "paid", "transaction"),
    "letter": ("dear", "sincerely", "to whom it may concern"),
    "report": ("executive summary", "introduction", "conclusion", "abstract"),
    "form": ("application form", "please fill", "checkbox"),
}
UNKNOWN = "unknown"


def _hits(low: str, phrases: tuple[str, ...]) -> Column:
    """Number of phrases in a lower-cased text; a plain search comes first, the pattern decides on word ends."""
    return sum((F.when(F.contains(low, F.lit(p)), F.col(low).rlike(rf"\b{p}\b").cast("int")).otherwise(0) for p in phrases), F.lit(0))


def classified(df: DataFrame, text: str = "text", top: int = 3) -> DataFrame:
    """Adds ``document_type``, ``confidence`` and the ``top`` candidates; no match is unknown with 0.

    The hits are counted in generated code, before the array functions that rank the types.
    """
    counted = df.withColumn("_low", F.lower(F.coalesce(col(text), F.lit("")))).select(*df.columns, *[_hits("_low", phrases).alias(f"_hits_{name}") for name, phrases in LEXICON.items()])
    scored = []
    for place, (name, phrases) in enumerate(LEXICON.items()):
        confidence = F.col(f"_hits_{name}") / len(phrases)
        scored.append(F.struct((-confidence).alias("order"), F.lit(place).alias("place"), F.lit(name).alias("type"), confidence.alias("confidence")))
    ranked = F.array_sort(F.filter(F.array(*scored), lambda s: s["confidence"] > 0))
    candidates = F.transform(F.slice(ranked, 1, top), lambda s: F.struct(s["type"].alias("type"), s["confidence"].alias("confidence")))
    out = counted.select(*df.columns, candidates.alias("candidates"))
    best = F.get("candidates", F.lit(0))
    return out.withColumn("document_type", F.coalesce(best["type"], F.lit(UNKNOWN))).withColumn("confidence", F.coalesce(best["confidence"], F.lit(0.0)))


def more_confident(embedding: Column, heuristic: Column) -> Column:
    """The embedding's (type, confidence) only where it is strictly more confident."""
    return F.when(embedding["confidence"] > heuristic["confidence"], embedding).otherwise(heuristic)


def prototypes(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, dim, value``: mean vector of each label; null labels and vectors are left out."""
    parts = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vector).alias("dim", "x"))
    return parts.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def nearest_prototype(vectors: DataFrame, means: DataFrame, key: str, vector: str, least: float = 0.3) -> DataFrame:
    """``key, document_type, confidence``: label of the prototype with the largest cosine, clipped
    to [0, 1]; under ``least``, or without a vector, unknown. The prototypes, one for each label,
    are broadcast after a check of their size."""
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("p")).select("label", F.col("p.value").alias("p"))
    dot = F.aggregate(F.zip_with("v", "p", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda a: a * a), F.lit(0.0), lambda t, x: t + x))
    both = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).join(small_or_shuffled(stored(packed)), F.lit(True), "left")
    cosine = F.when((norm("v") > 0) & (norm("p") > 0), dot / (norm("v") * norm("p"))).otherwise(0.0)
    scored = both.withColumn("cosine", F.coalesce(cosine, F.lit(0.0)))
    best = scored.groupBy("key").agg(F.max_by(F.struct("label", "cosine"), F.struct(F.round("cosine", 9), -F.hash("label"))).alias("b"))
    sure = F.least(F.greatest(F.col("b.cosine"), F.lit(0.0)), F.lit(1.0))
    return best.select("key", F.when(sure >= least, F.col("b.label").cast("string")).otherwise(UNKNOWN).alias("document_type"), sure.alias("confidence"))
