"""Texts cut off by field limits or broken transfers.

Intact texts are cut artificially to make positives; a hashed logistic regression on the
closing characters, the shape of the last lines and the length against the source's own
limits is fitted on them and scores every record.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions.text import source_key, strip
from sheafline.plans.storage import small_or_shuffled, stored
from sheafline.sources.tables import table

#: The classifier is fitted on at most so many texts; counts of lengths and scores cover all.
SAMPLE_ROWS = 20_000
#: A length is a limit of its source when so large a share of its texts, and so many, have it.
LIMIT_SHARE, LIMIT_COUNT = 0.01, 5
FEATURES = 1 << 14
#: Texts shorter than this are not cut for training.
LEAST_CUT = 40
#: Texts of fewer words and characters hold no sentence that could be cut: they are whole.
NO_SENTENCE_WORDS, NO_SENTENCE_LENGTH = 4, 20
#: Signs of omission that positives get at their ends.
OMISSIONS = ("", "", "", "…", "...", " [...]")

_PIECE = re.compile(r"[^\W\d_]+|\d+|\s+|[^\w\s]|_")
_OMITTED = re.compile(r"(…|\.\.\.|\[\s*(?:\.\.\.|…)\s*\])$")
_SMALL = {"of", "at", "to", "and", "for", "the", "a", "in", "by", "with", "on"}


def _shape(line: str) -> list[str]:
    """Kinds of a line's pieces: small words as they are, other words and numbers by kind."""
    out = []
    for piece in _PIECE.findall(line):
        if piece.isspace():
            kind = "_" if len(piece) > 1 else None
        elif piece[0].isdigit():
            kind = f"9{min(len(piece), 4)}" if len(line) < 60 else "9"
        elif piece[0].isalpha():
            lower = piece.lower()
            kind = lower if lower in _SMALL else "W" if piece.isupper() and len(piece) > 1 else "C" if piece[0].isupper() else "w"
        else:
            kind = piece
        if kind is not None:
            out.append(kind)
    return out


def ending(text: str, at_limit: bool) -> list[str]:
    """Features of one text's end, as strings for hashing."""
    tail = text[-400:].rstrip()
    if not tail:
        return ["blank"]
    omitted = _OMITTED.search(tail)
    body = tail[: omitted.start()].rstrip() if omitted else tail
    lines = [x for x in body.split("\n") if x.strip()]
    last = lines[-1] if lines else ""
    shape = _shape(last)
    final = body[-1:] if body else ""
    kind = final if final and not final.isalnum() else "9" if final.isdigit() else "u" if final.isupper() else "l"
    signed = next((k for k in (1, 2, 3) if len(lines) > k and re.match(r"\W*(with|kind|best)?\s*(regards|sincerely|yours)\b", lines[-1 - k].strip().lower())), 0)
    head = shape[0] if shape else ""
    first = last.strip().split(" ")[0][:12]
    lead = first if first.endswith(":") or first in ("-", "*", "•", "Total", "Subtotal") else head
    table = "".join(x if x in ("_", ":", "-") or x[0] == "9" else "" for x in shape)[-8:]
    since = re.split(r"[.!?。؟।:](?=\s|$|[^\x00-\x7f])", last)[-1].split()
    far = "0" if not since else "1" if len(since) < 4 else "4" if len(since) < 11 else "11"
    f = [
        f"kind={kind}",
        f"omitted={bool(omitted)}",
        f"kind+far={kind}|{far}",
        f"end={'|'.join(shape[-3:])}",
        f"lead={lead}|{kind}",
        f"lead+end={lead}|{'|'.join(shape[-2:])}",
        f"line={'|'.join(shape[:9])}" if len(shape) < 10 else "line=long",
        f"table={table}|{kind}" if "_" in shape else f"pieces={min(len(shape), 12)}|{kind}",
        f"signed={signed}|{kind}",
        f"signed+line={signed}|{'|'.join(shape[:7])}" if signed else "unsigned",
        f"length={min(len(last) // 16, 5)}|{kind}",
        f"length+signed={min(len(last) // 16, 5)}|{kind}|{bool(signed)}|{lead[-1:] == ':'}",
        f"open={kind in 'lu9,;-(' and lead[-1:] != ':'}|{len(last) > 47}|{bool(signed)}",
        f"limit={at_limit}",
        f"limit+kind={at_limit}|{kind}",
    ]
    pieces = len(text.split()) if len(text) < 60 else 6
    if pieces < 6:
        f += [f"few={pieces}", f"few={pieces}|{kind}"]
    return f + (["cut off"] if text.endswith(" ") and kind in "l9u," else []) + (["broken"] if "�" in tail[-3:] else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _endings(text: pd.Series, at_limit: pd.Series) -> pd.Series:
    return pd.Series([ending(t, bool(a)) for t, a in zip(text, at_limit)], dtype=object)


def length_limits(docs: DataFrame) -> DataFrame:
    """``key, size``: lengths that are limits of a source, from the lengths of all its texts."""
    sizes = docs.groupBy("key", "size").agg(F.count("*").alias("n"))
    sizes = stored(sizes)
    source = sizes.groupBy("key").agg(F.sum("n").alias("all"))
    return sizes.join(source, "key").where((F.col("n") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_SHARE * F.col("all"))).select("key", "size")


def _dice(seed: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(10_000)) / 10_000.0


def training_rows(docs: DataFrame) -> DataFrame:
    """``text, at_limit, label``: intact texts, and the same texts cut at a random place."""
    intact = docs.where("not at_limit").where(~strip("text").rlike(r"(…|\.\.\.|\[\.\.\.\])$"))
    whole = intact.select("text", (_dice(1) < 0.15).alias("at_limit"), F.lit(0.0).alias("label"))
    # most cuts leave a long text, one in four leaves a short one
    far = F.when(_dice(6) < 0.25, 20 + (F.least(F.length("text"), F.lit(240)) - 20) * 0.95 * _dice(2)).otherwise(F.length("text") * (0.3 + 0.65 * _dice(2)))
    at = F.least(far, F.length("text") - 3).cast("int")
    sign = F.element_at(F.array(*[F.lit(x) for x in OMISSIONS]), (_dice(3) * len(OMISSIONS)).cast("int") + 1)
    cut = intact.where(F.length("text") >= LEAST_CUT).select(F.concat(F.substring("text", F.lit(1), at), sign).alias("text"), (_dice(4) < 0.5).alias("at_limit"), F.lit(1.0).alias("label"))
    return whole.unionByName(cut)


def fit(docs: DataFrame) -> PipelineModel:
    """The classifier, fitted on a hashed sample of at most SAMPLE_ROWS texts."""
    total = docs.count()
    share = min(1.0, 0.95 * SAMPLE_ROWS / max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(SAMPLE_ROWS)
    rows = stored(training_rows(sample).select(_endings("text", "at_limit").alias("ends"), "label"))
    hashing = HashingTF(inputCol="ends", outputCol="features", numFeatures=FEATURES, binary=True)
    regression = LogisticRegression(maxIter=40, regParam=1e-3, standardization=False)
    if rows.select("label").distinct().count() < 2:
        return PipelineModel([])
    hashed = hashing.transform(rows).select("features", "label").coalesce(4).cache()
    model = regression.fit(hashed)
    # some texts taken as intact are cut themselves: those that look so are left out of a second fit
    doubtful = (F.col("label") == 0) & (vector_to_array("probability")[1] > 0.5)
    clean = model.transform(hashed).where(~doubtful).select("features", "label").cache()
    model = regression.fit(clean)
    hashed.unpersist()
    clean.unpersist()
    return PipelineModel([hashing, model])


def truncated(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, source, score`` of every row, and whether it is ``truncated``.

    Null texts are not truncated (score null), nor are blank ones and a few words alone (0). A null source has its own
    limits. Repeated rows count once. Texts of any length are measured whole, though only
    their ends make features. An empty table, or one without texts to cut, gives no truncated
    row. Only ``doc_id``, ``text`` and ``source`` are read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "source").distinct()
    keyed = docs.withColumn("key", F.coalesce(source_key("source"), F.lit(""))).withColumn("size", F.length("text"))
    limits = small_or_shuffled(stored(length_limits(keyed.where("text is not null").select("key", "size"))).withColumn("limited", F.lit(True)))
    known = keyed.join(limits, ["key", "size"], "left").withColumn("at_limit", F.coalesce("limited", F.lit(False)))
    texts = known.where("text is not null").select("text", "at_limit")
    model = fit(texts)
    if not model.stages:
        return docs.select("doc_id", "source", F.lit(None).cast("double").alias("score"), F.lit(False).alias("truncated"))
    ends = known.withColumn("ends", _endings(F.coalesce("text", F.lit("")), "at_limit")).select("doc_id", "source", "text", "ends")
    scored = model.transform(ends).select("doc_id", "source", "text", vector_to_array("probability")[1].alias("p"))
    bare = strip("text")
    no_sentence = (F.length(bare) < NO_SENTENCE_LENGTH) & (F.size(F.split(bare, r"(?U)\s+")) < NO_SENTENCE_WORDS)
    score = F.when(F.col("text").isNull(), None).when(no_sentence, 0.0).otherwise(F.col("p"))
    return scored.select("doc_id", "source", score.alias("score")).withColumn("truncated", F.coalesce(F.col("score") > threshold, F.lit(False)))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(table(spark, folder, "documents", "doc_id", "text", "source")).where("truncated").select("doc_id").distinct()


def p9_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, truncated ones and their share by source."""
    rows = truncated(table(spark, folder, "documents", "doc_id", "text", "source"))
    return rows.groupBy(source_key("source").alias("source")).agg(F.count("*").alias("documents"), F.sum(F.col("truncated").cast("int")).alias("truncated")).withColumn("share", F.col("truncated") / F.col("documents"))


QUERIES = {"p9_found": p9_found, "p9_sources": p9_sources}
SQL: dict[str, str] = {}
