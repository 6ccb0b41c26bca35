"""Evidence retrieval: index, top-N search, post-filter, normalised scores, reranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.similarity import DIMENSIONS, bucket, space_words
from sheafline.functions.text import strip, tokens
from sheafline.plans.storage import small_or_shuffled, stored

TOP_N, RERANK_N, TOP_K, VECTOR_WEIGHT = 50, 20, 5, 0.4
#: Queries that are scored together against every row of the index.
QUERY_BLOCK = 2_000
#: Chunks of a part of the index, and how many of them are scored at once.
INDEX_PART, SLICE = 20_000, 4_000


def hash_index(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, bucket, weight``: sparse hash embedding of each text, of length one."""
    words = chunks.select(key, F.explode(space_words(text)).alias("w"))
    counts = words.groupBy(key, bucket("w").alias("bucket")).agg(F.count("*").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def normalize_query(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def _best(top_n: int, matrix: Callable, floor: float):
    """The ``top_n`` chunks above ``floor`` of each query of a block among those of a part of the index."""

    def run(asked: pa.Table, part: pa.Table) -> pa.Table:
        out = {"query_id": [asked["query_id"].slice(0, 0)], "chunk_id": [part["chunk_id"].slice(0, 0)], "score": [pa.chunked_array([], pa.float64())]}
        if asked.num_rows and part.num_rows:
            queries, q = matrix(asked, "query_id")
            chunks, c = matrix(part, "chunk_id")
            if q.shape[1] != c.shape[1]:
                raise ValueError(f"queries of {q.shape[1]} numbers, an index of {c.shape[1]}")
            for begin in range(0, len(chunks), SLICE):
                score = q @ c[begin : begin + SLICE].T
                # chunks are in order of id, so equal scores are too
                order = np.argsort(-np.round(score, 6), axis=1, kind="stable")[:, :top_n]
                found = np.take_along_axis(score, order, axis=1)
                row, place = np.nonzero(~(found <= floor))
                for name, column in (("query_id", queries.take(pa.array(row))), ("chunk_id", chunks.take(pa.array(begin + order[row, place]))), ("score", pa.array(found[row, place]))):
                    out[name].append(column)
        return pa.table({name: pa.chunked_array([piece for c in columns for piece in (c.chunks if isinstance(c, pa.ChunkedArray) else [c])], type=columns[0].type) for name, columns in out.items()})

    return run


def _sparse(rows: pa.Table, key: str) -> tuple[pa.Array, np.ndarray]:
    """Keys in order and a row of summed weights for each."""
    column = rows[key].combine_chunks()
    keys = column.unique()
    keys = keys.take(pc.sort_indices(keys))
    cell = pc.index_in(column, keys).to_numpy(zero_copy_only=False).astype(np.int64) * DIMENSIONS + rows["bucket"].to_numpy()
    return keys, np.bincount(cell, rows["weight"].to_numpy(), minlength=len(keys) * DIMENSIONS).reshape(len(keys), DIMENSIONS)


def _vector_of(key: str) -> str:
    """Vectors have a name for each side, as both sides may come from one table."""
    return key.replace("_id", "_vector")


def _dense(rows: pa.Table, key: str) -> tuple[pa.Array, np.ndarray]:
    """Keys in order, repeats kept, and the vector of each."""
    rows = rows.take(pc.sort_indices(rows[key].combine_chunks()))
    vectors = rows[_vector_of(key)].combine_chunks()
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) != 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    return rows[key].combine_chunks(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), lengths[0]).astype(np.float64)


def _met(queries: DataFrame, index: DataFrame, asked: int, held: int, top_n: int, matrix: Callable, floor: float) -> DataFrame:
    """``query_id, chunk_id, score``: blocks of queries meet parts of the index, both of bounded size,
    and send on only the best ``top_n`` of a part."""
    blocks, parts = (max(1, -(-n // size)) for n, size in ((asked, QUERY_BLOCK), (held, INDEX_PART)))
    at = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("block", at("query_id", blocks)).withColumn("part", every(parts))
    right = index.withColumn("part", at("chunk_id", parts)).withColumn("block", every(blocks))
    kinds = dict(queries.dtypes)["query_id"], dict(index.dtypes)["chunk_id"]
    hits = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_best(top_n, matrix, floor), "query_id {}, chunk_id {}, score double".format(*kinds))
    return hits.withColumn("score", F.round("score", 6))


def search(queries: DataFrame, index: DataFrame, ids: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``top_n`` chunks of each query by inner product.

    Both sides are sparse ``(id, bucket, weight)``; chunks that share no bucket score 0 and
    still fill the list when fewer others do. ``ids`` has every chunk; a query without words
    finds nothing.
    """
    asked = queries.select("query_id").distinct()
    hits = stored(_met(queries.select("query_id", "bucket", "weight"), index.select("chunk_id", "bucket", "weight"), asked.count(), ids.count(), top_n, _sparse, 0.0))
    # the first chunks by id are enough to fill any list
    first = [F.lit(r[0]) for r in ids.select("chunk_id").distinct().orderBy("chunk_id").limit(top_n).collect()]
    fill = asked.withColumn("chunk_id", F.explode(F.array(*first).cast(f"array<{dict(index.dtypes)['chunk_id']}>")))
    zeros = fill.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.unionByName(zeros).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def dense_search(queries: DataFrame, index: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """``query_id, chunk_id, score, rank`` by inner product of dense vectors of one length.

    Queries are ``(query_id, vector)``, the index is ``(chunk_id, vector)``. Null vectors take
    no part; vectors of different lengths are an error; equal scores are ranked by id.
    """
    queries, index = (side.where("vector is not null").select(key, F.col("vector").alias(_vector_of(key))) for side, key in ((queries, "query_id"), (index, "chunk_id")))
    hits = _met(queries, index, queries.count(), index.count(), top_n, _dense, -np.inf)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def min_max(score: Column, query: str = "query_id") -> Column:
    """Scores of one query between 0 and 1; all 1 when they are equal."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(low == high, 1.0).otherwise((score - low) / (high - low))


def combined(vector: Column, rerank: Column, weight: float = VECTOR_WEIGHT) -> Column:
    return F.when(rerank.isNull(), vector).otherwise(vector * weight + rerank * (1 - weight))


def evidence(found: DataFrame, top_k: int = TOP_K, document_type: str | None = None, rerank: Column | None = None) -> DataFrame:
    """Ranked evidence from ``search`` results joined with their chunks.

    The type is filtered after the top-N, so fewer than ``top_k`` may be left. Without a
    reranker scores are min-max normalised over all candidates left. With one, the first
    RERANK_N are ordered by it and scored by both.
    """
    if document_type is not None:
        found = found.where(F.col("document_type") == document_type)
    by = Window.partitionBy("query_id")
    if rerank is None:
        scored = found.withColumn("vector_score", F.col("score")).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("score", min_max(F.col("score")))
        return scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc("vector_score"), "chunk_id"))).where(F.col("rank") <= top_k)
    first = found.withColumn("at", F.row_number().over(by.orderBy(F.desc("score"), "chunk_id"))).where(F.col("at") <= RERANK_N)
    both = first.withColumn("vector_score", F.col("score")).withColumn("raw", rerank)
    both = both.withColumn("rerank_score", min_max(F.col("raw"))).withColumn("score", combined(min_max(F.col("vector_score")), F.col("rerank_score")))
    return both.withColumn("rank", F.row_number().over(by.orderBy(F.desc("rerank_score"), "at"))).where(F.col("rank") <= top_k).drop("raw", "at")


def token_overlap(query: str, text: str) -> Column:
    """Offline reranker: share of the query's words in the text."""
    q, t = tokens(query), tokens(text)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(q, t)) / F.size(q), 6))


def relevant(chunks: DataFrame, truth: DataFrame) -> DataFrame:
    """``query_id, chunk_id``: chunks of the wanted type that contain the wanted text, in lower case."""
    wanted = truth.select("query_id", F.col("document_type").alias("t"), F.lower("match_text").alias("m"))
    return chunks.join(small_or_shuffled(stored(wanted)), (F.col("document_type") == F.col("t")) & F.contains(F.lower("text"), F.col("m"))).select("query_id", "chunk_id").distinct()


def query_metrics(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall and precision at ``ks``, reciprocal rank, nDCG at 5 and top-1 hit of each query.

    The ideal order of nDCG is that of the retrieved hits alone. A query without relevant
    chunks has recall 0; precision divides by k whatever was returned.
    """
    r = ranked.select("query_id", "chunk_id", "rank").join(truth.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left").fillna(0, ["hit"])
    total = truth.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    gain = F.sum(F.when(F.col("rank") <= 5, F.col("hit") / F.log2(F.col("rank") + 1.0)))
    g = r.groupBy("query_id").agg(*[hits(k).alias(f"h{k}") for k in ks], F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), gain.alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("h5"), F.lit(1)).cast("int")), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1.0))
    g = g.join(total, "query_id", "left").fillna(0, ["relevant"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select("query_id", "relevant", *[zero(F.try_divide(F.col(f"h{k}"), F.col("relevant"))).alias(f"recall_{k}") for k in ks], *[(F.col(f"h{k}") / k).alias(f"precision_{k}") for k in ks], zero(1 / F.col("first")).alias("mrr"), F.when(F.col("h5") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), (F.coalesce("first", F.lit(0)) == 1).cast("int").alias("top1"))


class VectorStore:
    """Chunks with vectors as a stored table: add, search, save, load, size."""

    def __init__(self, index: DataFrame):
        self.index = index

    def add(self, more: DataFrame) -> VectorStore:
        """Appends without looking for repeats; indexing twice keeps both rows."""
        return VectorStore(self.index.unionByName(more))

    def search(self, queries: DataFrame, top_n: int = TOP_N) -> DataFrame:
        return dense_search(queries, self.index, top_n)

    def size(self) -> int:
        return self.index.count()

    def save(self, path: str) -> None:
        self.index.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> VectorStore:
        return cls(spark.read.parquet(path))
