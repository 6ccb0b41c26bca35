"""Splits that keep related pages together, balanced by component swap search.

Streams and sources form a graph; its connected components must not be divided. Components
start from a hashed split; whole components are then moved and exchanged by annealing chains
that run in parallel, and the best chain is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.functions.text import source_key
from sheafline.plans.storage import small_or_shuffled, stored
from sheafline.sources.tables import table

SPLITS, SHARES = ("train", "validation", "test"), (0.8, 0.1, 0.1)
#: A component with more than this share of all pages is moved by itself; there are at most
#: 1 / HEAVY of them. The others are moved in BUNDLES hashed groups of whole components.
HEAVY, BUNDLES = 0.0005, 2_000
CHAINS, STEPS = 12, 4_000


def linked(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component of ``edges(a, b)``.

    Large-star and small-star steps over distinct edges until nothing changes; every round is
    two grouped steps, and rounds grow with the logarithm of the longest path.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("r"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("u"), F.col("r").alias("v")).where("u <> v").distinct()
        # small star: each node hands its smaller neighbours and itself to its smallest one
        low = large.groupBy("u").agg(F.min("v").alias("r"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("r").alias("v")).unionByName(low.select("u", F.col("r").alias("v")))
        e = stored(moved.where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def stream_groups(pages: DataFrame) -> DataFrame:
    """``stream_id, group_key``: the smallest source of the stream's component, else its own id.

    A stream with several sources links them, so the graph's nodes are sources only. Pages
    with a null stream_id belong to no stream. Repeated rows change nothing. An empty table
    gives an empty result. Only ``stream_id`` and ``source`` are read.
    """
    pairs = pages.where("stream_id is not null").select("stream_id", source_key("source").alias("source")).distinct()
    firsts = pairs.groupBy("stream_id").agg(F.min("source").alias("first"), F.max("source").alias("last"))
    firsts = stored(firsts)
    # only streams of several sources make edges
    several = firsts.where("`first` <> `last`").select("stream_id", "first")
    edges = pairs.where("source is not null").join(several, "stream_id").select(F.col("first").alias("a"), F.col("source").alias("b"))
    roots = stored(linked(edges))
    roots = small_or_shuffled(roots.withColumnRenamed("node", "first"))
    return firsts.join(roots, "first", "left").select("stream_id", F.coalesce("root", "first", "stream_id").alias("group_key"))


def _unit(total: F.Column) -> F.Column:
    heavy = F.col("pages") > HEAVY * total
    return F.when(heavy, F.concat(F.lit("g"), "group_key", F.lit("|"), "sourced")).otherwise(F.format_string("b%d", F.pmod(F.xxhash64("group_key", "sourced"), F.lit(BUNDLES))))


def anneal(pages: np.ndarray, labels: np.ndarray, start: np.ndarray, seed: int, shares=SHARES, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Best cost and assignment of one chain: moves and exchanges of units, cooled to zero.

    Cost: squared deviation of each split's share of pages, plus that of its share of first pages.
    """
    rng = np.random.default_rng(seed)
    size = np.stack([pages / max(pages.sum(), 1), labels / max(labels.sum(), 1)], 1)
    goal = np.array(shares)[:, None]
    at = start.copy()
    load = np.stack([np.bincount(at, size[:, k], len(shares)) for k in range(2)], 1)
    weight = np.array([1.0, 0.1])
    cost = lambda x: float((((x - goal) ** 2) * weight).sum())
    now = best = cost(load)
    keep = at.copy()
    n = len(at)
    big = np.argsort(-pages)
    for step in range(steps if n else 0):
        heat = now * 0.3 * (1 - step / steps) ** 2
        i = int(big[min(int(n * rng.random() ** 2), n - 1)])
        change = load.copy()
        if step % 2 and n > 1:
            j = int(rng.integers(n))
            a, b = at[i], at[j]
            change[a] += size[j] - size[i]
            change[b] += size[i] - size[j]
            moves = ((i, b), (j, a))
        else:
            b = int(rng.integers(len(shares)))
            change[at[i]] -= size[i]
            change[b] += size[i]
            moves = ((i, b),)
        after = cost(change)
        if after <= now or rng.random() < np.exp((now - after) / max(heat, 1e-12)):
            for unit, to in moves:
                at[unit] = to
            load, now = change, after
            if now < best:
                best, keep = now, at.copy()
    return best, keep


def _chains(units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pages, labels, start = units.value
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                cost, at = anneal(pages, labels, start, seed)
                yield pa.RecordBatch.from_arrays([pa.array([cost]), pa.array([seed]), pa.array([[SPLITS[k] for k in at]], pa.list_(pa.string()))], names=["cost", "seed", "splits"])

    return run


def balanced_splits(pages: DataFrame) -> DataFrame:
    """``stream_id, group_key, split_name`` with whole components in one split.

    A component too large for a share goes where it deviates least. Nulls, repeats and empty
    tables as in ``stream_groups``; pages delivered twice count once.
    """
    spark = pages.sparkSession
    groups = stored(stream_groups(pages).withColumn("sourced", (F.col("group_key") == F.col("stream_id")).cast("int").cast("string")))
    sizes = pages.where("stream_id is not null").groupBy("stream_id", "original_position").agg(F.max(F.col("boundary") == 1).cast("int").alias("first"))
    sizes = sizes.groupBy("stream_id").agg(F.count("*").alias("pages"), F.sum("first").alias("firsts"))
    parts = stored(groups.join(sizes, "stream_id").groupBy("group_key", "sourced").agg(F.sum("pages").alias("pages"), F.coalesce(F.sum("firsts"), F.lit(0)).alias("firsts")))
    total = F.lit(parts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0])
    unit = parts.withColumn("unit", _unit(total))
    # at most 1 / HEAVY + BUNDLES rows, whatever the size of the input
    rows = unit.groupBy("unit").agg(F.sum("pages").alias("pages"), F.sum("firsts").alias("firsts"), F.min(F.pmod(F.xxhash64("unit"), F.lit(10))).alias("h")).orderBy("unit").toPandas()
    start = np.select([rows.h < 8, rows.h == 8], [0, 1], 2).astype(np.int64)
    held = spark.sparkContext.broadcast((rows.unit.tolist(), rows.pages.to_numpy(float), rows.firsts.to_numpy(float), start))
    chains = spark.range(0, CHAINS, 1, CHAINS).mapInArrow(_chains(held), "cost double, seed long, splits array<string>")
    best = chains.orderBy("cost", "seed").first()
    chosen = spark.createDataFrame(list(zip(rows.unit.tolist(), best["splits"])) if len(rows) else [], "unit string, split_name string")
    placed = unit.join(F.broadcast(chosen), "unit").select("group_key", "sourced", "split_name")
    return groups.join(placed, ["group_key", "sourced"]).select("stream_id", "group_key", "split_name")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return stream_groups(table(spark, folder, "stream_pages", "stream_id", "source"))


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    return balanced_splits(table(spark, folder, "stream_pages", "stream_id", "original_position", "boundary", "source"))


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and share of each split."""
    pages = table(spark, folder, "stream_pages", "stream_id", "original_position").distinct()
    n = pages.join(p4_splits(spark, folder), "stream_id").groupBy("split_name").agg(F.count("*").alias("pages"))
    return n.withColumn("share", F.col("pages") / F.sum("pages").over(Window.partitionBy()))


QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits, "p4_shares": p4_shares}
SQL = {
    "p4_found": r"""
with recursive p as (select distinct stream_id, nullif(trim(lower(trim(source, chr(32) || chr(9) || chr(10) || chr(13)))), '') s from stream_pages where stream_id is not null),
     e as (select distinct x.s a, y.s b from p x join p y using (stream_id)),
     r as (select a, b from e where a is not null union select r.a, e.b from r join e on r.b = e.a),
     m as (select a, min(b) root from r group by a)
select stream_id, coalesce(min(root), stream_id) group_key from p left join m on p.s = m.a group by stream_id""",
}
