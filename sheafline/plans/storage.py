"""Where intermediate tables live and when a table may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes beyond which a table is joined by shuffle instead of broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; a cluster
    without it is an error, because a machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors and keeps columnar pruning.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables as returned by ``stored``, once everything made from them is stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Stored ``df`` with a number ``row`` for each row, and of rows with equal ``keys`` the first one only.

    Keys and numbers are shuffled; the other columns are so only where many rows are repeated.
    """
    numbered = stored(df.withColumn("row", F.monotonically_increasing_id()))
    repeated = stored(numbered.groupBy(*keys).agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    others = stored(numbered.select(*keys, "row").join(small_or_shuffled(repeated), list(keys)).where("row <> first").select("row"))
    n = others.count()
    kept = stored(numbered.join(small_or_shuffled(others, n), "row", "left_anti")) if n else numbered
    drop_stored(repeated, others, *[numbered] * (n > 0))
    return kept


def small_or_shuffled(table: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast when its rows are within ``limit`` and the counted bytes of
    its values within BROADCAST_BYTES; otherwise leave the join to shuffle (with AQE splitting
    skewed partitions). A given number of ``rows`` bounds tables without long values only."""
    wide = [c for c, kind in table.dtypes if kind in ("string", "binary")]
    nested = [c for c, kind in table.dtypes if kind.startswith(("array", "map", "struct"))]
    if rows is None or (rows <= limit and (wide or nested)):
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(0))
        size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in nested), size)
        rows, held = table.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    else:
        held = 0
    return F.broadcast(table) if rows <= limit and held + 16 * rows * len(table.columns) <= BROADCAST_BYTES else table.hint("merge")
