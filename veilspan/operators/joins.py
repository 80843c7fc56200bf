"""Join and lineage helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16
LANES, ROWS_A_PIECE = 16, 1000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measured, not guessed: at most ``rows`` rows and ``size`` bytes. Reads no more than that."""
    width = F.octet_length(F.to_json(F.struct("*")))
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return seen["n"] <= rows and seen["b"] <= size


def lookup(left: DataFrame, right: DataFrame, on: str, spread_by: list[str], how: str = "left",
           small: bool | None = None) -> DataFrame:
    """Join to a table that is unique on ``on``, whatever the size of either and however hot a key.

    A measured small side is broadcast.  Otherwise both sides are shuffled with a salt taken
    from ``spread_by``, so that a key holding a large share of the rows is split.
    """
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def attach(df: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Left join extras that are unique on ``keys``; null keys find each other. Large rows move only if they must."""
    own = {k: f"_attached_{i}" for i, k in enumerate(keys)}
    right = extra.select(*[F.col(k).alias(own[k]) for k in keys], *[c for c in extra.columns if c not in own])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(right[own[k]]) for k in keys])
    return df.join(F.broadcast(right) if is_small(right) else right, same, "left").drop(*own.values())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate results; only local runs may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="veilspan-")
        gone_at_end(spark, folder)
    return folder.rstrip("/")


def gone_at_end(spark: SparkSession, folder: str) -> None:
    """``folder``, made if need be, is deleted when the driver's JVM ends: intermediate results may hold secrets."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)


def checkpoint_folder(spark: SparkSession) -> str:
    """Spark's checkpoint folder for this application alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    gone_at_end(spark, context.getCheckpointDir())
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor does not repeat the scan that made ``df``."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written aside once, by columns: what follows reads the columns it needs and repeats nothing.

    The folder is that of the checkpoints.  Types that Parquet does not know are checkpointed.
    """
    if re.search(r"\b(void|interval)\b|struct<>", df.schema.simpleString()):
        return cut_lineage(df)
    folder = f"{checkpoint_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table dealt anew if few tasks would hold most of them, as in a table of one small file: a scan costs far more than the move.

    Measured, from row counts alone.  Streams stay as they are.
    """
    if df.isStreaming:
        return df
    pieces = df.groupBy(F.spark_partition_id().alias("piece")).count()
    seen = pieces.agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"), F.coalesce(F.sum("count"), F.lit(0)).alias("all")).first()
    lanes = max(LANES, df.sparkSession.sparkContext.defaultParallelism)
    if seen["most"] * lanes <= seen["all"] or seen["most"] <= ROWS_A_PIECE:
        return df
    return df.repartition(min(4 * lanes, -(-seen["all"] // ROWS_A_PIECE)))


def rank_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``row_number`` per group that splits a large group over many tasks.

    Rows are range-partitioned by group and order and numbered inside each partition; a
    group's rows in earlier partitions are added from the totals.
    """
    ranged = cut_lineage(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (ranged.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
              .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows"))
    inside = Window.partitionBy(group, "_part").orderBy(*order)
    return (attach(ranged.withColumn(name, F.row_number().over(inside)), before, [group, "_part"])
            .withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_part", "_before"))
