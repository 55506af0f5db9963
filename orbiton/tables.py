"""Written tables in the folder that driver and executors share, dense ids and components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; set here only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orbiton/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the zero-based rank by the order columns, which must be unique. Range partitions are counted and
    numbered each for itself; only one count for each partition is summed in one place."""
    parts = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_r", rank).join(F.broadcast(base), "_p").withColumn(name, F.col("_b") + F.col("_r") - 1).drop("_p", "_r", "_b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge: the least node that it reaches.

    Rounds of two steps until nothing changes: every node links its greater neighbours to the least node
    around it, then each node links its neighbours' least and itself. Minima by key are joined back; no
    key gathers its neighbours.
    """
    now = written(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    mark = None
    while True:
        both = now.union(now.select("lo", "hi"))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        up = written(both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct())
        low = up.groupBy("hi").agg(F.min("lo").alias("m"))
        now = written(up.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(low.select("hi", F.col("m").alias("lo"))).distinct())
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if after == mark:
            break
        mark = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo")).groupBy("node").agg(F.min("component").alias("component"))


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
