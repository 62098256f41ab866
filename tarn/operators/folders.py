"""Folders as intervals: in the order of path components a folder's subtree is one run of rows, so questions about subtrees are
comparisons of numbers, and deep paths are not exploded by ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.sources.scratch import store


def _scanned(rows: DataFrame, order: list[str], how: dict[str, Column]) -> DataFrame:
    """rows with running values in a total order: range partitions are scanned apart, and each is told what those before it hold (one row a
    partition). how: name to an aggregate, sum or max, of a column of rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = store(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))  # ranges are sampled: once
    near = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({k: v.over(near) for k, v in how.items()})
    ends = ranged.groupBy("_part").agg(*(v.alias(f"_{k}") for k, v in how.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    again = {k: F.sum(f"_{k}") if k.startswith("n_") else F.max(f"_{k}") for k in how}
    ends = ends.select("_part", *(again[k].over(before).alias(f"_before_{k}") for k in how))
    joined = local.join(F.broadcast(ends), "_part")
    met = {k: F.col(k) + F.coalesce(f"_before_{k}", F.lit(0)) if k.startswith("n_") else F.greatest(k, f"_before_{k}") for k in how}
    return joined.withColumns(met).drop("_part", *(f"_before_{k}" for k in how))


def intervals(nodes: DataFrame) -> DataFrame:
    """nodes(id, path, ...) with first and last: a node's number in the order of path components (ties by id), and that of the last node below
    it (its own, if there is none). Of nodes on one path each has the subtree below it.

    Components compare like the path with a character below all others for each slash; a node's end is a marker with the next
    character, so one pass over nodes and markers counts what lies between.
    """
    key = F.replace(F.col("path"), F.lit("/"), F.lit("\x00"))
    rows = nodes.select(key.alias("key"), F.lit(1).alias("real"), "id", F.struct("*").alias("row"))
    marks = nodes.select(F.concat(key, F.lit("\x01")).alias("key"), F.lit(0).alias("real"), "id", F.lit(None).alias("row"))
    counted = store(_scanned(rows.unionByName(marks), ["key", "real", "id"], {"n_before": F.sum("real")}))
    last = counted.filter("real = 0").select("id", F.col("n_before").alias("last"))
    return counted.filter("real = 1").select("id", "row", F.col("n_before").alias("first")).join(last, "id").select("row.*", "first", "last")


def under(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """(folder, id) of intervals() rows below each asked(folder, first, last), the folder itself too. Few folders are asked, so they are
    what is broadcast, by Spark's own measure."""
    rows = placed.select("id", F.col("first").alias("at"))
    return asked.join(rows, (F.col("at") >= F.col("first")) & (F.col("at") <= F.col("last"))).select("folder", "id")


def below(placed: DataFrame, marked: Column) -> DataFrame:
    """intervals() rows with `inside`: whether a marked row lies above them. Subtrees nest, so the farthest end of the marked rows before a row
    tells, and that is a running maximum: no join, whatever the number of marks."""
    reach = F.when(marked, F.col("last"))
    rows = placed.withColumn("_reach", reach)
    # a row's own mark must not count, so its reach is moved behind it
    steps = rows.select(F.struct(*placed.columns).alias("row"), F.col("first").alias("at"), F.lit(0).alias("after"), F.lit(None).cast("long").alias("reach"))
    marks = rows.filter(marked).select(F.lit(None).alias("row"), F.col("first").alias("at"), F.lit(1).alias("after"), F.col("_reach").alias("reach"))
    made = _scanned(steps.unionByName(marks), ["at", "after"], {"farthest": F.max("reach")}).filter("after = 0")
    return made.select("row.*", F.coalesce(F.col("farthest") >= F.col("at"), F.lit(False)).alias("inside"))


def subtree_sizes(placed: DataFrame) -> DataFrame:
    """(id, path, below): how many nodes lie below each."""
    return placed.select("id", "path", (F.col("last") - F.col("first")).alias("below"))
