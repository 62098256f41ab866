"""Helpers shared by the training-data operators: shared-folder tables, skew-safe lookups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key heavier than total / HOT_PARTS is "hot"; at most HOT_PARTS keys can be, which bounds what is broadcast.
HOT_PARTS = 2048
#: A bitmap of more than 2^MAX_BITS bits (32 MB) is not broadcast.
MAX_BITS = 28
_fallback_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (only if that is unset in local mode, as in tests) a
    temporary one. On a cluster an unset folder is an error, since executors do not see each other's."""
    global _fallback_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _fallback_dir is None:
        _fallback_dir = "file://" + tempfile.mkdtemp(prefix="tarn-shared-")
    return _fallback_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's file system client closes."""
    path = f"{shared_dir(spark)}/tarn/{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path.getParent())
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of new_path() that nothing reads any more."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does just that on pure ASCII, and far faster than translate()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def _slot(on: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(1 << bits)) + 1


def bitmap_of(keys: DataFrame, on: Sequence[str], bits: int) -> DataFrame:
    """A one-hash Bloom filter of the keys as rows (bucket, bits): at most 2^bits / 8 bytes, whatever the input."""
    slots = keys.select(_slot(on, bits).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))


def in_bitmap(rows: DataFrame, on: Sequence[str], bitmap: DataFrame, bits: int) -> DataFrame:
    """Rows whose key may be in the bitmap, which is broadcast; no row whose key is in it is lost."""
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(_slot(on, bits))).withColumn("_at", F.bitmap_bit_position(_slot(on, bits)))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    set_bit = byte.bitwiseAND(F.pow(F.lit(2), F.col("_at") % 8).cast("int")) != 0
    return marked.join(F.broadcast(bitmap), "_bucket").filter(set_bit).select(*rows.columns)


def may_be_among(rows: DataFrame, on: Sequence[str], keys: DataFrame, n_keys: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows whose key may be among the keys; no row whose key is among them is lost. A bitmap of 16 to 32 bits a key tells; keys
    that need more than 2^max_bits bits are joined by shuffle instead, and then the answer is exact."""
    bits = max(16, (16 * n_keys).bit_length())
    if bits > max_bits:
        return rows.join(keys.select(*on).distinct(), list(on), "left_semi")
    return in_bitmap(rows, on, bitmap_of(keys, on, bits), bits)


def hot_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, total: int, spread: Column) -> DataFrame:
    """left LEFT JOIN right, where right has one row a key and `weight` is how many left rows have that key.

    Keys heavier than total / HOT_PARTS are at most HOT_PARTS, so that part of right is broadcast; their left rows then go
    through the shuffled join for the other keys on a salt (from `spread`) that matches nothing, spread over all tasks.
    """
    limit = max(1, total // HOT_PARTS)
    values = [c for c in right.columns if c not in on]
    hot = right.filter(F.col(weight) > limit).select(*on, F.struct(*values).alias("_hot"))
    cold = right.filter(F.col(weight) <= limit).select(*on, F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    salted = left.join(F.broadcast(hot), list(on), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise((-1 - F.pmod(F.xxhash64(spread), F.lit(65536))).cast("int"))
    )
    joined = salted.join(cold, [*on, "_salt"], "left").withColumn("_hit", F.coalesce("_hot", "_cold"))
    return joined.select(*[c for c in left.columns], *[F.col("_hit")[v].alias(v) for v in values])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): (node, root), root the smallest node of its component; nodes on edges only.

    Alternating large-star and small-star (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): every
    round is a map-side combined minimum and one join, written to the shared folder; only two numbers reach the driver.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").filter("a <> b")
    current = stored(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        sides = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sides.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = stored(small.filter("u <> v").distinct(), "cc")
        state = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        current = following
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
